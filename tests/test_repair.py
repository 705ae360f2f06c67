"""The repair loop: rounds, reasons, order within a file, resumption."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from quarrymill.plans import repair

SOURCE = "import os\n\n\ndef run_{0}(value):\n    total = len(value)\n    total = eval(value)\n    os.system(value)\n    return total\n"
FILES = [("a.py", SOURCE.format(1)), ("b.py", SOURCE.format(2)), ("c.py", "x = 1\n"), ("d.py", "def (\n"), ("e.py", None)]


class Counting(repair.RulePatcher):
    """Fails if it is asked at all."""

    def infer_batch(self, prompts):
        raise MemoryError("asked again")


class Fixed:
    """One answer for all findings of a file, by its number."""

    def __init__(self, answers):
        self.answers = answers

    def infer_batch(self, prompts):
        fact = lambda p, name: p.split(f"{name}: ", 1)[1].split("\n")[0]
        return [self.answers[int(fact(p, "File")[1])].replace("ID", fact(p, "Finding ID")).replace("FILE", fact(p, "File")) for p in prompts]


def told(attempts):
    return sorted((r.id, r.attempt, r.accepted, r.reason.partition(":")[0]) for r in attempts.collect())


def test_rounds_settle_findings_in_order(spark, tmp_path):
    files = spark.createDataFrame(FILES, "path string, content string")
    state = str(tmp_path / "state")
    found, attempts, after = repair.repair(files, repair.RulePatcher(), state)
    # odd: the evaluation is mended first, so that the command's patch lacks its context and is made anew
    want = [
        ("AST-0001", 1, True, "accepted"), ("AST-0002", 1, False, "does not apply"), ("AST-0002", 2, True, "accepted"),
        ("AST-0003", 1, False, "no JSON object"), ("AST-0003", 2, True, "accepted"), ("AST-0004", 1, True, "accepted"),
    ]
    assert told(attempts) == want
    now = {r.path: r.content for r in after.collect()}
    mended = SOURCE.replace("eval(", "ast.literal_eval(").replace("os.system(value)", "subprocess.run([value], check=True)")
    assert now == {"a.py": mended.format(1), "b.py": mended.format(2), "c.py": "x = 1\n", "d.py": "def (\n", "e.py": None}
    facts = repair.summary(files, found, attempts, after).first()
    assert facts.asDict() == {"python_files": 5, "ast_findings": 4, "final_ast_findings": 0, "accepted_patches": 4, "rejected_patches": 0, "attempts": 6}
    # all is written: nobody is asked again
    again = repair.repair(files, Counting(), state)
    assert told(again[1]) == want and {r.path: r.content for r in again[2].collect()} == now


def test_a_cut_off_run_goes_on_after_its_last_whole_table(spark, tmp_path):
    files = spark.createDataFrame(FILES, "path string, content string")
    state = str(tmp_path / "state")
    repair.repair(files, repair.RulePatcher(), state, rounds=1)
    (tmp_path / "state/round=1/attempts/_SUCCESS").unlink()
    _, attempts, _ = repair.repair(files, repair.RulePatcher(), state)
    assert [x[1] for x in told(attempts)] == [1, 1, 2, 1, 2, 1]


def test_answers_are_refused_for_what_they_are(spark, tmp_path):
    head = "--- a/FILE\n+++ b/FILE\n"
    cases = {
        "keys or kinds are wrong": {"finding_id": "ID", "summary": "s"},
        "names another finding": {"finding_id": "other", "summary": "s", "patch": head},
        "no change": {"finding_id": "ID", "summary": "s", "patch": head},
        "must change the finding's file and no other": {"finding_id": "ID", "summary": "s", "patch": "--- a/z.py\n+++ b/z.py\n@@ -1 +1 @@\n-a\n+b\n"},
        "adds a banned pattern": {"finding_id": "ID", "summary": "s", "patch": f"{head}@@ -1 +1 @@\n-import os\n+eval(1)\n"},
        "does not apply": {"finding_id": "ID", "summary": "s", "patch": f"{head}@@ -1 +1 @@\n-import re\n+import io\n"},
        "changes nothing": {"finding_id": "ID", "summary": "s", "patch": f"{head}@@ -1 +1 @@\n-import os\n+import os\n"},
        "no longer parses": {"finding_id": "ID", "summary": "s", "patch": f"{head}@@ -1 +1 @@\n-import os\n+import (\n"},
        "more findings": {"finding_id": "ID", "summary": "s", "patch": f"{head}@@ -1 +1,2 @@\n import os\n+password = 'not-to-be-told'\n"},
        "is not accepted": {"finding_id": "ID", "summary": "s", "patch": f"{head}@@ -1 +1,2 @@\n import os\n+import ast\n"},
    }
    files = spark.createDataFrame([(f"f{i}.py", FILES[0][1]) for i in range(len(cases))], "path string, content string")
    accept = ~F.col("patch").contains("import ast")
    found, attempts, after = repair.repair(files, Fixed([json.dumps(x) for x in cases.values()]), str(tmp_path / "state"), rounds=1, accept=accept)
    got = {(r.file, r.reason.partition(":")[0]) for r in attempts.join(found, "id").collect()}
    assert got == {(f"f{i}.py", why) for i, why in enumerate(cases)}
    assert {r.content for r in after.collect()} == {FILES[0][1]}


def test_nothing_to_repair(spark, tmp_path):
    files = spark.createDataFrame(FILES[2:], "path string, content string")
    for part in (files, files.limit(0)):
        found, attempts, after = repair.repair(part, Counting(), str(tmp_path / str(part.count())))
        assert (found.count(), attempts.count(), after.count()) == (0, 0, part.count())


def test_files_are_tried_a_few_rows_at_a_time():
    import pyarrow as pa
    from quarrymill.functions import code_columns
    from quarrymill.plans import repair as loop

    tries = pa.list_(pa.struct([("line", pa.int32()), ("id", pa.string()), ("patch", pa.string()), ("why", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}.py" for i in range(200)]), pa.array(["x = 1\n"] * 200), pa.array([[]] * 200, tries)], ["file", "content", "tries"])
    out = list(loop._apply(iter([batch])))
    assert sum(len(b) for b in out) == 200 and max(len(b) for b in out) <= code_columns.SLICE


class Placed(repair.RulePatcher):
    """Says which task it was asked in, by an answer that is none the first time."""

    def infer_batch(self, prompts):
        from pyspark import TaskContext

        return [x if "Refused answer:" in p else f"task {TaskContext.get().partitionId()}" for p, x in zip(prompts, super().infer_batch(prompts), strict=True)]


def test_rounds_use_tasks_by_findings_however_few_bytes_these_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "FINDINGS_A_TASK", 4)
    files = spark.createDataFrame([(f"f{i}.py", SOURCE.format(2 * i)) for i in range(20)], "path string, content string")
    found, attempts, after = repair.repair(files, Placed(), str(tmp_path / "state"))
    assert len({r.answer for r in attempts.where("attempt = 1").collect()}) > 4
    for table in ("answers", "applied"):
        assert len(list((tmp_path / f"state/round=2/{table}").glob("part-*.parquet"))) > 4
    assert found.count() == 40 and after.where("content LIKE '%ast.literal_eval%'").count() == 20


def test_a_text_is_scanned_once_for_what_is_asked_of_it(spark, monkeypatch):
    import pyarrow as pa
    from quarrymill.functions import code
    from quarrymill.functions import code_columns as C

    seen = []
    scan = code.findings
    monkeypatch.setattr(code, "findings", lambda text: (seen.append(text), scan(text))[1])
    patch = code.make_patch("eval(1)\n", "x = 1\n", "a.py")
    kind = pa.list_(pa.struct([("line", pa.int32()), ("id", pa.string()), ("patch", pa.string()), ("why", pa.string())]))
    tries = [[{"line": 1, "id": "a", "patch": patch, "why": None}], [{"line": 1, "id": "b", "patch": "", "why": "no change"}]]
    batch = pa.RecordBatch.from_arrays([pa.array(["a.py", "b.py"]), pa.array(["eval(1)\n", "eval(2)\n"]), pa.array(tries, kind)], ["file", "content", "tries"])
    out = pa.Table.from_batches(list(repair._apply(iter([batch])))).to_pylist()
    assert [(r["content"], [x["accepted"] for x in r["results"]]) for r in out] == [("x = 1\n", [True]), (None, [False])]
    assert sorted(seen) == ["eval(1)\n", "x = 1\n"]
    files = spark.createDataFrame(FILES, "path string, content string")
    found, errors = C.scan(files)
    assert all("ArrowEvalPython" not in x._jdf.queryExecution().executedPlan().toString() for x in (found, errors))
    assert found.count() == 4 and errors.count() == 2
