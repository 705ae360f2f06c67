"""The repair loop: scan, propose, verify, apply, a few attempts a finding; as rounds over state tables.

Findings are made once. Each round asks a predictor about every finding that no attempt has settled, checks its answers,
and applies the patches to the files' present contents: file by file, in order of the findings, so that a patch sees what
was accepted before it and is refused where its context is gone. A refused finding is asked again in the next round, with
the answer, the reason and the present file. Rounds end when nothing is open, or after `rounds`.

State is three tables below one path: findings, and for each round its attempts and the files that it changed. A run that
was cut off goes on after the last whole round; the predictor is not asked again for what is written. Only files with an
open finding are read in a round, and only those that changed are written.

Defined results: files of null content, or that do not parse, have no findings and stay as they are. Answers that are no
JSON object, lack a key, name another finding or hold no patch are refused, as are patches that the rules before applying
refuse, that do not apply, change nothing, no longer parse, or leave more findings of any check. Paths must be unique.
Tests of a repository are not run: what else must hold is a column expression of the caller's, `accept`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import code
from quarrymill.functions import code_columns as C
from quarrymill.functions import text as X
from quarrymill.operators import relational
from quarrymill.streaming.predict import Predictor, predictions

ROUNDS = 3
KEYS = ("finding_id", "summary", "patch")
#: Characters of a refused answer that are shown again.
SHOWN = 5000
#: Findings that one task asks about. Their rows are few bytes, by which Spark would put all of them into one task or two.
FINDINGS_A_TASK = 2000
_RESULT = "array<struct<id string, accepted boolean, reason string>>"


def _asked(open_: DataFrame) -> DataFrame:
    """id and prompt; open_: a finding with its file's present content, and its last answer and refusal (null at first)."""
    about = F.concat(
        F.lit("Finding ID: "), "id", F.lit("\nCheck: "), "check", F.lit("\nFile: "), "file", F.lit("\nLine: "), F.col("line").cast("string"), F.lit("\nMessage: "), "message", F.lit("\n"),
    )
    rules = f"Answer with a JSON object of the text keys {', '.join(KEYS)} and no other; the patch is the smallest unified diff of this file alone and adds no dependency.\n\n"
    first = F.concat(F.lit("Repair one finding. " + rules), about, F.lit("\nExcerpt:\n"), relational.context_lines(F.col("content"), F.col("line")))
    again = F.concat(
        F.lit("A patch was refused; mend it against the file as it is now. " + rules), about, F.lit("Refused because: "), "refusal",
        F.lit("\n\nRefused answer:\n"), F.expr(f"right(coalesce(answer, ''), {SHOWN})"), F.lit("\n\nFile now:\n"), "content",
    )
    return open_.select("id", F.when(F.col("refusal").isNull(), first).otherwise(again).alias("prompt"))


def _why_not(most: int) -> Column:
    """Why an answer is refused before its patch is tried, or null."""
    field = lambda k: F.get_json_object("output", f"$.{k}")
    return F.coalesce(
        F.when(F.col("invalid_json"), F.concat(F.lit("no JSON object: "), F.coalesce("error", F.lit("")))),
        F.when(~F.coalesce(X.has_schema(F.col("output"), dict.fromkeys(KEYS, "STRING")), F.lit(False)), F.lit("keys or kinds are wrong")),
        F.when(field("finding_id") != F.col("id"), F.lit("names another finding")),
        X.preflight(field("patch"), F.col("file"), F.lit(True), code.BANNED_ADDITIONS, most),
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, content and tries (in order of findings) to file, new content (null if unchanged) and results."""
    for batch in (piece for whole in batches for piece in C.slices(whole)):
        after, results = [], []
        for content, tries in zip(batch.column("content").to_pylist(), batch.column("tries").to_pylist(), strict=True):
            now, told, counts = content, [], None
            for x in tries:
                reason = x["why"]
                if reason is None:
                    got = code.apply_patch(now, x["patch"])
                    if not got.ok:
                        reason = f"does not apply: {got.error}"
                    elif got.text == now:
                        reason = "changes nothing"
                    elif (found := code.findings(got.text)) is None:
                        reason = "no longer parses"
                    else:
                        counts = code.finding_counts(now) if counts is None else counts
                        new = Counter(f["check"] for f in found)
                        worse = sorted(k for k, n in new.items() if n > counts.get(k, 0))
                        if worse:
                            reason = f"more findings: {', '.join(worse)}"
                        else:
                            now, counts = got.text, new
                told.append({"id": x["id"], "accepted": reason is None, "reason": reason or "accepted"})
            after.append(now if now != content else None)
            results.append(told)
        kind = pa.list_(pa.struct([("id", pa.string()), ("accepted", pa.bool_()), ("reason", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(after, pa.string()), pa.array(results, kind)], ["file", "content", "results"])


def _there(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _once(spark, path: str, make) -> DataFrame:
    """The table at path; made and written unless a whole one is there."""
    if not _there(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _now(files: DataFrame, changed: list[DataFrame]) -> DataFrame:
    """path and content after rounds, the last change of each file."""
    out = files.select("path", "content")
    for i, x in enumerate(changed):
        new = x.select(F.col("file").alias("path"), F.col("content").alias(f"_c{i}"))
        out = out.join(new, "path", "left").select("path", F.coalesce(f"_c{i}", "content").alias("content"))
    return out


def repair(files: DataFrame, predictor: Predictor, state: str, rounds: int = ROUNDS, most: int = 40, accept: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, attempts (id, attempt, invalid_json, accepted, reason, answer) and the files at the end (path, content).

    files: path, content. accept: a condition on id, file, check, output and patch that an answer must meet as well.
    """
    spark = files.sparkSession
    files = files.select("path", "content")
    found = _once(spark, f"{state}/findings", lambda: C.scan(files)[0])
    attempts: list[DataFrame] = []
    changed: list[DataFrame] = []
    for n in range(1, rounds + 1):
        at = f"{state}/round={n}"

        def left(attempts=attempts):
            settled = [a.where("accepted").select("id") for a in attempts]
            out = found
            for s in settled:
                out = out.join(s, "id", "left_anti")
            return out

        tasks = 1
        if not _there(spark, f"{at}/attempts"):
            tasks = -(-left().count() // FINDINGS_A_TASK)
            if not tasks:
                break

        def answers(attempts=attempts, changed=changed, left=left, tasks=tasks):
            last = attempts[-1].select("id", F.col("reason").alias("refusal"), "answer") if attempts else None
            open_ = left().join(_now(files, changed).withColumnRenamed("path", "file"), "file")
            open_ = open_.join(last, "id", "left") if last is not None else open_.withColumns({"refusal": F.lit(None).cast("string"), "answer": F.lit(None).cast("string")})
            return predictions(_asked(open_.repartition(tasks, "id")), predictor).select("id", "invalid_json", "output", "error", F.col("raw_output").alias("answer"))

        said = _once(spark, f"{at}/answers", answers)

        def applied(said=said, changed=changed, tasks=tasks):
            patch = F.get_json_object("output", "$.patch")
            why = _why_not(most) if accept is None else F.coalesce(_why_not(most), F.when(~F.coalesce(accept, F.lit(False)), F.lit("is not accepted")))
            tries = said.join(found, "id").withColumn("patch", patch).withColumn("why", why)
            by_file = tries.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "id", "patch", "why"))).alias("tries"))  # a file's findings
            now = _now(files, changed).withColumnRenamed("path", "file")
            return by_file.join(now, "file").select("file", "content", "tries").repartition(tasks, "file").mapInArrow(_apply, f"file string, content string, results {_RESULT}")

        done = _once(spark, f"{at}/applied", applied)
        told = done.select(F.explode("results").alias("r")).select("r.*")
        facts = told.join(said.select("id", "invalid_json", "answer"), "id").select("id", F.lit(n).alias("attempt"), "invalid_json", "accepted", "reason", "answer")
        attempts.append(_once(spark, f"{at}/attempts", lambda facts=facts: facts))
        changed.append(done.where("content IS NOT NULL").select("file", "content"))
    every = attempts[0] if attempts else spark.createDataFrame([], "id string, attempt int, invalid_json boolean, accepted boolean, reason string, answer string")
    for a in attempts[1:]:
        every = every.unionByName(a)
    return found, every, _now(files, changed)


def summary(files: DataFrame, found: DataFrame, attempts: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files, findings before and after, findings settled and refused to the end, attempts."""
    rest = after.select(F.explode(C.code_findings("content")).alias("f"))
    last = attempts.groupBy("id").agg(F.bool_or("accepted").alias("ok"))
    counts = (
        files.agg(F.count("*").alias("python_files")), found.agg(F.count("*").alias("ast_findings")), rest.agg(F.count("*").alias("final_ast_findings")),
        last.agg(F.count_if("ok").alias("accepted_patches"), F.count_if(~F.col("ok")).alias("rejected_patches")), attempts.agg(F.count("*").alias("attempts")),
    )
    out = counts[0]
    for x in counts[1:]:
        out = out.join(F.broadcast(x))  # one row each
    return out


class RulePatcher:
    """Mends what a line of the shown code does, by a table of rules; a stand-in for a model, and as fallible as one.

    The first answer about a run-time evaluation in a function of an even number is cut off; the first two about a command
    in a function whose number divides by three have a context that the file lacks. Of a secret it makes code that is none.
    """

    RULES = {"dynamic-execution": ("eval(value)", "ast.literal_eval(value)"), "os-system": ("os.system(value)", "subprocess.run([value], check=True)"), "hardcoded-secret": ('"', "'")}

    def infer_batch(self, prompts: list[str]) -> list[str]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> str:
        import json
        import re

        fact = lambda name: re.search(rf"^{name}: (.*)$", prompt, re.M)[1]
        again = "Refused answer:" in prompt
        if again:
            source = prompt.rpartition("File now:\n")[2].split("\n")
            first = 1
        else:
            shown = prompt.rpartition("Excerpt:\n")[2].split("\n")
            first, source = int(shown[0][:5]), [x[7:] for x in shown]
        check, before = fact("Check"), self.RULES[fact("Check")]
        at = next(i for i, x in enumerate(source) if before[0] in x and (check != "hardcoded-secret" or "password" in x))
        number = int(next(m[1] for x in source if (m := re.match(r"def run_(\d+)\(", x))))
        tries = 0 if not again else 1 + prompt.count("TRIED ONCE")
        line = first + at
        head = [f"--- a/{fact('File')}", f"+++ b/{fact('File')}", f"@@ -{line - 1},2 +{line - 1},2 @@"]
        patch = [*head, f" {source[at - 1]}", f"-{source[at]}", f"+{source[at].replace(*before, 1)}"]
        if check == "os-system" and number % 3 == 0 and tries < 2:
            patch[3] = f"     tried = {'0' * tries}"
        answer = json.dumps({"finding_id": fact("Finding ID"), "summary": f"Mended. {'TRIED ONCE' if again else ''}", "patch": "\n".join(patch) + "\n"})
        return answer[:-9] if check == "dynamic-execution" and number % 2 == 0 and not again else answer
