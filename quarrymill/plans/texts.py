"""Text queries: conversations, JSON, licenses, names, patterns, context, answers, and code functions over made-up code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import code_columns as C
from quarrymill.functions import text as X
from quarrymill.functions.code import BANNED_ADDITIONS, SECRET_NAME
from quarrymill.operators import relational as R


#: A secret's name with a value after it.
SECRET_ASSIGNED = "(?i)" + SECRET_NAME.pattern.removesuffix("$") + r"\s*[:=]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messages(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(ordered.alias("messages"))


def conversation_roles(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


def conversation_violations(spark, sf_dir):
    """Rules that a conversation breaks: it must start with user or system, take turns, and end with the assistant."""
    roles = F.transform("messages", lambda m: m["role"])
    held = _messages(spark, sf_dir).select("conv_id", roles.alias("r"))
    body = F.filter("r", lambda x: x != "system")
    turns = F.exists(F.transform(F.sequence(F.lit(0), F.size(body) - 1), lambda i: F.get(body, i) == F.get(body, i + 1)), lambda x: x)
    rules = [(~F.get("r", F.lit(0)).isin("user", "system"), "start"), (F.element_at("r", -1) != "assistant", "end"), ((F.size(body) > 1) & turns, "turns")]
    return held.select("conv_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).alias("rule"))


def chat_render(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", F.sha2(X.chat_text(F.col("messages")), 256).alias("rendered_sha256"))


def strict_json(spark, sf_dir):
    """Properties as strict JSON objects with exactly the key k, a whole number."""
    e = _table(spark, sf_dir, "events").select("event_id", "props")
    return e.select("event_id", X.strict_object(F.col("props")).alias("is_object"), X.has_schema(F.col("props"), {"k": "BIGINT"}).alias("has_schema"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def license_detect(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = X.terms_found(F.coalesce("text", F.lit("")), ["license", "copyright", "all rights reserved", "non-commercial", "research only"])
    return docs.select("doc_id", X.license_id(F.coalesce("text", F.lit(""))).alias("license"), F.coalesce("text", F.lit("")).rlike(X.APACHE).alias("apache_like"), F.array_join(found, ",").alias("terms"))


def license_status(spark, sf_dir):
    """A decision per document: the first rule that holds, and counts by status with absent ones at 0."""
    docs = license_detect(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    status = F.when(F.col("n_chars") == 0, "skipped").when(F.col("terms") == "", "unknown").when(F.col("license") == "Apache-2.0", "train_allowed").otherwise("baseline_only")
    return R.dense_counts(docs.select(status.alias("status")), "status", ["train_allowed", "baseline_only", "skipped", "unknown"])


def slugs(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", X.tag_slug(u).alias("slug"), X.safe_name(u).alias("safe"), X.uri_path(u).alias("path"), X.cwe_normalised(u).alias("cwe"), u.rlike(X.REPOSITORY_URL).alias("is_repository"))


def cwe_ids(spark, sf_dir):
    name = F.concat(F.lit("x_"), F.regexp_replace("p_name", " ", "_"), F.lit("_cwe"), F.col("p_size").cast("string"), F.lit(".py"))
    made = _table(spark, sf_dir, "part").select("p_partkey", name.alias("id"))
    return made.select("p_partkey", X.cwe_from_id(F.col("id")).alias("cwe"), X.file_of_id(F.col("id")).alias("file"), X.without_space(F.col("id")).alias("bare"))


def fence_extract(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "`", "")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```python\n"), t, F.lit("\n```\nDone"))).otherwise(F.concat(F.lit("code: "), t))
    return docs.select("doc_id", F.sha2(X.fenced_code(raw), 256).alias("code_sha256"))


def pattern_scan(spark, sf_dir):
    """Secret-like assignments and banned calls in documents and pages."""
    d = _table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = _table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return d.unionByName(p).select("kind", "id", F.coalesce(F.col("text").rlike(SECRET_ASSIGNED), F.lit(False)).alias("secret"), F.coalesce(F.col("text").rlike("|".join(BANNED_ADDITIONS)), F.lit(False)).alias("banned"))


def context_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    at = F.pmod("doc_id", F.size(F.split("text", "\n"))).cast("int") + 1
    return docs.select("doc_id", F.md5(R.context_lines(F.col("text"), at, 2)).alias("context_md5"), F.right(F.col("text"), F.lit(40)).alias("tail"))


def finding_rank(spark, sf_dir):
    """Numbers in texts as findings, with ids in order of (document, place); the ids are made without a single task."""
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("file"), F.posexplode(F.regexp_extract_all("text", F.lit(r"([0-9]+)"), 1)).alias("place", "number"))
    return C.number_rows(rows, ["file", "place"], "AST-%04d").select("file", F.col("place").cast("long").alias("place"), "number", "id")


def suffix_join(spark, sf_dir):
    """Pages' paths met with the first path that they end with."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("uri"))
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_partkey").alias("ord"))
    return R.suffix_match(pages, "uri", parts, "path", "ord").select("page_id", "path")


def predict_map(spark, sf_dir):
    """A rule as predictor, through the same hook as any model's."""
    from quarrymill.streaming.predict import RulePredictor, predictions

    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("prompt"))
    return predictions(docs, RulePredictor(40)).select("id", "invalid_json", F.get_json_object("output", "$.label").alias("label"))


def stream_resume(spark, sf_dir):
    """Events read as a stream into a log, twice with one checkpoint; the second run adds nothing."""
    from quarrymill.streaming.resume import run_available

    out = run_available(spark, f"{sf_dir}/events.parquet", lambda df: df.where("event_type = 'purchase'").select("event_id", "user_id", "value"), runs=2)
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


SNIPPETS = {
    0: "import os\npath = input()\nos.system('ls ' + path)\n",
    1: "import subprocess as sp\nsp.run('ls', shell=True)\n",
    2: "from pickle import loads as rd\ndata = rd(b'')\n",
    3: "import yaml\nyaml.load('a', Loader=yaml.SafeLoader)\n",
    4: "import yaml\nyaml.load('a')\n",
    5: "api_key = 'a1b2c3d4e5'\n",
    6: "name = input()\nq = f'select {name}'\ncur.execute(q)\n",
    7: "def f(x):\n    # note\n    return x + 1\n",
    8: "def broken(:\n",
    9: "open(input())\neval('1')\n",
}


def _sources(spark, sf_dir):
    """A snippet for each part, by its key."""
    rows = spark.createDataFrame(list(SNIPPETS.items()), "k int, code string")
    part = _table(spark, sf_dir, "part").select("p_partkey", F.pmod("p_partkey", F.lit(10)).cast("int").alias("k"))
    return part.join(F.broadcast(rows), "k")  # ten rows


def scan_findings(spark, sf_dir):
    """Findings of made-up code, by the table function's rules."""
    found = _sources(spark, sf_dir).select("p_partkey", F.explode(C.code_findings("code")).alias("f"))
    return found.select("p_partkey", "f.check", "f.severity", "f.line")


def scan_findings_sql(spark, sf_dir):
    """The same through SQL, as a lateral table function."""
    C.register_udfs(spark)
    return spark.sql(
        "SELECT p_partkey, check, severity, line FROM {sources} s, LATERAL scan_findings(s.code)", sources=_sources(spark, sf_dir)
    )


def structural_code(spark, sf_dir):
    """How many parts share a token form and a structure."""
    s = _sources(spark, sf_dir).select(F.col("k").cast("long").alias("k"), C.py_parses("code").alias("parses"), C.norm_code("code").alias("tokens"), C.struct_code("code").alias("tree"))
    return s.groupBy("k").agg(F.count("*").alias("n"), F.bool_and("parses").alias("parses"), F.countDistinct("tokens").alias("token_forms"), F.countDistinct("tree").alias("structures"))


#: Documents of a task that makes patches: what a Python worker is sent at once follows from it, not from the table's size.
DOCS_A_TASK = 500


def _spread(spark, sf_dir):
    """Documents, a few in each task."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text").repartition(max(1, -(-docs.count() // DOCS_A_TASK)), "doc_id")


def patch_round_trip(spark, sf_dir):
    """Documents' patches to changed copies: they apply, give the copy, and touch the lines that changed."""
    docs = _spread(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.concat(F.regexp_replace("text", r"[\r\x0b\x0c\x1c-\x1e\x85  ]", " "), F.lit("\n")).alias("a"))
    done = docs.select("doc_id", C.try_patch("a", F.concat(F.lit("first line\n"), "a")).alias("t"))
    return done.select("doc_id", "t.ok", "t.same", "t.changed", F.array_join("t.lines", ",").alias("lines"), F.size(X.patch_changes(F.col("t.patch"))).cast("long").alias("patch_lines"))


def patch_edits(spark, sf_dir):
    """Documents as a word a line, with lines taken out, replaced and put in all along: many hunks, and last lines without an end."""
    clean = F.regexp_replace("text", r"[\x1c-\x1e\x85\u2028\u2029]", " ")
    docs = _spread(spark, sf_dir).select("doc_id", F.filter(F.split(clean, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w")).where("size(w) > 0")
    numbered = F.transform("w", lambda w, i: F.concat(w, F.lit(":"), i.cast("string")))

    def edited(line, i):
        mark = lambda name: F.concat(F.lit(name), i.cast("string"))
        none = F.array().cast("array<string>")
        return F.when(i % 100 == 3, none).when(i % 100 == 7, F.array(mark("edit:"))).when(i % 250 == 0, F.array(mark("new:"), line)).otherwise(F.array(line))

    end = F.when((F.col("doc_id") % 2 == 0) | (F.size("w") % 100 == 4), "\n").otherwise("")  # a last line that is taken out leaves no line without an end
    text = lambda lines: F.concat(F.array_join(lines, "\n"), end)
    docs = docs.withColumn("lines", numbered).select("doc_id", text(F.col("lines")).alias("a"), text(F.flatten(F.transform("lines", edited))).alias("b"))
    done = docs.select("doc_id", C.try_patch("a", "b").alias("t"))
    return done.select("doc_id", "t.ok", "t.same", "t.changed", F.md5(F.array_join("t.lines", ",")).alias("lines_md5"), F.size(X.patch_changes(F.col("t.patch"))).cast("long").alias("patch_lines"))


def queries() -> dict:
    names = (
        conversation_roles, conversation_violations, chat_render, strict_json, license_detect, license_status, slugs, cwe_ids, fence_extract,
        pattern_scan, context_lines, finding_rank, suffix_join, predict_map, stream_resume, scan_findings, scan_findings_sql, structural_code, patch_round_trip, patch_edits,
    )
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    roles = "r AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1), b AS (SELECT conv_id, r, list_filter(r, lambda x: x <> 'system') AS b FROM r)"
    lic = r"""SELECT doc_id, CASE WHEN contains(low, 'apache license') AND contains(low, 'version 2.0') THEN 'Apache-2.0'
  WHEN contains(low, 'mit license') OR (contains(low, 'permission is hereby granted') AND contains(low, 'without restriction')) THEN 'MIT' ELSE 'unknown' END AS license,
  regexp_matches(t, '(?i)apache(?: license)?[- ]?2(?:\.0)?') AS apache_like,
  coalesce(array_to_string(list_sort(list_filter(['license', 'copyright', 'all rights reserved', 'non-commercial', 'research only'], lambda x: contains(low, x))), ','), '') AS terms
  FROM (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents)"""
    banned = "|".join(BANNED_ADDITIONS)
    found = """k AS (SELECT p_partkey, p_partkey % 10 AS k FROM part), f AS (SELECT * FROM (VALUES (0, 'os-system', 'HIGH', 3), (1, 'subprocess-shell-true', 'HIGH', 2), (2, 'unsafe-pickle-load', 'HIGH', 2),
  (4, 'unsafe-yaml-load', 'HIGH', 2), (5, 'hardcoded-secret', 'HIGH', 1), (6, 'sql-string-format', 'HIGH', 3), (9, 'path-traversal-open', 'MEDIUM', 1), (9, 'dynamic-execution', 'HIGH', 2)) t(k, "check", severity, line))
  SELECT p_partkey, "check", severity, line FROM k JOIN f USING (k)"""
    return {
        "conversation_roles": "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1",
        "conversation_violations": f"""WITH {roles} SELECT conv_id, 'start' AS rule FROM b WHERE r[1] NOT IN ('user', 'system') UNION ALL SELECT conv_id, 'end' FROM b WHERE r[-1] <> 'assistant'
  UNION ALL SELECT conv_id, 'turns' FROM b WHERE len(list_filter(range(1, len(b)), lambda i: b[i] = b[i + 1])) > 0""",
        "chat_render": "SELECT conv_id, sha256(string_agg('<' || role || '>' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS rendered_sha256 FROM conversations GROUP BY 1",
        "strict_json": """SELECT event_id, json_valid(props) AND json_type(props) = 'OBJECT' AS is_object, json_valid(props) AND json_keys(props) = ['k'] AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS has_schema,
  CAST(props->>'$.k' AS BIGINT) AS k FROM events""",
        "license_detect": lic,
        "license_status": f"""WITH l AS ({lic}), s AS (SELECT CASE WHEN n_chars = 0 THEN 'skipped' WHEN terms = '' THEN 'unknown' WHEN license = 'Apache-2.0' THEN 'train_allowed' ELSE 'baseline_only' END AS status FROM l JOIN documents USING (doc_id))
SELECT ord, v.status, count(s.status) AS n FROM (VALUES (0, 'train_allowed'), (1, 'baseline_only'), (2, 'skipped'), (3, 'unknown')) v(ord, status) LEFT JOIN s USING (status) GROUP BY 1, 2""",
        "slugs": r"""SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
  regexp_replace(regexp_replace(lower(url), '[^a-z0-9_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS safe, ltrim(replace(url_decode(replace(url, '+', '%2B')), '\', '/'), './') AS path,
  CASE WHEN regexp_extract(url, '(\d+)', 1) <> '' THEN 'CWE-' || CAST(regexp_extract(url, '(\d+)', 1) AS BIGINT) END AS cwe,
  regexp_matches(url, '^https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:\.git)?/?$') AS is_repository FROM pages""",
        "cwe_ids": r"""SELECT p_partkey, 'CWE-' || lpad(p_size::VARCHAR, 3, '0') AS cwe, nullif(regexp_extract(id, '^[^_]*_[^_]*_(.+\.py)$', 1), '') AS file, regexp_replace(id, '\s+', '', 'g') AS bare
  FROM (SELECT *, 'x_' || replace(p_name, ' ', '_') || '_cwe' || p_size || '.py' AS id FROM part)""",
        "fence_extract": "SELECT doc_id, sha256(trim(replace(coalesce(text, ''), '`', ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS code_sha256 FROM documents",
        "pattern_scan": f"""SELECT 'document' AS kind, doc_id AS id, coalesce(regexp_matches(text, '{SECRET_ASSIGNED}'), false) AS secret, coalesce(regexp_matches(text, '{banned}'), false) AS banned FROM documents
  UNION ALL SELECT 'page', page_id, coalesce(regexp_matches(html, '{SECRET_ASSIGNED}'), false), coalesce(regexp_matches(html, '{banned}'), false) FROM pages""",
        "context_lines": r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), a AS (SELECT *, doc_id % len(l) + 1 AS n FROM l)
SELECT doc_id, md5(array_to_string(list_transform(range(greatest(1, n - 2), least(len(l), n + 2) + 1), lambda i: lpad(i::VARCHAR, 5, ' ') || ': ' || l[i]), chr(10))) AS context_md5, right(text, 40) AS tail FROM a""",
        "finding_rank": r"""WITH f AS (SELECT lpad(doc_id::VARCHAR, 10, '0') AS file, regexp_extract_all(text, '[0-9]+') AS n FROM documents WHERE text IS NOT NULL),
  u AS (SELECT file, unnest(range(len(n))) AS place, unnest(n) AS number FROM f)
SELECT file, place, number, 'AST-' || CASE WHEN row_number() OVER (ORDER BY file, place) < 10000 THEN lpad((row_number() OVER (ORDER BY file, place))::VARCHAR, 4, '0') ELSE (row_number() OVER (ORDER BY file, place))::VARCHAR END AS id FROM u""",
        "suffix_join": r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS uri FROM pages), m AS (SELECT page_id, p_partkey::VARCHAR AS path, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) AS r
  FROM p JOIN part ON uri = p_partkey::VARCHAR OR ends_with(uri, '/' || p_partkey))
SELECT p.page_id, m.path FROM p LEFT JOIN m ON m.page_id = p.page_id AND r = 1""",
        "predict_map": "SELECT doc_id AS id, length(trim(coalesce(text, ''))) = 0 AS invalid_json, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN NULL WHEN length(coalesce(text, '')) < 40 THEN 'short' ELSE 'long' END AS label FROM documents",
        "stream_resume": "SELECT user_id, count(*) AS n, round(sum(value), 6) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1",
        "scan_findings": f"WITH {found}",
        "scan_findings_sql": f"WITH {found}",
        "structural_code": "SELECT p_partkey % 10 AS k, count(*) AS n, p_partkey % 10 <> 8 AS parses, CASE WHEN p_partkey % 10 = 8 THEN 0 ELSE 1 END AS token_forms, CASE WHEN p_partkey % 10 = 8 THEN 0 ELSE 1 END AS structures FROM part GROUP BY p_partkey % 10",
        "patch_edits": r"""WITH d AS (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[\x1c-\x1e\x{85}\x{2028}\x{2029}]', ' ', 'g'), '[^\x20\x09-\x0D]+')) AS n FROM documents WHERE text IS NOT NULL),
  e AS (SELECT doc_id, list_filter(range(n), lambda i: i % 100 IN (3, 7) OR i % 250 = 0) AS e FROM d WHERE n > 0)
SELECT doc_id, true AS ok, true AS same, len(e) AS changed, md5(array_to_string(list_transform(e, lambda i: i + 1), ',')) AS lines_md5,
  len(e) + len(list_filter(e, lambda i: i % 100 = 7)) AS patch_lines FROM e""",
        "patch_round_trip": "SELECT doc_id, true AS ok, true AS same, 1 AS changed, '1' AS lines, 1 AS patch_lines FROM documents WHERE text IS NOT NULL",
    }
