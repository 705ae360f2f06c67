"""Scans with explicit schemas. What does not fit is an error or a row of violations, never a guess."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions.code import SKIP_DIRS
from quarrymill.functions.text import license_id
from quarrymill.scratch import materialize

RECORD_DDL = (
    "id STRING, family STRING, split STRING, language STRING, cwe STRING, vuln_type STRING, is_vulnerable BOOLEAN, vulnerable_code STRING, "
    "fixed_code STRING, vulnerable_lines ARRAY<BIGINT>, explanation STRING, patch_summary STRING, safe_test STRING, task STRING, "
    "ecosystem STRING, prompt STRING, target STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>, patch STRING, "
    "verification STRUCT<vulnerable_ast_parse: BOOLEAN, fixed_ast_parse: BOOLEAN, safe_test_ast_parse: BOOLEAN, "
    "security_oracle_pass: BOOLEAN, patch_round_trip: BOOLEAN, target_schema: STRING>, source STRING, source_license STRING"
)
CASE_DDL = (
    "id STRING, pair_id STRING, family STRING, framework STRING, language STRING, cwe STRING, expected_check STRING, is_vulnerable BOOLEAN, "
    "target_file STRING, protected_files ARRAY<STRING>, files MAP<STRING, STRING>, source STRING, source_license STRING"
)
SARIF_DDL = (
    "runs ARRAY<STRUCT<tool: STRUCT<driver: STRUCT<rules: ARRAY<STRUCT<id: STRING, properties: STRUCT<tags: ARRAY<STRING>>>>>, "
    "extensions: ARRAY<STRUCT<rules: ARRAY<STRUCT<id: STRING, properties: STRUCT<tags: ARRAY<STRING>>>>>>>, "
    "results: ARRAY<STRUCT<ruleId: STRING, locations: ARRAY<STRUCT<physicalLocation: STRUCT<artifactLocation: STRUCT<uri: STRING>>>>>>>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path is; patterns count if anything matches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line must parse; blank lines are passed over by Spark's reader."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def strict_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line must parse, blank ones too, which none can."""
    lines = spark.read.text(path)
    text = F.when(F.trim("value") == "", F.raise_error(F.lit("a blank line is no JSON")).cast("string")).otherwise(F.col("value"))
    return lines.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of each line of text files, blank ones included.

    A file is read in splits; a line's number is its place in its split after the numbers of lines of earlier ones.
    """
    meta = F.col("_metadata")
    read = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_at"))
    read = materialize(read, "lines")  # places and counts must be of one run
    sizes = read.groupBy("file", "_start").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each split
    place = F.row_number().over(Window.partitionBy("file", "_start").orderBy("_at"))
    return read.withColumn("_place", place).join(F.broadcast(starts), ["file", "_start"]).select("file", (F.col("_before") + F.col("_place")).alias("line"), "value")


def read_split(spark: SparkSession, path: str, split: str, tasks: tuple[str, ...] = ("detect", "repair", "repo_patch")) -> DataFrame:
    """A split's records of the given tasks. Any record that breaks a rule, of whatever task, is an error with its line; so is an empty split."""
    lines = numbered_lines(spark, path).withColumn("r", F.from_json("value", RECORD_DDL))
    whole = F.try_parse_json("value").isNotNull()
    rows = lines.where(whole).select("line", "r.*")
    broken = lines.where(~whole).select("line", F.lit("json").alias("rule")).unionByName(split_violations(rows, split, "line"))
    first = broken.orderBy("line", "rule").limit(1).collect()
    if first:
        raise ValueError(f"{path}:{first[0].line}: {first[0].rule}")
    kept = rows.drop("line")
    if not kept.limit(1).count():
        raise ValueError(f"{path}: no records")
    return kept.where(F.col("task").isin(*tasks))


def patch_split(spark: SparkSession, path: str, split: str, most: int = 0, seed: int = 42) -> DataFrame:
    """A split's repository patches; at most so many if a number is given, one of each weakness in turn."""
    from quarrymill.operators.relational import stratified_round_robin

    rows = read_split(spark, path, split, ("repo_patch",))
    return stratified_round_robin(rows, ["cwe"], F.col("id"), most, seed).select(*rows.columns)


def json_lines_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As json_lines, and no rows where there is no file."""
    return json_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def json_objects(spark: SparkSession, path: str, schema: str, skip_unreadable: bool = False) -> DataFrame:
    """Files that hold one object each; unreadable ones fail, or are left out."""
    reader = spark.read.schema(schema).option("multiLine", True)
    if skip_unreadable:
        return reader.option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(path)
    return reader.option("mode", "FAILFAST").json(path)


def shards(spark: SparkSession, root: str, schema: str, pattern: str = "shard-*.jsonl") -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mode", "FAILFAST").json(root)


def sarif(spark: SparkSession, root: str) -> DataFrame:
    """Findings of SARIF files: file, rule, uri and the numbers that the rule's tags name; a finding without location has no uri."""
    from quarrymill.functions.text import tag_cwes

    files = spark.read.schema(SARIF_DDL).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sarif").json(root)
    run = files.select(F.input_file_name().alias("file"), F.posexplode("runs").alias("run", "r"))
    rules = F.concat(F.coalesce("r.tool.driver.rules", F.array()), F.flatten(F.coalesce(F.transform("r.tool.extensions", lambda e: F.coalesce(e["rules"], F.array())), F.array())))
    tags = run.select("file", "run", F.explode(rules).alias("rule")).select("file", "run", F.col("rule.id").alias("rule"), tag_cwes(F.coalesce("rule.properties.tags", F.array())).alias("cwes"))
    tags = tags.groupBy("file", "run", "rule").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cwes")))).alias("cwes"))
    found = run.select("file", "run", F.explode("r.results").alias("x")).select("file", "run", F.col("x.ruleId").alias("rule"), F.get("x.locations", F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].alias("uri"))
    return found.join(tags, ["file", "run", "rule"], "left").select("file", "rule", "uri", F.coalesce("cwes", F.array().cast("array<string>")).alias("cwes"))


def python_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), content (null if it is no UTF-8) and digest of Python files; skipped folders left out, and so are links, to files
    or folders, where the file system is one that tells of them (file:)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    base = root.rstrip("/").split(":", 1)[-1].replace("//", "/")
    path = F.regexp_replace(F.regexp_extract("path", f"{base}/(.*)$", 1), "%20", " ")
    kept = files.where(~F.arrays_overlap(F.split(F.col("path"), "/"), F.array(*map(F.lit, SKIP_DIRS))))
    kept = kept.where(~_is_link(base)("path"))
    return kept.select(path.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("sha256"))


def _is_link(base: str):
    """Whether a file below base, or a folder between them, is a symbolic link."""

    @F.arrow_udf("boolean")
    def found(path: pa.Array) -> pa.Array:
        import os
        from urllib.parse import unquote, urlsplit

        def linked(uri: str) -> bool:
            if not uri.startswith("file:"):
                return False
            name = unquote(urlsplit(uri).path)
            while len(name) > len(base):
                if os.path.islink(name):
                    return True
                name = os.path.dirname(name)
            return False

        return pa.array([linked(x) for x in path.to_pylist()], pa.bool_())

    return found


def test_results(spark: SparkSession, path: str) -> DataFrame:
    """One row: the last result of a test whose name holds 'correctness', and of one that holds 'vulnerability' and not that."""
    rows = spark.read.option("header", True).csv(path).withColumn("_n", F.monotonically_increasing_id())
    name = F.lower("TestName")
    right, weak = name.contains("correctness"), name.contains("vulnerability")
    return rows.agg(
        F.max_by(F.when(right, F.col("Result")), F.when(right, F.col("_n"))).alias("test_correctness"),
        F.max_by(F.when(~right & weak, F.col("Result")), F.when(~right & weak, F.col("_n"))).alias("test_vulnerability"),
    )


def files_of(cases: DataFrame) -> DataFrame:
    """A row for each file of a case."""
    return cases.select("id", F.explode("files").alias("path", "content"))


def licenses(roots: DataFrame, texts: DataFrame) -> DataFrame:
    """roots (path) with the license that their text (path, text) shows; 'missing' without a text."""
    met = roots.join(texts, "path", "left")
    return met.select("path", F.when(F.col("text").isNull(), "missing").otherwise(license_id(F.col("text"))).alias("license"))


# Violations -----------------------------------------------------------------------------------------------------------------


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule for each rule (true where it is broken) that a row breaks; an unknown verdict counts as broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


#: The target's keys by kind of task.
TARGET_KEYS = {
    "agent": ("finding_id", "patch", "summary"),
    "analysis": ("cwe", "explanation", "fixed_code", "is_vulnerable", "patch_summary", "safe_test", "vuln_type", "vulnerable_lines"),
}


def split_violations(records: DataFrame, split: str, key: str = "id") -> DataFrame:
    """key and rule of each rule of a training split that a record breaks."""
    roles = F.transform("messages", lambda m: m["role"]) == F.array(*map(F.lit, ("system", "user", "assistant")))
    answer = F.try_parse_json(F.get("messages", F.lit(2))["content"]).cast("string") == F.try_parse_json("target").cast("string")
    keys = lambda kind: F.array(*map(F.lit, TARGET_KEYS[kind]))
    wanted = F.when(F.col("task") == "repo_patch", keys("agent")).otherwise(keys("analysis"))
    return violations(
        records, key,
        {"split": F.col("split") != split, "language": F.col("language") != "python", "provenance": F.col("source") != "generated", "license": F.col("source_license") != "Apache-2.0",
         "task": ~F.col("task").isin("detect", "repair", "repo_patch"), "roles": ~roles, "target": F.array_sort(F.json_object_keys("target")) != wanted, "answer": ~answer},
    )


def suite_violations(cases: DataFrame, languages: tuple[str, ...], licenses: tuple[str, ...]) -> DataFrame:
    """Broken rules of cases: keys that are not there, repeated ids, languages and licenses that are not allowed, pairs that are not one of each kind.

    A key that the whole suite lacks is a rule that every case breaks.
    """
    needed = ("pair_id", "family", "framework", "cwe", "expected_check", "is_vulnerable", "target_file", "files")
    kinds = {"is_vulnerable": "boolean", "files": "map<string,string>"}
    for c in ("language", "source_license", *needed):
        if c not in cases.columns:
            cases = cases.withColumn(c, F.lit(None).cast(kinds.get(c, "string")))
    whole = {f"no {c}": F.col(c).isNull() for c in needed}
    rows = violations(cases, "id", whole | {"language": ~F.col("language").isin(*languages), "license": ~F.col("source_license").isin(*licenses)})
    repeated = cases.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("rule"))
    pairs = cases.groupBy("pair_id").agg(F.sort_array(F.collect_list("is_vulnerable")).alias("kinds"))
    uneven = pairs.where(~F.col("kinds").eqNullSafe(F.array(F.lit(False), F.lit(True)))).select(F.col("pair_id").alias("id"), F.lit("pair").alias("rule"))
    return rows.unionByName(repeated).unionByName(uneven)


def config(path: str, required: tuple[str, ...] = ()) -> dict:
    """Settings of a YAML (or JSON, which is YAML) file as a mapping."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:  # without a YAML library, JSON only
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("settings must be a mapping")
    if missing := [k for k in required if k not in found]:
        raise ValueError(f"settings lack {missing}")
    return found
