"""quarrymill.functions.code as Arrow-batched column functions, table functions and SQL names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions import code
from quarrymill.scratch import materialize

FINDING = "struct<check:string,severity:string,line:int,column:int,message:string>"
# types as objects: text types need a session, and this module may be imported before there is one
_ROW = T.StructType([T.StructField(n, t) for n, t in (("check", T.StringType()), ("severity", T.StringType()), ("line", T.IntegerType()), ("column", T.IntegerType()), ("message", T.StringType()))])
_PATCH = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
_FINDINGS = pa.list_(pa.struct([("check", pa.string()), ("severity", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("message", pa.string())]))
_PATCHED = pa.struct([("ok", pa.bool_()), ("text", pa.string()), ("error", pa.string())])


_TRIAL = T.StructType([T.StructField(n, t) for n, t in (("patch", T.StringType()), ("ok", T.BooleanType()), ("same", T.BooleanType()), ("changed", T.LongType()), ("lines", T.ArrayType(T.LongType())))])
_TRIED = pa.struct([("patch", pa.string()), ("ok", pa.bool_()), ("same", pa.bool_()), ("changed", pa.int64()), ("lines", pa.list_(pa.int64()))])
#: Rows of a batch that are Python objects at a time.
SLICE = 64


def slices(batch: pa.Array | pa.RecordBatch) -> Iterator[pa.Array | pa.RecordBatch]:
    """A batch in pieces of SLICE rows; an empty one is one piece."""
    for k in range(0, max(1, len(batch)), SLICE):
        yield batch.slice(k, SLICE)


def _each(function, kind: pa.DataType):
    """A function of one row over batches. However many rows a batch has, a few of them are Python objects at a time."""

    def run(*columns: pa.Array) -> pa.Array:
        pieces = zip(*map(slices, columns), strict=True)
        return pa.concat_arrays([pa.array([function(*row) for row in zip(*(c.to_pylist() for c in piece), strict=True)], kind) for piece in pieces])

    return run


@F.arrow_udf(T.BooleanType())
def py_parses(source: pa.Array) -> pa.Array:
    return _each(code.parses, pa.bool_())(source)


@F.arrow_udf(T.StringType())
def norm_code(source: pa.Array) -> pa.Array:
    return _each(code.token_form, pa.string())(source)


@F.arrow_udf(T.StringType())
def struct_code(source: pa.Array) -> pa.Array:
    return _each(code.structure_form, pa.string())(source)


@F.arrow_udf(T.LongType())
def changed_lines(before: pa.Array, after: pa.Array) -> pa.Array:
    return _each(lambda a, b: None if a is None or b is None else code.changed_lines(a, b), pa.int64())(before, after)


@F.arrow_udf(T.ArrayType(T.LongType()))
def vulnerable_lines(before: pa.Array, after: pa.Array) -> pa.Array:
    return _each(lambda a, b: None if a is None or b is None else code.edited_lines(a, b), pa.list_(pa.int64()))(before, after)


@F.arrow_udf(T.StringType())
def make_patch(before: pa.Array, after: pa.Array) -> pa.Array:
    return _each(lambda a, b: None if a is None or b is None else code.make_patch(a, b), pa.string())(before, after)


@F.arrow_udf(_PATCH)
def apply_patch(before: pa.Array, patch: pa.Array) -> pa.Array:
    return _each(lambda a, b: vars(code.apply_patch(a, b)), _PATCHED)(before, patch)


@F.arrow_udf(_TRIAL)
def try_patch(before: pa.Array, after: pa.Array) -> pa.Array:
    """The patch of a pair of texts with what trying it gives: one pass over a row, where separate columns would send its texts to several workers."""

    def tried(a: str | None, b: str | None) -> dict | None:
        found = code.try_patch(a, b)
        return None if found is None else vars(found)

    return _each(tried, _TRIED)(before, after)


@F.arrow_udf(_PATCH)
def extract_code(raw: pa.Array, prompt: pa.Array) -> pa.Array:
    return _each(lambda a, b: vars(code.extract_code(a, b)), _PATCHED)(raw, prompt)


@F.arrow_udf(T.StringType())
def canonical_json(source: pa.Array) -> pa.Array:
    """JSON with keys in order at all levels, no blanks, ASCII only; null for what is no JSON."""
    return _each(code.canonical_json, pa.string())(source)


@F.arrow_udf(T.ArrayType(_ROW))
def code_findings(source: pa.Array) -> pa.Array:
    """Null where the source does not parse."""
    return _each(code.findings, _FINDINGS)(source)


FUNCTIONS = {
    "py_parses": py_parses, "norm_code": norm_code, "struct_code": struct_code, "changed_lines": changed_lines,
    "vulnerable_lines": vulnerable_lines, "make_patch": make_patch, "apply_patch": apply_patch, "try_patch": try_patch,
    "extract_code": extract_code, "code_findings": code_findings, "canonical_json": canonical_json,
}


@F.udtf(returnType=_ROW)
class ScanFindings:
    """Table function: a row for each finding of a source text."""

    def eval(self, source: str):
        for f in code.findings(source) or []:
            yield f["check"], f["severity"], f["line"], f["column"], f["message"]


def register_udfs(spark: SparkSession) -> None:
    """SQL names for all of these."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("scan_findings", ScanFindings)


@F.arrow_udf(T.MapType(T.StringType(), T.LongType()))
def finding_counts(source: pa.Array) -> pa.Array:
    """Findings by check; an empty map for code that does not parse."""
    return _each(lambda x: list(code.finding_counts(x).items()), pa.map_(pa.string(), pa.int64()))(source)


_FACTS = T.StructType([T.StructField(n, t) for n, t in (("parses", T.BooleanType()), ("tokens", T.StringType()), ("tree", T.StringType()), ("found", T.MapType(T.StringType(), T.LongType())))])
_TOLD = pa.struct([("parses", pa.bool_()), ("tokens", pa.string()), ("tree", pa.string()), ("found", pa.map_(pa.string(), pa.int64()))])


@F.arrow_udf(_FACTS)
def code_facts(source: pa.Array) -> pa.Array:
    """py_parses(), digests of norm_code() and struct_code(), and finding_counts(), of one text in one pass."""
    return _each(code.facts, _TOLD)(source)


#: Bytes of a file that are one row while its tree is hashed.
PIECE = 1 << 16


def _digest_in_order(by: str):
    """Rows in order of their tree to the tree's digest; the state goes on from batch to batch."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, digest, kind = None, None, None
        line = lambda: pa.RecordBatch.from_arrays([pa.array([tree], kind), pa.array([digest.hexdigest()])], [by, "tree_sha256"])
        for batch in batches:
            kind = batch.column(by).type
            for name, piece in zip(batch.column(by).to_pylist(), batch.column("piece"), strict=True):
                if digest is None or name != tree:
                    if digest is not None:
                        yield line()
                    tree, digest = name, hashlib.sha256()
                digest.update(piece.as_buffer() if piece.is_valid else b"")
        if digest is not None:
            yield line()

    return run


def tree_digest_streamed(rows: DataFrame, by: str, order: list[str], piece: Column) -> DataFrame:
    """by and tree_sha256: of the pieces (binary) of a tree's rows, one after another in a total order.

    A tree's rows meet sorted in one partition and are hashed as they pass: a task holds a batch, however large the tree.
    """
    kind = rows.schema[by].dataType.simpleString()
    sorted_ = rows.select(by, *order, piece.alias("piece")).repartition(by).sortWithinPartitions(by, *order)
    return sorted_.select(by, "piece").mapInArrow(_digest_in_order(by), f"{by} {kind}, tree_sha256 string")


def tree_digest_hashes(files: DataFrame, by: str) -> DataFrame:
    """by and tree_sha256: of a tree's files (path, sha256 as hex) in order of path: path, digest."""
    return tree_digest_streamed(files, by, ["path"], F.concat("path", "sha256").cast("binary"))


def tree_digest_raw(files: DataFrame, by: str, size: int = PIECE) -> DataFrame:
    """by and tree_sha256: of a tree's files (path, content) in order of path: path, a zero byte, content.

    Files are cut into pieces of `size` bytes; a null content is empty.
    """
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("content") / size).cast("int") - 1)), lambda i: F.substring(F.col("content"), i * size + 1, F.lit(size)))
    pieces = files.select(by, "path", content.alias("content")).select(by, "path", F.posexplode(cut).alias("n", "part"))
    head = F.when(F.col("n") == 0, F.concat(F.col("path").cast("binary"), F.lit(b"\0"))).otherwise(F.lit(b""))
    return tree_digest_streamed(pieces, by, ["path", "n"], F.concat(head, "part"))


def tree_digest_json(files: DataFrame, by: str) -> DataFrame:
    """by and tree_sha256: of a tree's JSON files (path, content) in order of path: path, content in canonical form."""
    shaped = files.withColumn("_c", canonical_json("content"))
    return tree_digest_streamed(shaped, by, ["path"], F.concat("path", F.coalesce("_c", F.lit(""))).cast("binary"))


def no_more_findings(before: Column, after: Column) -> Column:
    """No check has more findings after than before; true if there is none after."""
    more = F.map_zip_with(before, after, lambda _, b, a: F.coalesce(a, F.lit(0)) > F.coalesce(b, F.lit(0)))
    return F.size(F.map_filter(more, lambda _, x: x)) == 0


def scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, content) to findings and to files that do not parse.

    Findings have ids in order of (file, line, check). Sorting by range spreads them over tasks; a running count
    needs only the number of findings of each earlier range. Files are scanned once: what is found is written before it
    is sorted, as sorting reads its input twice.
    """
    scanned = materialize(files.select("path", code_findings("content").alias("found"), F.col("content").isNull().alias("unreadable")), "scanned")
    errors = scanned.where("found IS NULL").select(F.col("path").alias("file"), F.when(F.col("unreadable"), "not decodable").otherwise("syntax error").alias("error"))
    rows = scanned.select(F.col("path").alias("file"), F.posexplode("found").alias("ord", "f")).select("file", "ord", "f.*")
    return number_rows(rows, ["file", "line", "check", "ord"], "AST-%04d").drop("ord"), errors


def number_rows(rows: DataFrame, order: list[str], pattern: str, into: str = "id") -> DataFrame:
    """Rows with ids 1, 2, ... in a total order, without one task seeing all rows."""
    sorted_ = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = materialize(sorted_, "numbered")  # sizes and numbers must be of one run
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sorted_.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))  # a row for each partition
    at = F.col("_at").bitwiseAND((1 << 33) - 1)
    return sorted_.join(F.broadcast(starts), "_part").withColumn(into, F.format_string(pattern, F.col("_start") + at + 1)).drop("_part", "_at", "_start")
