"""Sinks. Spark's commit protocol publishes a folder's files together, which takes the place of rename tricks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import markdown_cell
from quarrymill.operators.relational import shuffled


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; null fields are written, so that keys are fixed."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON object with keys in order."""
    report.select(*sorted(report.columns)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_splits(records: DataFrame, path: str, seed: int) -> None:
    """A folder per split, rows in a seeded order."""
    shuffled(records, F.col("id"), seed).write.mode("overwrite").partitionBy("split").parquet(path)


def manifest(files: DataFrame) -> DataFrame:
    """files (path, content) as lines of digest, two blanks, path."""
    return files.orderBy("path").select(F.concat(F.sha2("content", 256), F.lit("  "), "path").alias("value"))


def write_manifest(files: DataFrame, path: str) -> None:
    manifest(files).write.mode("overwrite").text(path)


def failure_log(sections: list[tuple[str, str]], most: int = 50_000):
    """Column: sections (title, column) one after another, the last characters of each."""
    parts = [F.concat(F.lit(f"== {title} ==\n"), F.right(F.coalesce(c, F.lit("")), F.lit(most))) for title, c in sections]
    return F.array_join(F.array(*parts), "\n")


def sample_files(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source files of all samples (path, content) and the map from paths to samples."""
    each = prompts.withColumn("prompt_index", F.col("prompt_index").cast("int")).select("id", "cwe", "prompt_index", F.posexplode("output").alias("sample_index", "s"))
    path = F.format_string("p%03d/s%02d_code.py", "prompt_index", "sample_index")
    each = each.select(path.alias("path"), "id", "prompt_index", "sample_index", "cwe", F.col("s.compilable").alias("compilable"), F.col("s.cleared_code").alias("content"))
    return each.select("path", "content"), each.drop("content")


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Lines of a table, in order: head, rule, a line for each row. Reports are small: the text is one value."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |"))
    body = rows.select(F.struct(*order).alias("o"), cells.alias("line"))
    head = f"| {' | '.join(columns)} |\n|{'|'.join(['---'] * len(columns))}|"
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    return body.agg(F.concat(F.lit(head), F.lit("\n"), joined).alias("markdown"))


def markdown_report(title: str, facts: DataFrame, labels: dict[str, str]) -> DataFrame:
    """A title and a list of one row's values under their labels; numbers with four digits."""
    kinds = dict(facts.dtypes)
    shown = [F.concat(F.lit(f"- {label}: "), F.coalesce(F.format_string("%.4f", c) if kinds[c] == "double" else F.col(c).cast("string"), F.lit("n/a"))) for c, label in labels.items()]
    return facts.select(F.array_join(F.array(F.lit(f"# {title}"), F.lit(""), *shown), "\n").alias("markdown"))
