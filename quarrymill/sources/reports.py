"""Markdown reports: layouts are tables of labels and columns, rendered by column functions over small frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import markdown_cell


@dataclass(frozen=True)
class Table:
    """A heading, labels with the columns under them (and how numbers are shown), the order of rows, and what stands for none."""

    heading: str
    columns: tuple[tuple[str, str, str | None], ...]
    order: tuple[str, ...]
    empty: str = "None."


@dataclass(frozen=True)
class Layout:
    """A title with {columns} in it, a list of facts, tables, and a last remark."""

    title: str
    facts: tuple[tuple[str, str, str | None], ...]
    tables: tuple[Table, ...] = ()
    remark: str = ""


RATE = "%.4f"

EVALUATION = Layout(
    "Evaluation of {tag} on {split}",
    (("Model", "model_id", None), ("Records", "rows", None), ("Batch size", "batch_size", None), ("Strict JSON", "json_valid_rate", RATE), ("Schema valid", "schema_valid_rate", RATE),
     ("Accuracy", "accuracy", RATE), ("F1", "f1", RATE), ("Matthews correlation", "mcc", RATE), ("CWE exact", "cwe_correct_rate", RATE), ("Fixed code parses", "fixed_code_parseable_rate", RATE),
     ("Security control", "security_control_pass_rate", RATE), ("No regression", "no_dangerous_regression_rate", RATE), ("Overpatched", "overpatch_rate", RATE),
     ("Clean code preserved", "negative_preserved_rate", RATE), ("Median latency (s)", "median_latency", RATE)),
    (Table("By weakness", (("CWE", "cwe", None), ("Records", "rows", None), ("Classification", "classification_rate", RATE), ("Control", "control_rate", RATE)), ("cwe",)),),
    "Code was parsed and inspected, not run.",
)
PATCHES = Layout(
    "Patches of {tag} on {split}",
    (("Records", "rows", None), ("Strict schema", "schema_valid_rate", RATE), ("Patch applies", "patch_applies_rate", RATE), ("Security control", "security_control_pass_rate", RATE),
     ("Exact code", "patched_code_exact_rate", RATE), ("Relevant file only", "relevant_file_only_rate", RATE)),
)
SAMPLES = Layout(
    "Samples of {tag}",
    (("Scored prompts", "scored_prompts", None), ("Prompts", "prompts", None), ("Scored samples", "scored", None), ("Samples", "samples", None), ("Functional pass rate", "functional_pass_rate", RATE),
     ("Security-test pass rate", "security_test_pass_rate", RATE), ("Secure functional pass rate", "secure_functional_pass_rate", RATE), ("Secure pass@1", "secure_pass_at_1", RATE),
     ("Secure pass@3", "secure_pass_at_3", RATE), ("Secure pass@5", "secure_pass_at_5", RATE)),
)
SUITE = Layout(
    "Repository repair of {tag}",
    (("Records", "records", None), ("Vulnerable", "vulnerable", None), ("Clean", "clean", None), ("Detection recall", "detection_recall", RATE), ("Detection precision", "detection_precision", RATE),
     ("Strict JSON", "strict_json_rate", RATE), ("Patches accepted", "patch_acceptance_rate", RATE), ("Repaired end to end", "repair_rate", RATE), ("Clean code preserved", "preservation_rate", RATE),
     ("Unrelated rewrites", "unrelated_rewrites", None), ("Regressions", "regressions", None)),
    remark="A controlled suite of pairs, the same for all models.",
)
COMPARISON = Layout(
    "Paired comparison {tag}",
    (("Paired cases", "cases", None), ("Base repair rate", "base_rate", RATE), ("Other repair rate", "other_rate", RATE), ("Effect", "effect", "%+.4f"), ("From", "lower_95", "%+.4f"), ("To", "upper_95", "%+.4f"), ("Exact p", "p", "%.6f")),
    remark="No significance is claimed where the interval holds zero.",
)
SUMMARY = Layout(
    "Benchmark summary",
    (("Reports", "reports", None), ("Comparisons", "comparisons", None)),
    (Table("Reports", (("Tag", "tag", None), ("Split", "split", None), ("Records", "rows", None), ("Accuracy", "accuracy", RATE)), ("split", "tag")),
     Table("Paired comparisons", (("Left", "left", None), ("Right", "right", None), ("Split", "split", None), ("Shared", "shared", None), ("Difference", "difference", RATE), ("p", "p", "%.6g"), ("Holm p", "p_holm", "%.6g")), ("split", "left", "right"))),
)
AGENT = Layout(
    "Scan of {target}",
    (("Python files", "python_files", None), ("Findings", "findings", None), ("Accepted patches", "accepted", None), ("Rejected patches", "rejected", None)),
    (Table("Findings", (("Id", "id", None), ("Check", "check", None), ("Severity", "severity", None), ("File", "file", None), ("Line", "line", None), ("Message", "message", None)), ("id",), "No findings."),
     Table("Attempts", (("Finding", "finding_id", None), ("JSON valid", "json_valid", None), ("Accepted", "accepted", None), ("Reason", "reason", None)), ("finding_id",), "No attempts.")),
)


def _shown(column: str, form: str | None, null: str) -> Column:
    value = F.col(column)
    return F.when(value.isNull(), F.lit(null)).otherwise(F.format_string(form, value.cast("double")) if form else value.cast("string"))


def render_table(rows: DataFrame, table: Table) -> DataFrame:
    """One row, `markdown`: the table under its heading. Reports are small: their rows stand in one value."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(_shown(c, form, "")) for _, c, form in table.columns]), F.lit(" |"))
    labels = [label for label, _, _ in table.columns]
    head = f"| {' | '.join(labels)} |\n|{'|'.join(['---'] * len(labels))}|\n"
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*table.order).alias("o"), cells.alias("line")))), lambda x: x["line"])
    made = rows.agg(lines.alias("lines"))
    body = F.when(F.size("lines") == 0, F.lit(table.empty)).otherwise(F.concat(F.lit(head), F.array_join("lines", "\n")))
    return made.select(F.concat(F.lit(f"## {table.heading}\n\n"), body).alias("markdown"))


def render(layout: Layout, facts: DataFrame, *tables: DataFrame) -> DataFrame:
    """facts (one row) and the layout's tables, in its order, as one text."""
    pieces = [F.lit(f"# {layout.title}")]
    for c in facts.columns:
        if f"{{{c}}}" in layout.title:
            pieces[0] = F.replace(pieces[0], F.lit(f"{{{c}}}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    listed = F.array(*[F.concat(F.lit(f"- {label}: "), _shown(c, form, "n/a")) for label, c, form in layout.facts])
    out = facts.select(F.concat(pieces[0], F.lit("\n\n"), F.array_join(listed, "\n")).alias("markdown"))
    for table, rows in zip(layout.tables, tables, strict=True):
        part = render_table(rows, table).withColumnRenamed("markdown", "_more")
        out = out.join(F.broadcast(part)).select(F.concat_ws("\n\n", "markdown", "_more").alias("markdown"))  # one row each
    return out.select(F.concat("markdown", F.lit(f"\n\n{layout.remark}\n" if layout.remark else "\n")).alias("markdown"))
