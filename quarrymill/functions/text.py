"""String, digest and JSON column functions; everything here stays within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# License terms and patterns that verdicts are defined by.
APACHE = r"(?i)apache(?: license)?[- ]?2(?:\.0)?"
REPOSITORY_URL = r"^https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:\.git)?/?$"


def tag_slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9_.-]+", "-"), r"^-+|-+$", ""))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_.-]+", "-"), r"^[-.]+|[-.]+$", "")


def cwe_from_id(text: Column) -> Column:
    """CWE-089 of ...cwe89...; null where there is no number."""
    digits = F.regexp_extract(text, r"(?i)cwe(\d+)", 1)
    return F.when(digits != "", F.format_string("CWE-%03d", digits.cast("int")))


def cwe_normalised(text: Column) -> Column:
    """CWE-89 of the first number anywhere, with or without a CWE prefix; null where there is none."""
    digits = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits.cast("decimal(38,0)").cast("string")))


def file_of_id(text: Column) -> Column:
    """What follows the second underscore, if it is a Python file's name."""
    found = F.regexp_extract(text, r"^[^_]*_[^_]*_(.+\.py)$", 1)
    return F.when(found != "", found)


def tag_cwes(tags: Column) -> Column:
    """Numbers in rule tags like external/cwe/cwe-79, padded to three digits."""
    ids = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)cwe[-/](\d+)", 1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(ids, lambda x: x != ""), lambda x: F.format_string("CWE-%03d", x.cast("int")))))


def uri_path(uri: Column, decode: bool = True) -> Column:
    """A uri as a path: decoded (a plus stays a plus), with forward slashes, without leading dots and slashes."""
    text = F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))) if decode else uri
    return F.ltrim(F.replace(F.coalesce(text, uri), F.lit("\\"), F.lit("/")), F.lit("./"))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def license_id(text: Column) -> Column:
    low = F.lower(text)
    apache = low.contains("apache license") & low.contains("version 2.0")
    mit = low.contains("mit license") | (low.contains("permission is hereby granted") & low.contains("without restriction"))
    return F.when(apache, "Apache-2.0").when(mit, "MIT").otherwise("unknown")


def terms_found(text: Column, terms: list[str]) -> Column:
    return F.array_sort(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)))


def fenced_code(text: Column) -> Column:
    """The first fenced block, else the text without a leading label."""
    block = F.regexp_extract(text, r"(?is)```(?:python)?\s*(.*?)```", 1)
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = F.when(text.rlike(r"(?is)```(?:python)?\s*.*?```"), bare(block)).otherwise(bare(text))
    return F.regexp_replace(body, r"(?i)^\s*(?:python\s+code|code)\s*:\s*", "")


def patch_paths(patch: Column) -> Column:
    """Target paths of a diff's +++ lines."""
    heads = F.filter(F.split(patch, r"\r?\n"), lambda x: x.startswith("+++ "))
    return F.transform(heads, lambda x: F.regexp_replace(F.trim(F.substring_index(F.substr(x, F.lit(5)), "\t", 1)), "^b/", ""))


def patch_changes(patch: Column) -> Column:
    """Added and removed lines of a diff, with their signs."""
    return F.filter(F.split(patch, r"\r?\n"), lambda x: (x.startswith("+") & ~x.startswith("+++")) | (x.startswith("-") & ~x.startswith("---")))


def preflight(patch: Column, path: Column, exists: Column, banned: tuple[str, ...], most: int = 40) -> Column:
    """Why a patch is not tried, or null: the first rule that it breaks."""
    paths, lines = patch_paths(patch), patch_changes(patch)
    added = F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("+")), lambda x: F.substr(x, F.lit(2))), "\n")
    unsafe = path.startswith("/") | F.array_contains(F.split(path, "/"), "..") | ~path.endswith(".py")
    rules = [
        ((F.size(paths) != 1) | (F.get(paths, F.lit(0)) != path), "must change the finding's file and no other"),
        (unsafe, "path is unsafe or not a Python file"),
        (~F.coalesce(exists, F.lit(False)), "no such file"),
        (F.size(lines) == 0, "no change"),
        (F.size(lines) > most, f"more than {most} lines change"),
        (added.rlike("|".join(banned)), "adds a banned pattern"),
    ]
    return F.coalesce(*[F.when(broken, F.lit(why)) for broken, why in rules])


def chat_text(messages: Column) -> Column:
    """Messages (role, content) as <role> and text, a blank line between."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">\n"), m["content"])), "\n\n")


def markdown_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def indent(text: Column, width: int) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x != "", F.concat(F.lit(" " * width), x)).otherwise(x)), "\n")


def record_id(cwe: Column, seed: Column, family: Column, occurrence: Column, attempt: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", *[c.cast("string") for c in (seed, family, occurrence, attempt)]), 256)
    return F.concat(F.lit("psp-"), F.substr(cwe, F.lit(5)), F.lit("-"), F.substring(digest, 1, 16))


def line_f1(expected: Column, predicted: Column) -> Column:
    """F1 of two arrays of lines as sets; both empty 1, one empty or null 0."""
    a, b = F.array_distinct(expected), F.array_distinct(predicted)
    both = F.size(F.array_intersect(a, b))
    score = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
    return F.coalesce(score.otherwise(2.0 * both / (F.size(a) + F.size(b))), F.lit(0.0))


def json_kind(text: Column) -> Column:
    """The shape of a JSON text, types told apart strictly; null if it is no JSON."""
    return F.schema_of_variant(F.try_parse_json(text))


def strict_object(text: Column) -> Column:
    return F.coalesce(json_kind(text).startswith("OBJECT"), F.lit(False))


def has_schema(text: Column, fields: dict[str, str]) -> Column:
    """Whether a JSON object has exactly these fields with these types (STRING, BOOLEAN, BIGINT, ARRAY<BIGINT>)."""
    value = F.try_parse_json(text)
    keys = F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(fields)])

    def typed(key: str, kind: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
        return found.isin(kind, "ARRAY<VOID>") if kind.startswith("ARRAY") else found == kind
    checks = strict_object(text) & keys
    for key, kind in fields.items():
        checks = checks & typed(key, kind)
    return F.coalesce(checks, F.lit(False))


def utc_now() -> Column:
    """The query's start in UTC, as ISO 8601 text to the second."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
