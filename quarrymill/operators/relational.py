"""Joins, set operations, sampling and ordering that the pipelines are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Resuming and integrity ---------------------------------------------------------------------------------------------------


def pending(records: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose key is not in the log."""
    return records.join(done.select(*keys), keys, "left_anti")


def completed(log: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    return log.join(records.select(*keys), keys, "left_semi")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_and_extra(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with side 'missing' or 'extra'. One shuffle of keys, counted on both sides."""
    sides = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(found.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("f")))
    seen = sides.groupBy(*keys).agg(F.max("e").alias("e"), F.max("f").alias("f")).where("e <> f")
    return seen.select(*keys, F.when(F.col("e") == 1, "missing").otherwise("extra").alias("side"))


def require_none(violations: DataFrame, message: str) -> None:
    """Fail if there is any row."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs, absent counting as null."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def suffix_match(findings: DataFrame, uri: str, paths: DataFrame, path: str, order: str) -> DataFrame:
    """findings with the first path (by order) that equals their uri or that it ends with after a '/'; null if none.

    A uri is exploded into its own suffixes, so that paths are met by an equi-join and not by a nested loop; findings of one
    uri are asked about once, and met by it.
    """
    parts = F.split(F.col("_u"), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    asked = findings.select(F.col(uri).alias("_u")).distinct()
    met = asked.select("_u", F.explode(tails).alias(path)).join(paths.select(path, order), path)
    first = met.groupBy("_u").agg(F.min_by(path, order).alias(path))
    return findings.join(first, findings[uri] == first["_u"], "left").drop("_u")


def group_overlaps(values: DataFrame, group: str, value: str, groups: list[str]) -> DataFrame:
    """All pairs of groups, in their order, with how many values they share; pairs without any have 0.

    A value's groups are collected (as many as there are groups at most) and paired there: the values are shuffled
    once, and not joined with themselves.
    """
    rank = {g: i for i, g in enumerate(groups)}
    order = F.create_map(*[x for g, i in rank.items() for x in (F.lit(g), F.lit(i))])
    sets = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.array_sort(F.collect_set(order[F.col(group)])).alias("g")).where(F.size("g") > 1)
    pairs = F.flatten(F.transform("g", lambda a: F.transform(F.filter("g", lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r")))))
    counts = sets.select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n")).select("p.l", "p.r", "n")
    every = [(i, j, groups[i], groups[j]) for i in range(len(groups)) for j in range(i + 1, len(groups))]
    frame = values.sparkSession.createDataFrame(every, "l int, r int, left_group string, right_group string")
    return frame.join(counts, ["l", "r"], "left").select("left_group", "right_group", F.coalesce("n", F.lit(0)).alias("shared"))


# Ordering and sampling ------------------------------------------------------------------------------------------------------


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order, by an aggregation with partial results rather than a window."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def keep_last(rows: DataFrame, keys: list[str], order: str, into: str = "first_at") -> DataFrame:
    """The last row per key, with where the key was first seen."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    grouped = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return grouped.agg(F.max_by(row, order).alias("_r"), F.min(order).alias(into)).select("_r.*", into)


def stratified_round_robin(rows: DataFrame, strata: list[str], key: Column, limit: int | None, seed: int) -> DataFrame:
    """Up to limit rows: one of each stratum in turn, strata in order, rows of a stratum by seeded digest.

    Only the first `limit` of a stratum can be taken, so a window keeps no more of each.
    """
    if limit is None or limit <= 0:
        return rows
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(digest, key))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", *strata).limit(limit)


def shuffled(rows: DataFrame, key: Column, seed: int) -> DataFrame:
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), key)


def context_lines(text: Column, line: Column, radius: int = 12) -> Column:
    """Numbered lines around a line, clamped to the text."""
    lines = F.split(text, "\n")
    first = F.greatest(F.lit(1), line - radius)
    last = F.least(F.size(lines), line + radius)
    shown = F.transform(F.sequence(first, last), lambda i: F.format_string("%5d: %s", i, F.element_at(lines, i)))
    return F.when(last >= first, F.array_join(shown, "\n")).otherwise(F.lit(""))


def dense_counts(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts of the given values in their order, 0 for absent ones."""
    frame = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord int, {key} string")
    return frame.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select("ord", key, F.coalesce("n", F.lit(0)).alias("n"))


def unpack_samples(rows: DataFrame, array: str, position: str = "sample_index") -> DataFrame:
    return rows.select("*", F.posexplode(array).alias(position, "sample")).drop(array)


def in_order(rows: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each record that has one, in the records' order."""
    return records.select(key, F.col(order).alias("_order")).join(rows, key).orderBy("_order").drop("_order")


def shard(records: DataFrame, index: str, count: int, k: int) -> DataFrame:
    """The records of shard k of `count`: those whose index leaves the rest k."""
    if not 0 <= k < count:
        raise ValueError("a shard's number lies below the number of shards")
    return records.where(F.pmod(F.col(index), F.lit(count)) == k)


def shard_progress(records: DataFrame, done: DataFrame, key: str, index: str, count: int) -> DataFrame:
    """shard, expected and done rows of all shards, empty ones included."""
    number = F.pmod(F.col(index), F.lit(count)).cast("int").alias("shard")
    marked = records.select(key, number).join(done.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
    sums = marked.groupBy("shard").agg(F.count("*").alias("expected"), F.count("_done").alias("done"))
    every = records.sparkSession.range(count).select(F.col("id").cast("int").alias("shard"))
    return every.join(sums, "shard", "left").select("shard", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("done", F.lit(0)).alias("done"))


def inventory(files: DataFrame, by: list[str]) -> DataFrame:
    """Files, Python files and lines of each group of files (path, content); unreadable content has no lines."""
    lines = F.regexp_count(F.col("content"), F.lit("\n")) + F.when(F.col("content").rlike(r"[^\n]\z"), 1).otherwise(0)
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(F.col("path").endswith(".py")).alias("python_files"), F.coalesce(F.sum(lines), F.lit(0)).alias("lines"))


def first_allowed(audited: DataFrame, wanted: list[str]) -> str:
    """The first of the wanted models that an audit (model_id, train_allowed) allows; an error if it allows none."""
    order = audited.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wanted)], "_order int, model_id string")
    found = order.join(audited.where("train_allowed"), "model_id").orderBy("_order").limit(1).collect()
    if not found:
        raise ValueError(f"none of {wanted} is allowed for training")
    return found[0].model_id


def pack_samples(rows: DataFrame, keys: list[str], order: str, columns: list[str], into: str = "output") -> DataFrame:
    entry = F.struct(order, *columns)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(into))


def conjunction(*flags: Column) -> Column:
    """All true; null counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(f, F.lit(False)) for f in flags])
