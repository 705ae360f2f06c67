"""Corpus queries: normalisation, dedup, splits, contamination, sampling, integrity, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import code_columns as C
from quarrymill.functions import grams
from quarrymill.functions import text as X
from quarrymill.operators import relational as R
from quarrymill.scratch import materialize

SPLITS = ["train", "val", "test", "holdout"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_form(text: Column) -> Column:
    """Words in lower case, one blank between."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), " ")


def shape_form(text: Column) -> Column:
    """Words as W, numbers as 0."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[A-Za-z]+", "W"), "[0-9]+", "0")


def split_of(family: Column) -> Column:
    """A family's split by its digest: 8 parts of 10 train, then one each; null families train."""
    draw = F.conv(F.substring(F.md5(F.coalesce(family, F.lit(""))), 1, 15), 16, 10).cast("long") % 10
    return F.when(draw < 5, "train").when(draw < 7, "val").when(draw < 9, "test").otherwise("holdout")


_SPLIT = """CASE WHEN CAST(('0x' || substr(md5(coalesce(source, '')), 1, 15)) AS BIGINT) % 10 < 5 THEN 'train'
  WHEN CAST(('0x' || substr(md5(coalesce(source, '')), 1, 15)) AS BIGINT) % 10 < 7 THEN 'val'
  WHEN CAST(('0x' || substr(md5(coalesce(source, '')), 1, 15)) AS BIGINT) % 10 < 9 THEN 'test' ELSE 'holdout' END"""
_NORMAL = "array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ')"


def dedup_normalised(spark, sf_dir):
    """The first document of each normal form."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(normal_form(F.col("text")), 256).alias("norm_sha256"))
    return R.keep_first(docs, ["norm_sha256"], ["doc_id"])


def duplicate_groups(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.sha2(normal_form(F.col("text")), 256).alias("norm_sha256"))
    return R.duplicates(docs, ["norm_sha256"])


def structure_digests(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(shape_form(F.col("text")), 256).alias("shape_sha256"))


def split_assign(spark, sf_dir):
    """Families, their split, and a task and label by occurrence within the family."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", split_of(F.col("source")).alias("split"))
    turn = F.pmod("doc_id", F.lit(10))
    task = F.when(turn < 4, "repair").when(turn < 8, "detect").otherwise("repo_patch")
    return docs.withColumn("task", task).withColumn("positive", ~turn.isin(6, 7))


def split_overlap(spark, sf_dir):
    """Normal forms that pairs of splits share."""
    docs = _table(spark, sf_dir, "documents").select(F.md5(normal_form(F.col("text"))).alias("form"), split_of(F.col("source")).alias("split"))
    return R.group_overlaps(docs, "split", "form", SPLITS)


def split_statistics(spark, sf_dir):
    """Counts by language, by source, by both, and in all, in one pass."""
    docs = _table(spark, sf_dir, "documents")
    return docs.groupingSets([["lang", "source"], ["lang"], ["source"], []], "lang", "source").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 500).alias("n_long"), F.sum("n_chars").alias("chars")
    )


def language_counts(spark, sf_dir):
    """Counts of five languages in their order, 0 for absent ones."""
    return R.dense_counts(_table(spark, sf_dir, "documents"), "lang", ["de", "en", "es", "fr", "it"])


def contains_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (text, ...) x items (item, ...) where the text holds the item, inside words too; columns of both.

    An item has keys that every text which holds it must have as well: what its windows of bytes pick (grams.py). Texts
    that have a key are counted first, and each item takes the rarest of its keys; an item with a key that no text has is
    done with. Texts and items then meet by that key in an equi-join and are compared after it, so an item meets few
    texts that do not hold it, whatever common words it has. A text makes keys of those widths only that items have. Null
    and empty items are held by nothing.
    """
    asked = grams.keys(items.where("length(item) > 0").select(F.xxhash64("item").alias("_item"), "item"), "_item", "item", own=True).distinct()
    asked = materialize(asked.select("_item", F.col("width").alias("_width"), F.col("key").alias("_key")), "asked")
    widths = sorted(r[0] for r in asked.select("_width").distinct().collect())  # at most as many as there are
    if not widths:
        return docs.crossJoin(items.limit(0))
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("_text"), "text")
    made = lambda some: grams.keys(texts, "_text", "text", some).select("_text", F.col("key").alias("_key"))
    counts = made(widths).join(asked.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"))
    best = asked.join(counts, "_key", "left").groupBy("_item").agg(F.min(F.coalesce("_n", F.lit(0))).alias("_least"), F.min_by(F.struct("_key", "_width"), F.struct(F.coalesce("_n", F.lit(0)), "_key")).alias("_b"))
    best = materialize(best.where("_least > 0").select("_item", "_b.*"), "keys")
    chosen = sorted(r[0] for r in best.select("_width").distinct().collect())
    if not chosen:
        return docs.crossJoin(items.limit(0))
    # keys travel with their text's hash alone; texts and items follow for pairs that met, and are compared
    met = made(chosen).join(best.drop("_width"), "_key").select("_text", "_item").distinct()
    held = docs.where("text IS NOT NULL").withColumn("_text", F.xxhash64("text"))
    named = items.where("length(item) > 0").withColumn("_item", F.xxhash64("item"))
    return held.join(met.join(named, "_item"), "_text").where(F.contains("text", "item")).drop("_text", "_item")


def contamination_contains(spark, sf_dir):
    """Documents that hold a benchmark item's text."""
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return contains_pairs(docs, items).select("doc_id", "item_id")


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def contamination_exact(spark, sf_dir):
    """Items of the benchmark, turns of conversations and planted copies whose normal form is a document's, by semi-join on digests.

    Planted copies are of documents with labels: in capitals, with marks between the words, and where the label says
    toxic with one word more, which no document has. An empty form is no match.
    """
    held = _table(spark, sf_dir, "documents").select(normal_form(F.col("text")).alias("form")).where("form <> ''").select(F.sha2("form", 256).alias("h"))
    asked = _table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("id"), "text")
    turns = _table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    copies = _table(spark, sf_dir, "labels").select("doc_id", "toxic").join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    more = F.when(F.col("toxic") == 1, " zzplanted").otherwise("")
    planted = copies.select(F.lit("planted").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("<< "), F.replace(F.translate("text", _SMALL, _SMALL.upper()), F.lit(" "), F.lit(" - ")), more, F.lit(" >>")).alias("text"))
    every = asked.unionByName(turns).unionByName(planted).select("kind", "id", F.sha2(normal_form(F.col("text")), 256).alias("h"))
    return every.join(held, "h", "left_semi").select("kind", "id")


def contamination_gate(spark, sf_dir):
    """One row: whether no pair of splits shares a form and no form repeats."""
    overlap = split_overlap(spark, sf_dir).agg(F.sum("shared").alias("shared"))
    repeats = duplicate_groups(spark, sf_dir).agg(F.count("*").alias("repeated"))
    return overlap.join(F.broadcast(repeats)).select("shared", "repeated", ((F.col("shared") == 0) & (F.col("repeated") == 0)).alias("passed"))


def stratified_round_robin(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return R.stratified_round_robin(rows, ["lang", "quality"], F.col("doc_id"), 60, 42).select("doc_id", "lang", "quality", F.col("turn").cast("long").alias("turn"))


def seeded_order(spark, sf_dir):
    """The first 100 documents of a seeded order."""
    return R.shuffled(_table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 7).limit(100)


def resume_pending(spark, sf_dir):
    return R.pending(_table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels"), ["doc_id"])


def completed_semi(spark, sf_dir):
    return R.completed(_table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels"), ["doc_id"])


def snapshot_diff(spark, sf_dir):
    """Users whose number of events differs between even and odd event ids (two snapshots), absent ones included."""
    events = _table(spark, sf_dir, "events")
    day = lambda k: events.where(f"event_id % 2 = {k}").groupBy("user_id").agg(F.count("*").alias("n"))
    return R.changed(day(0), day(1), "user_id", "n")


def completeness_gate(spark, sf_dir):
    """Expected: all documents; found: labels, and one that no document has."""
    found = _table(spark, sf_dir, "labels").select((F.when(F.col("doc_id") % 50 == 1, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id"))).alias("doc_id"))
    return R.missing_and_extra(_table(spark, sf_dir, "documents"), found, ["doc_id"])


def positional_compare(spark, sf_dir):
    """Turns of conversations by place, against the next conversation's: where role or length differ, nulls alike."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    other = turns.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("role2"), F.col("n").alias("n2"))
    met = turns.join(other, ["conv_id", "turn"], "full_outer")
    return met.where(~(F.col("role").eqNullSafe(F.col("role2")) & F.col("n").eqNullSafe(F.col("n2")))).select("conv_id", "turn", "role", "role2")


def family_plan(spark, sf_dir):
    """Every part's row of a plan: specs x shapes, numbered, met by index modulo the plan's length."""
    part, nation, region = (_table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    plan = nation.select("n_nationkey", "n_name").crossJoin(F.broadcast(region.select("r_regionkey", "r_name")))  # 25 x 5 rows, fixed
    plan = plan.withColumn("ord", F.col("n_nationkey") * 5 + F.col("r_regionkey")).withColumn("family", F.lower(F.concat_ws("-", F.translate("n_name", " ", "_"), "r_name")))
    at = F.pmod("p_partkey", F.lit(125)).cast("int")
    return part.withColumn("ord", at).join(F.broadcast(plan.select("ord", "family")), "ord").select("p_partkey", "family", F.expr("p_partkey div 125").alias("occurrence"))


def record_ids(spark, sf_dir):
    """Reproducible ids: the first 16 digits of the digest of seed, family, occurrence and attempt."""
    made = family_plan(spark, sf_dir)
    rid = X.record_id(F.lit("CWE-089"), F.lit(42), F.col("family"), F.col("occurrence"), F.lit(0))
    return made.select("p_partkey", rid.alias("id"))


def sha_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.concat(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit("  "), path).alias("line"))


def tree_digest(spark, sf_dir):
    """Trees of a thousand files each, by their source."""
    path = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    docs = _table(spark, sf_dir, "documents").select("source", F.expr("doc_id div 1000").alias("tree"), path.alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    trees = C.tree_digest_hashes(docs.withColumn("_t", F.struct("source", "tree")).drop("source", "tree"), "_t")
    return trees.select("_t.source", "_t.tree", "tree_sha256")


def star_join(spark, sf_dir):
    """Revenue and late share by region and priority. Lines are summed per order before they are joined, small dimensions met last."""
    line = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("lines"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    by_customer = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    met = by_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return met.groupBy("r_name", "o_orderpriority").agg(F.sum("cents").alias("cents"), F.sum("lines").alias("lines"), F.round(F.sum("returned") / F.sum("lines"), 9).alias("returned_rate"))


def latency_summary(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 9).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 9).alias("p95"))


def token_lengths(spark, sf_dir):
    """Length audit of rendered conversations: how many, longest, mean, over the limit."""
    n = F.sum(F.length("text") + F.length("role") + 3)
    chats = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n.alias("n"))
    return chats.agg(F.count("*").alias("records"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") > 1500).alias("over"))


def queries() -> dict:
    names = (
        dedup_normalised, duplicate_groups, structure_digests, split_assign, split_overlap, split_statistics, language_counts,
        contamination_contains, contamination_exact, contamination_gate, stratified_round_robin, seeded_order, resume_pending,
        completed_semi, snapshot_diff, completeness_gate, positional_compare, family_plan, record_ids, sha_manifest, tree_digest,
        star_join, latency_summary, token_lengths,
    )
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    overlap = f"""f AS (SELECT DISTINCT md5({_NORMAL}) AS form, {_SPLIT} AS split FROM documents),
  s AS (SELECT * FROM (VALUES (0, 'train'), (1, 'val'), (2, 'test'), (3, 'holdout')) t(i, name)),
  overlap AS (SELECT a.name AS left_group, b.name AS right_group, (SELECT count(*) FROM f x JOIN f y ON x.form = y.form WHERE x.split = a.name AND y.split = b.name) AS shared
  FROM s a JOIN s b ON a.i < b.i)"""
    groups = f"SELECT sha256({_NORMAL}) AS norm_sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"
    plan = """p AS (SELECT n_nationkey * 5 + r_regionkey AS ord, lower(translate(n_name, ' ', '_') || '-' || r_name) AS family FROM nation, region),
  plan AS (SELECT p_partkey, family, p_partkey // 125 AS occurrence FROM part JOIN p ON p_partkey % 125 = ord)"""
    return {
        "dedup_normalised": f"SELECT sha256({_NORMAL}) AS norm_sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1",
        "duplicate_groups": groups,
        "structure_digests": "SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z]+', 'W', 'g'), '[0-9]+', '0', 'g')) AS shape_sha256 FROM documents",
        "split_assign": f"""SELECT doc_id, source, {_SPLIT} AS split, CASE WHEN doc_id % 10 < 4 THEN 'repair' WHEN doc_id % 10 < 8 THEN 'detect' ELSE 'repo_patch' END AS task,
  doc_id % 10 NOT IN (6, 7) AS positive FROM documents""",
        "split_overlap": f"WITH {overlap} SELECT * FROM overlap",
        "split_statistics": """SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, count(*) FILTER (n_chars >= 500) AS n_long, CAST(sum(n_chars) AS BIGINT) AS chars
  FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""",
        "language_counts": "SELECT ord, v.lang, count(d.doc_id) AS n FROM (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr'), (4, 'it')) v(ord, lang) LEFT JOIN documents d ON d.lang = v.lang GROUP BY 1, 2",
        "contamination_contains": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0",
        "contamination_exact": f"""WITH h AS (SELECT DISTINCT {_NORMAL} AS form FROM documents),
  p AS (SELECT doc_id::VARCHAR AS id, '<< ' || replace(translate(text, '{_SMALL}', '{_SMALL.upper()}'), ' ', ' - ') || CASE WHEN toxic = 1 THEN ' zzplanted' ELSE '' END || ' >>' AS text FROM labels JOIN documents USING (doc_id)),
  a AS (SELECT 'item' AS kind, item_id::VARCHAR AS id, {_NORMAL} AS form FROM benchmark UNION ALL SELECT 'turn', conv_id || '/' || turn, {_NORMAL} FROM conversations
  UNION ALL SELECT 'planted', id, {_NORMAL} FROM p) SELECT kind, id FROM a WHERE form <> '' AND form IN (SELECT form FROM h)""",
        "contamination_gate": f"WITH {overlap}, g AS ({groups}), r AS (SELECT (SELECT CAST(sum(shared) AS BIGINT) FROM overlap) AS shared, (SELECT count(*) FROM g) AS repeated) SELECT *, shared = 0 AND repeated = 0 AS passed FROM r",
        "stratified_round_robin": """SELECT doc_id, lang, quality, turn FROM (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY md5('42:' || doc_id), doc_id) AS turn
  FROM labels JOIN documents USING (doc_id)) ORDER BY turn, lang, quality LIMIT 60""",
        "seeded_order": "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100",
        "resume_pending": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "completed_semi": "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "snapshot_diff": """SELECT user_id, b.n AS before, a.n AS after FROM (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1) b
  FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1) a USING (user_id) WHERE b.n IS DISTINCT FROM a.n""",
        "completeness_gate": """WITH f AS (SELECT CASE WHEN doc_id % 50 = 1 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id FROM labels)
SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION SELECT doc_id, 'extra' FROM f WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
        "positional_compare": """WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT coalesce(a.conv_id, b.conv_id - 1) AS conv_id, coalesce(a.turn, b.turn) AS turn, a.role, b.role AS role2 FROM t a FULL JOIN t b ON a.conv_id = b.conv_id - 1 AND a.turn = b.turn
WHERE a.role IS DISTINCT FROM b.role OR a.n IS DISTINCT FROM b.n""",
        "family_plan": f"WITH {plan} SELECT * FROM plan",
        "record_ids": f"WITH {plan} SELECT p_partkey, 'psp-089-' || substr(sha256('42:' || family || ':' || occurrence || ':0'), 1, 16) AS id FROM plan",
        "sha_manifest": "SELECT sha256(coalesce(text, '')) || '  ' || source || '/' || doc_id || '.txt' AS line FROM documents",
        "tree_digest": """SELECT source, doc_id // 1000 AS tree, sha256(string_agg(lpad(doc_id::VARCHAR, 12, '0') || sha256(coalesce(text, '')), '' ORDER BY lpad(doc_id::VARCHAR, 12, '0'))) AS tree_sha256
  FROM documents GROUP BY 1, 2""",
        "star_join": """SELECT r_name, o_orderpriority, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS lines,
  round(count(*) FILTER (l_returnflag = 'R') / count(*), 9) AS returned_rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
        "latency_summary": "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 9) AS median, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY 1",
        "token_lengths": """SELECT count(*) AS records, CAST(max(n) AS BIGINT) AS longest, round(avg(n), 6) AS mean, count(*) FILTER (n > 1500) AS over
  FROM (SELECT conv_id, sum(length(text) + length(role) + 3) AS n FROM conversations GROUP BY 1)""",
    }
