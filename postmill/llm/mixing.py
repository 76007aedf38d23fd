"""Mixing sources to target weights.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share SHARE times all words; a target stops at MOST
times its source's words and the excess is shared again by weight (a water level, found in one pass over the sources).

Draws: a source is taken whole floor(target / words) times, and once more in part. The partial pass follows the permutation of documents by
the MD5 of their id: first documents of over 2 % of their source (50 at most), up to their share, then the others. Those lie in BLOCKS blocks, the key's
first digits; whole blocks are taken until the quota ends within one, and only that block's documents are ranked. So a hot source is never
ordered in one task.

Output shards: a source's block draws are divided among SHARDS shards by a splitting tree: each node halves its capacity and draws how many
of each source's blocks go left from the multivariate hypergeometric law (source by source, inverse transform). Each shard then takes its number of
consecutive block draws in a permuted order, so that shards are disjoint, and orders its rows by a hash. What a row is taken for is the count of its draws; as quotas are
exact, the tree decides where a block is drawn, and the quota how many are.

One row of the tree holds the quotas of all sources, so sources are meant to be thousands, not billions. Every step is a function of
ids and sizes: reruns agree. Nulls: a null text has no words; null ids share one key; repeated rows count each; a null source
is a source; empty tables give no rows. Extra columns are ignored by `mix`; `mixed_rows` keeps the columns of docs.
Very long texts are counted whole by a built-in expression; one of over 2 % of its source is weighed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table

WEIGHTS, SHARE, MOST, SHARDS, SEED = (5, 2, 1), 1.5, 2.0, 16, "mix"
#: Words that one task of a shard orders at most, on average: some 60 MB.
SLOT_WORDS = 10_000_000
BLOCKS = 16**3


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) of sources (source, source_size)."""
    every = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("at") % len(WEIGHTS) + 1)
    capped = ranked.withColumn("w", weight).withColumn("cap", MOST * F.col("source_size")).withColumn("total", SHARE * F.sum("source_size").over(every))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "at")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levelled = capped.withColumn("level", (F.col("total") - before) / rest)
    # once a source stays under its cap the level only falls, so the highest level of such a source is the water level
    level = F.max(F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level"))).over(every)
    return levelled.withColumn("target", F.least("cap", F.coalesce(F.col("w") * level, "cap"))).select("source", "source_size", "target")


def _hypergeometric(total: Column, hits: Column, draws: Column, u: Column) -> Column:
    """Of `draws` units drawn from `total` of which `hits` are marked, the number marked, at quantile u: three passes over the support."""
    lo, hi = F.greatest(F.lit(0), draws - total + hits), F.least(draws, hits)
    ks = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda k: F.log(((hits - k) * (draws - k)).cast("double") / ((k + 1) * (total - hits - draws + k + 1)).cast("double"))
    top = F.aggregate(ks, F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("m")), lambda a, k: F.struct((a["l"] + step(k)).alias("l"), F.greatest(a["m"], a["l"] + step(k)).alias("m")), lambda a: a["m"])

    def draw(most: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("l"), F.exp(-most).alias("s"))
        mass = F.aggregate(ks, start, lambda a, k: F.struct((a["l"] + step(k)).alias("l"), (a["s"] + F.exp(a["l"] + step(k) - most)).alias("s")), lambda a: a["s"])
        below = F.struct(F.lit(0.0).alias("l"), F.exp(-most).alias("s"), lo.alias("x"))
        find = lambda goal: F.aggregate(ks, below, lambda a, k: F.struct((a["l"] + step(k)).alias("l"), (a["s"] + F.exp(a["l"] + step(k) - most)).alias("s"), F.when(a["s"] < goal, k + 1).otherwise(a["x"]).alias("x")), lambda a: a["x"])
        return let(mass * u, find)

    return let(top, draw)


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(source, shard, n) from quotas (source, n int): how many block draws of each source each shard takes. shards: a power of two."""
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("order"), "source", "n"))).alias("q")).select(F.lit(0).alias("node"), "q")
    for level in range(shards.bit_length() - 1):
        total = F.aggregate("q", F.lit(0), lambda a, x: a + x["n"])

        def part(a, x):  # used at once, so the loop variable is safe
            u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node", x["order"], x["source"].isNull()), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            return let(_hypergeometric(a["total"], x["n"], a["left"], u), lambda k: F.struct((a["total"] - x["n"]).alias("total"), (a["left"] - k).alias("left"), F.concat(a["out"], F.array(k)).alias("out")))

        start = F.struct(total.alias("total"), F.floor(total / 2).cast("int").alias("left"), F.array().cast("array<int>").alias("out"))
        left = F.aggregate("q", start, part, lambda a: a["out"])

        def halves(ks):
            side = lambda number, n: F.struct((F.col("node") * 2 + number).alias("node"), F.transform("q", n).alias("q"))
            own = lambda x, n: F.struct(x["order"].alias("order"), x["source"].alias("source"), n.alias("n"))
            return F.array(side(0, lambda x, i: own(x, F.get(ks, i))), side(1, lambda x, i: own(x, x["n"] - F.get(ks, i))))

        node = node.select(F.explode(let(left, halves)).alias("x")).select("x.node", "x.q")
    return node.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("x.source", "shard", "x.n")


def mix(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, row: Column | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, draws) per row of docs; draws: array of (shard, place), one for each time it is taken.

    row: a value that tells apart rows of one id, which it orders; it comes first among the columns then, as `row`."""
    own = [] if row is None else ["row"]
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = table(docs.select(*([] if row is None else [row.alias("row")]), F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key")), "sizes")
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("whole", F.least(F.lit(2), ratio).cast("int"))
    goals = table(goals.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "goals")
    same = F.col("source").eqNullSafe(F.col("s"))
    sized = rows.join(goals.withColumnRenamed("source", "s"), same, "left").drop("s").withColumn("block", F.substring("key", 1, 3)).withColumn("large", 50 * F.col("size") > F.col("source_size"))
    # large documents first, each weighed by itself
    of = Window.partitionBy("source").orderBy("key", "size", *own)
    upto = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = sized.where("large").withColumn("before", upto(of)).withColumn("all", F.sum("size").over(Window.partitionBy("source")))
    large = large.withColumn("extra", F.col("before") + F.col("size") / 2 <= F.col("rest") * F.col("all") / F.col("source_size"))
    used = large.where("extra").groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("used"))
    blocks = sized.where("not large").groupBy("source", "block").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("whole").alias("whole"))
    blocks = blocks.join(used, same, "left").withColumn("quota", F.col("rest") - F.coalesce("used", F.lit(0))).drop("s")
    blocks = blocks.withColumn("before", upto(Window.partitionBy("source").orderBy("block")))
    blocks = blocks.withColumn("fill", F.when(F.col("before") + F.col("size") <= F.col("quota"), "all").when(F.col("before") > F.col("quota"), "none").otherwise("some"))
    fills = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "quota", "before", "fill")
    small = sized.where("not large").join(fills, same & (F.col("block") == F.col("b"))).drop("s", "b")
    inner = upto(Window.partitionBy("source", "block").orderBy("key", "size", *own))
    some = small.where("fill = 'some'").withColumn("extra", F.col("before") + inner + F.col("size") / 2 <= F.col("quota"))
    decided = small.where("fill <> 'some'").withColumn("extra", F.col("fill") == "all")
    keep = [*own, "doc_id", "source", "size", "source_size", "target", "key", "whole", "extra"]
    taken = table(large.select(keep).unionByName(decided.select(keep)).unionByName(some.select(keep)).withColumn("copies", F.least(F.lit(2), F.col("whole") + F.col("extra").cast("int"))), "taken")  # a row without words costs nothing, but is taken twice at most
    # block draws of 256 blocks a source: each whole pass draws all of its blocks, the partial pass those it reaches
    passes = taken.withColumn("block", F.substring("key", 1, 2)).groupBy("source", "block").agg(F.max("copies").alias("n"))
    draws = passes.where("n > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pass"))
    draws = table(draws.withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy("pass", F.xxhash64(F.lit(seed), "pass", "block"), "block")) - 1), "draws")
    split = splitting_tree(draws.groupBy("source").agg(F.count("*").cast("int").alias("n")), shards, seed)
    # tables between the steps keep each plan, and the driver's memory, small
    ends = table(split.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("shard"))).groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list("end")).alias("ends")), "ends")
    placed = draws.join(ends, same).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    shard_of = placed.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    found = taken.join(shard_of, same & (F.substring("key", 1, 2) == F.col("b")), "left")
    place = lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.lit(seed), s, i, "key").alias("place"))
    # a row is taken as often as shards have drawn its block in a pass that it is part of
    drawn = F.when(F.col("copies") > 0, F.transform(F.slice("shards", 1, F.col("copies")), place)).otherwise(F.array().cast("array<struct<shard:int,place:bigint>>"))
    return found.select(*own, "doc_id", "size", "source", "source_size", "target", drawn.alias("draws")).select(*own, "doc_id", "size", "source", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), "draws")


def _row_key() -> Column:
    """Digest of id, source and text, nulls apart from empty values."""
    part = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    ends = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.length(part("source")).cast("string"))
    return F.unhex(F.sha2(F.concat(ends, F.lit(":"), part("source"), part("text")), 256))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """Rows of docs as the mix takes them, repeated where it repeats them, in columns of docs. Each row has its own draws, whether ids repeat or are null.

    The rows of a shard lie together and in the order of their places: each slot, a stretch of a shard's order, is shuffled by one task. Slots grow in number with the words of the mix, SLOT_WORDS for each."""
    mixed = table(mix(docs, row=_row_key()).select("row", "taken", "draws"), "mixed")
    words = mixed.agg(F.sum("taken")).first()[0] or 0
    slots = max(SHARDS, -(-words // (SHARDS * SLOT_WORDS)))
    # rows equal in id, source and text take the draws of one row each, in order
    nth = lambda order: F.row_number().over(Window.partitionBy("row").orderBy(order)).alias("nth")
    drawn = mixed.where(F.size("draws") > 0).select("row", "draws", nth(F.col("draws")))
    whole = docs.select(F.struct("*").alias("d"), _row_key().alias("row"))
    numbered = whole.select("d", "row", nth(F.xxhash64("d")))
    rows = numbered.join(drawn, ["row", "nth"]).select("d", F.explode("draws").alias("draw_"))
    slot = F.floor((F.col("draw_.place") / float(1 << 64) + 0.5) * slots)
    rows = rows.select("d", "draw_.shard", "draw_.place", slot.alias("slot"))
    return rows.repartition("shard", "slot").sortWithinPartitions("shard", "slot", "place").select("d.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos_ FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][pos_ % 3 + 1] AS w, CAST(2 * source_size AS DOUBLE) AS cap, CAST({SHARE} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, pos_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER (ORDER BY cap / w, pos_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl FROM r),
t AS (SELECT source, source_size, least(cap, coalesce(w * max(CASE WHEN cap / w > lvl THEN lvl END) OVER (), cap)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(2, floor(target / source_size + 1e-12)) AS INT) ELSE 0 END AS whole FROM t),
x AS (SELECT d.*, source_size, target, whole, greatest(0, target - whole * source_size) AS rest, 50 * size > source_size AS large FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, large ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(size) OVER (PARTITION BY source, large) AS part_ FROM x),
z AS (SELECT *, large AND bef + size / 2.0 <= rest * part_ / source_size AS fst FROM y),
q AS (SELECT *, rest - coalesce(sum(CASE WHEN fst THEN size END) OVER (PARTITION BY source), 0) AS quota FROM z)
SELECT doc_id, size, source_size, target, CAST((whole + CAST(CASE WHEN large THEN fst ELSE bef + size / 2.0 <= quota END AS INT)) * size AS BIGINT) AS taken FROM q
"""
