"""Merkle manifest of a dataset: a tree of digests for each group of rows (a language), a tree over the groups' roots, proofs for single rows, and their check.

Building: a leaf is the digest of a row's fields. Leaves are ranked within their group without a task that ranks them all (range partitions of one written
table, counts, offsets); every level is one aggregation by rank div FAN, so no group has over FAN members. Each level is written to the manifest's store as
records digest -> children; equal subtrees are one record.

Proving: requests descend the store from the root by the digits of their rank in base FAN. A step looks up the record of each node that a request lies below,
takes the child that the digit selects and keeps the others as a segment of the path; requests with the same beginning of a rank descend as one row until they
part, so the steps of all rows' requests together cost about 1/FAN of the rows each time less. At the leaf the segments are reversed, which puts them in the order in which a checker folds them.

Digests are stored as 32 bytes and hashed as lowercase hex. Nulls: a null field is `-`; a null group comes first, as does a null id in its group. Equal ids are ordered by leaf;
rows that are wholly equal are leaves of their own that may stand for each other. The store stays in the shared folder, as a manifest is there to be asked later. An empty table has no root and no rows. Very long texts are hashed by the JVM whole.
Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, few, scratch, table

FAN = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:binary,behind:binary>>"


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields in order: `-` for null, else the length in bytes, a colon and the value."""
    parts = [v.cast("string") for v in fields.values()]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """One binary of an array of them."""
    return F.aggregate(digests, F.expr("X''"), lambda a, x: F.concat(a, x))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with `rank`, from 0 within each group by order, and `height`, the levels of the group's tree. Rows without difference in order may take each other's place."""
    keys = [group, *order]
    placed = table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()), name)
    # 33 bits below the partition's number count rows within it
    part = F.shiftright("at_", 33).alias("part_")
    runs = table(placed.groupBy(group, part).agg(F.min("at_").alias("first_"), F.count("*").alias("n_")), f"{name}-runs")
    before = F.sum("n_").over(Window.partitionBy(group).orderBy("part_")) - F.col("n_")
    total = F.sum("n_").over(Window.partitionBy(group))
    # octal digits of the last rank; a lone leaf needs no level
    height = F.when(F.col("total_") == 1, 0).otherwise(F.length(F.conv((F.col("total_") - 1).cast("string"), 10, FAN)))
    offsets = runs.select(group, "part_", (before - F.col("first_")).alias("shift_"), total.alias("total_")).withColumn("height", height.cast("int"))
    found = placed.withColumn("part_", part).join(few(offsets, BROADCAST_ROWS), [group, "part_"])
    return found.withColumn("rank", F.col("at_") + F.col("shift_")).drop("at_", "part_", "shift_", "total_")


def _build(leaves: DataFrame, store: str) -> DataFrame:
    """(key, height, digest) of the roots of all groups of leaves (key, rank, height, digest); the levels' records lie under store by level."""
    spark = leaves.sparkSession
    nodes = leaves.select("key", "rank", "height", "digest")
    roots = nodes.where("height = 0")
    for level in range(1, (leaves.agg(F.max("height")).first()[0] or 0) + 1):
        runs = nodes.where(F.col("height") >= level).groupBy("key", F.expr(f"rank div {FAN}").alias("rank")).agg(
            F.first("height").alias("height"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("children"))
        table_path = f"{store}/nodes-{level}"
        runs.withColumn("digest", F.unhex(F.sha2(text_of(_joined(F.col("children"))), 256))).write.parquet(table_path)
        made = spark.read.parquet(table_path)
        made.select("digest", "children").dropDuplicates(["digest"]).write.parquet(f"{store}/records-{level}")
        nodes = made.select("key", "rank", "height", "digest")
        roots = roots.unionByName(nodes.where(F.col("height") == level))
    return roots.select("key", "height", "digest")


@dataclass
class Manifest:
    """Where a dataset's trees lie: leaves (the given columns, key, rank, height, digest), the roots of groups (key, rank, height, digest), and the store."""

    leaves: DataFrame
    groups: DataFrame
    store: str
    root: bytes | None


def build(rows: DataFrame, order: list[str]) -> Manifest:
    """The manifest of rows (key: group, digest: leaf, and the columns of order). rows are read more than once, so they should be a written table."""
    spark = rows.sparkSession
    store = scratch(spark, "manifest")
    leaves = table(ranked(rows, "key", [*order, "digest"], "leaves"), "ranked")
    subroots = table(_build(leaves, f"{store}/groups"), "subroots").withColumnsRenamed({"key": "group", "height": "group_height"})
    groups = table(ranked(subroots.withColumn("key", F.lit("")), "key", ["group"], "groups"), "ranked-groups")
    root = _build(groups, f"{store}/top").select("digest").first()
    return Manifest(leaves, groups, store, bytes(root[0]) if root else None)


def _descend(requests: DataFrame, starts: DataFrame, store: str, highest: int, kept: list[str]) -> DataFrame:
    """requests (key, rank, ...) with digest, path and the columns kept of their group's start (key, height, digest, path, ...). A digit at a time from the highest level."""
    spark = requests.sparkSession
    state = ["key", "prefix", "digest", "path", *kept]
    begin = lambda level: starts.where(F.col("height") == level).withColumn("prefix", F.lit(0).cast("long")).select(state)
    nodes = begin(highest)
    for level in range(highest, 0, -1):
        records = spark.read.parquet(f"{store}/records-{level}")
        held = nodes.join(records, "digest").select("key", F.col("prefix").alias("above"), "children", "path", *kept)
        if level > 1:
            below = requests.where(F.col("height") >= level).select("key", F.expr(f"rank div {FAN ** (level - 1)}").alias("prefix")).distinct()
        else:
            below = requests.where("height >= 1").withColumn("prefix", F.col("rank"))
        found = below.withColumn("above", F.expr(f"prefix div {FAN}")).join(held, ["key", "above"])
        digit = (F.col("prefix") % FAN).cast("int")
        segment = F.struct(_joined(F.slice("children", F.lit(1), digit)).alias("before"), _joined(F.slice("children", digit + 2, F.lit(FAN))).alias("behind"))
        found = found.withColumns({"digest": F.element_at("children", digit + 1), "path": F.concat("path", F.array(segment))}).drop("children", "above")
        if level > 1:
            nodes = table(found.select(state).unionByName(begin(level - 1)), f"descent-{level}")
    lone = requests.where("height = 0").join(starts.where("height = 0").select("key", "digest", "path", *kept), "key").withColumn("prefix", F.lit(0).cast("long"))
    return (found.unionByName(lone.select(found.columns)) if highest else lone).drop("prefix")


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """requests (key, rank, height, and any columns but `digest`, `path`, `subroot`), rows of manifest.leaves, with digest (the leaf that the store holds), subroot, and path: the siblings before and
    behind the row at each level, from the leaf up to the root, binary."""
    groups, store = manifest.groups, manifest.store
    highest = groups.agg(F.max("height"), F.max("group_height")).first()
    top = groups.agg(F.first("key").alias("key"), F.first("height").alias("height")).where("key IS NOT NULL").withColumns({"digest": F.lit(bytearray(manifest.root or b"")), "path": F.expr(f"CAST(array() AS {PATH})")})
    asked = groups.select("key", "rank", "height", "group", "group_height")
    # written, so that the root is a row to join by and no constant
    reached = _descend(asked, table(top, "top"), f"{store}/top", highest[0] or 0, [])
    starts = table(reached.select(F.col("group").alias("key"), F.col("group_height").alias("height"), "digest", "path", F.col("digest").alias("subroot")), "starts")
    found = _descend(requests.drop("digest"), starts, f"{store}/groups", highest[1] or 0, ["subroot"])
    return found.withColumn("path", F.reverse("path"))


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings in order."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda a, s: F.concat(a, text_of(s["before"]), text_of(s["behind"]))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that follows from a leaf (binary) and its path."""
    return F.aggregate(path, text_of(leaf), lambda a, s: F.sha2(F.concat(text_of(s["before"]), a, text_of(s["behind"])).cast("binary"), 256))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, each checked against its row as it is, or with its capitals changed where 3 divides the checksum of its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    own = {f: F.col(f) for f in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(tampered, leaf_digest(own | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}))
    rows = table(docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("key"), leaf_digest(own).alias("digest"), changed.alias("changed")), "rows")
    manifest = build(rows, ["doc_id"])
    proven = prove(manifest, manifest.leaves.withColumn("leaf", F.col("digest")))
    root = F.lit((manifest.root or b"").hex())
    out = proven.select("doc_id", text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
                        fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _level_sql(name: str, level: int) -> str:
    """Nodes of the next level and, for each node of this one, its siblings; groups of one node stay as they are."""
    return f"""
{name}r{level} AS (SELECT k, rank // {FAN} AS above, any_value(n) AS n, list(digest ORDER BY rank) AS l FROM {name}{level} GROUP BY k, rank // {FAN}),
{name}s{level} AS (SELECT a.k, a.rank, a.n, CASE WHEN a.n > 1 THEN array_to_string(l[1:a.rank % {FAN}], '') ELSE '' END AS b, CASE WHEN a.n > 1 THEN array_to_string(l[a.rank % {FAN} + 2:], '') ELSE '' END AS e
  FROM {name}{level} a JOIN {name}r{level} r ON a.k = r.k AND a.rank // {FAN} = r.above),
{name}{level + 1} AS (SELECT k, above AS rank, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS digest, count(*) OVER (PARTITION BY k) AS n FROM {name}r{level}),"""


def _sql(levels: int = 6, top: int = 3) -> str:
    """SQL for up to FAN ** levels rows a language and FAN ** top languages."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    crc = ("list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x))), "
           "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))")
    steps = [("g", j, "p.r") for j in range(levels)] + [("t", j, "p.g") for j in range(top)]
    folded, joins, proof = "CASE WHEN tampered THEN changed ELSE leaf END", "", []
    for name, j, rank in steps:
        a = f"{name}_{j}"
        joins += f"\n  JOIN {name}s{j} {a} ON {a}.k = {'p.k' if name == 'g' else repr('')} AND {a}.rank = {rank} // {FAN ** j}"
        proof.append(f"{a}.b || {a}.e")
    out = f"f0 AS (SELECT p.*, {folded} AS f, {', '.join(f'{n}_{j}.n AS {n}n{j}, {n}_{j}.b AS {n}b{j}, {n}_{j}.e AS {n}e{j}' for n, j, _ in steps)}, sha256({' || '.join(proof)}) AS proof_sha256 FROM p{joins})"
    for i, (n, j, _) in enumerate(steps):
        out += f",\nf{i + 1} AS (SELECT * REPLACE (CASE WHEN {n}n{j} > 1 THEN sha256({n}b{j} || f || {n}e{j}) ELSE f END AS f) FROM f{i})"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {leaf('text')} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed,
  coalesce(xor({crc}, 4294967295) % 3 = 0, false) AS tampered FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
g0 AS (SELECT k, r AS rank, leaf AS digest, count(*) OVER (PARTITION BY k) AS n FROM q),
{''.join(_level_sql('g', j) for j in range(levels))}
t0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS rank, digest, count(*) OVER () AS n, k AS lang FROM g{levels}),
{''.join(_level_sql('t', j) for j in range(top))}
p AS (SELECT q.*, t0.rank AS g, t0.digest AS subroot, t{top}.digest AS root FROM q JOIN t0 ON t0.lang = q.k CROSS JOIN t{top}),
{out}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}
"""


OP12_SQL = _sql()
