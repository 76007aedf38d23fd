"""Exact deduplication with streaming state on disk.

A first pass reads the texts once and writes a log of (digest, code points, doc_id, row, locator). A Structured Streaming query
consumes the log; per digest its state, kept in RocksDB without expiry, retains the identifier of the best row so far (most code points,
then smallest doc_id, then the earliest), the locator of the first row (its file and its place there) and the group's size. Later batches are given the same folder: the query goes
on from its checkpoint, reads the new part of the log alone, and finds the digests of all batches before.

The digests of a batch are read back from the state as a table; those it doesn't hold are not written. A batch that was broken off is repeated with the same rows and number: a part of the log that is
whole is taken as it is, so that the stream counts no row twice, and one that is not is written anew.

Digests that were hit more than once have their whole normalised texts compared, byte for byte: those of the batch, and the first text of earlier batches, for which the
locators name the rows to reread (only those are normalised again). Texts that share a digest but differ are grouped by the text's SHA-256 instead, over the whole log.

Hot groups: the state update combines within tasks first, and the comparison takes least and greatest text by (digest, salt) before
digest, so that a group of copies never meets in one task and needs no pairs.

Nulls: a null text counts as empty. A null doc_id comes last among equals. Of repeated rows one stays. Empty tables give no rows.
Extra columns are ignored by `exact_groups`, kept by `drop_copies`. A later batch can only reread texts of tables in Parquet files with doc_id and text.
Very long texts are digested whole by built-in expressions and compared whole where a digest is hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, scratch, shared_dir

#: State on disk; without preallocation, which takes megabytes for each of many small stores.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of a hit list of 40 bytes each that may be broadcast (8 MB); above it the comparison joins by shuffle.
BROADCAST_HITS = 200_000
SALTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _best() -> Column:
    """Greatest for the row that stays; ~x turns the order of longs round without overflow."""
    turned = lambda c: F.bitwise_not(F.col(c).cast("long")).alias(c)
    return F.max(F.struct("n", turned("doc_id"), turned("batch"), turned("row")))


def _kept(best: str) -> list[Column]:
    """Identifier, batch and row that _best stands for."""
    return [F.bitwise_not(F.col(f"{best}.{c}")).alias(name) for c, name in (("doc_id", "keep_id"), ("batch", "keep_batch"), ("row", "keep_row"))]


LOG = "doc_id long, n long, row long, locator string, place long, digest binary, sha binary"


def _located(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the file of each row and its place there; both null where docs isn't read from Parquet files."""
    try:
        own = docs.metadataColumn("_metadata")
        return docs.select("doc_id", "text", own["file_path"].alias("locator"), own["row_index"].alias("place"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("locator"), F.lit(None).cast("long").alias("place"))


def _logged(rows: DataFrame, part: str) -> None:
    """Writes a part of the log unless it is there whole, which its marker tells."""
    spark = rows.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(part)


def _few(digests: DataFrame) -> DataFrame:
    return F.broadcast(digests) if digests.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS else digests


def _state(spark: SparkSession, log: str, place: str, touched: DataFrame | None) -> DataFrame:
    """(digest, keep_id, keep_batch, keep_row, first_batch, locator, place, group_size) from a streaming aggregation over the log, read from its state store: all digests, or those touched."""
    own = spark.newSession()  # its settings are nobody else's
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)
    stream = own.readStream.schema(f"{LOG}, batch long").parquet(log)
    first = F.min(F.struct(F.col("batch"), F.col("row"), F.col("locator"), F.col("place")))
    groups = stream.groupBy("digest").agg(_best().alias("best"), first.alias("first"), F.count("*").alias("size"))
    groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    state = own.read.format("statestore").load(place)
    best, first, size = (f"value.`{f.name}`" for f in state.schema["value"].dataType)
    path = scratch(spark, "exact-groups")
    found = state.select(F.col("key.digest").alias("digest"), *_kept(best), F.col(f"{first}.batch").alias("first_batch"), *[F.col(f"{first}.{c}").alias(c) for c in ("locator", "place")], F.col(size).alias("group_size"))
    (found.join(touched, "digest", "left_semi") if touched is not None else found).write.parquet(path)
    return spark.read.parquet(path)


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha, folder: str | None = None, batch: int = 0) -> DataFrame:
    """(doc_id, row, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text, ...), among these and the rows of earlier batches.

    folder: where log and state are, in the shared folder; batch: 0 for the first of a folder, and one more each time. A batch may be repeated, with the same rows, until the next one has begun."""
    spark = docs.sparkSession
    shared_dir(spark)
    folder = folder or scratch(spark, "exact")
    text = _located(docs).select(F.col("doc_id").cast("long"), "text", "locator", "place", normalised(F.col("text")).alias("body"))
    part = f"{folder}/log/batch={batch}"
    _logged(text.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"),
        "locator", "place", digest(F.col("body")).cast("binary").alias("digest"), sha(F.col("body")).alias("sha"),
    ), part)
    rows = spark.read.schema(LOG).parquet(part).withColumn("batch", F.lit(batch).cast("long"))
    state = _state(spark, f"{folder}/log", f"{folder}/state", _few(rows.select("digest").distinct()) if batch else None)
    hits = _few(state.where("group_size > 1").select("digest"))
    bodies = text.select("doc_id", "body")
    if batch:
        met = state.where(f"first_batch < {batch} AND locator IS NOT NULL").select("locator", "place")
        files = [r.locator for r in met.select("locator").distinct().collect()]
        if files:
            bodies = bodies.unionByName(_located(spark.read.parquet(*files)).join(_few(met), ["locator", "place"], "left_semi").select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("body")))
    bodies = bodies.withColumn("digest", digest(F.col("body")).cast("binary"))
    ends = bodies.join(hits, "digest", "left_semi").groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    unlike = ends.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("digest")
    named = rows.join(state.select("digest", "keep_id", "keep_batch", "keep_row", "group_size"), "digest")
    if not unlike.isEmpty():  # texts that differ under one digest: their groups go by the text itself
        every = spark.read.schema(f"{LOG}, batch long").parquet(f"{folder}/log").join(unlike, "digest", "left_semi")
        exact = every.groupBy("digest", "sha").agg(_best().alias("best"), F.count("*").alias("group_size")).select("digest", "sha", *_kept("best"), "group_size")
        named = named.join(unlike, "digest", "left_anti").unionByName(rows.join(exact, ["digest", "sha"]).select(named.columns))
    kept = (F.col("row") == F.col("keep_row")) & (F.col("batch") == F.col("keep_batch"))
    return named.select("doc_id", "row", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that do not stay."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha"))
    marked = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("id"), sha(normalised(F.col("text"))).alias("sha"), F.length("text").alias("n"))
    found = marked.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.col("n").desc()))
    return found.withColumn("at", first).where("at = 1").select("d.*")


def op6_exact(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS b FROM documents),
r AS (SELECT doc_id, b, first_value(doc_id) OVER (PARTITION BY b ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY b) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(b) AS text_sha256 FROM r
"""
