"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the operators define them (ASCII only).
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Rows that a Python helper holds at once.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session that names none gets one of its own if it runs in one process (tests), and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of two numbers that may be broadcast (16 MB); longer lists join by shuffle.
BROADCAST_ROWS = 500_000
LAST_ID = (1 << 63) - 1


#: Deletes the shuffle files of an execution at its end; else they lie until the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, counts, checkpoints and tables leave no shuffle files behind. No frame made within it may be computed twice; for reuse it has to be written."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Rows written to a new path in the shared folder and read back. Shuffles made for it are deleted once it is written, as nothing reads them again."""
    path = scratch(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder under the shared one, of tables that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{path}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows. df is counted, so it should be a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def identified(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, doc, tid, text) of docs: doc is the id (null: the largest), text is never null, and tid tells rows that share an id apart by text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), text.alias("text"))
    again = few(table(rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("again")), "ids"), most)
    tid = F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.join(again, rows.doc == F.col("again"), "left").select("doc_id", "doc", tid.alias("tid"), "text")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: lambda bodies would otherwise recompute an inlined expression per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over slices of at most BATCH_ROWS rows, so that Python objects stay few; fn returns one batch or yields several."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = fn(batch.slice(at, BATCH_ROWS))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    for value in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that points (a to b) points to one node only, and that one to none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("met")), F.struct(F.col("b").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("met")))).alias("x")).select("x.*")
    open_ = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("met").alias("met")).where("points > 0 AND points + met > 1")
    return open_.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b) of longs; component is the smallest node reachable.

    Alternating large-star and small-star steps: each rewires every node to the least neighbour it knows, so that
    even long chains shrink within a logarithmic number of rounds. It ends when only stars are left. Nothing is collected but a count.
    Edges lie in a table after each round, so that few edges are read by few tasks, and those of the round before are deleted.
    """
    spark, place, k = edges.sparkSession, f"components-{uuid.uuid4().hex}", 0
    edges = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{place}/{k}")
    while not _are_stars(edges):
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # the row that holds the least neighbour keeps its node on it, any other moves its neighbour there
        edges = table(large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), f"{place}/{k + 1}")
        discard(spark, f"{place}/{k}")
        k += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
