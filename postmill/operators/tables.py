"""Tables written once for several consumers."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). A session that names none gets a folder of its own if it runs in one process, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


#: Short rows (numbers, words, a line of a registry) that may be broadcast; longer lists join by shuffle.
BROADCAST_ROWS = 50_000


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows, else to be joined by sorting. df is counted, so it should be a written table.

    Without a hint Spark goes by the size of files, which says little about a compressed table and nothing about what is exploded from it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files, dealt out anew if it comes in fewer partitions than there are cores: work on whole texts would else wait for a few tasks. A large table stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


#: Bytes from which a text is dealt apart from shorter ones.
LONG_BYTES = 1 << 20


def apart(table: DataFrame, column: str, long: int = LONG_BYTES) -> DataFrame:
    """A table whose rows with long texts are packed by bytes into tasks of their own, so that short ones don't wait behind them. Short rows aren't shuffled; the table is read twice, which is little beside parsing. A null text is short."""
    size = F.coalesce(F.octet_length(column), F.lit(0))
    return table.where(size <= long).unionByName(table.where(size > long).hint("rebalance"))


def materialise(df: DataFrame, name: str = "rows") -> DataFrame:
    """Rows written as Parquet and read back: costly expressions run once, and lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
