"""A training corpus from `documents` in five stages, each written as Parquet and reread as the next one's input.

Rows need doc_id, text and source; other columns, whatever their names, go through all stages unchanged. Any column may be null. An empty table gives an
empty one at each stage. Very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import exact, mixing, pieces, quality, similar
from postmill.llm.common import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Each row is judged by its own text, whatever its id: a null or empty text has no words and goes; repeated rows stay or go together."""
    judged = quality.apply_rules(docs.select(F.struct("*").alias("own"), "text"))
    return judged.where("kept").select("own.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space: the one with most code points, then the smallest id; a null id comes last. Null and empty texts are one group; of repeated rows one stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles of similarity 0.8 or more: the one with the smallest id, then the least digest of its text. Rows with a null id are linked to nothing and stay.
    Null and empty texts have equal, empty sets and are linked. Rows equal in id and text stay or go together; rows that share an id with other texts are documents of their own."""
    return similar.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some not at all, some twice. Each row has draws of its own, whether ids repeat or are null; rows without words may be taken too, as they cost nothing. A null source is a source."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces (piece_ids, which replaces a column of that name) and the text these decode to (piece_text, likewise). A null text is encoded as an empty one; each row gives one row."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources), ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither SentencePiece nor the mix's draws; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
