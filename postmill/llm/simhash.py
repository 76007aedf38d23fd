"""SimHash near-duplicate groups through pigeonhole blocks.

A fingerprint of 64 bits is cut into BLOCKS blocks. Two fingerprints that differ in at most DISTANCE bits agree on
at least BLOCKS - DISTANCE blocks whole, so joining on every choice of so many blocks finds each close pair;
the Hamming distance is then verified. Equal fingerprints are joined only once, as one node.

A block shared by more than DENSE fingerprints isn't joined pairwise. There, two fingerprints are within two bits exactly
if some value is within one bit of both, so each member names itself and its one-bit neighbours in the bits the block leaves
free, and members that name the same value are linked to the least of them. That is exact, and its rows grow with the
members, not with their square; a value is named by at most 1 + free bits members.

Nulls: a null text has no words, its fingerprint is zero and it links like any other. A null doc_id is kept as a row with its
fingerprint and its own null component. Repeated rows of a doc_id keep one row each. Extra columns are dropped.
Very long texts are fingerprinted whole, one at a time in a task, whose memory grows with the words of the longest text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, components, scratch, table, texts

BLOCKS, DISTANCE, DENSE, SHINGLE = 5, 2, 32, 3


def hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 (seed 42) of every run of `shingle` lower-cased words; of all words where there are no more; of none, none."""
    words = text.lower().split()  # of bytes: A-Z alone is lowered, ASCII white space alone splits
    if not words:
        return []
    joined, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return [digest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of every run of `shingle` lower-cased words, as unsigned."""
    found = hashes(text, shingle)
    if not found:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65536):
        part = np.array(found[at : at + 65536], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batch):
        found = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(chosen)) for chosen in combinations(parts, blocks - distance)]


def links(nodes: DataFrame, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between nodes (node, fp) of distinct fp at DISTANCE bits or fewer; enough of them to keep what is connected so."""
    masks = _masks(blocks, DISTANCE)
    keyed = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.lit(m).alias("mask")) for k, m in enumerate(masks)])).alias("x"))
    keyed = keyed.select("node", "fp", "x.t", "x.mask", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    shared = table(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "blocks")  # written, so that Spark can split a block that many rows share
    members = keyed.join(shared, ["t", "key"])
    few, many = members.where(F.col("n") <= dense), members.where(F.col("n") > dense)
    left, right = few.select("t", "key", F.col("node").alias("a"), F.col("fp").alias("x")), few.select("t", "key", F.col("node").alias("b"), F.col("fp").alias("y"))
    pairs = left.join(right, ["t", "key"]).where("a < b").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE).select("a", "b")
    bits = F.array(F.lit(0).cast("long"), *[F.lit(b - (1 << 64) if b >> 63 else b).cast("long") for b in (1 << i for i in range(64))])
    named = many.select("t", "node", F.explode(F.filter(F.transform(bits, lambda b: F.struct(b.alias("b"), F.col("fp").bitwiseXOR(b).alias("v"))), lambda s: s["b"].bitwiseAND(F.col("mask")) == 0)).alias("s")).select("t", "node", "s.v")
    least = named.groupBy("t", "v").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").drop("most")
    stars = named.join(least, ["t", "v"]).where("node <> b").select(F.col("node").alias("a"), "b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text, ...)."""
    spark: SparkSession = docs.sparkSession
    path = scratch(spark, "fingerprints")
    fingerprints(docs, shingle).write.parquet(path)  # texts are read once; what follows works on 16 bytes a document
    fps = spark.read.parquet(path)
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    linked = components(links(nodes.where("node is not null"), blocks))
    named = table(nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    return fps.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
