"""Near copies: rows whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, all of them, and what these link.

SimHash comes first: the fingerprints of op1 are linked at two bits by op1's pigeonhole blocks, and each link is checked set by set. Most pairs at 0.8 lie further apart
(up to 20 of 64 bits), so an exact pass over what SimHash leaves unlinked follows, with pigeonhole blocks that are cut from the sets themselves. Sets of
a and b shingles at 0.8 differ in at most (a + b) / 9 of them. Sizes fall into bands of a quarter's growth; a band and the next form a group, whose
pairs differ in at most k places, so of k + 1 blocks (shingles are dealt to blocks by hash) one holds the same shingles in both. Blocks that are empty in both don't count: there are
some blocks more than k + 1, and a set with more empty ones than that is dealt again by another hash, until it has few enough. Of each pair, one set's
first good deal has a block in common, and the other, which has made at least as many deals, has sent it too: no pair is lost.

Shingles that a sample shows to be frequent are left out of the first deals, so that passages in many texts don't bring unlike texts together; the sample decides cost, not
results, as further deals take all shingles. Candidates are compared by parity sketches first (a bit for each two shingles or more; they differ in no
more bits than the sets do in shingles), then set by set.

Of blocks with the same members (their number, least and greatest row and a 64-bit hash of all) one is kept.
A block that more than two rows share isn't joined pairwise at once: its members are compared with one of them, first the one
with most shared blocks, then any other, which links a large group of near copies in linear work. Rows of blocks that are open by then meet by their rarest
shingles, of which similar sets have one in common among the first fifth and one: what many unlike texts share is among these only where it is most of a text.

Nulls: a null text has no shingles, and equal sets are linked. A row with a null doc_id is linked to nothing, as in op1. A row is
known by its id and the digest of its text; rows equal in both stay or go together.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import BROADCAST_ROWS, by_batch, components, discard, few, freed_shuffles, table, texts
from .substring import rolling_hashes

WORDS, SAMPLE, FREQUENT, ROUNDS = 5, 16, 20_000, 3
#: Members of open blocks that one member is compared with at once on average, without a further round.
AT_ONCE = 24
#: Deals without frequent shingles.
RARE_DEALS = 2
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The least size of each band: (5/4)**g, rounded up.
BANDS = np.array([-(-(5**g) // 4**g) for g in range(94)], np.int64)


def text_key() -> Column:
    """Tells rows that share an id apart; a null text is not an empty one."""
    return F.unhex(F.sha2(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of the lower-cased 5-word shingles, ascending; of fewer words, of the whole sequence."""
    words = text.lower().split()
    return np.unique(rolling_hashes(words, min(WORDS, len(words)))) if words else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * MIX
    x ^= x >> np.uint64(32)
    x *= MIX
    return x ^ (x >> np.uint64(29))


def blocks(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys of the blocks of a set: sets at 0.8 have one in common."""
    n = len(found)
    if not n:
        return np.zeros(0, np.int64)
    band, out = int(np.searchsorted(BANDS, n, "right")) - 1, []
    at = np.minimum(np.searchsorted(frequent, found), max(0, len(frequent) - 1))
    rare = found[frequent[at] != found] if len(frequent) else found
    for group in range(max(0, band - 1), band + 1):
        least = 5 ** (group + 1) // 4 ** (group + 2) + 1
        spare = least // 8
        parts, deal = least + spare, 0
        while True:
            dealt = _mixed(rare if deal < RARE_DEALS else found, deal)
            part = (((dealt >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, dealt)
            filled = np.flatnonzero(np.bincount(part, minlength=parts))
            out.append(_mixed(sums[filled] + filled.astype(np.uint64) * MIX, group * 1000 + deal + 1))
            if parts - len(filled) <= spare:
                break
            deal += 1
    return np.unique(np.concatenate(out)).view(np.int64)


def sketch(found: np.ndarray) -> bytes:
    """Parities of the counts of shingles by hash. Sets that can be similar have sketches of at most two lengths, each a power of two; the longer folds to the shorter."""
    bits = 64 * max(1, 1 << max(0, (len(found) - 1).bit_length() - 6))
    return np.packbits(np.bincount((_mixed(found, 77) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _lists(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))


def _frequent(docs: DataFrame) -> np.ndarray:
    """The shingles met most often, and more than once, in a sample, ascending."""
    run = lambda batch: pa.record_batch([_lists([shingles(t).view(np.int64) for t in texts(batch.column(0))])], names=["h"])
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.col("text").cast("string"))
    counted = by_batch(sample, run, "h array<long>").select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return np.sort(np.array([r.h for r in counted.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64))


def _keyed(docs: DataFrame, place: str) -> DataFrame:
    """(row, doc_id, digest, same, n, fp, keys) of docs (doc_id, digest, text), written: same is a digest of the set, fp op1's fingerprint, keys are the set's blocks."""
    frequent = _frequent(docs)

    def run(batch):
        found = [shingles(t) for t in texts(batch.column(3))]
        fps = np.array([simhash.fingerprint(t) for t in texts(batch.column(3))], np.uint64)
        same = pa.array([hashlib.sha256(x.tobytes()).digest() for x in found], pa.binary())
        return pa.record_batch([*batch.columns[:3], same, pa.array([len(x) for x in found], pa.int32()), pa.array(fps.view(np.int64)), _lists([blocks(x, frequent) for x in found])], names=["row", "doc_id", "digest", "same", "n", "fp", "keys"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "text")
    return table(by_batch(rows, run, "row long, doc_id long, digest binary, same binary, n int, fp long, keys array<long>"), f"{place}/blocks")


def _sets(docs: DataFrame, wanted: DataFrame, place: str) -> DataFrame:
    """(row, n, sketch, hashes) of the rows wanted (row, doc_id, digest), written."""

    def run(batch):
        found = [shingles(t) for t in texts(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array([sketch(x) for x in found], pa.binary()), _lists([x.view(np.int64) for x in found])], names=["row", "n", "sketch", "hashes"])

    return table(by_batch(docs.join(few(wanted, BROADCAST_ROWS // 4), ["doc_id", "digest"]).select("row", "text"), run, "row long, n int, sketch binary, hashes array<long>"), f"{place}/sets")


def _apart(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, p, q sketches, na, nb) without those whose sketches differ in more bits than their sets may in shingles."""

    def run(batch):
        keep = []
        for k, (p, q, m, n) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)):
            x, y = sorted((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)), key=len)
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            if 9 * int(np.bitwise_count(x ^ y).sum()) <= m + n:
                keep.append(k)
        return pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return by_batch(pairs.select("a", "b", "p", "q", "na", "nb"), run, "a long, b long")


def _alike(x: str, y: str) -> Column:
    """Set sizes that allow 0.8."""
    return (5 * F.col(x) >= 4 * F.col(y)) & (5 * F.col(y) >= 4 * F.col(x))


def _verified(pairs: DataFrame, sets: DataFrame, place: str, name: str) -> DataFrame:
    """Those of pairs (a, b), a written table, at 0.8 or more, written under name; place: a folder for a table on the way."""
    side = lambda node, n, s: sets.select(F.col("row").alias(node), F.col("n").alias(n), F.col("sketch").alias(s))
    close = table(_apart(pairs.join(side("a", "na", "p"), "a").join(side("b", "nb", "q"), "b").where(_alike("na", "nb"))), f"{place}/close")
    left, right = sets.select(F.col("row").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("row").alias("b"), F.col("hashes").alias("y"))
    both = close.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return table(both.where("5 * shared >= 4 * (n - shared)").select("a", "b"), name)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _by_fingerprint(once: DataFrame, place: str) -> DataFrame:
    """Pairs (a, b) of rows of once (row, fp, ...) whose SimHash fingerprints are equal or linked at two bits, written; of rows with equal fingerprints the least stands for all."""
    prints = table(once.select("row", "fp"), f"{place}/prints")
    nodes = table(prints.groupBy("fp").agg(F.min("row").alias("node")), f"{place}/nodes")
    equal = prints.join(nodes, "fp").where("row <> node").select(*_ordered("row", "node"))
    return table(equal.unionByName(simhash.links(nodes).select(*_ordered("a", "b"))).distinct(), f"{place}/near")


def _by_rarest(rows: DataFrame, sets: DataFrame, place: str) -> DataFrame:
    """Pairs (a, b) of rows (row, part), a written table, of unlike part, all that are at 0.8 and others that share a rare shingle. Of sets in one order of shingles the first n // 5 + 1 have one in
    common, and of the first common one on each has as many as they must share. The order is by the number of these rows that hold a shingle, rarest first."""
    flat = table(sets.join(rows, "row").select("row", "n", "part", F.explode("hashes").alias("h")), f"{place}/flat")
    often = table(flat.groupBy("h").agg(F.count("*").alias("often")).where("often > 1"), f"{place}/often")
    held = flat.join(often, "h").groupBy("row").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.sort_array(F.collect_list(F.struct("often", "h"))).alias("held"))
    # shingles that no other row holds come before all others
    rare = held.withColumn("alone", F.col("n") - F.size("held")).select("row", "n", "part", "alone", F.posexplode(F.slice("held", F.lit(1), F.greatest(F.lit(0), F.expr("n DIV 5 + 1 - alone").cast("int")))).alias("at", "x"))
    rare = table(rare.select("row", "n", "part", "x.h", (F.col("n") - F.col("alone") - F.col("at")).alias("ahead")), f"{place}/rare")
    side = lambda node: rare.select("h", F.col("row").alias(node), F.col("n").alias(f"n{node}"), F.col("part").alias(f"part{node}"), F.col("ahead").alias(f"ahead{node}"))
    return side("a").join(side("b"), "h").where("a < b AND parta <> partb").where(_alike("na", "nb")).where("9 * least(aheada, aheadb) >= 4 * (na + nb)").select("a", "b")


def _stars(parts: DataFrame) -> DataFrame:
    """Edges (a, b) from each row to the least one of its component, of parts (node, component)."""
    return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def links(docs: DataFrame, keyed: DataFrame, place: str, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) between rows of keyed; what is similar is connected by them, and nothing else. place: a folder for tables, in the shared one."""
    spark = keyed.sparkSession
    twins = table(keyed.groupBy("same").agg(F.min("row").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), f"{place}/twins")
    twins = table(keyed.select("row", "same").join(few(twins, BROADCAST_ROWS // 4), "same").where("row <> b").select(F.col("row").alias("a"), "b"), f"{place}/equal")
    once = keyed.join(few(twins.select(F.col("a").alias("row")), BROADCAST_ROWS), "row", "left_anti")
    near = _by_fingerprint(once, f"{place}/first")
    flat = once.select(F.explode("keys").alias("key"), "row", "n")
    shared = table(flat.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), f"{place}/first/shared")
    every = table(flat.join(shared, "key"), f"{place}/first/every")
    # near copies share most of their blocks: of blocks with the same members one is enough
    named = every.groupBy("key").agg(F.first("members").alias("members"), F.min("row").alias("lo"), F.max("row").alias("hi"), F.bit_xor(F.xxhash64("row")).alias("all"))
    unlike = table(named.groupBy("members", "lo", "hi", "all").agg(F.min("key").alias("key")).select("key"), f"{place}/first/unlike")
    plain = table(every.join(few(unlike, BROADCAST_ROWS), "key"), f"{place}/first/members")
    weight = table(plain.groupBy("row").agg(F.count("*").alias("weight")), f"{place}/first/weights")
    members = table(plain.join(weight, "row"), f"{place}/members")
    sets = _sets(docs, table(weight.select("row").join(keyed.select("row", "doc_id", "digest"), "row"), f"{place}/first/wanted"), place)
    # a row without a shared block is like no other, and has no set here
    fast = _verified(near, sets, f"{place}/first/fast", f"{place}/first/simhash")
    # compared with the member that shares most blocks with others
    pivot = table(members.groupBy("key").agg(F.max_by(F.struct("row", "n"), F.struct("weight", "row")).alias("p")), f"{place}/first/pivots")
    pairs = members.join(pivot, "key").where("row <> p.row").where(_alike("n", "p.n")).select("row", F.col("p.row").alias("other")).select(*_ordered("row", "other"))
    pairs = table(pairs.distinct().join(near, ["a", "b"], "left_anti"), f"{place}/first/pairs")
    parts = components(fast.unionByName(_verified(pairs, sets, f"{place}/first", f"{place}/first/similar")))
    compared = table(near.unionByName(pairs), f"{place}/compared")
    discard(spark, f"{place}/first")
    fresh, idle = None, False
    for k in range(rounds + 1):
        own = f"{place}/round-{k}"
        named = table(members.where("members > 2").select("key", "row", "n").join(parts.withColumnRenamed("node", "row"), "row", "left").select("key", "row", "n", F.coalesce("component", "row").alias("part")), f"{own}/parts")
        # blocks all of whose members are connected are done
        left = table(named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("key", "m"), f"{own}/open")
        size = left.agg(F.sum("m").alias("rows"), F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs")).first()
        if not size.rows:
            break
        # another round is worth it only where it spares many pairs, and links come from it
        every = k == rounds or idle or size.pairs <= AT_ONCE * size.rows
        named = table(named.join(few(left.select("key"), BROADCAST_ROWS), "key"), f"{own}/named")
        if every:
            pairs = _by_rarest(table(named.select("row", "part").distinct(), f"{own}/rows"), sets, own)
        else:
            pivot = table(named.groupBy("key").agg(F.max_by(F.struct("row", "n", "part"), F.struct(F.xxhash64(F.lit(k), "row"), "row")).alias("p")), f"{own}/pivots")
            pairs = named.join(few(pivot, BROADCAST_ROWS // 4), "key").where("part <> p.part").where(_alike("n", "p.n")).select("row", F.col("p.row").alias("other")).select(*_ordered("row", "other"))
        pairs = table(pairs.distinct().join(compared, ["a", "b"], "left_anti"), f"{own}/candidates")
        fresh = _verified(pairs, sets, own, f"{own}/similar")
        idle = fresh.isEmpty()
        if every:
            break
        parts, fresh = parts if idle else components(_stars(parts).unionByName(fresh)), None
        compared = table(compared.unionByName(pairs), f"{place}/compared")
        discard(spark, own)
    # what is connected already is returned as stars, equal sets with their own, so that the caller has no rounds to make unless the last comparison brought links
    equal = twins.join(parts.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("component", "b").alias("b"))
    stars = equal.unionByName(_stars(parts))
    return stars if fresh is None or idle else stars.unionByName(fresh)


def _with_digest(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("digest"), F.col("text").cast("string").alias("text"))


def near_copies(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, digest) of the rows of docs (doc_id, text, ...) that go: all of a linked group but the least by id, then digest. Written; the tables on the way are deleted."""
    known, place = _with_digest(docs), f"near-{uuid.uuid4().hex}"
    with freed_shuffles(docs.sparkSession):
        keyed = _keyed(known, place)
        named = components(links(known, keyed, place, rounds)).withColumnRenamed("node", "row")
        own = F.struct("doc_id", "digest")
        groups = table(keyed.select("row", "doc_id", "digest").join(few(table(named, f"{place}/components"), BROADCAST_ROWS), "row"), f"{place}/groups")
        least = table(groups.groupBy("component").agg(F.min(own).alias("stays")), f"{place}/stay")
        gone = table(groups.join(least, "component").where(own != F.col("stays")).select("doc_id", "digest").distinct(), "near-copies")
    discard(docs.sparkSession, place)
    return gone


def drop_near_copies(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs without near copies, in columns of docs."""
    gone = few(near_copies(docs, rounds).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone")), BROADCAST_ROWS // 4)
    marked = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("id"), text_key().alias("digest"))
    return marked.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("digest") == F.col("gone")), "left_anti").select("d.*")
