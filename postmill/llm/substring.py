"""Substring deduplication by fixed-block anchors.

A repeat of WINDOW words holds RUN whole reference blocks of BLOCK words, wherever the blocks of the reference document fall. The index holds
non-overlapping blocks of every document, from its first word on; every rolling window of BLOCK words of every document is a probe. Both
sides keep of each RUN successive blocks of one phase only the one with the least hash: the choice depends on nothing but the words of the repeat, so a
repeat still has a kept block on both sides, and the shuffled probes shrink to a fifth.

A probe hits if a smaller document has the block. Hits, and the reference blocks they hit, mark the places where windows of WINDOW words are then
compared whole, by a digest of 95 bits: the least document of each window is found by partial aggregation, and a word goes if a window over it starts in a
smaller document. Overlapping windows join to maximal repeats. No pairs of documents are formed, so a passage in thousands of them
costs one row each. Exact copies of a text are set aside first: all their windows start in the first copy.

Nulls: a null text has no words; a null doc_id counts as larger than any. Repeated rows of a doc_id don't remove each other's words.
Texts under WINDOW words lose nothing. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_batch, few, identified, table, texts

WINDOW, BLOCK = 50, 5
RUN = (WINDOW - BLOCK + 1) // BLOCK


MULTIPLIER, MULTIPLIER_2, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _rolling(one: np.ndarray, k: int, by: np.uint64 = MULTIPLIER) -> np.ndarray:
    """A hash of each run of k words from the hashes of the words, by halving."""
    if k == 1:
        return one
    half = k // 2
    h, n = _rolling(one, half, by), max(0, len(one) - 2 * half + 1)
    h = h[:n] * np.uint64(pow(int(by), half, 1 << 64)) + h[half : half + n]
    return h if k % 2 == 0 else h[: max(0, len(one) - k + 1)] * by + one[k - 1 :]


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIXER
    return h ^ (h >> np.uint64(29))


def rolling_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of every run of k words."""
    return _finished(_rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), k))


def anchors(text: bytes, reference: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word positions) of the kept blocks: of the non-overlapping ones, or of every rolling window."""
    words = text.split()
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step, phases = (BLOCK, 1) if reference else (1, BLOCK)
    hashes = rolling_hashes(words, BLOCK)[::step]
    at = np.arange(len(hashes)) * step
    rows = -(-len(hashes) // phases)
    table = np.full(rows * phases, np.iinfo(np.uint64).max, np.uint64)
    table[: len(hashes)] = hashes
    table = table.reshape(rows, phases)  # a column for each phase
    if rows < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(table, RUN, axis=0).argmin(axis=2) + np.arange(rows - RUN + 1)[:, None]
    kept = np.zeros(rows * phases, bool)
    kept[(least * phases + np.arange(phases)).ravel()] = True
    kept = np.flatnonzero(kept[: len(hashes)])
    return hashes[kept].view(np.int64), at[kept]


def _anchor_rows(docs: DataFrame, reference: bool) -> DataFrame:
    def run(batch):
        found = [anchors(t, reference) for t in texts(batch.column(2))]
        sizes = [len(h) for h, _ in found]
        doc, tid = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
        h, at = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.record_batch([pa.array(h), pa.array(doc), pa.array(tid), pa.array(at.astype(np.int32))], names=["h", "doc", "tid", "at"])

    return by_batch(docs.select("doc", "tid", "text"), run, "h long, doc long, tid long, at int")


def _starts(at: np.ndarray, n: int) -> np.ndarray:
    """Mask of the window starts (of n words) whose window holds a whole block at one of the positions."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.clip(at + BLOCK - WINDOW, 0, n), 1)
    np.add.at(edge, np.clip(at + 1, 0, n), -1)
    return (np.cumsum(edge[:-1]) > 0)[: max(0, n - WINDOW + 1)]


def _digests(words: list[bytes]) -> np.ndarray:
    """128 bits for each window: two rolling hashes over unlike hashes of the words."""
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    two = (one ^ (one >> np.uint64(31))) * MIXER
    two ^= two >> np.uint64(27)
    return np.stack([_finished(_rolling(one, WINDOW)), _finished(_rolling(two, WINDOW, MULTIPLIER_2))], axis=1)


def _lists(column: pa.Array, *fields: str) -> list[tuple[np.ndarray, ...]]:
    """For each row of a list of structs, an array of each field; null: empty."""
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())))
    flat = [column.flatten().field(f).to_numpy(zero_copy_only=False) for f in fields]
    return [tuple(x[a:b] for x in flat) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _window_rows(marked: DataFrame) -> DataFrame:
    """(a, b, doc, tid, at, probe): digests of the windows at marked places."""

    def run(batch):
        kept, sizes = [], []
        for (places, probes), text in zip(_lists(batch.column(2), "at", "probe"), texts(batch.column(3)), strict=True):
            words = text.split()
            probe = _starts(places[probes], len(words))
            at = np.flatnonzero(probe | _starts(places, len(words)))
            pair = _digests(words)[at]
            # of equal windows of one text, as periodic texts have by thousands, one goes out: a probe if there is one
            order = np.lexsort((~probe[at], pair[:, 1], pair[:, 0]))
            once = order[np.concatenate(([True], (pair[order][1:] != pair[order][:-1]).any(axis=1)))] if len(order) else order
            kept.append((pair[once, 0].view(np.int64), (pair[once, 1] & np.uint64(0x7FFFFFFF)).astype(np.int32), at[once].astype(np.int32), probe[at[once]]))
            sizes.append(len(once))
        a, b, at, probe = (np.concatenate([np.zeros(0, kind), *[x[k] for x in kept]]).astype(kind) for k, kind in enumerate((np.int64, np.int32, np.int32, bool)))
        doc, tid = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
        return pa.record_batch([pa.array(x) for x in (a, b, doc, tid, at, probe)], names=["a", "b", "doc", "tid", "at", "probe"])

    # doc_id is not needed here, but with it both uses of the texts shuffle the same columns, and Spark shuffles them once
    return by_batch(marked.select("doc", "tid", "marks", "text", "doc_id"), run, "a long, b int, doc long, tid long, at int, probe boolean")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept holds the words left, joined by one space."""
    # what rows are looked up in is written first, so that Spark can split a key that many rows share
    whole = identified(docs, BROADCAST_ROWS)
    named = whole.select("doc", "tid", F.unhex(F.sha2("text", 256)).alias("sha"))
    groups = table(named.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("sha", "first"), "equal")
    copies = few(table(named.join(few(groups, BROADCAST_ROWS // 4), "sha").where("doc > first").select("doc", "tid").distinct(), "copies"), BROADCAST_ROWS)
    firsts = whole.join(copies, ["doc", "tid"], "left_anti")

    refs = table(_anchor_rows(firsts, True), "blocks")
    index = table(refs.groupBy("h").agg(F.min("doc").alias("least")), "index")
    hits = table(_anchor_rows(firsts, False).join(index, "h").where("least < doc").select("h", "doc", "tid", "at"), "hits")
    hit = refs.join(table(hits.select("h").distinct(), "hit"), "h", "left_semi")
    mark = lambda df, probe: df.select("doc", "tid", F.struct("at", F.lit(probe).alias("probe")).alias("m"))
    marks = table(mark(hits, True).unionByName(mark(hit, False)).groupBy("doc", "tid").agg(F.collect_set("m").alias("marks")), "marks")

    windows = _window_rows(whole.join(marks, ["doc", "tid"]))
    least = table(windows.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").select("a", "b", "least"), "least")
    gone = windows.where("probe").join(least, ["a", "b"]).where("least < doc").select("doc", "tid", "at")
    gone = table(gone.unionByName(copies.select("doc", "tid", F.lit(-1).alias("at"))).groupBy("doc", "tid").agg(F.collect_set(F.struct("at")).alias("gone")), "gone")
    judged = whole.join(gone, ["doc", "tid"], "left").select("doc_id", "gone", "text")

    def finish(batch):
        out = []
        for (gone,), text in zip(_lists(batch.column(1), "at"), texts(batch.column(2)), strict=True):
            words = text.split()
            n = len(words)
            if n < WINDOW or not len(gone):
                out.append((n, 0, b" ".join(words)))
            elif gone.min() < 0:
                out.append((n, n, b""))
            else:
                edge = np.zeros(n + 1, np.int32)
                # with the text's other windows of these words
                runs = _digests(words).view([("a", np.uint64), ("b", np.uint64)])[:, 0]
                at = np.flatnonzero(np.isin(runs, runs[gone]))
                edge[at] += 1
                np.add.at(edge, at + WINDOW, -1)
                left = np.cumsum(edge[:-1]) == 0
                out.append((n, int(n - left.sum()), b" ".join([w for w, k in zip(words, left.tolist(), strict=True) if k])))
        return pa.record_batch([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].decode() for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return by_batch(judged, finish, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring(spark, sf_dir: str) -> DataFrame:
    left = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM d, unnest(range(1, len(ws) - 48)) AS u(p)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM w JOIN f USING (k) WHERE first < doc_id),
x AS (SELECT doc_id, list(q) AS qs FROM g GROUP BY doc_id),
t AS (SELECT d.doc_id, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS u(p)),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.q = t.p WHERE g.q IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
