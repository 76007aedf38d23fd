"""Suffix-array deduplication of bytes by prefix-free parsing.

Parsing: a position whose next CONTEXT bytes hash to zero modulo 2**TRIGGER_BITS is a trigger; a phrase runs from behind one trigger to the next, trigger
string included, so phrases overlap by that string and no phrase suffix longer than it is a prefix of another. A suffix of the text is a suffix of a phrase followed by
the parse behind that phrase, and only its first LENGTH bytes matter here.

1. Parse: its suffixes, one for each phrase, are grouped by the bytes around the trigger that all suffixes starting in the phrase hold (LENGTH - NEAR bytes behind it for
   starts at most NEAR before it). A parse suffix that is alone in its group repeats nowhere; that ends it for most text.
2. Dictionary: in the groups left, phrases with their right context are made distinct and counted. Where all distinct phrases of a group
   occur twice or more, every suffix starting in them repeats.
3. Order: the distinct phrases of each other group are brought together with their bytes, and their suffixes are sorted: the suffix array of the group's dictionary,
   which is a stretch of the corpus order, as suffixes that share LENGTH bytes share their group. Neighbours with LENGTH bytes in common, counted by how often their
   phrases occur, are repeated. A group of over MANY distinct phrases is not sorted in one task: its suffixes are counted by their digests, dealt to all tasks.
The suffixes of text that repeats nowhere are never sorted: a row for each byte of it would be many times the input.

Longer phrases are cut by the distance to their trigger, at NEAR and REACH bytes, so that each part has a long key; suffixes that hold no trigger are phrases by themselves,
and those that a text repeats itself (periodic text) are found within its task. Removed is every byte under a repeated suffix.

One row goes out per phrase, about 2**TRIGGER_BITS bytes of text. Hot passages cost one row per occurrence in step 1 and one per distinct context after it.
Nulls: a null text is empty; null and repeated doc_ids stay rows, repeated rows repeat each other. Texts under LENGTH bytes lose nothing. Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_batch, few, identified, table, texts

LENGTH, CONTEXT, NEAR, REACH, TRIGGER_BITS = 400, 8, 80, 192, 6
#: Distinct phrases of a group that one task sorts (about 50 suffixes each); suffixes sorted at once, in whole groups; bytes of text handled at once, in whole texts.
MANY, AT_ONCE, PIECE = 1000, 20_000, 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
#: A random number for each byte value.
SYMBOLS = np.array([xxhash.xxh3_64_intdigest(bytes([x]), 7) for x in range(256)], np.uint64)
NONE = np.zeros(0, np.int64)


def joined(column: pa.Array):
    """(row from, bytes, offsets) of the texts of a column, in pieces of about PIECE bytes and one text at least."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if not pa.types.is_binary(column.type) else column.cast(kind)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def hashes(data: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the bytes left to right, from sums over prefixes."""
    power = np.full(len(data) + 1, MULTIPLIER, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SYMBOLS[data] * power[:-1], dtype=np.uint64, out=sums[1:])
    back = np.full(len(data) + 1, INVERSE, np.uint64)
    back[0] = 1
    h = (sums[right] - sums[left]) * np.cumprod(back, dtype=np.uint64)[left]
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def triggers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, text) of the places whose next CONTEXT bytes, in one text, end a phrase."""
    n = len(data) - CONTEXT + 1
    if n <= 0:
        return NONE, NONE
    words = np.ndarray((n,), "<u8", data, strides=(1,))
    found = np.concatenate([np.flatnonzero((words[at : at + 65536] * MULTIPLIER) >> np.uint64(64 - TRIGGER_BITS) == 0) + at for at in range(0, n, 65536)])
    of = np.searchsorted(ends, found, "right") - 1
    inside = found + CONTEXT <= ends[of + 1]
    return found[inside], of[inside]


def gaps(data: np.ndarray, ends: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, text) of the suffixes whose LENGTH bytes hold no trigger."""
    last = ends[1:] - LENGTH
    every = np.arange(len(last))
    text = np.concatenate((of, every))  # up to each trigger, and behind the last one
    order = np.lexsort((np.concatenate((at, ends[1:])), text))
    stop = np.concatenate((at - (LENGTH - CONTEXT) - 1, last))[order]
    text = text[order]
    began = np.concatenate((at + 1, ends[1:]))[order]
    low = np.concatenate(([0], began[:-1]))
    low = np.where(np.concatenate(([True], text[1:] != text[:-1])), ends[:-1][text], low)
    high = np.minimum(stop, last[text])
    size = np.maximum(0, high - low + 1)
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(text, size)


def groups(data: np.ndarray, ends: np.ndarray):
    """(text, kind, key from, key to, first start, last start) of the suffixes of LENGTH bytes, as arrays.

    kind 0: starts at most NEAR before their trigger, 3: at most REACH, 1: further, 2: without a trigger (a row for each start)."""
    at, of = triggers(data, ends)
    before = np.where(np.concatenate(([True], of[1:] != of[:-1])), ends[of] - 1, np.concatenate(([0], at[:-1]))) if len(at) else at
    last = (ends[1:] - LENGTH)[of]
    parts = []
    for kind, low, high, left, right in ((0, at - NEAR, at, at, at + LENGTH - NEAR), (3, at - REACH, at - NEAR - 1, at - NEAR, at + LENGTH - REACH), (1, at - (LENGTH - CONTEXT), at - REACH - 1, at - REACH, at + CONTEXT)):
        first, final = np.maximum(before + 1, low), np.minimum(high, last)
        keep = np.flatnonzero(first <= final)
        parts.append([of[keep], np.full(len(keep), kind), left[keep], right[keep], first[keep], final[keep]])
    lone, text = gaps(data, ends, at, of)
    parts.append([text, np.full(len(lone), 2), lone, lone + LENGTH, lone, lone])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _windows(data: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, LENGTH)


def own_repeats(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, text) of the suffixes without a trigger whose LENGTH bytes occur again in the same text: in periodic text there is one at each byte, so these stay in the task."""
    lone, text = gaps(data, ends, *triggers(data, ends))
    if not len(lone):
        return NONE, NONE
    h = hashes(data, lone, lone + LENGTH)
    order = np.lexsort((h, text))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])))
    head = lone[order][np.flatnonzero(new)[np.cumsum(new) - 1]]  # the first with this hash; bytes decide
    same, seen = np.ones(len(order), bool), _windows(data)
    for k in range(0, len(order), 4096):
        same[k : k + 4096] = (seen[lone[order[k : k + 4096]]] == seen[head[k : k + 4096]]).all(axis=1)
    counts = np.bincount(np.cumsum(new) - 1, weights=same)
    found = order[same & (counts[np.cumsum(new) - 1] > 1)]
    return lone[found], text[found]


def _phrase_rows(docs: DataFrame, whole: bool) -> DataFrame:
    """(short) or (short, a, doc, tid, first, last): group key, digest of all bytes under the starts, and the starts first to last."""
    names, kinds = ["short", "a", "doc", "tid", "first", "last"], [np.int64] * 4 + [np.int32] * 2

    def run(batch):
        doc, tid = (batch.column(k).to_numpy() for k in (0, 1))
        for row, data, ends in joined(batch.column(2)):
            text, kind, left, right, first, last = groups(data, ends)
            short = (hashes(data, left, right) ^ (kind.astype(np.uint64) * MULTIPLIER)).view(np.int64)
            lone = np.flatnonzero(kind == 2)  # of those alike within a text one goes out, for other texts to meet
            order = lone[np.lexsort((short[lone], text[lone]))]
            again = (short[order][1:] == short[order][:-1]) & (text[order][1:] == text[order][:-1])
            keep = np.ones(len(kind), bool)
            keep[order[1:][again]] = False
            keep = np.flatnonzero(keep)
            if not whole:
                yield pa.record_batch([pa.array(short[keep])], names=names[:1])
                continue
            body, digest = data.tobytes(), xxhash.xxh3_64_intdigest
            a = np.fromiter((digest(body[x:y]) for x, y in zip(first[keep].tolist(), (last[keep] + LENGTH).tolist(), strict=True)), np.uint64, len(keep)).view(np.int64)
            begin, rows = ends[:-1][text[keep]], text[keep] + row
            cols = [short[keep], a, doc[rows], tid[rows], first[keep] - begin, last[keep] - begin]
            yield pa.record_batch([pa.array(c.astype(k)) for c, k in zip(cols, kinds, strict=True)], names=names)

    return by_batch(docs.select("doc", "tid", "text"), run, "short long, a long, doc long, tid long, first int, last int" if whole else "short long")


def _spans_of(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """(doc, tid, spans, text) of the texts that hold the first occurrence of a phrase of open_."""
    spans = table(open_.groupBy("doc", "tid").agg(F.collect_list(F.struct("short", "first", "last", "times")).alias("spans")), "spans")
    # doc_id is not needed here, but with it all uses of the texts shuffle the same columns, and Spark shuffles them once
    return docs.join(spans, ["doc", "tid"]).select("doc", "tid", "spans", "text", "doc_id")


def _ordered(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """(doc, tid, first, last): repeated suffixes of the phrases of open_ that occur once, from the order of each group's suffixes."""

    def bodies(batch):
        for doc, tid, spans, text in zip(*(batch.column(k).to_pylist() for k in range(3)), texts(batch.column(3)), strict=True):
            for k in range(0, len(spans), 2000):
                part = spans[k : k + 2000]
                col = lambda name, kind, part=part: pa.array([s[name] for s in part], kind)
                yield pa.record_batch([col("short", pa.int64()), pa.array([doc] * len(part), pa.int64()), pa.array([tid] * len(part), pa.int64()), col("first", pa.int32()), col("times", pa.int64()), pa.array([text[s["first"] : s["last"] + LENGTH] for s in part], pa.binary())], names=["short", "doc", "tid", "first", "times", "body"])

    rows = by_batch(_spans_of(docs, open_), bodies, "short long, doc long, tid long, first int, times long, body binary")

    def sort(batches):
        held, suffixes = [], 0
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for x in zip(*cols, strict=True):
                if suffixes >= AT_ONCE and x[0] != held[-1][0]:  # whole groups only
                    yield _repeated(held)
                    held, suffixes = [], 0
                held.append(x)
                suffixes += len(x[5]) - LENGTH + 1
        if held:
            yield _repeated(held)

    return rows.repartition("short").sortWithinPartitions("short").mapInArrow(sort, "doc long, tid long, first int, last int")


def _repeated(held: list[tuple]) -> pa.RecordBatch:
    """The suffix array of the phrases held, cut at LENGTH bytes; runs of starts whose bytes a neighbour shares, in phrases that occur once."""
    data = np.frombuffer(b"".join([x[5] for x in held]), np.uint8)
    size = np.array([len(x[5]) for x in held], np.int64)
    count, begin = size - LENGTH + 1, np.cumsum(size) - size
    of = np.repeat(np.arange(len(held)), count)
    within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    bodies = _windows(data)[begin[of] + within].reshape(-1).view(f"S{LENGTH}")
    order = np.argsort(bodies, kind="stable")
    ranked = bodies[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    times = np.array([x[4] for x in held], np.int64)
    total = np.add.reduceat(times[of[order]], np.flatnonzero(new))
    hit = np.zeros(len(of), bool)
    hit[order] = total[np.cumsum(new) - 1] > 1
    hit &= times[of] == 1  # all suffixes of the others are known to repeat
    at = np.flatnonzero(hit)
    start = at[np.concatenate(([True], (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])))] if len(at) else at
    stop = at[np.concatenate(((at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]]), [True]))] if len(at) else at
    doc, tid, first = (np.array([x[k] for x in held], np.int64) for k in (1, 2, 3))
    cols = [doc[of[start]], tid[of[start]], first[of[start]] + within[start], first[of[stop]] + within[stop]]
    return pa.record_batch([pa.array(c.astype(k)) for c, k in zip(cols, [np.int64, np.int64, np.int32, np.int32], strict=True)], names=["doc", "tid", "first", "last"])


def _counted(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """What _ordered gives, for groups of any size: suffixes are counted by a digest of 96 bits of their LENGTH bytes."""

    def run(batch):
        digest = xxhash.xxh3_128_digest
        for doc, tid, spans, text in zip(*(batch.column(k).to_pylist() for k in range(3)), texts(batch.column(3)), strict=True):
            for k in range(0, len(spans), 256):
                at = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans[k : k + 256]])
                times = np.concatenate([np.full(s["last"] + 1 - s["first"], s["times"]) for s in spans[k : k + 256]])
                pair, n = np.frombuffer(b"".join([digest(text[a : a + LENGTH]) for a in at.tolist()]), np.int64).reshape(-1, 2), len(at)
                yield pa.record_batch([pa.array(pair[:, 0]), pa.array((pair[:, 1] & 0x7FFFFFFF).astype(np.int32)), pa.array(np.full(n, doc)), pa.array(np.full(n, tid)), pa.array(at.astype(np.int32)), pa.array(times)], names=["x", "y", "doc", "tid", "at", "times"])

    suffixes = by_batch(_spans_of(docs, open_), run, "x long, y int, doc long, tid long, at int, times long")
    repeated = table(suffixes.groupBy("x", "y").agg(F.sum("times").alias("n")).where("n > 1").select("x", "y"), "repeated")
    return suffixes.where("times = 1").join(repeated, ["x", "y"]).select("doc", "tid", F.col("at").alias("first"), F.col("at").alias("last"))


def remove_repeats(docs: DataFrame, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the bytes left."""
    # rows alike in id and text count as many times as there are
    whole = identified(docs, BROADCAST_ROWS)
    digests = whole.where(F.octet_length("text") >= LENGTH).select("doc", "tid", F.unhex(F.sha2("text", 256)).alias("sha"))
    sizes = few(table(digests.groupBy("sha").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tid")).alias("head")).where("n > 1").select("sha", "head"), "equal"), BROADCAST_ROWS // 4)
    copies = table(digests.join(sizes, "sha").select("doc", "tid", (F.struct("doc", "tid") == F.col("head")).alias("head")).distinct(), "copies")
    others = few(copies.where("not head").select("doc", "tid"), BROADCAST_ROWS)
    # of texts that occur twice or more only the first is parsed: it stands for all, and all of them go whole
    parsed = whole.join(others, ["doc", "tid"], "left_anti")

    shared = table(_phrase_rows(parsed, False).groupBy("short").agg(F.count("*").alias("n")).where("n > 1").select("short"), "shared")
    phrases = table(_phrase_rows(parsed, True).join(shared, "short"), "phrases")
    dictionary = table(phrases.groupBy("short", "a").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("doc", "tid", "first", "last")]), "dictionary")
    sizes = table(dictionary.groupBy("short").agg(F.min("times").alias("rarest"), F.count("*").alias("n")).where("rarest = 1").select("short", "n"), "undecided")
    undecided = dictionary.join(sizes, "short")
    lone = _ordered(whole, undecided.where(F.col("n") <= many))
    large = undecided.where(F.col("n") > many)
    if not sizes.where(F.col("n") > many).isEmpty():
        lone = lone.unionByName(_counted(whole, large))
    twice = table(dictionary.where("times > 1").select("short", "a"), "twice")
    sure = phrases.join(twice, ["short", "a"]).select("doc", "tid", "first", "last")
    entire = copies.select("doc", "tid", F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    gone = table(lone.unionByName(sure).unionByName(entire).groupBy("doc", "tid").agg(F.collect_set(F.struct("first", "last")).alias("gone")), "gone")
    judged = whole.join(gone, ["doc", "tid"], "left").select("doc_id", "gone", "text")

    def finish(batch):
        marks = batch.column(1)
        for row, data, ends in joined(batch.column(2)):
            n = len(ends) - 1
            own, _ = own_repeats(data, ends)
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, own, 1)
            np.add.at(edge, own + LENGTH, -1)
            part = marks.slice(row, n)
            inner = part.flatten()
            of = np.repeat(np.arange(n), part.value_lengths().fill_null(0).to_numpy())
            first, last = (inner.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            entire = first < 0
            np.add.at(edge, ends[:-1][of] + np.maximum(first, 0), 1)
            np.add.at(edge, np.where(entire, ends[1:][of], ends[:-1][of] + last + LENGTH), -1)
            left = np.cumsum(edge[:-1]) == 0
            here = np.flatnonzero(~left)
            removed, spans = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if len(here):
                text = np.searchsorted(ends, here, "right") - 1
                removed = np.bincount(text, minlength=n)
                spans = np.bincount(text[np.concatenate(([True], (here[1:] != here[:-1] + 1) | (text[1:] != text[:-1])))], minlength=n)
            size = ends[1:] - ends[:-1]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size - removed)))), pa.py_buffer(data[left].tobytes())])
            yield pa.record_batch([batch.column(0).slice(row, n), pa.array(size), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), kept.cast(pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return by_batch(judged, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffixes(spark, sf_dir: str) -> DataFrame:
    left = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
