"""Alignment of the tokens of two tokenizers over the same texts, and how often their ids are linked across the corpus.

A is a byte-level BPE (a tokenizers file), B a SentencePiece BPE. Each text is put behind one space and encoded by both; a token is the byte range that it writes. Per batch, keyed by document, pandas'
merge_asof finds for each token's start the other side's token that covers it; the union of both directions holds all overlaps, and overlaps whose ends are equal close a group: between two such
ends the tokens of either side write the same bytes. All A-B pairs of a group are links.

A task keeps a table of distinct chunks, cut at single spaces before a letter or sign, where neither tokenizer's tokens reach across, so that a long text can be aligned in parts too: a part ends where both sides' tokens end.
Per document Spark then holds its distinct linked id pairs with how often each occurs; an id pair's count adds up partial counts of tasks, so a pair that all documents hold costs a row a task.
Counts come back to the documents in slices of at most SLICE_PAIRS pairs, each broadcast by itself (24 bytes a pair) whatever the number of slices, and documents add up what slices give. Nothing is joined by a pair, as a hot one is in nearly all documents.

Defined cases: null and empty texts, and texts whose tokens of either side don't write exactly the space and the text (one that holds U+2581, say), have no tokens: zeros and an empty string. Null and repeated ids are
documents of their own, and so are repeated texts. Other columns are not read. Very long texts are aligned part by part (about 200 bytes of memory for each of a part's PART_TOKENS tokens, and 100 for each word of
the text); a stretch without a place to cut is one part.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .pieces import MARK, ChunkTable, model_bytes

#: Chunks that a task's table holds before it is emptied, and the longest that it keeps and gives to the quicker of A's encoders.
TABLE_ROWS, TABLE_IDS, LONG_CHUNK = 600_000, 8_000_000, 300
#: Words that A's quicker encoder is given in one call, tokens that are aligned at once, distinct pairs that a task counts at once, and pairs in one broadcast slice of the counts.
RUN_WORDS, PART_TOKENS, COUNT_PAIRS, SLICE_PAIRS = 2000, 1 << 18, 1 << 21, 1 << 21
SIGN = re.compile("[!-~À-ɏ]")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """word -> number, given at the first look-up; new holds words not encoded yet. -1: a word that may not stand by itself."""

    def __init__(self):
        super().__init__()
        self.new, self.next = [], 0

    def __missing__(self, word: str) -> int:
        if len(word) > LONG_CHUNK or not SIGN.match(word):
            return -1
        self.new.append(word)
        self[word] = self.next
        self.next += 1
        return self.next - 1


class Aligner:
    """Both tokenizers, their tokens' bytes and the table of chunks."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        pieces = ChunkTable(b_model)
        self.b, spec, letters = pieces.sp, json.loads(a_json), byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[1:-1], 16)]) if self.b.is_byte(i) else piece(i).replace(MARK, " ").encode() for i in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        own = spec.get("pre_tokenizer") or {}
        byte_level = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space")
        self.exact = byte_level and pieces.exact
        self.quick = self._ranks(spec) if byte_level else None
        self._clear()

    def _clear(self) -> None:
        """Empties the table: chunk -> number, and by number where its ids lie on either side, and whether both sides write its bytes."""
        self.table, self.odd = _Words(), {}
        self.pools = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.begins, self.good = [np.zeros(1, np.int64), np.zeros(1, np.int64)], np.zeros(0, bool)

    def _ranks(self, spec: dict):
        """A faster encoder of the same vocabulary, where ids number the 256 bytes and then the merges in order."""
        import public_tokenizers
        import tiktoken

        special = {t["id"] for t in spec.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        in_order = all(spec["model"]["vocab"].get("".join(m)) == 256 + k for k, m in enumerate(merges))
        ranks = {t: i for i, t in enumerate(self.a_bytes) if i not in special}
        if not in_order or len(ranks) != 256 + len(merges):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _same(self, own: str, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == (b" " + own.encode()) == b"".join(map(self.b_bytes.__getitem__, b))

    def _add(self, chunks: list[str], a: list[list[int]], b: list[list[int]], good: list[bool]) -> None:
        """Encoded chunks join the table's arrays."""
        for k, ids in ((0, a), (1, b)):
            sizes = [len(x) for x in ids]
            self.pools[k] = np.concatenate([self.pools[k], np.array(list(itertools.chain.from_iterable(ids)), np.int64)])
            self.begins[k] = np.append(self.begins[k], self.begins[k][-1] + np.cumsum(sizes))
        self.good = np.append(self.good, np.array(good, bool))

    def _encode(self, chunks: list[str]) -> None:
        """Each chunk by itself, with a space before it."""
        a = [x.ids for x in self.a.encode_batch([" " + c for c in chunks], add_special_tokens=False)]
        b = self.b.encode(chunks, num_threads=1)
        self._add(chunks, a, b, [self._same(*x) for x in zip(chunks, a, b, strict=True)])

    def _encode_words(self, words: list[str]) -> None:
        """Words that may follow each other: many in one call, as tokens don't reach across their fronts."""
        for begin in range(0, len(words), RUN_WORDS):
            own = words[begin : begin + RUN_WORDS]
            run = " ".join(own)
            a, b = self.quick.encode_ordinary(" " + run), self.b.encode(run)
            ends = np.cumsum([1 + len(w.encode()) for w in own])
            if not (self.quick.decode_bytes(a) == b" " + run.encode() == b"".join(map(self.b_bytes.__getitem__, b))):
                self._encode(own)
                continue
            cuts = []
            for ids, lengths in ((a, self.a_length), (b, self.b_length)):
                reached = np.cumsum(lengths[ids])
                cut = np.searchsorted(reached, ends)
                assert (reached[cut] == ends).all()
                cuts.append(cut + 1)
            for k, ids in ((0, a), (1, b)):
                self.begins[k] = np.append(self.begins[k], self.begins[k][-1] + cuts[k])
                self.pools[k] = np.append(self.pools[k], np.array(ids, np.int64))
            self.good = np.append(self.good, np.ones(len(own), bool))

    def _merged(self, words: list[str]) -> list[str]:
        """Chunks of a text whose words may not all stand by themselves."""
        if not self.exact:
            return [" ".join(words)]
        out = [[words[0]]]
        for before, w in zip(words, words[1:], strict=False):
            if before and SIGN.match(w):
                out.append([w])
            else:
                out[-1].append(w)
        return [" ".join(c) for c in out]

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of each text's chunks in the table; none where it has no tokens."""
        if len(self.good) > TABLE_ROWS or len(self.pools[0]) + len(self.pools[1]) > TABLE_IDS:
            self._clear()
        table, odd = self.table, {}
        split = [t.split(" ") if t else [] for t in texts]
        found = [list(map(table.__getitem__, words)) for words in split]
        if table.new:
            (self._encode_words if self.quick else self._encode)(table.new)
            table.new = []
        for k, words in enumerate(split):
            if -1 in found[k] or not self.exact:
                odd[k] = self._merged(words)
        new = list({c for chunks in odd.values() for c in chunks if c not in self.odd})
        if new:
            self.odd |= {c: table.next + k for k, c in enumerate(new)}
            table.next += len(new)
            self._encode(new)
        for k, chunks in odd.items():
            found[k] = [self.odd[c] for c in chunks]
        numbers = [np.array(own, np.int64) for own in found]
        return [at if self.good[at].all() else at[:0] for at in numbers]

    def ids(self, side: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each chunk) of chunks in order."""
        begins = self.begins[side][at]
        sizes = self.begins[side][at + 1] - begins
        ends = np.cumsum(sizes)
        return self.pools[side][np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])], sizes


@lru_cache(maxsize=2)
def _aligner(a_json: str, b_model: bytes) -> Aligner:
    return Aligner(a_json, b_model)


def overlaps(doc_a: np.ndarray, len_a: np.ndarray, doc_b: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """(place of A's token, place of B's token, end of A's, end of B's) of all pairs of tokens whose bytes overlap. Documents follow each other; a document has as many bytes on either side."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    a = pd.DataFrame({"doc": doc_a, "at": end_a - len_a, "a": np.arange(len(len_a)), "end_a": end_a})
    b = pd.DataFrame({"doc": doc_b, "at": end_b - len_b, "b": np.arange(len(len_b)), "end_b": end_b})
    by_a, by_b = pd.merge_asof(a, b, on="at", by="doc"), pd.merge_asof(b, a, on="at", by="doc")
    # tokens that begin together were found from A's side
    later = by_b["at"].to_numpy() > (end_a - len_a)[by_b["a"].to_numpy()]
    columns = ["a", "b", "end_a", "end_b"]
    return np.array([np.concatenate([by_a[c].to_numpy(), by_b[c].to_numpy()[later]]) for c in columns])


def groups(len_a: np.ndarray, len_b: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B: overlaps with equal ends close groups."""
    closed = np.sort(pairs[2][pairs[2] == pairs[3]])
    return np.searchsorted(closed, np.cumsum(len_a)), np.searchsorted(closed, np.cumsum(len_b))


class _Document:
    """What is added up over a document's parts."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest, self.keys, self.times = hashlib.sha256(), [], []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) == 1:
            return self.keys[0], self.times[0]
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(self.times)).astype(np.int32)


@lru_cache(maxsize=1)
def _digits(n: int) -> list[bytes]:
    """Each id below n followed by each of the three separators."""
    return [b"%d" % i + s for s in (b",", b"|", b";") for i in range(n)]


def _part(aligner: Aligner, docs: list[_Document], chunks: list[tuple[int, np.ndarray]]) -> None:
    """Aligns one part's tokens (place of the document, its chunks) and adds them to the documents."""
    whose, at = np.array([d for d, _ in chunks]), np.concatenate([c for _, c in chunks])
    of_chunk, sides = np.repeat(whose, [len(c) for _, c in chunks]), []
    for side, lengths in ((0, aligner.a_length), (1, aligner.b_length)):
        ids, sizes = aligner.ids(side, at)
        sides.append((np.repeat(of_chunk, sizes), ids, lengths[ids]))
    (doc_a, a, len_a), (doc_b, b, len_b) = sides
    group_a, group_b = groups(len_a, len_b, overlaps(doc_a, len_a, doc_b, len_b))
    n = int(group_a[-1]) + 1
    size_a, size_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    of_group = doc_a[first_a]

    # the string: A's ids of a group, then B's
    most = max(len(aligner.a_bytes), len(aligner.b_bytes))
    codes = np.empty(len(a) + len(b), np.int64)
    place_a = np.arange(len(a)) + first_b[group_a]
    place_b = np.arange(len(b)) + (first_a + size_a)[group_b]
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[first_a + size_a - 1] = last_b[first_b + size_b - 1] = True
    codes[place_a], codes[place_b] = a + most * last_a, b + 2 * most * last_b
    digits, flat = _digits(most), codes.tolist()
    cut_a, cut_b = np.searchsorted(doc_a, whose, "right"), np.searchsorted(doc_b, whose, "right")

    # links: every token of A with each of its group's tokens of B
    times = size_b[group_a]
    offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    key = np.repeat(a, times) << 32 | b[np.repeat(first_b[group_a], times) + offset]
    link_doc = np.repeat(doc_a, times)
    cut_l = np.searchsorted(link_doc, whose, "right")
    order = np.lexsort((key, link_doc)) if len(whose) > 1 else np.argsort(key, kind="stable")
    key, link_doc = key[order], link_doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (link_doc[1:] != link_doc[:-1])
    at = np.flatnonzero(new)
    keys, counts, cut_k = key[at], np.diff(np.append(at, len(key))), np.searchsorted(link_doc[at], whose, "right")
    begin_a = begin_b = begin_l = begin_k = 0
    cut_g = np.searchsorted(of_group, whose, "right")
    begin_g = 0
    for d, ta, tb, tl, tk, tg in zip(whose.tolist(), cut_a.tolist(), cut_b.tolist(), cut_l.tolist(), cut_k.tolist(), cut_g.tolist(), strict=True):
        own = docs[d]
        text = b"".join(map(digits.__getitem__, flat[begin_a + begin_b : ta + tb]))
        own.digest.update((b";" if own.n_a else b"") + text[:-1])
        own.n_a, own.n_b, own.n_groups, own.n_links = own.n_a + ta - begin_a, own.n_b + tb - begin_b, own.n_groups + tg - begin_g, own.n_links + tl - begin_l
        own.keys.append(keys[begin_k:tk])
        own.times.append(counts[begin_k:tk].astype(np.int32))
        begin_a, begin_b, begin_l, begin_k, begin_g = ta, tb, tl, tk, tg


def align_texts(aligner: Aligner, texts: list[str]) -> list[_Document]:
    """One record for each text."""
    docs, part, size = [_Document() for _ in texts], [], 0
    for d, found in enumerate(aligner.tokens(texts)):
        # tokens of both sides up to each chunk, about the bytes they write
        reached = np.cumsum(aligner.begins[0][found + 1] - aligner.begins[0][found] + aligner.begins[1][found + 1] - aligner.begins[1][found])
        begin = 0
        while begin < len(found):
            before = reached[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(reached, before + PART_TOKENS - size, "right")))
            part.append((d, found[begin:end]))
            size += int(reached[end - 1] - before)
            begin = end
            if size >= PART_TOKENS or begin < len(found):
                _part(aligner, docs, part)
                part, size = [], 0
    if part:
        _part(aligner, docs, part)
    return docs


COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, a_json: str | None = None, b_model: bytes | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of docs (doc_id, text): counts of tokens, groups and links, the digest of the groups' ids, and the distinct linked
    id pairs (A's id << 32 | B's id) with how often each is linked in the document."""
    if a_json is None:
        import public_tokenizers

        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            a_json = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model or model_bytes()))

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                rows = batch.slice(begin, 200)
                found = align_texts(_aligner(*shared.value), [x or "" for x in rows.column(1).to_pylist()])
                pairs = [d.pairs() for d in found]
                ends = pa.array(np.cumsum([0] + [len(k) for k, _ in pairs]).astype(np.int32))
                flat = [np.concatenate([p[i] for p in pairs]) for i in (0, 1)]
                counts = [pa.array([getattr(d, c) for d in found], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                sha = pa.array([d.digest.hexdigest() if d.n_a else "" for d in found])
                yield pa.record_batch([rows.column(0), *counts, sha, *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {COLUMNS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair linked, and whether no pair of the same id of A is held by more."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def count():
            keys, n = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(n, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

        for batch in batches:
            keys = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            held.append((keys, np.ones(len(keys), np.int64)))
            size += len(keys)
            if size > COUNT_PAIRS:
                found = count()
                held, size = ([found], len(found[0])) if len(found[0]) <= COUNT_PAIRS // 2 else ([], 0)
                if not held:
                    yield pa.record_batch([pa.array(x) for x in found], names=["pair", "n"])
        if held:
            yield pa.record_batch([pa.array(x) for x in count()], names=["pair", "n"])

    counts = table(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.shiftright("pair", 32).alias("a_")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.withColumn("a_", a).join(most, "a_").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def counted(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned (written, with `row` telling rows apart) with n_best and count_sum instead of pairs and times: how many links have a pair that is the best of its id of A, and the sum of the links' counts."""
    spark = aligned.sparkSession
    slices = max(1, -(-counts.count() // SLICE_PAIRS))
    kept = ["row", *[c for c in aligned.columns if c not in ("row", "pairs", "times")]]
    sums = None
    for k in range(slices):
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).toPandas().sort_values("pair")
        shared = spark.sparkContext.broadcast(tuple(own[c].to_numpy() for c in ("pair", "n", "best")))
        del own

        def run(batches, shared=shared):
            pair, n, best = shared.value
            for batch in batches:
                lists = batch.column(len(kept))
                keys, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column(len(kept) + 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.searchsorted(pair, keys)
                at[at == len(pair)] = 0
                hit = (pair[at] == keys) if len(pair) else np.zeros(len(keys), bool)
                ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
                total = lambda x, ends=ends: np.diff(np.append(0, np.cumsum(x))[ends])
                sums = [total(times * hit * (best[at] if len(pair) else 0)), total(times * hit * (n[at] if len(pair) else 0))]
                yield pa.record_batch([*batch.columns[: len(kept)], *[pa.array(s.astype(np.int64)) for s in sums]], names=[*kept, "n_best", "count_sum"])

        schema = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in kept)
        found = aligned.select(*kept, "pairs", "times").mapInArrow(run, f"{schema}, n_best long, count_sum long")
        sums = found if sums is None else sums.unionByName(found)
    if slices == 1:  # a row each already
        return sums.drop("row")
    firsts = [F.first(c).alias(c) for c in kept[1:]]
    return sums.groupBy("row").agg(*firsts, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all documents by the public 50k byte-level and 32k SentencePiece vocabularies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch(spark, "aligned")
    align(docs).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    aligned = spark.read.parquet(path)
    return counted(aligned, table(pair_counts(aligned), "counts"))
