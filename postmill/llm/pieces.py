"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary holds a white-space marker behind another character, merges never cross the front
of a marked word, so a text splits into chunks (markers and the word behind them) that are segmented independently. A task
keeps a table chunk -> (ids, decoded text) and segments each distinct chunk once; a text's ids are the table's entries
joined by position. Line feeds that no piece holds begin chunks too. The table belongs to a task: joining it across the cluster would
shuffle every word with its position, several times the input, to save a segmentation of microseconds per distinct word.

The table is emptied when it reaches TABLE_ROWS chunks (checked every 50 texts), which bounds memory and changes no result. Long chunks are not kept.
Nulls: a null text counts as empty (begin and end ids only); null and repeated doc_ids stay rows. Extra columns are dropped by
the query and kept by `encode`.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch

MARK = "▁"
TABLE_ROWS, LONG_CHUNK = 300_000, 200


def model_bytes(path: str | None = None) -> bytes:
    """The model file, half a megabyte, read on the driver; by default the public 32k BPE vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class ChunkTable:
    """Segments distinct chunks with the library; whole texts where the vocabulary lets pieces cross markers."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        # exact only if normalisation leaves characters alone and puts one marker in front
        probe = " a  ﬁÅ b "
        self.exact = not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain) and self.sp.decode(self.sp.encode(probe)) == probe and MARK in pieces and self.sp.encode("a") == [pieces.index(MARK + "a")]
        self.ends = [self.sp.bos_id()], [self.sp.eos_id()]
        self.mark = pieces.index(MARK) if MARK in pieces else -1
        self.lead = pieces.index("a") if "a" in pieces else -1
        self.exact = self.exact and self.lead >= 0
        self.split = re.compile(f"{MARK}+[^{MARK}\n]*|\n+[^{MARK}\n]*").findall
        self.table: dict[str, tuple[bytes, str]] = {}

    def _segment(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers, and the text they decode to, of each chunk."""
        marked = [c[0] == MARK for c in chunks]
        # the library puts the first marker in front itself
        ids = self.sp.encode([c[1:].replace(MARK, " ") if m else c for c, m in zip(chunks, marked, strict=True)], num_threads=1)
        ids = [([self.mark] if c == MARK else x) if m else x[1:] for c, x, m in zip(chunks, ids, marked, strict=True)]
        decoded = self.sp.decode([[self.lead, *x] for x in ids], num_threads=1)
        return [(_pack(x), t[1:]) for x, t in zip(ids, decoded, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids with begin and end, decoded text) of each text."""
        (bos,), (eos,) = self.ends
        if not self.exact:
            ids = self.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            return [(_pack(x), t) for x, t in zip(ids, self.sp.decode(ids, num_threads=1), strict=True)]
        head, tail, table, out = _pack([bos]), _pack([eos]), self.table, []
        for at in range(0, len(texts), 50):
            split = [self.split(MARK + text.replace(" ", MARK)) if text else [] for text in texts[at : at + 50]]
            new = list({c for chunks in split for c in chunks if c not in table})
            extra = {}
            for c, x in zip(new, self._segment(new), strict=True):
                (table if len(c) <= LONG_CHUNK else extra)[c] = x
            for chunks in split:
                found = [table[c] for c in chunks] if not extra else [extra[c] if c in extra else table[c] for c in chunks]
                out.append((b"".join([head, *[x[0] for x in found], tail]), "".join([x[1] for x in found])[1:]))
            if len(table) > TABLE_ROWS:
                table.clear()
        return out


def _pack(ids: list[int]) -> bytes:
    import array
    import sys

    found = array.array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


@lru_cache(maxsize=2)
def _table(model: bytes) -> ChunkTable:
    return ChunkTable(model)


def encode(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """docs with `piece_ids` (array of int, begin and end ids included) and `piece_text` (decoded) for its column text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or model_bytes())
    schema = T.StructType([f for f in docs.schema if f.name not in ("piece_ids", "piece_text")])
    kept = [f.name for f in schema]
    schema = schema.add("piece_ids", T.ArrayType(T.IntegerType(), False)).add("piece_text", T.StringType())

    def run(batch):
        import numpy as np

        found = _table(shared.value).encode([x or "" for x in batch.column(kept.index("text")).to_pylist()])
        sizes = np.cumsum([0] + [len(x[0]) // 4 for x in found]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(x[0] for x in found), "<u4").astype(np.int32)))
        return pa.record_batch([*batch.columns, ids, pa.array([x[1] for x in found], pa.string())], names=[*kept, "piece_ids", "piece_text"])

    return by_batch(docs.select(*[F.col(f"`{c}`") for c in kept]), run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of the whole table: number of ids, digest of the ids and digest of the decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs)

    def run(batch):
        doc, _, ids, text = batch.columns
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_pylist()
        n = [b - a for a, b in zip(at, at[1:], strict=False)]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.record_batch([doc, pa.array(n, pa.int64()), pa.array([sha(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]), pa.array([sha(x.encode()) for x in text.to_pylist()])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batch(encoded, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
