"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates, scored as sparse dot products.

A text's words `[^\\x20\\x09-\\x0D]+` are read twice: as written (in lower case) and as a form, made of the letter case, the length and the marks around the letters, and
of whether the word repeats the one before it or ends four words that stood in the text before. Single words and pairs of the first reading and runs of one to three of the second are hashed into BUCKETS buckets; a text is the
vector of the square roots of their shares, which has length 1 whatever the text's length. Its score is the logistic function of its dot product with the weights and a bias.

Training: up to FIT_ROWS labelled rows (those with the least hash of their id; a documented bound) are turned into sparse vectors by Spark, and one task goes over them PASSES times, as each update
needs the one before. Only non-zero weights, at most one for each bucket, reach the driver. Scoring runs over all rows; weights are broadcast, BUCKETS doubles at most.

Nulls: a null text is an empty one and scores by the bias alone. Labels that are null or of null ids teach nothing; a document with several labels counts once, as good if one says so, and of rows that share an id the least
text teaches. Without labels every score is 0.5. Very long texts are read whole, with about 150 bytes of memory for each word. Other columns are no input; rows, null ids and repeated ones stay.
"""

from __future__ import annotations

import array
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts

BUCKETS = 1 << 18
#: Labelled rows that training uses at most, how often it goes over them, and bytes of text that a task works on at once (a longer text is alone).
FIT_ROWS, PASSES, SLICE_BYTES = 10_000, 8, 1 << 21
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
PREDICT_FROM, FOLDS = 0.3, 5
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Odd multipliers that mix hashes: kinds of n-grams and places within them.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
SPARSE = "buckets array<int>, sums array<float>"


def form(word: str) -> str:
    """Case, length class and surrounding marks of a word."""
    case = "l" if word.islower() else "u" if word.isupper() else "c" if word.lower() != word.upper() else "-"
    marks = "a" if word.isalpha() else re.sub(r"\w+", "a", word)[:8]
    return f"{case}{min(len(word), 12) // 3}{marks}"


#: word -> its place in HASHES (two numbers each: of the word, of its form). Emptied when it holds TABLE_WORDS; that changes no result.
TABLE: dict[bytes, int] = {}
HASHES = array.array("Q")
TABLE_WORDS = 300_000


def _words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash of the word, hash of its form) of all words in order."""
    if len(TABLE) > TABLE_WORDS:
        TABLE.clear()
        del HASHES[:]
    found = [WORD.findall(d) for d in docs]
    before = len(TABLE)
    at = np.array([TABLE.setdefault(w, len(TABLE)) for ws in found for w in ws], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(ws) for ws in found])
    for w in itertools.islice(TABLE, before, None):
        word = w.decode("utf-8", "replace")
        HASHES.append(xxhash.xxh64_intdigest(word.lower()))
        HASHES.append(xxhash.xxh64_intdigest(form(word), 1))
    hashes = np.frombuffer(HASHES, np.uint64).reshape(-1, 2)[at] if len(at) else np.zeros((0, 2), np.uint64)
    return doc, hashes[:, 0], hashes[:, 1]


def _run(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values that begin at each place (but the last n - 1)."""
    out = hashes[: max(0, len(hashes) - n + 1)] * MIX[0]
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * MIX[k] + hashes[k : len(hashes) - n + 1 + k]
    return out ^ (out >> np.uint64(32))


def vectors(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of all texts' non-zero entries, by document and bucket."""
    doc, own, forms = _words(docs)
    n = len(doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    same = lambda k: doc[k:] == doc[: n - k]
    after = np.zeros(n, bool)
    after[1:] = (own[1:] == own[:-1]) & same(1)
    again = np.zeros(n, bool)
    if n > 3:
        fours = _run(own, 4) * MIX[1] + doc[: n - 3].astype(np.uint64) * MIX[5]
        first = np.unique(fours, return_index=True)[1]
        repeat = np.ones(n - 3, bool)
        repeat[first] = False
        again[3:] = repeat & same(3)
    forms = forms * MIX[3] + (after.astype(np.uint64) * np.uint64(2) + again.astype(np.uint64)) * MIX[4]
    keys = []
    for kind, (read, length) in enumerate([(own, 1), (own, 2), (forms, 1), (forms, 2), (forms, 3)]):
        if n >= length:
            hashes = (_run(read, length) + np.uint64(kind)) * MIX[2]
            inside = same(length - 1)
            keys.append(doc[: n - length + 1][inside] * BUCKETS + (hashes >> np.uint64(46)).astype(np.int64)[inside])
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    at = found // BUCKETS
    total = np.bincount(at, counts, len(docs))
    return at, found % BUCKETS, np.sqrt(counts / total[at])


def sliced(docs: list[bytes]):
    """Slices of docs of at most SLICE_BYTES, or of one document."""
    begin, size = 0, 0
    for k, d in enumerate(docs):
        if k > begin and size + len(d) > SLICE_BYTES:
            yield docs[begin:k]
            begin, size = k, 0
        size += len(d)
    if begin < len(docs):
        yield docs[begin:]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """(weights, bias) after FTRL-Proximal updates in order of rows (buckets, values, label). The bias is the last coordinate, without L1."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    l1 = np.full(BUCKETS + 1, L1)
    l1[-1] = 0.0

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= l1[at], 0.0, -(own - np.sign(own) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rows = [(np.append(at, BUCKETS), np.append(values, 1.0), label) for at, values, label in rows]
    for _ in range(passes):
        for at, values, label in rows:
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-w @ values)) - label) * values
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: the checksum of the id is divisible by FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """(weights, bias) from the labels (doc_id, label 0 or 1) of rows of docs (doc_id, text) that aren't held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = table(known.orderBy(*order).limit(most), "labelled")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    examples = docs.join(F.broadcast(chosen), docs.doc_id == F.col("id")).groupBy("id", "label").agg(F.min(text).alias("text"))

    def features(batches):
        for batch in batches:
            id_, label_, text_ = batch.columns
            begin = 0
            for part in sliced(list(texts(text_))):
                at, bucket, value = vectors(part)
                ends = np.searchsorted(at, np.arange(len(part) + 1)).astype(np.int32)
                lists = lambda x, ends=ends: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
                yield pa.record_batch([id_.slice(begin, len(part)), label_.slice(begin, len(part)), lists(bucket.astype(np.int32)), lists(value.astype(np.float32))], names=["id", "label", "buckets", "sums"])
                begin += len(part)

    rows = table(examples.mapInArrow(features, f"id long, label int, {SPARSE}"), "examples")

    def learn(batches):
        given = []
        for batch in batches:
            for label_, bucket, value in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                given.append((bucket.values.to_numpy(), value.values.to_numpy().astype(np.float64), label_))
        w, bias = train(given)
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(np.append(at, BUCKETS).astype(np.int32)), pa.array(np.append(w[at], bias))], names=["bucket", "weight"])

    found = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(learn, "bucket int, weight double").toPandas()
    weights = np.zeros(BUCKETS + 1)
    weights[found["bucket"].to_numpy()] = found["weight"].to_numpy()
    return weights[:-1], float(weights[-1])


def score_texts(docs: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores from 0 to 1."""
    out = [np.zeros(0)]
    for part in sliced(docs):
        at, bucket, value = vectors(part)
        out.append(np.bincount(at, weights[bucket] * value, len(part)))
    return 1.0 / (1.0 + np.exp(-(np.concatenate(out) + bias)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs with `score` (replaced if it exists) of its column text."""
    kept = [c for c in docs.columns if c != "score"]
    shared, at = docs.sparkSession.sparkContext.broadcast(model), kept.index("text")

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                yield pa.record_batch([*rows.columns, pa.array(score_texts(list(texts(rows.column(at))), *shared.value))], names=[*kept, "score"])

    schema = T.StructType([f for f in docs.schema if f.name != "score"]).add("score", T.DoubleType())
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def op11_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by what the labels of four fifths of them teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= PREDICT_FROM, 1).otherwise(0).alias("predicted"))
