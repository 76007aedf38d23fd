import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import classifier

M, MIX = (1 << 64) - 1, [int(x) for x in classifier.MIX]


def run(values):
    h = values[0] * MIX[0] & M
    for k, v in enumerate(values[1:], 1):
        h = ((h ^ (h >> 29)) * MIX[k] + v) & M
    return h ^ (h >> 32)


def brute(text):
    """{bucket: value} of a text, word by word."""
    words = [w.decode("utf-8", "replace") for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    own = [xxhash.xxh64_intdigest(w.lower()) for w in words]
    forms, fours = [], set()
    for i, w in enumerate(words):
        bits = 2 * (i > 0 and own[i] == own[i - 1])
        if i >= 3:
            bits += tuple(own[i - 3 : i + 1]) in fours
            fours.add(tuple(own[i - 3 : i + 1]))
        forms.append((xxhash.xxh64_intdigest(classifier.form(w), 1) * MIX[3] + bits * MIX[4]) & M)
    found = Counter()
    for kind, (read, n) in enumerate([(own, 1), (own, 2), (forms, 1), (forms, 2), (forms, 3)]):
        for i in range(len(words) - n + 1):
            found[((run(read[i : i + n]) + kind) * MIX[2] & M) >> 46] += 1
    return {b: math.sqrt(c / found.total()) for b, c in found.items()}


TEXTS = ["", "a", " \n", "The the THE the The the THE the x", "é Ü ß| $$$ 12 a1", "one two three four " * 6, "x" * 50_000, "w1 w2\tw3\x0bw4\xa0w5 " * 900]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB c\n|é1$"), max_size=60), max_size=6))
def test_vectors(docs):
    for given in (docs, TEXTS):
        at, bucket, value = classifier.vectors([d.encode() for d in given])
        for i, d in enumerate(given):
            want, own = brute(d) if len(d) < 40_000 else None, at == i
            got = dict(zip(bucket[own].tolist(), value[own].tolist(), strict=True))
            assert want is None or (got.keys() == want.keys() and all(math.isclose(got[b], want[b]) for b in want))
            assert not len(value[own]) or math.isclose((value[own] ** 2).sum(), 1)


def ftrl(rows, passes):
    """The updates, a coordinate at a time."""
    z, n, c = Counter(), Counter(), classifier
    def weight(i):
        l1 = c.L1 if i < c.BUCKETS else 0
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((c.BETA + math.sqrt(n[i])) / c.ALPHA + c.L2)
    for _ in range(passes):
        for at, values, label in rows:
            own = {**dict(zip(at.tolist(), values.tolist(), strict=True)), c.BUCKETS: 1.0}
            w = {i: weight(i) for i in own}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in own.items())))
            for i, x in own.items():
                g = (p - label) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / c.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_training():
    rows = []
    for k, t in enumerate(["good text of words", "bad | bad | bad |", "other good words here", "| | bad", ""] * 3):
        _, at, values = classifier.vectors([t.encode()])
        rows.append((at, values, int("bad" not in t) if k != 4 else 0))
    w, bias = classifier.train(rows, 3)
    want = ftrl(rows, 3)
    assert math.isclose(bias, want[classifier.BUCKETS], rel_tol=1e-9)
    assert {i for i in np.flatnonzero(w)} == {i for i, x in want.items() if x and i < classifier.BUCKETS}
    assert all(math.isclose(w[i], x, rel_tol=1e-9, abs_tol=1e-12) for i, x in want.items() if i < classifier.BUCKETS)
    assert not classifier.train([])[0].any()


SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    out = {r.doc_id: r for r in classifier.op11_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for d, r in out.items())
    held = [(out[d].score, q, out[d].predicted) for d, q in labels.items() if d in out and out[d].held_out]
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    assert len(good) > 40 and len(bad) > 8
    assert sum(g > b for g in good for b in bad) / len(good) / len(bad) > 0.98
    assert sum(q == p for _, q, p in held) / len(held) > 0.95


def test_labels_of_held_out_rows_teach_nothing(spark):
    """Their labels turned round change no score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    (w, bias), (w2, bias2) = classifier.fit(docs, labels), classifier.fit(docs.repartition(3), turned)
    assert bias == bias2 and (w == w2).all() and w.any()


def test_odd_rows(spark):
    rows = [(1, "some good words", "x"), (None, "some good words", "y"), (2, None, "z"), (3, "", None), (1, "some good words", "x"), (4, "long words " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None), (77, 1)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    out = classifier.score(docs, model)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "score"] and len(got) == len(rows)
    scores = {(r.doc_id, r.text and r.text[:4]): r.score for r in got}
    assert scores[(1, "some")] == scores[(None, "some")] and scores[(2, None)] == scores[(3, "")] == 1 / (1 + math.exp(-model[1]))
    none = classifier.fit(docs, labels.limit(0))
    assert {r.score for r in classifier.score(docs, none).collect()} == {0.5}
    assert classifier.score(docs.limit(0), none).collect() == []
