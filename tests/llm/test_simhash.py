import random

import xxhash

from postmill.llm import simhash


def brute(rows):
    """Fingerprints bit by bit, groups by comparing all pairs."""
    fps = {}
    for doc, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def got(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    base = [" ".join(rng.choice("the of cat dog Ärger sat on mat ran far".split()) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = list(enumerate(base + [b + " end" for b in base[:20]] + base[:10] + ["", None, "one", "One", "two words", " \n\t", "x " * 20000, "İ ẞ"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as node")
    assert got(simhash.near_duplicates(df)) == brute(rows)


def test_sparse_and_dense_blocks_agree_with_all_pairs(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(60)} | {0, 3, 12, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i + 1, len(fps)):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in range(len(fps)) if find(i) != i}
    for dense in (2, 1000):
        edges = simhash.links(nodes, dense=dense)
        found = {r.node: r.component for r in simhash.components(edges).collect()}
        assert {k: v for k, v in found.items() if k != v} == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
