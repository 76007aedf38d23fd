import random

import corpus_pipeline
import numpy as np
from postmill.llm import common, similar


def sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Rows that stay, by comparing all pairs of rows with an id."""
    known = [r for r in rows if r[0] is not None]
    root, of = list(range(len(known))), [sets(t) for _, t in known]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(known)):
        for j in range(i):
            if 5 * len(of[i] & of[j]) >= 4 * len(of[i] | of[j]):
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(known):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [r for r in rows if r[0] is None] + [r for k, r in enumerate(known) if least[find(k)] == r[0]]


def data():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [[word() for _ in range(rng.randint(3, 120))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:40]:  # one to four changed words: similarities on both sides of 0.8
        for n in (1, 2, 3, 4):
            w = list(b)
            for at in rng.sample(range(len(w)), min(n, len(w))):
                w[at] = word()
            texts.append(" ".join(w))
    for _ in range(70):  # a large group of near copies, and a line common to unlike texts
        w = list(base[50])
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
        texts.append("this line is in a great many texts of the table " + " ".join(word() for _ in range(rng.randint(0, 30))))
    texts += ["", None, "One two", "one TWO", " \n", "a " * 300]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_against_all_pairs(spark):
    rows = data()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, d string")
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id, str(r.text)) for r in out.collect()) == sorted((d, str(t)) for d, t in brute(rows))


def test_rounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(similar, "AT_ONCE", 0)
    rows = data()
    want = {d for d, _ in rows} - {d for d, _ in brute(rows)}
    for rounds in (0, 1):
        assert {r.doc_id for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), rounds).collect()} == want


def test_blocks_and_sketches_of_similar_sets():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 77, 200, 513, 1000]:
        for frequent in (0, n // 3, n):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for _ in range(8):  # at the very bound: x gone, y new, with n - x >= 0.8 (n + y)
                x = int(rng.integers(0, n // 5 + 1))
                y = int(rng.integers(0, max(0, (5 * (n - x)) // 4 - n) + 1))
                b = np.union1d(rng.permutation(a)[x:], rng.integers(0, 1 << 63, y).astype(np.uint64))
                both = len(np.intersect1d(a, b))
                if 5 * both < 4 * (len(a) + len(b) - both):
                    continue
                known = np.sort(rng.permutation(a)[:frequent])
                assert len(np.intersect1d(similar.blocks(a, known), similar.blocks(b, known)))
                p, q = sorted((np.frombuffer(similar.sketch(v), np.uint64) for v in (a, b)), key=len)
                while len(q) > len(p):
                    q = q[: len(q) // 2] ^ q[len(q) // 2 :]
                assert np.bitwise_count(p ^ q).sum() <= len(a) + len(b) - 2 * both


def test_null_and_repeated_ids(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(None, long), (None, long + " end"), (None, None), (7, long + " other"), (7, "wholly different words stand here instead"), (9, long), (9, None), (9, "")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    got = sorted((str(r.doc_id), str(r.text)) for r in out)
    assert [g for g in got if g[0] != "9"] == sorted((str(d), str(t)) for d, t in rows if d != 9)
    assert len([g for g in got if g[0] == "9"]) == 1 and all(t in ("", "None") for d, t in got if d == "9")


def spied(monkeypatch, name):
    """Rows of the tables that end in this name, as they are written."""
    seen, own = [], similar.table

    def table(df, path):
        out = own(df, path)
        if path.endswith(name):
            seen.extend(out.collect())
        return out

    monkeypatch.setattr(similar, "table", table)
    return seen


def test_simhash_links_what_its_fingerprints_find(spark, monkeypatch):
    rng = random.Random(8)
    words = [[f"w{rng.randrange(3000)}" for _ in range(600)] for _ in range(20)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:300], "other", *w[301:]]) for w in words]
    fps, of = [similar.simhash.fingerprint(t.encode()) for t in texts], [sets(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2 and 5 * len(of[i] & of[j]) >= 4 * len(of[i] | of[j])}
    linked = spied(monkeypatch, "/simhash")
    gone = similar.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert want and {(r.a, r.b) for r in linked} == want
    assert {r.doc_id for r in gone} == set(range(20, 40))


def test_a_common_passage_makes_no_square_of_pairs(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(14)) for _ in range(300)]
    compared = spied(monkeypatch, "/candidates")
    assert similar.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0).collect() == []
    assert len(compared) < len(texts)


def test_components_of_few_edges_take_few_tasks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc = spark.sparkContext
    try:
        sc.setJobGroup("components", "")
        parts = common.components(edges)
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert {tuple(r) for r in parts.collect()} == {(i, 0) for i in range(13)}
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        # 3,404 tasks with edges in checkpoints and unions
        assert sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks) < 3000
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_links_of_connected_rows_are_stars(spark):
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join([*(f"x{k}" for k in range(at)), *words[at:]]) for at in range(0, 24, 3)]  # each like the next one, the ends unlike
    docs = similar._with_digest(spark.createDataFrame(list(enumerate(chain + chain[:3])), "doc_id long, text string"))
    with common.freed_shuffles(spark):
        edges = common.table(similar.links(docs, similar._keyed(docs, "stars"), "stars"), "stars/edges")
    assert edges.count() == 10 and common._are_stars(edges)
