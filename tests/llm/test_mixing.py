import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postmill.llm import mixing


def want_targets(sizes):
    """Reshare the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def rows(seed=1, n=1500):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "", "z", "hot"]
    return [(i, " ".join("w" * rng.randint(1, 400)) if rng.random() > 0.02 else None, rng.choice([*names, "hot", "hot"])) for i in range(n)]


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, source string, size string")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {d: len((t or "").split()) for d, t, _ in data}
    sizes = defaultdict(int)
    for d, _, s in data:
        sizes[s] += size[d]
    goal = want_targets(sizes)
    assert len(got) == len(data)
    taken, shards = Counter(), Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and (r.size == 0 or len(r.draws) * r.size == r.taken)
        taken[r.source] += r.taken
        shards.update(x.shard for x in r.draws)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.01 * sizes[s] + 1
    assert set(shards) == set(range(16)) and max(shards.values()) < 2 * min(shards.values())


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = {"a": 200, "b": 31, None: 7, "c": 0, "d": 1}
    df = spark.createDataFrame(list(quotas.items()), "source string, n int")
    total, left = sum(quotas.values()), Counter()
    for seed in range(8):
        got = mixing.splitting_tree(df, 2, str(seed)).collect()
        by = Counter()
        for r in got:
            by[r.source] += r.n
            left[r.source] += r.n * (r.shard == 0)
        assert {k: v for k, v in by.items() if v} == {k: v for k, v in quotas.items() if v}
        assert sum(r.n for r in got if r.shard == 0) == total // 2
    assert abs(left["a"] / 8 - 100) < 8 and abs(left["b"] / 8 - 15.5) < 4


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "a b", "s"), (None, "a b", "s"), (3, "w " * 50000, "s"), (4, " ", "t")], schema)
    got = mixing.mix(odd).collect()
    assert len(got) == 6 and all(r.taken <= 2 * r.size for r in got)
    docs = spark.createDataFrame(rows(2, 200), schema)
    out = mixing.mixed_rows(docs)
    counts = {r.doc_id: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert out.columns == docs.columns and counts == {r.doc_id: len(r.draws) for r in mixing.mix(docs).collect() if r.draws}


def test_mixed_rows_with_null_and_repeated_ids(spark):
    data = [(None if i % 7 == 0 else i // 2, f"{' '.join('w' * (1 + i % 9))} t{i}", "ab"[i % 2] if i % 5 else None, i) for i in range(300)]
    data += [(5, "same row", "a", 1000)] * 3 + [(6, None, "b", 1001), (6, "", "b", 1002)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n long")
    want = Counter()
    for r in mixing.mix(df, row=mixing._row_key()).collect():
        want[bytes(r.row)] += len(r.draws)
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    assert Counter(bytes(r.row) for r in out.select(mixing._row_key().alias("row")).collect()) == +want
    assert len(want) == len({(d, t, s) for d, t, s, _ in data}) and max(Counter(r.n for r in out.where("n <> 1000").collect()).values()) <= 3
