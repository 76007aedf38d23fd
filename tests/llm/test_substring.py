import random

import pytest
from pyspark.sql import functions as F

from postmill.llm import common, substring
from postmill.llm.common import LAST_ID as substring_last


def brute(rows):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    key = lambda d: substring_last if d is None else d
    for d, w in split:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, key(d)), key(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < key(d):
                gone |= set(range(i, i + 50))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def rows(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    passage, common = text(70), text(50)
    out = []
    for i in range(60):
        w = text(rng.choice([0, 10, 49, 50, 51, 120, 400]))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 12) : 70 - rng.randint(0, 12)]
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = common
        out.append([i * 7 % 61, rng.choice([" ", "\n", "  \t"]).join(w)])
    for i in range(15):  # near copies, with words changed here and there
        w = out[i * 3][1].split()
        for _ in range(2):
            if w:
                w[rng.randrange(len(w))] = "edit"
        out.append([100 + i, " ".join(w)])
    out += [[200 + i, out[i][1]] for i in range(10)]
    out += [[300, None], [301, ""], [302, "same " * 300], [303, "same " * 120], [304, "a b " * 20000], [None, out[3][1]], [None, " ".join(passage)], [305, " ".join(passage)], [305, " ".join(passage)], [305, " ".join(common)]]
    return [tuple(x) for x in out]


@pytest.mark.parametrize("most", [500_000, 0])
def test_against_all_windows(spark, monkeypatch, most):
    monkeypatch.setattr(substring, "BROADCAST_ROWS", most)
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, doc string").repartition(3)
    assert sorted([tuple(r) for r in substring.remove_repeats(df).collect()], key=str) == brute(data)


def test_empty(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shuffles_end_with_the_table_they_made(spark):
    """Shuffle files of written tables lay on disk until the driver collected garbage: four times the input at once."""
    held = lambda: spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before, set_ = held(), spark.conf.get(common.FREE_SHUFFLES, None)
    assert common.table(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "sevenths").count() == 7
    assert spark.conf.get(common.FREE_SHUFFLES, None) == set_
    assert held() <= before + 1  # the count's own
