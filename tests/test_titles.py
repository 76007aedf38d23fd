import random
import string
import time

import pytest
from pyspark.sql import functions as F

from postmill.operators import dedupe, links, titles

WORDS = "splunk engineer night nights shift frontend backend software engineering manager analyst data platform security cloud it qa a 3d c".split()


def spoiled(rng, word):
    """The word with a letter left out, put in or changed now and then."""
    k = rng.randrange(len(word))
    return rng.choice([word] * 4 + [word[:k] + word[k + 1 :], word[:k] + rng.choice("xyz ") + word[k:], word[:k] + "q" + word[k + 1 :]])


def rows(rng, n):
    found = []
    for i in range(n):
        words = [spoiled(rng, w) for w in rng.sample(WORDS, rng.randint(1, 6))]
        found.append((i, rng.choice(["acme", "globex"]), " ".join(" ".join(words).split())))
    return found


def brute(given, threshold):
    """Ordered pairs (company, a, b) of distinct titles where some a stands before some b."""
    lo, hi = {}, {}
    for seq, c, t in given:
        lo.setdefault((c, t), seq)
        hi[c, t] = seq
    return {(c, a, b) for c, a in lo for d, b in lo if c == d and a != b and lo[c, a] < hi[d, b] and titles.title_similarity(a, b) >= threshold}


def frame(spark, given):
    return spark.createDataFrame(given, "seq long, company_key string, title_key string").repartition(3)


@pytest.mark.parametrize("threshold", [0.85, 0.6, 0.95, 1.0])
def test_join_equals_all_pairs(spark, threshold):
    rng = random.Random(int(100 * threshold))
    given = rows(rng, 160)
    base = " ".join(rng.sample([w + x for w in WORDS for x in "abcdefgh"], 26))
    long = [base, base + " extra", base.replace("engineer", "enginer"), " ".join(base.split()[:20]), "a", "b", "aa", "ab", "x y", "x z", "!", ""]
    given += [(len(given) + i, "acme", t) for i, t in enumerate(long)] + [(300, *given[0][1:]), (301, *given[5][1:])]
    got = [tuple(r) for r in dedupe.title_pairs(frame(spark, given), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(given, threshold)


def test_threshold_of_nothing(spark):
    """Any two titles reach 0; one link each keeps a company together."""
    given = [(0, "a", "x"), (1, "a", "y"), (2, "a", ""), (3, "b", "z")]
    assert {tuple(r) for r in dedupe.title_pairs(frame(spark, given), 0.0).collect()} == {("a", "x", "y"), ("a", "x", "")}
    assert dedupe.title_pairs(frame(spark, given).limit(0)).collect() == []


def test_one_company_of_ten_thousand_titles(spark):
    """Random titles of one employer: no stage of all 50 million pairs."""
    rng = random.Random(7)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(600)]
    common = ["engineer", "manager", "analyst", "specialist"]
    given = [(i, "acme", f"{' '.join(rng.sample(words, 2))} {rng.choice(common)} {rng.randrange(10**5)}") for i in range(9_900)]
    given += [(10_000 + i, "acme", given[i * 7][2].replace("a", "e", 1)) for i in range(100)]
    began = time.time()
    got = {tuple(r)[1:] for r in dedupe.title_pairs(frame(spark, given)).collect()}
    assert time.time() - began < 240
    near = {(given[i * 7][2], given[9_900 + i][2]) for i in range(100)}
    assert {p for p in near if p[0] != p[1] and titles.title_similarity(*p) >= 0.85} <= got
    for a, b in rng.sample(sorted(got), min(200, len(got))):
        assert titles.title_similarity(a, b) >= 0.85


def test_closure_of_a_long_chain(spark):
    """A chain of 100,000 nodes, in an order that says nothing, falls together in logarithmic rounds."""
    n = 100_000
    name = lambda c: (c * 7_919) % n
    chain = spark.range(n - 1).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
    rounds = links.contract(chain)
    sizes = [r.count() for r in rounds]
    assert len(rounds) <= 20 and all(b < 0.6 * a for a, b in zip(sizes, sizes[1:], strict=False) if a > 100)
    found = links.components(chain)
    assert found.count() == n and found.select("component").distinct().collect() == [(0,)]


def test_closure_of_small_ones(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (5, 5), (8, 9), (20, 10), (30, 10), (40, 30)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in links.components(df).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (10, 10), (20, 10), (30, 10), (40, 10)}
    assert links.components(df.limit(0)).collect() == [] and links.components(df.where("a = b")).collect() == []
