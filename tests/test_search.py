import random

from pyspark.sql import functions as F

from postmill.operators import cards, filters, search, tables


def brute(lines, keys):
    return {k for k in keys if k and any(line and k in line for line in lines)}


def run(spark, lines, keys):
    out = search.held(spark.createDataFrame([(x,) for x in lines], "line string").repartition(3), spark.createDataFrame([(k,) for k in keys], "k string"))
    rows = [r.k for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_every_key_in_every_line(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abé\n🙂/", k=n))
    lines = [text(rng.choice([0, 3, 9, 511, 512, 513, 1500])) for _ in range(40)] + [None, "", "abcdefg", "abcdefgh"]
    keys = {text(rng.randint(1, 12)) for _ in range(150)} | {x[s : s + rng.choice([1, 7, 8, 9, 600])] for x in lines if x for s in (0, len(x) // 2)} | {"abcdefg", "bcdefgh", "h", "zzzzzzzzz", "abcdefghi"} - {""}
    keys |= {k[:-1] + "x" for k in keys if len(k) > 500}
    got = run(spark, lines, keys)
    assert got == brute(lines, keys) and len(got) > 20
    assert run(spark, [], keys) == set() and run(spark, lines, []) == set()


def test_long_lines_and_long_keys(spark):
    """A line of a megabyte, keys of 2,000 characters, and a key that repeats all along a line."""
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefgh/.?=&0123456789", k=1_000_000))
    long = ["https://a.com/" + line[s : s + 1986] for s in (0, 500_123, 998_014)]
    given = line[:400_000] + long[0] + line[400_000:] + long[2]
    keys = [*long, line[77:2077], line[777_000:779_000], long[0][:-1] + "~", "~" + line[100:2099], "x.com/" * 50, "/x.com/x.com"]
    assert run(spark, [given, "x.com/" * 30_000], keys) == brute([given, "x.com/" * 30_000], keys)


def test_tracker_with_a_long_url(spark):
    url = "https://a.com/" + "p" * 1_986
    df = spark.createDataFrame([(0, url), (1, url + "q"), (2, "https://b.com/1")], "seq long, url string")
    lines = spark.createDataFrame([("x" * 600_000 + url + "/apply " + "y" * 400_000,)], "line string")
    assert {r.seq: r.tracker_status for r in filters.check_tracker(df, lines).collect()} == {0: "applied", 1: None, 2: None}


def test_roles_equal_all_comparisons(spark):
    rng = random.Random(8)
    words = ["data", "engineer", "ai", "c", "go", "ml ops", "sécurité", "soc", "analyst", "python", "SIEM", "c++", "ata", "gin"]
    rows = [(i, " ".join(rng.sample(words, 3)), rng.choice(["Acme", None, "Ärzte GmbH"]), f"u{i}" if i % 9 else None, rng.choice([None, [], ["aws", "Go"]])) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, title string, company string, url string, tags array<string>").repartition(3)
    given = [(i, f"r{i}", " ".join(rng.choices([w[:k] for w in words for k in (1, 2, 3, 5, 9)], k=rng.randint(1, 3)))) for i in range(90)]
    given += [(90, "blank", " \t"), (91, "empty", ""), (92, "twice", "data DATA data"), (93, "none", "zzz data"), (94, "nbsp", "data engineer")]
    roles = spark.createDataFrame(given, "role_seq int, role string, keywords string")
    every = df.select("seq", "url", cards.haystack().alias("hay")).where("url IS NOT NULL").collect()
    want = set()
    for k, role, keys in given:
        hits = [(k, role, r.url, r.seq) for r in sorted(every, key=lambda r: r.seq) if all(w in r.hay for w in keys.lower().split())]
        want |= set(hits[:7])
    got = [tuple(r) for r in cards.role_hits(df, roles, 7).select("role_seq", "role", "url", "seq").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert cards.role_hits(df.limit(0), roles).collect() == [] and cards.role_hits(df, roles.limit(0)).collect() == []


def test_a_registry_of_any_length(spark):
    """Thirty thousand roles meet their cards without a comparison of all."""
    df = spark.range(3_000).select(F.col("id").alias("seq"), F.concat(F.lit("Job "), F.sha2(F.col("id").cast("string"), 256)).alias("title"), F.lit("A").alias("company"), F.concat(F.lit("u"), "id").alias("url"), F.array().cast("array<string>").alias("tags"))
    roles = spark.range(30_000).select(F.col("id").cast("int").alias("role_seq"), F.lit("r").alias("role"), F.concat(F.lit("job "), F.substring(F.sha2(F.col("id").cast("string"), 256), 5, 20)).alias("keywords"))
    got = cards.role_hits(df, roles).collect()
    assert len(got) == 3_000 and all(r.role_seq == r.seq for r in got)


def test_plans_have_no_nested_loops(spark, capsys):
    df = spark.range(50).select(F.col("id").alias("seq"), F.lit("Data engineer").alias("title"), F.lit("A").alias("company"), F.lit("u").alias("url"), F.array().cast("array<string>").alias("tags"))
    roles = spark.createDataFrame([(0, "Data", "data")], "role_seq int, role string, keywords string")
    cards.role_hits(df, roles).explain()
    search.held(df.select(F.col("title").alias("line")), df.select(F.col("company").alias("k"))).explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastNestedLoopJoin") <= 1 and "CartesianProduct" not in plan  # the one row of first cards for roles without keywords


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_places_are_not_broadcast(spark):
    """Small files hold many places: a 1 GB table ended the driver, as Spark took the places of its keys for a small table."""
    lines, keys = (spark.createDataFrame([(f"see https://jobs.example/{n} today",) for n in range(20)], "line string"), spark.createDataFrame([(f"https://jobs.example/{n}",) for n in range(5)], "k string"))
    found = search.held(lines, keys)
    assert "Broadcast" not in _plan(found)
    assert {r.k for r in found.collect()} == {f"https://jobs.example/{n}" for n in range(5)}


def test_roles_are_broadcast_behind_a_count_only(spark, monkeypatch):
    rows = [(n, f"https://jobs.example/{n}", f"Data Engineer {n}", "Acme", ["x"]) for n in range(30)]
    shown = spark.createDataFrame(rows, "seq long, url string, title string, company string, tags array<string>")
    roles = spark.createDataFrame([(0, "Data", "data engineer"), (1, "Nobody", "zzz")], "role_seq int, role string, keywords string")
    plain = sorted(map(tuple, cards.role_hits(shown, roles, 3).collect()))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 1)
    hits = cards.role_hits(shown, roles, 3)
    assert "BroadcastHashJoin" not in _plan(hits)
    assert sorted(map(tuple, hits.collect())) == plain == [(0, "Data", f"https://jobs.example/{n}", n) for n in range(3)]
