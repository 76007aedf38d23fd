import itertools
import random

import pytest
from pyspark.sql import functions as F

from postmill.functions import scoring
from postmill.operators import cards, dedupe, filters, report, state, titles

ROW = "seq long, url string, company string, title string, location string, score int, error string"


def posts(spark, rows):
    full = [(i, f"u{i}", *r) if len(r) == 5 else r for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ROW).repartition(3)


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_dedupe_keeps_best_then_earliest(spark):
    df = posts(spark, [("Acme, Inc.", "Senior Engineer", None, 50, None), ("acme inc", "Engineer II", None, 60, None), ("ACME INC", "engineer", None, 60, None), ("Acme inc", "Engineer", None, None, "HTTP 404"), ("", "Engineer", None, 1, None), (None, "Engineer", None, 2, None), ("日本", "Engineer", None, 2, None), ("Acme inc", "Other", None, None, None)])
    assert seqs(dedupe.dedupe_results(df)) == [1, 3, 4, 5, 6, 7]
    assert seqs(dedupe.dedupe_results(df.limit(0))) == []


def brute_fuzzy(rows, threshold):
    import re

    def norm(x, title=False):
        x = re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", (x or "").lower())).strip()
        return re.sub(" +", " ", re.sub(r"\b(senior|sr|junior|jr|lead|staff|principal|i{1,3}|iv)\b", " ", x)).strip() if title else x

    keys = [None if r[4] else (norm(r[0]), norm(r[1], True)) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if keys[i] and keys[j] and all(keys[i]) and all(keys[j]) and keys[i][0] == keys[j][0] and titles.title_similarity(keys[i][1], keys[j][1]) >= threshold:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    kept = {}
    for i, k in enumerate(keys):
        group = find(i) if k and all(k) else ("own", i)
        best = kept.get(group)
        if best is None or (rows[i][3] if rows[i][3] is not None else -1) > (rows[best][3] if rows[best][3] is not None else -1):
            kept[group] = i
    return sorted(kept.values())


def test_fuzzy_against_all_pairs(spark):
    rng = random.Random(4)
    words = ["splunk", "engineer", "night", "nights", "shift", "frontend", "backend", "software", "engineering", "manager", "analyst"]
    rows = [(rng.choice(["Acme", "Globex"]), " ".join(rng.sample(words, rng.randint(1, 4))), None, rng.choice([None, 10, 20]), rng.choice([None] * 9 + ["boom"])) for _ in range(70)]
    rows += [("Acme", "Splunk Engineer (Nights)", None, 5, None), ("Acme", "Splunk Engineer - Night Shift", None, 7, None), (None, "x", None, 1, None)]
    got = dedupe.fuzzy_dedupe(posts(spark, rows))
    assert seqs(got) == brute_fuzzy(rows, 0.85)
    with pytest.raises(ValueError):
        dedupe.fuzzy_dedupe(posts(spark, rows), 1.5)


def test_similarity_values():
    assert titles.title_similarity("Software Engineer", "Engineer") == 1.0 and titles.title_similarity("", "x") == 0.0
    assert titles.title_similarity("Frontend Engineer", "Backend Engineer") < 0.85 <= titles.title_similarity("Splunk Engineer (Nights)", "Splunk Engineer - Night Shift")


def test_reposts(spark):
    body = [("H", "one two three four five six seven eight nine ten eleven")]
    rows = [(0, "a", "Acme", "Engineer", None, 1, None, body), (1, "b", "acme", "Senior Engineer", None, 1, None, body), (2, "a", "Acme", "Engineer", None, 1, None, body), (3, "c", "Acme", "Engineer", None, 1, "err", body), (4, "d", "Acme", "Engineer", None, 1, None, [("H", "too short")]), (5, "e", None, "Engineer", None, 1, None, body)]
    df = spark.createDataFrame(rows, f"{ROW}, sections array<struct<heading:string,text:string>>")
    marked = {r.seq: r.repost_of for r in dedupe.mark_reposts(df).collect()}
    assert marked == {0: None, 1: "a", 2: None, 3: None, 4: None, 5: None}
    closed = df.where("seq = 1").withColumn("fingerprint", dedupe.content_fingerprint(df))
    old = {r.seq: r.repost_of_closed for r in dedupe.flag_historical_reposts(df, closed).collect()}
    assert old[0] == "b" and old[1] is None and old[4] is None


def test_filters(spark):
    money = [("r", "USD", 90000, 120000)]
    rows = [(0, "u", "Acme", "Engineer", "Berlin", 50, None, money, 10, "senior", "contract"), (1, "u", None, "Analyst", None, None, None, [], None, "unknown", "unknown"), (2, "u", "Bad Corp", "Intern", "Paris", 9, "HTTP 500", None, 99, None, None), (3, "u", "Bad Corp", "Engineer", "Paris", 70, None, [("r", "EUR", 10, 20)], 31, "mid", "full-time")]
    df = spark.createDataFrame(rows, f"{ROW}, salary_normalized array<struct<raw:string,currency:string,min_annual:bigint,max_annual:bigint>>, age_days int, seniority string, job_type string")
    keep = lambda **k: seqs(df.where(filters.posting_filter(**k)))
    assert keep() == [0, 1, 2, 3] and keep(location="berlin") == [0, 2] and keep(keywords="engineer, x") == [0, 2, 3] and keep(exclude_companies="bad") == [0, 1, 2]
    assert keep(seniority="senior,unknown") == [0, 1, 2] and keep(job_type="contract") == [0, 2] and keep(max_age=10) == [0, 1, 2] and keep(max_age=31) == [0, 1, 2, 3]
    assert keep(salary_min="100k USD") == [0, 1, 2] and keep(salary_max="100k USD") == [0, 1, 2] and keep(salary_min="130000") == [1, 2] and keep(salary_max="15") == [1, 2, 3]
    assert seqs(df.where(filters.min_score(60))) == [2, 3]
    for bad in ({"seniority": "boss"}, {"job_type": "x"}, {"max_age": -1}, {"salary_min": "abc"}):
        with pytest.raises(ValueError):
            filters.posting_filter(**bad)


@pytest.mark.parametrize(("spec", "want"), [("80K USD", (80000, "USD")), ("$120k", (120000, "USD")), ("25 LPA", (2500000, "INR")), ("1.5M INR", (1500000, "INR")), ("75,000", (75000, None)), ("€ 60k", (60000, "EUR"))])
def test_thresholds(spec, want):
    assert filters.parse_salary_threshold(spec) == want


@pytest.mark.parametrize("spec", ["", "abc", "$100 EUR", "80k XYZ", "0"])
def test_bad_thresholds(spec):
    with pytest.raises(ValueError):
        filters.parse_salary_threshold(spec)


def test_watch_over_runs(spark):
    empty = spark.createDataFrame([], "key string, url string, title string, first_seen date, closed_since date")
    run = lambda *rows: posts(spark, [(c, t, None, 1, e) for c, t, e in rows])
    flagged, closed, kept = state.apply_watch(run(("A", "x", None), ("A", "x", None), ("B", "y", None), (None, None, None)), empty, "2024-01-01")
    assert [r.is_new for r in flagged.orderBy("seq").collect()] == [True, False, True, True] and closed.count() == 0 and {r.key for r in kept.collect()} == {"a|x", "b|y", "|"}
    flagged, closed, kept2 = state.apply_watch(run(("A", "x", "failed"), ("C", "z", None)), kept, "2024-01-02")
    assert {r.key for r in closed.collect()} == {"b|y", "|"} and [r.seq for r in flagged.where("is_new").collect()] == [1]
    _, closed, kept3 = state.apply_watch(run(("B", "y", None), ("A", "x", None)), kept2, "2024-01-03")
    rows = {r.key: r for r in kept3.collect()}
    assert {r.key for r in closed.collect()} == {"c|z"} and rows["b|y"].closed_since is None and str(rows["b|y"].first_seen) == "2024-01-01" and str(rows["|"].closed_since) == "2024-01-02"


def test_history(spark):
    none = spark.createDataFrame([], "url string, rank long, score int, first_seen timestamp, last_seen timestamp, scrape_count long")
    run = spark.createDataFrame([("a", 1, 50), ("a", 3, 40), ("b", 2, 45)], "url string, rank long, score int")
    first = state.merge_history(none, run, "2024-01-01 00:00:00")
    second = {r.url: r for r in state.merge_history(first, run.where("url = 'a' AND rank = 1"), "2024-01-02 00:00:00").collect()}
    assert second["a"].scrape_count == 3 and second["a"].score == 50 and str(second["a"].first_seen) == "2024-01-01 00:00:00" and second["b"].scrape_count == 1 and str(second["b"].last_seen)[:10] == "2024-01-01"


def test_applications(spark):
    ev = "url string, ts timestamp, ord long, action string, status string, title string, company string, location string, notes string"
    t = lambda h: f"2024-01-01 0{h}:00:00"
    rows = [("http://a/?ref=1", t(1), 1, "mark", "applied", None, "Acme", None, "n1"), ("http://a", t(2), 2, "set_status", "offer", "T", "Other", None, "n2"), ("http://b", t(1), 3, "mark", "applied", None, None, None, None), ("http://b", t(2), 4, "delete", None, None, None, None, None)]
    df = spark.createDataFrame([(r[0], *r[1:]) for r in rows], ev.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    (a,) = state.fold_applications(df).collect()
    assert (a.url, a.status, a.title, a.company, a.notes, str(a.applied_date), str(a.updated_at)) == ("http://a/", "offer", "T", "Acme", "n1\nn2", "2024-01-01 01:00:00", "2024-01-01 02:00:00")
    assert [r.n for r in state.application_summary(state.fold_applications(df)).orderBy("at").collect()] == [0, 0, 1, 0, 0]
    for action, status in (("mark", "nope"), ("set_status", "offer")):
        bad = df.limit(0).unionByName(spark.createDataFrame([("http://c", None, 9, action, status)], "url string, ts string, ord long, action string, status string").withColumn("ts", F.current_timestamp()), allowMissingColumns=True)
        with pytest.raises(ValueError):
            state.fold_applications(bad)


def test_rank_and_digest(spark):
    rng = random.Random(1)
    rows = [("A", f"t{i}", None, rng.choice([None, 10, 50, 50, 90]), None) for i in range(200)]
    got = report.rank_postings(posts(spark, rows)).orderBy("rank").collect()
    want = sorted(range(200), key=lambda i: (-(rows[i][3] if rows[i][3] is not None else -1), i))
    assert [r.seq for r in got] == want and [r["rank"] for r in got] == list(range(1, 201))
    wide = posts(spark, [(i * 70000, f"u{i}", "A", "t", None, rng.choice([1, 2]), None) for i in range(50)])
    assert [r["rank"] for r in report.rank_postings(wide).orderBy(F.col("score").desc(), "seq").collect()] == list(range(1, 51))
    best = report.digest_top_n(posts(spark, rows).withColumn("is_new", F.col("seq") == 3), 2, only_new=True).collect()
    assert len(best) == 1 and best[0].line.endswith("[NEW]")


def test_stats(spark):
    tried = spark.createDataFrame([("https://jobs.lever.co/1", 5.0), ("https://jobs.lever.co/2", 5.0), ("https://x.com", 1.0), ("https://a.breezy.hr/1", 1.0)], "url string, duration_ms double")
    done = spark.createDataFrame([("https://jobs.lever.co/1", "x" * 200), ("https://x.com", None), ("https://x.com/2", "")], "url string, error string")
    got = {r.source: r for r in report.source_stats(tried, done).collect()}
    assert (got["lever"].status, got["lever"].filtered, got["lever"].errors) == ("failed", 1, {"x" * 120: 1}) and got["generic"].status == "ok" and got["breezy"].status == "empty"


def test_cards(spark):
    rows = [(0, "s", "1", "Data Engineer", "A", "u0", ["aws"]), (1, "s", "1", "Other", "A", "u1", []), (2, "t", "1", "data engineer", "a", "u0", None), (3, "t", "9", "SOC Analyst", "B", "u0?utm_x=1", ["siem"])]
    df = spark.createDataFrame(rows, "seq long, source string, job_id string, title string, company string, url string, tags array<string>")
    assert seqs(cards.dedupe_cards(df)) == [0, 3] and seqs(cards.dedupe_cards(df, 1)) == [0] and seqs(cards.dedupe_by_job_id(df)) == [0, 3]
    assert seqs(df.where(cards.match_keywords("DATA aws", cards.haystack()))) == [0] and seqs(df.where(cards.match_keywords(" ", cards.haystack()))) == [0, 1, 2, 3]
    roles = spark.createDataFrame([(0, "c", "Data", "data"), (1, "c", "Soc", "soc"), (2, "d", "All", "a")], "role_seq int, category string, role string, keywords string")
    first, added = cards.role_sweep(df, roles)
    assert {r.canonical_url: r.role for r in first.collect()} == {"u0": "Data", "u1": "All", "u0?utm_x=1": "Soc"} and {r.role: r.added for r in added.collect()} == {"Data": 1, "Soc": 1, "All": 1}
    assert cards.roles_for(roles, " C ").count() == 2
    with pytest.raises(ValueError):
        cards.roles_for(roles, "zz")
    with pytest.raises(ValueError):
        cards.facet_filter(df, "nowhere")
    assert {r.problem for r in cards.registry_problems(roles.unionByName(roles.limit(1)).unionByName(spark.createDataFrame([(9, "", "x", "y")], roles.schema))).collect()} == {"twice", "blank"}


def test_tracker(spark):
    df = posts(spark, [("A", "x", None, 1, None)] * 3).withColumn("url", F.element_at(F.array(F.lit("https://a.com/Jobs/1?utm_source=x"), F.lit("https://a.com/jobs/2"), F.lit("https://b.com/3")), (F.col("seq") + 1).cast("int")))
    lines = spark.createDataFrame([("sent to <https://A.com/jobs/1>",), ("also https://a.com/jobs/22",)], "line string")
    assert {r.seq: r.tracker_status for r in filters.check_tracker(df, lines).collect()} == {0: "applied", 1: "applied", 2: None}


def test_tracker_of_any_size_is_searched_whole(spark):
    held = ["https://a.com/j/1", "https://a.com/j/2", "https://b.com/x", "http://c.com/é/7", "not-a-url", "https://in.com/z"]
    other = ["https://a.com/j/9", "https://nowhere.com/1", "", None, "a key with no scheme"]
    df = spark.createDataFrame(list(enumerate(held + other)), "seq long, url string")
    text = ["https://a.com/j/1,https://a.com/j/2/apply|https://B.com/X.", "see http://c.com/é/78 \U0001f600not-a-url!", "https://r.com/?to=https://in.com/zz", None, "https://a.com/j", "x" * 1_200_000]
    got = {r.seq: r.tracker_status for r in filters.check_tracker(df, spark.createDataFrame([(t,) for t in text], "line string")).collect()}
    assert got == {i: "applied" if i < len(held) else None for i in range(len(held + other))}
    assert filters.check_tracker(df, spark.createDataFrame([], "line string")).where("tracker_status is not null").isEmpty()
    assert filters.check_tracker(df.limit(0), spark.createDataFrame([("https://a.com",)], "line string")).isEmpty()


def test_whole_flow_over_two_runs(spark):
    from postmill.plans import adapters, pipeline

    raw = adapters.postings(spark, "/root/testdata/sf0.001")
    watch = spark.createDataFrame([], "key string, url string, title string, first_seen date, closed_since date")
    history = spark.createDataFrame([], "url string, rank long, seq long, score int, title string, live int, fingerprint string, first_seen timestamp, last_seen timestamp, scrape_count long")
    go = lambda rows, watch, history, day, **more: pipeline.run_flow(rows, scoring.PROFILE, adapters.as_of(), fuzzy=True, reposts=True, least_score=30, watch=watch, history=history, today=day, attempts=rows.select("url", F.lit(2.0).alias("duration_ms")), **more)
    tracker = raw.where("seq = 7").select(F.concat(F.lit("sent "), "url").alias("line"))
    first = go(raw, watch, history, "2024-06-01", tracker=tracker, exclude_keywords="intern")
    rows, counts = first.postings.collect(), first.counters.first()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
    assert counts.after == len(rows) < counts.before and counts.errored == sum(bool(r.error) for r in rows) and counts.scored == sum(r.score is not None for r in rows)
    assert counts.merged == sum(bool(r.merged_urls) for r in rows) > 0 and counts.new == sum(r.is_new for r in rows) > 0 and counts.closed == 0 and counts.reposts == 0
    assert {r.seq for r in rows if r.tracker_status} <= {7} and sum(r.attempted for r in first.sources.collect()) == raw.count()
    # half of the postings are gone the next time, and history knows those that were closed
    old = first.history.withColumn("live", F.lit(0)).withColumn("url", F.concat(F.lit("https://old.com/"), "seq"))
    second = go(raw.where("seq % 2 = 0"), first.watch, old, "2024-06-15", exclude_keywords="intern")
    rows, counts = second.postings.collect(), second.counters.first()
    assert counts.closed == second.closed.count() > 0 and counts.reposts == sum(bool(r.repost_of_closed) for r in rows) > 0
    assert second.history.count() == old.count() + len({r.url for r in rows})
