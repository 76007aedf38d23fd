import json
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postmill.operators import report, state
from postmill.operators.snapshots import Snapshots
from postmill.operators.tables import materialise

HISTORY = "url string, rank long, score int, first_seen timestamp, last_seen timestamp, scrape_count long"


def first_plan(df) -> str:
    """The plan as made before any stage has run."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def exchanges(df) -> tuple[int, int]:
    """Shuffles in the plan, and those of them over the scan of a bucketed table."""
    lines = first_plan(df).splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    shuffles = [k for k, line in enumerate(lines) if " Exchange " in line]
    over = 0
    for k in shuffles:
        below = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
        over += any("Bucketed: true" in line for line in lines[k:below])
    assert any("Bucketed: true" in line for line in lines)
    return len(shuffles), over


def day_run(spark, day: int):
    rng = random.Random(day)
    rows = [(f"u{rng.randrange(400)}", k, rng.randrange(100)) for k in range(300)]
    return spark.createDataFrame(rows, "url string, rank long, score int")


@pytest.fixture
def folder():
    return f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"


def test_history_over_runs_is_that_of_plain_tables(spark, folder):
    runs, plain = Snapshots(spark, "history_runs", "url", 8, folder), spark.createDataFrame([], HISTORY)
    assert runs.before("2024-01-01") is None
    for day in range(1, 5):
        run, stamp = day_run(spark, day), f"2024-01-0{day} 00:00:00"
        old = runs.before(stamp[:10])
        plain = materialise(state.merge_history(plain, run, stamp))
        if old is None:
            kept = runs.start(stamp[:10], state.merge_history(spark.createDataFrame([], HISTORY), run, stamp))
        else:
            kept = runs.write(stamp[:10], state.merge_history(old, run, stamp))
        assert kept.exceptAll(plain).isEmpty() and plain.exceptAll(kept).isEmpty()
    # a repeated run starts from the one before it
    again = runs.write("2024-01-04", state.merge_history(runs.before("2024-01-04"), day_run(spark, 4), "2024-01-04 00:00:00"))
    assert again.exceptAll(plain).isEmpty() and plain.exceptAll(again).isEmpty()
    # a bucket is a file
    assert len(list(Path(folder[7:]).glob("history_runs__2024_01_04/*.parquet"))) <= 8
    runs.forget(keep=1)
    assert runs.runs() == ["history_runs__2024_01_04"] and [p.name for p in Path(folder[7:]).iterdir()] == ["history_runs__2024_01_04"]


@pytest.mark.parametrize(("buckets", "shuffles"), [(4, 1), (8, 2)])
def test_only_the_run_is_shuffled(spark, folder, buckets, shuffles):
    """A run is grouped in the session's four partitions, and its groups are dealt to buckets where these are more."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        history = Snapshots(spark, f"history_plan_{buckets}", "url", buckets, folder).start("1", state.merge_history(spark.createDataFrame([], HISTORY), day_run(spark, 1), "2024-01-01 00:00:00"))
        merged = state.merge_history(history, day_run(spark, 2), "2024-01-02 00:00:00")
        assert exchanges(merged) == (shuffles, 0)
        old = spark.createDataFrame([(f"c{k}|t", "u", "t") for k in range(50)], "key string, url string, title string").withColumns({"first_seen": F.to_date(F.lit("2024-01-01")), "closed_since": F.lit(None).cast("date")})
        watch = Snapshots(spark, f"watch_plan_{buckets}", "key", buckets, folder).start("1", old)
        postings = spark.createDataFrame([(k, f"u{k}", f"c{k % 70}", "t", None) for k in range(200)], "seq long, url string, company string, title string, error string")
        _, closed, following = state.apply_watch(postings, watch, "2024-01-02")
        assert exchanges(following) == (shuffles, 0) and exchanges(closed) == (shuffles, 0)
        assert following.count() == 70 and closed.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["", "History", "a-b", "a b"])
def test_bad_names(spark, name):
    with pytest.raises(ValueError):
        Snapshots(spark, name, "url")


def test_bad_runs(spark):
    with pytest.raises(ValueError):
        Snapshots(spark, "history_bad", "url").before("1; DROP")
    with pytest.raises(ValueError):
        Snapshots(spark, "history_bad", "url").forget(keep=0)


def ranked_rows(spark, rows):
    return materialise(spark.createDataFrame(rows, "seq long, score int, title string"))


@pytest.mark.parametrize("hot", [False, True])
def test_ranks_and_files_follow_each_other(spark, folder, hot):
    rng = random.Random(3)
    rows = [(s, 50 if hot and rng.random() < 0.9 else rng.choice([None, *range(101)]), f"t{s}") for s in rng.sample(range(-1000, 10**12), 3000)]
    ranked = report.rank_postings(ranked_rows(spark, rows))
    # the rows move once; the other shuffles are of counts
    plan = first_plan(ranked)
    assert "rangepartitioning" not in plan and plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan
    report.write_jsonl(ranked.select("rank", "seq", "score"), f"{folder}/out")
    lines = [json.loads(line) for part in sorted(Path(folder[7:], "out").glob("part-*")) for line in part.read_text().splitlines()]
    want = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1), r[0]))
    assert [(x["rank"], x["seq"], x["score"]) for x in lines] == [(k + 1, r[0], r[1]) for k, r in enumerate(want)]


def test_ranks_of_odd_tables(spark):
    assert report.rank_postings(ranked_rows(spark, [])).count() == 0
    one = report.rank_postings(ranked_rows(spark, [(None, 5, "a"), (7, 5, "b"), (9, None, "c")])).orderBy("rank").collect()
    assert [(r["rank"], r.title) for r in one] == [(1, "b"), (2, "a"), (3, "c")]
