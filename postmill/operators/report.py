"""Ranking, exports and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scoring
from ..functions.urls import board_name
from .dedupe import failed
from .tables import materialise


def _order() -> list[Column]:
    return [F.coalesce("score", F.lit(-1)).desc(), F.col("seq").asc()]


#: Stretches of seq that are counted for each score; with a hundred scores a million counts, 24 MB, at most.
STRETCHES = 10_000


def rank_postings(df: DataFrame) -> DataFrame:
    """df with rank from 1, laid out by rank: best score (of 0 to 100) first, unscored last, ties in input order, rows without seq last. Written as it is, its files follow each other by rank.

    Rows are counted by score and stretch of seq. The counts before a cell of both give its first rank and the task that takes it (cells are dealt out in order, so
    that tasks hold like numbers of rows), rows move to their task once, and a rank is the first of its task's plus the place in it: no task ranks all, nothing is sampled, no row
    moves again to be written in order. df is read three times (for the span of seq, the counts and the rows), so it should be a written table."""
    span = df.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n")).first()
    lo, tasks = span.lo or 0, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = ((span.hi or 0) - lo) // STRETCHES + 1
    keyed = df.withColumn("s_", F.coalesce("score", F.lit(-1))).withColumn("b_", F.coalesce(F.floor((F.col("seq") - lo) / F.lit(width)), F.lit(STRETCHES)))
    counts = keyed.groupBy("s_", "b_").agg(F.count("*").alias("n_"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = counts.groupBy("s_").agg(F.sum("n_").alias("t_")).select("s_", before("t_", Window.orderBy(F.col("s_").desc())).alias("above_"))
    cells = counts.withColumn("in_", before("n_", Window.partitionBy("s_").orderBy("b_"))).join(above, "s_").select("s_", "b_", (F.col("in_") + F.col("above_")).alias("off_"))
    cells = cells.withColumn("task_", F.floor(F.col("off_") * tasks / max(1, span.n)).cast("int"))
    cells = cells.withColumn("start_", F.min("off_").over(Window.partitionBy("task_"))).drop("off_")
    placed = keyed.join(F.broadcast(cells), ["s_", "b_"]).repartitionById(tasks, "task_").sortWithinPartitions(F.col("s_").desc(), F.col("seq").asc_nulls_last())
    # the place of a row in its partition: the lower 33 bits of this function
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return placed.withColumn("rank", F.col("start_") + place + 1).drop("s_", "b_", "task_", "start_")


def export_rows(df: DataFrame, profile: dict) -> DataFrame:
    """The 23 export columns of enriched postings, best first, blank where unknown."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    joined = lambda c, by: F.coalesce(F.array_join(c, by), F.lit(""))
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("")
    repost = [F.col(c) for c in ("repost_of", "repost_of_closed") if c in df.columns]
    tracker = F.col("tracker_status") if "tracker_status" in df.columns else F.lit(None).cast("string")
    lines = scoring.fit_summary(F.col("match"), F.col("experience_years_mentioned"), F.col("signals"), F.col("age_days"), tracker, profile)
    values = {
        "score": text("score"), "live": F.when(F.col("is_live"), "yes").when(~F.col("is_live"), "no").otherwise("unknown"), "age_days": text("age_days"), "title": text("title"), "company": text("company"),
        "location": text("location"), "type": text("employment_type"), "job_type": text("job_type"), "seniority": text("seniority"), "exp_years": joined(F.transform("experience_years_mentioned", lambda y: y.cast("string")), ","),
        "salary": joined(F.col("salary_hits"), "; "), "matched_skills": joined(F.col("match.matched_skills"), "; "), "skill_gaps": joined(F.col("match.skill_gaps"), "; "), "fit_summary": F.array_join(lines, "; "),
        "benefits": joined(F.transform("benefits", lambda s: F.coalesce(s["heading"], F.lit(""))), "; "), "sponsorship": yes(F.col("signals.sponsorship_mentioned")), "german_required": yes(F.col("signals.german_required")),
        "work_mode": joined(F.col("signals.work_mode"), ","), "tracker": text("tracker_status"), "applied": text("application_status"), "repost": F.coalesce(*repost, F.lit("")), "search_role": text("search_role"), "url": text("url"),
    }
    made = materialise(df.select(*[values[c].alias(f"{c}_") for c in fixed.EXPORT_COLUMNS], "score", "seq"), "export")
    return rank_postings(made).select(*[F.col(f"{c}_").alias(c) for c in fixed.EXPORT_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_jsonl(ranked: DataFrame, path: str) -> None:
    """One record a line, in the order of `rank_postings`, unknown fields as null."""
    ranked.write.option("ignoreNullFields", False).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """All records, unordered, unknown fields as null."""
    df.write.option("ignoreNullFields", False).json(path)


def digest_top_n(df: DataFrame, top: int = 10, only_new: bool = False) -> DataFrame:
    """(place, seq, line) of the best postings, of new ones alone if asked."""
    pool = df.where("is_new") if only_new else df
    best = pool.orderBy(*_order()).limit(top)
    known = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    line = F.concat_ws(" - ", F.coalesce(known("title"), F.lit("?")), known("company"), known("location"), F.when(F.col("score").isNotNull(), F.concat(F.lit("score "), F.col("score").cast("string"))))
    return best.select(F.row_number().over(Window.orderBy(*_order())).alias("place"), "seq", F.concat(line, F.when(F.coalesce("is_new", F.lit(False)), " [NEW]").otherwise("")).alias("line"))


def top10(df: DataFrame) -> DataFrame:
    """The scored ones of the ten best rows."""
    return df.orderBy(*_order()).limit(10).where("score IS NOT NULL")


def source_stats(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Per board: attempts (url, duration_ms) against results (url, error); errors counts messages cut to 120 characters."""
    tried = attempts.groupBy(board_name(F.col("url")).alias("source")).agg(F.count("*").alias("attempted"), F.sum("duration_ms").alias("duration_ms"))
    named = results.withColumn("source", board_name(F.col("url"))).withColumn("message", F.when(failed(), F.substring("error", 1, 120)))
    counted = named.groupBy("source", "message").agg(F.count("*").alias("n"))
    done = counted.groupBy("source").agg(
        F.sum(F.when(F.col("message").isNull(), F.col("n")).otherwise(0)).alias("ok"), F.sum(F.when(F.col("message").isNotNull(), F.col("n")).otherwise(0)).alias("errored"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("message", "n"))))).alias("errors"),
    )
    both = tried.join(done, "source", "full_outer").na.fill(0, ["attempted", "duration_ms", "ok", "errored"])
    status = F.when((F.col("errored") > 0) & (F.col("ok") == 0), "failed").when(F.col("errored") > 0, "partial").when(F.col("ok") == 0, "empty").otherwise("ok")
    return both.withColumn("filtered", F.greatest(F.lit(0), F.col("attempted") - F.col("ok") - F.col("errored"))).withColumn("status", status)


def top_errors_per_source(stats: DataFrame, top: int = 2) -> DataFrame:
    """(source, place, message, n): the most frequent errors of sources that failed, whole or in part."""
    flat = stats.where(F.col("status").isin("failed", "partial")).select("source", F.explode("errors").alias("message", "n"))
    return flat.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "message"))).where(F.col("place") <= top)


def run_counters(before: DataFrame, after: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """One row of counts of a run: postings before and after filters; of those after them failed, scored, merged (winners of fuzzy groups), reposts and new ones; and newly closed keys of the watch list."""
    given = lambda c, found: found if c in after.columns else F.lit(False)
    repost = given("repost_of", F.col("repost_of").isNotNull()) | given("repost_of_closed", F.col("repost_of_closed").isNotNull())
    flags = {"errored": failed(), "scored": F.col("score").isNotNull(), "merged": given("merged_urls", F.size("merged_urls") > 0), "reposts": repost, "new": given("is_new", F.coalesce("is_new", F.lit(False)))}
    counts = after.agg(F.lit(0).cast("long").alias("before"), F.count("*").alias("after"), *[F.count_if(c).alias(n) for n, c in flags.items()], F.lit(0).cast("long").alias("closed"))
    parts = [before.agg(F.count("*").alias("before")), counts] + ([closed.agg(F.count("*").alias("closed"))] if closed is not None else [])
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return every.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts.columns])


def score_band(df: DataFrame) -> DataFrame:
    return df.withColumns({"band": scoring.score_band(F.col("score")), "sheet_band": scoring.score_band(F.col("score"), 75, 50)})
