"""State from run to run: watch list, history and applications, each a table merged into its next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.urls import canonicalize_url
from .dedupe import failed, with_keys


def apply_watch(postings: DataFrame, state: DataFrame, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings with is_new, newly closed rows, next state).

    state: (key, url, title, first_seen, closed_since). A key that is absent, not failed in this run and not yet closed is closed today;
    a closed one that is back is open again. Only the first posting of an unseen key is new. State is joined once, by key: bucketed by it (`snapshots`), it isn't shuffled."""
    day = F.lit(today).cast("date")
    keyed = with_keys(postings).withColumn("key", F.concat_ws("|", "company_key", "title_key")).drop("company_key", "title_key")
    now = keyed.groupBy("key").agg(F.min(F.when(~failed(), F.col("seq"))).alias("first_seq"), F.min_by(F.struct("url", "title"), F.when(~failed(), F.col("seq"))).alias("now"), F.lit(True).alias("seen"))
    both = state.withColumn("known", F.lit(True)).join(now, "key", "full_outer")
    present = F.col("first_seq").isNotNull()
    closes = F.col("known") & F.col("seen").isNull() & F.col("closed_since").isNull()
    marked = both.where(F.col("known") | present).withColumn("closes", F.coalesce(closes, F.lit(False)))
    following = marked.select(
        "key", F.when(F.col("known"), F.col("url")).otherwise(F.col("now.url")).alias("url"), F.when(F.col("known"), F.col("title")).otherwise(F.col("now.title")).alias("title"),
        F.coalesce("first_seen", day).alias("first_seen"), F.when(present, F.lit(None).cast("date")).when(F.col("closes"), day).otherwise(F.col("closed_since")).alias("closed_since"), "closes",
    )
    fresh = both.where(F.col("known").isNull() & present).select(F.col("first_seq").alias("fresh_seq"))
    flagged = keyed.join(fresh, F.col("seq") == F.col("fresh_seq"), "left").withColumn("is_new", F.col("fresh_seq").isNotNull()).drop("fresh_seq")
    return flagged, following.where("closes").drop("closes"), following.drop("closes")


def merge_history(history: DataFrame, run: DataFrame, now: str) -> DataFrame:
    """Next snapshot of history (url, ..., first_seen, last_seen, scrape_count) after a run (url, rank, ...): the lowest row of a URL in rank order counts as its latest.

    A history bucketed by url (`snapshots`) isn't shuffled, and the result lies in its buckets."""
    values = [c for c in run.columns if c != "url"]
    stamp = F.lit(now).cast("timestamp")
    latest = run.groupBy("url").agg(F.max_by(F.struct(*values), "rank").alias("new"), F.count("*").alias("seen"))
    both = history.select("url", F.struct(*[c for c in history.columns if c != "url"]).alias("old")).join(latest, "url", "full_outer")
    pick = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return both.select(
        "url", *[pick(c) for c in values], F.coalesce("old.first_seen", stamp).alias("first_seen"), F.when(F.col("new").isNotNull(), stamp).otherwise(F.col("old.last_seen")).alias("last_seen"),
        (F.coalesce("old.scrape_count", F.lit(0)) + F.coalesce("seen", F.lit(0))).alias("scrape_count"),
    )


def fold_applications(events: DataFrame) -> DataFrame:
    """Applications by canonical URL from events (url, ts, ord, action, status, title, company, location, notes) in order of (ts, ord).

    mark and set_status set the status, the first date stays, fields fill in once, notes add up by line; delete forgets what was before. Raises for a status that is none, and
    for set_status on a URL that isn't there."""
    odd = events.where(F.col("action").isin("mark", "set_status") & ~F.coalesce(F.col("status").isin(fixed.STATUSES), F.lit(False)))
    events = events.withColumns({"key": canonicalize_url(F.col("url")), "at": F.struct("ts", "ord")})
    cuts = events.where("action = 'delete'").groupBy("key").agg(F.max("at").alias("cut"))
    live = events.where("action <> 'delete'").join(cuts, "key", "left").where("cut IS NULL OR at > cut")
    lost = live.groupBy("key").agg(F.min_by("action", "at").alias("first")).where("first = 'set_status'")
    for bad, what in ((odd, "an invalid status"), (lost, "set_status without an application")):
        if not bad.isEmpty():
            raise ValueError(f"events hold {what}")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    notes = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("notes", F.lit("")) != "", F.struct("at", "notes")))), lambda x: x["notes"])
    return live.groupBy(F.col("key").alias("url")).agg(
        *[first(c) for c in ("title", "company", "location")], F.max_by("status", "at").alias("status"), F.min("ts").alias("applied_date"), F.max("ts").alias("updated_at"), F.array_join(notes, "\n").alias("notes")
    )


def list_applications(applications: DataFrame, status: str | None = None) -> DataFrame:
    if status is not None and status not in fixed.STATUSES:
        raise ValueError(f"unknown status {status!r} (valid: {', '.join(fixed.STATUSES)})")
    found = applications.where(F.col("status") == status) if status else applications
    return found.orderBy(F.col("updated_at").desc(), "url")


def application_summary(applications: DataFrame) -> DataFrame:
    """(status, n) of all statuses, zero included."""
    spark = applications.sparkSession
    every = spark.createDataFrame([(k, s) for k, s in enumerate(fixed.STATUSES)], "at int, status string")
    return every.join(applications.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("at", "status", F.coalesce("n", F.lit(0)).alias("n"))


def backfill_from_history(applications: DataFrame, history: DataFrame) -> DataFrame:
    """applications with title, company and location from history where they are null."""
    fields = ["title", "company", "location"]
    old = history.groupBy(canonicalize_url(F.col("url")).alias("k_")).agg(*[F.min_by(c, "url").alias(f"{c}_") for c in fields])
    joined = applications.join(old, F.col("url") == F.col("k_"), "left")
    return joined.withColumns({c: F.coalesce(c, f"{c}_") for c in fields}).drop("k_", *[f"{c}_" for c in fields])


def annotate_application_status(postings: DataFrame, applications: DataFrame) -> DataFrame:
    """postings with application_status by canonical URL."""
    known = applications.select(F.col("url").alias("k2_"), F.col("status").alias("application_status"))
    return postings.withColumn("k_", canonicalize_url(F.col("url"))).join(known, F.col("k_") == F.col("k2_"), "left").drop("k_", "k2_")


def live_ranked_history(history: DataFrame) -> DataFrame:
    return history.where("live = 1").orderBy(F.col("score").desc_nulls_last(), "url")


__all__ = ["Window", "annotate_application_status", "application_summary", "apply_watch", "backfill_from_history", "fold_applications", "list_applications", "live_ranked_history", "merge_history"]
