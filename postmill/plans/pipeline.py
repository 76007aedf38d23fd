"""The whole flow over raw postings as one job: dedupe, enrich, score, link, filter, watch and rank, in that order; then state, statistics and counters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe, enrich, filters, report, state
from ..operators.cards import tag_search_role
from ..operators.tables import materialise

BODIES = ["full_text", "text1", "text2", "sections", "requirements", "responsibilities", "nice_to_have", "other_possibly_relevant"]
#: What history keeps of a posting.
RECORD = ["url", "rank", "seq", "score", "title", "live", "fingerprint"]


class Run(NamedTuple):
    """What one run gives. closed and watch (the next watch state) are None without a watch state, history (the next snapshot) without a history, sources without attempts."""

    postings: DataFrame
    counters: DataFrame
    closed: DataFrame | None
    watch: DataFrame | None
    history: DataFrame | None
    sources: DataFrame | None


def enriched_once(postings: DataFrame, profile: dict | None, as_of: Column, fingerprints: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Enriched postings, written without bodies, as the steps of a flow read them several times; with their fingerprint if wanted. columns: those that are wanted, if not all; what only others need isn't computed."""
    full = enrich.enrich_postings(postings, profile, as_of)
    if fingerprints:
        full = full.withColumn("fingerprint", dedupe.content_fingerprint(full))
    return materialise(full.select(*columns) if columns else full.drop(*BODIES), "enriched")


def run_flow(
    postings: DataFrame, profile: dict | None, as_of: Column, *, exact: bool = True, fuzzy: bool = False, least_score: int | None = None, reposts: bool = False, tracker: DataFrame | None = None, watch: DataFrame | None = None, today: str | None = None,
    history: DataFrame | None = None, applications: DataFrame | None = None, url_roles: DataFrame | None = None, attempts: DataFrame | None = None, enriched: bool = False, **given,
) -> Run:
    """given: filters of `posting_filter`. exact: without it, in-run reposts of one title remain to be marked. watch: (key, url, title, first_seen, closed_since); history: RECORD with first_seen, last_seen, scrape_count,
    read for postings of old closed ones before this run is merged in; attempts: (url, duration_ms). today is needed with watch and history. enriched: postings come from `enriched_once`."""
    first = dedupe.input_dedupe(postings).drop("canonical_url")
    every = materialise(first, "first") if enriched else enriched_once(first, profile, as_of, reposts or history is not None)
    rows = dedupe.dedupe_results(every).drop("company_key", "title_key") if exact else every
    if fuzzy:
        rows = dedupe.fuzzy_dedupe(rows).drop("company_key", "title_key")
    before = rows
    rows = rows.where(filters.posting_filter(**given))
    if least_score is not None:
        rows = rows.where(filters.min_score(least_score))
    if reposts:
        rows = dedupe.mark_reposts(rows)
    if tracker is not None:
        rows = filters.check_tracker(rows, tracker)
    closed = following = None
    if watch is not None:
        rows, closed, following = state.apply_watch(rows, watch, today)
        rows = rows.drop("key")
    if history is not None:
        rows = dedupe.flag_historical_reposts(rows, history.where("live = 0").select("fingerprint", "url", "seq"))
    if applications is not None:
        rows = state.annotate_application_status(rows, applications)
    if url_roles is not None:
        rows = tag_search_role(rows, url_roles)
    unranked = materialise(rows if watch is not None else rows.withColumn("is_new", F.lit(None).cast("boolean")), "unranked")
    ranked = materialise(report.rank_postings(unranked), "ranked")
    return Run(
        ranked, report.run_counters(before, ranked, closed), closed, following,
        None if history is None else state.merge_history(history, ranked.withColumn("live", F.col("is_live").cast("int")).select(*RECORD), today),
        None if attempts is None else report.source_stats(attempts, every.select("url", "error")),
    )


def run_pipeline(postings: DataFrame, profile: dict | None, as_of: Column, **given) -> DataFrame:
    """The ranked postings of `run_flow`."""
    return run_flow(postings, profile, as_of, **given).postings
