"""Exact and fuzzy duplicates, content fingerprints and reposts. `seq` is the input order; every "first" goes by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.urls import canonicalize_url
from .links import components
from .titles import alike, distinct_titles


def failed() -> Column:
    return F.coalesce("error", F.lit("")) != ""


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("at_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("at_ = 1").drop("at_")


def input_dedupe(df: DataFrame) -> DataFrame:
    """First spelling of each canonical URL, in column canonical_url. Map-side combined: a hot URL costs one row a task."""
    keyed = df.withColumn("canonical_url", canonicalize_url(F.col("url")))
    return keyed.groupBy("canonical_url").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), "seq").alias("r")).select("r.*", "canonical_url")


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"company_key": text.normalize_company(F.col("company")), "title_key": text.normalize_title(F.col("title"))})


def dedupe_results(df: DataFrame) -> DataFrame:
    """Best score of each (company, title), the earliest among equals; failed postings and those without a key all stay.

    Only (key, score, seq) is shuffled for the choice, combined within tasks; rows without a key never meet in one place."""
    keyed = with_keys(df)
    eligible = ~failed() & (F.col("company_key") != "") & (F.col("title_key") != "")
    best = keyed.where(eligible).groupBy("company_key", "title_key").agg(F.max_by("seq", F.struct(F.coalesce("score", F.lit(-1)), -F.col("seq"))).alias("best_seq"))
    kept = keyed.where(eligible).join(best.select("best_seq"), F.col("seq") == F.col("best_seq"), "left_semi")
    return kept.unionByName(keyed.where(~eligible))


def content_fingerprint(df: DataFrame) -> Column:
    """SHA-256 of company, title, place and distinct body tokens; null where there is too little to tell."""
    parts = ["sections", "requirements", "responsibilities", "nice_to_have", "other_possibly_relevant"]
    texts = F.concat(*[F.transform(F.col(p), lambda s: F.coalesce(s["text"], F.lit(""))) for p in parts if p in df.columns])
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.array_join(texts, " ")), F.lit("[a-z0-9]+"), F.lit(0))))
    company, title, place = text.normalize_company(F.col("company")), text.normalize_title(F.col("title")), text.normalize_company(F.col("location"))
    digest = text.let(tokens, lambda t: F.when(F.size(t) >= fixed.MIN_BODY_TOKENS, F.sha2(F.concat_ws("|", company, title, place, F.sha2(F.array_join(t, " "), 256)), 256)))
    return F.when((company != "") & (title != "") & ~failed(), digest)


def mark_reposts(df: DataFrame) -> DataFrame:
    """df with fingerprint and repost_of: the URL of the first posting with this content, where it is another one."""
    keyed = df if "fingerprint" in df.columns else df.withColumn("fingerprint", content_fingerprint(df))
    firsts = keyed.where("fingerprint IS NOT NULL").groupBy(F.col("fingerprint").alias("f")).agg(F.min_by("url", "seq").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(firsts, F.col("fingerprint") == F.col("f"), "left").withColumn("repost_of", F.when(F.col("first_url") != F.col("url"), F.col("first_url"))).drop("f", "first_url", "n")


def flag_historical_reposts(df: DataFrame, closed: DataFrame) -> DataFrame:
    """df with repost_of_closed: the URL under which closed (fingerprint, url, seq) had the same content first."""
    keyed = df if "fingerprint" in df.columns else df.withColumn("fingerprint", content_fingerprint(df))
    old = closed.where("fingerprint IS NOT NULL").groupBy(F.col("fingerprint").alias("f")).agg(F.min_by("url", "seq").alias("old_url"))
    return keyed.join(old, F.col("fingerprint") == F.col("f"), "left").withColumn("repost_of_closed", F.when(F.col("old_url") != F.col("url"), F.col("old_url"))).drop("f", "old_url")


# fuzzy titles


def title_pairs(df: DataFrame, threshold: float = fixed.FUZZY_THRESHOLD) -> DataFrame:
    """(company_key, a, b): pairs of distinct titles of a company that are alike; in either order of appearance if both occur. Rows fall together to distinct titles first."""
    return alike(distinct_titles(df), threshold).select("company_key", "a", "b")


def fuzzy_dedupe(df: DataFrame, threshold: float = fixed.FUZZY_THRESHOLD) -> DataFrame:
    """df without near duplicates of one company: each group of alike titles keeps its best score (earliest among equals), with merged_urls in input order.

    Failed postings and those without a key stay as they are."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be between 0 and 1, got {threshold}")
    keyed = with_keys(df)
    eligible = ~failed() & (F.col("company_key") != "") & (F.col("title_key") != "")
    rows = keyed.where(eligible)
    titles = distinct_titles(rows.select("company_key", "title_key", "seq"))
    linked = components(alike(titles, threshold).select(F.col("a_lo").alias("a"), F.col("b_lo").alias("b")))
    groups = titles.join(linked, F.col("lo") == F.col("node")).select("company_key", "title_key", "component")
    # keys hold no #, so a component's name is no title
    named = rows.join(groups, ["company_key", "title_key"], "left").withColumn("title_group", F.coalesce(F.concat(F.lit("#"), "component"), "title_key")).drop("component")
    members = named.groupBy("company_key", "title_group").agg(F.max_by("seq", F.struct(F.coalesce("score", F.lit(-1)), -F.col("seq"))).alias("best"), F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("all"))
    merged = members.select("best", F.transform(F.filter("all", lambda m: m["seq"] != F.col("best")), lambda m: m["url"]).alias("merged_urls"))
    kept = named.join(merged, F.col("seq") == F.col("best")).drop("best", "title_group")
    return kept.unionByName(keyed.where(~eligible).withColumn("merged_urls", F.array().cast("array<string>")).select(kept.columns))
