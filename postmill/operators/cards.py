"""Search cards: keyword match, duplicates, role sweeps and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonicalize_url
from .dedupe import first_by
from .search import grams
from .tables import few, materialise

WORK_MODES = ["remote", "hybrid", "onsite"]


def haystack(description: bool = False) -> Column:
    parts = [F.coalesce("title", F.lit("")), F.coalesce("company", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")]
    return F.lower(F.concat_ws(" ", *parts, *([F.coalesce("description", F.lit(""))] if description else [])))


def match_keywords(keywords: Column | str, hay: Column) -> Column:
    """Whether every word of the query is found in hay; an empty query is."""
    query = F.lit(keywords) if isinstance(keywords, str) else keywords
    words = F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(hay, w))


def dedupe_cards(cards: DataFrame, limit: int | None = None) -> DataFrame:
    """First of each (source, job_id), then first of each (title, company) in lower case, then the first `limit` in order."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    unique = first_by(cards, ["source", "job_id"], "seq").withColumns({"t_": low("title"), "c_": low("company")})
    left = first_by(unique, ["t_", "c_"], "seq").drop("t_", "c_")
    return left.orderBy("seq").limit(limit) if limit is not None else left


def dedupe_by_job_id(cards: DataFrame, limit: int | None = None) -> DataFrame:
    left = first_by(cards, ["job_id"], "seq")
    return left.orderBy("seq").limit(limit) if limit is not None else left


#: Characters of a word by which roles are looked up.
ROLE_GRAM = 3


def _short_grams(text: Column) -> Column:
    """All stretches of up to ROLE_GRAM characters."""
    cut = lambda g: F.transform(F.sequence(F.lit(1), F.length(g)), lambda n: F.substring(g, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(grams(text, ROLE_GRAM), cut)))


def role_hits(cards: DataFrame, roles: DataFrame, limit: int = 25) -> DataFrame:
    """(role_seq, role, url, seq): of each role the first `limit` cards that hold all its keywords. A role without keywords is held by every card.

    Roles and cards meet on stretches of up to ROLE_GRAM characters: of all stretches of a role's keywords (whole words where they are shorter) the one that fewest cards hold is looked up among the cards', which then have to hold
    all words. Stretches are counted over all cards, so a word that most cards hold decides nothing. Registries may have any length."""
    hay = materialise(cards.select("seq", "url", haystack().alias("hay")).where("coalesce(url, '') <> ''"), "cards")
    words = F.array_distinct(F.filter(F.split(F.lower("keywords"), r"(?U)\s+"), lambda w: w != ""))
    wanted = materialise(roles.select("role_seq", "role", "keywords", words.alias("words")), "roles")
    index = hay.select("seq", F.explode(_short_grams(F.col("hay"))).alias("gram"))
    cut = lambda w: F.when(F.length(w) <= ROLE_GRAM, F.array(w)).otherwise(F.slice(grams(w, ROLE_GRAM), F.lit(1), F.length(w) - ROLE_GRAM + 1))
    each = wanted.select("role_seq", F.explode(F.array_distinct(F.flatten(F.transform("words", cut)))).alias("gram"))
    often = index.join(few(materialise(each.select("gram").distinct(), "grams")), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(often.hint("merge"), "gram", "left").groupBy("role_seq").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    # the exploded index is never the side that is broadcast
    candidates = index.join(few(materialise(rarest, "rarest")), "gram").select("role_seq", "seq")
    hits = candidates.join(few(wanted.select("role_seq", "role", "keywords")), "role_seq").join(hay.hint("merge"), "seq").where(match_keywords(F.col("keywords"), F.col("hay"))).select("role_seq", "role", "url", "seq")
    hits = hits.withColumn("at_", F.row_number().over(Window.partitionBy("role_seq").orderBy("seq"))).where(F.col("at_") <= limit).drop("at_")
    # the first cards of the table, as one row of at most `limit` structs
    first = hay.select("seq", "url").orderBy("seq").limit(limit).agg(F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("firsts")).withColumn("k_", F.lit(0))
    free = wanted.where("size(words) = 0").select("role_seq", "role", F.lit(0).alias("k_")).join(F.broadcast(first), "k_").select("role_seq", "role", F.explode("firsts").alias("c")).select("role_seq", "role", "c.url", "c.seq")
    return hits.unionByName(free)


def role_sweep(cards: DataFrame, roles: DataFrame, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(canonical_url, role) of the first role that surfaced each URL, and (role_seq, role, added) with the URLs each role was first to surface."""
    hits = role_hits(cards, roles, limit)
    first = hits.groupBy(canonicalize_url(F.col("url")).alias("canonical_url")).agg(F.min_by("role", "role_seq").alias("role"))
    added = hits.groupBy("url").agg(F.min("role_seq").alias("role_seq")).groupBy("role_seq").agg(F.count("*").alias("added"))
    return first, roles.select("role_seq", "role").join(added, "role_seq", "left").select("role_seq", "role", F.coalesce("added", F.lit(0)).alias("added"))


def tag_search_role(postings: DataFrame, url_roles: DataFrame) -> DataFrame:
    """postings with search_role filled in by canonical URL where it is null."""
    keyed = postings.withColumn("k_", canonicalize_url(F.col("url")))
    roles = url_roles.select(F.col("canonical_url").alias("k2_"), F.col("role").alias("role_"))
    old = F.col("search_role") if "search_role" in postings.columns else F.lit(None).cast("string")
    return keyed.join(roles.hint("merge"), F.col("k_") == F.col("k2_"), "left").withColumn("search_role", F.coalesce(old, "role_")).drop("k_", "k2_", "role_")


def registry_problems(roles: DataFrame) -> DataFrame:
    """(problem, category, role) of a role registry: blank fields, and roles listed twice in a category whatever their case."""
    blank = F.trim(F.coalesce("category", F.lit(""))) == ""
    for c in ("role", "keywords"):
        blank = blank | (F.trim(F.coalesce(c, F.lit(""))) == "")
    twice = roles.groupBy(F.lower(F.trim("category")).alias("category"), F.lower(F.trim("role")).alias("role")).count().where("count > 1")
    return roles.where(blank).select(F.lit("blank").alias("problem"), "category", "role").unionByName(twice.select(F.lit("twice").alias("problem"), "category", "role"))


def roles_for(roles: DataFrame, category: str) -> DataFrame:
    """Roles of one category in order; raises for a category that has none."""
    found = roles.where(F.lower(F.trim("category")) == category.strip().lower())
    if found.isEmpty():
        raise ValueError(f"unknown role category {category!r}")
    return found.orderBy("role_seq")


def facet_filter(cards: DataFrame, work_mode: str | None = None, country: str | None = None, category: str | None = None, seniority: str | None = None) -> DataFrame:
    """Cards by facets: work mode, country (in capitals), a category among tags, a seniority level."""
    if work_mode is not None and work_mode not in WORK_MODES:
        raise ValueError(f"work mode must be one of {', '.join(WORK_MODES)}, got {work_mode!r}")
    for column, value in (("work_mode", work_mode), ("country", country and country.upper()), ("seniority", seniority)):
        if value is not None:
            cards = cards.where(F.col(column) == value)
    return cards.where(F.array_contains("tags", category)) if category is not None else cards
