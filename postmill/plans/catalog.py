"""Registered queries of the job-postings library: name -> (query, SQL of the same result or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text, urls
from ..functions.scoring import PROFILE
from ..operators import cards as C
from ..operators import dedupe, enrich, filters, report, state
from ..operators.snapshots import Snapshots
from ..operators.tables import materialise, shared_path
from . import oracle
from .adapters import as_of, pick, postings, table
from .oracle import CHAIN, board, canon, has, names, q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_postings(postings(spark, sf_dir), PROFILE, as_of())


def enriched_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of the enriched postings, written once: linking, ranking and history read them several times. What other columns need isn't computed."""
    return materialise(enriched(spark, sf_dir).select(*columns), "enriched")


def kept(spark: SparkSession, sf_dir: str, condition: F.Column) -> DataFrame:
    """seq of the enriched postings for which a condition holds. It is written as a column first: a filter would be pushed below the enrichment, and each column that it
    names, with all that this one comes from, be computed anew wherever it is named."""
    return materialise(enriched(spark, sf_dir).select("seq", condition.alias("kept")), "kept").where("kept").select("seq")


#: What duplicates of results are told by.
KEYED = ["seq", "title", "company", "score", "error"]


def joined(c, by: str = " | ") -> F.Column:
    return F.coalesce(F.array_join(c, by), F.lit(""))


def on_postings(name: str, columns: dict, sql: str, full: bool = False):
    """A query that selects expressions over raw (or enriched) postings."""

    def run(spark, sf_dir):
        df = (enriched if full else postings)(spark, sf_dir)
        return df.select("seq", *[(c() if callable(c) else c).alias(n) for n, c in columns.items()])

    query(name, CHAIN + sql)(run)


# --- URLs ---


@query("b1_canonicalize_url", f"SELECT page_id, {canon('url')} AS canonical_url FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonicalize_url(F.col("url")).alias("canonical_url"))


@query("a1_read_url_list", "SELECT trim(url) AS url FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '# ' || url WHEN page_id % 11 = 0 THEN '  ' ELSE '  ' || url || ' ' END AS url FROM pages) WHERE trim(url) <> '' AND NOT starts_with(trim(url), '#')")
def _(spark, sf_dir):
    from ..sources.feeds import url_list

    lines = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.expr("CASE WHEN page_id % 7 = 0 THEN '# ' || url WHEN page_id % 11 = 0 THEN '  ' ELSE '  ' || url || ' ' END").alias("value"))
    return url_list(lines).select("url")


@query("b2_input_dedupe", f"SELECT min(seq) AS seq, arg_min(url, seq) AS url, k AS canonical_url FROM (SELECT seq, url, {canon('url')} AS k FROM ({oracle.POSTINGS})) GROUP BY k")
def _(spark, sf_dir):
    return dedupe.input_dedupe(postings(spark, sf_dir).select("seq", "url"))


@query("b3_board_name", f"SELECT seq, {board('url')} AS board FROM ({oracle.POSTINGS})")
def _(spark, sf_dir):
    return postings(spark, sf_dir).select("seq", urls.board_name(F.col("url")).alias("board"))


# --- cards ---

CARDS = f"SELECT seq, CASE WHEN seq % 3 = 0 THEN 'remotive' ELSE 'arbeitnow' END AS source, 'id:' || CAST(seq // 2 AS VARCHAR) AS job_id, title, company, location, url, {pick('seq', ['python,aws', 'soc', 'remote,siem', ''])} AS tag FROM p"
ROLES = [("security", "Detection Engineer", "detection engineer"), ("security", "SOC Analyst", "soc analyst"), ("security", "Security Engineer", "security engineer"), ("data", "Data Engineer", "data"), ("cloud", "Cloud AWS", "cloud aws"), ("other", "Nobody", "zzz yyy")]
ROLE_ROWS = ", ".join(f"({k}, {q(c)}, {q(r)}, {q(w)})" for k, (c, r, w) in enumerate(ROLES))
HAY = "lower(coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || replace(tag, ',', ' '))"


def card_rows(spark, sf_dir) -> DataFrame:
    tag = F.expr(pick("seq", ["python,aws", "soc", "remote,siem", ""]))
    return postings(spark, sf_dir).select(
        "seq", F.when(F.col("seq") % 3 == 0, "remotive").otherwise("arbeitnow").alias("source"), F.concat(F.lit("id:"), F.expr("seq DIV 2").cast("string")).alias("job_id"), "title", "company", "location", "url", F.split(tag, ",").alias("tags"),
    )


def role_rows(spark) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(ROLES)], "role_seq int, category string, role string, keywords string")


@query("c1_match_keywords", f"{oracle.CHAIN.split(', b AS')[0]} SELECT seq FROM ({CARDS}) WHERE contains({HAY}, 'engineer') AND contains({HAY}, 'company') AND contains({HAY}, 'aws')")
def _(spark, sf_dir):
    return card_rows(spark, sf_dir).where(C.match_keywords("Engineer company  AWS", C.haystack())).select("seq")


@query("c2_dedupe_cards", f"""{oracle.CHAIN.split(', b AS')[0]}, c AS ({CARDS}), u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source, job_id ORDER BY seq) = 1),
v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lower(coalesce(title, '')), lower(coalesce(company, '')) ORDER BY seq) = 1) SELECT seq, job_id FROM v ORDER BY seq LIMIT 300""")
def _(spark, sf_dir):
    return C.dedupe_cards(card_rows(spark, sf_dir), 300).select("seq", "job_id")


@query("c3_dedupe_by_job_id", f"{oracle.CHAIN.split(', b AS')[0]}, c AS ({CARDS}) SELECT min(seq) AS seq, job_id FROM c GROUP BY job_id")
def _(spark, sf_dir):
    return C.dedupe_by_job_id(card_rows(spark, sf_dir)).select("seq", "job_id")


_SWEEP = f"""{oracle.CHAIN.split(', b AS')[0]}, c AS ({CARDS}), r(role_seq, category, role, keywords) AS (VALUES {ROLE_ROWS}),
h AS (SELECT r.role_seq, role, url, seq FROM r JOIN c ON len(list_filter(string_split(lower(keywords), ' '), lambda w: NOT contains({HAY}, w))) = 0 QUALIFY row_number() OVER (PARTITION BY r.role_seq ORDER BY seq) <= 25)"""


@query("c4_role_sweep", f"{_SWEEP} SELECT {canon('url')} AS canonical_url, arg_min(role, role_seq) AS role FROM h GROUP BY 1")
def _(spark, sf_dir):
    return C.role_sweep(card_rows(spark, sf_dir), role_rows(spark))[0]


@query("c4_role_sweep_added", f"{_SWEEP}, a AS (SELECT role_seq, count(*) AS added FROM (SELECT url, min(role_seq) AS role_seq FROM h GROUP BY url) GROUP BY role_seq) SELECT r.role_seq, r.role, coalesce(added, 0) AS added FROM r LEFT JOIN a USING (role_seq)")
def _(spark, sf_dir):
    return C.role_sweep(card_rows(spark, sf_dir), role_rows(spark))[1]


@query("c5_tag_search_role", f"{_SWEEP}, t AS (SELECT {canon('url')} AS k, arg_min(role, role_seq) AS role FROM h GROUP BY 1) SELECT p.seq, t.role AS search_role FROM p LEFT JOIN t ON t.k = {canon('p.url')}")
def _(spark, sf_dir):
    return C.tag_search_role(postings(spark, sf_dir).select("seq", "url"), C.role_sweep(card_rows(spark, sf_dir), role_rows(spark))[0]).select("seq", "search_role")


@query("c6_validate_registry", "SELECT 'twice' AS problem, lower(trim(p_brand)) AS category, lower(trim(p_type)) AS role FROM part GROUP BY 2, 3 HAVING count(*) > 1")
def _(spark, sf_dir):
    return C.registry_problems(table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_type").alias("role"), F.col("p_name").alias("keywords")))


@query("c7_facet_filter", f"{oracle.CHAIN.split(', b AS')[0]} SELECT seq FROM p WHERE seq % 3 = 1 AND seq % 2 = 0")
def _(spark, sf_dir):
    rows = card_rows(spark, sf_dir).withColumns({"work_mode": F.expr(pick("seq", ["remote", "hybrid", "onsite"])), "country": F.expr(pick("seq", ["DE", "US"])), "seniority": F.lit("mid")})
    return C.facet_filter(rows, "hybrid", "de").select("seq")


@query("a20_union_sources", f"{oracle.CHAIN.split(', b AS')[0]}, c AS ({CARDS}) SELECT source, count(*) AS n, count(location) AS located FROM c GROUP BY source")
def _(spark, sf_dir):
    from ..sources.feeds import union_sources

    rows = card_rows(spark, sf_dir)
    return union_sources([rows.where("source = 'remotive'").drop("tags"), rows.where("source = 'arbeitnow'").select("title", "seq", "source", "location", "url", "tags")]).groupBy("source").agg(F.count("*").alias("n"), F.count("location").alias("located"))


# --- enrichment ---


def _bucket(k: int) -> str:
    h, t = f"heading{k}", f"text{k}"
    return oracle._case([(f"trim({t}) = ''", "'none'"), (has(h, fixed.NICE_TO_HAVE), "'nice_to_have'"), (has(h, fixed.REQUIREMENTS), "'requirements'"), (has(h, fixed.RESPONSIBILITIES), "'responsibilities'"), (f"length({t}) > 400 AND {has(t, fixed.OTHER_HINTS)}", "'other'")], "'none'")


def _of(label: str) -> str:
    return f"concat_ws(' | ', CASE WHEN {_bucket(1)} = '{label}' THEN heading1 END, CASE WHEN {_bucket(2)} = '{label}' THEN heading2 END) AS {label}"


heads = lambda c: joined(F.transform(c, lambda s: s["heading"]))
BUCKETS = ["nice_to_have", "requirements", "responsibilities", "other"]


@query("e1_bucket_sections", f"{CHAIN} SELECT seq, {', '.join(map(_of, BUCKETS))} FROM k")
def _(spark, sf_dir):
    df = postings(spark, sf_dir).select("seq", text.bucket_sections(F.col("sections")).alias("b"))
    return df.select("seq", *[heads(F.col(f"b.{n}")).alias(n) for n in BUCKETS])


on_postings("e2_extract_benefits", {"benefits": lambda: heads(text.extract_benefits(F.col("sections")))}, f"SELECT seq, concat_ws(' | ', CASE WHEN {has('heading1', fixed.BENEFITS)} AND trim(text1) <> '' THEN heading1 END, CASE WHEN {has('heading2', fixed.BENEFITS)} AND trim(text2) <> '' THEN heading2 END) AS benefits FROM k")
on_postings("e3_find_skills", {"skills": lambda: joined(text.find_skills(F.col("full_text"), PROFILE["custom_skills"]))}, "SELECT seq, array_to_string(skills_found, ' | ') AS skills FROM k")
on_postings("e4_find_experience", {"years": lambda: joined(F.transform(text.find_experience(F.col("full_text")), lambda y: y.cast("string")))}, "SELECT seq, array_to_string(years, ' | ') AS years FROM k")
on_postings("e7_detect_signals", {
    "sponsorship": lambda: text.detect_signals(F.col("full_text"))["sponsorship_mentioned"], "german": lambda: text.detect_signals(F.col("full_text"))["german_required"], "modes": lambda: joined(text.detect_signals(F.col("full_text"))["work_mode"]),
}, "SELECT seq, sponsorship, german, array_to_string(modes, ' | ') AS modes FROM k")
on_postings("e8_posting_age_days", {"age_days": lambda: text.posting_age_days(F.col("posted"), as_of())}, "SELECT seq, age_days FROM k")
on_postings("e9_normalize_job_type", {"job_type": lambda: text.normalize_job_type(F.col("raw_types"), F.col("title"), F.col("full_text"))}, "SELECT seq, job_type FROM k")
on_postings("e10_infer_seniority", {"seniority": lambda: F.col("seniority"), "evidence": lambda: joined(F.col("seniority_evidence")), "confidence": lambda: F.col("seniority_confidence")}, "SELECT seq, seniority, evidence, CAST(confidence AS DOUBLE) AS confidence FROM k", full=True)
on_postings("e10b_seniority_rank", {"level_rank": lambda: text.seniority_rank(F.col("seniority"))}, f"SELECT seq, list_position({names(fixed.LEVELS)}, seniority) - 1 AS level_rank FROM k", full=True)
on_postings("e11_enrich_posting", {
    "job_type": lambda: F.col("job_type"), "seniority": lambda: F.col("seniority"), "n_skills": lambda: F.size("skills_found"), "live": lambda: F.col("is_live"), "chars": lambda: F.col("full_text_chars"), "score": lambda: F.col("score"), "age_days": lambda: F.col("age_days"),
}, "SELECT seq, job_type, seniority, len(skills_found) AS n_skills, is_live AS live, length(full_text) AS chars, score, age_days FROM k", full=True)
on_postings("d7_check_liveness", {"is_live": lambda: text.check_liveness(F.col("full_text"))["is_live"]}, "SELECT seq, is_live FROM k")
on_postings("f1_score_posting", {"score": lambda: F.col("score"), **{n: (lambda n=n: F.col(f"match.breakdown.{n}")) for n in fixed.WEIGHTS}}, """SELECT seq, score, CASE WHEN scored THEN p_skills END AS technical_skills, CASE WHEN scored THEN p_exp END AS experience, CASE WHEN scored THEN p_level END AS seniority,
  CASE WHEN scored THEN p_cert END AS certifications, CASE WHEN scored THEN p_place END AS location, CASE WHEN scored THEN p_role END AS role_relevance, CASE WHEN scored THEN p_pay END AS compensation FROM k""", full=True)
on_postings("f2_match_skills", {"matched": lambda: joined(F.col("match.matched_skills")), "gaps": lambda: joined(F.col("match.skill_gaps"))}, "SELECT seq, CASE WHEN scored THEN array_to_string(matched, ' | ') ELSE '' END AS matched, CASE WHEN scored THEN array_to_string(gaps, ' | ') ELSE '' END AS gaps FROM k", full=True)
on_postings("f3_role_relevance", {"tier": lambda: scoring.role_tier(F.col("title"), PROFILE)}, "SELECT seq, tier FROM k")
FIT = f"""concat_ws(' | ', CASE WHEN scored AND len(matched) > 0 THEN 'Fit: ' || array_to_string(matched[1:8], ', ') END, CASE WHEN len(years) > 0 THEN 'Asks ' || list_min(years) || '-' || list_max(years) || ' yrs; you have {PROFILE['years_total']}' END,
  CASE WHEN scored AND len(gaps) > 0 THEN 'Watch: ' || array_to_string(gaps[1:5], ', ') END, CASE WHEN german THEN 'Watch: German required' END, CASE WHEN sponsorship THEN 'Note: sponsorship mentioned in posting' END,
  CASE WHEN age_days IS NOT NULL THEN 'Posted ' || age_days || 'd ago' || CASE WHEN age_days <= 14 THEN ' (fresh)' WHEN age_days > 60 THEN ' (stale)' ELSE '' END END)"""
on_postings("f4_fit_summary", {"fit": lambda: joined(scoring.fit_summary(F.col("match"), F.col("experience_years_mentioned"), F.col("signals"), F.col("age_days"), F.lit(None).cast("string"), PROFILE))}, f"SELECT seq, {FIT} AS fit FROM k", full=True)
_SALARY = f"WITH p AS ({oracle.POSTINGS}), b AS (SELECT seq, {oracle.salary_hits('text1 || chr(32) || text2')} AS hits FROM p)"


@query("e5_extract_salary", f"{_SALARY} SELECT seq, array_to_string(hits, ' | ') AS salary FROM b")
def _(spark, sf_dir):
    df = postings(spark, sf_dir)
    return df.select("seq", joined(text.extract_salary(F.col("full_text"), text.folded(F.col("full_text")))).alias("salary"))


@query("e6_normalize_salary", f"{_SALARY}, n AS (SELECT seq, list_filter(list_transform(hits, lambda h: {oracle.annual('h')}), lambda x: x IS NOT NULL) AS found FROM b) SELECT seq, array_to_string(list_transform(found, lambda x: x.currency || ':' || x.lo || '-' || x.hi), ' | ') AS annual FROM n")
def _(spark, sf_dir):
    df = postings(spark, sf_dir)
    found = text.normalize_salary(text.extract_salary(F.col("full_text"), text.folded(F.col("full_text"))))
    return df.select("seq", joined(F.transform(found, lambda x: F.format_string("%s:%d-%d", x["currency"], x["min_annual"], x["max_annual"]))).alias("annual"))


@query("e12_epoch_to_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    iso = text.epoch_to_iso(F.col("ts").cast("double").cast("string"))
    return ev.select("event_id", iso.alias("iso"), text.posted_date(iso).alias("day"))


# --- linking ---

on_postings("g1_normalize_names", {"company_key": lambda: text.normalize_company(F.col("company")), "title_key": lambda: text.normalize_title(F.col("title"))}, "SELECT seq, company_key, title_key FROM k")


@query("g2_dedupe_results", f"{CHAIN} SELECT seq, score FROM k QUALIFY failed OR company_key = '' OR title_key = '' OR row_number() OVER (PARTITION BY failed, company_key, title_key ORDER BY coalesce(score, -1) DESC, seq) = 1")
def _(spark, sf_dir):
    return dedupe.dedupe_results(enriched_table(spark, sf_dir, *KEYED)).select("seq", "score")


_WHOLE = " || ' ' || ".join(f"substr(text{k}, 1, 2000) || CASE WHEN {_bucket(k)} <> 'none' THEN ' ' || text{k} ELSE '' END" for k in (1, 2))
_FP = f"""{CHAIN}, tk AS (SELECT seq, url, company_key, title_key, failed, trim(regexp_replace(regexp_replace(lower(coalesce(location, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS place,
  list_sort(list_distinct(regexp_extract_all(lower({_WHOLE}), '[a-z0-9]+'))) AS tokens FROM k),
fp AS (SELECT seq, url, CASE WHEN NOT failed AND company_key <> '' AND title_key <> '' AND len(tokens) >= 10 THEN sha256(concat_ws('|', company_key, title_key, place, sha256(array_to_string(tokens, ' ')))) END AS fingerprint FROM tk)"""


def _bodies(spark, sf_dir) -> DataFrame:
    """Postings with cut sections and whole buckets, as the enrichment leaves them."""
    return enriched(spark, sf_dir)


@query("g5_content_fingerprint", f"{_FP} SELECT seq, fingerprint FROM fp")
def _(spark, sf_dir):
    df = _bodies(spark, sf_dir)
    return df.select("seq", dedupe.content_fingerprint(df).alias("fingerprint"))


def _collapsed(df: DataFrame) -> DataFrame:
    """Few companies and titles, so that equal texts meet."""
    return df.withColumns({"company": F.lit("Acme"), "title": F.lit("Engineer"), "location": F.lit(None).cast("string")})


def _fingerprints(spark, sf_dir) -> DataFrame:
    """(seq, url, fingerprint), written, as it is read twice and costs an enrichment."""
    df = _collapsed(_bodies(spark, sf_dir))
    return materialise(df.select("seq", "url", dedupe.content_fingerprint(df).alias("fingerprint")), "fingerprints")


_FP1 = _FP.replace("sha256(concat_ws('|', company_key, title_key, place,", "sha256(concat_ws('|', 'acme', 'engineer', '',").replace("AND company_key <> '' AND title_key <> '' ", "")


@query("g6_mark_reposts", f"{_FP1}, f AS (SELECT seq, url, fingerprint, first_value(url) OVER (PARTITION BY fingerprint ORDER BY seq) AS first FROM fp) SELECT seq, CASE WHEN fingerprint IS NOT NULL AND first <> url THEN first END AS repost_of FROM f")
def _(spark, sf_dir):
    return dedupe.mark_reposts(_fingerprints(spark, sf_dir)).select("seq", "repost_of")


@query("g7_flag_historical_reposts", f"{_FP1}, c AS (SELECT fingerprint, arg_min(url, seq) AS old FROM fp WHERE seq % 2 = 0 AND fingerprint IS NOT NULL GROUP BY 1) SELECT seq, CASE WHEN old <> url THEN old END AS repost_of_closed FROM fp LEFT JOIN c USING (fingerprint) WHERE seq % 2 = 1")
def _(spark, sf_dir):
    df = _fingerprints(spark, sf_dir)
    return dedupe.flag_historical_reposts(df.where("seq % 2 = 1"), df.where("seq % 2 = 0")).select("seq", "repost_of_closed")


@query("g3_title_similarity")
def _(spark, sf_dir):
    keyed = dedupe.with_keys(postings(spark, sf_dir)).where("company_key <> ''").select("company_key", "title_key", "seq")
    return dedupe.title_pairs(keyed)


@query("g4_fuzzy_dedupe")
def _(spark, sf_dir):
    return dedupe.fuzzy_dedupe(enriched_table(spark, sf_dir, *KEYED, "url")).select("seq", "url", F.size("merged_urls").alias("n_merged"), F.array_join("merged_urls", " ").alias("merged_urls"))


# --- filters ---


def on_filter(name: str, condition: str, **given):
    @query(name, f"{CHAIN} SELECT seq FROM k WHERE failed OR ({condition})")
    def _(spark, sf_dir):
        return kept(spark, sf_dir, filters.posting_filter(**given))


on_filter("h1_location", "contains(lower(coalesce(location, '')), 'berlin')", location="Berlin")
on_filter("h2_title_keywords", "contains(lower(title), 'engineer') OR contains(lower(title), 'hunter')", keywords="Engineer, hunter")
on_filter("h3_excludes", "NOT contains(lower(coalesce(company, '')), 'gmbh') AND NOT contains(lower(title), 'intern') AND NOT contains(lower(title), 'data')", exclude_companies="GmbH", exclude_keywords="intern,Data")
on_filter("h4_seniority", "seniority IN ('senior', 'staff', 'unknown')", seniority="senior,staff,unknown")
on_filter("h5_job_type", "job_type IN ('contract', 'unknown')", job_type="contract,unknown")
_TOP = pick("seq", ["120000", "60000000", "2500000", "45000", "104000", None, "1200000", "95000"])
_CUR = pick("seq", ["USD", "EUR", "INR", "GBP", "USD", None, "INR", "USD"])
on_filter("h6_salary", f"({_TOP}) IS NULL OR (({_CUR}) = 'USD' AND CAST({_TOP} AS BIGINT) >= 100000)", salary_min="100k USD")
_LOW = pick("seq", ["120000", "60000000", "2500000", "45000", "104000", None, "1200000", "90000"])
on_filter("h6_salary_max", f"({_LOW}) IS NULL OR (({_CUR}) = 'USD' AND CAST({_LOW} AS BIGINT) <= 110000)", salary_max="110k USD")
on_filter("h8_max_age", "age_days IS NULL OR age_days <= 30", max_age=30)


@query("h9_min_score", f"{CHAIN} SELECT seq FROM k WHERE failed OR score >= 50")
def _(spark, sf_dir):
    return kept(spark, sf_dir, filters.min_score(50))


@query("h10_check_tracker", f"""WITH p AS (SELECT seq, url, {canon('lower(url)')} AS k FROM ({oracle.POSTINGS})), t AS (SELECT 'applied to <' || lower(url) || '> on monday' AS line, k FROM p WHERE seq % 50 = 3),
a AS (SELECT k FROM t UNION SELECT p.k FROM p JOIN t ON contains(t.line, p.k)) SELECT seq, CASE WHEN a.k IS NOT NULL THEN 'applied' END AS tracker_status FROM p LEFT JOIN a USING (k)""")
def _(spark, sf_dir):
    df = postings(spark, sf_dir).select("seq", "url")
    lines = df.where("seq % 50 = 3").select(F.concat(F.lit("applied to <"), "url", F.lit("> on Monday")).alias("line"))
    return filters.check_tracker(df, lines).select("seq", "tracker_status")


# --- state ---

TODAY, BEFORE = "2024-06-15", "2024-06-01"
_KEYS = f"{CHAIN}, kk AS (SELECT *, company_key || '|' || title_key AS key FROM k)"
_WATCH = f"""{_KEYS}, old AS (SELECT key, arg_min(url, seq) AS url, arg_min(title, seq) AS title, CASE WHEN min(seq) % 5 = 0 THEN DATE '{BEFORE}' END AS closed_since FROM kk WHERE seq % 3 <> 0 AND NOT failed GROUP BY key),
run AS (SELECT * FROM kk WHERE seq % 3 <> 1), now AS (SELECT key, bool_or(failed) AS any_failed, min(seq) FILTER (NOT failed) AS first_seq, arg_min(url, seq) FILTER (NOT failed) AS url, arg_min(title, seq) FILTER (NOT failed) AS title FROM run GROUP BY key),
m AS (SELECT coalesce(old.key, now.key) AS key, old.key IS NOT NULL AS known, first_seq, now.key IS NOT NULL AS seen, coalesce(old.url, now.url) AS url, coalesce(old.title, now.title) AS title, closed_since FROM old FULL JOIN now ON old.key = now.key)"""


def _watch_before(spark, sf_dir) -> DataFrame:
    """The watch list that an earlier run left."""
    df = postings(spark, sf_dir).select("seq", "url", "title", "company", "error")
    keyed = dedupe.with_keys(df).where("seq % 3 <> 0 AND error IS NULL").withColumn("key", F.concat_ws("|", "company_key", "title_key"))
    old = keyed.groupBy("key").agg(F.min_by("url", "seq").alias("url"), F.min_by("title", "seq").alias("title"), F.min("seq").alias("s"))
    return old.select("key", "url", "title", F.lit(BEFORE).cast("date").alias("first_seen"), F.when(F.col("s") % 5 == 0, F.lit(BEFORE).cast("date")).alias("closed_since"))


def kept_runs(spark, name: str, key: str) -> Snapshots:
    """Snapshots of a query of its own, in as many buckets as shuffles have tasks."""
    return Snapshots(spark, f"{name}_{uuid.uuid4().hex}", key, int(spark.conf.get("spark.sql.shuffle.partitions")), shared_path(spark, name))


def watched(spark, sf_dir):
    # scores play no part in the watch list
    df = postings(spark, sf_dir).select("seq", "url", "title", "company", "error")
    before = kept_runs(spark, "watch", "key").start(BEFORE, _watch_before(spark, sf_dir))
    return state.apply_watch(df.where("seq % 3 <> 1"), before, TODAY)


@query("i1_watch_new", f"{_WATCH} SELECT run.seq, coalesce(NOT m.known AND m.first_seq = run.seq, FALSE) AS is_new FROM run JOIN m ON m.key = run.key")
def _(spark, sf_dir):
    return watched(spark, sf_dir)[0].select("seq", "is_new")


@query("i1_watch_closed", f"{_WATCH} SELECT key, url FROM m WHERE known AND NOT seen AND closed_since IS NULL")
def _(spark, sf_dir):
    return watched(spark, sf_dir)[1].select("key", "url")


@query("i1_watch_state", f"""{_WATCH} SELECT key, url, title, CASE WHEN known THEN '{BEFORE}' ELSE '{TODAY}' END AS first_seen,
  CASE WHEN first_seq IS NOT NULL THEN NULL WHEN NOT seen AND closed_since IS NULL THEN '{TODAY}' ELSE CAST(closed_since AS VARCHAR) END AS closed_since FROM m WHERE known OR first_seq IS NOT NULL""")
def _(spark, sf_dir):
    return watched(spark, sf_dir)[2].select("key", "url", "title", F.col("first_seen").cast("string").alias("first_seen"), F.col("closed_since").cast("string").alias("closed_since"))


_HIST = f"{CHAIN}, h1 AS (SELECT url, max_by(seq, rank) AS seq, count(*) AS n FROM k WHERE seq % 3 <> 0 GROUP BY url), h2 AS (SELECT url, max_by(seq, rank) AS seq, count(*) AS n FROM k WHERE seq % 3 <> 1 GROUP BY url)"


def history(spark, sf_dir) -> DataFrame:
    ranked = report.rank_postings(enriched_table(spark, sf_dir, "url", "seq", "score", "title", "is_live"))
    run = materialise(ranked.select("url", "rank", "seq", "score", "title", F.col("is_live").cast("int").alias("live")), "run")
    empty = spark.createDataFrame([], "url string, rank long, seq long, score int, title string, live int, first_seen timestamp, last_seen timestamp, scrape_count long")
    runs = kept_runs(spark, "history", "url")
    first = runs.start(BEFORE, state.merge_history(empty, run.where("seq % 3 <> 0"), f"{BEFORE} 00:00:00"))
    return state.merge_history(first, run.where("seq % 3 <> 1"), f"{TODAY} 00:00:00")


@query("i2_merge_history", f"{_HIST} SELECT coalesce(h1.url, h2.url) AS url, coalesce(h2.seq, h1.seq) AS seq, CASE WHEN h1.url IS NOT NULL THEN '{BEFORE}' ELSE '{TODAY}' END AS first_seen, CASE WHEN h2.url IS NOT NULL THEN '{TODAY}' ELSE '{BEFORE}' END AS last_seen, coalesce(h1.n, 0) + coalesce(h2.n, 0) AS scrape_count FROM h1 FULL JOIN h2 ON h1.url = h2.url")
def _(spark, sf_dir):
    return history(spark, sf_dir).select("url", "seq", F.to_date("first_seen").cast("string").alias("first_seen"), F.to_date("last_seen").cast("string").alias("last_seen"), "scrape_count")


@query("i7_live_ranked_history", f"{_HIST}, m AS (SELECT coalesce(h2.seq, h1.seq) AS seq FROM h1 FULL JOIN h2 ON h1.url = h2.url) SELECT k.url, k.score FROM m JOIN k USING (seq) WHERE is_live")
def _(spark, sf_dir):
    return state.live_ranked_history(history(spark, sf_dir)).select("url", "score")


_STATUS = pick("event_id", fixed.STATUSES)
_EVENTS = f"""WITH ev AS (SELECT 'https://jobs.lever.co/acme/' || CAST(user_id AS VARCHAR) AS url, ts, event_id, CASE WHEN event_id % 17 = 0 THEN 'delete' ELSE 'mark' END AS action, {_STATUS} AS status, CASE WHEN event_id % 3 = 0 THEN 'T' || CAST(event_id AS VARCHAR) END AS title, CASE WHEN event_id % 4 = 0 THEN event_type END AS notes FROM events),
cut AS (SELECT url, max(ROW(ts, event_id)) AS cut FROM ev WHERE action = 'delete' GROUP BY url), live AS (SELECT ev.* FROM ev LEFT JOIN cut USING (url) WHERE action <> 'delete' AND (cut IS NULL OR ROW(ts, event_id) > cut)),
app AS (SELECT url, arg_min(title, ROW(ts, event_id)) FILTER (title IS NOT NULL) AS title, arg_max(status, ROW(ts, event_id)) AS status, min(ts) AS applied_date, max(ts) AS updated_at, coalesce(string_agg(notes, chr(10) ORDER BY ts, event_id), '') AS notes FROM live GROUP BY url)"""


def applications(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.fold_applications(ev.select(
        F.concat(F.lit("https://jobs.lever.co/acme/"), F.col("user_id").cast("string"), F.lit("?utm_source=x")).alias("url"), "ts", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 17 == 0, "delete").otherwise("mark").alias("action"),
        F.expr(_STATUS).alias("status"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("T"), F.col("event_id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("location"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("notes"),
    ))


@query("i3_fold_applications", f"{_EVENTS} SELECT url, title, status, strftime(applied_date, '%Y-%m-%d %H:%M:%S') AS applied, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated, notes FROM app")
def _(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return applications(spark, sf_dir).select("url", "title", "status", day("applied_date").alias("applied"), day("updated_at").alias("updated"), "notes")


@query("i4_list_applications", f"{_EVENTS} SELECT url, status FROM app WHERE status = 'offer'")
def _(spark, sf_dir):
    return state.list_applications(applications(spark, sf_dir), "offer").select("url", "status")


@query("i4_application_summary", f"{_EVENTS}, s(ord, status) AS (VALUES {', '.join(f'({k}, {q(s)})' for k, s in enumerate(fixed.STATUSES))}) SELECT s.ord, s.status, count(app.url) AS n FROM s LEFT JOIN app ON app.status = s.status GROUP BY ALL")
def _(spark, sf_dir):
    return state.application_summary(applications(spark, sf_dir)).withColumnRenamed("at", "ord")


@query("i5_backfill_from_history", f"{_EVENTS}, h AS (SELECT 'https://jobs.lever.co/acme/' || CAST(user_id AS VARCHAR) AS url, 'User ' || CAST(user_id % 10 AS VARCHAR) AS company FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0)) SELECT app.url, title, company FROM app LEFT JOIN h USING (url)")
def _(spark, sf_dir):
    users = table(spark, sf_dir, "events").where("user_id % 2 = 0").select("user_id").distinct()
    old = users.select(F.concat(F.lit("https://jobs.lever.co/acme/"), F.col("user_id").cast("string"), F.lit("#x")).alias("url"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("User "), (F.col("user_id") % 10).cast("string")).alias("company"), F.lit(None).cast("string").alias("location"))
    return state.backfill_from_history(applications(spark, sf_dir), old).select("url", "title", "company")


@query("i6_annotate_application_status", f"{_EVENTS}, p AS ({oracle.POSTINGS}) SELECT p.seq, app.status AS application_status FROM p LEFT JOIN app ON app.url = {canon('p.url')}")
def _(spark, sf_dir):
    return state.annotate_application_status(postings(spark, sf_dir).select("seq", "url"), applications(spark, sf_dir)).select("seq", "application_status")


# --- reports ---


@query("j4_rank_postings", f"{CHAIN} SELECT rank, seq, title, company, score FROM (SELECT *, row_number() OVER (ORDER BY coalesce(score, -1) DESC, seq) AS rank FROM (SELECT * EXCLUDE (rank) FROM k QUALIFY failed OR company_key = '' OR title_key = '' OR row_number() OVER (PARTITION BY failed, company_key, title_key ORDER BY coalesce(score, -1) DESC, seq) = 1))")
def _(spark, sf_dir):
    return report.rank_postings(materialise(dedupe.dedupe_results(enriched_table(spark, sf_dir, *KEYED)).select("seq", "title", "company", "score"), "distinct")).select("rank", "seq", "title", "company", "score")


_ATTEMPTS = f"WITH p AS ({oracle.POSTINGS}), t AS (SELECT {board('url')} AS source, count(*) AS attempted, CAST(sum(seq % 100) AS BIGINT) AS duration_ms FROM p GROUP BY 1), r AS (SELECT {board('url')} AS source, error FROM p WHERE seq % 5 <> 0)"


def stats(spark, sf_dir) -> DataFrame:
    df = postings(spark, sf_dir).select("seq", "url", "error")
    return report.source_stats(df.select("url", (F.col("seq") % 100).alias("duration_ms")), df.where("seq % 5 <> 0"))


_DONE = f"{_ATTEMPTS}, d AS (SELECT source, count(*) FILTER (error IS NULL) AS ok, count(error) AS errored FROM r GROUP BY 1)"


@query("j1_source_stats", f"{_DONE} SELECT source, attempted, duration_ms, coalesce(ok, 0) AS ok, coalesce(errored, 0) AS errored, greatest(0, attempted - coalesce(ok, 0) - coalesce(errored, 0)) AS filtered, CASE WHEN coalesce(errored, 0) > 0 AND ok = 0 THEN 'failed' WHEN coalesce(errored, 0) > 0 THEN 'partial' WHEN coalesce(ok, 0) = 0 THEN 'empty' ELSE 'ok' END AS status FROM t LEFT JOIN d USING (source)")
def _(spark, sf_dir):
    return stats(spark, sf_dir).select("source", "attempted", F.col("duration_ms").cast("long").alias("duration_ms"), "ok", "errored", "filtered", "status")


@query("j2_top_errors_per_source", f"{_ATTEMPTS}, c AS (SELECT source, error AS message, count(*) AS n FROM r WHERE error IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, message) AS place FROM c QUALIFY place <= 2")
def _(spark, sf_dir):
    return report.top_errors_per_source(stats(spark, sf_dir))


_FP_ROWS = _FP.removeprefix(CHAIN)


@query("j3_run_counters", f"""{_WATCH}{_FP_ROWS}, kept AS (SELECT * FROM run WHERE failed OR contains(lower(coalesce(location, '')), 'berlin') OR score >= 40),
f AS (SELECT kept.seq, kept.url, fingerprint, first_value(kept.url) OVER (PARTITION BY fingerprint ORDER BY kept.seq) AS first FROM kept JOIN fp ON fp.seq = kept.seq),
w AS (SELECT kept.*, key AS k2 FROM kept), wn AS (SELECT key, min(seq) FILTER (NOT failed) AS first_seq, bool_or(failed) AS any_failed FROM kept GROUP BY key)
SELECT (SELECT count(*) FROM run) AS before, count(*) AS after, count_if(failed) AS errored, count(score) AS scored, CAST(0 AS BIGINT) AS merged, (SELECT count_if(fingerprint IS NOT NULL AND first <> url) FROM f) AS reposts,
(SELECT count_if(old.key IS NULL AND wn.first_seq IS NOT NULL) FROM wn LEFT JOIN old ON old.key = wn.key) AS new, (SELECT count_if(wn.key IS NULL AND closed_since IS NULL) FROM old LEFT JOIN wn ON wn.key = old.key) AS closed FROM kept""")
def _(spark, sf_dir):
    full = enriched(spark, sf_dir)
    rows = materialise(full.withColumn("fingerprint", dedupe.content_fingerprint(full)).select(*KEYED, "url", "location", "fingerprint"), "enriched").where("seq % 3 <> 1")
    kept = dedupe.mark_reposts(rows.where(filters.posting_filter(location="berlin") | filters.min_score(40)))
    flagged, closed, _ = state.apply_watch(kept, _watch_before(spark, sf_dir), TODAY)
    return report.run_counters(rows, flagged, closed)


_BENEFITS = "concat_ws('; ', " + ", ".join(f"CASE WHEN {has(f'heading{k}', fixed.BENEFITS)} AND trim(text{k}) <> '' THEN heading{k} END" for k in (1, 2)) + ")"
EXPORT_SQL = f"""SELECT coalesce(CAST(score AS VARCHAR), '') AS score, CASE WHEN is_live THEN 'yes' ELSE 'no' END AS live, coalesce(CAST(age_days AS VARCHAR), '') AS age_days, title, coalesce(company, '') AS company, coalesce(location, '') AS location, coalesce(employment_type, '') AS type,
  job_type, seniority, array_to_string(years, ',') AS exp_years, array_to_string({oracle.salary_hits('full_text')}, '; ') AS salary, CASE WHEN scored THEN array_to_string(matched, '; ') ELSE '' END AS matched_skills, CASE WHEN scored THEN array_to_string(gaps, '; ') ELSE '' END AS skill_gaps, replace({FIT}, ' | ', '; ') AS fit_summary,
  {_BENEFITS} AS benefits, CASE WHEN sponsorship THEN 'yes' ELSE '' END AS sponsorship, CASE WHEN german THEN 'yes' ELSE '' END AS german_required, array_to_string(modes, ',') AS work_mode, '' AS tracker, '' AS applied, '' AS repost, '' AS search_role, url FROM k"""


@query("j5_export_rows", f"{CHAIN} {EXPORT_SQL}")
def _(spark, sf_dir):
    """All columns of the export, written as CSV and read back."""
    path = shared_path(spark, "export")
    report.write_csv(report.export_rows(enriched(spark, sf_dir), PROFILE), path)
    rows = spark.read.schema(", ".join(f"{c} string" for c in fixed.EXPORT_COLUMNS)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.na.fill("")


@query("j7_json_rows", f"{CHAIN} SELECT seq, score, title, company FROM k")
def _(spark, sf_dir):
    """The records that the JSON sink writes, written and read back."""
    path = shared_path(spark, "json")
    report.write_json(enriched(spark, sf_dir).select("seq", "score", "title", "company"), path)
    return spark.read.schema("seq long, score int, title string, company string").json(path)


@query("j8_score_band", f"{CHAIN} SELECT seq, CASE WHEN score >= 65 THEN 'hi' WHEN score >= 40 THEN 'mid' WHEN score IS NOT NULL THEN 'lo' END AS band, CASE WHEN score >= 75 THEN 'hi' WHEN score >= 50 THEN 'mid' WHEN score IS NOT NULL THEN 'lo' END AS sheet_band FROM k")
def _(spark, sf_dir):
    return report.score_band(enriched(spark, sf_dir)).select("seq", "band", "sheet_band")


@query("j9_digest_top_n", f"{CHAIN} SELECT row_number() OVER (ORDER BY rank) AS place, seq, concat_ws(' - ', title, company, location, 'score ' || score) || CASE WHEN seq % 4 = 0 THEN ' [NEW]' ELSE '' END AS line FROM k ORDER BY rank LIMIT 20")
def _(spark, sf_dir):
    return report.digest_top_n(enriched(spark, sf_dir).withColumn("is_new", F.col("seq") % 4 == 0), 20)


@query("j9_digest_only_new", f"{CHAIN} SELECT row_number() OVER (ORDER BY rank) AS place, seq, concat_ws(' - ', title, company, location, 'score ' || score) || ' [NEW]' AS line FROM k WHERE seq % 4 = 0 ORDER BY rank LIMIT 20")
def _(spark, sf_dir):
    return report.digest_top_n(enriched(spark, sf_dir).withColumn("is_new", F.col("seq") % 4 == 0), 20, only_new=True)


@query("j10_top10", f"{CHAIN} SELECT seq, score FROM k WHERE score IS NOT NULL ORDER BY rank LIMIT 10")
def _(spark, sf_dir):
    return report.top10(enriched(spark, sf_dir)).select("seq", "score")


__all__ = ["QUERIES", "SQL", "cache"]
