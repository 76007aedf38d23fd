"""Queries of the landed-data operators: payloads are made from the given tables by Spark, and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.scoring import PROFILE
from ..operators import cards as cards_of
from ..operators import report
from ..operators.tables import apart, shared_path, spread
from ..sources import ats, feeds, html
from . import catalog, oracle
from .adapters import as_of, postings, table
from .catalog import enriched_table, query
from .pipeline import enriched_once, run_flow

P = f"WITH p AS ({oracle.POSTINGS})"
PAGE = 100
place = "coalesce(location, 'Remote')"


def landed(spark, sf_dir, entry: dict, wrap: str = "%s", source: str = "x") -> DataFrame:
    """One payload for each hundred postings of an origin: a JSON array of entries, wrapped."""
    rows = postings(spark, sf_dir).withColumn("tags", F.array(F.col("origin"), F.lit("t")))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(*[F.expr(v).alias(k) for k, v in entry.items()])).alias("j")))), lambda x: x["j"])
    left, right = wrap.split("%s")
    made = rows.groupBy("origin", F.expr(f"seq DIV {PAGE}").alias("page")).agg(entries.alias("all"))
    return made.select(F.lit(source).alias("source"), F.concat(F.lit(left), F.lit("["), F.array_join("all", ","), F.lit("]"), F.lit(right)).alias("payload"), F.lit("careers.acme.com").alias("host"), F.lit("acme").alias("slug"))


def details(spark, sf_dir, entry: dict, wrap: str = "%s") -> DataFrame:
    """One payload for each posting."""
    left, right = wrap.split("%s")
    payload = F.concat(F.lit(left), F.to_json(F.struct(*[F.expr(v).alias(k) for k, v in entry.items()])), F.lit(right))
    return postings(spark, sf_dir).select(F.lit("x").alias("source"), payload.alias("payload"), F.lit("careers.acme.com").alias("host"), F.lit("acme").alias("slug"))


def cards(name: str, fn, entry: dict, wrap: str, job_id: str, location: str = place, url: str = "url", posted: str = "posted", tags: str = "origin || ',t'"):
    @query(name, f"{P} SELECT {job_id} AS job_id, title, company, {location} AS location, {url} AS url, {posted} AS posted_text, {tags} AS tags FROM p")
    def _(spark, sf_dir):
        return fn(landed(spark, sf_dir, entry, wrap)).select("job_id", "title", "company", "location", "url", "posted_text", F.array_join("tags", ",").alias("tags"))


id_ = "CAST(seq AS VARCHAR)"
cards("a2_cards_remoteok", feeds.cards_remoteok, {"id": "seq", "position": "title", "company": "company", "location": "location", "date": "posted", "tags": "tags", "url": "CASE WHEN seq % 2 = 0 THEN '/r/' || seq ELSE url END"}, "%s", f"'remoteok:' || {id_}", url=f"CASE WHEN seq % 2 = 0 THEN 'https://remoteok.com/r/' || {id_} ELSE url END")
cards("a3_cards_remotive", feeds.cards_remotive, {"id": "seq", "title": "title", "company_name": "company", "candidate_required_location": "location", "publication_date": "posted", "tags": "tags", "url": "url"}, '{"0-legal": "x", "jobs": %s}', f"'remotive:' || {id_}")
cards("a5_cards_workingnomads", feeds.cards_workingnomads, {"title": "title", "company_name": "company", "location": "location", "pub_date": "posted", "tags": "tags", "url": "CASE WHEN seq % 2 = 0 THEN 'https://w.com/job/go/' || seq || '/' ELSE url END"}, "%s", f"'workingnomads:' || CASE WHEN seq % 2 = 0 THEN {id_} ELSE url END", url=f"CASE WHEN seq % 2 = 0 THEN 'https://w.com/job/go/' || {id_} || '/' ELSE url END")
cards("a7_cards_arbeitnow", feeds.cards_arbeitnow, {"slug": "seq", "title": "title", "company_name": "company", "location": "location", "remote": "seq % 2 = 0", "created_at": "1700000000 + seq * 86400", "tags": "tags", "job_types": "array('full time')", "url": "url"}, '{"data": %s}', "'arbeitnow:' || url", location="CASE WHEN location IS NULL THEN 'Remote' WHEN seq % 2 = 0 THEN location || ' (Remote)' ELSE location END", posted="strftime(make_timestamp((1700000000 + seq * 86400) * 1000000), '%Y-%m-%dT%H:%M:%SZ')", tags="origin || ',t,full time'")
cards("a8_cards_himalayas", feeds.cards_himalayas, {"title": "title", "companyName": "company", "companySlug": "origin", "applicationLink": "CASE WHEN seq % 2 = 0 THEN url END", "guid": "url", "locationRestrictions": "CASE WHEN seq % 3 = 0 THEN array('DE', 'FR') ELSE array() END", "categories": "tags", "pubDate": "'1700000000'"}, '{"jobs": %s}', "'himalayas:' || url", location="CASE WHEN seq % 3 = 0 THEN 'DE, FR' ELSE 'Remote' END", posted="'2023-11-14T22:13:20Z'")
cards("a9_cards_workable", feeds.cards_workable, {"id": "seq", "title": "title", "department": "origin", "employmentType": "employment_type", "workplace": "'hybrid'", "url": "url", "created": "posted", "locations": "CASE WHEN seq % 2 = 0 THEN array(location) END", "location": "named_struct('city', 'Bonn', 'countryName', 'Germany')", "company": "named_struct('title', company)"}, '{"totalSize": 1, "jobs": %s}', f"'workable:' || {id_}", location="CASE WHEN seq % 2 = 0 AND location IS NOT NULL THEN location ELSE 'Bonn, Germany' END", tags="concat_ws(',', origin, employment_type, 'hybrid')")
cards("a10_cards_themuse", feeds.cards_themuse, {"id": "seq", "name": "title", "company": "named_struct('name', company)", "locations": "array(named_struct('name', location), named_struct('name', 'Flexible'))", "levels": "array(named_struct('name', origin))", "categories": "array(named_struct('name', 't'))", "refs": "named_struct('landing_page', url)", "publication_date": "posted", "contents": "'<p>' || title || '</p>'"}, '{"page": 0, "results": %s}', f"'themuse:' || {id_}", location="concat_ws(', ', location, 'Flexible')")


def escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def told(*parts: str) -> str:
    """SQL of the visible text of blocks: each without white space around it, blank ones left out, a line each."""
    bare = ", ".join(f"regexp_replace({x}, '^[\\s]+|[\\s]+$', '', 'g')" for x in parts)
    return f"array_to_string(list_filter([{bare}], lambda x: x <> ''), chr(10))"


#: A posting's whole body as HTML, and as read from it.
BODY, TOLD = f"concat('<p>', {escaped('text1')}, '</p><div>', {escaped('text2')}, '</div>')", told("text1", "text2")


@query("a11_cards_freehire", f"{P} SELECT 'freehire:s' || {id_} AS job_id, title, company, location, 'https://freehire.me/jobs/s' || {id_} AS url, '2024-05-01' AS posted_text, origin || ',t' AS tags, sha256({TOLD}) AS body_sha256 FROM p WHERE seq % 5 > 0")
def _(spark, sf_dir):
    entry = {"public_slug": "CASE WHEN seq % 5 > 0 THEN 's' || seq END", "source": "'lever'", "url": "url", "title": "title", "company": "company", "location": "location", "posted_at": "'2024-05-01T10:00:00Z'", "description": BODY, "skills": "tags", "work_mode": "'remote'"}
    made = feeds.cards_freehire(landed(spark, sf_dir, entry, '{"data": %s}'))
    return made.select("job_id", "title", "company", "location", "url", "posted_text", F.array_join("tags", ",").alias("tags"), F.sha2("description", 256).alias("body_sha256"))


def rss(spark, sf_dir, item: str) -> DataFrame:
    rows = postings(spark, sf_dir).withColumn("url", F.replace("url", F.lit("&"), F.lit("&amp;")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.expr(item).alias("i")))), lambda x: x["i"])
    made = rows.groupBy("origin", F.expr(f"seq DIV {PAGE}").alias("page")).agg(items.alias("all"))
    return made.select(F.lit("x").alias("source"), F.concat(F.lit("<?xml version='1.0'?><rss><channel><title>x</title>"), F.array_join("all", "\n"), F.lit("</channel></rss>")).alias("payload"), F.lit("h").alias("host"), F.lit("acme").alias("slug"))


flat = ["job_id", "title", "company", "location", "url", "posted_text"]


@query("a4_cards_wwr", f"{P} SELECT 'weworkremotely:' || url AS job_id, title, coalesce(company, title) AS company, 'Remote' AS location, url, coalesce(posted, '') AS posted_text FROM p")
def _(spark, sf_dir):
    item = "concat('<item><title>', concat_ws(': ', company, title), '</title><link>', url, '</link><pubDate>', coalesce(posted, ''), '</pubDate><category>c</category></item>')"
    return feeds.cards_wwr(rss(spark, sf_dir, item)).select(*flat)


@query("a6_cards_jobicy", f"{P} SELECT 'jobicy:' || url AS job_id, title, company, {place} AS location, url, posted AS posted_text, concat_ws(',', 'c', employment_type) AS tags FROM p")
def _(spark, sf_dir):
    own = lambda n, v: f"coalesce('<job_listing:{n}>' || {v} || '</job_listing:{n}>', '')"
    item = f"concat('<item><title><![CDATA[', title, ']]></title><link>', url, '</link>', coalesce('<pubDate>' || posted || '</pubDate>', ''), {own('company', 'company')}, {own('location', 'location')}, '<job_listing:category>c</job_listing:category>', {own('job_type', 'employment_type')}, '</item>')"
    return feeds.cards_jobicy(rss(spark, sf_dir, item)).select(*flat, F.array_join("tags", ",").alias("tags"))


@query("a12_hn_pick_thread", "SELECT CAST(min(conv_id) AS VARCHAR) AS story_id FROM conversations WHERE conv_id % 12 = 5")
def _(spark, sf_dir):
    months = "January February March April May June July August September October November December".split()
    label = F.element_at(F.array(*map(F.lit, months)), (F.col("conv_id") % 12 + 1).cast("int"))
    convs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    hits = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("objectID"), F.concat(F.lit("Ask HN: Who is hiring? ("), label, F.lit(" 2024)")).alias("title"))).alias("j")))), lambda x: x["j"])
    # one payload for each hundred conversations, as the search answers by pages of hits
    payloads = convs.groupBy(F.expr(f"conv_id DIV {PAGE}").alias("page")).agg(F.concat(F.lit('{"hits": ['), F.array_join(hits, ","), F.lit("]}")).alias("payload"))
    return feeds.hn_pick_thread(payloads, "June 2024", "page").select("story_id")


HEADER = "concat_ws(' | ', company, title, location, 'Full-time', 'https://x.y')"


@query("a13_cards_hn", f"""{P}, b AS (SELECT *, {told(HEADER, 'text2')} AS body FROM p WHERE seq % 7 > 0) SELECT 'hn:' || {id_} AS job_id, coalesce(company, title) AS company,
  CASE WHEN company IS NOT NULL THEN title WHEN location IS NOT NULL THEN location ELSE 'Full-time' END AS title, CASE WHEN company IS NOT NULL THEN location END AS location, sha256(body) AS body_sha256 FROM b WHERE length(body) >= {feeds.MIN_COMMENT_CHARS}""")
def _(spark, sf_dir):
    comment = F.expr(f"{HEADER} || '<p>' || {escaped('text2')}")
    rows = postings(spark, sf_dir).select(F.col("seq").alias("id"), comment.alias("text"), (F.col("seq") % 7 == 0).alias("deleted"), F.lit(None).cast("boolean").alias("dead"))
    return feeds.cards_hn(rows).select("job_id", "company", "title", "location", F.sha2("description", 256).alias("body_sha256"))


@query("a14_cards_linkedin", f"{P} SELECT {id_} AS job_id, title, company, location FROM p")
def _(spark, sf_dir):
    card = "concat('<li><div class=\"base-card job-search-card\" data-entity-urn=\"urn:li:jobPosting:', seq, '\"><a class=\"base-card__full-link\" href=\"https://l.com/x\"></a><h3 class=\"base-search-card__title\"> ', title, ' </h3>', coalesce('<h4 class=\"base-search-card__subtitle\">' || company || '</h4>', ''), coalesce('<span class=\"job-search-card__location\">' || location || '</span>', ''), '<time datetime=\"2024-05-01\">x</time></div></li>')"
    return html.cards_linkedin(postings(spark, sf_dir).select("seq", F.expr(f"{card} || {card}").alias("html"))).select("job_id", "title", "company", "location")


@query("a14_linkedin_detail", f"{P} SELECT seq, title, company, employment_type, location, sha256(regexp_replace({TOLD}, '[\\s]+', ' ', 'g')) AS body_sha256 FROM p WHERE seq % 4 > 0 AND employment_type IS NOT NULL AND location IS NOT NULL")
def _(spark, sf_dir):
    page = f"CASE WHEN seq % 4 > 0 THEN concat('<h1 class=\"top-card-layout__title\">', title, '</h1>', coalesce('<a class=\"topcard__org-name-link\">' || company || '</a>', ''), '<span class=\"topcard__flavor--bullet\">', employment_type, '</span><span class=\"topcard__flavor--bullet\">', location, '</span><div class=\"description__text\">', {BODY}, '</div>') ELSE '<p>gone</p>' END"
    rows = postings(spark, sf_dir).where("employment_type IS NOT NULL AND location IS NOT NULL").select("seq", F.expr(page).alias("html"))
    return html.linkedin_detail(rows).select("seq", "title", "company", "employment_type", "location", F.sha2("description_html", 256).alias("body_sha256"))


@query("a21_cards_to_postings", f"{P} SELECT title, company, 'apply: ' || url AS note, {TOLD} AS full_text FROM p WHERE seq % 5 > 0")
def _(spark, sf_dir):
    made = feeds.cards_freehire(landed(spark, sf_dir, {"public_slug": "CASE WHEN seq % 5 > 0 THEN 's' || seq END", "url": "url", "title": "title", "company": "company", "description": BODY}, '{"data": %s}'))
    return feeds.cards_to_postings(made).select("title", "company", F.get("fetch_notes", F.lit(0)).alias("note"), "full_text")


# --- applicant-tracking systems ---


def raw(name: str, fn, rows, sql: str):
    @query(name, f"{P} {sql}")
    def _(spark, sf_dir):
        return fn(rows(spark, sf_dir)).select("title", "company", "location", "employment_type", "department", "posted", F.col("description_html").alias("body"))


def select(company="company", location="location", kind="employment_type", department="origin", posted="posted", body="title", where="") -> str:
    return f"SELECT title, {company} AS company, {location} AS location, {kind} AS employment_type, {department} AS department, {posted} AS posted, {body} AS body FROM p {where}"


named = lambda v: f"named_struct('name', {v})"
raw("a15_raw_lever", ats.raw_lever, lambda s, d: details(s, d, {"id": "seq", "text": "title", "company": "company", "categories": "named_struct('commitment', employment_type, 'department', origin, 'location', location)", "description": "text2", "createdAt": "1700000000000 + seq"}), select(company="coalesce(company, '')", posted="CAST(1700000000000 + seq AS VARCHAR)", body="text2"))
raw("a15_raw_ashby", ats.raw_ashby, lambda s, d: details(s, d, {"title": "title", "organizationName": "company", "location": named("location"), "employmentType": "employment_type", "departmentName": "origin", "descriptionHtml": "text2", "publishedAt": "posted"}), select(body="text2"))
raw("a15_raw_greenhouse", ats.raw_greenhouse, lambda s, d: details(s, d, {"id": "seq", "title": "title", "company": named("company"), "location": named("location"), "offices": f"array({named(repr('A'))}, {named(repr('B'))})", "departments": f"array({named('origin')})", "metadata": "array(named_struct('value', employment_type))", "content": "text2", "updated_at": "posted"}), select(location="coalesce(location, 'A, B')", body="text2"))
raw("a15_raw_smartrecruiters", ats.raw_smartrecruiters, lambda s, d: details(s, d, {"id": "seq", "name": "title", "company": named("company"), "location": "named_struct('city', location, 'country', 'de')", "employmentType": "named_struct('label', employment_type)", "department": "named_struct('label', origin)", "jobAd": "named_struct('sections', named_struct('jobDescription', named_struct('text', text2)))", "releasedDate": "posted"}), select(location="concat_ws(', ', location, 'de')", body="text2"))
raw("a15_raw_workday", ats.raw_workday, lambda s, d: details(s, d, {"title": "title", "location": "location", "timeType": "employment_type", "jobDescription": "text2", "startDate": "posted"}, '{"jobPostingInfo": %s}'), select(company="'acme'", location="coalesce(location, '')", department="NULL", body="text2"))
raw("a16_raw_teamtailor", ats.raw_teamtailor, lambda s, d: landed(s, d, {"id": "seq", "title": "title", "url": "url", "content_html": "text2", "date_published": "posted"}, '{"items": %s}'), select(company="'careers'", location="NULL", kind="NULL", department="NULL", body="text2"))
raw("a16_raw_recruitee", ats.raw_recruitee, lambda s, d: landed(s, d, {"id": "seq", "title": "title", "location": "location", "employment_type": "employment_type", "department": "origin", "description": "text2", "published_at": "posted", "url": "url"}, '{"offers": %s}'), select(company="'acme'", body="text2"))
raw("a16_raw_workable_widget", ats.raw_workable_widget, lambda s, d: landed(s, d, {"shortcode": "seq", "title": "title", "location": "named_struct('location_str', location)", "employment_type": "employment_type", "department": "origin", "description": "text2", "created_at": "posted"}, '{"jobs": %s}'), select(company="'acme'", body="text2"))
raw("a16_raw_breezy", ats.raw_breezy, lambda s, d: landed(s, d, {"id": "seq", "name": "title", "url": "url", "location": named("location"), "type": named("employment_type"), "published_date": "posted"}), select(company="'acme'", department="NULL", body="''"))
raw("a16_raw_pinpoint", ats.raw_pinpoint, lambda s, d: landed(s, d, {"id": "seq", "title": "title", "url": "url", "description": "text2", "benefits": "'tea'", "location": "named_struct('city', location, 'name', 'HQ')", "workplace_type": "CASE WHEN seq % 2 = 0 THEN 'Remote' ELSE 'onsite' END", "employment_type_text": "employment_type"}, '{"data": %s}'), select(company="'acme'", location="CASE WHEN seq % 2 = 0 THEN 'Remote' ELSE concat_ws(', ', 'HQ', location) END", department="NULL", posted="NULL", body="nullif(text2, '') || chr(10) || '<h2>Benefits</h2>' || chr(10) || 'tea'"))
raw("a17_raw_workable_view", ats.raw_workable_view, lambda s, d: details(s, d, {"title": "title", "company": "named_struct('title', company)", "locations": "array(location)", "employmentType": "employment_type", "department": "origin", "description": "text2", "benefitsSection": "'tea'", "created": "posted"}), select(body="nullif(text2, '') || chr(10) || 'tea'"))
raw("a17_raw_join", ats.raw_join, lambda s, d: details(s, d, {"idParam": "seq", "title": "title", "company": named("company"), "employmentType": named("employment_type"), "category": named("origin"), "city": "named_struct('cityName', location)", "workplaceType": "'HYBRID'", "companyLocation": "'HQ'", "description": "'## ' || origin || '\\n* a\\n* **b**\\n\\nend'", "createdAt": "posted"}), select(location="coalesce(location || ' (Hybrid)', 'HQ')", body="'<h3>' || origin || '</h3>' || chr(10) || '<ul>' || chr(10) || '<li>a</li>' || chr(10) || '<li><strong>b</strong></li>' || chr(10) || '</ul>' || chr(10) || '<p>end</p>'"))


@query("a16_raw_personio", f"{P} {select(company=repr('acme'), body='text2')}")
def _(spark, sf_dir):
    tag = lambda n, v: f"coalesce('<{n}>' || {v} || '</{n}>', '')"
    item = f"concat('<position>', {tag('id', 'CAST(seq AS STRING)')}, {tag('office', 'location')}, {tag('department', 'origin')}, {tag('name', 'title')}, {tag('employmentType', 'employment_type')}, {tag('createdAt', 'posted')}, '<jobDescriptions><jobDescription><name>x</name><value><![CDATA[', text2, ']]></value></jobDescription></jobDescriptions></position>')"
    made = ats.raw_personio(rss(spark, sf_dir, item))
    return made.select("title", "company", "location", "employment_type", "department", "posted", F.col("description_html").alias("body"))


#: A posting's text as a description: a heading and a paragraph; SQL of the text that is read from it.
_ESCAPED = "replace(replace(text2, '&', '&amp;'), '<', '&lt;')"
_DESCRIPTION = f"concat('<h2>', heading1, '</h2><p>', {_ESCAPED}, '</p>')"
_TWICE = f"replace(replace({_DESCRIPTION}, '&', '&amp;'), '<', '&lt;')"
_LINE = r"trim(regexp_replace(text2, '[\s\v\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g'))"


def ld_pages(spark, sf_dir) -> DataFrame:
    ld = F.to_json(F.expr("named_struct('@type', 'JobPosting', 'title', title, 'hiringOrganization', named_struct('name', company), 'jobLocation', array(named_struct('address', named_struct('addressLocality', location))), 'employmentType', employment_type, 'description', " + _TWICE + ", 'datePosted', posted)"))
    page = F.concat(F.lit("<html><head><title>t</title><script type='application/ld+json'>not json</script><script type='application/ld+json'>"), ld, F.lit("</script></head><body><p>x</p></body></html>"))
    return postings(spark, sf_dir).select(F.col("seq").alias("page_id"), "url", page.alias("html"))


@query("a18_raw_from_jsonld_page", f"{P} SELECT seq AS page_id, title, company, location, employment_type, posted, url AS position_url FROM p")
def _(spark, sf_dir):
    return ats.raw_from_jsonld_page(ld_pages(spark, sf_dir), "eightfold").select("page_id", "title", "company", "location", "employment_type", "posted", "position_url")


#: board, entry of its listing, what is around the entries, slug, SQL of the URL.
BOARDS = [
    ("eightfold", {"positionUrl": "CASE WHEN seq % 2 = 0 THEN '/careers/job/' || seq ELSE url END"}, '{"data": {"count": 1, "positions": %s}}', "acme", f"CASE WHEN seq % 2 = 0 THEN 'https://acme.eightfold.ai/careers/job/' || {id_} ELSE url END"),
    ("lever", {"hostedUrl": "url"}, "%s", "acme", "url"), ("ashby", {"jobUrl": "url"}, '{"jobs": %s}', "acme", "url"), ("greenhouse", {"absolute_url": "url"}, '{"jobs": %s}', "acme", "url"), ("smartrecruiters", {"ref": "url"}, '{"content": %s}', "acme", "url"),
    ("workday", {"externalPath": "'/' || seq"}, '{"jobPostings": %s}', "a:wd1:s", f"'https://a.wd1.myworkdayjobs.com/s/job/' || {id_}"), ("teamtailor", {"url": "url"}, '{"items": %s}', "acme", "url"),
    ("recruitee", {"careers_url": "CASE WHEN seq % 2 = 0 THEN 'https://c.acme.com/o/' || seq END", "url": "url"}, '{"offers": %s}', "acme", f"CASE WHEN seq % 2 = 0 THEN 'https://c.acme.com/o/' || {id_} ELSE url END"),
    ("workable", {"shortcode": "seq"}, '{"jobs": %s}', "acme", f"'https://apply.workable.com/acme/j/' || {id_} || '/'"), ("breezy", {"url": "url"}, "%s", "acme", "url"),
    ("pinpoint", {"url": "CASE WHEN seq % 2 = 0 THEN url END", "absolute_url": "'https://p.acme.com/' || seq"}, '{"data": %s}', "acme", f"CASE WHEN seq % 2 = 0 THEN url ELSE 'https://p.acme.com/' || {id_} END"),
    ("rippling", {"id": "seq"}, '{"jobs": %s}', "acme", f"'https://ats.rippling.com/acme/jobs/' || {id_}"), ("join", {"idParam": "seq"}, '{"items": %s}', "acme", f"'https://join.com/companies/acme/' || {id_}"),
]
MARKED = [("radancy", "concat('<a class=\"x search-results-list__job-link\" href=\"/en/job/', seq, '\">x</a>')", f"'https://careers.acme.com/en/job/' || {id_}"), ("personio", "concat('<position><id> ', seq, ' </id></position>')", f"'https://acme.jobs.personio.de/job/' || {id_}")]


@query("a19_discover_urls", f"{P} " + " UNION ALL ".join(f"SELECT DISTINCT '{b}' AS source, {url} AS url FROM p" for b, url in [(b[0], b[4]) for b in BOARDS] + [(b[0], b[2]) for b in MARKED]))
def _(spark, sf_dir):
    every = [landed(spark, sf_dir, entry, wrap, board).withColumn("slug", F.lit(slug)) for board, entry, wrap, slug, _ in BOARDS]
    for board, item, _ in MARKED:
        made = postings(spark, sf_dir).groupBy(F.expr(f"seq DIV {PAGE}").alias("page")).agg(F.array_join(F.collect_list(F.expr(item)), "").alias("payload"))
        every.append(made.select(F.lit(board).alias("source"), "payload", F.lit("careers.acme.com").alias("host"), F.lit("acme").alias("slug")))
    return ats.discover_urls(reduce(DataFrame.unionByName, every)).select("source", "url")


# --- pages ---


_UNESCAPED = lambda x: f"replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_PIECE = f"CASE WHEN regexp_matches(x, '^<script', 'i') THEN regexp_extract(x, '(?is)^<script[^>]*>(.*)</script', 1) WHEN starts_with(x, '<') THEN '' ELSE {_UNESCAPED('x')} END"


@query("d1_html_text", f"SELECT page_id, sha256(array_to_string(list_filter(list_transform(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script\\s*>|<!--.*?-->|<[^>]*>|[^<]+'), lambda x: {_PIECE}), lambda x: regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g')), lambda x: x <> ''), ' ')) AS text_sha256 FROM pages")
def _(spark, sf_dir):
    return apart(spread(table(spark, sf_dir, "pages")), "html").select("page_id", F.sha2(html.text_of(F.col("html"), F.lit(" "), page=True), 256).alias("text_sha256"))


@query("d2_parse_description", f"{P} SELECT seq, heading1 AS heading, CASE WHEN length({_LINE}) <= 2000 THEN {_LINE} ELSE '' END AS section, trim(heading1 || ' ' || {_LINE}) AS text FROM p")
def _(spark, sf_dir):
    made = html.pages_to_postings(ld_pages(spark, sf_dir))
    return made.select("seq", F.get("sections", F.lit(0))["heading"].alias("heading"), F.get("sections", F.lit(0))["text"].alias("section"), F.col("full_text").alias("text"))


@query("d3_split_sections")
def _(spark, sf_dir):
    made = html.pages_to_postings(apart(spread(table(spark, sf_dir, "pages")), "html"))
    return made.select("seq", F.posexplode("sections").alias("at", "s")).select("seq", "at", "s.heading", F.length("s.text").alias("chars"))


@query("d4_parse_json_ld", f"{P} SELECT seq, title, company, location, 'json-ld' AS via FROM p")
def _(spark, sf_dir):
    return html.pages_to_postings(ld_pages(spark, sf_dir)).select("seq", "title", "company", "location", "via")


@query("d5_parse_embedded_json", f"{P} SELECT seq, title, CASE WHEN seq % 2 = 1 THEN company END AS company, location, trim(heading1 || ' ' || {_LINE}) AS full_text, CASE WHEN seq % 2 = 0 THEN 'embedded-next-data' ELSE 'embedded-json' END AS via FROM p")
def _(spark, sf_dir):
    job = f"named_struct('title', title, 'locationName', location, 'descriptionHtml', {_DESCRIPTION})"
    nxt = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.expr(f"named_struct('props', named_struct('list', array({job})))")), F.lit("</script>"))
    app = F.concat(F.lit("<script>var a = {}; window.__appData = "), F.to_json(F.expr(f"named_struct('organization', named_struct('name', company), 'posting', {job})")), F.lit("; run({});</script>"))
    pages = postings(spark, sf_dir).select(F.col("seq").alias("page_id"), "url", F.when(F.col("seq") % 2 == 0, nxt).otherwise(app).alias("html"))
    return html.pages_to_postings(pages).select("seq", "title", "company", "location", "full_text", "via")


_VISIBLE = _UNESCAPED("regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)', 1), '(?is)<script.*?</script\\s*>|<style.*?</style\\s*>|<noscript.*?</noscript\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")
_WALL = "CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '<body[^>]*>', {}) ELSE html END"


@query("d6_looks_blocked", f"SELECT page_id, length(v) < 2000 AND {oracle.has('v', fixed.BLOCKED.replace('(?<!gre)', ''))} AS blocked FROM (SELECT page_id, trim(regexp_replace({_VISIBLE}, '[\\s\\x{{a0}}]+', ' ', 'g')) AS v FROM (SELECT page_id, {_WALL.format(repr('<body><h1>Verify you are human</h1>'))} AS html FROM pages))")
def _(spark, sf_dir):
    """Pages, of which each third has got a bot challenge in front."""
    pages = apart(spread(table(spark, sf_dir, "pages")), "html").withColumn("html", F.expr(_WALL.format("'<body><h1>Verify you are human</h1>'")))
    return html.pages_to_postings(pages).select(F.col("seq").alias("page_id"), text.looks_blocked(F.col("visible")).alias("blocked"))


@query("d8_pages_to_postings")
def _(spark, sf_dir):
    made = html.pages_to_postings(apart(spread(table(spark, sf_dir, "pages")), "html"))
    from ..operators.enrich import enrich_postings

    return enrich_postings(made, PROFILE, as_of()).select("seq", "title", "is_live", "score", "job_type", F.size("sections").alias("n_sections"), "full_text_chars", "error")


@query("j6_jsonl_rows", f"{oracle.CHAIN} SELECT rank, seq, score FROM k WHERE rank <= 100000000")
def _(spark, sf_dir):
    """The records that the JSON-lines sink writes, written and read back."""
    path = shared_path(spark, "jsonl")
    report.write_jsonl(report.rank_postings(enriched_table(spark, sf_dir, "seq", "score", "title")).select("rank", "seq", "score", "title"), path)
    return spark.read.schema("rank long, seq long, score int").json(path)


_DEDUPED = f"""{catalog._WATCH.replace('run AS (SELECT * FROM kk WHERE seq % 3 <> 1)', f"""fpr AS (SELECT seq AS fseq, fingerprint FROM ({catalog._FP} SELECT seq, fingerprint FROM fp)),
u AS (SELECT kk.*, {oracle.canon('url')} AS ck, fingerprint FROM kk JOIN fpr ON fseq = seq QUALIFY row_number() OVER (PARTITION BY ck ORDER BY seq) = 1),
dd AS (SELECT * FROM u QUALIFY failed OR company_key = '' OR title_key = '' OR row_number() OVER (PARTITION BY failed, company_key, title_key ORDER BY coalesce(score, -1) DESC, seq) = 1),
run AS (SELECT * FROM dd WHERE failed OR (NOT contains(lower(title), 'data') AND (age_days IS NULL OR age_days <= 400) AND score >= 45))""")}"""
_HISTORY = f"SELECT fingerprint, arg_min(url, seq) AS old_url FROM ({catalog._FP} SELECT seq, url, fingerprint FROM fp) WHERE seq % 4 = 1 AND fingerprint IS NOT NULL GROUP BY 1"
_APPLIED = f"{catalog._EVENTS} SELECT url, status FROM app"
_ROLES = f"{catalog._SWEEP} SELECT {oracle.canon('url')} AS k, arg_min(role, role_seq) AS role FROM h GROUP BY 1"


@query("j11_run_pipeline", f"""{_DEDUPED}, hist AS ({_HISTORY}), app AS ({_APPLIED}), roles AS ({_ROLES}), t AS (SELECT lower(url) AS line, {oracle.canon('lower(url)')} AS k FROM p WHERE seq % 50 = 3), lk AS (SELECT DISTINCT {oracle.canon('lower(url)')} AS k FROM run), tracked AS (SELECT k FROM t UNION SELECT lk.k FROM lk JOIN t ON contains(t.line, lk.k))
SELECT row_number() OVER (ORDER BY coalesce(score, -1) DESC, run.seq) AS rank, run.seq, run.title, run.company, score, error, CASE WHEN run.ck IS NOT NULL AND old_url <> run.url THEN old_url END AS repost_of_closed,
coalesce(NOT m.known AND m.first_seq = run.seq, FALSE) AS is_new, app.status AS application_status, roles.role AS search_role, CASE WHEN tracked.k IS NOT NULL THEN 'applied' END AS tracker_status
FROM run JOIN m ON m.key = run.key LEFT JOIN hist ON hist.fingerprint = run.fingerprint LEFT JOIN app ON app.url = run.ck LEFT JOIN roles ON roles.k = run.ck LEFT JOIN tracked ON tracked.k = {oracle.canon('lower(run.url)')}""")
def _(spark, sf_dir):
    """The flow with all steps on but the fuzzy one, which SQL cannot express; its state, history, statistics and counters are queries of their own."""
    raw = postings(spark, sf_dir)
    full = enriched_once(raw, PROFILE, as_of(), columns=[*catalog.KEYED, "url", "location", "age_days", "is_live", "fingerprint"])
    old = full.where("seq % 4 = 1").select("url", F.lit(1).cast("long").alias("rank"), "seq", "score", "title", F.lit(0).alias("live"), "fingerprint", F.lit("2024-05-01").cast("timestamp").alias("first_seen"), F.lit("2024-05-01").cast("timestamp").alias("last_seen"), F.lit(1).cast("long").alias("scrape_count"))
    tracker = raw.where("seq % 50 = 3").select(F.concat(F.lit("<"), "url", F.lit(">")).alias("line"))
    roles = cards_of.role_sweep(catalog.card_rows(spark, sf_dir), catalog.role_rows(spark))[0]
    run = run_flow(
        full, PROFILE, as_of(), enriched=True, least_score=45, reposts=True, tracker=tracker, watch=catalog._watch_before(spark, sf_dir), today=catalog.TODAY, history=old, applications=catalog.applications(spark, sf_dir), url_roles=roles,
        attempts=raw.select("url", F.lit(1.0).alias("duration_ms")), exclude_keywords="data", max_age=400,
    )
    return run.postings.select("rank", "seq", "title", "company", "score", "error", "repost_of_closed", "is_new", "application_status", "search_role", "tracker_status")


__all__ = ["run_flow"]
