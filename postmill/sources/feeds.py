"""Landed board feeds, one payload a row (source, payload, host, slug), to search cards.

JSON is read by schema in permissive mode: entries that don't fit come out null, a payload that is none gives no rows. XML feeds are cut into
items by pattern and their fields read one by one, so that one broken item spoils no other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import epoch_to_iso, has, let, posted_date, rx
from ..functions.urls import strip
from .html import text_of

CARD = ["source", "job_id", "title", "company", "location", "url", "posted_text", "tags", "description", "ats", "career_url", "work_mode", "thread", "pos"]


def url_list(lines: DataFrame) -> DataFrame:
    """(seq, url) of lines (seq, value): stripped, without blank lines and comments."""
    return lines.select("seq", strip(F.col("value")).alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Rows of all sources under one schema."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def known(c: Column) -> Column:
    """Stripped text, null if blank."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def entries(landed: DataFrame, element: str, at: str | None) -> DataFrame:
    """One row (j, pos, and what landed holds) per entry of the payload's array, or of the array under a key of it."""
    schema = f"array<{element}>" if at is None else f"struct<{at}:array<{element}>>"
    parsed = F.from_json("payload", schema)
    rows = landed.withColumn("all_", parsed if at is None else parsed[at])
    if at is None:  # a lone object is no list
        rows = rows.where(F.regexp_like(F.coalesce("payload", F.lit("")), F.lit(r"^\s*\[")))
    return rows.select("*", F.posexplode("all_").alias("pos", "j")).drop("all_", "payload").where("j IS NOT NULL")


def _cards(rows: DataFrame, source: str, fields: dict) -> DataFrame:
    blank = {"tags": F.array().cast("array<string>")}
    value = lambda c: fields[c] if c in fields else F.lit(source) if c == "source" else F.col("pos") if c == "pos" else blank.get(c, F.lit(None).cast("string"))
    return rows.select(*[value(c).alias(c) for c in CARD])


def _id(source: str, first: Column, second: Column) -> Column:
    return F.concat(F.lit(f"{source}:"), F.coalesce(known(first), second.cast("string"), F.lit("")))


def _tags(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])


j = lambda path: F.col(f"j.{path}")


def cards_remoteok(landed: DataFrame) -> DataFrame:
    rows = entries(landed, "struct<id:string,position:string,company:string,location:string,date:string,tags:array<string>,url:string>", None).where("j.position IS NOT NULL")
    url = F.when(j("url").startswith("/"), F.concat(F.lit("https://remoteok.com"), j("url"))).otherwise(F.nullif(j("url"), F.lit("")))
    return _cards(rows, "remoteok", {"job_id": _id("remoteok", j("id"), url), "title": known(j("position")), "company": known(j("company")), "location": F.coalesce(known(j("location")), F.lit("Remote")), "url": url, "posted_text": known(j("date")), "tags": _tags(j("tags"))})


def cards_remotive(landed: DataFrame) -> DataFrame:
    rows = entries(landed, "struct<id:string,title:string,company_name:string,candidate_required_location:string,publication_date:string,tags:array<string>,url:string>", "jobs")
    return _cards(rows, "remotive", {"job_id": _id("remotive", j("id"), j("url")), "title": known(j("title")), "company": known(j("company_name")), "location": F.coalesce(known(j("candidate_required_location")), F.lit("Remote")), "url": known(j("url")), "posted_text": known(j("publication_date")), "tags": _tags(j("tags"))})


def cards_workingnomads(landed: DataFrame) -> DataFrame:
    rows = entries(landed, "struct<title:string,company_name:string,location:string,pub_date:string,tags:array<string>,url:string>", None)
    number = F.nullif(F.regexp_extract(F.coalesce(known(j("url")), F.lit("")), r"/job/go/(\d+)", 1), F.lit(""))
    return _cards(rows, "workingnomads", {"job_id": _id("workingnomads", number, known(j("url"))), "title": known(j("title")), "company": known(j("company_name")), "location": F.coalesce(known(j("location")), F.lit("Remote")), "url": known(j("url")), "posted_text": known(j("pub_date")), "tags": _tags(j("tags"))})


def cards_arbeitnow(landed: DataFrame) -> DataFrame:
    rows = entries(landed, "struct<slug:string,title:string,company_name:string,location:string,remote:boolean,created_at:string,tags:array<string>,job_types:array<string>,url:string>", "data")
    place = known(j("location"))
    place = F.when(F.coalesce(j("remote"), F.lit(False)) & place.isNotNull(), F.concat(place, F.lit(" (Remote)"))).otherwise(F.coalesce(place, F.lit("Remote")))
    return _cards(rows, "arbeitnow", {"job_id": _id("arbeitnow", j("url"), j("slug")), "title": known(j("title")), "company": known(j("company_name")), "location": place, "url": known(j("url")), "posted_text": epoch_to_iso(j("created_at")), "tags": _tags(j("tags"), j("job_types"))})


def cards_himalayas(landed: DataFrame) -> DataFrame:
    rows = entries(landed, "struct<title:string,companyName:string,companySlug:string,applicationLink:string,guid:string,locationRestrictions:array<string>,categories:array<string>,pubDate:string>", "jobs")
    url = F.coalesce(known(j("applicationLink")), known(j("guid")))
    place = F.nullif(F.array_join(F.coalesce(j("locationRestrictions"), F.array().cast("array<string>")), ", "), F.lit(""))
    return _cards(rows, "himalayas", {"job_id": _id("himalayas", url, j("companySlug")), "title": known(j("title")), "company": known(j("companyName")), "location": F.coalesce(place, F.lit("Remote")), "url": url, "posted_text": epoch_to_iso(j("pubDate")), "tags": _tags(j("categories"))})


def cards_workable(landed: DataFrame) -> DataFrame:
    rows = entries(landed, "struct<id:string,title:string,department:string,employmentType:string,workplace:string,url:string,created:string,locations:array<string>,location:struct<city:string,subregion:string,countryName:string,country:string>,company:struct<title:string>>", "jobs")
    parts = F.concat_ws(", ", known(j("location.city")), known(j("location.subregion")), known(F.coalesce(F.nullif(j("location.countryName"), F.lit("")), j("location.country"))))
    place = F.coalesce(known(F.get(j("locations"), F.lit(0))), F.nullif(parts, F.lit("")))
    return _cards(rows, "workable", {"job_id": _id("workable", j("id"), j("url")), "title": known(j("title")), "company": known(j("company.title")), "location": place, "url": known(j("url")), "posted_text": known(j("created")), "tags": F.array_compact(F.array(known(j("department")), known(j("employmentType")), known(j("workplace"))))})


def cards_themuse(landed: DataFrame) -> DataFrame:
    name = "array<struct<name:string>>"
    rows = entries(landed, f"struct<id:string,name:string,company:struct<name:string>,locations:{name},levels:{name},categories:{name},refs:struct<landing_page:string>,publication_date:string,contents:string>", "results")
    named = lambda c: F.array_compact(F.transform(F.coalesce(c, F.array().cast(name)), lambda x: known(x["name"])))
    return _cards(rows, "themuse", {"job_id": _id("themuse", j("id"), j("refs.landing_page")), "title": known(j("name")), "company": known(j("company.name")), "location": F.nullif(F.array_join(named(j("locations")), ", "), F.lit("")), "url": known(j("refs.landing_page")), "posted_text": known(j("publication_date")), "tags": _tags(named(j("levels")), named(j("categories"))), "description": text_of(j("contents"), F.lit(" "))})


def cards_freehire(landed: DataFrame) -> DataFrame:
    rows = entries(landed, "struct<public_slug:string,source:string,url:string,title:string,company:string,location:string,posted_at:string,description:string,skills:array<string>,work_mode:string>", "data").where(known(j("public_slug")).isNotNull() & known(j("title")).isNotNull())
    slug = known(j("public_slug"))
    return _cards(rows, "freehire", {"job_id": F.concat(F.lit("freehire:"), slug), "title": known(j("title")), "company": known(j("company")), "location": known(j("location")), "url": F.concat(F.lit("https://freehire.me/jobs/"), slug), "posted_text": posted_date(j("posted_at")), "description": text_of(j("description"), F.lit("\n")), "tags": F.array_compact(F.transform(F.coalesce(j("skills"), F.array().cast("array<string>")), known)), "ats": known(j("source")), "career_url": known(j("url")), "work_mode": known(j("work_mode"))})


# XML feeds


def _items(landed: DataFrame) -> DataFrame:
    items = F.regexp_extract_all("payload", F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), F.lit(1))
    return landed.where(F.regexp_like("payload", F.lit(r"(?s)<item[\s>].*</(rss|channel)>"))).select("*", F.posexplode(items).alias("pos", "item")).drop("payload")


def _unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _field(name: str) -> Column:
    raw = F.regexp_extract("item", rf"(?s)<(?:{name})(?:\s[^>]*)?>(.*?)</(?:{name})>", 1)
    plain = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", 1)
    return F.when(F.regexp_like(raw, F.lit(r"(?s)^\s*<!\[CDATA\[")), plain).otherwise(_unescape(raw))


def cards_wwr(landed: DataFrame) -> DataFrame:
    """Titles read 'Company: Title'; one without a colon is company and title both."""
    raw = F.coalesce(_field("title"), F.lit(""))
    title = F.coalesce(known(F.regexp_extract(raw, r"(?s)^[^:]*:(.*)$", 1)), strip(raw))
    link = known(_field("link"))
    return _cards(_items(landed), "weworkremotely", {"job_id": _id("weworkremotely", link, title), "title": known(title), "company": known(F.substring_index(raw, ":", 1)), "location": F.lit("Remote"), "url": link, "posted_text": strip(_field("pubDate")), "tags": F.array_compact(F.array(known(_field("category"))))})


def cards_jobicy(landed: DataFrame) -> DataFrame:
    own = lambda n: known(_field(rf"[\w.-]+:{n}"))
    link = known(_field("link"))
    return _cards(_items(landed), "jobicy", {"job_id": _id("jobicy", link, _field("title")), "title": known(_field("title")), "company": own("company"), "location": F.coalesce(own("location"), F.lit("Remote")), "url": link, "posted_text": known(_field("pubDate")), "tags": F.array_compact(F.array(own("category"), own("job_type")))})


# Hacker News threads

MIN_COMMENT_CHARS = 40
URL_LIKE = r"^(https?://|www\.)\S+$"
JOB_TYPE_TOKEN = r"^(full[\s-]?time|part[\s-]?time|contract(or)?|intern(ship)?s?|remote ok|visa|onsite ok)$"


def hn_pick_thread(landed: DataFrame, month: str, page: str | None = None) -> DataFrame:
    """(story_id, title, created_at): the thread '(month)', for example 'May 2024', else the first one that asks who is hiring.

    page: the column of landed that orders its payloads, where the hits lie in several."""
    hits = entries(landed, "struct<objectID:string,title:string,created_at:string>", "hits")
    rows = hits.withColumn("other", ~F.contains(F.coalesce(j("title"), F.lit("")), F.lit(f"({month})"))).where(~F.col("other") | F.contains(F.lower(j("title")), F.lit("who is hiring")))
    return rows.groupBy().agg(F.min_by("j", F.struct("other", *([page] if page else []), "pos")).alias("j")).where("j IS NOT NULL").select(j("objectID").alias("story_id"), j("title").alias("title"), j("created_at").alias("created_at"))


def cards_hn(comments: DataFrame, thread_title: str | None = None, created_at: str | None = None) -> DataFrame:
    """Cards of comments (id, text, deleted, dead): their first line is split by | or by a spaced dash into company, title and places."""
    gone = F.coalesce("deleted", F.lit(False)) | F.coalesce("dead", F.lit(False)) | (F.coalesce("text", F.lit("")) == "")
    rows = comments.where(~gone).withColumn("body", text_of(F.col("text"), F.lit("\n"))).where(F.length("body") >= MIN_COMMENT_CHARS)
    header = strip(F.get(F.filter(F.split("body", "\n"), lambda x: strip(x) != ""), F.lit(0)))
    rows = rows.withColumn("header", header).where(~F.lower("header").startswith("please ") & ~F.contains(F.lower("header"), F.lit("who is hiring")))
    parts = F.when(F.contains("header", F.lit("|")), F.split("header", r"\|")).when(F.regexp_like("header", F.lit(" [—–] ")), F.split("header", r"(?U)\s+[—–]\s+")).otherwise(F.array("header"))

    def fields(p: Column) -> Column:
        p = F.transform(p, strip)
        title = F.when(F.size(p) > 1, F.when(~has(F.get(p, F.lit(1)), URL_LIKE), F.nullif(F.get(p, F.lit(1)), F.lit(""))))
        bits = F.filter(F.slice(p, 3, 1000), lambda x: (x != "") & ~F.regexp_like(x, rx(JOB_TYPE_TOKEN)) & ~F.regexp_like(x, rx(URL_LIKE)))
        place = F.nullif(F.array_join(bits, ", "), F.lit(""))
        company = F.nullif(F.get(p, F.lit(0)), F.lit(""))
        return F.struct(company.alias("company"), F.coalesce(title, F.concat_ws(" — ", company, place)).alias("title"), place.alias("place"))

    rows = rows.withColumn("f", let(parts, fields)).withColumn("pos", F.col("id"))
    return _cards(rows, "hn_whoishiring", {"job_id": F.concat(F.lit("hn:"), F.col("id").cast("string")), "title": F.col("f.title"), "company": F.col("f.company"), "location": F.col("f.place"), "url": F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string")), "posted_text": F.lit(created_at), "description": F.col("body"), "thread": F.lit(thread_title)})


def cards_to_postings(cards: DataFrame) -> DataFrame:
    """Cards that hold a whole body as postings with one section 'Description'."""
    notes = F.array_compact(F.array(F.when(F.col("ats").isNotNull(), F.concat(F.lit("ats: "), "ats")), F.when(F.col("career_url").isNotNull(), F.concat(F.lit("apply: "), "career_url"))))
    return cards.where("description IS NOT NULL").select(
        F.col("pos").cast("long").alias("seq"), "source", "url", "title", "company", "location", F.lit(None).cast("string").alias("employment_type"), F.array().cast("array<string>").alias("raw_types"), F.col("posted_text").alias("posted"),
        F.array(F.struct(F.lit("Description").alias("heading"), F.col("description").alias("text"))).alias("sections"), F.col("description").alias("full_text"), F.lit(None).cast("string").alias("error"), notes.alias("fetch_notes"),
    )
