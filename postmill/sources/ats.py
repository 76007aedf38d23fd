"""Payloads of applicant-tracking systems to raw postings, and board listings to posting URLs.

A detail payload gives one raw posting, a feed as many as it has: feeds are exploded once and joined by id or URL where a list is given,
never read again for each URL. Landed rows are (source, payload, host, slug)."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import canonicalize_url, strip
from .feeds import entries, known
from .html import json_ld_posting, parse, read_rows

RAW = ["title", "company", "location", "employment_type", "department", "description_html", "posted", "salary_hits_extra", "position_url", "item_id", "source"]


def _raw(rows: DataFrame, source: str, fields: dict) -> DataFrame:
    blank = F.array().cast("array<string>")
    value = lambda c: F.lit(source) if c == "source" else fields.get(c, blank if c == "salary_hits_extra" else F.lit(None).cast("string"))
    return rows.select("host", "slug", *[value(c).alias(c) for c in RAW])


def _detail(landed: DataFrame, schema: str) -> DataFrame:
    return landed.withColumn("j", F.from_json("payload", schema)).where("j IS NOT NULL")


j = lambda path: F.col(f"j.{path}")
said = lambda c: F.nullif(c, F.lit(""))


def raw_lever(landed: DataFrame) -> DataFrame:
    rows = _detail(landed, "struct<id:string,text:string,company:string,location:string,categories:struct<commitment:string,department:string,location:string>,description:string,createdAt:string>").where("j.text IS NOT NULL")
    return _raw(rows, "lever-api", {"title": j("text"), "company": F.coalesce(j("company"), F.lit("")), "location": F.coalesce(said(j("location")), j("categories.location")), "employment_type": j("categories.commitment"), "department": j("categories.department"), "description_html": F.coalesce(j("description"), F.lit("")), "posted": j("createdAt"), "item_id": j("id")})


def raw_ashby(landed: DataFrame) -> DataFrame:
    """The place may be a text or an object with a name."""
    rows = _detail(landed, "struct<title:string,organizationName:string,location:string,employmentType:string,departmentName:string,descriptionHtml:string,compensationTierSummary:string,publishedAt:string>").where("j.title IS NOT NULL")
    place = F.when(j("location").startswith("{"), F.get_json_object(j("location"), "$.name")).otherwise(j("location"))
    return _raw(rows, "ashby-api", {"title": j("title"), "company": j("organizationName"), "location": place, "employment_type": j("employmentType"), "department": j("departmentName"), "description_html": F.coalesce(j("descriptionHtml"), F.lit("")), "posted": j("publishedAt")})


def raw_greenhouse(landed: DataFrame) -> DataFrame:
    name = "struct<name:string>"
    rows = _detail(landed, f"struct<id:string,title:string,company:{name},location:{name},offices:array<{name}>,departments:array<{name}>,metadata:array<struct<value:string>>,content:string,updated_at:string>").where("j.title IS NOT NULL")
    named = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast(f"array<{name}>")), lambda x: F.coalesce(x["name"], F.lit(""))), ", ")
    return _raw(rows, "greenhouse-api", {"title": j("title"), "company": j("company.name"), "location": F.coalesce(said(j("location.name")), named(j("offices"))), "employment_type": F.get(j("metadata.value"), F.lit(0)), "department": named(j("departments")), "description_html": F.coalesce(j("content"), F.lit("")), "posted": j("updated_at"), "item_id": j("id")})


def raw_smartrecruiters(landed: DataFrame) -> DataFrame:
    rows = _detail(landed, "struct<id:string,name:string,company:struct<name:string>,location:struct<city:string,country:string>,employmentType:struct<label:string>,department:struct<label:string>,jobAd:struct<sections:struct<jobDescription:struct<text:string>>>,releasedDate:string>").where("j.name IS NOT NULL")
    return _raw(rows, "smartrecruiters-api", {"title": j("name"), "company": j("company.name"), "location": said(F.concat_ws(", ", said(j("location.city")), said(j("location.country")))), "employment_type": j("employmentType.label"), "department": j("department.label"), "description_html": F.coalesce(j("jobAd.sections.jobDescription.text"), F.lit("")), "posted": j("releasedDate"), "item_id": j("id")})


def raw_workday(landed: DataFrame) -> DataFrame:
    rows = _detail(landed, "struct<jobPostingInfo:struct<id:string,title:string,location:string,timeType:string,jobDescription:string,postedOn:string,startDate:string>>").where("j.jobPostingInfo IS NOT NULL")
    info = lambda k: j(f"jobPostingInfo.{k}")
    return _raw(rows, "workday-api", {"title": info("title"), "company": F.col("slug"), "location": F.coalesce(info("location"), F.lit("")), "employment_type": info("timeType"), "description_html": F.coalesce(info("jobDescription"), F.lit("")), "posted": F.coalesce(said(info("postedOn")), info("startDate")), "item_id": info("id")})


def raw_teamtailor(landed: DataFrame) -> DataFrame:
    pay = "struct<currency:string,value:struct<minValue:string,maxValue:string>>"
    rows = entries(landed, f"struct<id:string,title:string,url:string,content_html:string,date_published:string,_jobposting:struct<identifier:struct<value:string>,baseSalary:{pay}>>", "items")
    value = lambda k: F.coalesce(j(f"_jobposting.baseSalary.value.{k}"), F.lit(""))
    band = F.concat(F.coalesce(j("_jobposting.baseSalary.currency"), F.lit("")), F.lit(" "), value("minValue"), F.lit("-"), value("maxValue"))
    extra = F.when((value("minValue") != "") | (value("maxValue") != ""), F.array(band)).otherwise(F.array().cast("array<string>"))
    return _raw(rows, "teamtailor-feed", {"title": j("title"), "company": F.substring_index("host", ".", 1), "description_html": F.coalesce(j("content_html"), F.lit("")), "posted": j("date_published"), "salary_hits_extra": extra, "position_url": j("url"), "item_id": F.coalesce(j("id"), j("_jobposting.identifier.value"))})


def raw_personio(landed: DataFrame) -> DataFrame:
    item = F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?s)<position(?:\s[^>]*)?>(.*?)</position>"), F.lit(1))).alias("pos", "item")
    rows = landed.select("*", item).drop("payload")
    field = lambda name: known(F.regexp_extract("item", rf"(?s)<{name}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1))
    values = F.regexp_extract_all("item", F.lit(r"(?s)<value>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</value>"), F.lit(1))
    return _raw(rows, "personio-xml", {"title": F.coalesce(field("name"), F.lit("")), "company": F.col("slug"), "location": field("office"), "employment_type": field("employmentType"), "department": field("department"), "description_html": F.array_join(F.filter(values, lambda v: v != ""), "\n"), "posted": field("createdAt"), "item_id": field("id")})


def raw_recruitee(landed: DataFrame) -> DataFrame:
    rows = entries(landed, "struct<id:string,title:string,location:string,employment_type:string,department:string,description:string,created_at:string,published_at:string,careers_url:string,url:string>", "offers")
    return _raw(rows, "recruitee-api", {"title": j("title"), "company": F.col("slug"), "location": j("location"), "employment_type": j("employment_type"), "department": j("department"), "description_html": F.coalesce(j("description"), F.lit("")), "posted": F.coalesce(said(j("created_at")), j("published_at")), "position_url": F.coalesce(said(j("careers_url")), j("url")), "item_id": j("id")})


def raw_workable_widget(landed: DataFrame) -> DataFrame:
    rows = entries(landed, "struct<id:string,shortcode:string,title:string,location:string,employment_type:string,department:string,description:string,published:string,created_at:string>", "jobs")
    place = F.when(j("location").startswith("{"), F.get_json_object(j("location"), "$.location_str")).otherwise(j("location"))
    url = F.when(said(j("shortcode")).isNotNull(), F.concat(F.lit("https://apply.workable.com/"), "slug", F.lit("/j/"), j("shortcode"), F.lit("/")))
    return _raw(rows, "workable-api", {"title": j("title"), "company": F.col("slug"), "location": place, "employment_type": j("employment_type"), "department": j("department"), "description_html": F.coalesce(j("description"), F.lit("")), "posted": F.coalesce(said(j("published")), j("created_at")), "position_url": url, "item_id": F.coalesce(said(j("shortcode")), j("id"))})


def raw_breezy(landed: DataFrame) -> DataFrame:
    """The feed has no bodies; they come from the pages."""
    rows = entries(landed, "struct<id:string,name:string,url:string,location:string,type:string,published_date:string>", None)
    either = lambda c: F.when(j(c).startswith("{"), F.get_json_object(j(c), "$.name")).otherwise(j(c))
    return _raw(rows, "breezy-feed", {"title": j("name"), "company": F.col("slug"), "location": either("location"), "employment_type": either("type"), "description_html": F.lit(""), "posted": j("published_date"), "position_url": j("url"), "item_id": j("id")})


def raw_pinpoint(landed: DataFrame) -> DataFrame:
    """Bodies with their headed parts; pay where it is shown."""
    parts = [("key_responsibilities", "Responsibilities"), ("skills_knowledge_expertise", "Skills & expertise"), ("benefits", "Benefits")]
    heads = ",".join(f"{p}:string,{p}_header:string" for p, _ in parts)
    rows = entries(landed, f"struct<id:string,title:string,url:string,description:string,{heads},location:struct<city:string,name:string>,workplace_type:string,employment_type_text:string,compensation_visible:boolean,compensation_minimum:bigint,compensation_maximum:bigint,compensation_currency:string,compensation_frequency:string>", "data")
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.coalesce(j("description"), F.lit(""))
    for part, head in parts:
        body = F.concat(body, F.when(known(j(part)).isNull(), "").otherwise(F.concat(F.lit("\n<h2>"), escaped(strip(F.coalesce(said(j(f"{part}_header")), F.lit(head)))), F.lit("</h2>\n"), known(j(part)))))
    place = F.when(F.lower(j("workplace_type")) == "remote", "Remote").otherwise(said(F.array_join(F.array_distinct(F.array_compact(F.array(known(j("location.name")), known(j("location.city"))))), ", ")))
    lo, hi = (F.when(j(f"compensation_{k}") != 0, j(f"compensation_{k}").cast("string")) for k in ("minimum", "maximum"))
    pay = F.when(F.coalesce(j("compensation_visible"), F.lit(False)) & F.coalesce(lo, hi).isNotNull(), F.concat_ws(" ", known(j("compensation_currency")), F.concat_ws("-", lo, hi), known(j("compensation_frequency"))))
    return _raw(rows, "pinpoint-feed", {"title": j("title"), "company": F.col("slug"), "location": place, "employment_type": j("employment_type_text"), "description_html": body, "salary_hits_extra": F.array_compact(F.array(pay)), "position_url": j("url"), "item_id": j("id")})


def raw_workable_view(landed: DataFrame) -> DataFrame:
    rows = _detail(landed, "struct<id:string,title:string,company:struct<title:string>,locations:array<string>,employmentType:string,department:string,description:string,requirementsSection:string,benefitsSection:string,created:string,url:string>").where("j.title IS NOT NULL")
    body = F.concat_ws("\n", said(j("description")), said(j("requirementsSection")), said(j("benefitsSection")))
    return _raw(rows, "workable-api", {"title": j("title"), "company": j("company.title"), "location": F.get(j("locations"), F.lit(0)), "employment_type": j("employmentType"), "department": j("department"), "description_html": body, "posted": j("created"), "position_url": j("url"), "item_id": j("id")})


def markdown_to_html(text: str | None) -> str:
    """Headings of two and three signs, bullets, bold, italic, links; all else is escaped paragraphs."""

    def inline(x: str) -> str:
        x = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", html.escape(x))
        x = re.sub(r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", r"<em>\1</em>", x)
        return re.sub(r"\[(.+?)\]\((https?://[^)\s]+)\)", r'<a href="\2">\1</a>', x)

    out, listed = [], False
    for line in (x.strip() for x in (text or "").splitlines()):
        bullet = line.startswith("* ")
        if bullet != listed:
            out.append("<ul>" if bullet else "</ul>")
            listed = bullet
        if bullet:
            out.append(f"<li>{inline(line[2:])}</li>")
        elif line:
            mark, tag = next(((m, t) for m, t in (("### ", "h4"), ("## ", "h3")) if line.startswith(m)), ("", "p"))
            out.append(f"<{tag}>{inline(line[len(mark):])}</{tag}>")
    return "\n".join(out + ["</ul>"] * listed)


@F.pandas_udf(T.StringType())
def _markdown(texts: pd.Series) -> pd.Series:
    return texts.map(markdown_to_html)


def raw_join(landed: DataFrame) -> DataFrame:
    name = "struct<name:string>"
    rows = _detail(landed, f"struct<id:string,idParam:string,title:string,company:{name},employmentType:{name},category:{name},city:struct<cityName:string>,country:{name},companyLocation:string,workplaceType:string,description:string,createdAt:string>").where("j.title IS NOT NULL")
    both, mode, country = said(F.concat_ws(", ", said(j("city.cityName")), said(j("country.name")))), F.upper(F.coalesce(j("workplaceType"), F.lit(""))), said(j("country.name"))
    place = F.when(mode == "REMOTE", F.concat_ws(", ", F.lit("Remote"), country)).otherwise(F.coalesce(F.when(mode == "HYBRID", F.concat(both, F.lit(" (Hybrid)"))).otherwise(both), said(j("companyLocation"))))
    return _raw(rows, "join-api", {"title": j("title"), "company": j("company.name"), "location": place, "employment_type": j("employmentType.name"), "department": j("category.name"), "description_html": _markdown(F.coalesce(j("description"), F.lit(""))), "posted": j("createdAt"), "item_id": j("idParam")})


def raw_from_jsonld_page(pages: DataFrame, source: str) -> DataFrame:
    """Raw postings of landed pages (page_id, url, html) that carry structured data."""
    names = ["title", "company", "location", "employment_type", "description_html", "posted"]
    schema = T.StructType().add("page_id", "long")
    for name in [*names, "position_url", "source"]:
        schema = schema.add(name, "string")

    def read(page: int, url: str | None, text: str | None):
        if found := json_ld_posting(parse(text)):
            yield {"page_id": page, **{n: None if found[n] is None else str(found[n]) for n in names}, "position_url": url, "source": source}

    return read_rows(pages.select("page_id", "url", "html"), read, schema)


def join_by_url(raw: DataFrame, urls: DataFrame) -> DataFrame:
    """Raw postings of a list (seq, url), by canonical URL."""
    wanted = urls.select("seq", canonicalize_url(F.col("url")).alias("k_"))
    return raw.where("position_url IS NOT NULL").join(wanted, canonicalize_url(F.col("position_url")) == F.col("k_")).drop("k_")


# listings to URLs


def discover_urls(landed: DataFrame) -> DataFrame:
    """(source, host, slug, url, pos) of landed listings: each board's own shape, first of each URL."""
    of = lambda s: landed.where(F.col("source") == s)
    made = lambda rows, source, url: rows.select(F.lit(source).alias("source"), "host", "slug", "pos", said(url).alias("url"))
    at = lambda source, element, key: entries(of(source), element, key)
    href = F.lit(r'(?i)<a\b[^>]*class="[^"]*search-results-list__job-link[^"]*"[^>]*>')
    anchors = of("radancy").select("*", F.posexplode(F.regexp_extract_all("payload", href, F.lit(0))).alias("pos", "a"))
    link = F.regexp_extract("a", r'href="([^"]+)"', 1)
    personio = of("personio").select("*", F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?s)<position>.*?<id>\s*(\d+)\s*</id>"), F.lit(1))).alias("pos", "id"))
    path = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^/+", "")
    site = F.split("slug", ":")
    eight = F.when(j("positionUrl").startswith("http"), j("positionUrl")).when(said(j("positionUrl")).isNotNull(), F.concat(F.lit("https://"), "slug", F.lit(".eightfold.ai"), j("positionUrl")))
    board = of("eightfold").withColumn("payload", F.get_json_object("payload", "$.data.positions"))
    parts = [
        made(entries(board, "struct<positionUrl:string>", None), "eightfold", eight),
        made(at("lever", "struct<hostedUrl:string>", None), "lever", j("hostedUrl")), made(at("ashby", "struct<jobUrl:string>", "jobs"), "ashby", j("jobUrl")), made(at("greenhouse", "struct<absolute_url:string>", "jobs"), "greenhouse", j("absolute_url")),
        made(at("smartrecruiters", "struct<ref:string>", "content"), "smartrecruiters", j("ref")),
        made(at("workday", "struct<externalPath:string>", "jobPostings"), "workday", F.when(path(j("externalPath")) != "", F.concat(F.lit("https://"), F.get(site, F.lit(0)), F.lit("."), F.get(site, F.lit(1)), F.lit(".myworkdayjobs.com/"), F.get(site, F.lit(2)), F.lit("/job/"), path(j("externalPath"))))),
        made(at("teamtailor", "struct<url:string>", "items"), "teamtailor", j("url")), made(personio, "personio", F.concat(F.lit("https://"), "slug", F.lit(".jobs.personio.de/job/"), "id")),
        made(at("recruitee", "struct<careers_url:string,url:string>", "offers"), "recruitee", F.coalesce(said(j("careers_url")), j("url"))),
        made(at("workable", "struct<shortcode:string>", "jobs"), "workable", F.concat(F.lit("https://apply.workable.com/"), "slug", F.lit("/j/"), said(j("shortcode")), F.lit("/"))),
        made(at("breezy", "struct<url:string>", None), "breezy", j("url")), made(at("pinpoint", "struct<url:string,absolute_url:string>", "data"), "pinpoint", F.coalesce(said(j("url")), j("absolute_url"))),
        made(at("rippling", "struct<id:string>", "jobs"), "rippling", F.concat(F.lit("https://ats.rippling.com/"), "slug", F.lit("/jobs/"), said(j("id")))),
        made(at("join", "struct<idParam:string>", "items"), "join", F.concat(F.lit("https://join.com/companies/"), "slug", F.lit("/"), said(j("idParam")))),
        made(anchors, "radancy", F.when(link.startswith("/"), F.concat(F.lit("https://"), "host", link)).otherwise(link)),
    ]
    from functools import reduce

    every = reduce(DataFrame.unionByName, parts).where("url IS NOT NULL")
    return every.groupBy("source", "host", "slug", "url").agg(F.min("pos").alias("pos"))
