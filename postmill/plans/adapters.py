"""Postings and cards derived from the tables `documents`, `events` and `pages` by SQL that Spark and DuckDB both read.

The tables hold no job vocabulary, so titles, places, dates and phrases are picked by the document's id; bodies are whole texts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import spread

AS_OF = "2024-06-15 12:00:00"


def pick(key: str, values: list) -> str:
    """CASE over key modulo the number of values."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN {quote(v)}" for k, v in enumerate(values)) + " END"


PREFIX = ["", "Senior ", "Junior ", "Lead ", "Staff ", "Sr. ", "Principal ", "Intern, ", "Head of "]
ROLE = ["Security Engineer", "Detection Engineer", "SOC Analyst", "Incident Response Analyst", "Data Engineer", "Cloud Security Engineer", "Threat Hunter", "Product Security Engineer", "Backend Developer", "Splunk Engineer", "Engineering Manager", "DevSecOps Engineer"]
SUFFIX = ["", " II", " (Nights)", " - Remote", " / Platform"]
PLACE = ["Berlin, Germany", "Remote", "London, UK", None, "Bengaluru, India", "New York, USA"]
KIND = ["FULL_TIME", "Part-time", "Contractor, Full-time", None, "Permanent", "internship", "weird value", "Fixed-Term"]
POSTED = ["2024-05-01", "3 days ago", "2 weeks ago", "yesterday", "2024-05-01T10:00:00Z", "12 Mar 2024", "Just posted", None, "seen on 2023-11-05 here", "5 hours ago", "Jan 2, 2024", "2024/02/03"]
YEARS = ["3-5 years of experience required.", "8+ years experience.", "10 yrs of experience", "", "At least 2 years of exp.", "No experience required.", "12+ years in people management"]
SALARY = ["Salary $120,000 per year.", "€60,000 k", "25 LPA", "£45,000", "$50/hr", "", "₹12,00,000 per annum", "$90,000 and $95,000"]
SKILL = ["Splunk, SIEM and Python.", "AWS, Terraform and Kubernetes", "MITRE ATT&CK and threat hunting", "ISO 27001, CISSP", "", "Security+ with CI/CD and Kibana"]
SIGNAL = ["Visa sponsorship available.", "Fluent German required: German must be fluent", "Hybrid, remote or on-site.", "", "Work from home", "Deutschkenntnisse von Vorteil"]
CLOSED = ["", "", "", "This job is no longer available.", "", "", "", "The position has been filled", "", "", ""]
HEADING = ["Requirements", "Deine Aufgaben", "Nice to have", "Vos missions", "Beneficios", "What we offer", "Random", "Dein Profil", "Bonus"]
HOST = ["https://jobs.lever.co/acme", "https://jobs.ashbyhq.com/acme", "https://boards.greenhouse.io/acme", "https://Example.com:443/careers", "https://careers.acme.com/en/job/berlin/engineer/33", "http://www.linkedin.com/jobs", "https://acme.breezy.hr", "https://remoteok.com"]
TAIL = ["", "?utm_source=x&ref=abc", "/", "?b=2&a=1#top", "?gclid=1&q=a+b%20c"]
FAULT = ["HTTP 404", "timeout after 30 s", "blocked"]

POSTINGS = f"""
SELECT d.doc_id AS seq, d.source AS origin,
  {pick('d.doc_id', HOST)} || '/' || CAST(d.doc_id - d.doc_id % 3 AS STRING) || {pick('d.doc_id', TAIL)} AS url,
  {pick('d.doc_id', PREFIX)} || {pick('d.doc_id', ROLE)} || {pick('d.doc_id', SUFFIX)} AS title,
  CASE WHEN d.doc_id % 41 = 0 THEN NULL ELSE 'Company ' || d.source || {pick('d.doc_id', ['', ', Inc.', ' GmbH'])} END AS company,
  {pick('d.doc_id', PLACE)} AS location, {pick('d.doc_id', KIND)} AS employment_type, {pick('d.doc_id', POSTED)} AS posted,
  {pick('d.doc_id', HEADING)} AS heading1, {pick('d.doc_id + 4', HEADING)} AS heading2,
  {pick('d.doc_id', YEARS)} || ' ' || {pick('d.doc_id', SALARY)} || ' ' || {pick('d.doc_id', SKILL)} || ' ' || {pick('d.doc_id', SIGNAL)} || ' ' || {pick('d.doc_id', CLOSED)} AS text1,
  coalesce(d.text, '') AS text2, CASE WHEN d.doc_id % 37 = 0 THEN {pick('d.doc_id', FAULT)} END AS error
FROM documents d
"""
FULL_TEXT = "text1 || ' ' || text2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings: one row per document."""
    made = spark.sql(POSTINGS.replace("FROM documents d", "FROM {documents} d"), documents=spread(table(spark, sf_dir, "documents")))
    section = lambda k: F.struct(F.col(f"heading{k}").alias("heading"), F.col(f"text{k}").alias("text"))
    return made.withColumn("sections", F.array(section(1), section(2))).withColumn("full_text", F.expr(FULL_TEXT)).withColumn("raw_types", F.array("employment_type"))


def as_of():
    return F.lit(AS_OF).cast("timestamp")
