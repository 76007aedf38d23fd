"""The derived columns of a posting in one pass, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text


def enrich_postings(df: DataFrame, profile: dict | None, as_of: Column, extra_salary: str | None = None) -> DataFrame:
    """df (seq, url, title, company, location, employment_type, raw_types, posted, sections, full_text, error, ...) with everything read from its text.

    extra_salary: a column of further salary strings, put behind the hits after normalisation. No profile: no score. A posting known to be closed has none either."""
    full, low, profile_skills = F.col("full_text"), F.col("low_text"), (profile or {}).get("custom_skills", [])
    out = df.withColumn("low_text", text.folded(full)).withColumns({
        "job_type": text.normalize_job_type(F.col("raw_types"), F.col("title"), full, low), "age_days": text.posting_age_days(F.col("posted"), as_of),
        "skills_found": text.find_skills(full, profile_skills, low), "experience_years_mentioned": text.find_experience(full, low), "salary_hits": text.extract_salary(full, low),
        "signals": text.detect_signals(full, low), "live": text.check_liveness(full, low), "buckets": text.bucket_sections(F.col("sections")), "benefits": text.extract_benefits(F.col("sections")),
        "full_text_chars": F.length(full), "section_text": F.array_join(F.transform("sections", lambda s: F.substring(s["text"], 1, fixed.SECTION_CHARS)), " "),
    })
    out = out.withColumns({
        "inferred": text.infer_seniority(F.col("title"), full, F.col("experience_years_mentioned"), low), "salary_normalized": text.normalize_salary(F.col("salary_hits")),
        "is_live": F.col("live.is_live"), "live_reason": F.col("live.live_reason"), **{n: F.col(f"buckets.{n}") for n in ("requirements", "nice_to_have", "responsibilities")},
        "other_possibly_relevant": F.slice("buckets.other", 1, fixed.OTHER_KEPT), "sections": F.transform("sections", lambda s: F.struct(s["heading"].alias("heading"), F.substring(s["text"], 1, fixed.SECTION_CHARS).alias("text"))),
    })
    if extra_salary:
        out = out.withColumn("salary_hits", F.array_distinct(F.concat("salary_hits", F.filter(extra_salary, lambda x: x != ""))))
    out = out.withColumns({"seniority": F.col("inferred.level"), "seniority_evidence": F.col("inferred.evidence"), "seniority_confidence": F.col("inferred.confidence")})
    if profile is not None:
        fit = scoring.score(F.col("title"), F.col("location"), F.col("section_text"), F.col("skills_found"), F.col("experience_years_mentioned"), F.col("salary_hits"), profile)
        out = out.withColumn("match", F.when(F.coalesce("is_live", F.lit(True)) & (F.coalesce("error", F.lit("")) == ""), fit)).withColumn("score", F.col("match.total"))
    return out.drop("live", "buckets", "inferred", "section_text", "raw_types", "low_text")
