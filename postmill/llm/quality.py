"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

`metrics` measures a text once; THRESHOLDS is the table (name, metric, least, most, words from which it holds) and `verdict` turns it into one
Boolean expression. Nothing is shuffled and no user function runs. Repeated windows of eight words are found in the row itself: where all
window hashes are distinct (nearly always) that ends it, else hash and position are sorted and covered words counted, so the
work stays n log n for texts of any length. Window hashes have 64 bits.

Nulls: a null text has no words, hence fails the base rule. Empty tables, repeated rows and null ids pass through as rows; columns of
docs are kept by `apply_rules` but for those named like its results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, let

WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: Function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is was for on with as at by an be this are or it from a i you he she not have has had his her its they we "
    "le la les de des du et un une est que qui dans pour pas sur au aux en par ce il elle ne plus se son sa avec "
    "der die das und ist zu den von mit auf für dem ein eine nicht im es sich des auch el los las y por con para del su al lo como más o"
).split()
#: (reason, metric, least, most, holds from so many words). None: no bound on that side.
THRESHOLDS = [
    ("mean word length", "word_chars / n_words", 2.0, 12.0, 1),
    ("symbols a word", "n_symbols / n_words", None, 0.3, 1),
    ("stop-word ratio", "n_stop_words / n_words", 0.02, None, 50),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.5, 1),
]
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines"]
BASE_FAILED = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words"


def words_of(text: Column) -> Column:
    """Words of a text, in order."""
    body = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(body) > 0, F.split(body, SPACE)).otherwise(F.array().cast("array<string>"))


def _covered(words: Column) -> Column:
    """Words that lie in a window found more than once."""

    def count(hashes: Column) -> Column:
        def slow(ranked: Column) -> Column:
            twin = lambda x, i: (F.get(ranked, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(ranked, i + 1)["h"].eqNullSafe(x["h"]))
            places = F.sort_array(F.transform(F.filter(ranked, twin), lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), slow)
        )

    of_words = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hs, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(of_words, lambda hs: let(windows(hs), count)))


def metrics(text: Column) -> Column:
    """Struct of METRICS, all long."""
    full = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    of_words = let(words_of(full), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        _covered(w).cast("long").alias("n_repeat_words"), F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    ))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(full, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))


def rules_sql(table=THRESHOLDS) -> str:
    """The table as one condition that a good text meets, in SQL that DuckDB and Spark both read."""
    bounds = []
    for _, metric, least, most, words in table:
        top, _, below = metric.partition(" / ")
        value = f"CAST({top} AS DOUBLE) / greatest({below}, 1)"
        kept = " AND ".join(x for x in (least is not None and f"{value} >= {least}", most is not None and f"{value} <= {most}") if x)
        bounds.append(f"(n_words < {words} OR ({kept}))")
    return " AND ".join(bounds)


def apply_rules(docs: DataFrame, table=THRESHOLDS) -> DataFrame:
    """docs with METRICS, base_failed and kept."""
    results = [*METRICS, "base_failed", "kept"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (*results, "quality_metrics")]
    measured = docs.select(*own, metrics(F.col("text")).alias("quality_metrics"))
    place = {"n_symbols": "quality_metrics.n_symbols", "n_lines": "quality_metrics.l.n_lines", "n_dup_lines": "quality_metrics.l.n_dup_lines"}
    flat = measured.select(*own, *[F.col(place.get(m, f"quality_metrics.w.{m}")).alias(m) for m in METRICS])
    judged = flat.withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.withColumn("kept", ~F.col("base_failed") & F.expr(rules_sql(table)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') AS win FROM d, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(p)),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g),
v AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM r WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, len(ls) AS n_lines
  FROM d JOIN l USING (doc_id) LEFT JOIN v ON v.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND {rules_sql()} AS kept FROM m
"""
