"""Titles of a company that are alike: candidates from inverted indexes that lose no pair, then the similarity itself."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from .tables import materialise

WORD = re.compile("[a-z0-9]+")
#: From this length on difflib leaves out frequent characters, and the closed forms below are upper bounds only.
JUNK_CHARS = 200
#: For comparisons of sums of thresholds: a candidate more does no harm.
SLACK = 1e-6


def title_similarity(a: str | None, b: str | None) -> float:
    """How alike two titles are, from 0 to 1, by their sets of tokens; 1 if all tokens of one lie in the other.

    The shared tokens in order begin each title written as shared tokens, then the rest. Of a text and a beginning of it the ratio is known from their lengths,
    so only the two sorted titles are compared by difflib."""
    x, y = (set(WORD.findall((s or "").lower())) for s in (a, b))
    if not x or not y:
        return 0.0
    line = lambda tokens: " ".join(sorted(tokens))
    ratio = lambda p, q: difflib.SequenceMatcher(None, p, q).ratio()
    shared, titles = line(x & y), [line(x), line(y)]
    if max(map(len, titles)) < JUNK_CHARS:
        begins = [2.0 * len(shared) / (len(shared) + len(t)) for t in titles]
    else:
        begins = [ratio(shared, " ".join(filter(None, [shared, line(own - (x & y))]))) for own in (x, y)]
    return max(*begins, ratio(*titles))


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([title_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _prefixes(postings: DataFrame, key: str, keep: Column, order: list[str], sums: Column) -> DataFrame:
    """Postings (company_key, lo, key, ...) of each title's rarest keys: those for which keep holds of `before`, the sum over the rarer ones."""
    counts = postings.groupBy("company_key", key).agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("lo").orderBy("n", key, *order)
    known = postings.join(counts, ["company_key", key])
    return known.withColumn("before", F.sum(sums).over(rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - sums).where(keep)


def by_tokens(titles: DataFrame, threshold: float) -> DataFrame:
    """(lo, other): candidates for alike shared tokens.

    Shared tokens of length s make a pair alike if 2 s / (s + n) reaches the threshold for the shorter title's length n, so tokens that weigh more than (1 - c) n, c = threshold / (2 - threshold), can't all be missing:
    of the shorter title's rarest tokens above that weight one is shared. Those are looked up among all tokens of longer titles."""
    c = threshold / (2.0 - threshold)
    postings = titles.select("company_key", "lo", "chars", F.explode("tokens").alias("token"))
    weight = F.length("token") + 1
    probes = _prefixes(postings, "token", F.col("before") <= (1.0 - c) * F.col("chars") + SLACK, [], weight).where("n > 1")
    longer = postings.select("company_key", "token", F.col("lo").alias("other"), F.col("chars").alias("other_chars"))
    return probes.join(longer, ["company_key", "token"]).where("lo <> other AND chars <= other_chars").select("lo", "other")


def by_grams(titles: DataFrame, threshold: float) -> DataFrame:
    """(lo, other): candidates for alike lines of sorted tokens.

    A ratio of t leaves at least m = t (a + b) / 2 characters matched in order, for the shorter line's length a and the longer's b: b <= a (2 - t) / t, and at most 2 (a - m) + (b - m) pairs of adjacent
    characters of the shorter line are broken. So of its rarest pairs, one more than that, one stands in the longer line, moved by no more than the characters left out before it. A line with fewer pairs has
    to meet all lines of its length band."""
    band = (2.0 - threshold) / threshold
    broken = max(3.0 * (1.0 - threshold), 2.0 + band - 1.5 * threshold * (1.0 + band))
    most = F.floor(F.col("chars") * broken + SLACK)
    places = F.when(F.col("chars") > 1, F.transform(F.sequence(F.lit(1), F.col("chars") - 1), lambda p: F.struct(p.alias("at"), F.substring("line", p, F.lit(2)).alias("gram"))))
    every = titles.select("company_key", "lo", "chars", F.lit(0).alias("at"), F.lit("").alias("gram"))
    postings = titles.select("company_key", "lo", "chars", F.explode(places).alias("p")).select("company_key", "lo", "chars", "p.at", "p.gram")
    enough = most + 1 <= F.col("chars") - 1
    probes = _prefixes(postings.where(enough), "gram", F.col("before") <= most, ["at"], F.lit(1)).select(postings.columns).unionByName(every.where(~enough))
    longer = postings.unionByName(every).select("company_key", "gram", F.col("lo").alias("other"), F.col("chars").alias("other_chars"), F.col("at").alias("other_at"))
    matched = threshold / 2.0 * (F.col("chars") + F.col("other_chars"))
    moved = F.col("other_at") - F.col("at")
    near = (moved >= matched - F.col("chars") - SLACK) & (moved <= F.col("other_chars") - matched + SLACK)
    fits = (F.col("lo") != F.col("other")) & (F.col("chars") <= F.col("other_chars")) & (F.col("other_chars") <= band * F.col("chars") + SLACK) & ((F.col("gram") == "") | near)
    return probes.join(longer, ["company_key", "gram"]).where(fits).select("lo", "other")


def _begins(a: Column, b: Column, a_chars: Column, b_chars: Column) -> Column:
    """The similarity by shared tokens: exact below JUNK_CHARS, an upper bound from there on."""
    shared = F.aggregate(F.array_intersect(a, b), F.lit(-1), lambda n, t: n + F.length(t) + 1)
    share = lambda chars: 2.0 * F.greatest(shared, F.lit(0)) / (F.greatest(shared, F.lit(0)) + chars)
    return F.greatest(share(a_chars), share(b_chars))


def distinct_titles(df: DataFrame) -> DataFrame:
    """(company_key, title_key, lo, hi, tokens, line, chars): distinct titles with their first and last place; lo names a title."""
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("title_key"), F.lit("[a-z0-9]+"), F.lit(0))))
    titles = df.groupBy("company_key", "title_key").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).withColumn("tokens", tokens)
    return materialise(titles.withColumn("line", F.array_join("tokens", " ")).withColumn("chars", F.length("line")), "titles")


def alike(titles: DataFrame, threshold: float = fixed.FUZZY_THRESHOLD) -> DataFrame:
    """(company_key, a, b, a_lo, b_lo): pairs of titles that reach the threshold; in either order of appearance if both occur. A threshold of 0 is reached by any two titles: each is paired with its company's first.

    What shared tokens decide is decided by built-in expressions; of the rest, pairs whose edit distance rules them out never reach difflib."""
    if threshold <= 0:
        first = titles.groupBy("company_key").agg(F.min("lo").alias("a_lo"), F.min_by("title_key", "lo").alias("a"))
        return titles.join(first, "company_key").where("lo <> a_lo").select("company_key", "a", F.col("title_key").alias("b"), "a_lo", F.col("lo").alias("b_lo"))
    known = titles.where("chars > 0")
    found = by_tokens(known, threshold).unionByName(by_grams(known, threshold))
    pairs = found.select(F.least("lo", "other").alias("x_lo"), F.greatest("lo", "other").alias("y_lo")).distinct()
    for side in "xy":
        own = titles.select("company_key" if side == "x" else F.col("company_key").alias("same"), F.col("title_key").alias(side), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"), F.col("tokens").alias(f"{side}_tokens"), F.col("line").alias(f"{side}_line"), F.col("chars").alias(f"{side}_chars"))
        pairs = pairs.join(own, f"{side}_lo")
    begins = _begins(F.col("x_tokens"), F.col("y_tokens"), F.col("x_chars"), F.col("y_chars"))
    edits = F.expr(f"levenshtein(x_line, y_line, CAST({1.0 - threshold!r} * (x_chars + y_chars) + {SLACK!r} AS INT))")
    judged = pairs.withColumn("begins", begins).withColumn("sure", (F.col("begins") >= threshold) & (F.greatest("x_chars", "y_chars") < JUNK_CHARS))
    judged = judged.where(F.col("sure") | (F.col("begins") >= threshold) | (edits >= 0)).select("company_key", "x", "y", "x_lo", "y_lo", "x_hi", "sure")
    judged = materialise(judged, "judged")
    turned = judged.where("y_lo < x_hi").select("company_key", F.col("y").alias("a"), F.col("x").alias("b"), F.col("y_lo").alias("a_lo"), F.col("x_lo").alias("b_lo"), "sure")
    both = judged.select("company_key", F.col("x").alias("a"), F.col("y").alias("b"), F.col("x_lo").alias("a_lo"), F.col("y_lo").alias("b_lo"), "sure").unionByName(turned)
    asked = both.where("NOT sure").where(similarity_udf("a", "b") >= threshold)
    return both.where("sure").unionByName(asked).drop("sure")
