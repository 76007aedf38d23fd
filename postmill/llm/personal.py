"""Personal data: candidates from high-recall generators, scored by boosted trees, cut off at calibrated thresholds.

Base spans come from one pattern a kind with its check (parts up to 255, 13 to 19 digits passing Luhn, 9 to 15 digits). Wider generators propose spans, which may overlap each other and the
base ones: addresses written with "at" and "dot", phone numbers without +, cards and IP addresses with other separators. A proposal gets binary features of its format and of its context.

Labels are made where nobody has to be asked. Every base span with the text around it is written anew in the forms that the generators look for: spelled out, bracketed, with other
separators, without + (GOOD), and into look-alikes such as lists of four numbers (BAD); the same generators and features run over these texts, and what they propose there is good or bad. All proposals on the documents
themselves that fail their kind's check, lie over a base span of another kind, or are cut out of a longer number are bad too, and stand for so many that pass the check by chance (CHANCE). The check itself is no
feature, so trees learn how personal data looks, and where it stands. Rows are counted by feature vector, and boosting over pairs of features (oblivious trees of depth two) runs on those counts. Half of them set,
for each kind, the least score whose precision reaches PRECISION. Proposals that pass the check, lie over no base span and reach that score are added; of two that overlap the one with the higher score stays, then that
of the kind first listed, then the first. Base spans always stay.

Everything on documents is built-in expressions: positions are sums of lengths of the pieces that `split` and `regexp_extract_all` leave.
Repetitions in the patterns are possessive, which changes no match and keeps long runs off the stack.

Nulls: a null text is empty; null and repeated doc_ids stay rows; an empty table gives no rows and no model. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scratch

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT = r"\x20?[(\[{]at[)\]}]\x20?|\x20at\x20(?=[A-Za-z0-9-]++\x20dot\x20)|@"
DOT = r"\x20?[(\[{](?:dot|\.)[)\]}]\x20?|\x20dot\x20|\."
#: Between the parts of an IP address.
POINT = r"\x20?[(\[{](?:dot|\.)[)\]}]\x20?|\x20dot\x20|\x20\.\x20|[.,:\x20]"
PROPOSALS = {
    "email": rf"[A-Za-z0-9._%+-]++(?:{AT})[A-Za-z0-9-]++(?:(?:{DOT})[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}(?:{POINT})[0-9]{{1,3}}(?:{POINT})[0-9]{{1,3}}(?:{POINT})[0-9]{{1,3}}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[\x20._/-]{0,2}[0-9]{4}[\x20._/-]{0,2}[0-9]{4}[\x20._/-]{0,2}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?|[0-9]{1,2}[\x20.-])?(?:\([0-9]{2,4}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@|[(\\[{]at[)\\]}]|\\x20dot\\x20", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
KEYWORDS = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|carte|karte|tarjeta", "phone": "phone|tel|call|mobile|fax|contact"}
#: Separators that a kind is usually written with.
SEPARATORS = {"email": r"[^.@_%+-]", "ip": r"[^.()\[\]{}]", "card": r"[^\x20._/-]", "phone": r"[^\x20.()-]"}
FEATURES = ["is_email", "is_ip", "is_card", "keyword", "glued_before", "glued_after", "usual_length", "one_separator", "usual_separator", "even_groups", "separated", "bracketed", "usual_ending"]
ROUNDS, RATE, PRECISION, CONTEXT = 30, 0.5, 0.85, 24
#: Of proposals that fail a check, so many as many pass it by chance: a tenth of random digits pass Luhn, about a fifth of random parts are under 256; of numbers that go on, and of addresses, about a tenth.
CHANCE = [0.1, 0.25, 1 / 9, 0.1]
#: Weight, as a share of the labels, of bad rows spread over all feature vectors: what no label shows counts as unlikely.
BACKGROUND = 0.1
SPAN = "array<struct<kind:int,start:int,end:int>>"
SNIP = "array<struct<kind:int,start:int,matched:string,before:string,behind:string>>"
CANDIDATE = "array<struct<kind:int,start:int,end:int,passes:boolean,cut:boolean,f:array<int>>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn."""

    def value(back: Column) -> Column:
        digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
        doubled = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
        total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(doubled(digit(i))))
        return total % 10 == 0

    return F.when(F.length(number) > 0, let(F.reverse(number), value)).otherwise(False)


def passes(kind: str, text: Column) -> Column:
    """The check of a kind on what its pattern matched."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: F.when(F.length(x).between(1, 3), F.coalesce(x.try_cast("int") <= 255, F.lit(False))).otherwise(False))
        return F.forall(F.split(text, r"\."), part)
    n = F.length(digits(text))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.when((n >= 13) & (n <= 19), luhn(digits(text))).otherwise(False)


def canonical(kind: str, text: Column) -> Column:
    """A candidate as the base pattern would read it."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(text, AT, "@"), DOT, ".")
    if kind == "ip":
        return F.regexp_replace(text, POINT, ".")
    return digits(text)


def found(text: Column, pattern: str, keep, entry) -> Column:
    """Array of entry(start, end, matched) of the leftmost non-overlapping matches for which keep(matched); code points, end exclusive."""

    def walk(hits: Column) -> Column:
        pairs = F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.length(m).alias("n")))
        one = lambda a, x: F.array(entry(a["at"] + x["gap"], a["at"] + x["gap"] + x["n"], x["m"]))
        none = F.slice(F.array(entry(F.lit(0), F.lit(0), F.lit(""))), 1, 0)
        step = lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.when(keep(x["m"]), F.concat(a["out"], one(a, x))).otherwise(a["out"]).alias("out"))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)


def _sound(kind: str, plain: Column) -> Column:
    """The check of a kind on a candidate in the form of the base pattern; an address must end like one."""
    return F.regexp_like(plain, F.lit(r"\.[A-Za-z]{2,24}$")) if kind == "email" else passes(kind, plain)


def _features(kind: str, text: Column, start: Column, end: Column, matched: Column) -> Column:
    before = F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)))
    plain, n = canonical(kind, matched), F.length(digits(matched))
    # an address spelled out is judged as the address it spells
    body = plain if kind == "email" else matched
    usual = {"email": F.length(plain).between(6, 64), "ip": F.length(plain).between(7, 15), "card": n.between(15, 16), "phone": n.between(10, 12)}[kind]
    seps = F.filter(F.array_distinct(F.split(F.regexp_replace(body, "[A-Za-z0-9@+()\\[\\]]+", ""), "")), lambda x: x != "")
    even = {"email": r"^[a-z0-9._-]+@[a-z0-9.-]+$", "ip": r"^[0-9]+(\D+)[0-9]+\1[0-9]+\1[0-9]+$", "card": r"^[0-9]{4}(\D*)[0-9]{4}\1[0-9]{4}\1[0-9]+$", "phone": r"[0-9]{3}[^0-9]+[0-9]{4}$"}[kind]
    checks = [
        F.lit(kind == "email"), F.lit(kind == "ip"), F.lit(kind == "card"), F.regexp_like(before, F.lit(f"(?i){KEYWORDS[kind]}")),
        F.regexp_like(before, F.lit(r"[\p{L}\p{N}]$")), F.regexp_like(F.substring(text, end + 1, F.lit(1)), F.lit(r"^[\p{L}\p{N}]")), usual, F.size(seps) <= 1,
        ~F.regexp_like(F.regexp_replace(body, "[A-Za-z0-9]+" if kind != "ip" else r"[A-Za-z0-9]+|\x20\.\x20", ""), F.lit(SEPARATORS[kind])), F.regexp_like(body, F.lit(even)),
        F.size(seps) >= 1, F.regexp_like(matched, F.lit(r"[\[({]|\x20(?:dot|\.)\x20")),
        F.regexp_like(plain, F.lit(r"\.(?:com|org|net|edu|gov|info|biz|eu)$|@[^@.]+\.[^@.]+\.[A-Za-z]{2,3}$")),
    ]
    return F.array(*[F.coalesce(c, F.lit(False)).cast("int") for c in checks])


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates, snips) per row of docs; snips: the base spans with the text around them."""
    text = F.col("text")
    base, proposed = [], []
    for k, kind in enumerate(KINDS):
        span = lambda a, b, m, k=k: F.struct(F.lit(k).alias("kind"), a.alias("start"), b.alias("end"), m.alias("matched"))
        kept = found(text, PATTERNS[kind], lambda m, kind=kind: passes(kind, m), lambda a, b, m, span=span: span(a, b, m))
        base.append(F.when(F.regexp_like(text, F.lit(NEEDS[kind] if kind != "phone" else r"\+[0-9]")) if kind != "email" else F.contains(text, F.lit("@")), kept))
        enough = (lambda m: F.length(digits(m)) >= 8) if kind in ("card", "phone") else (lambda m: F.lit(True))

        def entry(a, b, m, k=k, kind=kind):
            more = F.regexp_like(F.substring(text, b + 1, F.lit(2)), F.lit(r"^[.,:\x20-]?[0-9]")) | F.regexp_like(F.substring(text, F.greatest(a - 1, F.lit(1)), F.least(a, F.lit(2))), F.lit(r"[0-9][.,:\x20-]?$"))
            cut = more if kind != "email" else F.lit(False)
            # a number with a country code goes on to the left of what is proposed
            cut = cut & ~F.regexp_like(F.substring(text, F.greatest(a - 7, F.lit(1)), F.least(a, F.lit(8))), F.lit(r"\+[0-9]{1,3}[\x20.-]?$")) if kind == "phone" else cut
            return F.struct(F.lit(k).alias("kind"), a.alias("start"), b.alias("end"), F.coalesce(_sound(kind, canonical(kind, m)), F.lit(False)).alias("passes"), F.coalesce(cut, F.lit(False)).alias("cut"), _features(kind, text, a, b, m).alias("f"))

        proposed.append(F.when(F.regexp_like(text, F.lit(NEEDS[kind])), found(text, PROPOSALS[kind], lambda m, enough=enough: enough(m), lambda a, b, m, entry=entry: entry(a, b, m))))
    joined = lambda parts, kind: F.concat(*[F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts])
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    any_ = F.regexp_like(text, F.lit("[0-9@]|" + NEEDS["email"]))
    full = "array<struct<kind:int,start:int,end:int,matched:string>>"
    rows = rows.select("doc_id", "text", F.when(any_, joined(base, full)).otherwise(F.array().cast(full)).alias("full"), F.when(any_, joined(proposed, CANDIDATE)).otherwise(F.array().cast(CANDIDATE)).alias("candidates"))
    plain = F.transform("full", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    around = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["matched"].alias("matched"), F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))).alias("before"), F.substring(text, s["end"] + 1, F.lit(4)).alias("behind"))
    return rows.select("doc_id", plain.cast(SPAN).alias("base"), "candidates", F.transform("full", around).cast(SNIP).alias("snips"))


def forms(kind: int, m: Column) -> tuple[list[Column], list[Column]]:
    """(good, bad): a base span written in the forms that the generators look for, and look-alikes of it."""
    swap = lambda text, *pairs: reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
    if kind == 0:
        name, host, word = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1), lambda t: F.regexp_extract(t, "[A-Za-z]{2,}", 0)
        prose = F.concat(word(F.col("before")), F.lit(" at "), word(name), F.lit(" dot "), word(host))
        return [F.concat(name, F.lit(a), swap(host, (".", d))) for a, d in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), ("@", "[.]"), ("{at}", "{dot}"))], [F.when(F.regexp_like(prose, F.lit("^[A-Za-z]+ at [A-Za-z]+ dot [A-Za-z]+$")), prose)]
    if kind == 1:
        return [swap(m, (".", d)) for d in ("[.]", "(.)", "[dot]", " [dot] ", " dot ", " . ")], [swap(m, (".", d)) for d in (" ", ",", ":", ", ")]
    n = digits(m)
    if kind == 2:
        groups = F.regexp_extract_all(n, F.lit("[0-9]{1,4}"), F.lit(0))
        return [F.array_join(groups, d) for d in (".", "/", "_", ". ", " / ", "--", " - ")], []
    last = lambda a, b: F.substring(n, a, b)
    ten = [last(-10, 3), last(-7, 3), last(-4, 4)]
    plain = [F.format_string(f, *ten) for f in ("(%s) %s-%s", "%s-%s-%s", "%s.%s.%s", "%s %s %s", "001 %s %s %s", "0049-%s-%s-%s", "1 (%s) %s-%s", "1-%s-%s-%s")]
    return [F.when(F.length(n) >= 10, p) for p in plain], []


def made_up(extracted: DataFrame) -> DataFrame:
    """(at, kind, good, f): labelled rows from all base spans written anew; at halves them by chance."""
    snips = extracted.select("doc_id", F.explode("snips").alias("s")).select("s.*", F.xxhash64(F.lit("snip"), "doc_id", "s.kind", "s.start").alias("at"))
    # what was extracted is small and comes in few tasks, but rewriting a span costs as much as a short document
    snips = snips.repartition(int(extracted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at")
    rows = None
    for k in range(len(KINDS)):
        good, bad = forms(k, F.col("matched"))
        each = F.array(*[F.struct(c.alias("form"), F.lit(g).alias("good")) for part, g in ((good, True), (bad, False)) for c in part])
        own = snips.where(F.col("kind") == k).withColumn("x", F.explode(each)).where("x.form IS NOT NULL").select("at", "kind", "before", "behind", "x.form", "x.good")
        rows = own if rows is None else rows.unionByName(own)
    start = F.length("before")
    texts = rows.select(F.struct("at", "kind", "good", start.alias("start"), (start + F.length("form")).alias("end")).alias("doc_id"), F.concat("before", "form", "behind").alias("text"))
    same = lambda c: (c["kind"] == F.col("doc_id.kind")) & F.when(F.col("doc_id.good"), (c["start"] == F.col("doc_id.start")) & (c["end"] == F.col("doc_id.end"))).otherwise((c["start"] < F.col("doc_id.end")) & (F.col("doc_id.start") < c["end"]))
    open_ = F.filter("candidates", lambda c: same(c) & c["passes"] & ~c["cut"] & ~_over(c, lambda s: F.lit(True)))
    return extract(texts).select("doc_id", F.explode(open_).alias("c")).select("doc_id.at", "doc_id.kind", "doc_id.good", "c.f")


def _over(c: Column, test) -> Column:
    """Whether a base span that the test accepts overlaps candidate c."""
    return F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]) & test(s))


def _open(c: Column) -> Column:
    """Whether a proposal is to be decided: it passes, is whole, and no base span lies there."""
    return c["passes"] & ~c["cut"] & ~_over(c, lambda s: F.lit(True))


def _bad(c: Column) -> Column:
    """Whether a proposal is known to be none of its kind."""
    return ~_over(c, lambda s: s["kind"] == c["kind"]) & (~c["passes"] | c["cut"] | _over(c, lambda s: F.lit(True)))


def boost(counts: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[int, int, dict]]:
    """Trees (i, j, leaf values) from (features, good rows, bad rows): each splits on the pair of features with the highest gain of the logistic loss."""
    f = np.array([c[0] for c in counts]).reshape(len(counts), len(FEATURES))
    good, bad = (np.array([c[k] for c in counts], float) for k in (1, 2))
    trees, score = [], np.zeros(len(counts))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        gradient, curvature, best = good - (good + bad) * p, (good + bad) * p * (1 - p), (1e-6, None)
        for i, j in combinations(range(len(FEATURES)), 2):
            cell = 2 * f[:, i] + f[:, j]
            g, h = np.bincount(cell, gradient, 4), 1.0 + np.bincount(cell, curvature, 4)  # 1: the penalty on leaf values
            gain = (g * g / h).sum()
            if gain > best[0]:
                best = gain, (i, j, {divmod(x, 2): float(v) for x, v in enumerate(rate * g / h)}), cell
        if not best[1]:
            break
        trees.append(best[1])
        score = score + np.array(list(best[1][2].values()))[best[2]]
    return trees


def score_of(f, trees) -> float:
    return sum(leaves.get((f[i], f[j]), 0.0) for i, j, leaves in trees)


def labels(extracted: DataFrame) -> DataFrame:
    """(at, kind, good, f, chance): every base span written anew, and every proposal of the documents that is known to be bad (chance)."""
    known = extracted.select("doc_id", "base", F.explode("candidates").alias("c")).where(_bad(F.col("c")))
    order = F.xxhash64(F.lit("fit"), "doc_id", "c.kind", "c.start")
    return known.select(order.alias("at"), "c.kind", F.lit(False).alias("good"), "c.f", F.lit(True).alias("chance")).unionByName(made_up(extracted).withColumn("chance", F.lit(False)))


def fit(extracted: DataFrame) -> tuple[list, dict[int, float]]:
    """(trees, threshold by kind) from all labels; what comes to the driver is counts by feature vector, of which there are at most 2 ** len(FEATURES) in each half."""
    found = labels(extracted).groupBy((F.pmod(F.col("at"), F.lit(2)) == 0).alias("held"), "kind", "f").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good") & ~F.col("chance")).alias("bad"), F.count_if("chance").alias("chance"))
    counted = found.select("held", "kind", "f", F.col("good").cast("double"), (F.col("bad") + F.col("chance") * F.element_at(F.array(*map(F.lit, CHANCE)), F.col("kind") + 1)).alias("bad")).orderBy("kind", "f", "held").collect()
    fitted = [(tuple(r.f), r.good, r.bad) for r in counted if not r.held]
    kinds, rest = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)], len(FEATURES) - 3
    weight = BACKGROUND * sum(g + b for _, g, b in fitted) / (len(kinds) << rest)
    trees = boost(fitted + [((*k, *v), 0.0, weight) for k in kinds for v in product((0, 1), repeat=rest)])
    limits = {}
    for kind in range(len(KINDS)):
        scored = sorted(((score_of(r.f, trees), r.good, r.bad) for r in counted if r.held and r.kind == kind), reverse=True)
        good = bad = 0
        for at, (s, g, b) in enumerate(scored):
            good, bad = good + g, bad + b
            last = at + 1 == len(scored) or scored[at + 1][0] < s
            if last and s > 0 and good and good >= PRECISION * (good + bad):
                limits[kind] = s
    return trees, limits


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans, and these with the accepted candidates, by kind then start."""
    path = scratch(docs.sparkSession, "personal")
    extract(docs).write.parquet(path)
    extracted = docs.sparkSession.read.parquet(path)
    trees, limits = fit(extracted)

    def scored(c: Column) -> Column:
        value = F.lit(0.0)
        for i, j, leaves in trees:
            case = F.when(F.lit(False), 0.0)
            for (a, b), leaf in leaves.items():
                case = case.when((F.get(c["f"], F.lit(i)) == a) & (F.get(c["f"], F.lit(j)) == b), leaf)
            value = value + case.otherwise(0.0)
        return F.struct(value.alias("score"), (-c["kind"]).alias("order"), (-c["start"]).alias("place"), c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))

    limit = lambda c: F.element_at(F.array(*[F.lit(limits.get(k, math.inf)) for k in range(len(KINDS))]), c["kind"] + 1)
    open_ = F.transform(F.filter("candidates", _open), scored)
    over = F.filter(open_, lambda c: c["score"] >= limit(c) - 1e-9)
    # of proposals that overlap the greatest stays
    best = lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"]) & (d > c)))
    added = F.transform(let(over, best), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return extracted.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", added))).alias("spans"))


def op9_personal(spark, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
