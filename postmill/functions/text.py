"""What a posting's text says: section buckets, skills, years, salary, signals, liveness, age, job type and seniority."""

import re
from collections.abc import Sequence
from functools import cache, reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .literals import needed
from .urls import strip

SALARY_TYPE = "array<struct<raw:string,currency:string,min_annual:bigint,max_annual:bigint>>"


def rx(pattern: str) -> Column:
    """A pattern that ignores case and knows Unicode, as literal."""
    return F.lit(f"(?iU){pattern}")


needed = cache(needed)


def folded(text: Column) -> Column:
    """Lower-case text, to search for plain words before patterns are tried; the two letters that patterns take for s and i become these."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.contains(low, F.lit("\u017f")) | F.contains(low, F.lit("\u0131")), F.translate(low, "\u017f\u0131", "si")).otherwise(low)


def may_hold(pattern: str, *low: Column) -> Column:
    """Whether a text, given in folded form, holds the literals without which the pattern can't match."""
    return reduce(and_, [reduce(or_, [F.contains(x, F.lit(word)) for word in words for x in low]) for words in needed(pattern)], F.lit(True))


def has(text: Column, pattern: str, *low: Column) -> Column:
    """low: the text in folded form, where it is at hand (in parts, if it is put together from some); most texts are then never searched by the pattern."""
    found = F.regexp_like(F.coalesce(text, F.lit("")), rx(pattern))
    return may_hold(pattern, *low) & found if low else found


def matches(text: Column, pattern: str, group: int = 0, low: Column | None = None) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), rx(pattern), F.lit(group))
    return found if low is None else F.when(may_hold(pattern, low), found).otherwise(F.array().cast("array<string>"))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(text, f"(?iU){pattern}", group)


def let(value: Column, body) -> Column:
    """body(value), value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


# sections: array of (heading, text)


def bucket_sections(sections: Column) -> Column:
    """Struct of arrays nice_to_have, requirements, responsibilities, other; each section with text goes to the first that fits."""
    label = lambda s: (
        F.when(strip(F.coalesce(s["text"], F.lit(""))) == "", "none").when(has(s["heading"], fixed.NICE_TO_HAVE), "nice_to_have").when(has(s["heading"], fixed.REQUIREMENTS), "requirements")
        .when(has(s["heading"], fixed.RESPONSIBILITIES), "responsibilities").when((F.length(s["text"]) > fixed.OTHER_MIN_CHARS) & has(s["text"], fixed.OTHER_HINTS), "other").otherwise("none")
    )
    marked = F.transform(sections, lambda s: F.struct(label(s).alias("label"), s.alias("s")))
    of = lambda all_, name: F.transform(F.filter(all_, lambda m: m["label"] == name), lambda m: m["s"]).alias(name)
    return let(marked, lambda all_: F.struct(*[of(all_, n) for n in ("nice_to_have", "requirements", "responsibilities", "other")]))


def extract_benefits(sections: Column) -> Column:
    return F.filter(sections, lambda s: (strip(F.coalesce(s["text"], F.lit(""))) != "") & has(s["heading"], fixed.BENEFITS))


def find_skills(text: Column, extra: Sequence[str] = (), low: Column | None = None) -> Column:
    """Vocabulary terms found, in vocabulary order; none counts that touches a letter.

    A term's first run of letters stands in such a text between other characters, so the runs of the text rule most terms out at once."""
    vocabulary = fixed.SKILLS + [s for s in extra if s not in fixed.SKILLS]
    quoted = lambda s: "".join(f"\\{c}" if c in r"\.+*?()[]{}|^$&/-#~" else c for c in s)
    first = {s: re.search("[a-z]+", s.lower()) for s in vocabulary}
    first = {s: m[0] for s, m in first.items() if m and s.lower().isascii()}
    low = folded(text) if low is None else low
    runs = F.array_intersect(F.split(low, "[^a-z]+"), F.array(*map(F.lit, sorted(set(first.values())))))
    held = lambda met, s: (F.array_contains(met, first[s]) if s in first else F.lit(True)) & has(text, f"(?<![A-Za-z]){quoted(s)}(?![A-Za-z])")
    return let(runs, lambda met: F.array_compact(F.array(*[F.when(held(met, s), F.lit(s)) for s in vocabulary])))


def find_experience(text: Column, low: Column | None = None) -> Column:
    """Years asked for (the lower end of ranges), distinct and sorted."""
    return F.array_compact(F.array_sort(F.array_distinct(F.transform(matches(text, fixed.EXPERIENCE, 1, low), lambda x: x.try_cast("int")))))


#: What every alternative of the salary patterns begins with: at other places none of them is tried.
SALARY_START = r"(?=[₹ri\d.€$£])"


def extract_salary(text: Column, low: Column | None = None) -> Column:
    """Salary figures as written, with a pay period that follows; unlike ones only, the first SALARY_HITS by code point."""
    long = F.transform(matches(text, f"{SALARY_START}(?:{fixed.SALARY})(?:\\s*{fixed.PERIOD})?", 0, low), lambda m: _joined(m))
    short = F.transform(matches(text, f"{SALARY_START}(?:{fixed.SHORT_SALARY})", 0, low), strip)
    squeezed = lambda h: F.regexp_replace(h, r"(?U)\s+", "")

    def firsts(hits: Column) -> Column:
        keys = F.transform(hits, squeezed)
        return F.slice(F.array_sort(F.filter(hits, lambda h, i: F.array_position(keys, squeezed(h)) == i + 1)), 1, fixed.SALARY_HITS)

    return let(F.concat(long, short), firsts)


def _joined(hit: Column) -> Column:
    """Figure and pay period with one space between, none before a slash."""
    tail = first_match(hit, rf"\s*{fixed.PERIOD}$")
    figure, period = strip(F.substr(hit, F.lit(1), F.length(hit) - F.length(tail))), strip(tail)
    return strip(F.concat(figure, F.when(period.startswith("/") | (period == ""), "").otherwise(" "), period))


#: The largest double that a long holds: a figure above it would fail the whole query.
LARGEST = float(2**63 - 1024)


def normalize_salary(hits: Column) -> Column:
    """(raw, currency, min_annual, max_annual) of the hits that parse."""

    def annual(hit: Column) -> Column:
        tail = F.lower(first_match(hit, rf"\s*{fixed.PERIOD}\s*$"))
        factor = F.when(F.lit(False), 1)
        for word, times in fixed.PERIOD_FACTORS:
            factor = factor.when(F.regexp_like(tail, F.lit(f"(?<![a-z]){word}(?![a-z])")), times)
        core = F.regexp_replace(hit, rf"(?iU)\s*{fixed.PERIOD}\s*$", "")
        scale = factor.otherwise(1) * F.when(F.regexp_like(strip(core), F.lit(r"(?i)k\s*$")), 1000).otherwise(1)
        number = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")
        found = F.lit(None).cast("struct<raw:string,currency:string,min_annual:bigint,max_annual:bigint>")
        for currency, span, single, times in reversed(fixed.SALARY_SPECS):
            lo, hi, one = number(first_match(hit, span, 1)), number(first_match(hit, span, 2)), number(first_match(hit, single, 1))
            cut = lambda v, t=times: F.least(v * scale * t, F.lit(LARGEST)).cast("bigint")
            entry = lambda a, b, c=currency: F.struct(hit.alias("raw"), F.lit(c).alias("currency"), a.alias("min_annual"), b.alias("max_annual"))
            found = F.when(lo.isNotNull() & hi.isNotNull(), entry(cut(F.least(lo, hi)), cut(F.greatest(lo, hi)))).when(one.isNotNull(), entry(cut(one), cut(one))).otherwise(found)
        return found

    return F.array_compact(F.transform(hits, annual))


def detect_signals(text: Column, *low: Column) -> Column:
    modes = F.slice(F.array_sort(F.array_distinct(F.transform(matches(text, fixed.WORK_MODE, 1, *low), F.lower))), 1, 3)
    return F.struct(has(text, fixed.SPONSORSHIP, *low).alias("sponsorship_mentioned"), has(text, fixed.GERMAN, *low).alias("german_required"), modes.alias("work_mode"))


def looks_blocked(visible: Column) -> Column:
    return (F.length(visible) < fixed.BLOCKED_BELOW_CHARS) & has(visible, fixed.BLOCKED)


def check_liveness(visible: Column, *low: Column) -> Column:
    """(is_live, live_reason): unknown behind a bot wall, false if the page says so, else true."""
    says = fixed.LIVE_REASONS
    state = F.when(looks_blocked(visible), "blocked").when(has(visible, fixed.DEAD, *low), "closed").otherwise("open")
    live = lambda x: F.when(x == "blocked", F.lit(None).cast("boolean")).otherwise(x == "open").alias("is_live")
    return let(state, lambda x: F.struct(live(x), F.when(x == "blocked", says["blocked"]).when(x == "closed", says["closed"]).otherwise(says["open"]).alias("live_reason")))


def posting_age_days(posted: Column, as_of: Column) -> Column:
    """Days since a posting date at as_of (a timestamp in UTC): whole days elapsed; null where the date can't be read."""
    text = strip(posted)
    low = F.lower(text)
    relative = r"(\d+)\s*(minute|hour|day|week|month|year)s?\s+ago"
    unit = F.when(F.lit(False), 0)
    for name, days in fixed.AGE_UNITS.items():
        unit = unit.when(first_match(low, relative, 2) == name, days)
    zoned = F.regexp_replace(text, r"(\.\d+)?Z$", "$1+00:00")
    formats = [
        (zoned, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?[+-]\d{2}:?\d{2}$", None), (text, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", None), (text, r"^\d{4}-\d{2}-\d{2}$", None),
        (text, r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (text, r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (text, r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
        (first_match(text, r"\d{4}-\d{2}-\d{2}"), r"^.+$", None),
    ]
    stamps = [F.when(F.regexp_like(t, F.lit(p)), F.try_to_timestamp(t, F.lit(f)) if f else t.try_cast("timestamp")) for t, p, f in formats]
    elapsed = F.floor((as_of.cast("double") - F.coalesce(*stamps).cast("double")) / 86400).cast("int")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("int")).when(low.isin("today", "just now", "just posted"), 0).when(low == "yesterday", 1)
        .when(has(low, relative), first_match(low, relative, 1).try_cast("int") * unit).otherwise(elapsed)
    )


def normalize_job_type(raw: Column, title: Column, text: Column, *low: Column) -> Column:
    """Canonical job type of an array of raw values; hints in title and text where none is known."""
    names = F.create_map(*[F.lit(x) for pair in fixed.JOB_TYPE_NAMES.items() for x in pair])
    squash = lambda v: strip(F.regexp_replace(F.lower(strip(v)), r"(?U)[\s_\-]+", " "))
    known = lambda v: F.coalesce(names[squash(v)], F.get(F.array_compact(F.transform(F.split(squash(v), r"[,/|;]"), lambda p: names[strip(p)])), F.lit(0)))
    blob = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    hint = F.when(F.lit(False), "")
    for label, pattern in fixed.JOB_TYPE_HINTS:
        hint = hint.when(has(blob, pattern, *low, *[folded(title) for _ in low]), label)
    values = F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.coalesce(F.get(F.array_compact(F.transform(values, known)), F.lit(0)), hint.otherwise("unknown"))


def _level(text: Column, table, prefix: str, *low: Column) -> Column:
    """(level, evidence) of the first pattern that the lower-case text matches."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    level = F.when(F.lit(False), "")
    for name, pattern in table:
        level = level.when(has(plain, pattern, *low), name)

    def told(x: Column) -> Column:
        said = F.when(F.lit(False), "")
        for name, pattern in table:
            said = said.when(x == name, F.concat(F.lit(f"{prefix}: '"), strip(first_match(plain, pattern)), F.lit("'")))
        return F.struct(x.alias("level"), said.alias("evidence"))

    return let(level, told)


def infer_seniority(title: Column, text: Column, years: Column, *low: Column) -> Column:
    """(level, evidence, confidence): the title decides, then the text, then years; agreement raises confidence."""
    by_title, by_text = _level(title, fixed.TITLE_LEVELS, "title"), _level(text, fixed.TEXT_LEVELS, "description", *low)
    lo, hi = F.array_min(years), F.array_max(years)
    by_years = F.when(hi <= 2, "entry").when(lo >= 8, "staff").when(lo >= 5, "senior").when(hi >= 3, "mid")
    years_say = F.when(by_years.isNotNull(), F.format_string("asks %d-%d years", lo, hi))

    def judged(x: Column) -> Column:
        t, d, y = x["t"]["level"], x["d"]["level"], x["y"]
        second = F.when(t.isNotNull() & t.eqNullSafe(d), x["d"]["evidence"]).when(F.coalesce(t, d).isNotNull() & F.coalesce(t, d).eqNullSafe(y), x["ys"])
        sure = F.when(t.isNotNull() & t.eqNullSafe(d), 0.95).when(t.isNotNull() & t.eqNullSafe(y), 0.9).when(t.isNotNull(), 0.8).when(d.isNotNull() & d.eqNullSafe(y), 0.65).when(d.isNotNull(), 0.55).when(y.isNotNull(), 0.4).otherwise(0.0)
        first = F.when(t.isNotNull(), x["t"]["evidence"]).when(d.isNotNull(), x["d"]["evidence"]).otherwise(x["ys"])
        return F.struct(F.coalesce(t, d, y, F.lit("unknown")).alias("level"), F.array_compact(F.array(first, second)).alias("evidence"), sure.alias("confidence"))

    return let(F.struct(by_title.alias("t"), by_text.alias("d"), by_years.alias("y"), years_say.alias("ys")), judged)


def seniority_rank(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, fixed.LEVELS)), level), F.lit(0)).cast("int") - 1


def epoch_to_iso(value: Column) -> Column:
    """ISO time of an epoch in seconds; null for anything else."""
    return F.date_format(F.timestamp_seconds(F.floor(value.try_cast("double"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def posted_date(value: Column) -> Column:
    """Date of an ISO time, else its first ten characters; null for blank."""
    text = strip(value)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.coalesce(F.date_format(F.try_to_date(F.substring(text, 1, 10)), "yyyy-MM-dd"), F.substring(text, 1, 10)))


def normalize_company(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_company(c), fixed.LEVEL_TOKENS, " "), " +", " "))


def company_of_blank(c: Column) -> Column:
    """Stripped text, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))
