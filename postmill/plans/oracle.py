"""DuckDB SQL of the enriched postings, written apart from the Spark expressions; queries compare with selections from it."""

from ..functions import fixed
from ..functions.scoring import PROFILE
from .adapters import AS_OF, FULL_TEXT, POSTINGS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)}, 'i')"


def names(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def _escape(s: str) -> str:
    return "".join(f"\\{c}" if c in r".+*?()[]{}|^$" else c for c in s)


def _skills() -> str:
    found = [f"CASE WHEN {has('full_text', f'(^|[^A-Za-z]){_escape(s)}([^A-Za-z]|$)')} THEN {q(s)} END" for s in [*fixed.SKILLS, *PROFILE["custom_skills"]]]
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


def _case(pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def _level(text: str, table) -> str:
    return _case([(f"regexp_matches(lower({text}), {q(p)})", q(n)) for n, p in table], "NULL")


def _said(text: str, table, prefix: str) -> str:
    return _case([(f"regexp_matches(lower({text}), {q(p)})", f"{q(prefix + ': ' + chr(39))} || trim(regexp_extract(lower({text}), {q(p)})) || {q(chr(39))}") for n, p in table], "NULL")


def _job_type() -> str:
    squash = "trim(regexp_replace(lower(trim(employment_type)), '[\\s_\\-]+', ' ', 'g'))"
    known = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in fixed.JOB_TYPE_NAMES.items()) + "}"
    parts = f"list_filter(list_transform(regexp_split_to_array({squash}, '[,/|;]'), lambda p: {known}[trim(p)]), lambda x: x IS NOT NULL)"
    hints = _case([(has("lower(title || chr(10) || full_text)", p), q(n)) for n, p in fixed.JOB_TYPE_HINTS], "'unknown'")
    return f"coalesce({known}[{squash}], {parts}[1], {hints})"


def _age() -> str:
    relative = r"(\d+)\s*(minute|hour|day|week|month|year)s?\s+ago"
    unit = _case([(f"regexp_extract(lower(posted), {q(relative)}, 2) = {q(n)}", str(d)) for n, d in fixed.AGE_UNITS.items()], "NULL")
    stamp = f"coalesce(try_strptime(posted, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(posted, '%Y-%m-%d'), try_strptime(posted, '%Y/%m/%d'), try_strptime(posted, '%d %b %Y'), try_strptime(posted, '%b %d, %Y'), try_strptime(regexp_extract(posted, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '%Y-%m-%d'))"
    return f"""CASE WHEN posted IS NULL THEN NULL WHEN lower(posted) IN ('today', 'just now', 'just posted') THEN 0 WHEN lower(posted) = 'yesterday' THEN 1
      WHEN regexp_matches(lower(posted), {q(relative)}) THEN CAST(regexp_extract(lower(posted), {q(relative)}, 1) AS INT) * {unit}
      ELSE CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch({stamp})) / 86400) AS INT) END"""


def _score() -> str:
    own = {s.lower() for s in PROFILE["skills"]}
    wide = own | {v.lower() for k, vs in PROFILE["skill_aliases"].items() if k.lower() in own for v in vs}
    any_of = lambda hay, words: "(" + " OR ".join(f"contains({hay}, {q(w.lower())})" for w in words) + ")"
    w, years = fixed.WEIGHTS, PROFILE["years_total"]
    tier = _case([(any_of("lower(title)", fixed.ROLE_TIERS[t]), q(t)) for t in fixed.ROLE_TIERS], "NULL")
    return f"""
s0 AS (SELECT *, list_distinct(list_transform(skills_found, lambda x: lower(x))) AS own_skills, lower(substr(text1, 1, 2000) || ' ' || substr(text2, 1, 2000)) AS body, {tier} AS tier,
  CASE WHEN len(years) = 0 THEN 0.6 WHEN {years} BETWEEN list_min(years) - 1 AND list_max(years) + 1 THEN 1.0 WHEN {years} BETWEEN list_min(years) - 2 AND list_max(years) + 2 THEN 0.6 ELSE 0.2 END AS f_exp FROM e),
s1 AS (SELECT *, list_sort(list_filter(own_skills, lambda x: list_contains({names(sorted(wide))}, x))) AS matched, list_sort(list_filter(own_skills, lambda x: NOT list_contains({names(sorted(wide))}, x))) AS gaps FROM s0),
s2 AS (SELECT *, is_live IS NOT FALSE AND coalesce(error, '') = '' AS scored,
  CAST(round_even(least(1.0, len(matched) / 7.0) * {w['technical_skills']}, 0) AS INT) AS p_skills, CAST(round_even(f_exp * {w['experience']}, 0) AS INT) AS p_exp,
  CAST(round_even(CASE WHEN regexp_matches(lower(title), '(manager|director|head of|vp|chief)') THEN 0.2 WHEN regexp_matches(lower(title), '(senior|sr\\.|lead|staff|principal)') THEN CASE WHEN f_exp >= 0.6 THEN 0.8 ELSE 0.53 END
    WHEN regexp_matches(lower(title), '(junior|jr\\.|intern|trainee|\\bl1\\b)') THEN 0.53 ELSE 0.67 END * {w['seniority']}, 0) AS INT) AS p_level,
  CAST(round_even(CASE WHEN {any_of('body', PROFILE['certs'])} THEN 1.0 ELSE 0.6 END * {w['certifications']}, 0) AS INT) AS p_cert,
  CAST(round_even(CASE WHEN {any_of("lower(coalesce(location, ''))", PROFILE['locations'][:1])} THEN 1.0 WHEN {any_of("lower(coalesce(location, ''))", [*PROFILE['locations'], 'remote'])} THEN 0.8 ELSE 0.6 END * {w['location']}, 0) AS INT) AS p_place,
  CAST(round_even(CASE tier WHEN 'tier1' THEN 1.0 WHEN 'tier2' THEN 0.8 ELSE 0.4 END * {w['role_relevance']}, 0) AS INT) AS p_role,
  CAST(round_even(CASE WHEN contains(text1, '25 LPA') THEN 1.0 ELSE 0.6 END * {w['compensation']}, 0) AS INT) AS p_pay FROM s1),
s AS (SELECT *, CASE WHEN scored THEN p_skills + p_exp + p_level + p_cert + p_place + p_role + p_pay END AS score FROM s2)"""


def salary_hits(text: str) -> str:
    """List of the salary figures of a text: unlike ones, the first by code point."""
    tail = f"regexp_extract(h, {q(chr(92) + 's*' + fixed.PERIOD + '$')}, 0, 'i')"
    period = f"trim({tail})"
    whole = f"trim(trim(h[1:len(h) - len({tail})]) || CASE WHEN {period} = '' OR starts_with({period}, '/') THEN '' ELSE ' ' END || {period})"
    long = f"list_transform(regexp_extract_all({text}, {q(f'(?:{fixed.SALARY})(?:{chr(92)}s*{fixed.PERIOD})?')}, 0, 'i'), lambda h: {whole})"
    short = f"list_transform(regexp_extract_all({text}, {q(fixed.SHORT_SALARY)}, 0, 'i'), lambda h: trim(h))"
    squeezed = lambda h: f"regexp_replace({h}, '\\s+', '', 'g')"
    found = f"list_concat({long}, {short})"
    return f"list_slice(list_sort(list_filter({found}, lambda h, i: list_position(list_transform({found}, lambda g: {squeezed('g')}), {squeezed('h')}) = i)), 1, {fixed.SALARY_HITS})"


def annual(hit: str) -> str:
    """Struct (currency, lo, hi) of a figure a year, or null."""
    at = lambda pattern, group: f"regexp_extract({hit}, {q(pattern)}, {group}, 'i')"
    tail = f"lower(regexp_extract({hit}, {q(chr(92) + 's*' + fixed.PERIOD + chr(92) + 's*$')}, 0, 'i'))"
    factor = _case([(f"regexp_matches({tail}, {q(f'(^|[^a-z]){word}([^a-z]|$)')})", str(times)) for word, times in fixed.PERIOD_FACTORS], "1")
    core = f"regexp_replace({hit}, {q(chr(92) + 's*' + fixed.PERIOD + chr(92) + 's*$')}, '', 'i')"
    scale = f"({factor}) * CASE WHEN regexp_matches(trim({core}), 'k\\s*$', 'i') THEN 1000 ELSE 1 END"
    number = lambda x: f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)"
    cut = lambda v, times: f"CAST(trunc({v} * ({scale}) * {times}) AS BIGINT)"
    cases = []
    for currency, span, single, times in fixed.SALARY_SPECS:
        lo, hi, one = number(at(span, 1)), number(at(span, 2)), number(at(single, 1))
        entry = lambda a, b, c=currency, t=times: f"{{'currency': {q(c)}, 'lo': {cut(a, t)}, 'hi': {cut(b, t)}}}"
        cases += [(f"{lo} IS NOT NULL AND {hi} IS NOT NULL", entry(f"least({lo}, {hi})", f"greatest({lo}, {hi})")), (f"{one} IS NOT NULL", entry(one, one))]
    return _case(cases, "NULL")


_DEAD = fixed.DEAD
CHAIN = rf"""
WITH p AS ({POSTINGS}), b AS (SELECT *, {FULL_TEXT} AS full_text FROM p),
e AS (SELECT *, {_skills()} AS skills_found, list_sort(list_distinct(list_transform(regexp_extract_all(full_text, {q(fixed.EXPERIENCE)}, 1, 'i'), lambda x: CAST(x AS INT)))) AS years,
  {_level('title', fixed.TITLE_LEVELS)} AS lt, {_level('full_text', fixed.TEXT_LEVELS)} AS ld, {_said('title', fixed.TITLE_LEVELS, 'title')} AS st, {_said('full_text', fixed.TEXT_LEVELS, 'description')} AS sd,
  {_job_type()} AS job_type, {_age()} AS age_days, {has('full_text', fixed.SPONSORSHIP)} AS sponsorship, {has('full_text', fixed.GERMAN)} AS german,
  list_slice(list_sort(list_distinct(list_transform(regexp_extract_all(full_text, {q(fixed.WORK_MODE)}, 1, 'i'), lambda x: lower(x)))), 1, 3) AS modes,
  NOT {has('full_text', _DEAD)} AS is_live,
  trim(regexp_replace(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS company_key,
  trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), {q(fixed.LEVEL_TOKENS)}, ' ', 'g'), ' +', ' ', 'g')) AS title_key FROM b),
{_score().strip()},
d AS (SELECT *, CASE WHEN list_max(years) <= 2 THEN 'entry' WHEN list_min(years) >= 8 THEN 'staff' WHEN list_min(years) >= 5 THEN 'senior' WHEN list_max(years) >= 3 THEN 'mid' END AS ly,
  'asks ' || list_min(years) || '-' || list_max(years) || ' years' AS sy FROM s),
g AS (SELECT *, coalesce(lt, ld, ly, 'unknown') AS seniority,
  CASE WHEN lt = ld THEN 0.95 WHEN lt = ly THEN 0.9 WHEN lt IS NOT NULL THEN 0.8 WHEN ld = ly THEN 0.65 WHEN ld IS NOT NULL THEN 0.55 WHEN ly IS NOT NULL THEN 0.4 ELSE 0.0 END AS confidence,
  CASE WHEN lt IS NOT NULL THEN concat_ws(' | ', st, CASE WHEN lt = ld THEN sd WHEN lt = ly THEN sy END) WHEN ld IS NOT NULL THEN concat_ws(' | ', sd, CASE WHEN ld = ly THEN sy END) WHEN ly IS NOT NULL THEN sy ELSE '' END AS evidence FROM d),
k AS (SELECT *, row_number() OVER (ORDER BY coalesce(score, -1) DESC, seq) AS rank, coalesce(error, '') <> '' AS failed FROM g)
"""


def canon(url: str) -> str:
    """Canonical URL of the forms that the tables hold (no credentials, no odd ports)."""
    query = f"regexp_extract({url}, '\\?([^#]*)', 1)"
    noise = names(fixed.TRACKING)
    kept = (
        f"list_sort(list_filter(list_filter(string_split({query}, '&'), lambda x: x <> ''), lambda x: NOT (starts_with(lower(string_split(x, '=')[1]), 'utm_') OR list_contains({noise}, lower(string_split(x, '=')[1])))))"
    )
    decoded = f"list_transform({kept}, lambda x: url_decode(replace(x, '+', ' ')))"
    host = f"regexp_replace(lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#]+)', 1)), ':443$', '')"
    path = f"regexp_extract({url}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
    cut = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE rtrim({path}, '/') END"
    return f"lower(regexp_extract({url}, '^([A-Za-z]+)://', 1)) || '://' || {host} || {cut} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({decoded}, '&') ELSE '' END"


def board(url: str) -> str:
    host = f"lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#]*)', 1))"
    return _case([*[(f"contains({host}, {q(a)})", q(b)) for a, b in fixed.BOARD_HOSTS], (f"regexp_matches({url}, {q(fixed.RADANCY_JOB)})", "'radancy'")], "'generic'")
