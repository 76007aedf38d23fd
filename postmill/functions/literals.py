"""Literals that a pattern can't do without."""

from re import _constants as C
from re import _parser

MOST = 64


def _prefixes(items) -> tuple[set[str], bool, list[set[str]]]:
    """(strings one of which begins a match of items, whether they are all of it, further such sets from within)."""
    runs, now, first, whole = [], {""}, None, True

    def close():
        nonlocal now, first, whole
        runs.append(now)
        first, now, whole = first or now, {""}, False

    for op, value in items:
        if op is C.LITERAL:
            found, all_ = {chr(value).lower()}, True
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in value):
            found, all_ = {chr(x).lower() for _, x in value}, True
        elif op is C.SUBPATTERN:
            found, all_, inner = _prefixes(value[3])
            runs += inner
        elif op is C.BRANCH:
            parts = [_prefixes(x) for x in value[1]]
            found, all_ = set().union(*(p[0] for p in parts)), all(p[1] for p in parts)
            best = [max([p[0], *p[2]], key=_worth) for p in parts]
            runs.append(set().union(*best))
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            found, all_, inner = _prefixes(value[2])
            all_ = False
            runs += inner
        else:
            close()
            continue
        if len(found) * len(now) > MOST:
            close()
        now = {a + b for a in now for b in found}
        if not all_:
            close()
    if whole:
        return now, True, runs
    runs.append(now)
    return first, False, runs


def _worth(words: set[str]) -> tuple[int, int]:
    return min(map(len, words)), -len(words)


def needed(pattern: str) -> list[list[str]]:
    """Lists of lower-case strings: a text that the pattern matches, in any case, holds one string at least of each list."""
    first, _, runs = _prefixes(_parser.parse(pattern))
    best = max([first, *runs], key=_worth)
    least = lambda words: sorted(w for w in words if not any(v in w for v in words - {w}))
    return [least(words) for k, words in enumerate((best, first)) if "" not in words and not (k and words == best)]
