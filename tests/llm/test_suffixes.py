import random

import numpy as np
import pytest

from postmill.llm import suffixes


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for k, (_, t) in enumerate(data):
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    out = []
    for d, t in data:
        cover = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                cover[i : i + 400] = b"\x01" * 400
        runs = sum(1 for i in range(len(t)) if cover[i] and not (i and cover[i - 1]))
        out.append((d, len(t), sum(cover), runs, bytes(c for c, x in zip(t, cover) if not x)))
    return sorted(out, key=str)


def rows(seed=5):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abc deé\n") for _ in range(n))
    passage, common = text(700), text(420)
    out = []
    for i in range(40):
        t = text(rng.choice([0, 100, 380, 500, 1500, 3000]))
        for piece in (passage[rng.randint(0, 150) : 700 - rng.randint(0, 150)] if i % 3 == 0 else "", common if i % 4 == 0 else ""):
            at = rng.randint(0, len(t))
            t = t[:at] + piece + t[at:]
        out.append((i, t))
    for i in range(12):
        t = list(out[i * 3][1])
        for _ in range(3):
            if t:
                t[rng.randrange(len(t))] = "Z"
        out.append((100 + i, "".join(t)))
    out += [(200 + i, out[i][1]) for i in range(8)]
    return out + [(300, None), (301, ""), (302, "a" * 3000), (303, "a" * 399), (304, "a" * 500 + "b"), (305, "xyz" * 900), (306, text(300) * 3), (307, text(450) * 2), (None, out[6][1]), (None, passage), (308, "é" * 200), (309, "é" * 200), (310, passage), (310, passage), (310, common)]


@pytest.mark.parametrize(("most", "many"), [(500_000, suffixes.MANY), (0, 2)])
def test_against_all_strings(spark, monkeypatch, most, many):
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", most)
    monkeypatch.setattr(suffixes, "AT_ONCE", 200)
    monkeypatch.setattr(suffixes, "PIECE", 5000)
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, doc string").repartition(3)
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, many).collect()], key=str)
    assert got == brute(data)


def test_groups_cover_every_start_once():
    rng = random.Random(1)
    bodies = [bytes(rng.randrange(256) for _ in range(5000)), b"q" * 2000, b"", b"\x00" * 900, b"z" * 399, b"ab" * 400]
    ends = np.cumsum([0, *map(len, bodies)])
    text, _, _, _, first, last = suffixes.groups(np.frombuffer(b"".join(bodies), np.uint8), ends)
    starts = sorted((k, i - ends[k]) for k, a, b in zip(text.tolist(), first.tolist(), last.tolist()) for i in range(a, b + 1))
    assert starts == [(k, i) for k, x in enumerate(bodies) for i in range(len(x) - 399)]


def test_own_repeats():
    bodies = [b"ab" * 400, bytes(range(256)) * 3, b"q" * 401]
    ends = np.cumsum([0, *map(len, bodies)])
    at, text = suffixes.own_repeats(np.frombuffer(b"".join(bodies), np.uint8), ends)
    for k, x in enumerate(bodies):
        lone = {int(a - ends[k]) for a, t in zip(at, text) if t == k}
        assert all(sum(x[i : i + 400] == x[a : a + 400] for i in range(len(x) - 399)) > 1 for a in lone)


def test_empty(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
