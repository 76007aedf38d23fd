import re

import pytest
from pyspark.sql import functions as F

from postmill.llm import exact

TEXTS = [(0, "a b"), (1, "ab "), (2, "a\nb  "), (3, None), (4, ""), (5, " \t"), (6, "x"), (7, "X"), (8, "é"), (9, "é "), (9, "é "), (None, "a b   "), (10, "w " * 100000), (11, "w" * 100000), (12, "a\xa0b")]


def brute(rows):
    groups = {}
    for at, (doc, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, at))
    out = []
    for members in groups.values():
        first = min(members)
        doc = rows[first[3]][0]
        out += [(rows[m[3]][0], doc, len(members)) for m in members]
    return sorted(out, key=str)


def test_groups(spark):
    df = spark.createDataFrame([(d, t, "x") for d, t in TEXTS], "doc_id long, text string, digest string").repartition(3)
    for digest in (exact.sha, lambda c: F.substring(exact.sha(c), 1, 1), lambda c: F.lit(b"same")):  # the last two force the comparison of whole texts
        rows = exact.exact_groups(df, digest).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in rows], key=str) == brute(TEXTS)
        assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_drop_copies_and_empty(spark):
    df = spark.createDataFrame([(d, t, "x") for d, t in TEXTS], "doc_id long, text string, kept_id string")
    left = exact.drop_copies(df)
    assert left.columns == df.columns and sorted([r.doc_id for r in left.collect()], key=str) == sorted([None, 3 + 2, 6, 7, 9, 10, 12], key=str)
    assert exact.exact_groups(df.limit(0)).collect() == []


def test_later_batches_find_the_state(spark, tmp_path):
    batches, known = [TEXTS[:7], TEXTS[7:], [(20, "ab"), (21, "x   "), (22, "new"), (23, "x")]], []
    for digest in (exact.sha, lambda c: F.substring(exact.sha(c), 1, 1)):
        folder, known = f"file://{tmp_path}/{id(digest)}", []
        for k, rows in enumerate(batches):
            path = str(tmp_path / f"{id(digest)}-{k}.parquet")
            spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
            known += rows
            got = exact.exact_groups(spark.read.parquet(path), digest, folder, k).collect()
            want = brute(known)
            for d, _ in rows:
                assert {(r.keep_id, r.group_size) for r in got if r.doc_id == d} <= {(x[1], x[2]) for x in want if x[0] == d}
            assert len(got) == len(rows) and all(r.doc_id == r.keep_id for r in got if r.kept)
    # the log of each batch was read once, by the query that went on from its checkpoint
    assert len(list((tmp_path / f"{id(digest)}" / "state" / "commits").glob("[0-9]*"))) >= 3


@pytest.mark.parametrize("broken", ["log", "state", "after"])
def test_a_broken_batch_is_repeated(spark, tmp_path, monkeypatch, broken):
    """Three batches, the second broken off while its log is written, before its state is, or when all is done but the answer."""
    batches, known = [TEXTS[:7], [*TEXTS[7:], (1, "ab "), (30, "x")], [(20, "ab"), (21, "x   "), (22, "new"), (23, "x")]], []
    weak = lambda c: F.substring(exact.sha(c), 1, 1)
    folder = f"file://{tmp_path}/groups"
    for k, rows in enumerate(batches):
        path = str(tmp_path / f"{k}.parquet")
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
        known += rows
        if k == 1 and broken == "log":
            left = tmp_path / "groups" / "log" / "batch=1"
            left.mkdir(parents=True)
            (left / "part-00000-half.parquet").write_bytes(b"PAR1 cut off")
        elif k == 1:
            with monkeypatch.context() as patched:
                real = exact._state

                def dies(*given):
                    if broken == "after":
                        real(*given)
                    raise RuntimeError("executor lost")

                patched.setattr(exact, "_state", dies)
                with pytest.raises(RuntimeError):
                    exact.exact_groups(spark.read.parquet(path), weak, folder, k)
        got = exact.exact_groups(spark.read.parquet(path), weak, folder, k).collect()
        want = brute(known)
        assert len(got) == len(rows)
        for d, _ in rows:
            assert {(r.keep_id, r.group_size) for r in got if r.doc_id == d} <= {(x[1], x[2]) for x in want if x[0] == d}


def test_locators_name_rows_of_files(spark, tmp_path):
    path = str(tmp_path / "own.parquet")
    spark.createDataFrame([(k, f"t{k}", "x", k) for k in range(50)], "doc_id long, text string, locator string, place long").coalesce(1).write.parquet(path)
    found = exact._located(spark.read.parquet(path)).collect()
    assert [(r.doc_id, r.place) for r in found] == [(k, k) for k in range(50)] and all("own.parquet/part-" in r.locator for r in found)
    made = exact._located(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert [(r.locator, r.place) for r in made] == [(None, None)]
