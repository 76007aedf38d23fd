import re
from collections import Counter

import corpus_pipeline
from postmill.llm import mixing, pieces

from . import test_quality, test_similar

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    from postmill.llm import quality

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    verdict = {r.doc_id: r.kept for r in quality.apply_rules(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r in rows:  # the base rule by brute force; the rest of the verdict is tested against SQL
        assert not (verdict[r.doc_id] and test_quality.brute(r.text)[5])
    good = [r for r in rows if verdict[r.doc_id]]
    best = {}
    for r in good:
        best.setdefault(re.sub(r"[\x20\x09-\x0d]+", "", r.text), []).append((-len(r.text), r.doc_id))
    stays = {min(v)[1] for v in best.values()}
    single = [r for r in good if r.doc_id in stays]
    apart = {d for d, _ in test_similar.brute([(r.doc_id, r.text) for r in single])}
    left = [r for r in single if r.doc_id in apart]
    taken = {r.doc_id: len(r.draws) for r in mixing.mix(spark.createDataFrame(left)).collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter({d: n for d, n in taken.items() if n})
    table, text = pieces.ChunkTable(pieces.model_bytes()), {r.doc_id: r.text for r in rows}
    for r in out:
        assert r.text == text[r.doc_id] == r.piece_text and r.piece_ids == table.sp.encode(r.text, add_bos=True, add_eos=True)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and (k == 4 or out.columns == docs.columns)
        assert out.count() == 0


ROWS = [
    (None, "one", "s"), (None, "one", "s"), (None, None, "s"), (3, None, None), (3, "", None), (4, "a b", None), (4, "a  b", "s"), (5, "A B", "t"), (5, "A B", "t"), (6, " \n", "t"), (None, "a b", "t"),
    *[(10 + i % 3, f"{w} " * 30 + "the end of it", "u") for i, w in enumerate(("x", "y", "z", "x"))], (20, "long " * 40_000, "u"),
]


def odd(spark):
    """Null and repeated ids, texts and sources, and columns with the names that stages use inside."""
    names = ["kept", "own", "d", "row", "draw_", "at", "digest", "n_words"]
    return spark.createDataFrame([(*r, *[f"{k}-{n}" for n in names]) for k, r in enumerate(ROWS)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)


def test_stages_with_null_and_repeated_rows(spark):
    docs = odd(spark)
    given = {r.kept: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = [r.asDict() for r in out.collect()]
        assert out.columns == docs.columns + (["piece_ids", "piece_text"] if k == 4 else [])
        for r in rows:  # no row is changed or made up
            assert {c: r[c] for c in docs.columns} == given[r["kept"]].asDict()
        left = Counter(r["kept"] for r in rows)
        texts = Counter((r["doc_id"], r["text"]) for r in rows)
        if k == 0:
            assert all(len((given[x].text or "").split()) >= 20 for x in left) and max(left.values(), default=0) <= 1
        elif k == 1:
            squeezed = lambda t: re.sub(r"[\x20\x09-\x0d]+", "", t or "")
            assert Counter(squeezed(t) for _, t in texts.elements()) == Counter({squeezed(t) for _, t, _ in ROWS})
            assert (4, "a  b") in texts and (5, "A B") in texts
        elif k == 2:
            known = [r[:2] for r in ROWS]
            want = Counter(test_similar.brute(known))
            assert {x: n for x, n in texts.items() if x[0] is None} == {x: n for x, n in want.items() if x[0] is None}
            assert {d for d, _ in texts if d is not None} == {d for d, _ in want if d is not None}
        elif k == 3:
            assert max(left.values()) <= 2
            size = lambda t: len((t or "").split())
            sizes, taken = Counter(), Counter()
            for _, t, s in ROWS:
                sizes[s] += size(t)
            for r in rows:
                taken[r["source"]] += size(r["text"])
            assert all(taken[s] <= 2 * sizes[s] for s in sizes)
        else:
            sp = pieces.ChunkTable(pieces.model_bytes()).sp
            assert len(rows) == len(ROWS) and all(r["piece_ids"] == sp.encode(r["text"] or "", add_bos=True, add_eos=True) for r in rows)
