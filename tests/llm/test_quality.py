import collections
import re

from postmill.llm import quality


def brute(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = collections.Counter(runs), set()
    for i, r in enumerate(runs):
        if seen[r] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [
    None, "", " \n\t\r", "one", "été  ünd\x0bno\x0cbreak\xa0space", "a b c d e f g h " * 3, "x " * 9, "l\nl\n l\n\nm\n", "#*$%&|<> ok " * 30,
    "the quick brown fox jumps over the lazy dog and runs from it to that big old house on a hill with us " * 2,
    "the house stands on a hill and it was built by an old man who had a dog that liked to run in the wood with him", "w" * 100000, "very long text " * 20000,
]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_words string")
    out = quality.apply_rules(df)
    rows = out.collect()
    assert len(rows) == 2 * len(TEXTS) and out.columns.count("n_words") == 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in rows if r.kept} == {10}
    assert quality.apply_rules(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    quality.apply_rules(spark.createDataFrame([(1, "a")], "doc_id long, text string")).explain()
    assert "Python" not in capsys.readouterr().out
