import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postmill.llm import alignment, pieces

A_JSON = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = pieces.model_bytes()
A, B = Tokenizer.from_str(A_JSON), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
A.encode_special_tokens = True
LETTERS = alignment.byte_letters()


def encoded(text):
    """(ids, bytes of each token) of both sides, by the libraries on the whole text."""
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    name = B.id_to_piece
    return (a, [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]), (b, [bytes([int(name(i)[3:5], 16)]) if B.is_byte(i) else name(i).replace("▁", " ").encode() for i in b])


def brute_groups(text):
    """Groups ([ids of A], [ids of B]) of a text."""
    if not text:
        return []
    (a, a_bytes), (b, b_bytes) = encoded(text)
    if not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
        return []
    out, i, j, x, y, own = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            own[0].append(a[i])
            x += len(a_bytes[i])
            i += 1
        else:
            own[1].append(b[j])
            y += len(b_bytes[j])
            j += 1
        if x == y and own[0] and own[1]:
            out.append(own)
            own = ([], [])
    assert own == ([], [])
    return out


def brute(rows):
    made = [(d, brute_groups(t)) for d, t in rows]
    links = [Counter((a, b) for g in gs for a in g[0] for b in g[1]) for _, gs in made]
    count = Counter(p for own in links for p in own)
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (d, gs), own in zip(made, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((d, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), own.total(), sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ALIGNER = alignment.Aligner(A_JSON, MODEL)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n", "a\n", "a \n b", "a\n b\n\n c", "\ta", "it's we'll I'd", "<|endoftext|> x <s></s> <unk> <0x41>", "▁", "a ▁ b", "naïve café ñandú ß", "日本語 テキスト です", "🙂👍🏽 a🙂 ",
    "　x  y \x1c z\x85w", "ﬁ ligature é é", "12345 3.14 1,000", "don’t “quote”", "\x00 a\x00b", "aaaaaaaaaaaaaaaa", "a" * 1000, " " * 50 + "b", "!!!???...", "x\r\ny \r z", "ǅ Ɂ ɐ ʰ", "a​ b  c",
]


def record(text):
    d = alignment.align_texts(ALIGNER, [text])[0]
    keys, times = d.pairs()
    return d.n_a, d.n_b, d.n_groups, d.n_links, d.digest.hexdigest() if d.n_a else "", dict(zip(keys.tolist(), times.tolist(), strict=True))


def wanted(text):
    groups = brute_groups(text)
    row = brute([(1, text)])[0]
    return (*row[1:5], row[7], dict(Counter(a << 32 | b for g in groups for a in g[0] for b in g[1])))


def test_odd_texts():
    assert ALIGNER.exact and ALIGNER.quick
    for text in ODD:
        assert record(text) == wanted(text), repr(text)
    together = alignment.align_texts(ALIGNER, ODD)
    assert [d.n_links for d in together] == [wanted(t)[3] for t in ODD]


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  \n\t'abcTHE.,!éßñ1▁的🙂  \x1d"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert record(text) == wanted(text)


def test_parts_of_long_texts(monkeypatch):
    text = "Some words, and others; naïve ones too.\n" * 400 + "w" * 3000 + "\n end"
    want = wanted(text)
    for size in (1, 300, 5000):
        monkeypatch.setattr(alignment, "PART_TOKENS", size)
        assert record(text) == want
    monkeypatch.setattr(alignment, "TABLE_ROWS", 1)
    assert record(text) == want
    slow = alignment.Aligner(A_JSON, MODEL)
    slow.quick = None
    assert [x.n_links for x in alignment.align_texts(slow, ODD)] == [wanted(t)[3] for t in ODD]
    slow.exact = False
    assert [x.digest.hexdigest() for x in alignment.align_texts(slow, [text])] == [want[4]]


def test_query_form(spark, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "the house"), (None, None), (3, "the house is the house"), (3, "the house is the house"), (99, "The word " * 60_000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    query = lambda: sorted([tuple(r) for r in alignment.op13_alignment(spark, str(tmp_path)).select(*NAMES).collect()], key=str)
    want = sorted(brute(rows), key=str)
    assert query() == want
    monkeypatch.setattr(alignment, "SLICE_PAIRS", 40)
    assert query() == want


def test_documents_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in alignment.op13_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got.values()) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))
    docs.where(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert alignment.op13_alignment(spark, str(tmp_path)).collect() == []
