import hashlib
import struct

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import pieces

MODEL = pieces.model_bytes()
SP, TABLE = sentencepiece.SentencePieceProcessor(model_proto=MODEL), pieces.ChunkTable(MODEL)


def whole(text):
    ids = SP.encode(text, add_bos=True, add_eos=True)
    return struct.pack(f"<{len(ids)}I", *ids), SP.decode(ids)


@settings(max_examples=600, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\t ab<0x>s/éﬁ　 \x00的"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_equal_whole_text(text):
    assert TABLE.encode([text]) == [whole(text)]


def test_odd_texts():
    assert TABLE.exact
    for text in ["", " ", "  ", "a  b ", "\na", "a\nb", " a", "▁a", "<s>", "</s> <unk>", "<0x0A>", "a" * 5000, " " * 300, "\n\n \n", "x y " * 3000, "é \U0001f600\U0001f468‍\U0001f469"]:
        assert TABLE.encode([text]) == [whole(text)], text


def test_query_form(spark, tmp_path):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (2, "", None), (None, "a  b\n", "z"), (5, "same words same words", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(pieces.op5_sentencepiece(spark, str(tmp_path)).collect(), key=str)
    want = sorted([(d, len(whole(t or "")[0]) // 4, hashlib.sha256(whole(t or "")[0]).hexdigest(), hashlib.sha256(whole(t or "")[1].encode()).hexdigest()) for d, t, _ in rows], key=str)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert pieces.encode(df).columns == ["doc_id", "text", "piece_ids", "piece_text"]
    assert pieces.encode(df.limit(0)).collect() == []
