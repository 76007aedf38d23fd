import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import chat

TEXT = st.text(st.one_of(st.sampled_from("\\#<>/:# \nturnAé"), st.characters(exclude_categories=["Cs"])), max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", ""]), TEXT), TEXT), max_size=5))
def test_round_trip_and_spans(turns):
    formatted, spans, rewrites = chat.locate(turns)
    assert chat.parse(formatted) == turns and not rewrites
    assert [chat.unescape(formatted[a:b]) for _, a, b, _ in spans] == [t for _, t in turns]
    assert [s[3] for s in spans[:-1]] == [s[0] for s in spans[1:]]


def test_templates_that_rewrite_history_are_found():
    latest = lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))
    assert chat.locate([("user", "hello"), ("assistant", "hi")], latest)[2]
    plain = lambda turns: "<s>" + "".join(f"[{r}]{t};" for r, t in turns)
    formatted, spans, rewrites = chat.locate([("user", "aa"), ("assistant", ""), ("user", "b;")], plain)
    assert not rewrites and [formatted[a:b] for _, a, b, _ in spans] == ["aa", "", "b;"] and spans[0][0] == 3


def test_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (None, None, "assistant", "y"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "é" * 50000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op10_chat(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, None, -7}
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].n_turns == 2
    assert got[3].n_turns == 2 and got[3].loss_chars == 0 and got[3].loss_sha256 == sha("")
    assert got[-7].loss_sha256 == sha(chat.EXTRA_TEXT) and got[-7].loss_chars == len(chat.EXTRA_TEXT)
    assert got[4].loss_chars == 50000
    assert chat.format_chats(df.limit(0)).collect() == []
