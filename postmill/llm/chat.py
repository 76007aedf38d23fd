"""Chat formatting by incremental black-box rendering.

A template is any function list[(role, text)] -> str. `locate` learns nothing of its inside: it renders successive turn prefixes and compares
each output with the one before, whose end is where the new turn begins; an output that doesn't begin with the one before means that the template
rewrites history, which is reported. Rendering the newest turn with two unlike texts shows which of its characters are header and footer.

`render` is the template of the query. It marks turns and puts a backslash before every backslash, # and < of roles and texts, so that no text can
hold a mark; `parse` and `unescape` read it back.

A conversation is one row: its turns are gathered in order (turn, role, text), which is bounded by the longest conversation. Prefix rendering costs
the square of a conversation's length, as a black box requires. Nulls: a null text or role counts as empty, a null conv_id is a conversation, null turns
come first; repeated rows are turns of their own. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch

Turns = list[tuple[str, str]]
EXTRA_ID, EXTRA_TEXT = -7, r"\### Assistant: </turn> ok"
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_ESCAPE, _UNESCAPE = re.compile(r"[\\#<]"), re.compile(r"\\(.)", re.S)
#: A turn of the template: roles and texts hold marks only behind a backslash.
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.|:(?! ))*+): ((?:[^\\#<]|\\.)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: Turns) -> str:
    """The query's template."""
    return "".join([f"{OPEN}{escape(role).replace(':', chr(92) + ':')}{MIDDLE}{escape(text)}{CLOSE}" for role, text in turns])


def parse(formatted: str) -> Turns:
    """The turns of what `render` wrote; raises if it isn't such text."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def common(a: str, b: str, back: bool = False) -> int:
    """Characters that a and b share in front, or at the back; by halving, so that texts are compared as memory."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if (a[-mid:] == b[-mid:]) if back else a.startswith(b[:mid]):
            low = mid
        else:
            high = mid - 1
    return low


def locate(turns: Turns, template: Callable[[Turns], str] = render) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """Formatted text, (start, text start, text end, end) of each turn in it, and whether the template rewrites history.

    Where history is rewritten, spans are those of the prefix that ends with the turn and need not hold in the whole."""
    before, spans, rewrites = template([]) if turns else "", [], False
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        start = len(before)
        if not now.startswith(before):
            rewrites, start = True, common(now, before)
        a, b = (template([*turns[:k], (role, x)]) for x in ("a", "b"))
        head = common(a, b)
        tail = common(a[head:], b[head:], back=True)
        spans.append((start, head, len(now) - tail, len(now)))
        before = now
    return before, spans, rewrites


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows (conv_id, turn, role, text): turns in order."""
    turn = F.struct(F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, template: Callable[[Turns], str] = render, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, rewrites_history): loss_spans are the texts of turns whose role is in learn_from."""

    def run(batch):
        out = []
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pairs = [(t["role"], t["text"]) for t in turns]
            formatted, spans, rewrites = locate(pairs, template)
            loss = [{"start": a, "end": b} for (role, _), (_, a, b, _) in zip(pairs, spans, strict=True) if role in learn_from]
            out.append((conv, len(pairs), formatted, loss, rewrites))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), span, pa.bool_()]
        return pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["conv_id", "n_turns", "formatted", "loss_spans", "rewrites_history"])

    return by_batch(conversations(rows), run, "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>, rewrites_history boolean")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted text of every conversation and of conversation -7."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))

    def run(batch):
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out = []
        for conv, _, formatted, spans, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = parse(formatted)
            loss = "".join([unescape(formatted[s["start"] : s["end"]]) for s in spans])
            out.append((conv, len(turns), sha("".join([f"{role}\n{text}\n" for role, text in turns])), len(loss), sha(loss), len(formatted)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.record_batch([pa.array([x[k] for x in out], pa.string() if "sha" in n else pa.int64()) for k, n in enumerate(names)], names=names)

    return by_batch(format_chats(rows.unionByName(extra)), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') || ': ' || replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') || '</turn>' || chr(10) AS f FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(f)) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""
