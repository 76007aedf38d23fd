"""Which of many texts stand anywhere in which lines, by an index of short anchors: no comparison of every text with every line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Characters of an anchor, and of a block into which lines are cut.
GRAM, BLOCK = 8, 512


def grams(text: Column, size: int) -> Column:
    """The characters from each place of a text on, `size` of them, fewer near its end."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def blocks(lines: DataFrame, column: str) -> DataFrame:
    """(line, block, text, tail): lines cut into blocks of BLOCK characters, each with the first characters of the next. `line` is a number, the same in each read."""
    cut = lines.where(F.length(column) > 0).select(F.monotonically_increasing_id().alias("line"), F.regexp_extract_all(column, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("cut"))
    tail = lambda x, i: F.struct(x.alias("text"), F.substring(F.coalesce(F.get("cut", i + 1), F.lit("")), 1, GRAM - 1).alias("tail"))
    return materialise(cut.select("line", F.posexplode(F.transform("cut", tail)).alias("block", "b")).select("line", "block", "b.text", "b.tail"), "blocks")


def anchors(keys: DataFrame) -> DataFrame:
    """(k, gram, offset): of each key (k, distinct, not empty) the stretch of GRAM characters that the fewest keys have, the last of equals; a shorter key whole."""
    places = keys.where(F.length("k") >= GRAM).select("k", F.posexplode(F.slice(grams(F.col("k"), GRAM), F.lit(1), F.length("k") - GRAM + 1)).alias("offset", "gram"))
    often = places.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = places.join(often.hint("merge"), "gram").groupBy("k").agg(F.min_by(F.struct("gram", "offset"), F.struct("n", -F.col("offset"))).alias("a"))
    return rarest.select("k", "a.gram", "a.offset")


def held(lines: DataFrame, keys: DataFrame, column: str = "line") -> DataFrame:
    """Those of keys (k: distinct texts) that stand anywhere in a line.

    Every place of a line gives one probe, looked up among the keys' anchors; a hit is verified piece by piece against the blocks that the key would lie in, so neither a long key nor a long line makes a probe longer.
    Every join is by sorting: Spark would take the exploded places of a small file for a small table and broadcast them.
    Keys shorter than an anchor are looked up among the beginnings of the distinct probes. Null and empty lines hold nothing; null and empty keys are held by nothing."""
    keys = materialise(keys.where(F.length("k") > 0).select("k"), "keys")
    cut = blocks(lines, column)
    places = F.slice(grams(F.concat("text", "tail"), GRAM), F.lit(1), F.length("text"))
    probes = cut.select("line", "block", F.posexplode(places).alias("at", "gram"))
    hits = probes.join(anchors(keys).hint("merge"), "gram").withColumn("first", F.col("block").cast("long") * BLOCK + F.col("at") - F.col("offset")).where("first >= 0")
    hits = hits.select("line", "k", "first", (F.col("first") + F.length("k")).alias("end")).distinct()
    pieces = hits.withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(end - 1) div {BLOCK}"))))
    begin = F.col("block") * BLOCK
    low, high = F.greatest("first", begin), F.least("end", begin + BLOCK)
    part = lambda text, origin: F.substring(text, (low - origin + 1).cast("int"), (high - low).cast("int"))
    same = part(F.col("text"), begin) == part(F.col("k"), F.col("first"))
    checked = pieces.join(cut.select("line", F.col("block").cast("long").alias("block"), "text").hint("merge"), ["line", "block"]).where(same)
    needed = F.expr(f"(end - 1) div {BLOCK} - first div {BLOCK} + 1")
    found = checked.groupBy("line", "k", "first", "end").agg(F.count("*").alias("n")).where(F.col("n") == needed).select("k")
    beginnings = probes.select("gram").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("gram"), F.lit(GRAM - 1))), lambda n: F.substring("gram", F.lit(1), n))).alias("k"))
    short = keys.where(F.length("k") < GRAM).join(beginnings.hint("merge"), "k", "left_semi")
    return found.distinct().unionByName(short)
