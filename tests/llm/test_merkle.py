import hashlib
import zlib

from pyspark.sql import functions as F

from postmill.llm import merkle

H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The levels of a tree, from the leaves to the root."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at, own):
    """(siblings, digest of the root) on the way up from a place, with own as its digest."""
    siblings = []
    for level in levels[:-1]:
        run = level[at - at % 8 : at - at % 8 + 8]
        before, behind = run[: at % 8], run[at % 8 + 1 :]
        siblings += before + behind
        own, at = H([*before, own, *behind]), at // 8
    return siblings, own


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> result rows."""
    leaf = lambda r: H(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    lower = lambda r: (*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: sorted([r for r in rows if r[2] == lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs}
    trees = {lang: tree([leaf(r) for r in own[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for i, lang in enumerate(langs):
        for j, r in enumerate(own[lang]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low, mid = climb(trees[lang], j, leaf(lower(r) if bad else r))
            high, root = climb(top, i, mid)
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], H(low + high), root, root == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def query(spark, rows, path, parts=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", digest string").repartition(parts)
    df.write.parquet(f"{path}/documents.parquet")
    return [tuple(r) for r in merkle.op12_merkle(spark, path).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_query_form(spark, tmp_path):
    langs = [None, "de", "en", "en", "en", "éa", "z", "Z", "", "fr", "a1", "a2"]
    rows = [(i * 7 % 1000, f"s{i % 3}" if i % 5 else None, langs[i * 31 % 97 % len(langs)], i if i % 11 else None, None if i % 13 == 0 else f"Text Étang {i} " * (i % 4)) for i in range(1000)]
    rows += [(5, "s", "en", 1, "Same")] * 30 + [(5, "s", "en", 1, "Other"), (None, None, None, None, None), (None, None, None, None, ""), (3, "s", "lone", 5, "A B"), (12, "s", "long", 1, "Wörd " * 200_000)]
    assert sorted(map(str, query(spark, rows, str(tmp_path)))) == sorted(map(str, brute(rows)))


def test_small_and_empty(spark, tmp_path):
    one = [(1, "s", "en", 2, "Hi")]
    assert query(spark, one, f"{tmp_path}/one") == brute(one)
    eight = [(i, "s", "en", 2, "Hi") for i in range(9)]
    assert sorted(query(spark, eight, f"{tmp_path}/nine")) == sorted(brute(eight))
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op12_merkle(spark, f"{tmp_path}/none").collect() == []


def test_some_requests_only(spark):
    """Requests for a few rows descend to those rows alone, and a forged path does not fold to the root."""
    rows = spark.createDataFrame([(i, "=a" if i % 3 else "=b", bytearray(hashlib.sha256(str(i).encode()).digest())) for i in range(700)], "id long, key string, digest binary")
    made = merkle.build(rows.checkpoint(), ["id"])
    found = merkle.prove(made, made.leaves.where("id IN (0, 5, 699)")).withColumn("root", merkle.fold(F.col("digest"), F.col("path")))
    got = found.collect()
    assert sorted(r.id for r in got) == [0, 5, 699] and {r.root for r in got} == {made.root.hex()}
    assert all(bytes(r.digest) == hashlib.sha256(str(r.id).encode()).digest() for r in got)
    forged = found.select(merkle.fold(F.col("digest"), F.reverse("path")).alias("x")).collect()
    assert made.root.hex() not in {r.x for r in forged}
