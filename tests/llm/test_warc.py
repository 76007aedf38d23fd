import gzip
import hashlib

import pytest

from postmill.llm import warc

PAGES = [
    (1, "http://a/ü x", "short"), (2, "http://b/", "short"), (3, None, None), (4, "u", ""), (5, "u", "é" * 60), (6, "v", "é" * 60), (7, "w", "é" * 60),
    (9, "big", "line\r\n\r\nWARC/1.0\r\n\r\n" * 9000), (8, "big", "line\r\n\r\nWARC/1.0\r\n\r\n" * 9000), (10, "e", "x" * 100), (11, "e", "x" * 99), (12, "e", "x" * 99), (13, "r", "y" * 200), (13, "r", "y" * 200),
]


@pytest.mark.parametrize("most", [200_000, 0])
def test_round_trip(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", most)
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, body string").repartition(3)
    path = f"{tmp_path}/w"
    warc.write_archives(df, path, segment=1000)
    got = sorted(warc.read_archives(spark, path).collect(), key=lambda r: (r.page_id, r.type))
    text = {p: (h or "").encode() for p, _, h in PAGES}
    assert [r.page_id for r in got] == sorted(p for p, _, _ in PAGES)
    for r in got:
        assert r.payload_bytes == len(text[r.page_id]) and r.digest == hashlib.sha256(text[r.page_id]).hexdigest()
        assert r.payload is None if r.type == "revisit" else bytes(r.payload) == text[r.page_id]
    assert {(r.page_id, r.refers_to) for r in got if r.type == "revisit"} == {(6, 5), (7, 5), (9, 8)}


def test_standard_layout_and_damage(tmp_path):
    body = b"z" * 5000
    made = list(warc.records(1, "1#0", "http://a", body, hashlib.sha256(body).hexdigest(), None, False, 2000))
    data = b"".join(r + warc.END for r in made)
    read = list(warc.split_records(warc._inflate(gzip.compress(data) + gzip.compress(data))))
    assert len(read) == 2 * len(made) and read[1][0]["warc-segment-origin-id"] == read[0][0]["warc-record-id"]
    block = b"".join(b for _, b in read[: len(made)])
    assert int(read[len(made) - 1][0]["warc-segment-total-length"]) == len(block)
    assert warc.decode_chunked(block.partition(warc.END)[2]) == body
    with pytest.raises(ValueError):
        list(warc.split_records(data[:-10]))
    with pytest.raises(ValueError):
        warc.decode_chunked(b"5\r\nab\r\n0\r\n\r\n")
    assert warc.decode_chunked(b"2;x=1\r\nab\r\n0\r\nT: 1\r\n\r\n") == b"ab"


def test_missing_segment_is_reported(spark, tmp_path):
    body = b"z" * 5000
    made = list(warc.records(1, "1#0", "http://a", body, hashlib.sha256(body).hexdigest(), None, False, 2000))
    (tmp_path / "x.txt").write_bytes(b"".join(r + warc.END for r in (made[0], made[2])))
    with pytest.raises(Exception, match="missing"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").collect() == []
