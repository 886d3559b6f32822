import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from obliqua.llm import warc
from obliqua.llm.common import Scratch

PAGES = "page_id long, url string, html string"


def text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("abc é漢\r\n<>") for _ in range(n))


def expected(rows, least=1000):
    """Brute force over all rows: (page_id, bytes, sha1, type, refers_to)."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, h in data:
        same = [j for j, g in data if g == h]
        known = [j for j in same if j is not None]
        top = max(known) if known else None
        revisit = len(h) >= least and i != top
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def stored(spark, rows, path, **how):
    warc.write_archives(spark.createDataFrame(rows, PAGES).withColumn("block", F.lit(1)).withColumn("payload", F.lit("x")), path, **how)
    return warc.read_pages(spark, path)


@pytest.fixture(scope="module")
def rows():
    big, mid = text(1, 9000), text(2, 1200)
    odd = [(1, None, None), (2, "http://a/", ""), (3, "a\r\nWARC-Type: x", "WARC/1.1\r\n\r\n0\r\n\r\n"), (None, "n", text(3, 2000)), (None, "n", text(3, 2000)), (5, "n", text(3, 2000)), (None, "m", text(4, 2000))]
    same = [(i, f"http://h/{i}", mid) for i in range(10, 60)] + [(59, "again", mid)]
    return [*odd, *same, (70, "u", big), (71, "u", big), (72, "u", text(5, 998) + "é"), (73, "u", text(5, 998) + "é"), (74, "u", "x" * 999), (75, "u", "x" * 999)]


@pytest.mark.parametrize("segment,chunk,records", [(1 << 14, 1 << 12, 2000), (512, 100, 7), (97, 1000, 1), (150, 1, 50)])
def test_pages_come_back_as_brute_force_says(spark, tmp_path, rows, segment, chunk, records):
    got = stored(spark, rows, str(tmp_path / "w"), segment_bytes=segment, chunk_bytes=chunk, most_records=records).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == expected(rows)
    assert all(r.error is None for r in got)
    texts = sorted((r.page_id or -1, bytes(r.payload)) for r in got if r.payload is not None)
    kept = {(i, h) for i, _, h, kind, _ in expected(rows) if kind == "response"}
    assert texts == sorted((i or -1, b) for i, b in [(i, (h or "").encode()) for i, _, h in rows] if (i, hashlib.sha1(b).hexdigest()) in kept)
    if segment == 97:
        assert max(r.n_segments for r in got) > 50


def test_groups_of_equal_pages_meet_by_a_join_beyond_the_count(spark, rows):
    with Scratch(spark) as scratch:
        pages = spark.createDataFrame(rows, PAGES)
        few, many = [sorted(map(repr, warc.with_revisits(pages, 1000, scratch, most).select("page_id", "refers_to", "revisit").collect())) for most in (100, 0)]
    assert few == many


def test_archives_are_plain_warc_records(spark, tmp_path, rows):
    stored(spark, rows[:6], str(tmp_path / "w"), segment_bytes=300).count()
    records = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.parse(gzip.decompress(f.read_bytes()))]
    kinds = {r["warc-type"] for r in records}
    assert kinds == {"response", "revisit", "continuation"} and len({r["warc-record-id"] for r in records}) == len(records)
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= r.keys() for r in records)
    parts = [r for r in records if r["warc-type"] == "continuation"]
    assert all("warc-segment-origin-id" in r and int(r["warc-segment-number"]) > 1 for r in parts)


def damaged(spark, records):
    return {r.record_id: r for r in warc.reassembled(records).collect()}


def test_damage_is_told_and_spares_the_others(spark, tmp_path):
    stored(spark, [(k, "u", text(k, 2000)) for k in range(4)], str(tmp_path / "w"), segment_bytes=700)
    records = warc.read_records(spark, str(tmp_path / "w")).persist()
    first = {r.page_id: r.record_id for r in records.filter("segment = 1").collect()}
    lost = F.col("origin_id").isin(first[0]) & (F.col("segment") == 2)
    last = F.col("origin_id").isin(first[1]) & F.col("total").isNotNull()
    start = F.col("record_id").isin(first[2])
    got = damaged(spark, records.filter(~F.coalesce(lost | last, F.lit(False)) & ~start))
    assert "not whole" in got[first[0]].error and "last segment" in got[first[1]].error and "not whole" in got[first[2]].error
    assert got[first[3]].error is None and bytes(got[first[3]].payload) == text(3, 2000).encode()
    longer = damaged(spark, records.withColumn("total", F.col("total") + 1))
    assert all("bytes of" in r.error for r in longer.values())
    flipped = damaged(spark, records.withColumn("digest", F.lit("sha1:AAAA")))
    assert all("digest differs" in r.error and r.payload is None for r in flipped.values())


def test_chunks():
    for size in (1, 7, 100):
        assert warc.unchunked(warc.chunked(b"0123456789" * 3, size)) == b"0123456789" * 3
    assert warc.chunked(b"", 5) == b"0\r\n\r\n" and warc.unchunked(b"0\r\n\r\n") == b""
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n", b"0\r\n\r\nmore", b"-1\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_other_bytes_are_refused_and_members_joined():
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1 200 OK\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n"))
    assert warc.gunzipped(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab" and warc.gunzipped(b"plain") == b"plain"


def test_empty_table(spark, tmp_path):
    assert stored(spark, [], str(tmp_path / "w")).count() == 0
