import base64
import hashlib

import pytest
from loomgraph.llm import warc

EVIL = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
ROWS = [(5, "u v", EVIL * 3), (6, None, None), (7, "", ""), (8, "é", EVIL * 3), (9, "z", "a\r\n\r\nWARC/1.1\r\n"), (2, "q", EVIL * 3), (11, "x", "é✓" * 40_000), (12, "y", "HTTP/1.1 200 OK\r\n\r\nbody"), (None, "n", "lost"), (13, "n", "lost")]


def expected(rows):
    first, out = {}, {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        f = first.setdefault(digest, i)
        out[i] = (len(raw), digest, "response" if f == i else "revisit", None if f == i else f)
    return out


@pytest.mark.parametrize("block", [700, 1 << 23])
def test_round_trip_with_records_inside_payloads(spark, block):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string").repartition(2)
    path = warc.new_path(spark, "test")
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path, block).collect()
    assert len(got) == len(ROWS)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id is not None} == expected(ROWS)
    assert all(r.digest == r.payload_digest for r in got)
    assert [r.record_type for r in got if r.page_id is None] == ["response"]


def test_false_candidates_are_seen_and_dropped(spark):
    path = warc.new_path(spark, "test")
    warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1), path)
    found = warc.candidates(warc.blocks(spark, path, 600), 600)
    assert found.count() > len(ROWS) and warc.read_archives(spark, path, 600).count() == len(ROWS)


def test_repeated_rows_and_an_empty_table(spark):
    schema = "page_id long, url string, html string"
    got = warc.archived(spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (3, "u", "same")], schema)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [(1, "response", 0), (1, "response", 0), (3, "revisit", 1)]
    assert warc.archived(spark.createDataFrame([], schema)).count() == 0


def test_headers_of_any_length_are_read_and_broken_chains_fail(spark):
    rows = [(1, "a", "one"), (2, "u" * 200_000, EVIL), (3, "b", "three"), (4, "v" * 70_000, "four")]
    path = warc.new_path(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read_archives(spark, path, 5000).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(rows)
    broken = warc.new_path(spark, "test")
    text = EVIL + "no record" + EVIL
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(broken)
    with pytest.raises(Exception, match="no record at"):
        warc.read_archives(spark, broken, 5000).collect()


def test_a_url_of_a_megabyte_across_a_block_and_very_many_equal_pages(spark):
    rows = [(1, "a", "x" * ((8 << 20) - 900)), (2, "u" * (1 << 20), "two"), (3, "b", "three"), *[(i, "c", "same" if i % 2 else None) for i in range(4, 3004)]]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(rows)
