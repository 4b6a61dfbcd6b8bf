import hashlib

import pytest

from daybook.llm import warc
from daybook.session import scratch_path

LONG = "<p>é" + "0123456789" * 40 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n"
ROWS = [
    (5, "http://a/x?é\r\nX-Page-ID: 9", LONG, "z"), (3, None, LONG, "z"), (3, "http://b/", LONG, "z"), (9, "", "short", None), (8, "u", "short", None),
    (1, "u", None, None), (2, "u", "", None), (None, "u", LONG, None), (None, None, "x" * 5000, None), (7, "u", "y" * 99, None), (6, "u", "y" * 99, None),
    (11, "u", "日本" * 20_000, None), (12, "u", "日本" * 20_000, None),
]


@pytest.mark.parametrize("segment", [300, 64 * 1024])
def test_round_trip(spark, segment):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")
    got = warc.archive_digests(df, segment_bytes=segment, chunk_bytes=100).collect()
    want = []
    for i, _, h, _ in ROWS:
        data = (h or "").encode()
        same = [r[0] for r in ROWS if (r[2] or "").encode() == data and r[0] is not None]
        to = min(same) if len(data) >= 100 and same and min(same) != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to, None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_files_hold_the_payloads(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(df, path, segment_bytes=777, chunk_bytes=64)
    rows = [r for r in warc.read_archive(spark, path).collect() if r.record_type == "response"]
    assert all(r.fault is None for r in rows)
    assert {(r.page_id, bytes(r.payload).decode()) for r in rows} == {
        ("3", LONG), ("9", "short"), ("8", "short"), ("1", ""), ("2", ""), (None, "x" * 5000), ("7", "y" * 99), ("6", "y" * 99), ("11", "日本" * 20_000)
    }


def test_faults():
    import pandas as pd

    def seg(n, part, total=None):
        return {"page_id": "1", "uri": None, "record_type": "response", "claimed": None, "number": n, "total": total, "part": part, "fault": None}

    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc" * 50, 40)
    whole = pd.DataFrame([seg(2, block[30:], len(block)), seg(1, block[:30])])
    assert warc.joined(None, whole)["payload"][0] == b"abc" * 50
    assert warc.joined(None, whole[:1])["fault"][0] == "a segment is missing"
    assert warc.joined(None, whole[1:])["fault"][0] == "a segment is missing"
    assert warc.joined(None, whole.assign(total=[9.0, None]))["fault"][0] == "segments of another total length"
    assert warc.joined(None, pd.DataFrame([seg(1, block[:60], 60)]))["payload"][0] is None
    assert list(warc.parsed(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")) == [({"content-length": "10"}, None)]
    assert list(warc.parsed(b"noise")) == [({}, None)]


def test_empty(spark):
    assert warc.archive_digests(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
