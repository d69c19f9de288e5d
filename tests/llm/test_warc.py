import base64
import gzip
import hashlib
import re

import pytest

from llm.storage import fresh_path
from llm.warc import _parse, archive_round_trip, chunked, digest, read_archives, unchunked, write_archives


def test_chunks():
    for data in (b"", b"a", "é日本".encode() * 50, b"0\r\n\r\n" * 9):
        assert unchunked(chunked(data, 7)) == data
    with pytest.raises(ValueError):
        unchunked(b"5\r\nabc")


HTML = ["<p>é日本</p>\r\n" * 40, "WARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 3\r\n\r\n\r\n" * 9, "", None, "\n", "x" * 5000, "HTTP/1.1 404\r\n\r\n0\r\n\r\n"]


def test_round_trip(spark):
    rows = [(i, f"http://a/{i}", HTML[i % len(HTML)] if i % 3 else f"page {i}") for i in range(60)] + [(5, "http://b\r\nX: y", HTML[5]), (200, None, HTML[1]), (None, "u", "only"), (None, "u", HTML[0])]
    frame = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    for least in (0, 100):
        got = archive_round_trip(frame, min_revisit_bytes=least, segment_bytes=300, chunk_bytes=64, compress=bool(least)).collect()
        first = {}
        for page, _, html in rows:
            if page is not None:
                first[html or ""] = min(page, first.get(html or "", page))
        want = []
        for page, _, html in rows:
            data = (html or "").encode()
            origin = first.get(html or "") if len(data) >= least else None
            revisit = origin is not None and origin != page
            want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", origin if revisit else None, None if revisit else True, None if revisit else data))
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.verified, None if r.payload is None else bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)


def test_segments_are_written_and_missing_ones_found(spark):
    path = fresh_path(spark, "warc")
    write_archives(spark.createDataFrame([(1, "u", "x" * 1000)], "page_id long, url string, html string"), path, segment_bytes=300, compress=False)
    content = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    heads = [h for c in content for h, _ in _parse(c)]
    assert [h["warc-type"] for h in heads] == ["response", *["continuation"] * 3] and heads[-1]["warc-segment-total-length"] == str(sum(int(h["content-length"]) for h in heads))
    cut = fresh_path(spark, "warc")
    spark.createDataFrame([(content[0][: content[0].rindex(b"WARC/1.1")].decode()[:-1],)], "value string").coalesce(1).write.text(cut)
    with pytest.raises(Exception, match="segments are missing"):
        read_archives(spark, cut).collect()


def test_a_gzip_member_per_record(spark, tmp_path):
    plain = fresh_path(spark, "warc")
    write_archives(spark.createDataFrame([(i, f"http://a/{i}", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1), plain, compress=False)
    for k, row in enumerate(spark.read.format("binaryFile").load(plain).collect()):
        records = [b"WARC/1.1" + x for x in bytes(row.content).split(b"WARC/1.1")[1:]]
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    assert sorted(r.page_id for r in read_archives(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4]


def test_empty(spark):
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def _foreign(kind, record_id, block, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """A member per record, records of other types, a revisit without a length, segments of another type."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhello"
    records = [
        _foreign("warcinfo", "urn:uuid:0", b"software: x"),
        _foreign("request", "urn:uuid:1", b"GET / HTTP/1.1\r\n\r\n"),
        _foreign("response", "urn:uuid:2", http, WARC_Payload_Digest=f"sha1:{digest(b'hello')}"),
        _foreign("response", "urn:uuid:3", http, WARC_Payload_Digest="sha256:abc"),
        _foreign("revisit", "urn:uuid:4", b"", WARC_Payload_Digest=f"sha1:{digest(b'hello')}", WARC_Refers_To="<urn:uuid:2>"),
        _foreign("resource", "urn:uuid:5", b"ab", WARC_Segment_Number=1),
        _foreign("continuation", "urn:uuid:6", b"cd", WARC_Segment_Number=2, WARC_Segment_Origin_ID="<urn:uuid:5>", WARC_Segment_Total_Length=4),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = read_archives(spark, str(tmp_path)).collect()
    assert sorted(((r.record_type, r.page_id, r.payload_bytes, r.refers_to, r.verified) for r in got), key=str) == sorted([("response", None, 5, None, True), ("response", None, 5, None, None), ("revisit", None, None, None, None)], key=str)


def test_references_name_records(spark, tmp_path):
    """Each revisit refers to the record of a response, with hot payloads and others."""
    rows = [(i, f"u{i}", "same" if i % 3 else f"pair {i // 6}") for i in range(60)]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), str(tmp_path / "w"), compress=False)
    text = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    ids = {kind: re.findall(rb"WARC-Type: " + kind + rb"\r\nWARC-Record-ID: (\S+)", text) for kind in (b"response", b"revisit")}
    refers = re.findall(rb"WARC-Refers-To: (\S+)", text)
    assert len(refers) == len(ids[b"revisit"]) == 60 - 11 and set(refers) <= set(ids[b"response"])
