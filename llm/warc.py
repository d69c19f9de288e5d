"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing.  Of rows with equal payloads (at least min_revisit_bytes long) the one with the smallest id
is a response, the others are revisits of it.  A response's block is an HTTP message with chunked
transfer framing; a block longer than segment_bytes goes out as a first record and continuation
records.  Spark's text sink writes the archives: a record is one row whose last line feed is the
sink's row separator, so the files are plain WARC (gzip by option) and are committed like any output.

Reading.  Each file, plain or gzip of any number of members, is parsed by declared lengths, never by
looking for markers.  Continuation records are grouped by their origin identifier, put in order by
segment number and joined; the total length must match, chunked framing is decoded, and the payload's
digest is verified.  Records in one piece skip the grouping.  Archives of others are read too: records
of other types than response, revisit and their continuations are left out, ids that are not ours are
null, a revisit that doesn't say its payload's length has none, and a digest of another kind than SHA-1
is not verified (null).

Defined results: a null payload counts as empty; a null id is written as such and read as null, and
counts as larger than any other; repeated rows (equal id and payload) are all responses, or all
revisits; an empty table gives an empty table; other columns than the three that are named are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.columns import numbered, place
from llm.storage import discard, fresh_path, stored

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
FILE_BYTES = 16 << 20
#: A payload that more than one in so many pages hold is looked up in a table of at most so many rows.
HOT_SHARE = 1_000
PAGE = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
RECORD = "origin string, segment int, total long, head string, block binary"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cut(data: bytes, at: int) -> int:
    """The last place up to `at` that doesn't split a UTF-8 character."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        to = _cut(data, at + size) if at + size < len(data) else len(data)
        to = to if to > at else min(at + 4, len(data))
        yield data[at:to]
        at = to


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in _pieces(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(out[-1]) != size or body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += 2


def _record(kind: str, record_id: str, headers: list[tuple[str, object]], block: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2026-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block.decode("utf-8") + "\r\n\r"  # the sink adds the last \n


def _clean(value: object) -> object:
    return None if value is None else "".join(c for c in str(value) if c.isprintable())


def write_archives(pages: DataFrame, path: str, payload: str = "html", page_id: str = "page_id", url: str = "url", min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, compress: bool = True) -> None:
    """Write one record (and its continuations) per row to WARC files below path."""
    here = numbered(pages)
    link = F.col(f"c{place(pages, url)}") if url.lower() in [c.lower() for c in pages.columns] else F.lit(None)
    body = F.coalesce(F.col(f"c{place(pages, payload)}").cast("string"), F.lit(""))
    rows = here.select(F.col(f"c{place(pages, page_id)}").cast("long").alias("page_id"), link.cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("key"), F.monotonically_increasing_id().alias("n"))
    rows = whole = stored(rows, "pages")  # so that a row has one number, whoever reads it
    # whom the copies refer to: ids and digests only, of payloads that occur twice
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("first")
    copies = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("key").agg(first, F.count("*").alias("copies")).where(F.col("copies") > 1)
    copies = stored(copies.select("key", F.col("first.page_id").alias("first_id"), F.col("first.n").alias("first_n"), "copies"), "copies")
    # HOT_SHARE rows at most are broadcast; their pages then need no partner in the join by key, so they are dealt by number
    hot = F.col("copies") * HOT_SHARE > whole.count()
    known = copies.where(hot).select("key", F.col("first_id").alias("hot_id"), F.col("first_n").alias("hot_n"))
    rows = rows.join(F.broadcast(known), "key", "left").withColumn("key", F.when(F.col("hot_n").isNotNull(), F.col("n").cast("string")).otherwise(F.col("key")))
    rows = rows.join(copies.where(~hot).select("key", "first_id", "first_n"), "key", "left")
    rows = rows.withColumns({"first_id": F.coalesce("hot_id", "first_id"), "first_n": F.coalesce("hot_n", "first_n")})

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, link, text, first, first_n, n in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first_id", "first_n", "n")), strict=True):
                data, me = text.encode("utf-8"), f"urn:page:{page}:{n}"
                common = [("WARC-Target-URI", _clean(link)), ("X-Page-Id", page), ("WARC-Payload-Digest", f"sha1:{digest(data)}"), ("X-Payload-Length", len(data)), ("Content-Type", "application/http;msgtype=response")]
                if first is not None and first != page:
                    out.append(_record("revisit", me, [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}:{first_n}>")], b"HTTP/1.1 200 OK\r\n\r\n"))
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(data, chunk_bytes)
                    parts = list(_pieces(block, segment_bytes))
                    out.append(_record("response", me, [*common, *([("WARC-Segment-Number", 1)] if len(parts) > 1 else [])], parts[0]))
                    for i, part in enumerate(parts[1:], 2):
                        last = [("WARC-Segment-Total-Length", len(block))] if i == len(parts) else []
                        out.append(_record("continuation", f"{me}:{i}", [("WARC-Segment-Origin-ID", f"<{me}>"), ("WARC-Segment-Number", i), *last], part))
                held += len(data)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    mean = whole.select(F.avg(F.octet_length("payload")).alias("m")).first().m or 1
    options = {"compression": "gzip"} if compress else {}
    records = rows.select("page_id", "url", "payload", "first_id", "first_n", "n").mapInArrow(render, "value string")
    records.write.options(**options).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 500)))).text(path)
    discard(whole, copies)


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in data[at:end].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if len(block) != size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, block


KEPT = ("warc-type", "x-page-id", "warc-payload-digest", "x-payload-length", "warc-refers-to")


#: Ids as write_archives gives them: the page, then a number of its own.
OWN_ID = re.compile(r"<urn:page:(-?\d+)(?::\d+)*>")


def _page(head: str, block: bytes) -> tuple:
    kind, page, said, size, refers = head.split("\n")
    label, _, said = said.rpartition(":")
    said = said.upper() if label.lower() in ("", "sha1") and said else None
    page_id = int(page) if page.removeprefix("-").isdigit() else None
    if kind == "revisit":
        origin = OWN_ID.fullmatch(refers)
        return page_id, None, int(size) if size.isdigit() else None, said, kind, int(origin[1]) if origin else None, None
    top, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in top.lower() else body
    own = digest(payload)
    return page_id, payload, len(payload), own, kind, None, own == said if said else None


READ = ("response", "revisit", "continuation")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: page_id, payload, its length and digest, record_type, refers_to, verified.

    A group of segments that lacks one, or whose joined length isn't the total that its last segment
    declares, raises ValueError; so does broken framing.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw  # all members: archives may have one per record
                out: list[tuple] = []
                held = 0
                for head, block in _parse(raw):
                    if head["warc-type"] not in READ and "warc-segment-number" not in head:
                        continue
                    origin = head.get("warc-segment-origin-id") or head["warc-record-id"]
                    kept = "\n".join(head.get(k, "") for k in KEPT)
                    out.append((origin, int(head.get("warc-segment-number", 0)), int(head.get("warc-segment-total-length", -1)), kept, block))
                    held += len(block)
                    if held > 4 << 20:
                        yield table(out)
                        out, held = [], 0
                yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["origin", "segment", "total", "head", "block"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        for batch in batches:
            rows = [_page(h, b) for h, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"])

    # a task takes files by size
    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)
    whole = records.where(F.col("segment") == 0).select("head", "block")
    parts = records.where(F.col("segment") > 0).groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "head", "block"))).alias("parts"), F.max("total").alias("total"))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, p) -> a || p.block)")
    complete = (F.element_at("parts", -1)["segment"] == F.size("parts")) & (F.octet_length("block") == F.col("total"))
    parts = parts.withColumn("block", joined).withColumn("head", F.element_at("parts", 1)["head"])
    parts = parts.where(F.substring_index("head", "\n", 1).isin(*READ))  # the segments of other records go together
    parts = parts.select("head", F.when(complete, F.col("block")).otherwise(F.raise_error(F.lit("segments are missing"))).alias("block"))
    return whole.unionByName(parts).mapInArrow(decode, PAGE)


def archive_round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
