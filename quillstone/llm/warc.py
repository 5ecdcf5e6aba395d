"""WARC archives: records, segments, and their reassembly.

A response is an HTTP message with chunked transfer framing. A block longer than SEGMENT bytes is cut
into a first record and continuation records that carry the origin's id and a segment number; the last
one carries the total length. Rows that share a payload are one response (largest page_id) and revisits. Each record
is a gzip member of its own, so a reader can take single records by their offsets.

Nulls and edges: a null html is an empty payload; a null url is written as "urn:page:<page_id>", one of
more than URL characters by its SHA-1; empty
tables give no records. Each row has a record of its own: where a page_id is null or occurs again, the record's id
goes on with the digest, the url's SHA-1 and a number among equal rows. Rows that share the largest page_id of their
payload are a response each. A row without page_id is written as a revisit of a page with its payload, or else as a
response; the query gives both as revisits that refer to no page, as its SQL does. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged, table

#: Bytes of a record's block beyond which it is segmented.
SEGMENT = 16 * 1024
#: Bytes of one chunk of the transfer framing.
CHUNK = 4096
#: Bytes of blocks that are decoded at once.
PART = 4 << 20
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"
#: Last byte of every gzip member of less than 16 MB.
MEMBER_END = b"\0"
#: Characters of the longest url that is written as it stands.
URL = 64 * 1024
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(payload):
    """Bare base32 of the SHA-1 of a binary or string column, in SQL functions alone: 5 hex digits are 4 letters."""
    digest = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    out = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over, broken framing raises."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is missing")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def record(kind: str, rid: str, block: bytes, **headers: str) -> bytes:
    """One WARC record without its closing blank lines."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": DATE} | {k.replace("_", "-"): v for k, v in headers.items()} | {"Content-Length": str(len(block))}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, rid: str, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """A page's records. rid, refers_to: ids of its own record and of the response that it revisits."""
    url = url or (rid if page_id is None else f"urn:page:{page_id}")
    url = url if len(url) <= URL else f"urn:sha1:{hashlib.sha1(url.encode()).hexdigest()}"
    base = {"WARC_Target_URI": re.sub(r"[\s\x00-\x20]", "%20", url), "WARC_Payload_Digest": f"sha1:{digest}"}
    if refers_to is not None:
        return [record("revisit", rid, HTTP, **base, WARC_Refers_To=f"<{refers_to}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", Content_Type="application/http; msgtype=response")]
    block = HTTP + frame(payload)
    if len(block) <= segment:
        return [record("response", rid, block, **base, Content_Type="application/http; msgtype=response")]
    cut = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record("response", rid, cut[0], **base, WARC_Segment_Number="1", Content_Type="application/http; msgtype=response")]
    for k, part in enumerate(cut[1:], 2):
        last = {"WARC_Segment_Total_Length": str(len(block))} if k == len(cut) else {}
        out.append(record("continuation", f"{rid}:{k}", part, **base, WARC_Segment_Origin_ID=f"<{rid}>", WARC_Segment_Number=str(k), **last))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive; what doesn't parse raises."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) != n or data[at : at + 4] != END:
            raise ValueError("record is cut short")
        at += 4
        yield head, block


def dedup_plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, rid, refers_to: the last is the record id of the largest page_id with the same payload, null there.

    The largest id of a payload is pre-aggregated, so a payload that many pages share is one row to join. Rows of
    page_ids that occur again or are null are counted before they meet, so equal ones are one row until they are written.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    again = pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or page_id is null").select("page_id", F.lit(True).alias("again"))
    if not again.limit(1).count():
        best = rows.groupBy("digest").agg(F.max("page_id").alias("best_id"))
        name = lambda c: F.concat(F.lit("urn:page:"), c)
        return rows.join(best, "digest").select("page_id", "url", "html", "digest", name("page_id").alias("rid"), F.when(F.col("page_id") < F.col("best_id"), name("best_id")).alias("refers_to"))
    rows = rows.withColumn("url", F.coalesce("url", F.lit(""))).join(again, "page_id", "left").withColumn("again", F.coalesce("again", F.col("page_id").isNull()))
    counted = rows.where("again").groupBy("page_id", "url", "digest", "again").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
    rows = rows.where("not again").withColumn("n", F.lit(1).cast("long")).unionByName(counted)
    best = rows.groupBy("digest").agg(F.max(F.struct("page_id", "url", "again")).alias("best"))
    rows = rows.join(best, "digest").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))

    def named(of: str, nth) -> Column:
        tail = F.concat(F.lit(":"), "digest", F.lit(":"), F.sha1(F.col(f"{of}url")), F.lit(":"), nth)
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(f"{of}page_id").cast("string"), F.lit("")), F.when(F.col(f"{of}again"), tail).otherwise(""))

    visit = F.col("best.page_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best.page_id")))
    return rows.select("page_id", "url", "html", "digest", named("", F.col("nth")).alias("rid"), F.when(visit, named("best.", F.lit(1))).alias("refers_to"))


def write_archives(pages: DataFrame, where: str, segment: int = SEGMENT) -> None:
    """Write WARC files of dedup_plan's pages, a gzip member a record, by Spark's own writer, so that lost tasks and repeats leave whole files only."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            size = 0
            # rows are made objects one at a time: a batch of pages isn't held twice
            for r in (tuple(b.column(c)[i].as_py() for c in ("page_id", "url", "html", "digest", "rid", "refers_to")) for i in range(b.num_rows)):
                for x in page_records(r[0], r[1], (r[2] or "").encode(), r[3], r[4], r[5], segment):
                    out.append(member(x + END)[: -len(MEMBER_END)])
                    size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = pages.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    # the separator that the text writer puts after each row is the end of a gzip member: the high byte of its length
    made.write.mode("overwrite").option("lineSep", MEMBER_END.decode()).option("maxRecordsPerFile", 2000).option("compression", "none").text(where)


def member(record_: bytes) -> bytes:
    """A record as a gzip member of its own."""
    if len(record_) >> 24:
        raise ValueError("a record has 16 MB or more")
    return gzip.compress(record_, 4, mtime=0)


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member of a file holds."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, out, step = zlib.decompressobj(31), [], 1 << 15
        while not z.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut short")
            out.append(z.decompress(view[at : at + step]))
            at += min(step, len(data) - at) - len(z.unused_data)
        yield b"".join(out)


def read_records(spark: SparkSession, where: str) -> DataFrame:
    """A row for each record: rid, kind, origin, segment, total, digest, refers_to, block."""
    schema = "rid string, kind string, origin string, segment int, total long, digest string, refers_to string, url string, block binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("rid", pa.string()), ("kind", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("block", pa.binary())])
        bare = lambda v: v.strip("<>") if v else None
        for b in batches:
            for data in b.column("content"):
                out, size = [], 0
                for h, block in chain.from_iterable(map(parse, members(data.as_py()))):
                    out.append((bare(h["warc-record-id"]), h["warc-type"], bare(h.get("warc-segment-origin-id")), int(h["warc-segment-number"]) if "warc-segment-number" in h else None, int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, bare(h.get("warc-refers-to")), h.get("warc-target-uri"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)], schema=types)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)], schema=types)

    return spark.read.format("binaryFile").load(where).select("content").mapInArrow(rows, schema)


def reassemble(records: DataFrame) -> DataFrame:
    """Responses with whole blocks: rid, digest, url, n_segments, block.

    Segments meet by origin id and are put in order of their numbers; a missing or repeated number, or a
    length other than the total, raises. Records that aren't segmented pass without a shuffle.
    """
    whole = records.where("kind = 'response' and segment is null").select("rid", "digest", "url", F.lit(1).alias("n_segments"), "block")
    parts = records.where("kind in ('response', 'continuation') and segment is not null")
    by = parts.groupBy(F.coalesce("origin", "rid").alias("rid")).agg(
        F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("segment") == 1, F.col("url"))).alias("url"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"),
    )
    ordered = (F.size("s") == F.element_at("s", -1)["segment"]) & (F.size(F.array_distinct("s.segment")) == F.size("s"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = b.column("s")[i].as_py()
                block = b"".join(x["block"] for x in s)
                if not b.column("ordered")[i].as_py() or b.column("total")[i].as_py() != len(block):
                    raise ValueError(f"segments of {b.column('rid')[i].as_py()} don't fit together")
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("rid", "digest", "url")), pa.array([len(s)], pa.int32()), pa.array([block], pa.binary())], ["rid", "digest", "url", "n_segments", "block"])

    return whole.unionByName(by.withColumn("ordered", ordered).mapInArrow(joined, "rid string, digest string, url string, n_segments int, block binary"))


def decode(responses: DataFrame) -> DataFrame:
    """page id, payload, its length and digest; a payload that doesn't have its record's digest raises."""
    import base64

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # parts of a batch, PART bytes of blocks each (or one block)
            sizes, at = pc.binary_length(b.column("block")).to_pylist(), 0
            while at < len(sizes):
                stop, size = at + 1, sizes[at]
                while stop < len(sizes) and size + sizes[stop] <= PART:
                    size += sizes[stop]
                    stop += 1
                part, at = b.slice(at, stop - at), stop
                out = []
                for block in part.column("block"):
                    head, _, body = block.as_py().partition(END)
                    out.append(unframe(body) if b"transfer-encoding: chunked" in head.lower() else body)
                digests = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in out]
                if digests != part.column("digest").to_pylist():
                    raise ValueError("a payload doesn't have its record's digest")
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("url"), pa.array(digests), pa.array(list(map(len, out)), pa.int64()), part.column("n_segments"), pa.array(out, pa.binary())], ["rid", "url", "digest", "payload_bytes", "n_segments", "payload"])

    return responses.mapInArrow(rows, "rid string, url string, digest string, payload_bytes long, n_segments int, payload binary")


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_dir(spark)
    write_archives(dedup_plan(table(spark, sf_dir, "pages")), f"{where}/warc")
    # the archives are parsed once: what later steps need of each record is small but for the blocks of responses
    records = read_records(spark, f"{where}/warc")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)", 1).try_cast("long")
    full = staged(decode(reassemble(records)).select("rid", page("rid").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "n_segments"), f"{where}/responses")
    visits = records.where("kind = 'revisit'").select(page("rid").alias("page_id"), F.col("refers_to").alias("of"), F.col("digest").alias("payload_digest"))
    of = full.select(F.col("rid").alias("of"), "payload_bytes", F.col("payload_digest").alias("full_digest"))
    refers_to = F.when(F.col("page_id").isNotNull(), page("of")).alias("refers_to")
    seen = visits.join(of, "of", "left").select("page_id", "payload_bytes", F.coalesce("full_digest", "payload_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), refers_to)
    kind = F.when(F.col("page_id").isNull(), "revisit").otherwise("response").alias("record_type")
    return full.select("page_id", "payload_bytes", "payload_digest", kind, F.lit(None).cast("long").alias("refers_to")).unionByName(seen)


_CHARS = " || ".join(f"substr('{BASE32}', (('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s} & 31)::BIGINT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
SQL = {
    "op4_warc_segments": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_CHARS} AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < best THEN best END AS refers_to
FROM m""",
}
QUERIES = {"op4_warc_segments": op4_warc_segments}
