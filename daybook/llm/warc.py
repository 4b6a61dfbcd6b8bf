"""Web archives: write pages as WARC records, read the archives back, put segmented records together again.

Writing: pages whose payload an earlier page has become revisit records. A record's block is an HTTP response with a
chunked body; a block beyond ``segment_bytes`` is continued in further records, each with the origin's id and its
number, the last with the length of the whole block. Files are written by Spark's text writer whose line separator is
the end of a record, so they go to any file system that Spark knows, and a lost task is written anew. Each file is compressed as one.

Reading: each file, compressed or not, is cut at the lengths its records state. Records of one segment are decoded where they are read;
continued ones are grouped by origin, ordered by number, checked against the total length and decoded.

Defined cases: a NULL payload is empty; a NULL page_id is written without the header and read as NULL, and is never the
one that others revisit unless no other has that payload; rows that repeat page_id and payload are alike, so copies of
the first page are responses all; an empty table gives an empty result; other columns are ignored; a record that is cut
short, misses a segment or has a wrong length has a NULL payload and says so in ``fault``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.session import materialize, scratch_path

SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
MIN_REVISIT = 100
FILE_RECORDS = 2048  # a file has so many records at most, hence FILE_RECORDS * SEGMENT_BYTES bytes and headers
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
FIELDS = "page_id string, uri string, record_type string, refers_to string, claimed string, origin string, number int, total long, part binary, payload binary, fault string"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts]) + b"0\r\n\r\n"


def body(block: bytes) -> bytes:
    """The body of an HTTP response, out of its chunks if it has any. Raises ValueError if it is broken."""
    head, sep, rest = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no end of HTTP headers")
    if b"transfer-encoding: chunked" not in head.lower():
        return rest
    out, at = [], 0
    while True:
        end = rest.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size")
        n = int(rest[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = end + 2
        if rest[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk of another size")
        out.append(rest[at : at + n])
        at += n + 2


def record(kind: str, rid: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), *headers, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n" + block


def records_of(row, rid: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    from urllib.parse import quote

    uri = None if row.url is None else quote(row.url, safe="!#$%&'()*+,/:;=?@[]~")
    headers = [("WARC-Target-URI", uri), ("X-Page-ID", row.page_id), ("WARC-Payload-Digest", f"sha256:{row.digest}")]
    top = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row.refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", row.refers_to)]
        return [record("revisit", rid, headers, top + b"\r\n")]
    block = top + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row.payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [record("response", rid, headers, block)]
    out = [record("response", rid, [*headers, ("WARC-Segment-Number", 1)], parts[0])]
    for n, p in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        more = [("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", f"<{rid}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
        out.append(record("continuation", f"{rid}-{n}", more, p))
    return out


def write_archive(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> None:
    """Write the pages below ``path``."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    src = src.withColumn("digest", F.sha2("payload", 256)).withColumn("large", F.length("payload") >= MIN_REVISIT)
    first = src.filter("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first")
    known = src.join(first, (F.col("digest") == F.col("d")) & F.col("large"), "left")
    known = known.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import NAMESPACE_URL, uuid5

        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, len(b), 256):
                out = []
                for row in b.iloc[at : at + 256].itertuples(index=False):
                    k += 1
                    # of the task and the row, so that a task run again writes the same
                    out += records_of(row, f"urn:uuid:{uuid5(NAMESPACE_URL, f'{task}/{k}/{row.page_id}/{row.digest}')}", segment_bytes, chunk_bytes)
                yield pd.DataFrame({"record": out})

    ids = known.select(F.col("page_id").cast("string"), "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", F.col("refers_to").cast("string"))
    out = ids.mapInPandas(run, "record binary")
    # the cast keeps the bytes as they are
    out.select(F.col("record").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of each record; the block is None if the file ends within it."""
    if content[:2] == b"\x1f\x8b":
        import gzip

        content = gzip.decompress(content)
    at, size = 0, len(content)
    while at < size:
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            yield {}, None
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        n = int(headers["content-length"])
        block = content[end + 4 : end + 4 + n]
        yield headers, block if len(block) == n else None
        at = end + 4 + n + len(END)


def read_records(spark: SparkSession, path: str, continued: bool) -> DataFrame:
    """Records of one segment, decoded; or, if ``continued``, the segments of the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for b in batches:
            for content in b["content"]:
                out = []
                for h, block in parsed(content):
                    kind, number = h.get("warc-type"), h.get("warc-segment-number")
                    if (number is not None) != continued:
                        continue
                    payload = part = fault = None
                    if block is None:
                        fault = "cut short"
                    elif continued:
                        part = block
                    elif kind == "response":
                        try:
                            payload = body(block)
                        except ValueError as e:
                            fault = str(e)
                    origin = h.get("warc-segment-origin-id", h.get("warc-record-id"))
                    total = h.get("warc-segment-total-length")
                    claimed = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    out.append((h.get("x-page-id"), h.get("warc-target-uri"), kind, h.get("x-refers-to-page-id"), claimed, origin, number and int(number), total and int(total), part, payload, fault))
                    if len(out) == 512:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, FIELDS)


def joined(key, rows: pd.DataFrame) -> pd.DataFrame:
    """One record of its segments."""
    rows = rows.sort_values("number")
    first, payload, fault = rows.iloc[0], None, None
    parts, total = rows["part"].tolist(), rows["total"].dropna()
    if rows["fault"].notna().any():
        fault = rows["fault"].dropna().iloc[0]
    elif rows["number"].tolist() != list(range(1, len(rows) + 1)) or total.empty:
        fault = "a segment is missing"
    elif int(total.iloc[-1]) != sum(map(len, parts)):
        fault = "segments of another total length"
    else:
        try:
            payload = body(b"".join(parts))
        except ValueError as e:
            fault = str(e)
    row = {"page_id": first["page_id"], "uri": first["uri"], "record_type": first["record_type"], "refers_to": None, "claimed": first["claimed"], "payload": payload, "fault": fault}
    return pd.DataFrame([row])


OUT = ["page_id", "uri", "record_type", "refers_to", "claimed", "payload", "fault"]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: page_id and refers_to as text, uri, record_type, claimed (the digest that the record
    states), payload (binary; NULL for revisits) and fault. A group of segments is no larger than its record."""
    whole = read_records(spark, path, False).select(*OUT)
    kept = "page_id string, uri string, record_type string, refers_to string, claimed string, payload binary, fault string"
    return whole.unionByName(read_records(spark, path, True).groupBy("origin").applyInPandas(joined, kept))


def archive_digests(pages: DataFrame, *, id_col: str = "page_id", **options) -> DataFrame:
    """Write the pages to an archive in the shared folder, read it back, and give page_id, payload_bytes, payload_digest,
    record_type, refers_to and fault per page; a revisit has the figures of the payload it refers to."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    path = scratch_path(spark, "warc")
    write_archive(pages, path, id_col=id_col, **options)
    got = read_archive(spark, path).select(
        F.col("page_id").cast(kind), "record_type", F.col("refers_to").cast(kind), "claimed", F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"), "fault"
    )
    got = materialize(got, "warc-records")
    have = got.filter("record_type = 'response' and digest is not null").groupBy("digest").agg(F.max("n").alias("payload_bytes"))
    seen = got.withColumn("payload_digest", F.coalesce("digest", F.when(F.col("record_type") == "revisit", F.col("claimed"))))
    seen = seen.drop("digest", "claimed").join(have.withColumnRenamed("digest", "d"), F.col("payload_digest") == F.col("d"), "left")
    return seen.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")
