"""WARC archives with segmented records.

Writing: a page is an HTTP response record with its payload in chunked transfer
coding. A block longer than ``segment`` bytes is cut: the first record has
segment number 1, the others are continuation records that name the first as
their origin, and the last one tells the total length. Of pages with equal
payloads of at least ``least`` bytes the one with the largest id is the response
and the others are revisit records that name it and carry no payload.

Reading: records are parsed as a stream. Continuations are grouped by their
origin's id, ordered by segment number, checked against the total length and
joined; then the chunked framing is taken away. A revisit's payload figures are
those of the record it names.

A null payload is empty; a null url or id is written as empty. Rows of one id
and payload are records of their own, of which one is the response. An empty
table writes no archive and reads as an empty one. A record that is damaged, or
has a segment missing, fails the job with its id.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfield.llm.common import NO_ID, Bench, opened, partitions, write_once

#: Bytes of a block in one record, of a chunk of the transfer coding, of an archive before a new one begins, of a payload that may be a revisit.
SEGMENT, CHUNK, ARCHIVE, LEAST = 1 << 20, 1 << 13, 256 << 20, 1000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLAN = "page_id long, row long, url string, html binary, digest string, keep_id long, keep_row long"
RECORD = (
    "record_id string, type string, origin string, segment int, total long, page_id long, payload_digest string, refers_record string, refers_to long, "
    "payload_bytes long, block binary"
)


def record_id(page: int, row: int, segment: int = 1) -> str:
    """A name that a task run again gives as well."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{row}/{segment}')}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts.append(b"%x\r\n%s\r\n" % (len(piece), piece))
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has no end")
        parts.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A gzip member of its own, as archives are compressed."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def page_records(row: dict, segment: int) -> Iterator[bytes]:
    page, own = row["page_id"], record_id(row["page_id"], row["row"])
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    shared = [("WARC-Target-URI", url), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", page)]
    if row["keep_row"] is not None and row["keep_row"] != row["row"]:
        yield record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared, ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
             ("WARC-Refers-To", record_id(row["keep_id"], row["keep_row"])), ("X-Refers-To-Page-Id", row["keep_id"])],
            REVISIT_HEAD,
        )
        return
    block = HEAD + chunked(row["html"])
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, ("WARC-Payload-Digest", f"sha1:{row['digest']}")]
    yield record(first + ([("WARC-Segment-Number", 1)] if len(parts) > 1 else []), parts[0])
    for number, part in enumerate(parts[1:], 2):
        end = [("WARC-Segment-Total-Length", len(block))] if number == len(parts) else []
        yield record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page, row["row"], number)), ("WARC-Target-URI", url), ("WARC-Date", DATE),
             ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number), *end],
            part,
        )


def write_archives(batches: Iterator[pa.RecordBatch], folder: str, segment: int, archive: int) -> Iterator[pa.RecordBatch]:
    """A task's records in archives of about ``archive`` bytes; yields the names of the archives it finished."""
    rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
    row = next(rows, None)

    def fill() -> Iterator[bytes]:
        nonlocal row
        size = 0
        while row is not None and size < archive:
            for raw in page_records(row, segment):
                size += len(raw)
                yield raw
            row = next(rows, None)

    while row is not None:
        yield pa.RecordBatch.from_pydict({"name": [write_once(folder, "pages.warc.gz", fill())]})


def plan(pages: DataFrame, page_id: str, url: str, html: str, least: int, bench: Bench) -> DataFrame:
    """Every page with its digest and, where others share a payload long enough, the page that is the response."""
    own = pages.select(
        F.coalesce(F.col(page_id).cast("long"), F.lit(NO_ID)).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("html"),
    )
    rows = bench.keep(own.select("*", F.monotonically_increasing_id().alias("row"), F.sha1("html").alias("digest")), "rows")
    long_enough = rows.where(F.octet_length("html") >= least)
    groups = long_enough.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    chosen = bench.keep(groups.select("digest", F.col("keep.page_id").alias("keep_id"), F.col("keep.row").alias("keep_row")), "chosen")
    # Short payloads have no group to look for; a hot digest's one row on the right is joined to split parts of the left.
    found = rows.where(F.octet_length("html") >= least).join(chosen, "digest", "left")
    short = rows.where(F.octet_length("html") < least).select("*", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"))
    return found.unionByName(short).select("page_id", "row", "url", "html", "digest", "keep_id", "keep_row")


def write_warc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, segment: int = SEGMENT, archive: int = ARCHIVE,
) -> DataFrame:
    """Write the archives; the index has the name of each."""
    bench = Bench(pages.sparkSession, "warc")
    index = bench.keep(plan(pages, page_id, url, html, least, bench).mapInArrow(lambda b: write_archives(b, folder, segment, archive), "name string"), "index")
    bench.drop("rows", "chosen")
    return index


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive, one at a time."""
    while True:
        line = source.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := source.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = source.read(size)
        if len(block) != size:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


def figures(block: bytes, digest: str) -> tuple[int, str]:
    """Length and digest of a response's payload, which must be the one its header names."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    found = hashlib.sha1(payload).hexdigest()
    if digest and digest != found:
        raise ValueError(f"a payload has digest {found}, not {digest}")
    return len(payload), found


def parse(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """A row per record; blocks only of segmented ones, the others are finished at once."""
    system, root = opened(folder)
    schema = pa.schema([
        ("record_id", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()),
        ("payload_digest", pa.string()), ("refers_record", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("block", pa.binary()),
    ])
    for batch in batches:
        for name in batch.column("name").to_pylist():
            with system.open_input_stream(f"{root}/{name}") as raw:
                held, size = [], 0
                for headers, block in read_records(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)):
                    kind, number = headers["warc-type"], headers.get("warc-segment-number")
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    row = dict.fromkeys(schema.names)
                    row |= {"record_id": headers["warc-record-id"], "type": kind, "payload_digest": digest or None}
                    row["page_id"] = int(headers["x-page-id"]) if "x-page-id" in headers else None
                    if number:
                        row |= {"origin": headers.get("warc-segment-origin-id", row["record_id"]), "segment": int(number), "block": block}
                        row["total"] = int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None
                        size += len(block)
                    elif kind == "response":
                        row["payload_bytes"], row["payload_digest"] = figures(block, digest)
                    elif kind == "revisit":
                        row |= {"refers_record": headers["warc-refers-to"], "refers_to": int(headers["x-refers-to-page-id"])}
                    held.append(row)
                    if size >= 4 << 20 or len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)


def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of one record side by side become its payload's figures."""
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            parts = row["parts"]
            numbers = [p["segment"] for p in parts]
            block = b"".join(p["block"] for p in parts)
            totals = {p["total"] for p in parts} - {None}
            if numbers != list(range(1, len(numbers) + 1)) or totals != {len(block)}:
                raise ValueError(f"record {row['origin']} has segments {numbers} of {len(block)} bytes and total length {totals}")
            first = parts[0]
            out.append((row["origin"], first["type"], first["page_id"], *figures(block, first["payload_digest"])))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["record_id", "type", "page_id", "payload_bytes", "payload_digest"]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)


def read_warc(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    bench = Bench(spark, "warc-read")
    records = bench.keep(index.repartition(partitions(index)).mapInArrow(lambda b: parse(b, folder), RECORD), "records")
    # A record's segments are what one payload is cut into: they are as large as that payload, whatever the table holds.
    cut = records.where("origin IS NOT NULL").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "total", "type", "page_id", "payload_digest", "block"))).alias("parts")
    )
    joined = cut.mapInArrow(reassemble, "record_id string, type string, page_id long, payload_bytes long, payload_digest string")
    single = records.where("origin IS NULL")
    fields = ["record_id", "type", "page_id", "payload_bytes", "payload_digest"]
    responses = bench.keep(single.where("type = 'response'").select(*fields).unionByName(joined), "responses")
    of = responses.select(F.col("record_id").alias("refers_record"), F.col("payload_bytes").alias("bytes"))
    revisits = single.where("type = 'revisit'").join(of, "refers_record")
    none = F.lit(None).cast("long")
    both = responses.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), none.alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to")
    )
    unnull = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return both.select(unnull("page_id"), "payload_bytes", "payload_digest", "record_type", unnull("refers_to"))
