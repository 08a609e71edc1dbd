"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing is DataFrame expressions only. Of the records with equal payloads of ``least`` bytes or
more, the one with the largest page_id is a response and the others are revisits of it; a
response's payload goes in chunked transfer framing, and a block of more than
``SEGMENT_BYTES`` is cut into a first segment and continuation records. Records are written
as text whose line separator is the blank line pair that ends a WARC record, so that any
file system Spark can write to will do; files are gzip streams, bounded by ``FILE_RECORDS`` and ``FILE_BYTES``.
Payloads are not shuffled while at most ``BROADCAST_RESPONSES`` payloads have revisits.

Reading unpacks an archive file (gzip members too) piece by piece and lets a record go as soon
as it is whole, groups segments by their origin's
identifier, orders them by segment number, verifies the numbering, the total length and the
payload digest, and decodes the chunked framing. Revisits carry the length of the payload
they stand for in their HTTP header.

Defined results: a null html is an empty payload; a page with a null page_id is archived
without a page header and comes back with a null page_id, and is referred to by nobody; rows
that are equal in page_id, url and html come back as often as they were written (with the
largest page_id each is a response); an empty table makes an empty archive; columns other
than page_id, url and html are not archived; a record whose checks fail comes back with
verified = false and without payload columns.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import prepare, scratch_path, stored, written

SEGMENT_BYTES = 4096
CHUNK_BYTES = 1024
FILE_RECORDS = 2000
#: A file's records, unpacked, with a header of HEADER_BYTES each, come to this much.
FILE_BYTES, HEADER_BYTES = 16 << 20, 1024
#: Bytes of a packed file that are unpacked at a time, and of rows in a batch.
PIECE_BYTES, BATCH_BYTES = 64 << 10, 4 << 20
#: Payloads with revisits whose list is broadcast (some 60 bytes each); beyond, rows are shuffled with this many salts.
BROADCAST_RESPONSES, SALTS = 500_000, 16
LEAST_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_CRLF = "\r\n"
_ARCHIVED = "origin string, number int, total bigint, kind string, page_id string, refers_to string, digest string, block binary, verified boolean"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five of them are four characters."""
    five = lambda i: F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(five(i), s).bitwiseAND(31) + 1, F.lit(1)) for i in range(8) for s in (15, 10, 5, 0)))


def _text(binary: Column) -> Column:
    return binary.cast("string")


def with_record_types(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), digest (base32), and refers_to of revisits."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    every = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    light = every.select("page_id", "sha1", F.octet_length("payload").alias("size")).where("page_id is not null")
    last = light.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").select("sha1", "last")
    last = written(last, "responses", compact=True)
    if last.count() <= BROADCAST_RESPONSES:
        every = every.join(F.broadcast(last), "sha1", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("last"), F.col("last"))).drop("last")
    else:  # a common payload's pages are spread by a salt
        salted = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        refers = light.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha1", "salt"])
        refers = refers.where("page_id <> last").select("page_id", "sha1", F.col("last").alias("refers_to")).distinct()
        every = every.join(refers, ["page_id", "sha1"], "left")
    return every.withColumn("digest", base32_of_hex(F.col("sha1")))


def archive_records(pages: DataFrame, least: int = LEAST_REVISIT_BYTES, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The records of the archive as text, without the blank lines that end each."""
    p = with_record_types(pages, least)
    size = F.octet_length("payload")
    starts = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
    frames = F.transform(starts, lambda i: F.concat(F.lower(F.hex(F.least(F.lit(chunk), size - i * chunk).cast("bigint"))), F.lit(_CRLF), _text(F.substring("payload", i * chunk + 1, F.lit(chunk))), F.lit(_CRLF)))
    chunked = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Transfer-Encoding: chunked{_CRLF}{_CRLF}"), F.array_join(frames, ""), F.lit(f"0{_CRLF}{_CRLF}"))
    bare = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), size.cast("string"), F.lit(f"{_CRLF}{_CRLF}"))
    revisit = F.col("refers_to").isNotNull()
    name = F.md5(F.to_json(F.struct(F.col("page_id").cast("string").alias("p"), F.col("url").alias("u"), F.col("digest").alias("d"))))
    origin = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")
    p = p.select("page_id", "url", "digest", "refers_to", origin.alias("origin"), F.when(revisit, bare).otherwise(chunked).cast("binary").alias("block"))
    length = F.octet_length("block")
    p = p.withColumn("segments", F.ceil(length / segment).cast("int")).withColumn("number", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    part = F.substring("block", (F.col("number") - 1) * segment + 1, F.lit(segment))
    line = lambda key, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{key}: "), value, F.lit(_CRLF))).otherwise("")
    first, cut = F.col("number") == 1, F.col("segments") > 1
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), "origin", F.when(first, "").otherwise(F.concat(F.lit("#"), F.col("number").cast("string"))), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20"), F.col("url").isNotNull() & first),
        line("WARC-Page-ID", F.col("page_id").cast("string"), F.col("page_id").isNotNull() & first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit & first),
        line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string"), revisit & first),
        line("WARC-Segment-Number", F.col("number").cast("string"), cut),
        line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), "origin", F.lit(">")), ~first),
        line("WARC-Segment-Total-Length", length.cast("string"), cut & (F.col("number") == F.col("segments"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(part).cast("string")),
        F.lit(_CRLF),
    )
    return p.select(F.concat(header, _text(part)).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT_BYTES, segment: int = SEGMENT_BYTES) -> None:
    records = max(1, min(FILE_RECORDS, FILE_BYTES // (segment + HEADER_BYTES)))
    archive_records(pages, least, segment).write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", records).option("compression", "gzip").text(path)


def unpacked(data: bytes) -> Iterator[bytes]:
    """A file's bytes as they are, or those of its gzip members in small pieces."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while view[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(data):
            yield z.decompress(view[at : at + PIECE_BYTES])
            at = min(at + PIECE_BYTES, len(data))
        at -= len(z.unused_data)


class _Window:
    """The part of a stream that is being looked at: ``held`` from ``at`` on."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def reach(self, size: int) -> bool:
        """Hold ``size`` bytes from here on, or what there is; whether more came."""
        parts, have = [self.held[self.at :]] if self.at < len(self.held) else [], len(self.held) - self.at
        before = have
        while have < size and (piece := next(self.pieces, None)) is not None:
            parts.append(piece)
            have += len(piece)
        if have > before:
            self.held, self.at = b"".join(parts), 0
        return have > before

    def find(self, what: bytes) -> int:
        return self.held.find(what, self.at)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; what is not a record is skipped."""
    w = _Window(unpacked(data))
    while True:
        start = w.find(b"WARC/1.")
        if start < 0:
            w.at = max(w.at, len(w.held) - 6)
            if not w.reach(len(w.held) - w.at + 1):
                return
            continue
        w.at = start
        end = w.find(b"\r\n\r\n")
        if end < 0:  # twice as much, so that a header without an end is searched a few times only
            if not w.reach(2 * (len(w.held) - w.at)):
                return
            continue
        headers = {}
        for text in w.held[w.at : end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = text.partition(":")
            headers[key.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            w.at += 7
            continue
        head = end + 4 - w.at
        if len(w.held) - w.at < head + int(size):
            w.reach(head + int(size))
        yield headers, w.held[w.at + head : w.at + head + int(size)]
        w.at = min(w.at + head + int(size), len(w.held))


def decode_chunked(body: bytes) -> bytes:
    """The body without its chunked framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(body[at : at + size])
        at += size + 2


def assemble(segments: list[dict]) -> list[dict]:
    """The records that one origin's segments make up, one for each copy that was archived (``times``: equal segments as one)."""
    by_number: dict[int, list[dict]] = {}
    for s in segments:
        by_number.setdefault(s["number"], []).append(s)
    order = sorted(by_number)
    times = {k: sum(s.get("times", 1) for s in x) for k, x in by_number.items()}
    copies = times[order[0]]
    whole = order == list(range(1, len(order) + 1)) and set(times.values()) == {copies}
    first, last = by_number[order[0]][0], by_number[order[-1]][0]
    block = b"".join(by_number[k][0]["block"] for k in order)
    whole = whole and (last["total"] == len(block) if len(order) > 1 else last["total"] in (None, len(block)))
    made = {"page_id": first["page_id"], "record_type": first["kind"], "refers_to": first["refers_to"], "payload": None, "payload_bytes": None, "payload_digest": None, "verified": False}
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if whole and first["kind"] == "revisit":
        size = fields.get(b"content-length", b"")
        if first["digest"] and size.isdigit():
            made |= {"payload_bytes": int(size), "payload_digest": first["digest"], "verified": True}
    elif whole:
        try:
            payload = decode_chunked(body) if re.search(rb"\bchunked\b", fields.get(b"transfer-encoding", b"").lower()) else body
        except ValueError:
            return [made] * copies
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if first["digest"] in (None, digest):
            made |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "verified": True}
    return [made] * copies


def _is_whole(segments: list[dict]) -> bool:
    """Whether these are all segments of a record, equally many copies of each."""
    numbers = sorted(s["number"] for s in segments)
    last = max(numbers)
    copies = len(numbers) // last
    return numbers == sorted([*range(1, last + 1)] * copies) and (last == 1 and not segments[0]["cut"] or any(s["number"] == last and s["total"] is not None for s in segments))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _ARCHIVED.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _rows_of(data: bytes, payload: bool) -> Iterator[tuple]:
    """Rows of one file: a record once its segments are there, at the end the segments of records that lie elsewhere, too."""
    waiting: dict[str, list[dict]] = {}
    for h, block in parse_records(data):
        if h.get("warc-type") not in ("response", "revisit", "continuation"):
            continue
        origin = (h.get("warc-segment-origin-id") or h.get("warc-record-id", "")).strip("<>")
        number, total = h.get("warc-segment-number", ""), h.get("warc-segment-total-length", "")
        digest = h.get("warc-payload-digest")
        own = waiting.setdefault(origin, [])
        own.append({"number": int(number) if number.isdigit() else 1, "cut": number != "", "total": int(total) if total.isdigit() else None, "kind": h.get("warc-type"), "page_id": h.get("warc-page-id"), "refers_to": h.get("warc-refers-to-page-id"), "digest": digest.removeprefix("sha1:") if digest else None, "block": block})
        if (number == "" or total.isdigit()) and _is_whole(own):
            del waiting[origin]
            for r in assemble(own):
                yield origin, 0, r["payload_bytes"], r["record_type"], r["page_id"], r["refers_to"], r["payload_digest"], r["payload"] if payload else None, r["verified"]
    for origin, own in waiting.items():
        if _is_whole(own):  # a record whose last segment came before others
            for r in assemble(own):
                yield origin, 0, r["payload_bytes"], r["record_type"], r["page_id"], r["refers_to"], r["payload_digest"], r["payload"] if payload else None, r["verified"]
        else:
            for s in own:
                yield origin, s["number"], s["total"], s["kind"], s["page_id"], s["refers_to"], s["digest"], s["block"], None


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archive files under ``path``, where a file has all of a record's segments; else the segments.

    A whole record has number 0, its verdict in ``verified`` and its payload's length and
    digest in ``total`` and ``digest``; its payload is in ``block`` if it is asked for. So
    only records that are spread over files travel in pieces.
    """
    prepare(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for row in _rows_of(data.as_py(), payload):
                    rows.append(row)
                    held += len(row[7] or b"") + 256
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _ARCHIVED)


def reassemble(segments: DataFrame, page_id_type: str = "bigint", payload: bool = True) -> DataFrame:
    """The archived records, verified, from the rows of ``read_archives``; of those spread over files, equal segments are counted first, then all of a record meet in one row."""
    segments = stored(segments)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"] + ["payload"] * payload
    ready = segments.where("number = 0").select("page_id", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "verified", F.col("block").alias("payload")).select(names)
    equal = segments.where("number > 0").groupBy("origin", "number", "total", "kind", "page_id", "refers_to", "digest", "block").agg(F.count("*").alias("times"))
    spread = equal.groupBy("origin").agg(F.collect_list(F.struct("number", "total", "kind", "page_id", "refers_to", "digest", "block", "times")).alias("segments"))
    types = {"page_id": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "verified": pa.bool_()} | ({"payload": pa.binary()} if payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for own in b.column(0) for r in assemble(own.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))

    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, verified boolean" + ", payload binary" * payload
    out = ready.unionByName(spread.select("segments").mapInArrow(run, schema))
    return out.withColumns({c: F.col(c).cast(page_id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Archive the pages in the shared folder, read the archive back and reassemble it."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least)
    return reassemble(read_archives(spark, path, payload=False), pages.schema["page_id"].dataType.simpleString(), payload=False)
