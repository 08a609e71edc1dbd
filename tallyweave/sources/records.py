"""CSV files of any size as rows of text, read in many ranges of a file although quotes may hold line breaks.

Spark's text reader deals a file out in ranges that begin at a line. Whether a range begins within
quotes depends on all text before it, so a first scan goes through each range twice, as if it began
outside and as if inside, and notes how it ends and how many records begin in it. Composing that in
the order of the ranges tells how each one really begins and the number of its first record. A
second scan cuts the ranges into records and these into fields; a record that goes on in the next
ranges is put together from its pieces, which are all that is shuffled.

A quote opens a field at its beginning only; within quotes a doubled quote is a quote; elsewhere
quotes are ordinary characters. Lines end with \\n or \\r\\n; blank lines are no records. The first
record of each file is its header.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.session import ship

_BYTE_ORDER_MARK = b"\xef\xbb\xbf"
#: Instead of a number of fields: bytes that are no UTF-8; a record that cannot be cut into fields.
NO_TEXT, NO_RECORD = -1, -2


class Dialect:
    """How records and fields end; the separator is one ASCII character."""

    def __init__(self, sep: str = ","):
        self.sep = sep
        s = re.escape(sep.encode())
        self.quoted = re.compile(rb'(?<![^\n' + s + rb'])"(?:[^"]++|"")*+("|\Z)')
        self.rest = re.compile(rb'(?:[^"]++|"")*+("|\Z)')

    def __reduce__(self):
        return Dialect, (self.sep,)

    def ends(self, data: bytes, inside: bool) -> tuple[list[int], bool]:
        """Where records end (after their line end) in whole lines that begin inside quotes or not, and whether they end inside."""
        out, at, open_ = [], 0, False
        if b'"' not in data:
            return ([] if inside else (np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1).tolist()), inside
        if inside:
            m = self.rest.match(data)
            if not m.group(1):
                return out, True
            at = m.end()
        for m in self.quoted.finditer(data, at):
            low, high = m.span()
            while (k := data.find(b"\n", at, low)) >= 0:
                at = k + 1
                out.append(at)
            at, open_ = high, not m.group(1)
        if not open_:
            while (k := data.find(b"\n", at)) >= 0:
                at = k + 1
                out.append(at)
        return out, open_

    def table(self, records: list[bytes], width: int) -> list[pa.Array]:
        """The number of fields of each record, and its first ``width`` fields."""
        data = b"".join(records)
        names = [f"c{i}" for i in range(width)]
        try:  # all records have ``width`` fields, as is usual
            made = pc.read_csv(pa.BufferReader(data), pc.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=names), pc.ParseOptions(delimiter=self.sep, newlines_in_values=True), pc.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False))
            if made.num_rows == len(records):
                return [pa.array([width] * len(records), pa.int32()), *(c.combine_chunks() for c in made.columns)]
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            pass
        rows = [self.fields(r) for r in records]
        return [pa.array([n for n, _ in rows], pa.int32()), *(pa.array([r[i] if i < len(r) else None for _, r in rows], pa.string()) for i in range(width))]

    def fields(self, record: bytes) -> tuple[int, list[str]]:
        """How many fields a record has, and these."""
        csv.field_size_limit(sys.maxsize)
        try:
            rows = list(csv.reader(io.StringIO(record.decode(), newline=""), delimiter=self.sep))
        except UnicodeDecodeError:
            return NO_TEXT, []
        except csv.Error:
            return NO_RECORD, []
        return (len(rows[0]), rows[0]) if len(rows) == 1 else (NO_RECORD, [])


def _blank(record: bytes) -> bool:
    return not record.strip(b" \t\r\n")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the range in the file) and the bytes of each line without its line end."""
    return spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.col("value").cast("binary").alias("line"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, bytes]]:
    """Some lines of one range at a time: (file, start), whether they are its first, and the lines."""
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        files, starts, lines = b.column(0).dictionary_encode(), b.column(1).to_numpy(), b.column(2)
        which = files.indices.to_numpy()
        borders = [0, *(np.flatnonzero((which[1:] != which[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), b.num_rows]
        for i, j in zip(borders, borders[1:], strict=False):
            key = files.dictionary[which[i]].as_py(), int(starts[i])
            data = compute.binary_join(pa.ListArray.from_arrays(pa.array([i, j], pa.int32()), lines), b"\n")[0].as_py() + b"\n"
            yield key, key != now, data.removeprefix(_BYTE_ORDER_MARK) if key != now and not key[1] else data
            now = key


class Range:
    """A range's lines as they come, cut into records; whether the range begins inside quotes is given."""

    def __init__(self, dialect: Dialect, inside: bool):
        self.dialect, self.inside, self.foreign, self.held = dialect, inside, inside, b""

    def add(self, data: bytes) -> tuple[bytes | None, list[bytes]]:
        """The end of the record that the range began within, where it comes; and whole records."""
        ends, self.inside = self.dialect.ends(data, self.inside)
        if not ends:
            self.held += data
            return None, []
        cut = [self.held + data[: ends[0]], *(data[a:b] for a, b in zip(ends, ends[1:], strict=False))]
        self.held = data[ends[-1] :]
        other = None
        if self.foreign:
            other, self.foreign = cut.pop(0), False
        return other, [r for r in cut if not _blank(r)]


def scanned(lines: DataFrame, dialect: Dialect) -> DataFrame:
    """A row for each range: if it begins outside (0) or inside (1) quotes, whether it ends inside, and how many records begin in
    it; for the first range of a file its first record, too."""
    ship(lines.sparkSession)
    names = ["file", "start", "head", "ends0", "n0", "ends1", "n1"]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ways, counts, head = None, [], [], None

        def told() -> pa.RecordBatch:
            ends = [v for w, n in zip(ways, counts, strict=True) for v in (w.inside, n + (w.inside and not w.foreign))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, head, *ends), kinds, strict=True)], names)

        for k, fresh, data in _blocks(batches):
            if fresh:
                if key:
                    yield told()
                key, ways, counts, head = k, [Range(dialect, False), Range(dialect, True)], [0, 0], None
            for i, w in enumerate(ways):
                _, records = w.add(data)
                counts[i] += len(records)
                if not i and not k[1] and head is None and records:
                    head = records[0]
        if key:
            yield told()

    return lines.mapInArrow(run, "file string, start bigint, head binary, ends0 boolean, n0 bigint, ends1 boolean, n1 bigint")


@dataclass
class Plan:
    """How each range begins: inside quotes or not, the number in its file of the first record that begins in it, and how many rows
    come before the file. The files' headers, the number of rows, and whether a file ends within quotes."""

    begins: dict[tuple[str, int], tuple[bool, int, int]]
    heads: list[bytes]
    rows: int
    unclosed: bool


def composed(ranges: list) -> Plan:
    """From the rows of ``scanned``, one for each range."""
    plan, file, inside, at, before = Plan({}, [], 0, False), None, False, 0, 0
    for r in sorted(ranges, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            plan.unclosed |= inside
            before, file, inside, at = before + max(0, at - 1), r["file"], False, 0
            plan.heads += [] if r["head"] is None else [bytes(r["head"])]
        plan.begins[r["file"], r["start"]] = inside, at, before
        at += r["n1"] if inside else r["n0"]
        inside = r["ends1"] if inside else r["ends0"]
    plan.rows, plan.unclosed = before + max(0, at - 1), plan.unclosed or inside
    return plan


def rows_of(lines: DataFrame, plan: Plan, dialect: Dialect, width: int) -> DataFrame:
    """row (from 0, in the order of files and lines), n (its number of fields, or NO_TEXT or NO_RECORD), and the fields c0, c1, ..."""
    spark = lines.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(plan.begins)  # three numbers for each range
    fields = [T.StructField("row", T.LongType()), T.StructField("n", T.IntegerType()), *(T.StructField(f"c{i}", T.StringType()) for i in range(width))]
    pieced = [*fields, T.StructField("place", T.LongType()), T.StructField("piece", T.BinaryType())]
    names = [f.name for f in pieced]

    def whole(first: int, records: list[bytes]) -> pa.RecordBatch:
        nothing = [pa.nulls(len(records), pa.int64()), pa.nulls(len(records), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(records)), pa.int64()), *dialect.table(records, width), *nothing], names)

    def piece(row: int, place: int, data: bytes) -> pa.RecordBatch:
        nothing = [pa.nulls(1, pa.int32()), *(pa.nulls(1, pa.string()) for _ in range(width))]
        return pa.RecordBatch.from_arrays([pa.array([row]), *nothing, pa.array([place]), pa.array([data], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, at, before = None, None, 0, 0

        def left() -> Iterator[pa.RecordBatch]:
            """What a range ends within: a record that began here, or long before."""
            number = at - 1 if now.foreign else at
            if now.held and number > 0:
                yield piece(before + number - 1, key[1], now.held)

        for k, fresh, data in _blocks(batches):
            if fresh:
                if key:
                    yield from left()
                inside, at, before = shared.value[k]
                key, now = k, Range(dialect, inside)
            other, records = now.add(data)
            if other is not None and at > 1:
                yield piece(before + at - 2, key[1], other)
            if not at and records:
                at, records = 1, records[1:]  # the header
            if records:
                yield whole(before + at - 1, records)
                at += len(records)
        if key:
            yield from left()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = [b"".join(p["piece"] for p in parts) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *dialect.table(records, width)], names[:-2])

    made = lines.mapInArrow(run, T.StructType(pieced))
    # at most two pieces for a range: the end of a record and the beginning of one
    pieces = made.where("piece is not null").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("parts"))
    return made.where("piece is null").drop("place", "piece").unionByName(pieces.mapInArrow(join, T.StructType(fields)))
