"""Adapters: a CSV file or any DataFrame as the frame that the engine profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyweave.functions.text import MISSING, as_number, column
from tallyweave.plans.batch import kept, total
from tallyweave.sources import records

#: The limit of a service that takes uploads (``most_bytes``); a table on a cluster has none.
UPLOAD_LIMIT_BYTES = 25 * 1024 * 1024
ROW = "__row"
_RAW = "__raw_"


class BadInput(ValueError):
    """The input cannot be read as one flat table with rows and columns."""


@dataclass
class Frame:
    """Typed columns, the text each was read from (where there is one), and the 0-based row position (where asked for)."""

    df: DataFrame
    columns: list[str]
    raw: dict[str, str] = field(default_factory=dict)
    row: str | None = None


def _plain(df: DataFrame, c: str):
    """NaN counts as missing; numbers that are not doubles become doubles only when they are aggregated."""
    kind = df.schema[c].dataType
    return F.when(~F.isnan(column(c)), column(c)) if isinstance(kind, T.DoubleType | T.FloatType) else column(c)


def with_rows(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The frame with a contiguous 0-based position: by ``order``, else in reading order.

    Positions are offsets of the partitions (a table of one row each, broadcast) plus a position within
    the partition, so no task sees more than its own partition.
    """
    if order:
        df = df.repartitionByRange(*(column(c) for c in order)).sortWithinPartitions(*(column(c) for c in order))
    df = kept(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "rows")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    starts = df.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    place = F.col("__at") - F.shiftleft(F.col("__part").cast("bigint"), 33)
    return df.join(F.broadcast(starts), "__part").withColumn(ROW, (F.col("__start") + place).cast("bigint")).drop("__part", "__at", "__start")


def from_dataframe(df: DataFrame, rows: bool = False, order: list[str] | None = None) -> Frame:
    """Any DataFrame as a frame; text columns are their own raw text."""
    if not df.columns:
        raise BadInput("the table has no columns")
    names = list(df.columns)
    out = df.select(*(_plain(df, c).alias(c) for c in names))
    if rows:
        out = with_rows(out, order)
    return Frame(out, names, {}, ROW if rows else None)


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path of any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def _named(head: list[str]) -> list[str]:
    """Names of the columns; empty ones are numbered by place, repeated ones (also those that differ in case alone) get a number."""
    names: list[str] = []
    taken: set[str] = set()
    for i, c in enumerate(head):
        name, k = c or f"column {i + 1}", 0
        while name.lower() in taken:
            k += 1
            name = f"{c or f'column {i + 1}'}.{k}"
        taken.add(name.lower())
        names.append(name)
    return names


def _records(spark: SparkSession, path: str, most_bytes: int | None, sep: str) -> tuple[DataFrame, list[str]]:
    """row, c0, c1, ... of a CSV path, written once, and the columns' names; whatever keeps it from being one table is a ``BadInput``."""
    try:
        size = file_bytes(spark, path)
        if most_bytes is not None and size > most_bytes:
            raise BadInput(f"the file has {size} bytes; the limit is {most_bytes}")
        dialect, lines = records.Dialect(sep), records.lines_of(spark, path)
        plan = records.composed(records.scanned(lines, dialect).collect() if size else [])  # a row for each range of a file
        if not plan.heads and not plan.rows:
            raise BadInput("the CSV is empty")
        if plan.unclosed:
            raise BadInput("the CSV ends within quotes")
        (n, head), *others = [dialect.fields(h) for h in dict.fromkeys(plan.heads)] or [(records.NO_RECORD, [])]
        if n == records.NO_TEXT or any("\u0000" in c for c in head):
            raise BadInput("the CSV is not text in UTF-8")
        if n == records.NO_RECORD or others or not any(c.strip() for c in head):
            raise BadInput("the files have different headers" if others else "the CSV has no header")
        table = kept(records.rows_of(lines, plan, dialect, len(head)), "csv")
        bad = table.where((F.col("n") > len(head)) | (F.col("n") < 0)).select("row", "n").orderBy("row").head(1)
        if bad:
            row, n = bad[0]
            raise BadInput(f"row {row + 1} " + ("is not text in UTF-8" if n == records.NO_TEXT else "has a line end outside quotes" if n == records.NO_RECORD else f"has {n} fields; the header has {len(head)}"))
        return table.drop("n"), _named(head)
    except BadInput:
        raise
    except Exception as error:
        raise BadInput(f"the CSV cannot be read: {error}") from error


def raw_csv(spark: SparkSession, path: str, most_bytes: int | None = None, sep: str = ",") -> DataFrame:
    """Every field of a CSV file (or of a folder of them) as text, nothing taken as missing; fields that a row lacks are null.

    Files are read in many ranges, whatever their quotes hold. A ``BadInput`` is: no file, nothing in it, more than ``most_bytes``,
    bytes that are no UTF-8, a row with more fields than the header, quotes that are not closed.
    """
    table, names = _records(spark, path, most_bytes, sep)
    return table.drop("row").toDF(*names)


#: What a number in a CSV file looks like; the words for no number are among the missing values.
_CSV_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def from_csv(spark: SparkSession, path: str, rows: bool = True, most_bytes: int | None = None, sep: str = ",") -> Frame:
    """A CSV file: its records are read once, typed columns are projections of them.

    A column whose filled values are all whole numbers becomes bigint, all numbers double; the usual words for missing
    values and fields that a row lacks become null. The texts stay beside the typed columns, for the profile.
    """
    raw, names = _records(spark, path, most_bytes, sep)
    raw = raw.toDF(ROW, *(_RAW + n for n in names))
    text = {c: F.coalesce(column(_RAW + c), F.lit("")) for c in names}
    present = {c: ~F.trim(t).isin(*MISSING) for c, t in text.items()}
    kinds = {"n": present, "k": {c: present[c] & F.trim(t).rlike(_CSV_NUMBER) for c, t in text.items()}, "w": {c: present[c] & F.trim(t).rlike(r"^[+-]?\d{1,18}$") for c, t in text.items()}}
    got = total(raw, {("", "rows"): F.count(F.lit(1))} | {(c, k): F.count_if(of[c]) for k, of in kinds.items() for c in names})
    if not got["", "rows"]:
        raise BadInput("the CSV has no rows")
    kind = {c: None if got[c, "n"] != got[c, "k"] else "bigint" if got[c, "w"] == got[c, "n"] and got[c, "n"] else "double" for c in names}
    typed = [F.when(present[c], F.regexp_replace(F.trim(text[c]), r"(?i)^([+-]?)inf(inity)?$", "$1Infinity").try_cast(kind[c]) if kind[c] else column(_RAW + c)).alias(c) for c in names]
    out = raw.select(*typed, *(text[c].alias(_RAW + c) for c in names), *([ROW] if rows else []))
    return Frame(out, names, {c: _RAW + c for c in names}, ROW if rows else None)


def number_of(frame: Frame, name: str, coerced: bool):
    """A column as double; a coerced one from its text."""
    return as_number(column(frame.raw.get(name, name)).cast("string")) if coerced else column(name).cast("double")


def running_ranks(freq: DataFrame, keys: list[str], value: str, counts: list[str]) -> DataFrame:
    """keys, value, and for each count column the value's average rank (``r_``) and its count, within the keys.

    The frequency table is range-partitioned, so that no task holds all values of a key; a small table of the partitions' totals
    (one row for a key and a partition that has it) gives each its offset.
    """
    dealt = kept(freq.select(*keys, value, *counts).repartitionByRange(*keys, value).withColumn("part_", F.spark_partition_id()), "values")
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "part_").agg(*(F.sum(c).alias(c) for c in counts))
    offsets = sums.select(*keys, "part_", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in counts))
    upto = Window.partitionBy(*keys, "part_").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = [(F.col(f"b_{c}") + F.sum(c).over(upto) - (F.col(c) - 1) / 2).cast("double").alias(f"r_{c}") for c in counts]
    return dealt.join(F.broadcast(offsets), [*keys, "part_"]).select(*keys, value, *counts, *ranks)
