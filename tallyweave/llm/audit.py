"""What quality filters cost each other: all orders of five filters, from one CUBE over their flags.

Each document is measured once for its failures; documents become counts of (part, flags), and a
SQL CUBE over part and flags gives, where the selected flags are all false, how many survive each
subset of filters. A step of an order leads from one subset to the same with one filter more, so
joins of pairs of subsets give every step of every order.

Filters: A under ``LEAST_WORDS`` words; B too few different words; C too many capitals; D a sign
of ``SIGNS``; E a text that a row of smaller doc_id has, too.

Defined results: a null text counts as empty; a null source is the part ''; a row without a doc_id
has no labels and neither fails E nor makes others fail; rows that share a doc_id do not make each
other fail E and have the labels of that id; several labels of one id count as one that says 1 if
any does; an empty table gives no rows. Texts are read whole and compared by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .util import prepare, written

#: Fixed values of the conditions.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, "#$%&*|"
FILTERS = "ABCDE"
MEASURED = FILTERS[:4]
_WHOLE = (1 << len(FILTERS)) - 1

_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set within each text."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def failed_block(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whether each text of a block fails each of ``MEASURED``."""
    w = tb.Words(raw, offsets, tb.NONSPACE, tb.PLAIN)
    n = np.diff(w.first)
    _, first = np.unique(tb.mix(w.hashes ^ tb.mix(w.text.astype(np.uint64))), return_index=True)
    distinct = np.bincount(w.text[first], minlength=len(n))
    capitals = _sums((raw >= 65) & (raw <= 90), offsets)
    points = _sums((raw & 0xC0) != 0x80, offsets)
    return n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * points, _sums(_SIGN[raw], offsets) > 0


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, content (SHA-256 of the text) and the flags of ``MEASURED``, in one pass over the texts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(3))
            for i, j, r, o in tb.blocks(raw, offsets):
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), *(pa.array(f) for f in failed_block(r, o))], ["doc_id", "part", "content", *MEASURED])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, part string, content binary, " + ", ".join(f"{f} boolean" for f in MEASURED))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the five flags, and how many documents (n), good and toxic ones have them.

    Repeated rows are one row with a count before anything is joined. Joins are by doc_id with the labels, and by content and
    doc_id with the first document of each text, so copies of one text spread over all tasks.
    """
    seen = written(measured(docs).groupBy("doc_id", "part", "content", *MEASURED).agg(F.count(F.lit(1)).alias("n")), "audit")
    named = seen.where("doc_id is not null")
    first = named.groupBy("content").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    flagged = named.join(first, ["content", "doc_id"], "left").join(known, "doc_id", "left")
    part = ["part", *MEASURED]
    both = flagged.select(*part, F.col("first").isNull().alias("E"), "n", "good", "toxic").unionByName(seen.where("doc_id is null").select(*part, F.lit(False).alias("E"), "n", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    n = F.col("n")
    return both.groupBy("part", *FILTERS).agg(F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))


#: Rows of the cube whose selected flags are all false: who is left by each subset of filters.
SURVIVORS = f"""
SELECT part, {" + ".join(f"((1 - not_{f}) << {k})" for k, f in enumerate(FILTERS))} AS subset, n, good, toxic
FROM (SELECT part, {", ".join(f"{f}, grouping({f}) AS not_{f}" for f in FILTERS)}, grouping(part) AS all_parts, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM {{cells}} GROUP BY CUBE(part, {", ".join(FILTERS)}))
WHERE all_parts = 0 AND {" AND ".join(f"(not_{f} = 1 OR NOT {f})" for f in FILTERS)}
"""


def survivors(spark: SparkSession, counted: DataFrame) -> DataFrame:
    """part, subset (bit k: filter k), n, good, toxic for every part and subset of filters, zeros included."""
    found = spark.sql(SURVIVORS, cells=counted)
    every = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(_WHOLE))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])


def transitions(left: DataFrame) -> DataFrame:
    """From each subset to each with one filter more: kept, removed, good_lost, toxic_lost, and the filter's totals in its part."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    one = left.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)))).where(F.col("subset").bitwiseAND(bit) == 0).withColumn("next", F.col("subset").bitwiseOR(bit))
    two = left.select("part", F.col("subset").alias("next"), *(F.col(c).alias(f"{c}_next") for c in ("n", "good", "toxic")))
    lost = {a: F.col(c) - F.col(f"{c}_next") for c, a in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))}
    made = one.join(two, ["part", "next"]).select("part", "filter", "subset", F.col("n_next").alias("kept"), *(v.alias(a) for a, v in lost.items()))
    own = Window.partitionBy("part", "filter")  # 16 rows
    size, removed = F.bit_count("subset"), F.col("removed")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), size + 1)
    last = F.col("subset").bitwiseOR(bit) == _WHOLE
    return made.select("*", *(F.sum(v).over(own).cast("bigint").alias(a) for a, v in _totals(removed, last, orders).items()))


def _totals(removed: Column, last: Column, orders: Column) -> dict[str, Column]:
    """Of a filter in a part: who fails it, who fails it alone, and what it removes over all orders."""
    return {"fails": F.when(F.col("subset") == 0, removed), "unique_fails": F.when(last, removed), "shapley": removed * orders}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order of the filters and step, with the counts of the step's filter."""
    spark = docs.sparkSession
    counted = written(cells(docs, labels), "audit_cells", compact=True)
    moved = transitions(survivors(spark, counted))
    steps = [("".join(FILTERS[f] for f in order), k + 1, f, sum(1 << g for g in order[:k])) for order in permutations(range(len(FILTERS))) for k, f in enumerate(order)]
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter int, subset int")  # 600 rows
    out = moved.join(F.broadcast(plan), ["filter", "subset"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
  coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS bad FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, bad, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT part, o, step, bad, n, good, toxic, bad[o[step]] AS fails, len(list_filter(list_slice(o, 1, step - 1), lambda x: bad[x])) > 0 AS gone,
  len(list_filter(bad, lambda x: x)) = 1 AS alone FROM c, o, range(1, 6) r(step)),
t AS (SELECT part, array_to_string(list_transform(o, lambda x: chr((64 + x)::INT)), '') AS filter_order, step, o[step] AS filter,
  coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost FROM s GROUP BY part, o, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM t
"""
