"""The quality scan: issues with the rows they are in, and a score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import special
from tallyweave.functions.text import column
from tallyweave.operators import matrix
from tallyweave.operators.catalog import OUTLIERS_KEPT, Column_, identifier_column
from tallyweave.plans.batch import kept
from tallyweave.session import ship
from tallyweave.sources.frames import Frame, number_of

#: What an issue costs, their order, and limits.
WEIGHTS = {"high": 15.0, "medium": 6.0, "low": 1.5}
ORDER = {"high": 0, "medium": 1, "low": 2}
SHOWN, LEAST_ROWS, LEAST_SIDE, NOT_RANDOM = 15, 20, 3, 0.01
#: Repeated row hashes that are broadcast (16 bytes each, counted first); more are joined by a shuffle.
BROADCAST_REPEATS = 1_000_000
ISSUE = "severity string, kind string, column string, message string, locations array<struct<row:bigint,id:string,value:double>>, location_count bigint, location_more bigint"


def located(frame: Frame, wanted: dict, identifier: str | None) -> dict[object, tuple[int, list[dict]]]:
    """For each key (a condition and a value): how many rows meet the condition, and the first ``SHOWN`` of them, as 1-based position,
    identifier and value. One scan for all; each task keeps its first rows only.
    """
    if not wanted:
        return {}
    ship(frame.df.sparkSession)
    keys = list(wanted)
    ids = column(identifier).cast("string") if identifier else F.lit(None).cast("string")
    row = column(frame.row) + 1 if frame.row else F.lit(None).cast("bigint")
    hit = F.array_compact(F.array(*(F.when(where, F.struct(F.lit(i).alias("k"), F.lit(None).cast("double").alias("v") if value is None else value.cast("double").alias("v"))) for i, (where, value) in enumerate(wanted.values()))))
    hits = frame.df.select(row.alias("row"), ids.alias("id"), F.explode(hit).alias("e")).select("e.k", "row", "id", "e.v")
    shown = SHOWN if frame.row else 0

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kept = np.zeros(len(keys), np.int64), None
        for b in batches:
            k = b.column(0).to_numpy()
            counts += np.bincount(k, minlength=len(keys))
            if shown and b.num_rows:
                some = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
                k, rows = some.column(0).to_numpy(), some.column(1).to_numpy()
                order = np.lexsort((rows, k))
                place = np.arange(len(k)) - np.searchsorted(k[order], k[order])
                kept = some.take(pa.array(order[place < shown])).combine_chunks()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.float64()), pa.array(counts[at])], names)
        for b in kept.to_batches() if kept else ():
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64())], names)

    names = ["k", "row", "id", "v", "n"]
    partial = hits.mapInArrow(first, "k int, row bigint, id string, v double, n bigint")
    part = Window.partitionBy("k", F.col("n").isNull())
    best = partial.withColumn("total", F.sum("n").over(part)).withColumn("place", F.row_number().over(part.orderBy("row"))).where((F.col("place") <= F.when(F.col("n").isNull(), SHOWN).otherwise(1)))
    out = {key: (0, []) for key in keys}
    for r in best.orderBy("k", F.col("n").isNull(), "row").collect():  # at most SHOWN and one for a condition
        if r["n"] is not None:
            out[keys[r["k"]]] = (r["total"], [])
        else:
            out[keys[r["k"]]][1].append({"row": r["row"], "id": r["id"], "value": r["v"]})
    return out


def beyond(x: Column, q1: float, q3: float, reach: float) -> Column:
    """Whether a value lies more than so many interquartile ranges outside the quartiles."""
    return (x < q1 - reach * (q3 - q1)) | (x > q3 + reach * (q3 - q1))


def level_issues(n: int, top: int, least: int) -> tuple[bool, bool]:
    """Whether one level has nearly all values, and whether a level is rare."""
    return n > 0 and top / n > 0.9, least < 5


def welch(n1: int, m1: float, v1: float, n2: int, m2: float, v2: float) -> tuple[float, float, float]:
    """t, degrees of freedom and two-sided p of two samples with variances v."""
    a, b = v1 / n1, v2 / n2
    if a + b <= 0:
        return special.NAN, special.NAN, special.NAN
    t = (m1 - m2) / math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return t, df, special.t_sf2(t, df)


def missingness(frame: Frame, targets: list[str], columns: list[Column_]) -> dict[str, tuple[str, float] | None]:
    """For each target the column whose values differ most between rows with and without it, and the p of that.

    Two scans for all targets and columns: moments of the numeric columns on either side of each target, and counts of the levels.
    """
    from tallyweave.operators.association import chi_square_of

    numeric = [p.name for p in columns if p.type == "numeric" and not p.coerced_from_text]
    categorical = [p.name for p in columns if p.type == "categorical"]
    if not targets:
        return {}
    sides = [F.when(column(t).isNull() if gone else column(t).isNotNull(), 1.0) for t in targets for gone in (True, False)]
    x = [column(c).cast("double") for c in numeric]
    moments = matrix.fold(frame.df, [*x, *sides], matrix.Pairs()) if numeric else None
    levels, codes = matrix.coded(frame.df, categorical)
    pairs = [(i, len(categorical) + j) for j in range(len(targets)) for i in range(len(categorical))]
    flags = [column(t).isNull().cast("double") for t in targets]
    counts = matrix.fold(frame.df, [*codes, *flags], matrix.Tables([*(max(1, len(v)) for v in levels), *(2 for _ in targets)], pairs)) if pairs else None
    order = [p.name for p in columns if p.type in ("numeric", "categorical")]
    out: dict = {}
    for j, t in enumerate(targets):
        found = {}
        for i, c in enumerate(numeric):
            at = [len(numeric) + 2 * j + side for side in (0, 1)]
            n = [int(moments["n"][i, k]) for k in at] if moments else [0, 0]
            if c == t or min(n) < LEAST_SIDE or sum(n) < LEAST_ROWS or any(moments["f"][i, k] != m for k, m in zip(at, n, strict=True)):
                continue
            a, b = ((m, moments["mean"][i, k], moments["m2"][i, k] / (m - 1)) for k, m in zip(at, n, strict=True))
            found[c] = welch(*a, *b)[2]
        for i, c in enumerate(categorical):
            cells = counts[pairs.index((i, len(categorical) + j))] if counts else np.zeros((0, 2))
            table = {(int(g), str(v)): int(cells[v, g]) for v, g in zip(*np.nonzero(cells), strict=True)}
            if c != t and len({k[0] for k in table}) == 2 and len({k[1] for k in table}) > 1 and sum(table.values()) >= LEAST_ROWS:
                found[c] = chi_square_of(table)["p"]
        best = min(((v, order.index(k), k) for k, v in found.items() if math.isfinite(v)), default=None)
        out[t] = best and (best[2], best[0])
    return out


def missingness_association(frame: Frame, target: str, columns: list[Column_]) -> tuple[str, float] | None:
    return missingness(frame, [target], columns)[target]


def issues_of(frame: Frame, rows: int, columns: list[Column_]) -> list[dict]:
    """Every issue, most severe first, then by kind."""
    found: list[dict] = []
    identifier = identifier_column(columns)

    def add(severity: str, kind: str, message: str, name: str | None = None, **detail) -> None:
        found.append({"severity": severity, "kind": kind, "column": name, "message": message} | detail)

    if rows < 30:
        add("high", "sample_size", f"{rows} rows are too few for {'almost any' if rows < 10 else 'most'} tests.")
    any_null = F.lit(False)
    for c in frame.columns:
        any_null = any_null | column(c).isNull()
    outer: dict = {}  # which fence the values of a column pass
    where: dict = {"rows": (any_null, None)} | {(p.name, "gone"): (column(p.name).isNull(), None) for p in columns if p.pct_missing > 0 and p.name != identifier}
    for p in columns:
        s = p.stats or {}
        outer[p.name] = next((k for k in (5, 3) if s.get(f"n_outliers_{k}iqr")), None)
        if outer[p.name]:
            x = number_of(frame, p.name, p.coerced_from_text)
            where[p.name, "far"] = beyond(x, s["q1"], s["q3"], outer[p.name]), x
    places = located(frame, where, identifier)

    def at(key, most: int | None = None) -> dict:
        """The locations of an issue: how many there are (or are kept), and the first ones."""
        if key not in places or frame.row is None:
            return {}
        count, first = places[key]
        count = count if most is None else min(most, count)
        return {"locations": first, "location_count": count, "location_more": max(0, count - len(first))}

    gaps = places["rows"][0]
    if gaps:
        add("medium" if gaps / rows > 0.2 else "low", "missing_rows", f"{gaps} of {rows} rows lack at least one value.", **at("rows"))
    linked = missingness(frame, [p.name for p in columns if 0 < p.pct_missing < 1 and p.type in ("numeric", "categorical")], columns)
    for p in columns:
        if p.pct_missing > 0:
            add("high" if p.pct_missing > 0.5 else "medium" if p.pct_missing > 0.2 else "low", "missing_column", f"{p.pct_missing:.0%} of {p.name} is missing.", p.name, **at((p.name, "gone")))
        if linked.get(p.name) and linked[p.name][1] < NOT_RANDOM:
            add("medium", "missing_not_random", f"Whether {p.name} is missing goes with {linked[p.name][0]} (p = {linked[p.name][1]:.3g}).", p.name)
        if p.exclude_reason == "constant":
            add("low", "constant_column", f"{p.name} has one value only and is left out.", p.name)
        elif p.exclude_reason == "near-constant":
            add("low", "near_constant_column", f"Nearly all of {p.name} is one value; it is left out.", p.name)
        elif p.exclude_reason == "id-like / free text":
            add("low", "excluded_column", f"{p.name} seems to identify rows or to be free text; it is left out.", p.name)
        elif p.exclude_reason == "high-cardinality text":
            add("low", "excluded_column", f"{p.name} has {p.n_unique} different texts; it is left out.", p.name)
        elif p.type == "datetime":
            add("low", "excluded_column", f"{p.name} holds dates, which are not analysed.", p.name)
        if p.coerced_from_text:
            add("low", "coerced_type", f"{p.name} is text that was read as numbers.", p.name)
        s = p.stats or {}
        if s:
            if k := outer[p.name]:
                add(*{5: ("medium", "extreme_values"), 3: ("low", "outliers")}[k], f"{p.name} has {s[f'n_outliers_{k}iqr']} value(s) more than {k} IQR outside its quartiles.", p.name, **at((p.name, "far"), OUTLIERS_KEPT))
            if abs(s["skew"]) > 1:
                add("medium" if abs(s["skew"]) > 2 else "low", "skew", f"{p.name} is skewed ({s['skew']:.2f}).", p.name)
            if s["kurtosis"] > 3:
                add("low", "heavy_tails", f"{p.name} has heavy tails (excess kurtosis {s['kurtosis']:.2f}).", p.name)
        if p.type == "categorical":
            size, high, low = p.level_counts
            imbalanced, rare = level_issues(size, high, low)
            if imbalanced:
                add("medium", "class_imbalance", f"{high / size:.0%} of {p.name} is one level.", p.name)
            if rare:
                add("medium", "rare_category", f"A level of {p.name} has only {low} row(s).", p.name)
    same = duplicate_rows(frame.df, frame.columns).first()[0]
    if same > 1:
        add("medium", "duplicate_rows", f"{same} rows are equal to another row.")
    numeric = sum(p.type == "numeric" for p in columns)
    if numeric >= rows > 0:
        add("high", "wide_data", f"{numeric} numeric columns for {rows} rows leave models no room.")
    return sorted(found, key=lambda i: (ORDER[i["severity"]], i["kind"]))


def _fingerprints(columns: list) -> list:
    return [F.xxhash64(*columns, F.lit(seed)) for seed in (1, 2)]


def duplicate_rows(df: DataFrame, columns: list[str], fingerprints=_fingerprints) -> DataFrame:
    """One row: how many rows equal another one, nulls equal to nulls.

    Rows are counted by two 64-bit hashes first (24 bytes a row are shuffled); only rows whose hashes repeat are compared in full.
    """
    plain = [column(c) for c in columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
    names = [f"h{i}" for i in range(len(fingerprints(plain)))]
    hashed = df.select(*(c.alias(f"c{i}") for i, c in enumerate(plain)), *(h.alias(n) for h, n in zip(fingerprints(plain), names, strict=True)))
    again = kept(hashed.groupBy(*names).count().where("count > 1").select(*names), "repeated")
    few = again.count() <= BROADCAST_REPEATS
    some = hashed.join(F.broadcast(again) if few else again, names, "left_semi")
    return some.groupBy(*(f"c{i}" for i in range(len(plain)))).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_duplicates"))


def score_of(issues: list[dict]) -> float:
    return max(0.0, min(100.0, round(100.0 - sum(WEIGHTS[i["severity"]] for i in issues), 1)))


def summary_of(issues: list[dict]) -> str:
    n = {k: sum(i["severity"] == k for i in issues) for k in WEIGHTS}
    return f"{', '.join(f'{v} {k}' for k, v in n.items())}: {len(issues)} issue{'s' * (len(issues) != 1)}"


def as_frame(spark: SparkSession, issues: list[dict]) -> DataFrame:
    rows = [(i["severity"], i["kind"], i["column"], i["message"], [(v["row"], v["id"], v["value"]) for v in i.get("locations", [])], i.get("location_count", 0), i.get("location_more", 0)) for i in issues]
    return spark.createDataFrame(rows, ISSUE)


def score_frame(issues: DataFrame) -> DataFrame:
    """The score of a frame of issues (severity)."""
    cost = F.create_map(*(F.lit(v) for kv in WEIGHTS.items() for v in kv))[F.col("severity")]
    return issues.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(100 - F.coalesce(F.sum(cost), F.lit(0.0)), 1))).alias("score"))
