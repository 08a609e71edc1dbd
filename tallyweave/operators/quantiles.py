"""Exact quantiles with linear interpolation, of many columns, and of levels, in two passes whatever their size.

The first pass keeps a rank sketch of each column (and level): the built-in mergeable summary, whose
rank error is bounded. Two of its quantiles bracket each wanted rank. The second pass counts what
lies under each bracket and gathers the different values within, a few ten-thousandths of all; the
value at the wanted rank follows. A bracket that misses its rank is widened to the whole column, so
the numbers are exact whatever the sketch says.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.plans.batch import kept, totals
from tallyweave.session import ship
from tallyweave.sources.frames import running_ranks

#: Ranks of the sketch are within 1 / ACCURACY of all rows; a bracket reaches so many of these parts to either side.
ACCURACY, REACH = 4000, 2
#: Different values within brackets that may reach the driver; more are ranked where they are.
LAST_VALUES = 200_000
_LEVEL = "__level_of"


def quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float]) -> dict[str, list[float] | None]:
    """Of each named column; None where it has no value."""
    got = level_quantiles(df, columns, probabilities, F.lit(""))
    return {n: got.get((n, "")) for n in columns}


def level_quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float], level: Column, accuracy: int = ACCURACY, last_values: int = LAST_VALUES) -> dict[tuple[str, str], list[float]]:
    """Of each named column in each level that has a value of it; rows without a level are left out. Levels are few."""
    names = list(columns)
    rows = df.select(level.cast("string").alias(_LEVEL), *(columns[n].cast("double").alias(f"x{i}") for i, n in enumerate(names))).where(F.col(_LEVEL).isNotNull())
    around = sorted({min(1.0, max(0.0, p + side * REACH / accuracy)) for p in probabilities for side in (-1, 1)} | {0.0, 1.0})
    sketch = {}
    for i in range(len(names)):
        x = F.col(f"x{i}")
        sketch |= {(i, "n"): F.count(x), (i, "low"): F.min(x), (i, "high"): F.max(x), (i, "q"): F.percentile_approx(x, around, accuracy)}
    got = totals(rows, sketch, [_LEVEL])
    wanted: dict = {}  # (column, level): ranks, brackets, and the lowest and highest value
    for (v,), s in got.items():
        for i in range(len(names)):
            n = s[i, "n"]
            if n:
                at = dict(zip(around, s[i, "q"], strict=True))
                ranks = sorted({r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
                wanted[i, v] = n, ranks, _brackets(at, ranks, n, accuracy, s[i, "low"], s[i, "high"])
    found = _settled(rows, wanted, last_values)
    short = {k: (n, missing, [(s_low, s_high)]) for k, (n, ranks, _) in wanted.items() if (missing := [r for r in ranks if r not in found[k]]) for s_low, s_high in [(got[k[1],][k[0], "low"], got[k[1],][k[0], "high"])]}
    if short:
        for k, more in _settled(rows, short, last_values).items():
            found[k] |= more
    out = {}
    for (i, v), (n, _, _) in wanted.items():
        values = []
        for p in probabilities:
            place = p * (n - 1)
            a, b = found[i, v][math.floor(place)], found[i, v][math.ceil(place)]
            values.append(a if a == b else a + (b - a) * (place - math.floor(place)))
        out[names[i], v] = values
    return out


def _brackets(at: dict[float, float], ranks: list[int], n: int, accuracy: int, low: float, high: float) -> list[tuple[float, float]]:
    """Disjoint value ranges, in order, that should hold the ranks."""
    points = sorted(at)
    out: list[tuple[float, float]] = []
    for r in ranks:
        a = [q for q in points if q * n <= r - (REACH - 1) / accuracy * n]
        b = [q for q in points if q * n >= r + (REACH - 1) / accuracy * n]
        pair = (at[a[-1]] if a and a[-1] > 0 else low, at[b[0]] if b and b[0] < 1 else high)
        if out and pair[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], pair[1]))
        else:
            out.append(pair)
    return out


def _counted(rows: DataFrame, spans: dict[tuple[int, str], list[tuple[float, float]]]) -> DataFrame:
    """(c, level, gap, v, n): how many values of a column and level lie in each gap between its brackets, and how often each value
    within a bracket occurs (then v is set and gap null)."""
    ship(rows.sparkSession)
    places, levels = sorted({i for i, _ in spans}), sorted({v for _, v in spans})
    edges = [(places.index(i), levels.index(v), i, v, np.array(b)) for (i, v), b in spans.items()]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int64()]
    names = ["c", "level", "gap", "v", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps: dict = {}
        for b in batches:
            code = b.column(0).to_numpy(zero_copy_only=False)
            own = [np.flatnonzero(code == k) for k in range(len(levels))] if len(levels) > 1 else [slice(None)]
            x = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[1:]]
            for c, k, i, v, span in edges:
                some = x[c][own[k]]
                some = some[~np.isnan(some)]
                under = np.searchsorted(span[:, 1], some)  # brackets that end under the value
                inside = (under < len(span)) & (some >= span[np.minimum(under, len(span) - 1), 0])
                gaps[i, v] = gaps.get((i, v), 0) + np.bincount(under[~inside], minlength=len(span) + 1)
                values, n = np.unique(some[inside], return_counts=True)
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(n), kinds[0]), pa.array([v] * len(n)), pa.nulls(len(n), kinds[2]), pa.array(values), pa.array(n)], names)
        told = [(i, v, g, None, int(n)) for (i, v), own in gaps.items() for g, n in enumerate(own) if n]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*told, strict=True), kinds, strict=True)], names)

    numbered = F.create_map(*(F.lit(y) for k, v in enumerate(levels) for y in (v, k)))[F.col(_LEVEL)] if len(levels) > 1 else F.lit(0)
    made = rows.select(numbered.alias("code"), *(f"x{i}" for i in places)).mapInArrow(run, "c int, level string, gap int, v double, n bigint")
    return made.groupBy("c", "level", "gap", "v").agg(F.sum("n").alias("n"))


def _settled(rows: DataFrame, wanted: dict, last_values: int) -> dict[tuple[int, str], dict[int, float]]:
    """The value at each wanted rank that its column's brackets hold, by one pass over the rows."""
    if not wanted:
        return {}
    counts = kept(_counted(rows, {k: brackets for k, (_, _, brackets) in wanted.items()}), "brackets")
    held = counts.where("gap is null")
    few = counts.count() <= last_values
    gaps: dict = {}
    values: dict = {}
    for r in (counts if few else counts.where("gap is not null")).collect():  # a row for each column, level and gap, and a few values
        if r["gap"] is None:
            values.setdefault((r["c"], r["level"]), []).append((r["v"], r["n"]))
        else:
            gaps.setdefault((r["c"], r["level"]), {})[r["gap"]] = r["n"]
    if few:
        return {k: _picked(ranks, brackets, gaps.get(k, {}), sorted(values.get(k, []))) for k, (_, ranks, brackets) in wanted.items()}
    ranked = running_ranks(held, ["c", "level"], "v", ["n"])
    out: dict = {k: {} for k in wanted}
    targets = [(i, v, r, float(r + 1 - sum(gaps.get((i, v), {}).get(g, 0) for g in range(b + 1)))) for (i, v), (_, ranks, brackets) in wanted.items() for r in ranks for b in range(len(brackets))]
    # a row for each wanted rank and bracket: few
    asked = rows.sparkSession.createDataFrame(targets, "c int, level string, rank bigint, place double").withColumnRenamed("level", "own")
    spans = {(i, v): brackets for (i, v), (_, _, brackets) in wanted.items()}
    last = F.col("r_n") + (F.col("n") - 1) / 2
    hit = ranked.join(F.broadcast(asked), (ranked["c"] == asked["c"]) & (ranked["level"] == asked["own"]) & (last - F.col("n") < F.col("place")) & (F.col("place") <= last)).select(asked["c"], "own", "rank", "place", "v").collect()
    for r in hit:
        key = r["c"], r["own"]
        for b, (low, high) in enumerate(spans[key]):
            if low <= r["v"] <= high and r["place"] == r["rank"] + 1 - sum(gaps.get(key, {}).get(g, 0) for g in range(b + 1)):
                out[key][r["rank"]] = r["v"]
    return out


def _picked(ranks: list[int], brackets: list[tuple[float, float]], gaps: dict[int, int], values: list[tuple[float, int]]) -> dict[int, float]:
    """The values at the ranks, from counted values of the brackets and the counts of the gaps between them."""
    out, before, at = {}, 0, 0
    for b, (_, high) in enumerate(brackets):
        before += gaps.get(b, 0)
        end = bisect_right(values, (high, math.inf), at)
        upto = list(accumulate((n for _, n in values[at:end]), initial=before))
        for r in ranks:
            if upto[0] <= r < upto[-1]:
                out[r] = values[at + bisect_right(upto, r) - 1][0]
        before, at = upto[-1], end
    return out
