"""How often each value occurs within each pattern of levels and gaps: what tests of levels, tables and medians need, from one scan.

A pattern is a combination of levels of the categorical columns and of the numeric columns that are present. Tasks count the values
of a block of rows by pattern before anything is shuffled, so the shuffle carries different values, not rows times pairs of columns.
A copy with filled gaps has the same counts, with its missing values counted at their fill, and needs no scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import column
from tallyweave.operators import matrix
from tallyweave.operators.association import BROADCAST_CELLS, LEAST_LEVEL, sums_of_ranks
from tallyweave.plans.batch import kept
from tallyweave.session import ship
from tallyweave.sources.frames import running_ranks

#: Patterns that are told apart; frames with more are tested pair by pair. Cells of a block of rows whose values a task counts at once.
MOST_PATTERNS, BLOCK_CELLS = 1000, 4 << 20


class Pattern(NamedTuple):
    """Levels of the categorical columns, which numeric columns are present (as bits), rows, and the first row's place."""

    levels: tuple[str | None, ...]
    mask: int
    n: int
    met: int

    def has(self, c: int) -> bool:
        return bool(self.mask >> c & 1)


@dataclass
class Values:
    """Counts (c, v, code, n) of the values of the numeric columns by pattern; columns and patterns by number."""

    numeric: list[str]
    categorical: list[str]
    patterns: list[Pattern]
    table: DataFrame
    fills: dict[str, object] = field(default_factory=dict)  # of a filled copy

    @cached_property
    def groups(self) -> list[tuple[int, str]]:
        """All rows, then the levels of each categorical column."""
        return [(-1, ""), *((k, v) for k in range(len(self.categorical)) for v in sorted({p.levels[k] for p in self.patterns} - {None}))]

    def _in(self, p: Pattern, group: tuple[int, str]) -> bool:
        return group[0] < 0 or p.levels[group[0]] == group[1]

    @cached_property
    def sizes(self) -> dict[tuple[int, int], int]:
        """Values of a numeric column in a group that has any."""
        got = {(c, g): sum(p.n for p in self.patterns if p.has(c) and self._in(p, own)) for c in range(len(self.numeric)) for g, own in enumerate(self.groups)}
        return {k: n for k, n in got.items() if n}

    @cached_property
    def long(self) -> DataFrame:
        """(c, g, v, n): the counts by group."""
        # a row for each pattern and group: a few thousand
        of = self.table.sparkSession.createDataFrame([(code, g) for code, p in enumerate(self.patterns) for g, own in enumerate(self.groups) if self._in(p, own)], "code int, g int")
        return kept(self.table.join(F.broadcast(of), "code").groupBy("c", "g", "v").agg(F.sum("n").alias("n")), "group_values")

    @cached_property
    def quartiles(self) -> dict[tuple[int, int], list[float]]:
        """Exact quartiles of a column in a group, with linear interpolation."""
        places = {k: [p * (n - 1) for p in (0.25, 0.5, 0.75)] for k, n in self.sizes.items()}
        asked = self.table.sparkSession.createDataFrame([(*k, r) for k, own in places.items() for r in sorted({int(p) + up for p in own for up in (0, 1)})], "c int, g int, place bigint")
        last = F.col("r_n") + (F.col("n") - 1) / 2
        ranked = running_ranks(self.long, ["c", "g"], "v", ["n"])
        hit = ranked.join(F.broadcast(asked), ["c", "g"]).where((last - F.col("n") < F.col("place") + 1) & (F.col("place") + 1 <= last)).select("c", "g", "place", "v").collect()
        at = {(r["c"], r["g"], r["place"]): r["v"] for r in hit}
        out = {}
        for k, own in places.items():
            ends = [(at[*k, int(p)], at.get((*k, int(p) + 1)), p % 1) for p in own]
            out[k] = [a if not part or a == b else a + (b - a) * part for a, b, part in ends]
        return out

    @cached_property
    def moments(self) -> dict[tuple[int, int], dict]:
        """Of a column in a group: range, mean, centred sums, sums of distances from the median, and values far beyond the quartiles."""
        spark, quartiles = self.table.sparkSession, self.quartiles
        got = {(r["c"], r["g"]): r.asDict() for r in self.long.groupBy("c", "g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.col("n") * F.col("v")).alias("s")).collect()}
        out: dict = {k: {"n": n, "low": got[k]["low"], "high": got[k]["high"], "mean": got[k]["s"] / n, "median": quartiles[k][1]} for k, n in self.sizes.items()}
        n, from_mean, from_median = F.col("n"), F.col("v") - F.col("mean"), F.abs(F.col("v") - F.col("median"))
        far = F.sum(F.when((F.col("q3") > F.col("q1")) & ((F.col("v") < F.col("q1") - 5 * (F.col("q3") - F.col("q1"))) | (F.col("v") > F.col("q3") + 5 * (F.col("q3") - F.col("q1")))), n).otherwise(0))
        known = spark.createDataFrame([(*k, m["mean"], *quartiles[k]) for k, m in out.items()], "c int, g int, mean double, q1 double, median double, q3 double")
        sums = {"m2": n * from_mean * from_mean, "m3": n * from_mean * from_mean * from_mean, "d": n * from_median}
        for r in self.long.join(F.broadcast(known), ["c", "g"]).groupBy("c", "g").agg(far.alias("far"), *(F.sum(x).alias(k) for k, x in sums.items())).collect():
            out[r["c"], r["g"]] |= {k: r[k] for k in ("m2", "m3", "far")} | {"d_mean": r["d"] / out[r["c"], r["g"]]["n"]}
        around = spark.createDataFrame([(*k, m["median"], m["d_mean"]) for k, m in out.items()], "c int, g int, median double, d_mean double")
        spread = from_median - F.col("d_mean")
        for r in self.long.join(F.broadcast(around), ["c", "g"]).groupBy("c", "g").agg(F.sum(n * spread * spread).alias("d2")).collect():
            out[r["c"], r["g"]]["d2"] = r["d2"]
        return out

    def stats(self) -> dict[str, dict]:
        """What ``correlations`` asks of the profile: the skew of ``adjusted_skew`` and the values beyond five quartile ranges."""
        out = {}
        for c, name in enumerate(self.numeric):
            m = self.moments.get((c, 0))
            if m:
                n = m["n"]
                skew = n**0.5 * m["m3"] / m["m2"] ** 1.5 if m["m2"] > 0 else 0.0
                out[name] = {"skew": skew * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 else 0.0, "n_outliers_5iqr": m["far"]}
        return out

    def gappy(self) -> set[str]:
        """The columns that lack a value somewhere."""
        lacking = {n for c, n in enumerate(self.numeric) if not all(p.has(c) for p in self.patterns)}
        return lacking | {n for k, n in enumerate(self.categorical) if any(p.levels[k] is None for p in self.patterns)}

    def fill_values(self) -> dict[str, object]:
        """Of columns with gaps: median of numeric, mode (the smallest of equals) of categorical ones; nothing for empty ones."""
        lacking = self.gappy()
        out: dict = {n: self.quartiles[c, 0][1] for c, n in enumerate(self.numeric) if n in lacking and (c, 0) in self.sizes}
        for k, name in enumerate(self.categorical):
            rows = {v: sum(p.n for p in self.patterns if p.levels[k] == v) for j, v in self.groups if j == k}
            if name in lacking and rows:
                out[name] = min(rows, key=lambda v: (-rows[v], v))
        return out

    def filled(self, fills: dict[str, object]) -> Values:
        """The counts of a copy whose gaps are filled."""
        lacking = [(c, code) for code, p in enumerate(self.patterns) for c, name in enumerate(self.numeric) if name in fills and not p.has(c)]
        full = sum(1 << c for c, name in enumerate(self.numeric) if name in fills)
        patterns = [Pattern(tuple(fills.get(name) if v is None else v for name, v in zip(self.categorical, p.levels, strict=True)), p.mask | full, p.n, p.met) for p in self.patterns]
        spark = self.table.sparkSession
        more = spark.createDataFrame([(c, float(fills[self.numeric[c]]), code, self.patterns[code].n) for c, code in lacking], "c int, v double, code int, n bigint")
        return Values(self.numeric, self.categorical, patterns, self.table.unionByName(more), fills)

    def only(self, numeric: list[str]) -> Values:
        """The counts of some numeric columns."""
        at = [self.numeric.index(n) for n in numeric]
        place = F.create_map(*(F.lit(v) for i, c in enumerate(at) for v in (c, i)))
        patterns = [p._replace(mask=sum(p.has(c) << i for i, c in enumerate(at))) for p in self.patterns]
        return Values(numeric, self.categorical, patterns, self.table.where(F.col("c").isin(at)).withColumn("c", place[F.col("c")]))

    def level_moments(self) -> dict[tuple[str, str], dict[str, dict]]:
        """Of each numeric and categorical column, by level of enough values: n, mean, variance, median, range, and mean and variance
        of distances from the median; the commonest level first, of equal ones the one that is met first."""
        out: dict = {(a, b): {} for a in self.numeric for b in self.categorical}
        for (c, g), n in self.sizes.items():
            k, level = self.groups[g]
            if k >= 0 and n >= LEAST_LEVEL:
                m = self.moments[c, g]
                out[self.numeric[c], self.categorical[k]][level] = {v: m[v] for v in ("n", "mean", "median", "low", "high", "d_mean")} | {"var": m["m2"] / (n - 1), "d_var": m["d2"] / (n - 1)}
        met = lambda c, k, v: min(p.met for p in self.patterns if p.has(c) and p.levels[k] == v)
        return {(a, b): dict(sorted(own.items(), key=lambda kv: (-kv[1]["n"], met(self.numeric.index(a), self.categorical.index(b), kv[0])))) for (a, b), own in out.items()}

    def rank_sums(self, levels: dict[tuple[str, str], list[str]]) -> dict[tuple[str, str], tuple[dict[str, tuple[int, float]], float]]:
        """What ``association.rank_sums`` gives for pairs with their levels."""
        pairs = list(levels)
        wanted = [(self.numeric.index(a), self.groups.index((self.categorical.index(b), v)), i, v) for i, (a, b) in enumerate(pairs) for v in levels[a, b]]
        asked = self.table.sparkSession.createDataFrame(wanted, "c int, g int, pair int, level string")  # a row for each pair and level
        freq = self.long.join(F.broadcast(asked), ["c", "g"]).select(F.col("pair").alias("c"), "v", "level", "n")
        return sums_of_ranks(freq, pairs)

    @property
    def presence(self) -> list[int]:
        """Columns that are missing in the same rows have the same number."""
        seen = [tuple(p.has(c) for p in self.patterns) for c in range(len(self.numeric))]
        return [list(dict.fromkeys(seen)).index(s) for s in seen]

    @property
    def shared_rows(self) -> np.ndarray:
        """Rows that have both columns of a pair."""
        m = np.array([[p.has(c) for c in range(len(self.numeric))] for p in self.patterns], np.float64)
        return m.T @ (m * np.array([[p.n] for p in self.patterns], np.float64))

    def rank_kernels(self, filled: Values) -> tuple[matrix.Ranks, matrix.Ranks] | None:
        """Ranks of all values of the frame and of its filled copy, for ``matrix.Ranks``; None where the tables are too large to send."""
        presence = self.presence
        codes = [[code for code, p in enumerate(self.patterns) if p.has(presence.index(g))] for g in range(max(presence) + 1)]
        counts = [F.sum("n").alias("all"), *(F.sum(F.when(F.col("code").isin(own), F.col("n")).otherwise(0)).alias(f"n{g}") for g, own in enumerate(codes))]
        freq = kept(self.table.groupBy("c", "v").agg(*counts), "rank_values")
        if freq.count() * (len(counts) + 2) > BROADCAST_CELLS:
            return None
        got = {n: a.to_numpy(zero_copy_only=False) for n, a in zip(freq.columns, freq.toArrow().combine_chunks().columns, strict=True)}
        values, ranks, copies = [], [], []
        for c in range(len(self.numeric)):
            own = np.flatnonzero(got["c"] == c)
            own = own[np.argsort(got["v"][own])]
            v, n = got["v"][own], np.stack([got[k][own] for k in freq.columns[2:]], 1).astype(np.float64)
            lacking = sum(q.n for p, q in zip(self.patterns, filled.patterns, strict=True) if q.has(c) and not p.has(c))
            if lacking or not len(v):
                fill = filled.fills.get(self.numeric[c], 0.0)
                at = int(np.searchsorted(v, fill))
                if at == len(v) or v[at] != fill:
                    v, n = np.insert(v, at, fill), np.insert(n, at, 0.0, 0)
                n[at, 0] += lacking
            r = n.cumsum(0) - n / 2
            values.append(v)
            ranks.append(r[:, 1:])
            copies.append(np.repeat(r[:, :1], max(filled.presence) + 1, 1))  # a filled column has all rows or none
        return matrix.Ranks(values, ranks, presence, self.shared_rows / 2), matrix.Ranks(values, copies, filled.presence, filled.shared_rows / 2)

    def tables(self) -> dict[tuple[str, str], dict[tuple[str, str], int]]:
        """The counts (by pair of levels) of every pair of categorical columns over the rows that have both."""
        out: dict = {}
        for i, j in combinations(range(len(self.categorical)), 2):
            own = out.setdefault((self.categorical[i], self.categorical[j]), {})
            for p in self.patterns:
                if p.levels[i] is not None and p.levels[j] is not None:
                    own[p.levels[i], p.levels[j]] = own.get((p.levels[i], p.levels[j]), 0) + p.n
        return out


def _index(of: list, c: Column) -> Column:
    """The place of a column's value among some, from 1; 0 where it has none."""
    return F.coalesce(F.create_map(*(F.lit(y) for i, v in enumerate(of) for y in (v, i + 1)))[c], F.lit(0)) if of else F.lit(0)


def value_counts(df: DataFrame, numeric: list[str], categorical: list[str]) -> Values | None:
    """The counts of a frame, from one scan for the patterns and one for the values.

    None where there are more than ``MOST_PATTERNS``, no numeric or categorical columns, or numbers that are not finite.
    """
    if not numeric or not categorical:
        return None
    x, text = [column(c).cast("double") for c in numeric], [column(c).cast("string") for c in categorical]
    mask = reduce(Column.bitwiseOR, (F.when(v.isNotNull(), F.lit(1 << c)).otherwise(0).cast("bigint") for c, v in enumerate(x)))
    odd = reduce(Column.__or__, (F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False)) for v in x))
    keys = [f"l{k}" for k in range(len(text))]
    rows = df.select(*(t.alias(k) for t, k in zip(text, keys, strict=True)), mask.alias("mask"), odd.alias("odd"), F.monotonically_increasing_id().alias("met"))
    got = rows.groupBy(*keys, "mask").agg(F.count(F.lit(1)).alias("n"), F.min("met").alias("met"), F.bool_or("odd").alias("odd")).limit(MOST_PATTERNS + 1).collect()
    if not 0 < len(got) <= MOST_PATTERNS or any(r["odd"] for r in got):
        return None
    patterns = sorted((Pattern(tuple(r[k] for k in keys), r["mask"], r["n"], r["met"]) for r in got), key=lambda p: p.met)
    levels = [sorted({p.levels[k] for p in patterns} - {None}) for k in range(len(text))]
    masks = sorted({p.mask for p in patterns})
    joint, one, base = F.lit(0).cast("bigint"), [0] * len(patterns), 1
    for of, c, own in [(levels[k], text[k], [p.levels[k] for p in patterns]) for k in range(len(text))] + [(masks, mask, [p.mask for p in patterns])]:
        joint = joint + _index(of, c).cast("bigint") * base
        one = [key + (0 if v is None else of.index(v) + 1) * base for key, v in zip(one, own, strict=True)]
        base *= len(of) + 1
    if base >= 1 << 62:
        return None
    order = np.argsort(np.array(one))
    sorted_keys = np.array(one, np.int64)[order]
    ship(df.sparkSession)
    most = max(1, BLOCK_CELLS // len(numeric))
    has = [[p.has(c) for p in patterns] for c in range(len(numeric))]

    def counted(blocks: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, *x = (np.concatenate(a) for a in zip(*blocks, strict=True))
        code = order[np.searchsorted(sorted_keys, key)].astype(np.int16)
        by = np.argsort(code, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(has[0])))))
        for c, own in enumerate(x):
            own = own[by]
            made = [(p, *np.unique(own[ends[p] : ends[p + 1]], return_counts=True)) for p in np.flatnonzero(np.diff(ends)) if has[c][p]]
            if made:
                v, n = np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made])
                codes = np.repeat(np.array([m[0] for m in made], np.int32), [len(m[1]) for m in made])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(v), pa.array(codes), pa.array(n)], ["c", "v", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, rows = [], 0
        for b in batches:
            if b.num_rows:
                blocks.append([a.to_numpy(zero_copy_only=False) for a in b.columns])
                rows += b.num_rows
            if rows >= most:
                yield from counted(blocks)
                blocks, rows = [], 0
        if blocks:
            yield from counted(blocks)

    some = df.select(joint.alias("key"), *(v.alias(f"x{c}") for c, v in enumerate(x)))
    made = some.mapInArrow(run, "c int, v double, code int, n bigint").groupBy("c", "v", "code").agg(F.sum("n").alias("n"))
    return Values(numeric, categorical, patterns, kept(made, "pattern_values"))
