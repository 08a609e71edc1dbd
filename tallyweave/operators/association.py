"""Tests of pairs of columns: correlation, group difference and contingency.

Moments of all pairs come from single aggregations; ranks come from frequency tables, which
are what a rank test needs and as small as the data allow. Only levels, pairs and cells reach
the driver, where the closed forms and tail probabilities are evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import special
from tallyweave.functions.text import column
from tallyweave.operators import matrix
from tallyweave.operators.quality import welch
from tallyweave.operators.quantiles import level_quantiles
from tallyweave.operators.results import Assumption, result, signed
from tallyweave.plans.batch import kept, total, totals
from tallyweave.session import ship
from tallyweave.sources.frames import running_ranks

if TYPE_CHECKING:
    from tallyweave.operators.shared import Known
    from tallyweave.operators.values import Values

#: Least rows of a test and of a level, levels of a group test, rows of a Shapiro test.
LEAST_ROWS, LEAST_LEVEL, MOST_LEVELS, SHAPIRO_ROWS = 10, 3, 20, 5000
ALPHA = 0.05
#: Cells of the rank tables that are broadcast together; larger ones are joined by a shuffle.
BROADCAST_CELLS = 4_000_000
_MET, _LEVEL = "__met", "__level"


def pair_moments(df: DataFrame, numeric: list[str]) -> dict[tuple[str, str], dict]:
    """n, r and ranges of every numeric pair, each over the rows that have both, from one scan.

    r is None without spread and NaN where a value is infinite or sums overflow.
    """
    k = len(numeric)
    got = matrix.fold(df, [column(c) for c in numeric], matrix.Pairs()) if k > 1 else None
    return moments_of(numeric, got or {v: np.zeros((k, k)) for v in ("n", "f", "m2", "co", "low", "high")})


def moments_of(numeric: list[str], got: dict) -> dict[tuple[str, str], dict]:
    """From the state of ``matrix.Pairs``."""
    k = len(numeric)
    out: dict = {}
    for i, j in combinations(range(k), 2):
        n = int(got["n"][i, j])
        ends = {f"{v}{e}": float(got[side][p, q]) if n else None for v, p, q in (("x", i, j), ("y", j, i)) for e, side in ((0, "low"), (1, "high"))}
        flat = not n or ends["x0"] == ends["x1"] or ends["y0"] == ends["y1"]
        room = math.sqrt(got["m2"][i, j]) * math.sqrt(got["m2"][j, i]) if not flat and got["f"][i, j] == n and min(got["m2"][i, j], got["m2"][j, i]) > 0 else 0.0
        whole = got["f"][i, j] == n and math.isfinite(room)
        out[numeric[i], numeric[j]] = {"n": n, "r": None if flat else float(got["co"][i, j] / room) if whole and room > 0 else special.NAN} | ends
    return out


def _number(name: str) -> Column:
    x = column(name).cast("double")
    return F.when(~F.isnan(x), x)


def _broadcastable(sizes: dict[int, int], width: int) -> set[int]:
    """The smallest rank tables that together have no more cells than are broadcast."""
    out, cells = set(), 0
    for c, n in sorted(sizes.items(), key=lambda kv: (kv[1], kv[0])):
        cells += n * width
        if cells > BROADCAST_CELLS:
            break
        out.add(c)
    return out


def _classes(x: DataFrame, gaps: list[int], k: int) -> tuple[list[Column], np.ndarray]:
    """Classes of rows that tell which rows have a column, as conditions on ``mask``, and which of them add up for each column.

    The patterns of missing values that occur are such classes; where they are more than the columns with gaps, the (overlapping)
    rows that have each of these, and all rows, are used instead.
    """
    every = np.ones((1, k), np.int64)
    if not gaps:
        return [F.lit(True)], every
    patterns = sorted(r[0] for r in x.select("mask").distinct().limit(len(gaps) + 2).collect())
    if len(patterns) <= len(gaps) + 1:
        return [F.col("mask") == p for p in patterns], np.array([[i not in gaps or p >> gaps.index(i) & 1 for i in range(k)] for p in patterns], np.int64)
    partner = np.zeros((len(gaps) + 1, k), np.int64)
    partner[[gaps.index(i) + 1 if i in gaps else 0 for i in range(k)], range(k)] = 1
    return [F.lit(True), *(F.col("mask").bitwiseAND(1 << g) != 0 for g in range(len(gaps)))], partner


def rank_correlations(df: DataFrame, numeric: list[str], moments: dict | None = None) -> dict[tuple[str, str], tuple[int, float | None]]:
    """n and the correlation of average ranks of every numeric pair, each over the rows that have both.

    A value is ranked within classes of rows with the same gaps, from one frequency table of all columns; ranks among the rows that
    have another column are sums over classes. Ranks reach the rows by broadcast where the tables are small; the other columns
    travel together, as one long table, to the ranks and back. ``moments``: those of ``pair_moments``, if known.
    """
    k = len(numeric)
    moments = moments or pair_moments(df, numeric)
    x = df.select(*(_number(c).alias(f"x{i}") for i, c in enumerate(numeric)))
    got = total(x, {"": F.count(F.lit(1))} | {i: F.count(f"x{i}") for i in range(k)})
    gaps = [i for i in range(k) if got[i] < got[""]]
    mask = F.lit(0).cast("bigint")  # at most MOST_COLUMNS = 40 bits
    for g, i in enumerate(gaps):
        mask = mask.bitwiseOR(F.when(F.col(f"x{i}").isNotNull(), 1 << g).otherwise(0).cast("bigint"))
    x = x.withColumn("mask", mask)
    classes, partner = _classes(x, gaps, k)
    counts = [f"n{e}" for e in range(len(classes))]
    entry = F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("v")) for i in range(k)))
    long = x.select("mask", F.explode(entry).alias("e")).select("mask", "e.*").where("v is not null")
    freq = long.groupBy("c", "v").agg(*(F.count_if(w).alias(n) for w, n in zip(classes, counts, strict=True)))
    ranked = kept(running_ranks(freq, ["c"], "v", counts).select("c", "v", F.array(*(F.col(f"r_{n}") - 0.5 for n in counts)).alias("r")), "ranks")
    small = _broadcastable(dict(ranked.groupBy("c").count().collect()), len(counts) + 1)
    large = [i for i in range(k) if i not in small]
    rows = x
    if large:
        rows = kept(x.withColumn("id", F.monotonically_increasing_id()), "numbered")
        entry = F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("v")) for i in large))
        far = rows.select("id", F.explode(entry).alias("e")).select("id", "e.*").where("v is not null").join(ranked.where(F.col("c").isin(large)), ["c", "v"])
        rows = rows.join(far.groupBy("id").agg(*(F.first(F.when(F.col("c") == i, F.col("r")), True).alias(f"r{i}") for i in large)), "id", "left")
    for i in sorted(small):
        table = ranked.where(F.col("c") == i).select(F.col("v").alias(f"v{i}"), F.col("r").alias(f"r{i}"))
        rows = rows.join(F.broadcast(table), F.col(f"x{i}") == F.col(f"v{i}"), "left")
    nothing = F.array_repeat(F.lit(float("nan")), len(counts))
    mean = np.zeros((k, k))  # ranks less a half of n rows have the mean n / 2
    for i, j in combinations(range(k), 2):
        mean[i, j] = mean[j, i] = moments[numeric[i], numeric[j]]["n"] / 2
    s = matrix.fold(rows, [F.coalesce(f"r{i}", nothing) for i in range(k)], matrix.RankProducts(partner, mean), len(counts)) if k > 1 else None
    return rhos_of(numeric, s)


def rhos_of(numeric: list[str], s: dict | None) -> dict[tuple[str, str], tuple[int, float | None]]:
    """From the state of ``matrix.RankProducts`` or ``matrix.Ranks``."""
    out: dict = {}
    for i, j in combinations(range(len(numeric)), 2):
        n, ab, aa, bb = (int(s["n"][i, j]), s["ab"][i, j], s["aa"][i, j], s["aa"][j, i]) if s else (0, 0.0, 0.0, 0.0)
        out[numeric[i], numeric[j]] = n, float(ab / math.sqrt(aa) / math.sqrt(bb)) if n and min(aa, bb) > 1e-6 * n * n else None  # one value that differs makes n * n / 4
    return out


def _clamped(r: float | None) -> float:
    """A correlation within its limits; NaN where there is none."""
    return max(-1.0, min(1.0, r)) if r is not None and math.isfinite(r) else special.NAN


def correlations(df: DataFrame, numeric: list[str], stats: dict[str, dict], known: Known | None = None) -> list[dict]:
    """Pearson or Spearman of every numeric pair; Spearman where a profile is skewed or has extremes. ``known``: what a shared scan
    found, if any."""
    out = []
    uneven = {c: abs((stats.get(c) or {}).get("skew", 0)) > 1 or (stats.get(c) or {}).get("n_outliers_5iqr", 0) > 0 for c in numeric}
    moments = known.moments if known else pair_moments(df, numeric)
    by_rank = known.rhos if known and known.rhos is not None else rank_correlations(df, numeric, moments) if moments else {}
    for (a, b), m in moments.items():
        if m["n"] < LEAST_ROWS or m["x0"] == m["x1"] or m["y0"] == m["y1"]:
            continue
        r, rho = _clamped(m["r"]), _clamped(by_rank[a, b][1])
        p, q = special.pearson_p(r, m["n"]), special.pearson_p(rho, m["n"])
        ranks = uneven[a] or uneven[b]
        value = rho if ranks else r
        agrees = (r > 0) - (r < 0) == (rho > 0) - (rho < 0) and (p < ALPHA) == (q < ALPHA)
        out.append(result("correlation", "spearman" if ranks else "pearson", [a, b], m["n"], value, q if ranks else p, "spearman_rho" if ranks else "r", value, signed(value), [Assumption("linear, without extreme skew", not ranks, "ranks were used because a column is skewed or has extremes")], agrees, pearson_r=r, pearson_p=p, spearman_rho=rho, spearman_p=q))
    return out


def level_moments(df: DataFrame, num: list[str], cat: str) -> dict[str, dict[str, dict]]:
    """For each numeric column, by level: n, mean, variance, median, and the same of distances from the median.

    The commonest level comes first, of equal ones the one that is met first.
    """
    level = column(cat).cast("string")
    some = df.where(level.isNotNull()).withColumn(_MET, F.monotonically_increasing_id())
    wanted = {}
    for c in num:
        x = column(c).cast("double")
        wanted |= {(c, "n"): F.count(x), (c, "mean"): F.avg(x), (c, "var"): F.var_samp(x), (c, "low"): F.min(x), (c, "high"): F.max(x), (c, "met"): F.min(F.when(x.isNotNull(), F.col(_MET)))}
    by = {k[0]: v for k, v in totals(some, wanted, [level.alias("level")]).items()}
    for (c, v), (median,) in level_quantiles(df, {c: column(c) for c in num}, [0.5], level).items():
        by[v][c, "median"] = median
    out: dict = {}
    for c in num:
        own = {v: {k: m[c, k] for k in ("n", "mean", "var", "median", "low", "high")} for v, m in by.items() if m[c, "n"] >= LEAST_LEVEL}
        out[c] = dict(sorted(own.items(), key=lambda kv: (-kv[1]["n"], by[kv[0]][c, "met"])))
    spread = {}
    for c in num:
        middle = F.create_map(*(F.lit(v) for k, m in out[c].items() for v in (k, float(m["median"]))))[level] if out[c] else F.lit(None).cast("double")
        d = F.abs(column(c).cast("double") - middle)
        spread |= {(c, "d_mean"): F.avg(d), (c, "d_var"): F.var_samp(d)}
    for (v,), m in totals(some, spread, [level.alias("level")]).items():
        for c in num:
            if v in out[c]:
                out[c][v] |= {"d_mean": m[c, "d_mean"], "d_var": m[c, "d_var"]}
    return out


def one_way(groups: list[tuple[int, float, float]]) -> tuple[float, float, float, float]:
    """F, p, eta squared and the total sum of squares of groups (n, mean, variance)."""
    n, k = sum(g[0] for g in groups), len(groups)
    grand = sum(g[0] * g[1] for g in groups) / n
    between = sum(g[0] * (g[1] - grand) ** 2 for g in groups)
    within = sum((g[0] - 1) * (g[2] or 0.0) for g in groups)
    total = between + within
    f = special.NAN if n <= k else (between / (k - 1)) / (within / (n - k)) if within > 0 else math.inf if between > 0 else special.NAN
    return f, special.f_sf(f, k - 1, n - k), between / total if total > 0 else 0.0, total


def rank_sums(df: DataFrame, levels: dict[tuple[str, str], list[str]]) -> dict[tuple[str, str], tuple[dict[str, tuple[int, float]], float]]:
    """For each pair of a numeric and a categorical column with its levels: rows and sum of average ranks by level, and the sum of
    t^3 - t over ties; from one frequency table of all pairs."""
    names = list(levels)
    entry = []
    for i, (num, cat) in enumerate(names):
        level = column(cat).cast("string")
        entry.append(F.struct(F.lit(i).alias("c"), F.when(level.isin(levels[num, cat]), level).alias("level"), column(num).cast("double").alias("v")))
    long = df.select(F.explode(F.array(*entry)).alias("e")).select("e.*").where("level is not null and v is not null")
    return sums_of_ranks(kept(long.groupBy("c", "v", "level").agg(F.count(F.lit(1)).alias("n")), "level_values"), names)


def sums_of_ranks(freq: DataFrame, names: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[dict[str, tuple[int, float]], float]]:
    """The same from the table (c, v, level, n); c is the number of a pair."""
    ranked = kept(running_ranks(freq.groupBy("c", "v").agg(F.sum("n").alias("t")), ["c"], "v", ["t"]), "level_value_ranks")
    t = F.col("t").cast("double")
    ties = dict(ranked.groupBy("c").agg(F.sum(t * t * t - t)).collect())
    sums = freq.join(ranked.select("c", "v", "r_t"), ["c", "v"]).groupBy("c", "level").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r_t")).alias("s")).collect()
    return {pair: ({r["level"]: (r["n"], r["s"]) for r in sums if r["c"] == i}, ties.get(i) or 0.0) for i, pair in enumerate(names)}


def kruskal(sums: dict[str, tuple[int, float]], ties: float) -> tuple[float, float]:
    """H with tie correction, and p; NaN where all values are equal."""
    n = sum(c for c, _ in sums.values())
    room = 1 - ties / (n**3 - n)
    if room <= 0:
        return special.NAN, special.NAN
    h = (12 / (n * (n + 1)) * sum(s * s / c for c, s in sums.values()) - 3 * (n + 1)) / room
    return h, special.chi2_sf(h, len(sums) - 1)


def cohen_d(a: dict, b: dict) -> float:
    pooled = ((a["n"] - 1) * (a["var"] or 0) + (b["n"] - 1) * (b["var"] or 0)) / max(1, a["n"] + b["n"] - 2)
    return (a["mean"] - b["mean"]) / math.sqrt(pooled) if min(a["n"], b["n"]) > 1 and pooled > 0 else 0.0


def shapiro_by_level(df: DataFrame, cat: str, levels: dict[str, list[str]]) -> DataFrame:
    """(num, level, n, w, p) of the levels of 3 to 5000 rows; each is a bounded group."""
    ship(df.sparkSession)
    level = column(cat).cast("string")
    entry = F.array(*(F.struct(F.lit(c).alias("num"), F.when(level.isin(v), column(c).cast("double")).alias("x")) for c, v in levels.items()))
    some = df.where(level.isNotNull()).select(level.alias("level"), F.explode(entry).alias("e")).select("level", "e.*").where("x is not null")
    sizes = some.groupBy("num", "level").count().where((F.col("count") >= 3) & (F.col("count") <= SHAPIRO_ROWS)).select("num", "level")

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        w, p = special.shapiro(rows["x"].to_numpy())
        return pd.DataFrame({"num": [rows["num"].iloc[0]], "level": [rows["level"].iloc[0]], "n": [len(rows)], "w": [w], "p": [p]})

    return some.join(F.broadcast(sizes), ["num", "level"]).groupBy("num", "level").applyInPandas(test, "num string, level string, n bigint, w double, p double")  # levels of one column: at most 50


def group_differences(df: DataFrame, numeric: list[str], categorical: list[str], values: Values | None = None) -> list[dict]:
    """Welch's t for two levels, analysis of variance for more, with rank tests beside them. ``values``: the counts of these columns,
    if known."""
    made: dict = {}
    if not numeric or not categorical:
        return []
    # a row for each categorical column, so that the levels of all of them are groups of the same passes
    entry = F.array(*(F.concat(F.lit(f"{i} "), column(c).cast("string")) for i, c in enumerate(categorical)))
    long = df.select(*(column(c) for c in numeric), F.explode(entry).alias(_LEVEL))
    if values:
        of = values.level_moments()
    else:
        met = level_moments(long, numeric, _LEVEL)
        of = {(num, cat): {v.split(" ", 1)[1]: m for v, m in met[num].items() if v.startswith(f"{i} ")} for num in numeric for i, cat in enumerate(categorical)}
    fit = {pair: levels for pair, levels in of.items() if 2 <= len(levels) <= MOST_LEVELS and min(m["low"] for m in levels.values()) < max(m["high"] for m in levels.values())}
    few: dict = {}
    for (num, cat), levels in fit.items():
        few.setdefault(num, []).extend(f"{categorical.index(cat)} {v}" for v, m in levels.items() if m["n"] <= SHAPIRO_ROWS)
    shapiro: dict = {}
    for r in shapiro_by_level(long, _LEVEL, {num: own for num, own in few.items() if own}).collect() if any(few.values()) else ():
        shapiro.setdefault((r["num"], categorical[int(r["level"].split(" ", 1)[0])]), []).append(r["p"])
    asked = {pair: list(levels) for pair, levels in fit.items()}
    ranks = (values.rank_sums(asked) if values else rank_sums(df, asked)) if fit else {}
    for cat in categorical:
        for num in numeric:
            if (num, cat) not in fit:
                continue
            levels = fit[num, cat]
            names, groups = list(levels), list(levels.values())
            n = sum(m["n"] for m in groups)
            summary = [{"level": v, "n": m["n"], "mean": m["mean"], "std": math.sqrt(m["var"] or 0.0)} for v, m in levels.items()]
            levene = one_way([(m["n"], m["d_mean"], m["d_var"]) for m in groups])[1]
            normal = min((p for p in shapiro.get((num, cat), []) if p is not None and not math.isnan(p)), default=special.NAN)
            sums, ties = ranks[num, cat]
            checks = [Assumption("equal variances (Levene)", not levene < ALPHA, f"p = {levene:.3g}"), Assumption("normal groups (Shapiro)", not normal < ALPHA, f"least p = {normal:.3g}", n < 30)]
            if len(names) == 2:
                a, b = groups
                t, _, p = welch(a["n"], a["mean"], a["var"], b["n"], b["mean"], b["var"])
                c, s = sums[names[0]]
                rank_p = special.mann_whitney_p(s - c * (c + 1) / 2, c, sums[names[1]][0], ties)
                extra = {"mannwhitney_p": rank_p, "test": "Welch t-test", "higher_group": names[0] if a["mean"] >= b["mean"] else names[1]}
                row = ("welch_t", t, p, "cohen_d", cohen_d(a, b))
            else:
                f, p, eta, _ = one_way([(m["n"], m["mean"], m["var"]) for m in groups])
                rank_p = kruskal(sums, ties)[1]
                extra = {"kruskal_p": rank_p, "test": "one-way ANOVA", "higher_group": max(names, key=lambda v: levels[v]["mean"])}
                row = ("anova", f, p, "eta_sq", eta)
            agrees = math.isfinite(rank_p) and (row[2] < ALPHA) == (rank_p < ALPHA)
            made[num, cat] = result("group_difference", row[0], [num, cat], n, *row[1:], "none", checks, agrees, groups=summary, levene_p=levene, shapiro_min_p=normal, **extra)
    return [made[num, cat] for num in numeric for cat in categorical if (num, cat) in made]


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over the rows that have both, levels as text."""
    return df.select(column(a).cast("string").alias("a"), column(b).cast("string").alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def chi_square_of(table: dict[tuple, int]) -> dict:
    """Chi-square (with Yates' correction for one degree of freedom), bias-corrected V and expected counts of a table."""
    rows, cols = (sorted({k[i] for k in table}) for i in (0, 1))
    n = sum(table.values())
    sums = {(0, r): sum(table.get((r, c), 0) for c in cols) for r in rows} | {(1, c): sum(table.get((r, c), 0) for r in rows) for c in cols}
    dof = (len(rows) - 1) * (len(cols) - 1)
    chi2, expected = 0.0, []
    for r in rows:
        for c in cols:
            e = sums[0, r] * sums[1, c] / n
            gap = abs(table.get((r, c), 0) - e)
            gap -= min(0.5, gap) if dof == 1 else 0
            chi2 += gap * gap / e
            expected.append(e)
    r, k = len(rows), len(cols)
    phi = max(0.0, chi2 / n - dof / (n - 1)) if n > 1 else 0.0
    room = min(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1 if n > 1 else 0.0
    return {"chi2": chi2, "p": special.chi2_sf(chi2, dof), "dof": dof, "v": math.sqrt(phi / room) if room > 0 else 0.0, "expected": expected, "rows": rows, "cols": cols, "n": n}


def tables(df: DataFrame, categorical: list[str], touched: Iterable[str] | None = None) -> dict[tuple[str, str], dict[tuple[str, str], int]]:
    """The counts (by pair of levels) of every pair of categorical columns over the rows that have both, from one scan; with
    ``touched`` only of pairs that have one of these."""
    pairs = [(i, j) for i, j in combinations(range(len(categorical)), 2) if touched is None or not {categorical[i], categorical[j]}.isdisjoint(touched)]
    if not pairs:
        return {}
    levels, codes = matrix.coded(df, categorical)
    got = matrix.fold(df, codes, matrix.Tables([max(1, len(v)) for v in levels], pairs)) if pairs else None
    out = {}
    for k, (i, j) in enumerate(pairs):
        counts = got[k] if got else np.zeros((0, 0), np.int64)
        out[categorical[i], categorical[j]] = {(levels[i][a], levels[j][b]): int(counts[a, b]) for a, b in zip(*np.nonzero(counts), strict=True)}
    return out


def contingency(df: DataFrame, categorical: list[str], touched: Iterable[str] | None = None, values: Values | None = None) -> list[dict]:
    """Chi-square of every pair of categorical columns (that has one of ``touched``); Fisher's p for a sparse 2 x 2 table. ``values``:
    the counts of these columns, if known."""
    out = []
    counts = {p: t for p, t in values.tables().items() if touched is None or not set(p).isdisjoint(touched)} if values else tables(df, categorical, touched)
    for (a, b), table in counts.items():
        if sum(table.values()) < LEAST_ROWS or min(len({k[i] for k in table}) for i in (0, 1)) < 2:
            continue
        t = chi_square_of(table)
        low = sum(e < 5 for e in t["expected"])
        kind, p = "chi_square", t["p"]
        if low and len(t["rows"]) == len(t["cols"]) == 2:
            kind, p = "fisher_exact", special.fisher_2x2(*(table.get((r, c), 0) for r in t["rows"] for c in t["cols"]))
        cells = {r: {c: table.get((r, c), 0) for c in t["cols"]} for r in t["rows"]}
        out.append(result("contingency", kind, [a, b], t["n"], t["chi2"], p, "cramers_v", t["v"], "none", [Assumption("expected counts of 5 or more", not low, f"{low} cell(s) under 5", low > 0)], None, chi2=t["chi2"], dof=t["dof"], min_expected=min(t["expected"]), low_expected_cells=low, table=cells))
    return out
