"""Plot-ready series: histograms, boxes, scatters, trends, contingency tables and the correlation matrix."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.operators.quantiles import level_quantiles, quantiles
from tallyweave.plans.batch import total, totals

#: Limits of what is shown, and the seed of what is drawn.
LEAST_BINS, MOST_BINS, BOX_OUTLIERS, LEVELS_SHOWN, MATRIX_COLUMNS = 5, 24, 12, 12, 24
SCATTER_POINTS, RESIDUAL_POINTS, PARTIAL_POINTS, INFLUENCE_POINTS, INFLUENCE_TOP, SEED = 160, 200, 150, 400, 20, 20260902
#: Pairs of columns whose series are made together.
PAIRS_AT_ONCE = 16
BLOCKS = "▁▂▃▄▅▆▇█"


def finite(x: Column) -> Column:
    """The value if it is a finite number, else null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def bin_count(low: float, high: float, q1: float, q3: float, n: int) -> int:
    """Freedman-Diaconis, or Sturges without spread, within the limits."""
    width = 2 * (q3 - q1) / n ** (1 / 3)
    bins = math.ceil((high - low) / width) if width > 0 else math.ceil(math.log2(n) + 1)
    return max(LEAST_BINS, min(MOST_BINS, bins))


def histograms(df: DataFrame, columns: dict[str, Column], quartiles: dict[str, tuple[float, float]] | None = None) -> dict[str, dict | None]:
    """Equal-width counts of each column over the values inside its 3 IQR fences; None under five values."""
    columns = {n: finite(x) for n, x in columns.items()}
    if quartiles is None:
        found = quantiles(df, columns, [0.25, 0.75])
        quartiles = {n: tuple(q) for n, q in found.items() if q}
    wanted: dict = {}
    for n, (q1, q3) in quartiles.items():
        x, reach = columns[n], 3 * (q3 - q1)
        inside = F.when((x >= q1 - reach) & (x <= q3 + reach), x) if reach > 0 else x
        wanted |= {(n, "n"): F.count(x), (n, "low"): F.min(inside), (n, "high"): F.max(inside), (n, "min"): F.min(x), (n, "max"): F.max(x)}
    got = total(df, wanted) if wanted else {}
    out: dict[str, dict | None] = dict.fromkeys(columns)
    binned = {}
    for n, (q1, q3) in quartiles.items():
        size, low, high = got[n, "n"], got[n, "low"], got[n, "high"]
        if size < 5:
            continue
        if got[n, "min"] == got[n, "max"]:
            out[n] = {"bin_edges": [low, high], "counts": [size], "n": size, "n_below": 0, "n_above": 0}
            continue
        if low == high:  # a single value inside the fences: the bin range widens by half a unit either way
            low, high = low - 0.5, high + 0.5
        bins = bin_count(low, high, q1, q3, size)
        edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
        out[n] = {"bin_edges": edges, "counts": [0] * bins, "n": size, "n_below": 0, "n_above": 0}
        x = columns[n]
        place = F.when(x < low, -1).when(x > high, bins).otherwise(F.least(F.floor((x - low) * bins / (high - low)).cast("int"), F.lit(bins - 1)))
        binned[n] = F.struct(F.lit(n).alias("name"), F.when(x.isNotNull(), place).alias("bin"))
    if binned:
        long = df.select(F.explode(F.array(*binned.values())).alias("p")).select("p.name", "p.bin").where("bin is not null")
        for name, place, count in long.groupBy("name", "bin").count().collect():
            h = out[name]
            if place < 0:
                h["n_below"] = count
            elif place >= len(h["counts"]):
                h["n_above"] = count
            else:
                h["counts"][place] = count
    return out


def sparkline(counts: Column) -> Column:
    """An array of counts as block glyphs, one each."""
    top = F.array_max(counts)
    glyph = lambda c: F.substring(F.lit(BLOCKS), F.when(top > 0, F.bround(c * 7 / F.nullif(top, F.lit(0)))).otherwise(0).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(counts, glyph), "")


def sparkline_text(counts: list[int]) -> str:
    top = max(counts, default=0)
    return "".join(BLOCKS[round(c * 7 / top) if top > 0 else 0] for c in counts)


def boxes(long: DataFrame, quartiles: dict[tuple[str, str], list[float]]) -> dict[tuple[str, str], dict]:
    """From rows (name, level, x): five numbers, whiskers within 1.5 IQR, and the smallest few values beyond them, in two passes."""
    if not quartiles:
        return {}
    spark = long.sparkSession
    fences = spark.createDataFrame([(n, v, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for (n, v), (q1, _, q3) in quartiles.items()], "name string, level string, low double, high double")
    rows = long.where("x is not null").join(F.broadcast(fences), ["name", "level"])  # a row for a box
    x = F.col("x")
    outside = (x < F.col("low")) | (x > F.col("high"))
    got = totals(rows, {"n": F.count(x), "min": F.min(x), "max": F.max(x), "lo": F.min(F.when(~outside, x)), "hi": F.max(F.when(~outside, x))}, ["name", "level"])
    far: dict = {}
    if any(m["min"] < q1 - 1.5 * (q3 - q1) or m["max"] > q3 + 1.5 * (q3 - q1) for k, m in got.items() for q1, _, q3 in [quartiles[k]]):
        beyond = rows.where(outside).select("name", "level", "x", F.row_number().over(Window.partitionBy("name", "level").orderBy("x")).alias("k")).where(F.col("k") <= BOX_OUTLIERS)
        for r in beyond.orderBy("k").collect():  # a dozen for a box
            far.setdefault((r["name"], r["level"]), []).append(r["x"])
    return {k: {"min": m["min"], "q1": q1, "median": median, "q3": q3, "max": m["max"], "whisker_lo": q1 if m["lo"] is None else m["lo"], "whisker_hi": q3 if m["hi"] is None else m["hi"], "outliers": far.get(k, []), "n": m["n"]} for k, m in got.items() for q1, median, q3 in [quartiles[k]]}


def column_boxes(df: DataFrame, columns: dict[str, Column], quartiles: dict[str, list[float]] | None = None) -> dict[str, dict]:
    """A box for each column that has a finite value."""
    columns = {n: finite(x) for n, x in columns.items()}
    if quartiles is None:
        quartiles = {n: q for n, q in quantiles(df, columns, [0.25, 0.5, 0.75]).items() if q}
    if not quartiles:
        return {}
    long = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit("").alias("level"), columns[n].alias("x")) for n in quartiles))).alias("e")).select("e.*")
    return {n: b for (n, _), b in boxes(long, {(n, ""): q for n, q in quartiles.items()}).items()}


def box_of(df: DataFrame, x: Column) -> dict | None:
    return column_boxes(df, {"x": x}).get("x")


def level_boxes(df: DataFrame, wanted: dict[object, tuple[Column, Column, list[str]]]) -> dict[object, list[dict]]:
    """For each key a box for each of its levels (numeric column, categorical column, levels in order), all keys together."""
    out: dict = {}
    keys = list(wanted)
    for at in range(0, len(keys), PAIRS_AT_ONCE):
        some = {str(i): wanted[k] for i, k in enumerate(keys[at : at + PAIRS_AT_ONCE])}
        entry = F.array(*(F.struct(F.lit(i).alias("name"), F.when(cat.cast("string").isin(levels), cat.cast("string")).alias("level"), finite(num).alias("x")) for i, (num, cat, levels) in some.items()))
        long = df.select(F.explode(entry).alias("e")).select("e.*").where("level is not null and x is not null")
        key = F.concat("name", F.lit(" "), "level")
        quartiles = {tuple(v.split(" ", 1)): q for (_, v), q in level_quantiles(long, {"x": F.col("x")}, [0.25, 0.5, 0.75], key).items()}
        made = boxes(long, quartiles)
        for i, k in enumerate(keys[at : at + PAIRS_AT_ONCE]):
            out[k] = [{"level": v} | made[str(i), v] for v in wanted[k][2] if (str(i), v) in made]
    return out


def group_boxes(df: DataFrame, num: Column, cat: Column, levels: list[str]) -> list[dict]:
    """A box for each level, in the order given."""
    return level_boxes(df, {"": (num, cat, levels)})[""]


def _trend(got: dict) -> dict | None:
    if got["n"] < 3 or got["slope"] is None:
        return None
    at = lambda v: got["my"] + got["slope"] * (v - got["mx"])
    return {"x0": got["x0"], "y0": at(got["x0"]), "x1": got["x1"], "y1": at(got["x1"]), "slope": got["slope"]}


def trend_of(df: DataFrame, x: Column, y: Column) -> dict | None:
    """End points of the least-squares line; None under three points or without spread in x."""
    pair = x.isNotNull() & y.isNotNull()
    x, y = F.when(pair, x), F.when(pair, y)
    return _trend(total(df, {"n": F.count(x), "slope": F.try_divide(F.regr_sxy(y, x), F.regr_sxx(y, x)), "mx": F.avg(x), "my": F.avg(y), "x0": F.min(x), "x1": F.max(x)}))


def limits_of(q1: float, q3: float, low: float, high: float) -> list[float]:
    """Axis limits: 3 IQR fences within the data, padded by a twentieth; a unit either way without spread."""
    if q3 > q1:
        low, high = max(low, q1 - 3 * (q3 - q1)), min(high, q3 + 3 * (q3 - q1))
    if low == high:
        return [low - 1.0, high + 1.0]
    return [low - 0.05 * (high - low), high + 0.05 * (high - low)]


def drawn(df: DataFrame, cap: int, by: Column) -> DataFrame:
    """At most ``cap`` rows, the same ones for the same rows however they are partitioned."""
    return df.orderBy(F.xxhash64(by, F.lit(SEED)), by).limit(cap)


def drawn_by_key(long: DataFrame, cap: int, by: Column, sizes: dict[int, int]) -> list:
    """The same for the rows of each ``key``, which has so many rows; sorted are only rows whose hash is small, unless they are too few."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("hash_", by))
    hashed = long.withColumn("hash_", F.xxhash64(by, F.lit(SEED)))
    bounds = F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, min(2**63 - 1, int(min(1.0, (4 * cap + 100) / n) * 2**64) - 2**63))))[F.col("key")]
    for some in (hashed.where(F.col("hash_") <= bounds), hashed):
        rows = some.withColumn("place", place).where(F.col("place") <= cap).drop("place", "hash_").collect()  # at most ``cap`` for a key
        met = Counter(r["key"] for r in rows)
        if all(met[k] >= min(cap, n) for k, n in sizes.items()):
            break
    return rows


def _long(df: DataFrame, entries: dict[int, dict[str, Column]]) -> DataFrame:
    """A row for each key and row of the frame, with the key's columns; rows with a null among them are left out."""
    names = list(next(iter(entries.values())))
    entry = F.array(*(F.struct(F.lit(k).alias("key"), *(c.alias(n) for n, c in e.items())) for k, e in entries.items()))
    return df.select(F.explode(entry).alias("e")).select("e.*").dropna(subset=names)


def points_of(df: DataFrame, pairs: dict[object, tuple[Column, Column]], cap: int, names: tuple[str, str] = ("x_lim", "y_lim"), trends: bool = False) -> dict[object, dict | None]:
    """Of each pair of columns: points (all, or a seeded draw), their number, limits from all of them, and the trend; None under three."""
    keys, out = list(pairs), dict.fromkeys(pairs)
    for at in range(0, len(keys), PAIRS_AT_ONCE):
        some = dict(enumerate(keys[at : at + PAIRS_AT_ONCE]))
        made = []
        for i, key in some.items():
            x, y = finite(pairs[key][0]), finite(pairs[key][1])
            both = x.isNotNull() & y.isNotNull()
            made += [F.when(both, x).alias(f"x{i}"), F.when(both, y).alias(f"y{i}")]
        rows = df.select(*made)
        wanted: dict = {}
        for i in some:
            x, y = F.col(f"x{i}"), F.col(f"y{i}")
            wanted |= {(i, "n"): F.count(x), (i, "x0"): F.min(x), (i, "x1"): F.max(x), (i, "y0"): F.min(y), (i, "y1"): F.max(y)}
            wanted |= {(i, "slope"): F.try_divide(F.regr_sxy(y, x), F.regr_sxx(y, x)), (i, "mx"): F.avg(x), (i, "my"): F.avg(y)} if trends else {}
        ends = total(rows, wanted)
        some = {i: key for i, key in some.items() if ends[i, "n"] >= 3}
        if not some:
            continue
        q = quantiles(rows, {f"{v}{i}": F.col(f"{v}{i}") for i in some for v in "xy"}, [0.25, 0.75])
        limits = {(i, v): limits_of(*q[f"{v}{i}"], ends[i, f"{v}0"], ends[i, f"{v}1"]) for i in some for v in "xy"}
        outside = {i: F.count_if((F.col(f"x{i}") < limits[i, "x"][0]) | (F.col(f"x{i}") > limits[i, "x"][1]) | (F.col(f"y{i}") < limits[i, "y"][0]) | (F.col(f"y{i}") > limits[i, "y"][1])) for i in some}
        clipped = total(rows, outside)
        shown: dict = {i: [] for i in some}
        for r in drawn_by_key(_long(rows, {i: {"x": F.col(f"x{i}"), "y": F.col(f"y{i}")} for i in some}), cap, F.struct("x", "y"), {i: ends[i, "n"] for i in some}):
            shown[r["key"]].append([r["x"], r["y"]])
        for i, key in some.items():
            n = ends[i, "n"]
            out[key] = {"points": sorted(shown[i]), "n": n, "sampled": n > cap, names[0]: limits[i, "x"], names[1]: limits[i, "y"], "clipped": clipped[i]}
            if trends:
                out[key]["trend"] = _trend({k: ends[i, k] for k in ("n", "slope", "mx", "my", "x0", "x1")})
    return out


def points_series(df: DataFrame, x: Column, y: Column, cap: int, names: tuple[str, str] = ("x_lim", "y_lim")) -> dict | None:
    return points_of(df, {0: (x, y)}, cap, names)[0]


def scatter_series(df: DataFrame, x: Column, y: Column, cap: int = SCATTER_POINTS) -> dict | None:
    return points_of(df, {0: (x, y)}, cap, trends=True)[0]


def influences(df: DataFrame, distances: dict[object, Column], row: Column, cap: int = INFLUENCE_POINTS) -> dict[object, dict | None]:
    """Of each column of distances, by row: the largest always, a seeded draw of the others; None under three."""
    out: dict = dict.fromkeys(distances)
    rows = df.select(row.alias("row"), *(finite(d).alias(f"d{i}") for i, d in enumerate(distances.values())))
    got = total(rows, {(i, k): f(f"d{i}") for i in range(len(distances)) for k, f in (("n", F.count), ("max", F.max))}) if distances else {}
    some = {i: key for i, key in enumerate(distances) if got[i, "n"] >= 3}
    if not some:
        return out
    above = total(rows, {i: F.count_if(F.col(f"d{i}") > 4.0 / got[i, "n"]) for i in some})
    long = _long(rows, {i: {"row": F.col("row"), "d": F.col(f"d{i}")} for i in some})
    top = long.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("d"), "row"))).where(F.col("place") <= INFLUENCE_TOP).drop("place")
    shown: dict = {i: set() for i in some}
    for r in [*top.collect(), *drawn_by_key(long, cap, F.col("row"), {i: got[i, "n"] for i in some})]:  # at most ``cap`` and the largest for a key
        shown[r["key"]].add((r["row"], r["d"]))
    for i, key in some.items():
        n = got[i, "n"]
        out[key] = {"points": sorted(map(list, shown[i])), "n": n, "threshold": 4.0 / n, "n_above": above[i], "max": got[i, "max"], "sampled": n > cap}
    return out


def influence_series(df: DataFrame, distance: Column, row: Column, cap: int = INFLUENCE_POINTS) -> dict | None:
    return influences(df, {0: distance}, row, cap)[0]


def contingency_series(rows: dict[tuple[str, str], int], row_var: str, col_var: str) -> dict | None:
    """From counts by pair of levels: the commonest levels of either side, counts, and shares of the shown cells by row."""
    if not rows:
        return None
    order = {}
    for k in (0, 1):
        sums: dict[str, int] = {}
        for key, n in rows.items():
            sums[key[k]] = sums.get(key[k], 0) + n
        order[k] = sorted(sums, key=lambda v: (-sums[v], v))
    top = [order[k][:LEVELS_SHOWN] for k in (0, 1)]
    counts = [[rows.get((a, b), 0) for b in top[1]] for a in top[0]]
    sums = [sum(c) for c in counts]
    return {"row_var": row_var, "col_var": col_var, "rows": top[0], "cols": top[1], "counts": counts, "row_shares": [[v / t if t else 0.0 for v in c] for c, t in zip(counts, sums, strict=True)], "row_totals": sums, "n": sum(sums), "truncated": any(len(order[k]) > len(top[k]) for k in (0, 1))}


def correlation_matrix(numeric: list[str], results: DataFrame) -> DataFrame | None:
    """Cells (i, j, value, q, kind, n) of the upper triangle and the diagonal, for the first columns."""
    cols = numeric[:MATRIX_COLUMNS]
    if len(cols) < 2:
        return None
    spark = results.sparkSession
    place = F.create_map(*(F.lit(v) for i, c in enumerate(cols) for v in (c, i)))
    a, b = place[F.col("vars")[0]], place[F.col("vars")[1]]
    pairs = results.where((F.col("family") == "correlation") & a.isNotNull() & b.isNotNull() & finite(F.col("effect_value")).isNotNull())
    cells = pairs.select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), F.col("effect_value").alias("value"), F.col("q_value").alias("q"), "kind", "n")
    own = spark.range(len(cols)).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("value"), F.lit(None).cast("double").alias("q"), F.lit("identity").alias("kind"), F.lit(None).cast("bigint").alias("n"))
    return own.unionByName(cells)


