"""The column catalog: what each column is, and the statistics of the numeric ones."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.text import column, filled, identifier_name, looks_dated, looks_numeric, share
from tallyweave.operators.quantiles import quantiles
from tallyweave.operators.series import column_boxes, histograms
from tallyweave.plans.batch import total
from tallyweave.sources.frames import Frame, number_of

#: Limits of the classification.
MOST_LEVELS, NEAR_CONSTANT, UNIQUE_SHARE, TEXT_SHARE, MOSTLY_MISSING = 50, 0.99, 0.95, 0.9, 0.5
OUTLIERS_KEPT = 25


@dataclass
class Column_:
    """One column's record."""

    name: str
    type: str = "excluded"
    exclude_reason: str | None = None
    n_missing: int = 0
    pct_missing: float = 0.0
    n_unique: int = 0
    unique_ratio: float = 0.0
    coerced_from_text: bool = False
    stats: dict | None = None
    level_counts = (0, 0, 0)  # values, and how often the commonest and the rarest of them; no part of the record


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted skewness; 0 for two values or fewer and for a constant."""
    n = F.count(x)
    return F.when(n > 2, F.coalesce(F.skewness(x), F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).otherwise(0.0)


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis; 0 for three values or fewer and for a constant."""
    n = F.count(x)
    g = F.kurtosis(x)
    adjusted = F.try_divide((n - 1).cast("double"), (n - 2) * (n - 3)) * ((n + 1) * g + 6)
    return F.when((n > 3) & g.isNotNull(), adjusted).otherwise(0.0)


def distinct_counts(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """(name, n_unique, top, least): distinct values of each column and the counts of its commonest and rarest, by one unpivot."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in texts.items())))
    long = df.select(pairs.alias("p")).select("p.name", "p.value").where("value is not null")
    return long.groupBy("name", "value").count().groupBy("name").agg(F.count(F.lit(1)).alias("n_unique"), F.max("count").alias("top"), F.min("count").alias("least"))


def numeric_stats(df: DataFrame, columns: dict[str, Column]) -> dict[str, dict]:
    """Moments, quartiles, outlier counts, histogram and box of numeric columns."""
    wanted = {}
    for n, x in columns.items():
        wanted |= {(n, "min"): F.min(x), (n, "max"): F.max(x), (n, "mean"): F.avg(x), (n, "std"): F.coalesce(F.stddev_samp(x), F.lit(0.0)), (n, "skew"): adjusted_skew(x), (n, "kurtosis"): adjusted_kurtosis(x), (n, "n"): F.count(x)}
    got = total(df, wanted)
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75])
    out = {}
    fences = {}
    for n, x in columns.items():
        s = {k: got[n, k] for k in ("min", "max", "mean", "std", "skew", "kurtosis")}
        if not got[n, "n"]:
            out[n] = {}
            continue
        q1, median, q3 = quartiles[n]
        out[n] = s | {"median": median, "q1": q1, "q3": q3, "n_outliers_3iqr": 0, "n_outliers_5iqr": 0}
        if q3 > q1:
            for k in (3, 5):
                fences[n, f"n_outliers_{k}iqr"] = F.count_if((x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1)))
    for (n, key), value in total(df, fences).items() if fences else ():
        out[n][key] = value
    some = {n: x for n, x in columns.items() if out[n]}
    shown = histograms(df, some, {n: (out[n]["q1"], out[n]["q3"]) for n in some})
    drawn = column_boxes(df, some, {n: [out[n]["q1"], out[n]["median"], out[n]["q3"]] for n in some})
    for n in some:
        out[n]["histogram"], out[n]["box"] = shown[n], drawn.get(n)
    return out


def profile(frame: Frame) -> tuple[int, list[Column_]]:
    """Number of rows and the record of each column, in order."""
    df = frame.df
    kinds = {c: df.schema[c].dataType for c in frame.columns}
    numeric = {c for c, k in kinds.items() if isinstance(k, T.NumericType)}
    dated = {c for c, k in kinds.items() if isinstance(k, T.DateType | T.TimestampType | T.TimestampNTZType)}
    usable = {c for c, k in kinds.items() if c in numeric or c in dated or isinstance(k, T.StringType | T.BooleanType)}
    text = {c: column(frame.raw.get(c, c)).cast("string") for c in usable}
    wanted: dict = {("", "rows"): F.count(F.lit(1))} | {(c, "n"): F.count(column(c)) for c in frame.columns}
    for c in usable - numeric - dated:
        wanted[c, "numeric"] = share(looks_numeric(text[c]), filled(text[c]))
        wanted[c, "dated"] = share(looks_dated(text[c]), filled(text[c]))
    got = total(df, wanted)
    rows = got["", "rows"]
    coerced = {c for c in usable if got.get((c, "numeric"), 0) >= TEXT_SHARE and isinstance(kinds[c], T.StringType)}
    values = {c: number_of(frame, c, c in coerced) if c in numeric | coerced else column(c) for c in usable}
    counts = {r["name"]: (r["n_unique"], r["top"], r["least"]) for r in distinct_counts(df, values).collect()} if usable else {}
    parsed = {r["name"]: r["top"] for r in distinct_counts(df, {c: column(c) for c in coerced}).collect()} if coerced else {}
    out, measured = [], {}
    for c in frame.columns:
        n = got[c, "n"]
        missing = (rows - n) / rows if rows else 0.0
        unique, top, least = counts.get(c, (0, 0, 0))
        ratio = unique / rows if rows else 0.0
        p = Column_(c, "excluded", None, rows - n, round(missing, 4), unique, round(ratio, 4), c in coerced)
        p.level_counts = (n, top, least)
        named = identifier_name(c)
        if c not in usable:
            p.exclude_reason = "unsupported type"
        elif not n:
            p.exclude_reason = "empty"
        elif missing > MOSTLY_MISSING:
            p.exclude_reason = "mostly missing"
        elif unique <= 1:
            p.exclude_reason = "constant"
        elif (parsed.get(c, top) if c in coerced else top) / n >= NEAR_CONSTANT:
            p.exclude_reason = "near-constant"
        elif c in numeric or c in coerced:
            if named and ratio >= UNIQUE_SHARE:
                p.exclude_reason = "id-like"
            else:
                p.type = "numeric"
                measured[c] = values[c]
        elif c in dated or got.get((c, "dated"), 0) >= TEXT_SHARE:
            p.type, p.exclude_reason = "datetime", "dates are described, not analysed"
        elif named or ratio >= UNIQUE_SHARE:
            p.exclude_reason = "id-like / free text"
        elif unique > MOST_LEVELS or ratio >= 0.5:
            p.exclude_reason = "high-cardinality text"
        else:
            p.type = "categorical"
        out.append(p)
    if measured:
        stats = numeric_stats(df, measured)
        for p in out:
            p.stats = stats.get(p.name)
    return rows, out


def identifier_column(columns: list[Column_]) -> str | None:
    """The first column that was left out for looking like an identifier."""
    return next((p.name for p in columns if (p.exclude_reason or "").startswith("id-like")), None)


def as_frame(spark: SparkSession, columns: list[Column_]) -> DataFrame:
    """The catalog as rows, without statistics."""
    rows = [tuple(v for k, v in asdict(p).items() if k != "stats") for p in columns]
    return spark.createDataFrame(rows, "name string, type string, exclude_reason string, n_missing bigint, pct_missing double, n_unique bigint, unique_ratio double, coerced_from_text boolean")


def type_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
