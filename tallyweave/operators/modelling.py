"""The frames that are analysed: chosen columns, typed, as they are and with gaps filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import column
from tallyweave.operators.catalog import Column_
from tallyweave.operators.quantiles import quantiles
from tallyweave.plans.batch import total
from tallyweave.sources.frames import Frame, number_of

MOST_COLUMNS = 40


def entropy(counts: DataFrame) -> DataFrame:
    """-sum p ln(p + 1e-12) of a frame with the column count."""
    n = counts.agg(F.sum("count").alias("n"))
    return counts.join(F.broadcast(n)).agg((-F.sum(F.col("count") / F.col("n") * F.log(F.col("count") / F.col("n") + 1e-12))).alias("entropy"))  # n is one row


def chosen_columns(frame: Frame, columns: list[Column_], most: int = MOST_COLUMNS) -> tuple[list[str], list[str]]:
    """Names to analyse, and names beyond the cap: fuller columns first, then those with more spread or entropy."""
    usable = [p for p in columns if p.type in ("numeric", "categorical")]
    if len(usable) <= most:
        return [p.name for p in usable], []

    def worth(p: Column_) -> tuple[float, float]:
        if p.type == "numeric":
            return 1 - p.pct_missing, abs(p.stats["std"]) / (abs(p.stats["max"] - p.stats["min"]) or 1.0)
        return 1 - p.pct_missing, entropy(frame.df.where(column(p.name).isNotNull()).groupBy(column(p.name)).count()).first()[0]

    order = sorted(usable, key=worth, reverse=True)
    return [p.name for p in order[:most]], [p.name for p in order[most:]]


def category(c):
    """A level as text; whole doubles keep their point, truth values are True and False."""
    return F.when(F.typeof(c) == "boolean", F.initcap(c.cast("string"))).otherwise(c.cast("string"))


def analysed(frame: Frame, columns: list[Column_], names: list[str], row: Column | None = None) -> DataFrame:
    """The chosen columns: numbers as double, categories as text; nulls stay. ``row`` comes along if given."""
    by = {p.name: p for p in columns}
    return frame.df.select(*((number_of(frame, n, by[n].coerced_from_text) if by[n].type == "numeric" else category(column(n))).alias(n) for n in names), *([] if row is None else [row]))


def fill_values(df: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, object]:
    """Median of numeric and mode (the smallest of equals) of categorical columns; nothing for empty ones."""
    medians = quantiles(df, {c: column(c) for c in numeric}, [0.5]) if numeric else {}
    modes = total(df, {c: F.mode(column(c), True) for c in categorical}) if categorical else {}
    return {c: v[0] for c, v in medians.items() if v} | {c: v for c, v in modes.items() if v is not None}


def imputed(df: DataFrame, numeric: list[str], categorical: list[str], fills: dict[str, object] | None = None) -> DataFrame:
    """The frame with its gaps filled; with ``fills`` by these."""
    fills = fill_values(df, numeric, categorical) if fills is None else fills
    value = {c: F.lit(v).cast(df.schema[c].dataType) if c in categorical else F.lit(v) for c, v in fills.items()}
    return df.select(*((F.coalesce(column(c), value[c]) if c in value else column(c)).alias(c) for c in df.columns))


def split(columns: list[Column_], names: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical names in the order of the table."""
    return tuple([p.name for p in columns if p.name in names and p.type == k] for k in ("numeric", "categorical"))


def gappy(df: DataFrame) -> set[str]:
    """The columns that lack a value somewhere."""
    got = total(df, {c: F.count(column(c)) for c in df.columns} | {"": F.count(F.lit(1))})
    return {c for c in df.columns if got[c] < got[""]}
