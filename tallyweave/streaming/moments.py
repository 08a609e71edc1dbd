"""Moments of numeric columns over a stream: the part of a profile that can be kept up to date in bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.functions.text import column


def running_moments(df: DataFrame, numeric: list[str]) -> DataFrame:
    """(name, n, n_missing, mean, sd, low, high) of each column, of a batch or a stream; the state is one row a column."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), column(c).cast("double").alias("x")) for c in numeric)))
    x = F.when(~F.isnan("x"), F.col("x"))
    long = df.select(pairs.alias("p")).select("p.name", "p.x")
    return long.groupBy("name").agg(F.count(x).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("n_missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))


def watch(stream: DataFrame, numeric: list[str], name: str) -> StreamingQuery:
    """Keep the moments of a stream in the in-memory table ``name``."""
    return running_moments(stream, numeric).writeStream.outputMode("complete").format("memory").queryName(name).start()
