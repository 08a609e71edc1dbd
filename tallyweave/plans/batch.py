"""Aggregating many expressions, and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame

#: Expressions of one aggregation; more would leave generated code behind.
MOST_EXPRESSIONS = 160


def totals(df: DataFrame, wanted: dict[str, Column], by: Iterable[str] = ()) -> dict[tuple, dict]:
    """Every aggregate by group key (() without ``by``), in as many passes as plan size asks for."""
    by, names, out = list(by), list(wanted), {}
    for k in range(0, len(names), MOST_EXPRESSIONS):
        some = names[k : k + MOST_EXPRESSIONS]
        made = df.groupBy(*by).agg(*(wanted[n].alias(f"a{i}") for i, n in enumerate(some))) if by else df.agg(*(wanted[n].alias(f"a{i}") for i, n in enumerate(some)))
        for row in made.collect():  # as many rows as groups: levels, bins or one
            out.setdefault(tuple(row[: len(by)]), {}).update(zip(some, row[len(by) :], strict=True))
    return out


def total(df: DataFrame, wanted: dict[str, Column]) -> dict:
    return totals(df, wanted).get((), {})


def kept(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the folder of spark.checkpoint.dir (on one machine a temporary one), until the application ends."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark.sparkContext.setCheckpointDir(where)
    path = f"{where}/tallyweave/{label}-{uuid.uuid4().hex}"
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(table)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
