"""Session helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that Python is given.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_shipped: set[str] = set()
_stored: list[DataFrame] = []


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches for long texts and give executors this package; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    top = Path(__file__).resolve().parent.parent
    name = os.path.join(tempfile.mkdtemp(), "tallyweave_src.zip")
    with zipfile.ZipFile(name, "w") as z:  # the driver serves it to the executors
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyweave-shared-")  # tests and single machines
        spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """The frame kept on the executors' disks for several uses; a lost part is computed again from its source."""
    df = df.persist(StorageLevel.DISK_ONLY)
    _stored.append(df)
    return df


def release() -> None:
    """Give back what ``stored`` keeps, once a result that uses it has been written."""
    while _stored:
        _stored.pop().unpersist()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/tallyweave/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def dropped(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """The frame written as a table in the shared folder and read again, which cuts its lineage and its plan.

    ``compact``: rebalanced first, so that a small table is one file.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if compact else df
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """The name, or one like it, that none of the columns has (whatever its case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> tuple:
    """Two columns, never null, that tell rows apart by doc_id and text; only repeated rows share both."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.xxhash64(F.col("text"), F.col("doc_id").cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(mod: int, rest: int):
    """crc32 of doc_id as text, modulo ``mod``, equals ``rest``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest
