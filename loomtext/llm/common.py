"""What the training-data operators share: tables, scratch tables in the cluster's folder, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch. Documents may be long, so a batch is kept to a few MB.
ARROW_ROWS = 400

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Session setting: fewer rows in each Arrow batch, so that long texts fit the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another number of rows in each Arrow batch, for what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/loomtext-{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Spilled:
    """A DataFrame written to the shared folder and read again: lineage ends here and lost executors cost nothing."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def spill(df: DataFrame, label: str) -> DataFrame:
    return Spilled(df, label).df


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        if spark.sparkContext._jsc is not None:
            try:
                remove(spark, path)
            except Exception:  # the gateway may be gone at exit; the folder is scratch space
                return
