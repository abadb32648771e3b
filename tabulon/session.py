"""Session helpers: shared scratch folder, table reading, cutting lineage through written tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers where their path doesn't hold it, once a context."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if getattr(context, "_tabulon_shipped", False):
        return
    context._tabulon_shipped = True
    if home in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == home:
        return
    folder = tempfile.mkdtemp(prefix="tabulon-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "tabulon"), "zip", home, "tabulon"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local (tests, benches)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tabulon-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


DEFAULT_BATCH = "67108864b"  # Spark's own limit of an Arrow batch
_made: list[str] = []  # folders under the shared one that haven't been deleted


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end all scratch folders made within it, but those of the written frames that are put on the list."""
    before, kept = set(_made), []
    yield kept
    stay = {getattr(df, "_tabulon_path", None) for df in kept}
    for path in [p for p in _made if p not in before and p not in stay]:
        delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: later work doesn't compute it anew, and a lost executor takes none of it away."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tabulon_path = path
    return back


def forget(*frames: DataFrame) -> None:
    """Deletes what written() wrote for frames that nothing will read any more."""
    for df in frames:
        path = getattr(df, "_tabulon_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    if path in _made:
        _made.remove(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, most: str = "4194304b") -> None:
    """Limits the session's Arrow batches to a few MB each, where no limit is set yet, so that neither the JVM's buffers nor a Python worker hold more than a few texts at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BATCH:
        spark.conf.set(key, most)
