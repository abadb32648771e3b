"""MRC image stacks as rows (path, index, ny, nx, pixels), read and written by tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: MRC modes and their NumPy types.
MODES = {0: np.int8, 1: np.int16, 2: np.float32, 6: np.uint16, 12: np.float16}
SCHEMA = "path string, index int, ny int, nx int, pixels array<float>"


def encode(images: np.ndarray, pixel: float = 1.0) -> bytes:
    """An MRC file (mode 2) of a stack (n, ny, nx)."""
    n, ny, nx = images.shape
    head = np.zeros(256, "<i4")
    head[:4] = nx, ny, n, 2
    head[7:10] = nx, ny, n
    head[10:13] = np.array([nx * pixel, ny * pixel, n * pixel], "<f4").view("<i4")
    head[16:19] = 1, 2, 3
    head[52] = int.from_bytes(b"MAP ", "little")
    head[53] = 0x00004444
    return head.tobytes() + np.ascontiguousarray(images, "<f4").tobytes()


def decode(data: bytes) -> np.ndarray:
    head = np.frombuffer(data, "<i4", 256)
    nx, ny, n, mode = head[:4].tolist()
    kind = np.dtype(MODES[mode]).newbyteorder("<")
    return np.frombuffer(data, kind, nx * ny * n, 1024 + int(head[23])).reshape(n, ny, nx).astype(np.float32)


def _rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, content in zip(part["path"], part["content"], strict=True):
            stack = decode(content)
            yield pd.DataFrame({"path": path, "index": range(1, len(stack) + 1), "ny": stack.shape[1], "nx": stack.shape[2], "pixels": [x.ravel() for x in stack]})


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.mrc*").load(path).select("path", "content").mapInPandas(_rows, SCHEMA)


def normalised(images: DataFrame) -> DataFrame:
    """Zero mean and unit deviation of each image, with array functions only."""
    from pyspark.sql import functions as F

    s = F.aggregate("pixels", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x.cast("double") * x).alias("q")))
    n = F.size("pixels")
    m = images.withColumn("_s", s).withColumn("_m", F.col("_s.s") / n).withColumn("_d", F.sqrt(F.greatest(F.col("_s.q") / n - F.col("_m") ** 2, F.lit(0.0))))
    return m.withColumn("pixels", F.transform("pixels", lambda x: F.when(F.col("_d") > 0, (x - F.col("_m")) / F.col("_d")).otherwise(0.0).cast("float"))).drop("_s", "_m", "_d")
