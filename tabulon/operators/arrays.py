"""Image kernels over rows (id, ny, nx, pixels): spectra, filters, correlations, Fourier shell correlation.

Per-image sums use array functions; Fourier transforms run in NumPy over Arrow batches of images of equal size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "id long, ny int, nx int, pixels array<float>"


def radii(ny: int, nx: int) -> np.ndarray:
    """The rounded distance of each Fourier element from the origin."""
    y, x = np.fft.fftfreq(ny, 1 / ny), np.fft.fftfreq(nx, 1 / nx)
    return np.rint(np.hypot(y[:, None], x)).astype(np.int64)


def _groups(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Rows of equal size: their places and pixels (n, ny, nx)."""
    ny, nx = b.column(1).to_numpy(), b.column(2).to_numpy()
    pixels = b.column(3).to_numpy(zero_copy_only=False)
    for h, w in sorted({*zip(ny.tolist(), nx.tolist(), strict=True)}):
        at = np.flatnonzero((ny == h) & (nx == w))
        yield at, np.stack([np.asarray(pixels[i], np.float64) for i in at]).reshape(-1, h, w), h, w


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, x, h, w in _groups(b):
            r = radii(h, w)
            power = np.abs(np.fft.fft2(x)) ** 2
            n = np.bincount(r.ravel())
            sums = np.stack([np.bincount(r.ravel(), p.ravel(), len(n)) for p in power])
            ids = b.column(0).to_numpy()[at]
            yield pa.record_batch([pa.array(np.repeat(ids, len(n))), pa.array(np.tile(np.arange(len(n)), len(at)).astype(np.int32)), pa.array((sums / n).ravel())], names=["id", "shell", "power"])


def power_spectra(images: DataFrame) -> DataFrame:
    """(id, shell, mean power) of each image's rotationally averaged spectrum."""
    return images.select("id", "ny", "nx", "pixels").mapInArrow(_spectra, "id long, shell int, power double")


def low_pass(shell: float, width: float = 2.0) -> Callable[[np.ndarray], np.ndarray]:
    """Weights of shells: 1 below shell - width / 2, 0 above shell + width / 2, half a cosine between."""
    return partial(_cosine_edge, shell=shell, width=width)


def _cosine_edge(r: np.ndarray, shell: float, width: float) -> np.ndarray:
    return 0.5 + 0.5 * np.cos(np.pi * np.clip((r - shell + width / 2) / width, 0, 1))


def _filter(batches: Iterator[pa.RecordBatch], weight: Callable) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, x, h, w in _groups(b):
            out = np.fft.ifft2(np.fft.fft2(x) * weight(radii(h, w))).real.astype(np.float32)
            yield pa.record_batch([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(list(out.reshape(len(at), -1)), pa.list_(pa.float32()))], names=["id", "ny", "nx", "pixels"])


def filtered(images: DataFrame, weight: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    return images.select("id", "ny", "nx", "pixels").mapInArrow(partial(_filter, weight=weight), IMAGE)


def averages(images: DataFrame, by: str) -> DataFrame:
    """(by, n, pixels): the mean image of each group, from partial sums of pixels."""
    each = images.select(by, F.posexplode("pixels").alias("at", "v")).groupBy(by, "at").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return each.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("pixels"))


def shell_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of two images (or volumes of one slice) in each Fourier shell; 0 where a shell is empty of power."""
    r = radii(*a.shape).ravel()
    fa, fb = np.fft.fft2(a).ravel(), np.fft.fft2(b).ravel()
    top = np.bincount(r, (fa * fb.conj()).real)
    down = np.sqrt(np.bincount(r, np.abs(fa) ** 2) * np.bincount(r, np.abs(fb) ** 2))
    return np.divide(top, down, out=np.zeros_like(top), where=down > 0)


def pearson_to(images: DataFrame, reference: list[float]) -> DataFrame:
    """(id, r): each image's Pearson correlation with a reference, in array functions."""
    ref = np.asarray(reference, float)
    ref = ref - ref.mean()
    norm = float(np.sqrt((ref**2).sum()))
    r = F.array(*[F.lit(float(x)) for x in ref])
    n = F.size("pixels")
    s = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x.cast("double"))
    q = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    xy = F.aggregate(F.zip_with("pixels", r, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    sd = F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)))
    return images.select("id", F.when((sd > 0) & (F.lit(norm) > 0), xy / (sd * norm)).otherwise(0.0).alias("r"))
