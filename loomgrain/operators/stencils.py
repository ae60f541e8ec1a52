"""Filters on whole tiles: one thin Arrow pass a filter, no shuffle; images are independent of each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.functions import kernels

#: Pixels of images of one size that a kernel takes as one stack.
STACK = 1 << 16


def map_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], stacked: bool = False, spread: bool = False) -> DataFrame:
    """tiles with each image replaced by kernel(image). Null data stays null; values and shapes may change.

    Rows are taken a few at a time, so the batch size of the session doesn't decide how much memory a task needs. With
    `stacked` the kernel takes stacks (n, height, width) of images of one size, of STACK pixels or one image. With `spread`
    images are first dealt over the session's partitions, for kernels that take far longer than a shuffle of the images,
    as the files that they come from may be few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024 if stacked else 32):
                b = whole.slice(at, 1024 if stacked else 32)
                sizes, col = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)), b.column(4)
                held, ends = col.is_valid().to_pylist(), col.offsets.to_numpy()
                flat = col.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
                data, at_size = [None] * len(sizes), {}
                for i, ok in enumerate(held):
                    if ok:
                        at_size.setdefault(sizes[i], []).append(i)
                for (h, w), own in at_size.items():
                    step = max(1, STACK // max(1, h * w)) if stacked else 1
                    for k in range(0, len(own), step):
                        some = own[k : k + step]
                        images = np.stack([flat[ends[i] : ends[i + 1]].reshape(h, w) for i in some])
                        made = kernel(images) if stacked else [kernel(images[0])]
                        for i, out in zip(some, made, strict=True):
                            out = np.asarray(out, dtype=float)
                            sizes[i], data[i] = out.shape, out.ravel()
                hs, ws = (pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), hs, ws, pa.array(data, pa.list_(pa.float64()))], names=["image_id", "channel", "height", "width", "data"])

    src = tiles.select("image_id", F.col("channel").cast("string"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("data").cast("array<double>"))
    if spread:
        src = src.repartition("image_id", "channel")
    return src.mapInArrow(run, f"image_id {tiles.schema['image_id'].dataType.simpleString()}, channel string, height int, width int, data array<double>")


def gaussian(tiles: DataFrame, sigma: float | None) -> DataFrame:
    return map_tiles(tiles, lambda a: kernels.gaussian(a, sigma), stacked=True)


def tubeness(tiles: DataFrame, sigma_max: int = 3) -> DataFrame:
    return map_tiles(tiles, lambda a: kernels.tubeness(a, sigma_max), stacked=True)


def hysteresis(tiles: DataFrame, alpha: float = 1.0) -> DataFrame:
    return map_tiles(tiles, lambda a: kernels.hysteresis(a, alpha))


def nl_means(tiles: DataFrame, patch: int = 5, distance: int = 35) -> DataFrame:
    return map_tiles(tiles, lambda a: kernels.nl_means(a, patch, distance), stacked=True, spread=True)


def median_filter(tiles: DataFrame, size: int = 3, times: int = 1) -> DataFrame:
    def run(a: np.ndarray) -> np.ndarray:
        for _ in range(times):
            a = kernels.square_median(a, size)
        return a

    return map_tiles(tiles, run, stacked=True)


def equalise_adaptive(tiles: DataFrame, limit: float = 0.01) -> DataFrame:
    return map_tiles(tiles, lambda a: kernels.equalise_adaptive(a, limit=limit), stacked=True)


def rescale(tiles: DataFrame, scale: float) -> DataFrame:
    return map_tiles(tiles, lambda a: kernels.rescale(a, scale))


def resize(tiles: DataFrame, shape: tuple[int, int]) -> DataFrame:
    return map_tiles(tiles, lambda a: kernels.resize(a, shape))


def distance_transform(tiles: DataFrame) -> DataFrame:
    """Distances of pixels above 0 to the nearest that isn't."""
    return map_tiles(tiles, lambda a: kernels.distance_transform(a > 0))


def local_maxima(tiles: DataFrame) -> DataFrame:
    return map_tiles(tiles, kernels.local_maxima)


def label_tiles(tiles: DataFrame, diagonal: bool = True) -> DataFrame:
    """Connected parts of pixels above 0, numbered from 1 in row-major order."""
    return map_tiles(tiles, lambda a: kernels.label(a > 0, diagonal))


def distance_image(tiles: DataFrame, scale: float = 1.25, alpha: float = 1.0, sigma: float = 0.5) -> DataFrame:
    """What fibres are traced on: enlarged, ridge-filtered, thresholded, cleaned, distances, smoothed, frame cleared."""
    return map_tiles(tiles, lambda a: distance_of(a, scale, alpha, sigma))


def distance_of(a: np.ndarray, scale: float, alpha: float, sigma: float) -> np.ndarray:
    big = kernels.rescale(a, scale)
    mask = kernels.drop_small(kernels.hysteresis(kernels.tubeness(big), alpha), int(64 * scale**2))
    if not mask.any():
        return np.zeros(big.shape)
    far = kernels.distance_transform(mask)
    soft = kernels.gaussian(np.where(np.isfinite(far), far, 0.0), sigma)
    soft[[0, -1]] = 0
    soft[:, [0, -1]] = 0
    return soft


def preprocess(tiles: DataFrame, low: float = 1.0, high: float = 99.0, patch: int = 5, distance: int = 35) -> DataFrame:
    """Clip at two percentiles, bring to 0..1, equalise adaptively, denoise: one pass over each tile."""

    def run(a: np.ndarray) -> np.ndarray:
        a = np.clip(a, *np.percentile(a, [low, high]))
        span = a.max() - a.min()
        a = (a - a.min()) / span if span else np.zeros(a.shape)
        return kernels.nl_means(kernels.equalise_adaptive(a), patch, distance)

    return map_tiles(tiles, run)
