"""Colour clusters of pixels and which of them are cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import kernels
from loomgrain.functions.pixels import LUMA, composite, normalise_stack, pixels_of, spherical, tiles_of, unit_vector
from loomgrain.operators import stencils
from loomgrain.operators.components import columns

#: Largest asin, asin, acos and intensity of a cellular cluster.
BOUNDARY = (0.65, 1.1, 1.40, 0.92)


def id_type(df: DataFrame) -> str:
    """The type that an image's id has in df."""
    return df.schema["image_id"].dataType.simpleString()


def lloyd(v: np.ndarray, k: int, seed: int, rounds: int = 100, sample: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) of a seeded k-means: spread-out first centres from a sample, then means until nothing moves."""
    rng = np.random.default_rng(seed)
    pool = v[rng.choice(len(v), min(sample, len(v)), replace=False)]
    c = [pool[rng.integers(len(pool))]]
    for _ in range(min(k, len(pool)) - 1):
        d = np.min([((pool - x) ** 2).sum(1) for x in c], axis=0)
        c.append(pool[rng.choice(len(pool), p=d / d.sum())] if d.sum() else pool[rng.integers(len(pool))])
    c = np.array(c)
    labels = np.zeros(len(v), int)
    for _ in range(rounds):
        new = ((v**2).sum(1)[:, None] - 2 * v @ c.T + (c**2).sum(1)[None]).argmin(1)
        moved = np.array([v[new == j].mean(0) if (new == j).any() else c[j] for j in range(len(c))])
        if (new == labels).all() and np.allclose(moved, c):
            break
        labels, c = new, moved
    return labels, c


def lloyds(v: np.ndarray, k: int, seed: int, rounds: int = 100, sample: int = 10_000) -> tuple[np.ndarray, list[np.ndarray]]:
    """lloyd() of each of a stack (images, pixels, 3), bit by bit: they draw the same numbers and move together."""
    m, n = v.shape[:2]
    rng = np.random.default_rng(seed)
    pool = v[:, rng.choice(n, min(sample, n), replace=False)]
    c = [pool[:, rng.integers(pool.shape[1])]]
    apart = np.ones(m, bool)  # lloyd() draws otherwise where all of a pool is at the centres
    for _ in range(min(k, pool.shape[1]) - 1):
        d = np.min([((pool - x[:, None]) ** 2).sum(-1) for x in c], axis=0)
        total = d.sum(-1, keepdims=True)
        apart &= np.isfinite(total[:, 0]) & (total[:, 0] > 0)
        upto = np.where(apart[:, None], d / np.where(apart[:, None], total, 1), 1.0).cumsum(-1)
        upto /= upto[:, -1:]
        c.append(pool[np.arange(m), np.minimum((upto <= rng.random()).sum(-1), pool.shape[1] - 1)])
    c = np.stack(c, axis=1)
    labels = np.zeros((m, n), int)
    own = np.flatnonzero(apart)
    for _ in range(rounds):
        if not len(own):
            break
        some, was, parts = v[own], c[own], c.shape[1]
        new = ((some**2).sum(-1)[:, :, None] - 2 * some @ was.transpose(0, 2, 1) + (was**2).sum(-1)[:, None]).argmin(-1)
        at = (new + np.arange(len(own))[:, None] * parts).ravel()
        size = np.bincount(at, minlength=len(own) * parts).reshape(-1, parts, 1)
        sums = np.stack([np.bincount(at, some[:, :, i].ravel(), len(own) * parts) for i in range(v.shape[2])], axis=-1)
        moved = np.where(size > 0, sums.reshape(was.shape) / np.maximum(size, 1), was)
        going = (new != labels[own]).any(-1) | ~np.isclose(moved, was).all((1, 2))
        own = own[going]
        labels[own], c[own] = new[going], moved[going]
    c = list(c)
    for i in np.flatnonzero(~apart):
        labels[i], c[i] = lloyd(v[i], k, seed, rounds, sample)
    return labels, c


def kmeans_colours(pixels: DataFrame, k: int = 10, runs: int = 2, seed: int = 0) -> DataFrame:
    """(image_id, run, y, x, cluster, centre): each image's pixels (image_id, y, x, red, green, blue) clustered, seeded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], ignore_index=True)
        v = pdf[["red", "green", "blue"]].to_numpy(float)
        out = []
        for r in range(runs):
            labels, c = lloyd(v, k, seed + r)
            out.append(pdf[["image_id", "y", "x"]].assign(run=r, cluster=labels, centre=[c[i].tolist() for i in labels]))
        return pd.concat(out)[["image_id", "run", "y", "x", "cluster", "centre"]]

    src = pixels.select("image_id", F.col("y").cast("int"), F.col("x").cast("int"), "red", "green", "blue")
    return src.groupBy("image_id").applyInPandas(run, f"image_id {id_type(src)}, run int, y int, x int, cluster int, centre array<double>")


def nearest(centres: list[list[float]]) -> Column:
    """(d, i): squared distance to, and number of, the nearest centre of (red, green, blue); ties to the first."""
    far = lambda c: sum(((F.col(x) - F.lit(v)) * (F.col(x) - F.lit(v)) for x, v in zip(COLOURS, c, strict=True)), F.lit(0.0))
    return F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))


COLOURS = ("red", "green", "blue")


def corpus_clusters(pixels: DataFrame, k: int = 10, seed: int = 0, share: float = 0.05, rounds: int = 40, first: int = 2000) -> tuple[DataFrame, list[list[float]]]:
    """(pixels plus cluster int, centres): one mini-batch k-means for the whole corpus of (image_id, y, x, red, green, blue).

    The hash of (seed, image_id, y, x) deals pixels to batches of about `share` of them and names the `first` pixels of
    which the first centres are drawn, spread out; so the draw is the same however the table is dealt. Each round assigns
    one batch and moves each centre to the mean of all that it was ever given. Sums are decimal, and so the same in any
    order. Only centres and sums are on the driver. Null colours are left out of the fit and get a null cluster, fewer
    distinct pixels than k give fewer centres, an empty table none.
    """
    h = F.xxhash64(F.lit(seed), "image_id", "y", "x")
    whole = F.col("red").isNotNull() & F.col("green").isNotNull() & F.col("blue").isNotNull()
    numbers = pixels.filter(whole).select(*[F.col(c).cast("double").alias(c) for c in COLOURS], h.alias("h"))
    pool = np.array([tuple(r) for r in numbers.orderBy("h", *COLOURS).limit(first).select(*COLOURS).collect()], float).reshape(-1, 3)
    if not len(pool):
        return pixels.withColumn("cluster", F.lit(None).cast("int")), []
    rng = np.random.default_rng(seed)
    centres = [pool[0]]
    while len(centres) < k:
        far = np.min([((pool - c) ** 2).sum(1) for c in centres], axis=0)
        if not far.sum():
            break
        centres.append(pool[rng.choice(len(pool), p=far / far.sum())])
    centres, given = [c.tolist() for c in centres], [0] * len(centres)
    batches = max(1, round(1 / share))
    for r in range(rounds):
        batch = numbers.filter(F.pmod("h", F.lit(batches)) == r % batches).withColumn("near", nearest(centres))
        sums = batch.groupBy(F.col("near.i").alias("i")).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("decimal(30,12)")).alias(c) for c in COLOURS]).collect()
        for s in sums:  # at most k rows
            given[s.i] += s.n
            centres[s.i] = [c + (float(s[name]) - s.n * c) / given[s.i] for c, name in zip(centres[s.i], COLOURS, strict=True)]
    return pixels.withColumn("cluster", F.when(whole, nearest(centres)["i"])), centres


def cluster_intensity(labels: DataFrame, grey: DataFrame) -> DataFrame:
    """(image_id, run, cluster, intensity): mean of the non-zero greys of each cluster; null if all are zero."""
    g = labels.join(grey.select("image_id", "y", "x", "grey"), ["image_id", "y", "x"])
    return g.groupBy("image_id", "run", "cluster").agg((F.sum("grey") / F.nullif(F.count_if(F.col("grey") != 0), F.lit(0))).alias("intensity"))


def classify_clusters(centres: DataFrame, boundary: tuple[float, ...] = BOUNDARY) -> DataFrame:
    """centres (…, centre, intensity) plus angles array<double> and is_cell: no value above its bound."""
    u = centres.withColumn("__u", unit_vector(F.col("centre")))
    angles = F.array(*spherical(F.col("__u")[0], F.col("__u")[1], F.col("__u")[2]), F.col("intensity"))
    u = u.withColumn("angles", angles)
    cell = F.lit(True)
    for i, b in enumerate(boundary):
        cell = cell & F.coalesce(F.col("angles")[i] <= b, F.lit(False))
    return u.withColumn("is_cell", cell).drop("__u")


def separation_cost(classified: DataFrame, boundary: tuple[float, ...] = BOUNDARY) -> DataFrame:
    """(image_id, run, cost): minus the sum of distances of all angles and intensities from their bounds; gaps count 0."""
    far = [F.coalesce(F.nanvl(F.abs(F.col("angles")[i] - b), F.lit(0.0)), F.lit(0.0)) for i, b in enumerate(boundary)]
    return classified.groupBy("image_id", "run").agg((0.0 - F.sum(sum(far[1:], far[0]))).alias("cost"))


def best_run(costs: DataFrame) -> DataFrame:
    """(image_id, run, cost) of the cheapest run of each image, the first on ties."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("cost", "run"))
    return costs.withColumn("__p", place).filter("__p = 1").drop("__p")


def scale_channel(a: np.ndarray) -> np.ndarray:
    """One channel clipped at 2 and 98 %, in 8 bits, mirrored at the edge, equalised and median-filtered twice; also of
    a stack (..., height, width) of images."""
    low, high = np.percentile(a.reshape(*a.shape[:-2], -1), [2, 98], axis=-1)[..., None, None]
    a = np.floor(np.clip(a, low, high) * 255.99999)
    big = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(2, 2)] * 2, mode="symmetric")
    for one in big.reshape(-1, *big.shape[-2:]):
        n, edges = np.histogram(one, 256)
        one[:] = np.interp(one, (edges[:-1] + edges[1:]) / 2, n.cumsum() / n.sum())
    return kernels.square_median(kernels.square_median(big, 3), 3)[..., 2:-2, 2:-2]


def scale_image(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scaled channels, grey over its largest) of one height x width x 3 image, or of each of a stack."""
    scaled = np.stack([scale_channel(rgb[..., c]) for c in range(3)], axis=-1)
    grey = scaled @ np.array(LUMA)
    top = grey.max((-2, -1), keepdims=True)
    return scaled, np.where(top != 0, grey / np.where(top != 0, top, 1), grey)


Classifier = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, float]]


def by_boundary(labels: np.ndarray, centres: np.ndarray, grey: np.ndarray, boundary: tuple[float, ...] = BOUNDARY) -> tuple[np.ndarray, float]:
    """The default classifier: (which clusters are cells, cost)."""
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    u = np.clip(centres / np.where(norm == 0, 1, norm), -1, 1)
    light = np.array([grey[labels == j].sum() / max(1, np.count_nonzero(grey[labels == j])) for j in range(len(centres))])
    v = np.column_stack([np.arcsin(u[:, 0]), np.arcsin(u[:, 1]), np.arccos(u[:, 2]), light])
    return (v <= np.array(boundary)).all(1), float(-np.nansum(np.abs(v - np.array(boundary))))


def scale_images(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, red, green, blue, grey) of images (image_id, y, x, red, green, blue) by scale_image(), image by image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rgb, pdf = _dense(pdf)
        scaled, grey = scale_image(rgb)
        return pdf[["image_id", "y", "x"]].assign(red=scaled[:, :, 0].ravel(), green=scaled[:, :, 1].ravel(), blue=scaled[:, :, 2].ravel(), grey=grey.ravel())

    src = pixels.select("image_id", "y", "x", "red", "green", "blue")
    return src.groupBy("image_id").applyInPandas(run, f"image_id {id_type(src)}, y int, x int, red double, green double, blue double, grey double")


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """One whole image as height x width x 3, and its rows in that order."""
    h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
    pdf = pdf.sort_values(["y", "x"], ignore_index=True)
    return pdf[["red", "green", "blue"]].to_numpy(float).reshape(h, w, 3), pdf


def cell_mask(rgb: np.ndarray, k: int, runs: int, min_object: int, classifier: Classifier, seed: int) -> np.ndarray:
    """Cell pixels of each of a stack (images, height, width, 3): scaled, clustered `runs` times, classified; the cheapest
    run, opened, filled and cleaned."""
    scaled, grey = scale_image(rgb)
    cells, costs = np.zeros(grey.shape, bool), [None] * len(rgb)
    for r in range(runs):
        labels, centres = lloyds(scaled.reshape(len(rgb), -1, 3), k, seed + r)
        for i, c in enumerate(centres):
            own, cost = classifier(labels[i], c, grey[i].ravel())
            if costs[i] is None or cost < costs[i]:
                costs[i], cells[i] = cost, np.asarray(own)[labels[i]].reshape(grey.shape[1:])
    opened = kernels.dilate(kernels.erode(cells, 2), 2)
    return np.stack([kernels.fill_small(kernels.drop_small(kernels.fill_enclosed(m), min_object), min_object) for m in opened])


def _cells(pixels: DataFrame, find: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, y, x, is_cell) of every pixel of whole images (image_id, y, x, red, green, blue).

    find: a stack (images, height, width, 3) of images of one size -> their cell pixels. One shuffle by image, dealt over
    all of the session's partitions, as finding takes far longer than what is sent would tell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                at_size: dict[tuple[int, int], list] = {}
                for i, own in enumerate(b.column(1)):
                    y, x, *rgb, n = columns(own)
                    order = np.lexsort((x, y))
                    h, w = int(y.max()) + 1, int(x.max()) + 1
                    at_size.setdefault((h, w), []).append((i, y[order], x[order], np.stack(rgb, axis=-1)[order].astype(float).reshape(h, w, 3)))
                for (h, w), images in at_size.items():
                    step = max(1, stencils.STACK // (h * w))
                    for k in range(0, len(images), step):
                        took, ys, xs, rgb = zip(*images[k : k + step], strict=True)
                        cell = find(np.stack(rgb))
                        flat = [pa.array(np.concatenate(c), pa.int32()) for c in (ys, xs)]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(took, h * w))), *flat, pa.array(cell.ravel())], names=["image_id", "y", "x", "is_cell"])

    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    colours = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(c).cast("double").alias(c) for c in COLOURS])
    per = pixels.select("image_id", colours.alias("p")).repartition(n, "image_id").groupBy("image_id").agg(F.collect_list("p").alias("pixels"))  # one image's
    return per.mapInArrow(run, f"image_id {id_type(pixels)}, y int, x int, is_cell boolean")


def cell_masks(pixels: DataFrame, k: int = 10, runs: int = 2, min_object: int = 200, classifier: Classifier = by_boundary, seed: int = 0) -> DataFrame:
    """(image_id, y, x): cell pixels of whole images (image_id, y, x, red, green, blue); see cell_mask().

    `classifier` may be any callable (labels, centres, grey) -> (which clusters are cells, cost). Equal seeds give equal
    masks however images are dealt; an image without cells gives no rows.
    """
    return _cells(pixels, lambda rgb: cell_mask(rgb, k, runs, min_object, classifier, seed)).filter("is_cell").drop("is_cell")


def composite_rgb(stacks: DataFrame) -> DataFrame:
    """(image_id, y, x, red, green, blue) of stacks (image_id, channel, y, x, v): the third channel adaptively equalised."""
    third = stencils.equalise_adaptive(tiles_of(stacks.filter("channel = '2'")))
    return composite(stacks, pixels_of(third))


def rgb_segmentation(rgb: DataFrame, scale: float = 1.0, k: int = 10, runs: int = 2, min_object: int = 200, classifier: Classifier = by_boundary, seed: int = 0) -> DataFrame:
    """(image_id, y, x, is_cell) of every pixel of whole images (image_id, y, x, red, green, blue).

    Each pixel's colours are brought to unit length, images enlarged by `scale`, their cell pixels found (cell_mask()), and
    the mask brought back to size: any pixel that a cell touches is cell, all others are fibre.
    """
    channels = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("channel"), F.col(c).alias("v")) for i, c in enumerate(("red", "green", "blue"))]))
    long = rgb.select("image_id", "y", "x", channels.alias("p")).select("image_id", "y", "x", "p.channel", "p.v")
    wide = normalise_stack(long).groupBy("image_id", "y", "x").pivot("channel", ["0", "1", "2"]).agg(F.first("v"))
    src = wide.select("image_id", "y", "x", F.col("0").alias("red"), F.col("1").alias("green"), F.col("2").alias("blue"))

    def find(images: np.ndarray) -> np.ndarray:
        big = images if scale == 1 else np.stack([np.stack([kernels.rescale(i[:, :, c], scale) for c in range(3)], axis=2) for i in images])
        mask = cell_mask(big, k, runs, min_object, classifier, seed)
        return mask if scale == 1 else np.stack([kernels.resize(m.astype(float), images.shape[1:3]) > 0 for m in mask])

    return _cells(src, find)


def map_images(pixels: DataFrame, schema: str, fn: Callable[[pd.DataFrame], Iterator[dict]]) -> DataFrame:
    """A metric or filter of one's own: fn(pixels of an image) -> rows of the schema, image by image."""
    return pixels.groupBy("image_id").applyInPandas(lambda pdf: pd.DataFrame(list(fn(pdf))), schema)
