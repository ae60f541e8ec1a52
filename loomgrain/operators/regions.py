"""Regions of labelled pixels: shape, texture, orientation, and which of them count."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import kernels
from loomgrain.functions.pixels import tensor_analysis
from loomgrain.functions.stats import angle_sdi, entropy_of
from loomgrain.operators.components import columns, dense, label_images
from loomgrain.operators.masks import CROSS, shifted

REGION = ("image_id", "region_id")


def region_shape(pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, area, bbox, extent, eccentricity, circularity, perimeter) of region pixels (…, y, x).

    Circularity is pi times the diameter of the circle of equal area over the perimeter; it is null for a perimeter of 0.
    The eccentricity is that of the ellipse with the second moments of the pixels' places; 0 for a single pixel.
    """
    p = pixels.select(*REGION, "y", "x").distinct()
    a = p.groupBy(*REGION).agg(
        F.count("*").alias("area"),
        F.min("y").alias("min_y"),
        F.min("x").alias("min_x"),
        (F.max("y") + 1).alias("max_y"),
        (F.max("x") + 1).alias("max_x"),
        F.var_pop("y").alias("vy"),
        F.var_pop("x").alias("vx"),
        F.covar_pop("y", "x").alias("c"),
    )
    half = F.sqrt((F.col("vy") - F.col("vx")) * (F.col("vy") - F.col("vx")) / 4 + F.col("c") * F.col("c"))
    mid = (F.col("vy") + F.col("vx")) / 2
    a = a.withColumn("extent", F.col("area") / ((F.col("max_y") - F.col("min_y")) * (F.col("max_x") - F.col("min_x"))))
    a = a.withColumn("eccentricity", F.coalesce(F.sqrt(F.greatest(1 - (mid - half) / F.nullif(mid + half, F.lit(0.0)), F.lit(0.0))), F.lit(0.0)))
    a = a.join(perimeter(p), list(REGION), "left")
    round_ = math.pi * F.sqrt(4 * F.col("area") / math.pi) / F.nullif(F.col("perimeter"), F.lit(0.0))
    return a.withColumn("circularity", round_).drop("vy", "vx", "c")


def perimeter(p: DataFrame) -> DataFrame:
    """(image_id, region_id, perimeter): border pixels weighted by how their border neighbours lie."""
    keys = [*REGION, "y", "x"]
    inner = shifted(p, CROSS).groupBy(*keys).agg(F.count("*").alias("n")).filter("n = 5").select(*keys)
    border = p.join(inner, keys, "left_anti")
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 if dy == dx == 0 else 2 if dy * dx == 0 else 10).alias("w")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    said = border.withColumn("o", near).select(*REGION, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.w").alias("w"))
    code = said.join(border, keys, "left_semi").groupBy(*keys).agg(F.sum("w").alias("code"))
    # fixed values: codes of straight, diagonal and mixed steps
    step = F.when(F.col("code").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("code").isin(21, 33), math.sqrt(2)).when(F.col("code").isin(13, 23), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return code.groupBy(*REGION).agg(F.sum(step).alias("perimeter"))


def region_texture(pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, mean, std, entropy) of region pixels with a value v."""
    base = pixels.groupBy(*REGION).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return base.join(entropy_of(pixels, REGION), list(REGION))


def structure_metrics(tensors: DataFrame, value: str = "energy") -> DataFrame:
    """(image_id, region_id, angle_sdi, coherence, local_coherence) of region pixels with jxx, jxy, jyy.

    Coherence is that of the mean tensor, local coherence the mean of the pixels', the spread that of the `value` map
    weighted by coherence.
    """
    t = tensor_analysis(tensors)
    means = t.groupBy(*REGION).agg(F.avg("jxx").alias("jxx"), F.avg("jxy").alias("jxy"), F.avg("jyy").alias("jyy"), F.avg("coherence").alias("local_coherence"))
    whole = tensor_analysis(means).select(*REGION, "coherence", "local_coherence")
    return whole.join(angle_sdi(t, REGION, value, "coherence", name="angle_sdi"), list(REGION), "left")


def passing(regions: DataFrame, min_size: int = 0, min_frac: float | None = None, frame: tuple[int, int] | None = None, total: str = "total") -> DataFrame:
    """Regions with filled_area of at least min_size and, if asked for, total / filled_area of at least min_frac.

    With frame (height, width) those whose bounding box touches the frame go too. A null total fails min_frac.
    """
    out = regions.filter(F.col("filled_area") >= min_size)
    if min_frac is not None:
        out = out.filter(F.col(total) / F.col("filled_area") >= min_frac)
    if frame is not None:
        out = out.filter((F.col("min_y") > 0) & (F.col("min_x") > 0) & (F.col("max_y") < frame[0]) & (F.col("max_x") < frame[1]))
    return out


MEASURED = "region_id int, area long, filled_area long, min_y int, min_x int, max_y int, max_x int"


def measured(mask: DataFrame, width: int, values: DataFrame | None = None, by_pixel: bool = False) -> DataFrame:
    """A mask's 8-connected parts, measured in one task an image after one shuffle by image.

    (image_id, region_id, area, filled_area, bounding box, total_<name> of every further column of values (image_id, y, x,
    ...)); filled_area counts what the region encloses; totals are null without a value. by_pixel gives that row for each
    pixel, with y and x. Repeated pixels count once, an empty mask gives no rows.
    """
    m = mask.select("image_id", "y", "x").distinct()
    names = [] if values is None else [c for c in values.columns if c not in ("image_id", "y", "x")]
    if names:
        m = m.join(values, ["image_id", "y", "x"], "left")
    m = m.select("image_id", F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(c).cast("double") for c in names]).alias("p"))
    kind = mask.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, {MEASURED}" + "".join(f", `total_{c}` double" for c in names) + (", y int, x int" if by_pixel else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                took, rows, ys, xs = [], [], [], []
                for k, pixels in enumerate(b.column(1)):
                    y, x, *v, _ = columns(pixels)
                    for own, row in _measures(y, x, v, width):
                        n = len(own) if by_pixel else 1
                        took += [k] * n
                        rows += [row] * n
                        ys.append(y[own])
                        xs.append(x[own])
                made = list(zip(*rows, strict=True)) if rows else [()] * (7 + len(names))
                out = [b.column(0).take(pa.array(took, pa.int64()))] + [pa.array(c, t) for c, t in zip(made, [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.float64()] * len(names)], strict=True)]
                if by_pixel:
                    out += [pa.array(np.concatenate(c) if c else [], pa.int32()) for c in (ys, xs)]
                yield pa.RecordBatch.from_arrays(out, names=["image_id", "region_id", "area", "filled_area", "min_y", "min_x", "max_y", "max_x", *(f"total_{c}" for c in names), *(("y", "x") if by_pixel else ())])

    return m.groupBy("image_id").agg(F.collect_list("p").alias("pixels")).mapInArrow(run, schema)  # one image's pixels


def _measures(y: np.ndarray, x: np.ndarray, values: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, tuple]]:
    """measured() of one image: for each part which of the pixels it has, and its row."""
    m, y0, x0 = dense(y, x)
    at = kernels.label(m)[y - y0, x - x0]
    order = np.argsort(at, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        py, px_ = y[own], x[own]
        totals = [None if np.isnan(v[own]).all() else float(np.nansum(v[own])) for v in values]
        box = int(py.min()), int(px_.min()), int(py.max()) + 1, int(px_.max()) + 1
        first = int((py.astype(np.int64) * width + px_)[np.lexsort((px_, py))[0]])
        # what encloses a pixel has at least eight pixels
        filled = kernels.filled_area(py, px_) if len(own) >= 8 else len(own)
        yield own, (first, len(own), filled, *box, *totals)


def regions(mask: DataFrame, height: int, width: int, pixels: DataFrame | None = None, min_size: int = 0, min_frac: float | None = None) -> DataFrame:
    """(image_id, region_id, area, filled_area, total, rank) of a mask's 8-connected parts that pass, largest first.

    total is the sum of the pixel values on the region (null without pixels); see measured().
    """
    per = measured(mask, width, pixels.select("image_id", "y", "x", "v") if pixels is not None else None)
    total = F.col("total_v") if pixels is not None else F.lit(None).cast("double")
    out = passing(per.withColumn("total", total), min_size, min_frac if pixels is not None else None)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("filled_area"), "region_id"))
    return out.select("image_id", "region_id", "area", "filled_area", "total", rank.alias("rank"))


def to_segments(mask: DataFrame, tag: str, height: int, width: int, pixels: DataFrame | None = None, min_size: int = 0, min_frac: float | None = None) -> DataFrame:
    return regions(mask, height, width, pixels, min_size, min_frac).withColumn("tag", F.lit(tag))


def segment_pixels(mask: DataFrame, tag: str, width: int, pixels: DataFrame, min_size: int = 0, min_frac: float | None = None) -> DataFrame:
    """(image_id, tag, region_id, y, x): the pixels of a mask's 8-connected parts that pass; see measured() and passing()."""
    per = measured(mask, width, pixels.select("image_id", "y", "x", "v"), by_pixel=True)
    return passing(per.withColumn("total", F.col("total_v")), min_size, min_frac).select("image_id", F.lit(tag).alias("tag"), "region_id", "y", "x")


def bbox_sample(boxes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels inside the half-open bounding box of each region (image_id, region_id, min_y, min_x, max_y, max_x).

    Boxes are dealt to the rows they cover, so a pixel meets only the boxes of its own row.
    """
    b = boxes.select(*REGION, "min_x", "max_x", F.explode(F.sequence(F.col("min_y"), F.col("max_y") - 1)).alias("y"))
    met = pixels.join(b, ["image_id", "y"]).filter("x >= min_x and x < max_x")
    return met.select(*REGION, "y", "x", "v")


def region_swap(masks: DataFrame, values: DataFrame, width: int, sizes: tuple[int, int], fracs: tuple[float, float]) -> DataFrame:
    """(image_id, mask_id, y, x) of masks 0 and 1 after failing regions of either join the other where they pass there.

    Regions of mask 0 are tried first; then those of what mask 1 has become. A region stays if it has at least its mask's
    size and mean; else it leaves, and joins the other mask if its mean in the other image is enough, whatever its size.
    values: (image_id, mask_id, y, x, v); of a pixel's several values the largest counts, and a region without any has no
    mean and leaves. Both rounds of an image are one pass after one shuffle; an image must fit a task.
    """
    kind = masks.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, out = [], []
                for k, pixels in enumerate(b.column(1)):
                    mask, y, x, v, _ = columns(pixels)
                    y0, x0 = y.min(), x.min()
                    on = np.zeros((2, y.max() - y0 + 1, x.max() - x0 + 1), bool)
                    light = np.full(on.shape, -np.inf)
                    own = np.isnan(v)
                    on[mask[own], y[own] - y0, x[own] - x0] = True
                    np.maximum.at(light, (mask[~own], y[~own] - y0, x[~own] - x0), v[~own])
                    swap_masks(on, light, sizes, fracs)
                    m, y, x = np.nonzero(on)
                    rows.append(np.full(len(y), k))
                    out.append((m, y + y0, x + x0))
                took = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
                flat = [pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int32())] * 3
                yield pa.RecordBatch.from_arrays([b.column(0).take(took), *flat], names=["image_id", "mask_id", "y", "x"])

    place = [F.col(c).cast("int").alias(c) for c in ("mask_id", "y", "x")]
    number = F.when(~F.isnan("v"), F.col("v"))
    both = masks.filter("mask_id in (0, 1)").select("image_id", *place, F.lit(float("nan")).alias("v")).union(values.filter("mask_id in (0, 1)").select("image_id", *place, number.cast("double").alias("v")).filter("v is not null"))
    per = both.groupBy("image_id").agg(F.collect_list(F.struct("mask_id", "y", "x", "v")).alias("pixels"))  # one image's
    return per.mapInArrow(run, f"image_id {kind}, mask_id int, y int, x int")


def swap_masks(on: np.ndarray, light: np.ndarray, sizes: tuple[int, int], fracs: tuple[float, float]) -> None:
    """region_swap() of one image in place; on and light hold both masks and both images, -inf where there is no value."""
    for a, b in ((0, 1), (1, 0)):
        parts = kernels.label(on[a])
        ys, xs = np.nonzero(parts)
        n = parts[ys, xs]
        order = np.argsort(n, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
            y, x = ys[own], xs[own]
            area = kernels.filled_area(y, x)
            mean = {}
            for side in (a, b):
                v = light[side, y, x]
                v = v[np.isfinite(v)]
                mean[side] = v.sum() / area if len(v) else -np.inf
            if area < sizes[a] or mean[a] < fracs[a]:
                on[a, y, x] = False
                if mean[b] >= fracs[b]:
                    on[b, y, x] = True


# ---------------------------------------------------------------- co-occurrence


#: Four directions, (dy, dx) at distance 1.
DIRECTIONS = ((0, 1), (1, 1), (1, 0), (1, -1))


def glcm(pixels: DataFrame, distances: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(image_id, region_id, distance, direction, i, j, p): symmetric shares of grey-level pairs of region pixels (…, v).

    Values of 0..1 become 8-bit levels. Level 0 is dropped after shares are formed, so they needn't sum to 1.
    """
    g = pixels.select(*REGION, "y", "x", F.floor(F.col("v") * 255.99999).cast("int").alias("i"))
    steps = []
    for d in distances:
        for k, (dy, dx) in enumerate(DIRECTIONS):
            r = round(d / math.sqrt(2)) if dy and dx else d
            steps.append(F.struct(F.lit(d).alias("distance"), F.lit(k).alias("direction"), F.lit(dy * r).alias("dy"), F.lit(dx * r).alias("dx")))
    a = g.withColumn("s", F.explode(F.array(*steps)))
    a = a.select(*REGION, F.col("s.distance").alias("distance"), F.col("s.direction").alias("direction"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "i")
    met = a.join(g.withColumnRenamed("i", "j"), [*REGION, "y", "x"])
    keys = [*REGION, "distance", "direction"]
    n = met.select(*keys, "i", "j").union(met.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))).groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return n.withColumn("p", p).filter("i > 0 and j > 0").select(*keys, "i", "j", "p")


def glcm_props(pairs: DataFrame) -> DataFrame:
    """One row a region: each property of its co-occurrence tables, averaged over them. The mean is sum(i * p * p)."""
    keys = [*REGION, "distance", "direction"]
    i, j, p = F.col("i").cast("double"), F.col("j").cast("double"), F.col("p")
    first = pairs.groupBy(*keys).agg(F.sum(i * p * p).alias("mean"))
    d = pairs.join(first, keys)
    di, dj = i - F.col("mean"), j - F.col("mean")
    far = F.abs(i - j)
    each = d.groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        F.sum(p * p).alias("asm"),
        (0.0 - F.sum(p * F.log(p))).alias("entropy"),
        F.sum(p * far * far).alias("contrast"),
        F.sum(p * far).alias("dissimilarity"),
        F.sum(p / (1 + far * far)).alias("homogeneity"),
        F.sum(p / (1 + far)).alias("similarity"),
        F.sum(p * i * j).alias("autocorrelation"),
        F.sum(p * di * dj).alias("covariance"),
        F.sum(p * di * di).alias("__var"),
        F.sum(2 * p * F.col("mean")).alias("clustering"),
    )
    each = each.withColumn("energy", F.sqrt("asm")).withColumn("correlation", F.when(F.col("__var") < 1e-30, F.lit(1.0)).otherwise(F.col("covariance") / F.nullif(F.col("__var"), F.lit(0.0))))
    names = ["asm", "energy", "entropy", "contrast", "dissimilarity", "homogeneity", "similarity", "autocorrelation", "mean", "covariance", "clustering", "correlation"]
    return each.groupBy(*REGION).agg(*[F.avg(n).alias(n) for n in names])
