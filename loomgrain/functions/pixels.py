"""Per-pixel work on pixel tables (image_id, channel, y, x, v): ranges, norms, derivatives and tensors.

Everything is keyed by image; a table dealt by image_id needs no further shuffle for the steps keyed by image and channel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE = ("image_id", "channel")


def pixels_of(tiles: DataFrame) -> DataFrame:
    """(image_id, channel, y, x, v) from tiles (image_id, channel, height, width, data), row-major."""
    out = tiles.select("image_id", "channel", "width", F.posexplode("data").alias("i", "v"))
    return out.select("image_id", "channel", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def tiles_of(pixels: DataFrame) -> DataFrame:
    """(image_id, channel, height, width, data): one row an image; missing pixels are an error of the caller."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"])
    return pixels.groupBy(*IMAGE).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), ordered.alias("data"))


def clip_intensities(pixels: DataFrame, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Values clamped to two percentiles (linear interpolation) of their image and channel. Null values stay null."""
    bounds = pixels.groupBy(*IMAGE).agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100))).alias("__p"))
    out = pixels.join(bounds, list(IMAGE))
    v = F.when(F.col("v").isNotNull(), F.least(F.greatest("v", F.col("__p")[0]), F.col("__p")[1]))
    return out.withColumn("v", v).select(*pixels.columns)


def clip_intensities_sketched(pixels: DataFrame, low: float = 1.0, high: float = 99.0, size: int = 2000) -> DataFrame:
    """clip_intensities() for images beyond a task: percentiles from mergeable quantile sketches of fixed size.

    Tasks sketch what they hold of an image and only the sketches meet, so no image is gathered. The bounds are values of
    the image whose rank is within about 2.3 / size ** 0.9 of the one asked for (0.25 % at 2000; size is 8 to 65535), and
    exact for images of up to `size` pixels but for interpolation. Null values stay null; an image of nulls alone too.
    """
    bounds = pixels.groupBy(*IMAGE).agg(F.kll_sketch_agg_double("v", F.lit(size)).alias("__k"))
    rank = lambda p: F.kll_sketch_get_quantile_double("__k", F.lit(p / 100))
    some = pixels.groupBy(*IMAGE).agg(F.count("v").alias("__n"))
    bounds = bounds.join(some, list(IMAGE)).filter("__n > 0").select(*IMAGE, rank(low).alias("__lo"), rank(high).alias("__hi"))
    out = pixels.join(bounds, list(IMAGE), "left")
    return out.withColumn("v", F.when(F.col("v").isNotNull(), F.least(F.greatest("v", F.col("__lo")), F.col("__hi")))).select(*pixels.columns)


def rescale(pixels: DataFrame) -> DataFrame:
    """Values brought to 0..1 of their image and channel, or -1..1 where any is negative; a constant image becomes 0."""
    w = Window.partitionBy(*IMAGE)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    unit = F.coalesce((F.col("v") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))
    return pixels.withColumn("v", F.when(lo < 0, unit * 2 - 1).otherwise(unit))


def normalise_stack(pixels: DataFrame) -> DataFrame:
    """Each pixel's channel vector divided by its length; zero vectors stay."""
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("image_id", "y", "x")))
    return pixels.withColumn("v", F.when(norm != 0, F.col("v") / norm).otherwise(F.col("v")))


def unit_vector(a: Column) -> Column:
    """An array divided by its Euclidean length; a zero array stays."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(a, lambda x: F.when(norm != 0, x / norm).otherwise(x))


def composite(pixels: DataFrame, third: DataFrame | None = None) -> DataFrame:
    """(image_id, y, x, red, green, blue) from channels 0, 1, 2: the first, the root of the product of the other two, the third.

    third: (image_id, y, x, v) to stand for the third, such as its equalised form.
    """
    wide = pixels.groupBy("image_id", "y", "x").pivot("channel", ["0", "1", "2"]).agg(F.first("v"))
    rgb = wide.select("image_id", "y", "x", F.col("0").alias("red"), F.sqrt(F.greatest(F.col("1") * F.col("2"), F.lit(0.0))).alias("green"), F.col("2").alias("blue"))
    if third is None:
        return rgb
    return rgb.drop("blue").join(third.select("image_id", "y", "x", F.col("v").alias("blue")), ["image_id", "y", "x"], "left")


#: Luma weights of red, green and blue.
LUMA = (0.2125, 0.7154, 0.0721)


def greyscale(rgb: DataFrame) -> DataFrame:
    """(image_id, y, x, grey): luma over the image's largest."""
    luma = LUMA[0] * F.col("red") + LUMA[1] * F.col("green") + LUMA[2] * F.col("blue")
    out = rgb.select("image_id", "y", "x", luma.alias("l"))
    top = F.max("l").over(Window.partitionBy("image_id"))
    return out.select("image_id", "y", "x", (F.col("l") / F.nullif(top, F.lit(0.0))).alias("grey"))


def clear_border(pixels: DataFrame, thickness: int = 1) -> DataFrame:
    """Pixels of the outer frame set to 0."""
    w = Window.partitionBy(*IMAGE)
    inside = (F.col("y") >= thickness) & (F.col("x") >= thickness) & (F.col("y") <= F.max("y").over(w) - thickness) & (F.col("x") <= F.max("x").over(w) - thickness)
    return pixels.withColumn("v", F.when(inside, F.col("v")).otherwise(F.lit(0.0)))


def block_of(at: Column, length: Column, parts: int) -> Column:
    """Which of `parts` near-equal runs a place falls in; the first length % parts runs are one longer."""
    size, extra = F.floor(length / parts), length % parts
    edge = extra * (size + 1)
    return F.when(at < edge, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - edge) / F.greatest(size, F.lit(1)))).cast("int")


def split_tiles(pixels: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """pixels plus tile_id: rows are cut into ncols parts and columns into nrows, tiles counted along columns first."""
    w = Window.partitionBy(*IMAGE)
    height, width = F.max("y").over(w) + 1, F.max("x").over(w) + 1
    out = pixels.withColumn("__r", block_of(F.col("y"), height, ncols)).withColumn("__c", block_of(F.col("x"), width, nrows))
    return out.withColumn("tile_id", (F.col("__r") * nrows + F.col("__c")).cast("int")).drop("__r", "__c")


def ring_mask(pixels: DataFrame, cy: int, cx: int, sizes: tuple[int, ...]) -> DataFrame:
    """Pixels on square rings of the given half-widths around a centre; what falls outside the image isn't there."""
    return pixels.filter(F.greatest(F.abs(F.col("y") - cy), F.abs(F.col("x") - cx)).isin(list(sizes)))


def label_set(labels: DataFrame, background: int = 0, col: str = "label") -> DataFrame:
    return labels.filter(F.col(col) != background).select(col).distinct()


def spherical(c0: Column, c1: Column, c2: Column) -> tuple[Column, Column, Column]:
    """Angles of a unit vector: asin, asin and acos of its parts, clamped to [-1, 1]."""
    clamp = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))
    return F.asin(clamp(c0)), F.asin(clamp(c1)), F.acos(clamp(c2))


def equalise(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """Values mapped through their image's cumulative histogram, linear between bin centres; constant images become 1.

    The histogram becomes one array an image (of `bins` numbers); a pixel looks up its own bin and the one beside it.
    """
    w = Window.partitionBy(*IMAGE)
    p = pixels.withColumns({"__lo": F.min("v").over(w), "__step": (F.max("v").over(w) - F.min("v").over(w)) / bins})
    place = F.when(F.col("__step") > 0, F.least(F.floor((F.col("v") - F.col("__lo")) / F.col("__step")), F.lit(bins - 1))).otherwise(F.lit(0))
    p = p.withColumn("__bin", place.cast("int"))
    hist = p.groupBy(*IMAGE, "__bin").agg(F.count("*").alias("__n"))
    at = hist.groupBy(*IMAGE).agg(F.map_from_entries(F.collect_list(F.struct("__bin", "__n"))).alias("__m"), F.sum("__n").alias("__t"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("__m", b), F.lit(0)))
    grown = F.aggregate(counts, F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    cdf = at.select(*IMAGE, F.transform(grown, lambda n: n / F.col("__t")).alias("__cdf"))
    p = p.join(cdf, list(IMAGE))
    centre = F.col("__lo") + (F.col("__bin") + 0.5) * F.col("__step")
    side = F.greatest(F.least(F.col("__bin") + F.when(F.col("v") < centre, -1).otherwise(1), F.lit(bins - 1)), F.lit(0))
    own, beside = F.get("__cdf", F.col("__bin")), F.get("__cdf", side)
    far = F.abs(F.col("v") - centre) / F.nullif(F.col("__step"), F.lit(0.0))
    v = F.when((side == F.col("__bin")) | far.isNull(), F.when(far.isNull(), F.lit(1.0)).otherwise(own)).otherwise(own + (beside - own) * far)
    return p.select(*[v.alias("v") if c == "v" else F.col(c) for c in pixels.columns])


# ---------------------------------------------------------------- derivatives and tensors


def gradient(df: DataFrame, col: str, along: str, out: str, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """df plus a numpy-style derivative of col along y or x: central inside, one-sided at the edges, 0 where undefined."""
    other = "x" if along == "y" else "y"
    w = Window.partitionBy(*keys, other).orderBy(along)
    before, after = F.lag(col).over(w), F.lead(col).over(w)
    d = F.when(before.isNull(), after - F.col(col)).when(after.isNull(), F.col(col) - before).otherwise((after - before) / 2)
    return df.withColumn(out, F.coalesce(F.nanvl(d, F.lit(0.0)), F.lit(0.0)))


def derivatives(pixels: DataFrame, rank: int = 1) -> DataFrame:
    """pixels plus dy, dx; with rank 2 also dyy, dydx (along y of dx), dxdy (along x of dy) and dxx."""
    out = gradient(gradient(pixels, "v", "y", "dy"), "v", "x", "dx")
    if rank == 2:
        for col, along, name in (("dy", "y", "dyy"), ("dx", "y", "dydx"), ("dy", "x", "dxdy"), ("dx", "x", "dxx")):
            out = gradient(out, col, along, name)
    return out


def blurred(df: DataFrame, cols: tuple[str, ...], sigma: float, mirrored: bool = True) -> DataFrame:
    """df with Gaussian-blurred columns (kernel cut at four deviations), image by image, along rows and then columns.

    Beyond the border values are mirrored, or else 0. Each row or column becomes one array from which its pixels look up
    what they need, so nothing is multiplied by the kernel's size. A deviation whose kernel is one pixel changes nothing.
    """
    reach = int(4 * sigma + 0.5)
    if reach == 0:
        return df
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = [w / sum(raw) for w in raw]
    for along, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*IMAGE, other).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumns({f"__a_{c}": F.collect_list(c).over(w) for c in cols})
        n = F.size(f"__a_{cols[0]}")
        new = {}
        for c in cols:
            total = F.lit(0.0)
            for k, weight in zip(range(-reach, reach + 1), weights, strict=True):
                at = F.col(along) + k
                if mirrored:
                    turn = F.pmod(at, 2 * n)
                    at = F.when(turn < n, turn).otherwise(2 * n - 1 - turn)
                    value = F.get(f"__a_{c}", at.cast("int"))
                else:
                    value = F.when((at >= 0) & (at < n), F.get(f"__a_{c}", at.cast("int"))).otherwise(F.lit(0.0))
                total = total + weight * value
            new[c] = total
        df = df.withColumns(new).drop(*[f"__a_{c}" for c in cols])
    return df


def nematic_tensor(pixels: DataFrame, sigma: float = 0.0001) -> DataFrame:
    """(image_id, channel, y, x, jxx, jxy, jyy): outer product of the unit gradient, turned by a right angle; 0 where flat; blurred."""
    d = derivatives(pixels)
    r2 = F.nullif(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"), F.lit(0.0))
    part = lambda e: F.coalesce(e / r2, F.lit(0.0))
    n = d.select(*IMAGE, "y", "x", part(F.col("dx") * F.col("dx")).alias("jxx"), part(-F.col("dy") * F.col("dx")).alias("jxy"), part(F.col("dy") * F.col("dy")).alias("jyy"))
    return blurred(n, ("jxx", "jxy", "jyy"), sigma)


def structure_tensor(pixels: DataFrame, sigma: float = 0.0001) -> DataFrame:
    """(image_id, channel, y, x, jxx, jxy, jyy) of Sobel derivatives, blurred, pixels beyond the border counting 0.

    Neighbours come by windows along rows and columns, so nothing is multiplied by a kernel's size.
    """
    row = Window.partitionBy(*IMAGE, "y").orderBy("x")
    col = Window.partitionBy(*IMAGE, "x").orderBy("y")
    z = F.lit(0.0)
    lag = lambda c, w: F.coalesce(F.lag(c).over(w), z)
    lead = lambda c, w: F.coalesce(F.lead(c).over(w), z)
    d = pixels.withColumns({"__dx": lead("v", row) - lag("v", row), "__sx": lag("v", row) + 2 * F.col("v") + lead("v", row)})
    d = d.withColumns({"__ix": (lag("__dx", col) + 2 * F.col("__dx") + lead("__dx", col)) / 4, "__iy": (lead("__sx", col) - lag("__sx", col)) / 4})
    j = d.select(*IMAGE, "y", "x", (F.col("__ix") * F.col("__ix")).alias("jxx"), (F.col("__ix") * F.col("__iy")).alias("jxy"), (F.col("__iy") * F.col("__iy")).alias("jyy"))
    return blurred(j, ("jxx", "jxy", "jyy"), sigma, mirrored=False)


def tensor_analysis(tensors: DataFrame) -> DataFrame:
    """tensors plus coherence, angle (degrees) and energy, from the closed form for 2 x 2 symmetric matrices."""
    split = F.sqrt((F.col("jxx") - F.col("jyy")) * (F.col("jxx") - F.col("jyy")) + 4 * F.col("jxy") * F.col("jxy"))
    whole = F.nullif(F.col("jxx") + F.col("jyy"), F.lit(0.0))
    ratio = F.coalesce(split / whole, F.lit(0.0))
    return tensors.withColumns(
        {
            "coherence": ratio * ratio,
            "angle": F.atan2(2 * F.col("jxy"), F.col("jyy") - F.col("jxx")) * (90 / math.pi),
            "energy": F.abs("jxx") + F.abs("jyy"),
        }
    )


def tensor_colour(tensors: DataFrame, pixels: DataFrame) -> DataFrame:
    """(image_id, channel, y, x, hue, saturation, brightness): angle, coherence and value, each over its range in the image."""
    t = tensor_analysis(tensors).join(pixels, [*IMAGE, "y", "x"])
    w = Window.partitionBy(*IMAGE)
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(w), F.lit(0.0)), F.lit(0.0))
    return t.select(*IMAGE, "y", "x", ((F.col("angle") + 90) / 180).alias("hue"), share("coherence").alias("saturation"), share("v").alias("brightness"))
