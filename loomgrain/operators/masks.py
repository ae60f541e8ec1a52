"""Binary masks as rows: a mask pixel is there (image_id, mask_id, y, x) or it isn't.

Neighbour work multiplies rows by a fixed handful of offsets and joins on whole pixels, or packs pixels of a row into
numbers and does so with these; nothing dense is built.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import kernels
from loomgrain.sources.stages import few_at_once

#: A pixel and its four neighbours.
CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def square(radius: int) -> tuple[tuple[int, int], ...]:
    return tuple((dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))


def shifted(mask: DataFrame, offsets: tuple[tuple[int, int], ...]) -> DataFrame:
    """Every pixel at every offset; other columns stay."""
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets]))
    out = mask.withColumn("__o", steps)
    return out.withColumn("y", (F.col("y") + F.col("__o.dy")).cast("int")).withColumn("x", (F.col("x") + F.col("__o.dx")).cast("int")).drop("__o")


def inside(height: Column | int, width: Column | int) -> Column:
    return (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < height) & (F.col("x") < width)


#: Pixels of a row that one number holds, and the furthest that one step reaches.
WORD, STEP = 32, 8


def _words(mask: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, y, w, bits): a mask with WORD pixels of a row, from x = w * WORD on, in one number."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("x"), F.lit(WORD)).cast("int"))
    place = (F.col("y").cast("int").alias("y"), F.floor(F.col("x") / WORD).cast("int").alias("w"))
    return mask.groupBy(*keys, *place).agg(F.bit_or(bit).alias("bits"))


def _within(words: DataFrame, height: Column | int, width: Column | int) -> DataFrame:
    """Words without what lies outside the image."""
    n = F.greatest(F.least(F.lit(width) - F.col("w") * WORD, F.lit(WORD)), F.lit(0)).cast("int")
    bits = F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)
    return words.filter((F.col("w") >= 0) & (F.col("y") >= 0) & (F.col("y") < height)).withColumn("bits", bits).filter("bits != 0")


def _pixels(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    on = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)
    return words.select(*keys, "y", (F.col("w") * WORD).alias("__x"), F.explode(on).alias("__i")).select(*keys, "y", (F.col("__x") + F.col("__i")).cast("int").alias("x"))


def _all(cols: list[Column], how: str) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = getattr(out, how)(c)
    return out


def _cross(times: int) -> dict[int, int]:
    """How far left and right each row (by dy) reaches: `times` steps to the four neighbours."""
    return {dy: times - abs(dy) for dy in range(-times, times + 1)}


def _wider(words: DataFrame, keys: tuple[str, ...], reach: dict[int, int]) -> DataFrame:
    """Words with each pixel's surroundings, reach[dy] pixels left and right in row y + dy."""
    sent, low = [], F.lit((1 << WORD) - 1)
    for dy, r in reach.items():
        # half a word to the left of the word itself, so that up to STEP pixels on either side are held too
        wide = _all([F.shiftleft("bits", WORD // 2 + k) for k in range(-r, r + 1)], "bitwiseOR")
        parts = {0: F.shiftrightunsigned(wide, WORD // 2).bitwiseAND(low)}
        if r:
            parts |= {-1: F.shiftleft(wide.bitwiseAND(F.lit((1 << WORD // 2) - 1)), WORD // 2), 1: F.shiftrightunsigned(wide, WORD // 2 + WORD)}
        sent += [F.struct(F.lit(dy).alias("dy"), F.lit(dw).alias("dw"), bits.cast("long").alias("b")) for dw, bits in parts.items()]
    each = words.select(*keys, "y", "w", F.explode(F.filter(F.array(*sent), lambda p: p["b"] != 0)).alias("__p"))
    return each.groupBy(*keys, (F.col("y") + F.col("__p.dy")).alias("y"), (F.col("w") + F.col("__p.dw")).alias("w")).agg(F.bit_or("__p.b").alias("bits"))


def _narrower(words: DataFrame, keys: tuple[str, ...], reach: dict[int, int]) -> DataFrame:
    """Words with the pixels whose surroundings are all there."""
    places = [(dy, dw) for dy, r in reach.items() for dw in ((-1, 0, 1) if r else (0,))]
    sent = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(-dy).alias("dy"), F.lit(-dw).alias("dw")) for i, (dy, dw) in enumerate(places)]))
    each = words.select(*keys, "y", "w", "bits", sent.alias("__p"))
    met = each.groupBy(*keys, (F.col("y") + F.col("__p.dy")).alias("y"), (F.col("w") + F.col("__p.dw")).alias("w"))
    met = met.agg(*[F.coalesce(F.max(F.when(F.col("__p.i") == i, F.col("bits"))), F.lit(0).cast("long")).alias(f"__b{i}") for i in range(len(places))])
    at = {place: F.col(f"__b{i}") for i, place in enumerate(places)}
    rows = []
    for dy, r in reach.items():
        wide = F.shiftleft(at[dy, 0], WORD // 2)
        if r:
            wide = wide.bitwiseOR(F.shiftrightunsigned(at[dy, -1], WORD // 2)).bitwiseOR(F.shiftleft(at[dy, 1], WORD // 2 + WORD))
        rows += [F.shiftrightunsigned(wide, WORD // 2 + k) for k in range(-r, r + 1)]
    bits = _all(rows, "bitwiseAND").bitwiseAND(F.lit((1 << WORD) - 1))
    return met.select(*keys, "y", "w", bits.cast("long").alias("bits")).filter("bits != 0")


def _stepped(words: DataFrame, height: Column | int, width: Column | int, far: int, keys: tuple[str, ...], step: Callable, reach: Callable[[int], dict[int, int]]) -> DataFrame:
    """`step` by reach(far), STEP pixels at most at a time; what then lies within the image."""
    while far > 0:
        words = step(words, keys, reach(min(far, STEP)))
        far -= STEP
    return _within(words, height, width)


def dilate(mask: DataFrame, height: int, width: int, times: int = 1, keys: tuple[str, ...] = ("image_id", "mask_id")) -> DataFrame:
    """Each pixel with its four neighbours, `times` times over, within the image.

    This and the like go by numbers of WORD pixels of a row, so that nothing is multiplied by the pixels reached.
    """
    return _pixels(_stepped(_words(mask, keys), height, width, times, keys, _wider, _cross), keys)


def erode(mask: DataFrame, height: int, width: int, times: int = 1, keys: tuple[str, ...] = ("image_id", "mask_id")) -> DataFrame:
    """Pixels whose whole neighbourhood is in the mask; outside the image nothing is."""
    return _pixels(_stepped(_words(mask, keys), height, width, times, keys, _narrower, _cross), keys)


def opened(mask: DataFrame, height: int, width: int, times: int = 1, keys: tuple[str, ...] = ("image_id", "mask_id")) -> DataFrame:
    small = _stepped(_words(mask, keys), height, width, times, keys, _narrower, _cross)
    return _pixels(_stepped(small, height, width, times, keys, _wider, _cross), keys)


def closed(mask: DataFrame, height: int, width: int, times: int = 1, keys: tuple[str, ...] = ("image_id", "mask_id")) -> DataFrame:
    large = _stepped(_words(mask, keys), height, width, times, keys, _wider, _cross)
    return _pixels(_stepped(large, height, width, times, keys, _narrower, _cross), keys)


def smooth(mask: DataFrame, height: int, width: int, sigma: float, keys: tuple[str, ...] = ("image_id", "mask_id")) -> DataFrame:
    """Where a blur of the mask isn't zero: the mask widened by the blur's radius in a square."""
    return _pixels(_stepped(_words(mask, keys), height, width, int(4 * sigma + 0.5), keys, _wider, lambda r: dict.fromkeys(range(-r, r + 1), r)), keys)


def union_masks(masks: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return masks.select(*keys, "y", "x").distinct()


def grid(images: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, y, x): all pixels of each distinct image_id."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    return images.select("image_id").distinct().withColumn("y", rows).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def complement(mask: DataFrame, images: DataFrame, height: int, width: int) -> DataFrame:
    """All pixels of the images that the mask doesn't have."""
    return grid(images, height, width).join(mask.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("image_id", "y", "x").distinct(), ["image_id", "y", "x"], "left_semi")


def threshold_mean(pixels: DataFrame, keys: tuple[str, ...] = ("image_id", "channel")) -> DataFrame:
    """Pixels at or above the mean of their image and channel."""
    mean = F.avg("v").over(Window.partitionBy(*keys))
    return pixels.withColumn("__m", mean).filter(F.col("v") >= F.col("__m")).drop("__m")


def mean_of_masks(masks: DataFrame, pixels: DataFrame, least: float, height: int, width: int, layers: int | None = None, area: int = 0, times: int = 1) -> DataFrame:
    """(image_id, y, x) where image value times the share of masks that have the pixel is above `least`, cleaned and widened.

    Holes and then parts of fewer than `area` pixels (4-connected) go, and the rest is dilated `times` times. `layers` is
    the number of an image's masks, those without any pixel included; without it the masks that have one are counted.
    """
    k = masks.groupBy("image_id", "y", "x").agg(F.count_distinct("mask_id").alias("k"))
    p = pixels.select("image_id", "y", "x", "v").join(k, ["image_id", "y", "x"], "left")
    if layers is None:
        n = masks.select("image_id", "mask_id").distinct().groupBy("image_id").agg(F.count("*").alias("n"))
        p = p.join(n, "image_id")
    else:
        p = p.withColumn("n", F.lit(layers))
    out = p.filter(F.col("v") * F.coalesce("k", F.lit(0)) / F.col("n") > least).select("image_id", "y", "x")
    if area > 0:
        from loomgrain.operators.components import drop_small, fill_small

        out = drop_small(fill_small(out, out, height, width, area), width, area)
    return dilate(out, height, width, times, ("image_id",)) if times else out


def rasterise(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, y, x): the nodes and a line of pixels along each edge (image_id, src, dst), by the integer line rule.

    The longer axis goes pixel by pixel from src to dst; the other one has gone, after t of n steps over a difference of d,
    floor((2 d t + n) / 2 n) pixels, so at a tie it steps away from the start. Fractions of places are cut off first.
    """
    place = lambda c, name: F.floor(F.col(c)).cast("long").alias(name)
    a = nodes.select("image_id", F.col("node_id").alias("src"), place("y", "y0"), place("x", "x0"))
    b = nodes.select("image_id", F.col("node_id").alias("dst"), place("y", "y1"), place("x", "x1"))
    e = edges.select("image_id", "src", "dst").join(a, ["image_id", "src"]).join(b, ["image_id", "dst"])
    n = F.greatest(F.abs(F.col("y1") - F.col("y0")), F.abs(F.col("x1") - F.col("x0")))
    e = e.withColumn("n", n).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))

    def at(p: str, q: str) -> Column:
        gone = F.floor((2 * F.abs(F.col(q) - F.col(p)) * F.col("t") + F.col("n")) / (2 * F.greatest(F.col("n"), F.lit(1))))
        return (F.col(p) + F.signum(F.col(q) - F.col(p)) * gone).cast("int")

    line = e.select("image_id", at("y0", "y1").alias("y"), at("x0", "x1").alias("x"))
    return line.union(nodes.select("image_id", F.floor("y").cast("int"), F.floor("x").cast("int"))).distinct()


def network_masks(parts: DataFrame, height: int, width: int, iterations: int = 2, sigma: float | None = 0.5, area: int = 64, by_network: bool = True) -> DataFrame:
    """(image_id, network_id, y, x), or without network_id of all networks of an image: what networks cover.

    parts: (image_id, network_id, nodes, edges) as graphs.network_parts() gives them. Edges are drawn by the rule of
    rasterise(), widened `iterations` times by their four neighbours, then to where a blur of `sigma` isn't zero, and
    holes of fewer than `area` pixels are filled. One pass, and of an image's networks together one shuffle; repeated
    edges and nodes in one place change nothing, no networks give no rows.
    """
    kind = parts.schema["image_id"].dataType.simpleString()
    own = parts.select("image_id", "network_id", "nodes", "edges")
    if not by_network:
        own = own.groupBy("image_id").agg(F.lit(0).alias("network_id"), F.collect_list(F.struct("nodes", "edges")).alias("graphs"))
    else:
        own = own.select("image_id", "network_id", F.array(F.struct("nodes", "edges")).alias("graphs"))

    def run(batches):
        for pdf in batches:
            for image, net, graphs in zip(pdf["image_id"], pdf["network_id"], pdf["graphs"], strict=True):
                lines = []
                for g in graphs:
                    at = {r["node_id"]: (int(r["y"] // 1), int(r["x"] // 1)) for r in g["nodes"]}
                    lines += [(p, p) for p in at.values()] + [(at[r["src"]], at[r["dst"]]) for r in g["edges"]]
                ys, xs = kernels.network_mask(lines, height, width, iterations, sigma, area)
                yield pd.DataFrame({"image_id": [image] * len(ys), "network_id": [net] * len(ys), "y": ys, "x": xs})

    out = few_at_once(own, run, f"image_id {kind}, network_id int, y int, x int")
    return out if by_network else out.drop("network_id")
