"""Whole jobs: tracing networks, segment tables, network tables and image tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.functions import networks, stats
from loomgrain.functions.pixels import pixels_of, rescale, structure_tensor, tiles_of
from loomgrain.operators import clusters, components, graphs, masks, regions, stencils
from loomgrain.operators.masks import grid
from loomgrain.sources.stages import few_at_once, kept

#: Columns of the segment tables, in order.
SEGMENT_METRICS = ("area", "circularity", "eccentricity", "coverage", "mean", "std", "entropy", "angle_sdi", "coherence", "local_coherence")
NETWORK_METRICS = ("no_fibres", "cross_link_density", "degree", "eigenvalue", "connectivity", "angle_sdi", "mean_waviness", "mean_length")


def _traced(tiles: DataFrame, grow) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of grow(image) -> (places, edges) over each tile, in one pass."""
    kind = tiles.schema["image_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for image, h, w, data in zip(pdf["image_id"], pdf["height"], pdf["width"], pdf["data"], strict=True):
                xy, pairs = grow(np.asarray(data, float).reshape(h, w))
                rows.append((image, *graphs.rows_of(list(range(len(xy))), xy, pairs)))
            yield pd.DataFrame(rows, columns=["image_id", "n", "e"])

    g = few_at_once(tiles.select("image_id", "height", "width", "data"), run, f"image_id {kind}, n {graphs.NODES}, e {graphs.EDGES}")
    return g.select("image_id", F.inline("n")), g.select("image_id", F.inline("e"))


def build_networks(tiles: DataFrame, scale: float = 1.25, alpha: float = 1.0, sigma: float = 0.5, nuc_thresh: float = 2, lmp_thresh: float = 0.15, angle: float = 70, r_thresh: float = 7) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) traced over each tile: distance image, growth, scaling back, cleaning."""
    return _traced(tiles, lambda img: trace(img, scale, alpha, sigma, nuc_thresh, lmp_thresh, angle, r_thresh))


def trace_networks(tiles: DataFrame, nuc_thresh: float = 2, lmp_thresh: float = 0.15, angle: float = 70, r_thresh: float = 8) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) grown over distance images as they are: seeds, then tips until none moves; image by image."""
    return _traced(tiles, lambda img: networks.Tracer(img, nuc_thresh, lmp_thresh, angle, r_thresh).run())


def trace(img: np.ndarray, scale: float, alpha: float, sigma: float, nuc_thresh: float, lmp_thresh: float, angle: float, r_thresh: float) -> tuple[networks.Points, networks.Pairs]:
    """One image's cleaned network in its own coordinates."""
    far = stencils.distance_of(img, scale, alpha, sigma * scale)
    if not far.any():
        return [], []
    top = 0.1 * scale**2
    t = networks.Tracer(far, min(nuc_thresh * scale**2, top * far.max()), min(lmp_thresh * scale**2, top * far[far > 0].mean()), angle, int(r_thresh * scale))
    xy, pairs = t.run()
    xy, pairs = [(float(y // scale), float(x // scale)) for y, x in xy], pairs
    return networks.clean(xy, pairs, 2.0)


def segment_table(region_pixels: DataFrame, pixels: DataFrame, tag: str) -> DataFrame:
    """One row a region (image_id, region_id, y, x): shape, texture and orientation under the image's pixels.

    coverage is the region's share of its bounding box. Everything is keyed by image and region after one join by pixel.
    """
    shape = regions.region_shape(region_pixels)
    met = region_pixels.join(pixels.select("image_id", "y", "x", "v"), ["image_id", "y", "x"])
    texture = regions.region_texture(met)
    tensors = structure_tensor(pixels)
    oriented = regions.structure_metrics(region_pixels.join(tensors, ["image_id", "y", "x"]))
    keys = list(regions.REGION)
    t = shape.join(texture, keys).join(oriented, keys, "left")
    return t.select(*keys, "area", "circularity", "eccentricity", F.col("extent").alias("coverage"), "mean", "std", "entropy", "angle_sdi", "coherence", "local_coherence", F.lit(tag).alias("tag"))


def network_table(parts: DataFrame) -> DataFrame:
    """One row a network of graphs.network_parts(): counts, degrees, spectra and spread.

    Cross-links (nodes of more than two edges, for each fibre) and the degree correlation are those of the whole
    component, also of its nodes outside every fibre; eigenvalue and connectivity those of the contracted network; length,
    waviness and angles those of the fibres. parts is read several times: pass a kept table.
    """
    keys = ["image_id", "network_id"]
    props = stats.fibre_properties(graphs.fibres_of_parts(parts))
    base = props.groupBy(*keys).agg(F.count("*").alias("no_fibres"), F.avg("waviness").alias("mean_waviness"), F.avg("length").alias("mean_length"))
    whole = graphs.component_metrics(parts.select(*keys, F.inline("nodes")), parts.select(*keys, F.inline("edges")), tuple(keys))
    out = base.join(whole, keys, "left").join(graphs.part_spectra(parts), keys, "left")
    out = out.join(stats.angle_sdi(props, tuple(keys), "angle", name="angle_sdi"), keys, "left")
    return out.withColumn("cross_link_density", F.col("cross_links") / F.col("no_fibres")).select(*keys, *NETWORK_METRICS)


def image_table(segments: DataFrame, image_size: DataFrame, network_rows: DataFrame | None = None, fibre_rows: DataFrame | None = None) -> DataFrame:
    """One row an image: segment metrics averaged by area, their number and coverage, and network averages if given.

    image_size: (image_id, pixels). With fibre_rows the angle spread is that of all fibres of the image.
    """
    metrics = [m for m in SEGMENT_METRICS if m not in ("area", "coverage")]
    out = segments.groupBy("image_id").agg(*[stats.nanmean(F.col(m), F.col("area")).alias(m) for m in metrics], F.sum("area").alias("__area"), F.count("*").alias("no_segments"))
    out = out.join(image_size, "image_id").withColumn("coverage", F.col("__area") / F.col("pixels")).drop("__area", "pixels")
    if network_rows is not None:
        own = [m for m in NETWORK_METRICS if m not in ("no_fibres", "angle_sdi")]
        n = network_rows.groupBy("image_id").agg(*[stats.nanmean(F.col(m)).alias(m) for m in own], F.sum("no_fibres").alias("no_fibres"))
        out = out.join(n, "image_id", "left")
    if fibre_rows is not None:
        out = out.join(stats.angle_sdi(fibre_rows, ("image_id",), "angle", name="fibre_angle_sdi"), "image_id", "left")
    return out


def file_tag(table: DataFrame, name_col: str, tag: str) -> DataFrame:
    """table plus file: where the row's segments or networks are kept."""
    return table.withColumn("file", F.concat_ws("_", F.col(name_col), F.lit(tag)))


def cell_table(cells: DataFrame, image_size: DataFrame) -> DataFrame:
    """One row an image of its cell segments (segment_table()): metrics averaged by area, their number and their coverage.

    image_size: (image_id, pixels). Images without a cell have no row.
    """
    metrics = [m for m in SEGMENT_METRICS if m not in ("area", "coverage")]
    out = cells.groupBy("image_id").agg(*[stats.nanmean(F.col(m), F.col("area")).alias(f"cell_{m}") for m in metrics], F.count("*").alias("no_cells"), F.sum("area").alias("__area"))
    return out.join(image_size, "image_id").withColumn("cell_coverage", F.col("__area") / F.col("pixels")).drop("__area", "pixels")


def metric_databases(segments: DataFrame, cells: DataFrame | None, parts: DataFrame, pixels: DataFrame, which: tuple[str, ...] = ("global", "fibre", "network", "cell")) -> dict[str, DataFrame]:
    """The tables of a corpus named in `which`: global, fibre, network and cell (empty, and nothing of cells in global,
    without cells).

    parts are the networks (graphs.network_parts()), pixels those of the intensity image. What the global table shares
    with others is kept once: the networks, and the segment and network rows that it averages.
    """
    out, share = {}, "global" in which
    keep = kept if share else lambda df, tag: df
    if {"global", "network"} & set(which):
        parts = kept(parts, "networks")
        out["network"] = keep(network_table(parts), "network-rows")
    if {"global", "fibre"} & set(which):
        out["fibre"] = keep(segment_table(segments, pixels, "fibre"), "fibre-segments")
    if cells is not None and {"global", "cell"} & set(which):
        out["cell"] = keep(segment_table(cells, pixels, "cell"), "cell-segments")
    elif "cell" in which:
        out["cell"] = segment_table(segments.limit(0), pixels, "cell")
    if share:
        size = pixels.groupBy("image_id").agg(F.count("*").alias("pixels"))
        out["global"] = image_table(out["fibre"], size, out["network"], stats.fibre_properties(graphs.fibres_of_parts(parts)))
        if cells is not None:
            out["global"] = out["global"].join(cell_table(out["cell"], size), "image_id", "left")
    return {name: out[name] for name in which}


def fibre_filter(network_pixels: DataFrame, images: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, y, x, v): 2 on the network regions and 0.25 elsewhere, blurred; every pixel of every image."""
    every = grid(images, height, width)
    on = network_pixels.select("image_id", "y", "x").distinct().withColumn("on", F.lit(True))
    v = every.join(on, ["image_id", "y", "x"], "left").select("image_id", F.lit("0").alias("channel"), "y", "x", F.when(F.col("on"), 2.0).otherwise(0.25).alias("v"))
    return pixels_of(stencils.gaussian(tiles_of(v), 0.5)).drop("channel")


def segment_by_filter(filtered: DataFrame, height: int, width: int, threshold: float = 0.1, fibre_above: bool = False) -> DataFrame:
    """Fibre and cell segments from a fibre filter.

    By default pixels above the threshold are cells, as the original has it: its background lies above the threshold, so
    that an image gives one cell and no fibre. fibre_above=True turns the sides round.
    """
    above = filtered.filter(F.col("v") > threshold).select("image_id", "y", "x")
    below = filtered.filter(F.col("v") <= threshold).select("image_id", "y", "x")
    fibre, cell = (above, below) if fibre_above else (below, above)
    return regions.to_segments(fibre, "fibre", height, width).unionByName(regions.to_segments(cell, "cell", height, width))


def fibre_and_cell_masks(
    stacks: DataFrame,
    network_pixels: DataFrame,
    height: int,
    width: int,
    scale: float = 1.0,
    swap_sizes: tuple[int, int] = (250, 150),
    swap_fracs: tuple[float, float] = (0.01, 0.1),
    holes: int = 64,
    least: float = 0.1,
    **clustering,
) -> tuple[DataFrame, DataFrame]:
    """Where fibres are and where cells are in three-channel stacks (image_id, channel 0 SHG, 1 PL, 2 transmission, y, x, v).

    Colour clusters say which pixels are cell; regions that fit the other side better change sides (sizes and means of
    cell and fibre: swap_sizes, swap_fracs); holes under `holes` pixels are filled. The fibre side, widened twice and
    closed, and the fibre filter of the traced networks (network_pixels: image_id, y, x), cut at its mean, count half each:
    where their mean times the SHG value (over its range) is above `least` is fibre, all else is cell. Further arguments go
    to rgb_segmentation(). What is read several times is kept: the swapped masks and the result.
    """
    keys = ("image_id",)
    norm = rescale(stacks)
    images = stacks.select("image_id").distinct()
    clustered = clusters.rgb_segmentation(clusters.composite_rgb(norm), scale, **clustering)
    sides = clustered.select("image_id", F.when(F.col("is_cell"), 0).otherwise(1).alias("mask_id"), "y", "x")
    value = stacks.filter("channel in ('0', '1')").select("image_id", F.when(F.col("channel") == "1", 0).otherwise(1).alias("mask_id"), "y", "x", "v")
    swapped = kept(regions.region_swap(kept(sides, "sides"), value, width, swap_sizes, swap_fracs), "swapped")
    fibre = components.fill_small(swapped.filter("mask_id = 1").select("image_id", "y", "x"), images, height, width, holes)
    fibre = masks.closed(masks.dilate(fibre, height, width, 2, keys), height, width, 1, keys)
    drawn = masks.threshold_mean(fibre_filter(network_pixels, images, height, width), keys).select("image_id", "y", "x")
    layers = fibre.withColumn("mask_id", F.lit(1)).unionByName(drawn.withColumn("mask_id", F.lit(0)))
    shg = norm.filter("channel = '0'").select("image_id", "y", "x", "v")
    fibrous = kept(masks.mean_of_masks(layers, shg, least, height, width, layers=2), "fibrous")
    return fibrous, masks.complement(fibrous, images, height, width)


def segment_shg_pl_trans(stacks: DataFrame, network_pixels: DataFrame, height: int, width: int, scale: float = 1.0, min_sizes: tuple[int, int] = (100, 200), min_fracs: tuple[float, float] = (100, 0.1), **how) -> DataFrame:
    """Fibre and cell segments of three-channel stacks: the parts of fibre_and_cell_masks() that are large and bright enough.

    min_sizes and min_fracs are those of fibre (in SHG) and cell (in PL); further arguments go to fibre_and_cell_masks().
    """
    fibrous, cellular = fibre_and_cell_masks(stacks, network_pixels, height, width, scale, **how)
    raw = {c: stacks.filter(F.col("channel") == c).select("image_id", "y", "x", "v") for c in ("0", "1")}
    made = regions.to_segments(fibrous, "fibre", height, width, raw["0"], min_sizes[0], min_fracs[0])
    return made.unionByName(regions.to_segments(cellular, "cell", height, width, raw["1"], min_sizes[1], min_fracs[1]))
