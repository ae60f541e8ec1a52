"""Filters on images cut into blocks: the rows of the filters on whole images, and so their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import blocks
from loomgrain.plans import image_queries  # noqa: F401 - registers the SQL that is used again here
from loomgrain.plans.base import ORACLES, foreground, pixels, query, r6, rounded
from loomgrain.sources.stages import kept

#: Blocks that divide no side of the images evenly.
BLOCK = 3


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks_of(pixels(spark, sf_dir), BLOCK)


def cut_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foreground as blocks of 1 and 0."""
    on = foreground(spark, sf_dir).select("image_id", "y", "x", F.lit(1.0).alias("on"))
    p = pixels(spark, sf_dir).join(on, ["image_id", "y", "x"], "left")
    return blocks.blocks_of(p.withColumn("v", F.coalesce("on", F.lit(0.0))), BLOCK)


def back(b: DataFrame) -> DataFrame:
    return blocks.pixels_of_blocks(b, BLOCK).drop("channel")


def on(b: DataFrame) -> DataFrame:
    return back(b).filter("v > 0").select("image_id", "y", "x")


@query(ORACLES["f1_gaussian"])
def f1_gaussian_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(back(blocks.gaussian(cut(spark, sf_dir), BLOCK, 0.5)))


@query(ORACLES["f6_tubeness"])
def f6_tubeness_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(back(blocks.tubeness(cut(spark, sf_dir), BLOCK, 3)))


@query(ORACLES["f7_hysteresis"])
def f7_hysteresis_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from sums over blocks, parts joined over their borders."""
    return on(blocks.hysteresis(cut(spark, sf_dir), BLOCK, 1.0))


@query(ORACLES["f9_median_filter"])
def f9_median_filter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(back(blocks.median_filter(cut(spark, sf_dir), BLOCK, 3)))


@query(ORACLES["f14_open_close"])
def f14_open_close_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kept(cut_mask(spark, sf_dir), "mask-blocks")
    opened = on(blocks.opened(m, BLOCK)).withColumn("part", F.lit("opened"))
    return opened.unionByName(on(blocks.closed(m, BLOCK)).withColumn("part", F.lit("closed")))


@query(ORACLES["f16_distance_transform"])
def f16_distance_transform_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = back(blocks.distance_transform(cut_mask(spark, sf_dir), BLOCK, 2)).filter("v > 0 and v < 1e9")
    return d.select("image_id", "y", "x", r6("v").alias("distance"))
