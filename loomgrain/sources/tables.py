"""Image stacks, masks, graphs and databases as tables: channels, checks, JSON forms, saving and loading."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAPH = "struct<directed:boolean,multigraph:boolean,graph:map<string,string>,nodes:array<struct<xy:array<double>,id:long>>,links:array<struct<r:double,source:long,target:long>>>"


def average_stack(raw: DataFrame) -> DataFrame:
    """(image_id, channel, y, x, v): mean over slices of raw pixels (…, slice, v, acc), over the accumulation number."""
    return raw.groupBy("image_id", "channel", "y", "x").agg((F.avg("v") / F.first("acc")).alias("v"))


def order_channels(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """raw (…, source, idx) with the channel that wanted (source, idx, channel) gives; others are dropped."""
    return raw.join(wanted, ["source", "idx"]).drop("source", "idx")


def verify_stacks(tiles: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(tiles of whole stacks, quarantine (image_id, reason)): n channels, all of one shape."""
    s = tiles.groupBy("image_id").agg(F.count("*").alias("k"), F.count_distinct(F.struct("height", "width")).alias("shapes"))
    reason = F.when(F.col("k") != n, F.lit("channels")).when(F.col("shapes") != 1, F.lit("shape"))
    s = s.withColumn("reason", reason)
    good = s.filter("reason is null").select("image_id")
    return tiles.join(good, "image_id", "left_semi"), s.filter("reason is not null").select("image_id", "reason")


def append_channel(tiles: DataFrame, more: DataFrame) -> DataFrame:
    """tiles and those of more whose image has the same shape."""
    shape = tiles.select("image_id", "height", "width").distinct()
    return tiles.unionByName(more.join(shape, ["image_id", "height", "width"], "left_semi").select(*tiles.columns))


def remove_channel(tiles: DataFrame, channel: str) -> DataFrame:
    return tiles.filter(F.col("channel") != channel)


def to_stack(tiles: DataFrame) -> DataFrame:
    """(image_id, channels, heights, widths, stack array<array<double>>): one row an image, channels in order of name."""
    s = F.sort_array(F.collect_list(F.struct("channel", "height", "width", "data")))
    part = lambda name: F.transform("s", lambda t: t[name])
    return tiles.groupBy("image_id").agg(s.alias("s")).select("image_id", part("channel").alias("channels"), part("height").alias("heights"), part("width").alias("widths"), part("data").alias("stack"))


def from_stack(stacks: DataFrame) -> DataFrame:
    """(image_id, channel, height, width, data) from rows of to_stack()."""
    z = stacks.select("image_id", F.explode(F.arrays_zip("channels", "heights", "widths", "stack")).alias("z"))
    return z.select("image_id", F.col("z.channels").alias("channel"), F.col("z.heights").alias("height"), F.col("z.widths").alias("width"), F.col("z.stack").alias("data"))


def stack_shape(tiles: DataFrame) -> DataFrame:
    """(image_id, n_channels, height, width, n_values)."""
    return tiles.groupBy("image_id").agg(F.count("*").alias("n_channels"), F.max("height").alias("height"), F.max("width").alias("width"), F.sum(F.size("data")).alias("n_values"))


# ---------------------------------------------------------------- JSON


def graphs_to_json(nodes: DataFrame, edges: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, json): each graph in node-link form, nodes by id and links by their ends."""
    n = nodes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("node_id", "y", "x"))).alias("n"))
    e = edges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("src", "dst", "r"))).alias("e"))
    g = n.join(e, key, "left")
    form = F.struct(
        F.lit(False).alias("directed"),
        F.lit(False).alias("multigraph"),
        F.create_map().cast("map<string,string>").alias("graph"),
        F.transform("n", lambda t: F.struct(F.array(t["y"], t["x"]).alias("xy"), t["node_id"].alias("id"))).alias("nodes"),
        F.coalesce(F.transform("e", lambda t: F.struct(t["r"].alias("r"), t["src"].alias("source"), t["dst"].alias("target"))), F.array().cast("array<struct<r:double,source:bigint,target:bigint>>")).alias("links"),
    )
    return g.select(key, F.to_json(form).alias("json"))


def graphs_from_json(rows: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from rows of graphs_to_json(); text that isn't a graph gives none."""
    g = rows.select(key, F.from_json("json", GRAPH).alias("g"))
    n = g.select(key, F.explode("g.nodes").alias("t")).select(key, F.col("t.id").alias("node_id"), F.col("t.xy")[0].alias("y"), F.col("t.xy")[1].alias("x"))
    e = g.select(key, F.explode("g.links").alias("t")).select(key, F.col("t.source").alias("src"), F.col("t.target").alias("dst"), F.col("t.r").alias("r"))
    return n, e


def _unwanted(name: str) -> bool:
    return name.startswith("_") or name.startswith("contraction")


def kept_type(t: T.DataType) -> T.DataType:
    """A type without the struct fields that are private or left over from contractions."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, kept_type(f.dataType), f.nullable) for f in t.fields if not _unwanted(f.name)])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(kept_type(t.elementType), t.containsNull)
    return t


def drop_keys(df: DataFrame, col: str) -> DataFrame:
    """df with unwanted keys of a struct (or array of structs) column dropped at every level."""
    return df.withColumn(col, F.from_json(F.to_json(col), kept_type(df.schema[col].dataType)))


def drop_map_keys(df: DataFrame, col: str) -> DataFrame:
    """df with unwanted keys of a map column dropped."""
    return df.withColumn(col, F.map_filter(col, lambda k, v: ~k.startswith("_") & ~k.startswith("contraction")))


def drop_json_keys(df: DataFrame, col: str) -> DataFrame:
    """df with unwanted keys dropped from JSON text of any shape, in objects at every level, also those within arrays.

    Row by row in one Arrow pass, as no schema need hold for two rows. Keys stay in order, repeated keys become the last of
    them, text is written without spaces. Null stays null, what isn't an object or array stays as it is; text that is no
    JSON becomes null.
    """

    def kept(value):
        if isinstance(value, dict):
            return {k: kept(v) for k, v in value.items() if not _unwanted(k)}
        return [kept(v) for v in value] if isinstance(value, list) else value

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(kept(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def dropped(text: pd.Series) -> pd.Series:
        return text.map(one)

    return df.withColumn(col, dropped(F.col(col)))


# ---------------------------------------------------------------- saving


def save_database(df: DataFrame, folder: str, name: str, kind: str, fmt: str = "parquet") -> str:
    path = f"{folder.rstrip('/')}/{name}_{kind}"
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
    return path


def load_database(spark: SparkSession, folder: str, name: str, kind: str, fmt: str = "parquet") -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}_{kind}"
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)


def save_masks(mask_pixels: DataFrame, path: str, buckets: int = 64) -> None:
    """Mask pixels in folders by a hash of the image, so that one image's masks are read without the rest."""
    mask_pixels.withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_masks(spark: SparkSession, path: str, width: int | None = None, first_only: bool = False) -> DataFrame:
    """Mask pixels; with first_only just the first connected part of each layer, as objects are kept."""
    m = spark.read.parquet(path).drop("bucket")
    if not first_only:
        return m
    from loomgrain.operators.components import label_images

    parts = label_images(m, width, keys=("image_id", "mask_id"))
    first = F.min("region_id").over(Window.partitionBy("image_id", "mask_id"))
    return parts.withColumn("f", first).filter("region_id = f").select("image_id", "mask_id", "y", "x")
