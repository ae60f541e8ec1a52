"""How queries are registered, and the given tables seen as images, stacks, masks and graphs.

A vector of `embeddings` is read as an 8 x 8 image; three consecutive ones are a stack of three channels. Pixels at or
above their image's mean are foreground; foreground pixels are nodes, and edges join 8-neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrain.functions.pixels import tiles_of
from loomgrain.operators.masks import grid

SIDE = 8
REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that gives the same rows if there is any."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTERED[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.lit("0").alias("channel"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.col("embedding").cast("array<double>").alias("data"), "label")


def mosaics(spark: SparkSession, sf_dir: str, across: int = 8) -> DataFrame:
    """Larger tiles: across * across consecutive vectors side by side; places that no vector fills are 0."""
    p = pixels(spark, sf_dir)
    k = F.col("image_id") % (across * across)
    p = p.select(F.floor(F.col("image_id") / (across * across)).alias("image_id"), "channel", (F.floor(k / across) * SIDE + F.col("y")).cast("int").alias("y"), ((k % across) * SIDE + F.col("x")).cast("int").alias("x"), "v")
    every = grid(p, across * SIDE, across * SIDE).withColumn("channel", F.lit("0"))
    return tiles_of(every.join(p, ["image_id", "channel", "y", "x"], "left").na.fill(0.0, ["v"]))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, channel, y, x, v, label)."""
    t = tiles(spark, sf_dir).select("image_id", "channel", "label", F.posexplode("data").alias("i", "v"))
    return t.select("image_id", "channel", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), "v", "label")


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, channel, y, x, v): whole stacks of three, values made positive."""
    p = pixels(spark, sf_dir).select(F.floor(F.col("image_id") / 3).alias("image_id"), (F.col("image_id") % 3).cast("string").alias("channel"), "y", "x", F.abs("v").alias("v"))
    whole = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 3).alias("image_id")).agg(F.count("*").alias("k")).filter("k = 3")
    return p.join(whole, "image_id", "left_semi")


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """threshold_mean() of the images; only as whole arrays are they dealt by id, so a sort holds a row an image."""
    some, own = F.filter("data", lambda v: v.isNotNull()), Window.partitionBy("image_id")
    t = tiles(spark, sf_dir).select("image_id", "data", F.aggregate(some, F.lit(0.0), lambda s, v: s + v).alias("s"), F.coalesce(F.size(some), F.lit(0)).alias("n"))
    t = t.select("image_id", "data", (F.sum("s").over(own) / F.nullif(F.sum("n").over(own), F.lit(0))).alias("m"))
    p = t.select("image_id", "m", F.posexplode("data").alias("i", "v")).filter("v >= m")
    return p.select("image_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), "v")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = foreground(spark, sf_dir).select("image_id", (F.col("y") * SIDE + F.col("x")).cast("long").alias("node_id"), "y", "x", "v")
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    e = nodes.withColumn("o", near).select("image_id", F.col("node_id").alias("src"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.sqrt((F.abs("o.dy") + F.abs("o.dx")).cast("double")).alias("r"))
    return nodes, e.join(nodes.select("image_id", "y", "x", F.col("node_id").alias("dst")), ["image_id", "y", "x"]).select("image_id", "src", "dst", "r")


#: The same in SQL.
PX = "px AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v, label FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"
ST = f"{PX}, st AS (SELECT image_id // 3 AS image_id, image_id % 3 AS channel, y, x, abs(v) AS v FROM px WHERE image_id // 3 IN (SELECT vec_id // 3 FROM embeddings GROUP BY 1 HAVING count(*) = 3))"
FG = f"{PX}, fg AS (SELECT image_id, y, x, v FROM (SELECT *, avg(v) OVER (PARTITION BY image_id) AS m FROM px) WHERE v >= m)"
GR = f"""{FG}, nodes AS (SELECT image_id, CAST(y * 8 + x AS BIGINT) AS node_id, y, x, v FROM fg),
edges AS (SELECT a.image_id, a.node_id AS src, b.node_id AS dst, sqrt(CAST(abs(a.y - b.y) + abs(a.x - b.x) AS DOUBLE)) AS r FROM nodes a JOIN nodes b ON a.image_id = b.image_id AND a.node_id < b.node_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)"""


def q6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def parts_sql(p: str, source: str) -> str:
    """CTEs over a table source(image_id, y, x, v) of 8 x 8 images: {p}_lb (…, region_id) and {p}_fa (area, filled_area, total).

    Parts are 8-connected; filled_area is what can't be reached from outside through pixels that aren't the part's.
    """
    return f"""{p}_m AS (SELECT image_id, y, x, v, y * 8 + x AS id FROM {source}),
{p}_re(image_id, id, root) AS (SELECT image_id, id, id FROM {p}_m UNION SELECT b.image_id, b.id, r.root FROM {p}_re r JOIN {p}_m a ON a.image_id = r.image_id AND a.id = r.id JOIN {p}_m b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
{p}_lb AS (SELECT image_id, y, x, v, region_id FROM {p}_m JOIN (SELECT image_id, id, min(root) AS region_id FROM {p}_re GROUP BY 1, 2) USING (image_id, id)),
{p}_rg AS (SELECT image_id, region_id, count(*) AS area, sum(v) AS total FROM {p}_lb GROUP BY 1, 2),
{p}_ce AS (SELECT r.image_id, r.region_id, c.y, c.x FROM {p}_rg r, (SELECT CAST(i // 10 - 1 AS INTEGER) AS y, CAST(i % 10 - 1 AS INTEGER) AS x FROM range(100) t(i)) c ANTI JOIN {p}_lb l ON l.image_id = r.image_id AND l.region_id = r.region_id AND l.y = c.y AND l.x = c.x),
{p}_ou(image_id, region_id, y, x) AS (SELECT image_id, region_id, -1, -1 FROM {p}_rg UNION SELECT c.image_id, c.region_id, c.y, c.x FROM {p}_ou o JOIN {p}_ce c ON c.image_id = o.image_id AND c.region_id = o.region_id AND abs(c.y - o.y) <= 1 AND abs(c.x - o.x) <= 1),
{p}_fa AS (SELECT image_id, region_id, area, total, 100 - n AS filled_area FROM {p}_rg JOIN (SELECT image_id, region_id, count(*) AS n FROM {p}_ou GROUP BY 1, 2) USING (image_id, region_id))"""
