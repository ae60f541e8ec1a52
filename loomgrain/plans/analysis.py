"""The whole job: from image stacks to networks, segments and the four metric tables, of images that lack them only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions.pixels import tiles_of
from loomgrain.operators import graphs, masks, regions, stencils
from loomgrain.plans import jobs
from loomgrain.sources.files import plan_recompute
from loomgrain.sources.stages import kept


@dataclass
class Outputs:
    """Tables in a folder, each in `buckets` partitions by the hash of the image, replaced image by image.

    Every image that a table was made for has at least one row there, with `__none` true where it has nothing else; so
    what is done is read from the tables themselves, and an image whose partition someone deletes is made again.
    """

    spark: SparkSession
    folder: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("image_id"), F.lit(self.buckets)).cast("int")

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _all(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        parts = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "bucket=*"))
        return self.spark.read.parquet(self.path(name)) if parts and len(parts) else None

    def read(self, name: str) -> DataFrame:
        """The table without its bookkeeping."""
        return self._all(name).filter(~F.col("__none")).drop("__none", "bucket")

    def done(self, *names: str, like: DataFrame) -> DataFrame:
        """(image_id) of the images that all the tables have been made for; `like` gives the type where there are none."""
        out = None
        for name in names:
            table = self._all(name)
            ids = like.select("image_id").limit(0) if table is None else table.select("image_id").distinct()
            out = ids if out is None else out.join(ids, "image_id", "left_semi")
        return out

    def replace(self, name: str, rows: DataFrame, images: DataFrame) -> None:
        """Make rows those of `images` in the table; other images' rows stay. Only partitions of `images` are written."""
        ids = images.select("image_id").distinct()
        new = ids.join(rows.withColumn("__some", F.lit(True)), "image_id", "left").withColumn("__none", F.col("__some").isNull()).drop("__some").withColumn("bucket", self.bucket())
        old = self._all(name)
        if old is not None:
            touched = ids.select(self.bucket().alias("bucket")).distinct()
            stay = old.join(touched, "bucket", "left_semi").join(ids, "image_id", "left_anti")
            new = new.unionByName(kept(stay, f"stay-{name}"), allowMissingColumns=True)
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(name))


@dataclass
class Settings:
    """What the steps take; the defaults are those of the interactive runner of such analyses."""

    height: int
    width: int
    scale: float = 1.25
    alpha: float = 1.0
    sigma: float = 0.5
    patch: int = 5
    distance: int = 35
    fire: dict = field(default_factory=dict)
    min_sizes: tuple[int, int] = (100, 200)
    min_fracs: tuple[float, float] = (0.1, 0.01)
    segmentation: dict = field(default_factory=dict)


TABLES = ("global", "fibre", "network", "cell")


def analyse(stacks: DataFrame, folder: str, how: Settings, force: tuple[str, ...] = (), preprocess: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the four tables in `folder`, the work list) after all that is missing has been made for the images of stacks.

    stacks: (image_id, channel 0 SHG, 1 PL, 2 transmission, y, x, v), how.height by how.width each. The first channel is
    preprocessed (preprocess() on tiles; by default clipped, equalised and denoised), traced, and its networks assigned;
    fibre and cell segments come from all channels and the networks; metrics from networks, segments and raw values. An
    image whose networks, segments or metrics aren't in `folder` gets them, and what follows from them, anew; `force`
    names steps ("network", "segment", "metric") to make again. Each step is a written table that the next one reads, so a
    job that is lost goes on where it was. A second run without changes writes nothing. An empty table gives an empty work
    list; images without a fibre or cell count as done.
    """
    out = Outputs(stacks.sparkSession, folder, buckets)
    images = kept(stacks.select("image_id").distinct(), "images")
    done = [out.done(*names, like=images) for names in (("networks",), ("segments",), TABLES)]
    plan = kept(plan_recompute(images, *done, *(step in force for step in ("network", "segment", "metric"))), "work-list")
    shg = stacks.filter("channel = '0'")

    todo = plan.filter("do_network").select("image_id")
    if not todo.isEmpty():
        tiles = tiles_of(shg.join(todo, "image_id", "left_semi").select("image_id", "channel", "y", "x", "v"))
        ready = preprocess(tiles) if preprocess else stencils.preprocess(tiles, patch=how.patch, distance=how.distance)
        nodes, edges = jobs.build_networks(kept(ready, "preprocessed"), how.scale, how.alpha, how.sigma, **how.fire)
        out.replace("networks", graphs.network_parts(nodes, edges), todo)

    todo = plan.filter("do_segment").select("image_id")
    if not todo.isEmpty():
        own = stacks.join(todo, "image_id", "left_semi")
        covered = masks.network_masks(out.read("networks").join(todo, "image_id", "left_semi"), how.height, how.width)
        fibrous, cellular = jobs.fibre_and_cell_masks(own, covered.select("image_id", "y", "x").distinct(), how.height, how.width, how.scale, **how.segmentation)
        raw = {c: own.filter(F.col("channel") == c) for c in ("0", "1")}
        fibre = regions.segment_pixels(fibrous, "fibre", how.width, raw["0"], how.min_sizes[0], how.min_fracs[0])
        cell = regions.segment_pixels(cellular, "cell", how.width, raw["1"], how.min_sizes[1], how.min_fracs[1])
        out.replace("segments", fibre.unionByName(cell), todo)

    todo = plan.filter("do_metric").select("image_id")
    if not todo.isEmpty():
        own = stacks.join(todo, "image_id", "left_semi")
        of = {c: own.filter(F.col("channel") == c).select("image_id", "channel", "y", "x", "v") for c in ("0", "1")}
        seg = out.read("segments").join(todo, "image_id", "left_semi")
        fibre, cell = (seg.filter(F.col("tag") == t).drop("tag") for t in ("fibre", "cell"))
        made = jobs.metric_databases(fibre, None, out.read("networks").join(todo, "image_id", "left_semi"), of["0"])
        size = of["0"].groupBy("image_id").agg(F.count("*").alias("pixels"))
        made["cell"] = kept(jobs.segment_table(cell, of["1"], "cell"), "cell-segments")
        made["global"] = made["global"].join(jobs.cell_table(made["cell"], size), "image_id", "full")
        for name in TABLES:
            out.replace(name, made[name], todo)
    if any(out._all(name) is None for name in TABLES):
        return {}, plan
    return {name: out.read(name) for name in TABLES}, plan


def analyse_stream(stacks: DataFrame, folder: str, how: Settings, checkpoint: str, **more):
    """A streaming query that analyses each batch of stacks as it comes; whole stacks must come in one batch."""

    def batch(df: DataFrame, _: int) -> None:
        analyse(kept(df, "batch"), folder, how, **more)

    return stacks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
