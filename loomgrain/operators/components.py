"""Connected components over tables, and what is decided by their sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.functions import kernels
from loomgrain.sources.stages import dealt

#: Half of the neighbours of a pixel; the other half is the same pairs turned round.
HALF_CROSS, HALF_SQUARE = ((0, 1), (1, 0)), ((0, 1), (1, -1), (1, 0), (1, 1))


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the folder that the session names; only local mode may go without, in a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            named = "file://" + tempfile.mkdtemp(prefix="loomgrain-checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint()


#: Nodes and edges, from either end, of a key that one task takes.
FITS = 1 << 18


def connected_components(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("image_id",), node: str = "node_id", src: str = "src", dst: str = "dst", fits: int = FITS) -> DataFrame:
    """(keys, node, component): each node with the smallest node of its key that edges connect it to.

    Keys of up to `fits` nodes and edges are done in one pass, each by one task. For larger ones each round takes the least
    label of a node's neighbours, then that label's own label, so the number of rounds grows with the logarithm of the
    longest path. Nodes without edges are components. Edges whose ends aren't nodes are ignored.
    """
    k = list(keys)
    none = F.lit(None).cast(nodes.schema[node].dataType)
    both = edges.select(*k, F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(*k, F.col(dst), F.col(src)))
    if not k:
        return _by_rounds(nodes.select(F.col(node).alias("n")), both, k, node)
    rows = _cut(nodes.select(*k, F.col(node).alias("n"), none.alias("a"), none.alias("b")).unionByName(both.filter("a < b").select(*k, none.alias("n"), "a", "b")))
    large = rows.groupBy(*k).agg(F.count("*").alias("size")).filter(F.col("size") > fits).select(*k)
    if large.isEmpty():
        return _cut(_in_tasks(rows, k, node))
    large = _cut(large)
    rest = rows.join(large, k, "left_semi")
    half = rest.filter("a is not null")
    slow = _by_rounds(rest.filter("n is not null").select(*k, "n"), half.select(*k, "a", "b").union(half.select(*k, "b", "a")), k, node)
    return _cut(_in_tasks(rows.join(large, k, "left_anti"), k, node)).union(slow)


def _in_tasks(rows: DataFrame, k: list[str], node: str) -> DataFrame:
    """connected_components() of rows (keys, n, a, b), either a node n or an edge from a to b; some keys at a time."""
    kind = rows.schema["n"].dataType.simpleString()
    head = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in k)

    def solved(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, of = b.column(len(k)).flatten(), np.repeat(np.arange(b.num_rows), b.column(len(k)).value_lengths())
        values, at = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
        codes = np.unique(of * len(values) + at)  # a key's nodes side by side, by id
        ends, known = [], np.True_
        owner = np.repeat(np.arange(b.num_rows), b.column(len(k) + 1).value_lengths())
        for c in ("a", "b"):
            v = pa.compute.struct_field(b.column(len(k) + 1).flatten(), c).to_numpy(zero_copy_only=False)
            spot = np.minimum(np.searchsorted(values, v), max(len(values) - 1, 0))
            code = owner * len(values) + spot
            place = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = known & (values[spot] == v) & (codes[place] == code) if len(codes) else np.zeros(len(v), bool)
            ends.append(place)
        p, q = (e[known] for e in ends)
        label = np.arange(len(codes))
        while True:
            least = np.minimum(label[p], label[q])
            new = label.copy()
            for e in (label[p], label[q], p, q):  # an end's own label learns of the other's, too
                np.minimum.at(new, e, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        took = pa.array(codes // max(len(values), 1))
        named = [pa.array(values[c % max(len(values), 1)], ids.type) for c in (codes, codes[label])]
        return pa.RecordBatch.from_arrays([*(b.column(i).take(took) for i in range(len(k))), *named], names=[*k, node, "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum(whole.column(len(k)).value_lengths().to_numpy() + whole.column(len(k) + 1).value_lengths().to_numpy())
            at = 0
            while at < whole.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + FITS, "right")))
                yield solved(whole.slice(at, end - at))
                at = end

    per = rows.groupBy(*k).agg(F.collect_list("n").alias("n"), F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b"))).alias("e"))  # a key's, FITS at most
    return per.mapInArrow(run, f"{head}, `{node}` {kind}, component {kind}")


def _by_rounds(nodes: DataFrame, both: DataFrame, k: list[str], node: str) -> DataFrame:
    """connected_components() of nodes (keys, n) and edges from either end (keys, a, b) of any number."""
    both = _cut(both.distinct())
    label = _cut(nodes.select(*k, "n", F.col("n").alias("c")).distinct())
    while True:
        near = both.join(dealt(label.withColumnRenamed("n", "b")), [*k, "b"]).groupBy(*k, F.col("a").alias("n")).agg(F.min("c").alias("m"))
        step = label.join(dealt(near), [*k, "n"], "left").select(*k, "n", F.col("c").alias("was"), F.least("c", F.coalesce("m", "c")).alias("c"))
        up = step.select(*k, F.col("n").alias("c"), F.col("c").alias("cc"))
        step = _cut(step.join(dealt(up), [*k, "c"], "left").select(*k, "n", "was", F.least("c", F.coalesce("cc", "c")).alias("c")))
        label = step.drop("was")
        if step.filter("was != c").isEmpty():
            return label.select(*k, F.col("n").alias(node), F.col("c").alias("component"))


def label_mask(mask: DataFrame, width: int, diagonal: bool = True, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, x, region_id): connected parts of a mask, each named by the place y * width + x of its first pixel."""
    m = mask.select(*keys, "y", "x").distinct().withColumn("node_id", F.col("y") * width + F.col("x"))
    steps = HALF_SQUARE if diagonal else HALF_CROSS
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    e = m.withColumn("o", near).select(*keys, F.col("node_id").alias("src"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    e = e.join(m.withColumnRenamed("node_id", "dst"), [*keys, "y", "x"]).select(*keys, "src", "dst")
    c = connected_components(m, e, keys)
    return m.join(c, [*keys, "node_id"]).select(*keys, "y", "x", F.col("component").alias("region_id"))


def dense(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """One image's mask as an array that just holds it, and where that starts."""
    y0, x0 = int(y.min()), int(x.min())
    m = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), bool)
    m[y - y0, x - x0] = True
    return m, y0, x0


def columns(pixels: pa.ListScalar) -> list[np.ndarray]:
    """The fields of a list of structs as arrays, and the number of structs."""
    s = pixels.values
    return [*(s.field(i).to_numpy(zero_copy_only=False) for i in range(s.type.num_fields)), len(s)]


def label_images(mask: DataFrame, width: int, diagonal: bool = True, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """label_mask() for images that fit a task each: one shuffle by image instead of rounds over the whole table.

    Repeated pixels count once, an empty mask gives no rows, other columns are dropped.
    """
    head = ", ".join(f"`{c}` {mask.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, ys, xs, names = [], [], [], []
                for k, pixels in enumerate(b.column(len(keys))):
                    y, x, _ = columns(pixels)
                    m, y0, x0 = dense(y, x)
                    parts = kernels.label(m, diagonal)
                    y, x = np.nonzero(parts)
                    n = parts[y, x]
                    _, first = np.unique(n, return_index=True)
                    rows.append(np.full(len(y), k))
                    ys.append(y + y0)
                    xs.append(x + x0)
                    names.append(((y[first] + y0) * width + x[first] + x0)[n - 1])
                took = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
                flat = [pa.array(np.concatenate(c).astype(np.int32)) if c else pa.array([], pa.int32()) for c in (ys, xs, names)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(took) for i in range(len(keys))), *flat], names=[*keys, "y", "x", "region_id"])

    per = mask.groupBy(*keys).agg(F.collect_set(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))).alias("pixels"))  # one image's
    return per.mapInArrow(run, f"{head}, y int, x int, region_id int")


def drop_small(mask: DataFrame, width: int, size: int, diagonal: bool = False, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The mask without parts of fewer than `size` pixels."""
    parts = label_images(mask, width, diagonal, keys)
    large = parts.groupBy(*keys, "region_id").agg(F.count("*").alias("n")).filter(F.col("n") >= size)
    return parts.join(large, [*keys, "region_id"], "left_semi").select(*keys, "y", "x")


def fill_small(mask: DataFrame, images: DataFrame, height: int, width: int, size: int = 64) -> DataFrame:
    """The mask with background parts of fewer than `size` pixels added; an image that is all background becomes a full mask where it is that small."""
    from loomgrain.operators.masks import complement

    own = images.select("image_id").distinct()
    return complement(drop_small(complement(mask, own, height, width), width, size), own, height, width)


def fill_enclosed(mask: DataFrame, images: DataFrame, height: int, width: int, diagonal: bool = False) -> DataFrame:
    """The mask with background parts added that don't touch the frame."""
    from loomgrain.operators.masks import complement

    parts = label_images(complement(mask, images, height, width), width, diagonal)
    frame = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    open_ = parts.filter(frame).select("image_id", "region_id").distinct()
    holes = parts.join(open_, ["image_id", "region_id"], "left_anti").select("image_id", "y", "x")
    return mask.select("image_id", "y", "x").union(holes).distinct()


def drop_small_components(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of components with at least two inner nodes (degree over 1) and two ends (degree 1)."""
    from loomgrain.operators.graphs import node_degree

    c = _cut(connected_components(nodes, edges).join(node_degree(nodes, edges), ["image_id", "node_id"]))
    good = c.groupBy("image_id", "component").agg(F.count_if(F.col("degree") > 1).alias("i"), F.count_if(F.col("degree") == 1).alias("e")).filter("i >= 2 and e >= 2")
    keep = c.join(good, ["image_id", "component"], "left_semi").select("image_id", "node_id")
    kept = nodes.join(keep, ["image_id", "node_id"], "left_semi")
    return kept, edges.join(keep.withColumnRenamed("node_id", "src"), ["image_id", "src"], "left_semi")
