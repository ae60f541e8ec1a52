"""Filters on images too large for a task: square blocks that lend each other what a filter reaches over their borders.

blocks: (image_id, channel, height, width, by, bx, data), height and width those of the whole image, block (by, bx) its
part from row by * side and column bx * side on, at most side by side, row-major. Every block of an image must be there
and none may be null; that is checked. All results equal those of the filters on whole images (operators.stencils) bit
by bit, whatever the side. Images without rows give none, channels are apart, image ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import kernels
from loomgrain.operators.components import FITS, connected_components
from loomgrain.operators.stencils import STACK
from loomgrain.sources.stages import dealt, kept

KEYS = ["image_id", "channel", "height", "width"]
#: Copies of an image's thresholds, so that one image's blocks are dealt over as many tasks.
SALTS = 64


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([f"image_id {df.schema['image_id'].dataType.simpleString()}", "channel string", "height int", "width int", *more])


def _values(c: pa.Array) -> Callable[[int], object]:
    """The i-th value of a column: lists of numbers as numpy arrays that share its memory, lists of structs as dicts."""
    kind = c.type
    if not pa.types.is_list(kind) or not (pa.types.is_floating(kind.value_type) or pa.types.is_struct(kind.value_type)):
        return c.to_pylist().__getitem__
    ends, there = c.offsets.to_pylist(), c.is_valid().to_pylist()
    if pa.types.is_floating(kind.value_type):
        flat = c.values.to_numpy(zero_copy_only=False)
        return lambda i: flat[ends[i] : ends[i + 1]] if there[i] else None
    fields = {f.name: _values(c.values.field(k)) for k, f in enumerate(kind.value_type)}
    return lambda i: [{name: get(j) for name, get in fields.items()} for j in range(ends[i], ends[i + 1])] if there[i] else None


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, one at a time, so that a batch isn't held twice."""
    for at in range(0, b.num_rows, 256):
        part = b.slice(at, 256)
        columns = {name: _values(c) for name, c in zip(b.schema.names, part.columns, strict=True)}
        for i in range(part.num_rows):
            yield {name: get(i) for name, get in columns.items()}


#: Numbers that a pass over rows holds of what it makes, before it passes them on.
HELD = 1 << 18


def _mapped(df: DataFrame, step: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """step(row) -> rows over df in one Arrow pass; what is made is passed on at 1,024 rows or HELD numbers."""

    def steps(rows: Iterator[dict]) -> Iterator[list[dict]]:
        yield from map(step, rows)

    return _mapped_rows(df, steps, schema)


def _mapped_rows(df: DataFrame, steps: Callable[[Iterator[dict]], Iterator[list[dict]]], schema: str) -> DataFrame:
    """_mapped() of a step that takes the rows of a batch in turn and may see several before it gives theirs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for made in steps(_rows(b)):
                out += made
                size += sum(len(v) for row in made for v in row.values() if isinstance(v, (np.ndarray, list)))
                if len(out) >= 1024 or size >= HELD:
                    yield _batch(out, arrow)
                    out, size = [], 0
            if out:
                yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def blocks_of(pixels: DataFrame, side: int, sizes: DataFrame | None = None) -> DataFrame:
    """Blocks from pixels (image_id, channel, y, x, v), of which every one is there.

    sizes: (image_id, channel, height, width) where it is known; else it comes from the largest y and x.
    """
    if sizes is None:
        sizes = pixels.groupBy("image_id", "channel").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    place = (F.floor(F.col("y") / side).cast("int").alias("by"), F.floor(F.col("x") / side).cast("int").alias("bx"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"].cast("double"))
    b = pixels.select("image_id", "channel", *place, "y", "x", "v").groupBy("image_id", "channel", "by", "bx").agg(ordered.alias("data"))
    return b.join(sizes, ["image_id", "channel"]).select("image_id", F.col("channel").cast("string").alias("channel"), F.col("height").cast("int"), F.col("width").cast("int"), "by", "bx", "data")


def pixels_of_blocks(blocks: DataFrame, side: int) -> DataFrame:
    """(image_id, channel, y, x, v)."""
    wide = F.least(F.lit(side), F.col("width") - F.col("bx") * side)
    p = blocks.select("image_id", "channel", "by", "bx", wide.alias("wide"), F.posexplode("data").alias("i", "v"))
    return p.select("image_id", "channel", (F.col("by") * side + F.floor(F.col("i") / F.col("wide"))).cast("int").alias("y"), (F.col("bx") * side + F.col("i") % F.col("wide")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def _extent(k: int, side: int, size: int, reach: int = 0) -> tuple[int, int]:
    """Rows (or columns) of block k and `reach` more on either side, within the image."""
    return max(0, k * side - reach), min(size, (k + 1) * side + reach)


def _square(row: dict, side: int) -> np.ndarray:
    y0, y1 = _extent(row["by"], side, row["height"])
    x0, x1 = _extent(row["bx"], side, row["width"])
    if row["data"] is None or len(row["data"]) != (y1 - y0) * (x1 - x0):
        raise ValueError(f"block {row['by']}, {row['bx']} of image {row['image_id']} isn't whole")
    return np.asarray(row["data"], float).reshape(y1 - y0, x1 - x0)


def map_blocks(blocks: DataFrame, side: int, reach: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """blocks with kernel(image) in place of data, for kernels that see no further than `reach` pixels.

    Small blocks are filtered together in fields of at least four reaches, so that a pixel isn't filtered many times as
    some block's surroundings. Each block sends the fields beside its own the strips that they need, which is all that is
    shuffled beside the blocks; each field puts together what it gets, is filtered with the image's own border where that
    is near, and is cut into its blocks again. Fields of one size go through the kernel as one stack (n, height, width).
    """
    many = max(1, -(-4 * reach // side))
    field = many * side

    def send(row: dict) -> list[dict]:
        a, out = _square(row, side), []
        y0, x0 = row["by"] * side, row["bx"] * side
        y1, x1 = y0 + a.shape[0], x0 + a.shape[1]
        last_y, last_x = (row["height"] - 1) // field, (row["width"] - 1) // field
        for fy in range(max(0, (y0 - reach) // field), min(last_y, (y1 - 1 + reach) // field) + 1):
            for fx in range(max(0, (x0 - reach) // field), min(last_x, (x1 - 1 + reach) // field) + 1):
                (ya, yb), (xa, xb) = _extent(fy, field, row["height"], reach), _extent(fx, field, row["width"], reach)
                part = a[max(ya - y0, 0) : max(yb - y0, 0), max(xa - x0, 0) : max(xb - x0, 0)]
                out.append({**{k: row[k] for k in KEYS}, "fy": fy, "fx": fx, "y": max(ya, y0), "x": max(xa, x0), "h": part.shape[0], "w": part.shape[1], "part": part.ravel()})
        return out

    def put(row: dict) -> np.ndarray:
        (ya, yb), (xa, xb) = _extent(row["fy"], field, row["height"], reach), _extent(row["fx"], field, row["width"], reach)
        a, filled = np.zeros((yb - ya, xb - xa)), 0
        for p in row["parts"]:
            a[p["y"] - ya : p["y"] - ya + p["h"], p["x"] - xa : p["x"] - xa + p["w"]] = p["part"].reshape(p["h"], p["w"])
            filled += p["h"] * p["w"]
        if filled != a.size:
            raise ValueError(f"blocks around {row['fy'] * many}, {row['fx'] * many} of image {row['image_id']} are missing or repeated")
        return a

    def cut(row: dict, done: np.ndarray) -> list[dict]:
        ya, xa = _extent(row["fy"], field, row["height"], reach)[0], _extent(row["fx"], field, row["width"], reach)[0]
        out = []
        for by in range(row["fy"] * many, min((row["fy"] + 1) * many, -(-row["height"] // side))):
            for bx in range(row["fx"] * many, min((row["fx"] + 1) * many, -(-row["width"] // side))):
                (y0, y1), (x0, x1) = _extent(by, side, row["height"]), _extent(bx, side, row["width"])
                out.append({**{k: row[k] for k in KEYS}, "by": by, "bx": bx, "data": done[y0 - ya : y1 - ya, x0 - xa : x1 - xa].ravel()})
        return out

    def filtered(rows: Iterator[dict]) -> Iterator[list[dict]]:
        waiting: dict[tuple, list] = {}

        def some(shape: tuple) -> Iterator[list[dict]]:
            own = waiting.pop(shape)
            done = np.asarray(kernel(np.stack([a for _, a in own])), float)
            for (row, _), d in zip(own, done, strict=True):
                yield cut(row, d)

        for row in rows:
            a = put(row)
            waiting.setdefault(a.shape, []).append(({k: row[k] for k in (*KEYS, "fy", "fx")}, a))
            if sum(len(own) * h * w for (h, w), own in waiting.items()) >= STACK:
                for shape in list(waiting):
                    yield from some(shape)
        for shape in list(waiting):
            yield from some(shape)

    src = blocks.select(*KEYS, "by", "bx", F.col("data").cast("array<double>").alias("data"))
    sent = _mapped(src, send, _schema(blocks, "fy int", "fx int", "y int", "x int", "h int", "w int", "part array<double>"))
    met = sent.groupBy(*KEYS, "fy", "fx").agg(F.collect_list(F.struct("y", "x", "h", "w", "part")).alias("parts"))  # a field's
    return _mapped_rows(met, filtered, _schema(blocks, "by int", "bx int", "data array<double>"))


def gaussian(blocks: DataFrame, side: int, sigma: float) -> DataFrame:
    return map_blocks(blocks, side, int(4 * sigma + 0.5), lambda a: kernels.gaussian(a, sigma))


def tubeness(blocks: DataFrame, side: int, sigma_max: int = 3) -> DataFrame:
    return map_blocks(blocks, side, int(4 * sigma_max + 0.5) + 2, lambda a: kernels.tubeness(a, sigma_max))


def median_filter(blocks: DataFrame, side: int, size: int = 3, times: int = 1) -> DataFrame:
    def run(a: np.ndarray) -> np.ndarray:
        for _ in range(times):
            a = kernels.square_median(a, size)
        return a

    return map_blocks(blocks, side, size // 2 * times, run)


def dilate(blocks: DataFrame, side: int, times: int = 1) -> DataFrame:
    return map_blocks(blocks, side, times, lambda a: kernels.dilate(a > 0, times))


def erode(blocks: DataFrame, side: int, times: int = 1) -> DataFrame:
    return map_blocks(blocks, side, times, lambda a: kernels.erode(a > 0, times))


def opened(blocks: DataFrame, side: int, times: int = 1) -> DataFrame:
    return map_blocks(blocks, side, 2 * times, lambda a: kernels.dilate(kernels.erode(a > 0, times), times))


def closed(blocks: DataFrame, side: int, times: int = 1) -> DataFrame:
    return map_blocks(blocks, side, 2 * times, lambda a: kernels.erode(kernels.dilate(a > 0, times), times))


# ---------------------------------------------------------------- what the whole image decides


def _with(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """blocks joined with columns of their image, images (KEYS, ...); those of one beyond FITS pixels over up to SALTS keys.

    Both sides are dealt: images are as many as blocks of one, so neither may go to the driver and to all tasks whole.
    """
    size = F.col("height").cast("long") * F.col("width")
    salts = F.least(F.lit(SALTS), F.lit(1) + F.floor(size / FITS)).cast("int")
    salted = blocks.withColumn("__s", F.pmod(F.xxhash64("by", "bx"), salts).cast("int"))
    each = images.withColumn("__s", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(dealt(each), [*KEYS, "__s"]).drop("__s")


def smallest_gap(blocks: DataFrame) -> DataFrame:
    """(image_id, channel, gap): the least difference of two distinct values of an image; null for a constant one.

    Values are sorted over all tasks; a task passes on its images' least gap, first and last value.
    """
    v = blocks.select("image_id", "channel", F.explode("data").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).distinct()
    dealt = v.repartitionByRange("image_id", "channel", "v").withColumn("part", F.spark_partition_id())
    before = F.lag("v").over(Window.partitionBy("part", "image_id", "channel").orderBy("v"))
    per = dealt.withColumn("gap", F.col("v") - before).groupBy("part", "image_id", "channel").agg(F.min("gap").alias("gap"), F.min("v").alias("first"), F.max("v").alias("last"))
    between = F.col("first") - F.lag("last").over(Window.partitionBy("image_id", "channel").orderBy("first"))
    return per.withColumn("between", between).groupBy("image_id", "channel").agg(F.least(F.min("gap"), F.min("between")).alias("gap"))


def thresholds(blocks: DataFrame, side: int, alpha: float = 1.0, rounds: int = 1000, fits: int = FITS) -> DataFrame:
    """(image_id, channel, height, width, low, high) of hysteresis(): its two thresholds. blocks are read several times.

    Images of up to `fits` pixels are put together, each in one task, all in one pass. Those of larger ones come from sums
    and counts of blocks, see thresholds_by_rounds().
    """
    size = F.col("height").cast("long") * F.col("width")
    small, large = blocks.filter(size <= fits), blocks.filter(size > fits)

    def whole(row: dict) -> list[dict]:
        a = np.full((row["height"], row["width"]), np.nan)
        filled = 0
        for p in row["parts"]:
            part = _square({**row, **p}, side)
            y, x = p["by"] * side, p["bx"] * side
            a[y : y + part.shape[0], x : x + part.shape[1]] = part
            filled += part.size
        if filled != a.size:
            raise ValueError(f"blocks of image {row['image_id']} are missing or repeated")
        low, high = kernels.hysteresis_limits(a, alpha)
        return [{**{k: row[k] for k in KEYS}, "low": low, "high": high}]

    parts = small.groupBy(*KEYS).agg(F.collect_list(F.struct("by", "bx", F.col("data").cast("array<double>").alias("data"))).alias("parts"))  # one image's, `fits` pixels at most
    done = _mapped(parts, whole, _schema(blocks, "low double", "high double"))
    return done if large.isEmpty() else done.unionByName(thresholds_by_rounds(kept(large, "large"), alpha, rounds))


def thresholds_by_rounds(blocks: DataFrame, alpha: float = 1.0, rounds: int = 1000) -> DataFrame:
    """thresholds() of images of any size, from sums and counts of blocks.

    The fixed point of the cross-entropy threshold takes a pass over the blocks a round, all images together, until no
    image moves by half its smallest gap; the other one takes a histogram of 256 bins between the image's extremes.
    """
    keys = KEYS

    def part(step: Callable[[np.ndarray, dict], dict], *extra: str):
        return lambda row: [{**{k: row[k] for k in KEYS}, **step(np.asarray(row["data"], float), row)}]

    basics = _mapped(blocks, part(lambda a, r: {"s": float(a.sum()), "n": a.size, "lo": float(a.min()), "hi": float(a.max())}), _schema(blocks, "s double", "n long", "lo double", "hi double"))
    base = basics.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    base = kept(base.join(smallest_gap(blocks), ["image_id", "channel"]), "image-range")
    state = base.select(*keys, "lo", (F.col("gap") / 2).alias("tolerance"), (F.col("mean") - F.col("lo")).alias("t"), (F.col("lo") == F.col("hi")).alias("done"))
    state = kept(state, "threshold")

    def sides(a: np.ndarray, r: dict) -> dict:
        v = a - r["lo"]
        above = v > r["t"]
        return {"sa": float(v[above].sum()), "na": int(above.sum()), "sb": float(v[~above].sum()), "nb": int((~above).sum())}

    for _ in range(rounds):
        open_ = state.filter(~F.col("done"))
        if open_.isEmpty():
            break
        sums = _mapped(_with(blocks, open_.select(*keys, "lo", "t")), part(sides), _schema(blocks, "sa double", "na long", "sb double", "nb long"))
        s = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("sa", "na", "sb", "nb")])
        front, back = F.col("sa") / F.nullif("na", F.lit(0)), F.col("sb") / F.nullif("nb", F.lit(0))
        new = F.when((F.col("na") > 0) & (F.col("nb") > 0) & (F.col("sb") > 0), (back - front) / (F.log(back) - F.log(front)))
        moved = state.join(s, keys, "left").select(*keys, "lo", "tolerance", F.when(F.col("done"), F.col("t")).otherwise(F.coalesce(new, "t")).alias("t"), (F.col("done") | new.isNull() | (F.abs(new - F.col("t")) <= F.col("tolerance"))).alias("done"))
        state = kept(moved, "threshold")
    li = state.select(*keys, F.when(F.col("tolerance").isNull(), F.col("lo")).otherwise(F.col("t") + F.col("lo")).alias("li"))

    def histogram(a: np.ndarray, r: dict) -> dict:
        return {"lo": r["lo"], "hi": r["hi"], "counts": np.histogram(a, 256, (r["lo"], r["hi"]))[0].tolist()}

    bins = _mapped(_with(blocks, base.filter("lo < hi").select(*keys, "lo", "hi")), part(histogram), _schema(blocks, "lo double", "hi double", "counts array<long>"))
    bins = bins.groupBy(*keys, "lo", "hi").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(256)]).alias("counts"))
    iso = _mapped(bins, lambda r: [{**{k: r[k] for k in KEYS}, "high": kernels.isodata_of(np.array(r["counts"]), r["lo"], r["hi"])}], _schema(blocks, "high double"))
    t = base.join(li, keys).join(iso, keys, "left").withColumn("high", F.coalesce("high", "lo"))
    return t.select(*keys, F.least(F.lit(alpha) * F.col("mean"), F.col("li"), F.col("high")).alias("low"), "high")


def label_blocks(blocks: DataFrame, side: int, diagonal: bool = True) -> tuple[DataFrame, DataFrame]:
    """(labels, parts): connected parts of pixels above 0, over block borders too.

    labels are blocks whose data number the parts of each block by itself from 1 (0: none); parts (image_id, channel, by,
    bx, label, component) say which belong together: component is the smallest (by, bx, label), as a long, of them. Only
    pixels along block borders meet by a join; the rest is one pass and connected_components() over the blocks' parts.
    """
    numbered = _mapped(blocks, lambda r: [{**{k: r[k] for k in (*KEYS, "by", "bx")}, "data": kernels.label(_square(r, side) > 0, diagonal).ravel().astype(float)}], _schema(blocks, "by int", "bx int", "data array<double>"))
    numbered = kept(numbered, "labels")
    across = F.ceil(F.col("width") / side).cast("long")
    node = ((F.col("by") * across + F.col("bx")) * (side * side + 1) + F.col("label")).cast("long")

    def borders(row: dict) -> list[dict]:
        a = _square(row, side)
        h, w = a.shape
        ys, xs = np.nonzero(a)
        on = (ys == 0) | (xs == 0) | (ys == h - 1) | (xs == w - 1)
        return [{**{k: row[k] for k in (*KEYS, "by", "bx")}, "ys": (ys[on] + row["by"] * side).tolist(), "xs": (xs[on] + row["bx"] * side).tolist(), "labels": a[ys[on], xs[on]].astype(int).tolist(), "n": int(a.max(initial=0))}]

    edge = kept(_mapped(numbered, borders, _schema(blocks, "by int", "bx int", "ys array<int>", "xs array<int>", "labels array<int>", "n int")), "borders")
    parts = edge.filter("n > 0").select(*KEYS, "by", "bx", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("label")).withColumn("node_id", node)
    rim = edge.select(*KEYS, "by", "bx", F.explode(F.arrays_zip("ys", "xs", "labels")).alias("p")).select(*KEYS, "by", "bx", F.col("p.ys").alias("y"), F.col("p.xs").alias("x"), F.col("p.labels").alias("label")).withColumn("node_id", node)
    steps = ((0, 1), (1, -1), (1, 0), (1, 1)) if diagonal else ((0, 1), (1, 0))
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    there = rim.withColumn("o", near).select("image_id", "channel", "by", "bx", F.col("node_id").alias("src"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    here = rim.select("image_id", "channel", F.col("by").alias("by_"), F.col("bx").alias("bx_"), F.col("node_id").alias("dst"), "y", "x")
    pairs = there.join(dealt(here), ["image_id", "channel", "y", "x"]).filter("by != by_ or bx != bx_").select("image_id", "channel", "src", "dst").distinct()
    found = connected_components(parts, pairs, ("image_id", "channel"))
    return numbered, parts.join(dealt(found), ["image_id", "channel", "node_id"]).select("image_id", "channel", "by", "bx", "label", "component")


def hysteresis(blocks: DataFrame, side: int, alpha: float = 1.0, fits: int = FITS) -> DataFrame:
    """blocks with 1 where 4-connected parts above the low threshold hold a value above the high one, else 0.

    fits: see thresholds().
    """
    blocks = kept(blocks, "blocks")
    limits = kept(thresholds(blocks, side, alpha, fits=fits), "limits")
    met = kept(_with(blocks, limits), "limited")
    weak = _mapped(met, lambda r: [{**{k: r[k] for k in (*KEYS, "by", "bx")}, "data": (np.asarray(r["data"]) > r["low"]).astype(float)}], _schema(blocks, "by int", "bx int", "data array<double>"))
    labels, parts = label_blocks(weak, side, False)
    both = labels.withColumnRenamed("data", "labels").join(dealt(met), [*KEYS, "by", "bx"])

    def strong(row: dict) -> list[dict]:
        n = np.asarray(row["labels"]).astype(int)
        return [{"image_id": row["image_id"], "channel": row["channel"], "by": row["by"], "bx": row["bx"], "label": int(k)} for k in np.unique(n[(np.asarray(row["data"]) > row["high"]) & (n > 0)])]

    hit = _mapped(both, strong, _schema(blocks).split(", height")[0] + ", by int, bx int, label int")
    good = parts.join(dealt(hit), ["image_id", "channel", "by", "bx", "label"]).select("image_id", "channel", "component").distinct()
    keep = parts.join(dealt(good), ["image_id", "channel", "component"]).groupBy("image_id", "channel", "by", "bx").agg(F.collect_list("label").alias("keep"))  # one block's labels
    last = labels.join(dealt(keep), ["image_id", "channel", "by", "bx"], "left")
    return _mapped(last, lambda r: [{**{k: r[k] for k in (*KEYS, "by", "bx")}, "data": np.isin(np.asarray(r["data"]), r["keep"] or [-1]).astype(float)}], _schema(blocks, "by int", "bx int", "data array<double>"))


def distance_transform(blocks: DataFrame, side: int, strip: int = 64) -> DataFrame:
    """blocks of the distances of pixels above 0 to the nearest that isn't (infinite in an image without any).

    Two keyed passes over strips, which must fit a task: along columns, `strip` of them at the image's full height; then
    along rows, `strip` of them at its full width, where for each step sideways the squares are compared, as far as any
    distance found yet.
    """
    strip = min(strip, side)

    def cut(row: dict, across: bool) -> list[dict]:
        a = _square(row, side)
        a = a if across else a.T
        y0, x0 = (row["by"], row["bx"]) if across else (row["bx"], row["by"])
        return [{**{k: row[k] for k in KEYS}, "strip": y0 * -(-side // strip) + s // strip, "at": y0 * side + s, "to": x0 * side, "h": a[s : s + strip].shape[0], "w": a.shape[1], "part": a[s : s + strip].ravel()} for s in range(0, a.shape[0], strip)]

    def assembled(row: dict) -> tuple[np.ndarray, int]:
        first = min(p["at"] for p in row["parts"])
        out = np.zeros((max(p["at"] + p["h"] for p in row["parts"]) - first, max(p["to"] + p["w"] for p in row["parts"])))
        for p in row["parts"]:
            out[p["at"] - first : p["at"] - first + p["h"], p["to"] : p["to"] + p["w"]] = np.reshape(p["part"], (p["h"], p["w"]))
        return out, first

    def back(row: dict, a: np.ndarray, first: int, across: bool) -> list[dict]:
        """Strips by block column (or row): parts of the blocks they came from."""
        out = []
        for k in range(0, a.shape[1], side):
            part = a[:, k : k + side]
            by, bx = (first // side, k // side) if across else (k // side, first // side)
            y, x = (first, k) if across else (k, first)
            part = part if across else part.T
            out.append({**{c: row[c] for c in KEYS}, "by": by, "bx": bx, "y": y, "x": x, "h": part.shape[0], "w": part.shape[1], "part": part.ravel()})
        return out

    def down(row: dict) -> list[dict]:
        a, first = assembled(row)  # columns lie along the second axis
        far = np.where(a > 0, np.inf, 0.0)
        for y in range(1, far.shape[1]):
            far[:, y] = np.minimum(far[:, y], far[:, y - 1] + 1)
        for y in range(far.shape[1] - 2, -1, -1):
            far[:, y] = np.minimum(far[:, y], far[:, y + 1] + 1)
        return back(row, far, first, False)

    def sideways(row: dict) -> list[dict]:
        a, first = assembled(row)
        return back(row, kernels.row_distances(a), first, True)

    def put(row: dict) -> list[dict]:
        (y0, y1), (x0, x1) = _extent(row["by"], side, row["height"]), _extent(row["bx"], side, row["width"])
        a = np.zeros((y1 - y0, x1 - x0))
        for p in row["parts"]:
            a[p["y"] - y0 : p["y"] - y0 + p["h"], p["x"] - x0 : p["x"] - x0 + p["w"]] = np.reshape(p["part"], (p["h"], p["w"]))
        return [{**{k: row[k] for k in (*KEYS, "by", "bx")}, "data": a.ravel()}]

    piece = ("at int", "to int", "h int", "w int", "part array<double>")
    home = ("by int", "bx int", "y int", "x int", "h int", "w int", "part array<double>")
    out = blocks.select(*KEYS, "by", "bx", "data")
    for across, step in ((False, down), (True, sideways)):
        pieces = _mapped(out, lambda r, across=across: cut(r, across), _schema(blocks, "strip int", *piece))
        strips = pieces.groupBy(*KEYS, "strip").agg(F.collect_list(F.struct("at", "to", "h", "w", "part")).alias("parts"))
        done = _mapped(strips, step, _schema(blocks, *home))
        out = _mapped(done.groupBy(*KEYS, "by", "bx").agg(F.collect_list(F.struct("y", "x", "h", "w", "part")).alias("parts")), put, _schema(blocks, "by int", "bx int", "data array<double>"))
    return out


