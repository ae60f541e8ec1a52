"""Filters on blocks equal those on whole images bit by bit, whatever the blocks' side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrain.functions import kernels
from loomgrain.operators import blocks
from loomgrain.plans.base import mosaics
from loomgrain.sources.stages import kept


def images():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:23, 0:31]
    lines = (np.abs((x - y) % 9) < 2) * 5 + rng.random((23, 31))
    holed = (rng.random((23, 31)) > 0.2).astype(float)
    holed[5:18, 6:20] = 1
    return {"lines": lines, "noise": rng.standard_normal((23, 31)), "holed": holed, "flat": np.ones((9, 5)), "thin": rng.random((1, 17)) + 0.1, "full": np.ones((8, 12))}


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(name, "0", y, x, float(a[y, x])) for name, a in images().items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id string, channel string, y int, x int, v double").cache()


def arrays(df, side):
    out = {}
    for r in df.collect():
        a = out.setdefault(r.image_id, np.full((r.height, r.width), np.nan))
        y, x = r.by * side, r.bx * side
        a[y : y + side, x : x + side] = np.reshape(r.data, a[y : y + side, x : x + side].shape)
    return out


LOCAL = {
    "gaussian": (lambda b, s: blocks.gaussian(b, s, 1.5), lambda a: kernels.gaussian(a, 1.5)),
    "tubeness": (lambda b, s: blocks.tubeness(b, s, 2), lambda a: kernels.tubeness(a, 2)),
    "median": (lambda b, s: blocks.median_filter(b, s, 3, 2), lambda a: kernels.square_median(kernels.square_median(a))),
    "dilate": (lambda b, s: blocks.dilate(b, s, 2), lambda a: kernels.dilate(a > 0, 2)),
    "closed": (lambda b, s: blocks.closed(b, s, 2), lambda a: kernels.erode(kernels.dilate(a > 0, 2), 2)),
    "opened": (lambda b, s: blocks.opened(b, s, 1), lambda a: kernels.dilate(kernels.erode(a > 0, 1), 1)),
    "distance": (lambda b, s: blocks.distance_transform(b, s, 5), lambda a: kernels.distance_transform(a > 0)),
    "hysteresis": (lambda b, s: blocks.hysteresis(b, s, 0.9), lambda a: kernels.hysteresis(a, 0.9)),
}


@pytest.mark.parametrize("name", sorted(LOCAL))
@pytest.mark.parametrize("side", [3, 8, 40])
def test_blocks_equal_whole_images(pixels, name, side):
    if name == "tubeness":
        pixels = pixels.filter("image_id != 'thin'")  # second derivatives need two rows
    on_blocks, whole = LOCAL[name]
    got = arrays(on_blocks(blocks.blocks_of(pixels, side), side), side)
    for k, a in images().items():
        if k in got or name != "tubeness":
            assert np.array_equal(got[k], np.asarray(whole(a), float)), k


def test_mosaics(spark):
    sf, side = "/root/testdata/sf0.001", 24
    t = mosaics(spark, sf).cache()
    px = t.select("image_id", "channel", F.posexplode("data").alias("i", "v")).select("image_id", "channel", F.floor(F.col("i") / 64).cast("int").alias("y"), (F.col("i") % 64).cast("int").alias("x"), "v")
    whole = {r.image_id: np.array(r.data).reshape(r.height, r.width) for r in t.collect()}
    b = blocks.blocks_of(px, side).cache()
    for on_blocks, on_whole in ((lambda: blocks.gaussian(b, side, 2.0), lambda a: kernels.gaussian(a, 2.0)), (lambda: blocks.hysteresis(blocks.tubeness(b, side), side), lambda a: kernels.hysteresis(kernels.tubeness(a)))):
        got = arrays(on_blocks(), side)
        assert got.keys() == whole.keys() and all(np.array_equal(got[k], on_whole(a)) for k, a in whole.items())


def test_labels_over_borders(spark):
    """A spiral is one part, though its blocks hold several pieces each."""
    m = np.zeros((15, 15), bool)
    y = x = 0
    dy, dx, left, top = 0, 1, 14, 14
    m[0, :] = m[:, 14] = m[14, :] = True
    m[2:, 0] = True
    m[2, 0:13] = m[2:13, 12] = m[12, 2:13] = m[4:13, 2] = True
    pixels = spark.createDataFrame([(1, "0", r, c, float(m[r, c])) for r in range(15) for c in range(15)], "image_id int, channel string, y int, x int, v double")
    _, parts = blocks.label_blocks(blocks.blocks_of(pixels, 4), 4, False)
    want = kernels.label(m, False).max()
    assert parts.select("component").distinct().count() == want and parts.count() > want


def test_missing_and_empty(spark, pixels):
    b = blocks.blocks_of(pixels, 8)
    assert blocks.gaussian(b.filter("false"), 8, 1.0).count() == 0
    assert blocks.hysteresis(b.filter("false"), 8).count() == 0
    with pytest.raises(Exception, match="missing"):
        blocks.gaussian(b.filter("not (image_id = 'lines' and by = 1 and bx = 1)"), 8, 1.0).count()
    again = blocks.pixels_of_blocks(b, 8).select(*pixels.columns)
    assert again.exceptAll(pixels.select(*pixels.columns)).count() == 0 and again.count() == pixels.count()


def test_thresholds_of_large_images(pixels):
    """Images beyond what fits go by rounds over blocks, the others in one pass; both as the whole image."""
    on_blocks = blocks.hysteresis(blocks.blocks_of(pixels, 8), 8, 0.9, fits=100)
    got = arrays(on_blocks, 8)
    assert all(np.array_equal(got[k], kernels.hysteresis(a, 0.9).astype(float)) for k, a in images().items())


def test_thresholds_take_no_rounds(spark, pixels):
    """Images that fit take a fixed number of jobs, and no table of images is sent to the driver and on to all tasks."""
    b, sc = kept(blocks.blocks_of(pixels, 8), "test-blocks"), spark.sparkContext
    sc.setJobGroup("limits", "")
    limits = blocks.thresholds(b, 8, 0.9)
    limits.collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("limits")) <= 4
    met = blocks._with(b, limits)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_joined_by_way_of_the_driver(spark, pixels):
    """Kept tables look small to Spark, as their files are compressed: still no join sends one to the driver and on to all."""
    from loomgrain.operators import components

    store = spark._jsparkSession.sharedState().statusStore()
    blocks_ = kept(blocks.blocks_of(pixels, 8), "test-blocks")
    before = store.executionsCount()
    assert blocks.hysteresis(blocks_, 8, 0.9).count() == blocks_.count()
    n, e = spark.range(40).toDF("node_id"), spark.range(39).selectExpr("id as src", "id + 1 as dst").filter("src != 20")
    assert components.connected_components(n, e, ()).select("component").distinct().count() == 2
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_a_field_is_filtered_once(spark):
    """An 8 x 8 image in blocks of 3 goes through a far-reaching kernel once, not once a block."""
    calls = spark.sparkContext.accumulator(0)
    rows = [(i, "0", y, x, float(i + y * x)) for i in range(20) for y in range(8) for x in range(8)]
    b = blocks.blocks_of(spark.createDataFrame(rows, "image_id int, channel string, y int, x int, v double"), 3)

    def kernel(a):
        calls.add(len(a))
        return kernels.tubeness(a, 3)

    assert blocks.map_blocks(b, 3, 14, kernel).count() == 180
    assert calls.value == 20
