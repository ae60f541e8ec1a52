"""The whole job from stacks to tables, run again with new, changed and missing outputs."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrain.functions import kernels
from loomgrain.operators import graphs, masks
from loomgrain.plans import analysis

SIDE = 40
SCHEMA = "image_id string, channel string, y int, x int, v double"


def stack(name, seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    shg = sum((np.abs(y - a * x - b) < 1.5) * 5.0 for a, b in ((1, 0), (0.2, 10), (-0.6, 34))) + rng.random((SIDE, SIDE)) * 0.2
    pl = ((y - 30) ** 2 + (x - 8) ** 2 < 40) * 6.0 + rng.random((SIDE, SIDE)) * 0.3
    return [(name, str(c), int(i), int(j), float(a[i, j])) for c, a in enumerate((shg, pl, shg + pl + 1)) for i in range(SIDE) for j in range(SIDE)]


HOW = analysis.Settings(SIDE, SIDE, min_sizes=(20, 20), min_fracs=(0.0, 0.0), fire={"nuc_thresh": 1.0}, segmentation={"swap_sizes": (30, 30), "k": 3, "min_object": 4})


def plain(tiles):
    return tiles


def work(plan):
    return {(r.image_id, r.do_network, r.do_segment, r.do_metric) for r in plan.collect() if r.do_network or r.do_segment or r.do_metric}


def stamps(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_only_what_is_missing_is_made(spark, tmp_path):
    one = spark.createDataFrame(stack("a", 1) + stack("b", 2), SCHEMA)
    folder = tmp_path / "out"

    def run(df, **more):
        return analysis.analyse(df, str(folder), HOW, preprocess=plain, buckets=5, **more)

    tables, plan = run(one)
    assert work(plan) == {(i, True, True, True) for i in "ab"}
    first = {name: {tuple(map(str, r)) for r in t.collect()} for name, t in tables.items()}
    assert {r.image_id for r in tables["global"].collect()} == {"a", "b"} and first["network"] and first["fibre"] and first["cell"]
    before = stamps(folder)
    _, plan = run(one)
    assert work(plan) == set() and stamps(folder) == before  # nothing is written

    two = one.union(spark.createDataFrame(stack("c", 3), SCHEMA))
    gone = spark.createDataFrame([("a",)], "image_id string").select(F.pmod(F.xxhash64("image_id"), F.lit(5)).alias("b")).first().b
    at_home = {r.image_id for r in spark.createDataFrame([("a",), ("b",)], "image_id string").filter(F.pmod(F.xxhash64("image_id"), F.lit(5)) == gone).collect()}
    shutil.rmtree(folder / "segments" / f"bucket={gone}")
    tables, plan = run(two)
    assert work(plan) == {("c", True, True, True)} | {(i, False, True, True) for i in at_home}
    again = {name: {tuple(map(str, r)) for r in t.filter("image_id != 'c'").collect()} for name, t in tables.items()}
    assert {name: len(rows) for name, rows in again.items()} == {name: len(rows) for name, rows in first.items()}
    assert again["network"] == first["network"]


def test_nothing_to_analyse(spark, tmp_path):
    tables, plan = analysis.analyse(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), HOW, preprocess=plain)
    assert tables == {} and plan.count() == 0


def drawn(a, b):
    """The integer line rule, step by step with its error term."""
    dy, dx = abs(b[0] - a[0]), abs(b[1] - a[1])
    steep = dy > dx
    (big, small), (p, q) = ((dy, dx), a) if steep else ((dx, dy), a[::-1])
    sp, sq = (np.sign(b[0] - a[0]), np.sign(b[1] - a[1])) if steep else (np.sign(b[1] - a[1]), np.sign(b[0] - a[0]))
    error, out = 2 * small - big, []
    for _ in range(big):
        out.append((p, q) if steep else (q, p))
        while error >= 0 and big:
            q += sq
            error -= 2 * big
        p += sp
        error += 2 * small
    return out + [tuple(b)]


def test_lines_by_the_integer_rule(spark):
    ends = [(y, x) for y in range(9) for x in range(9)]
    for a in ((0, 0), (8, 8), (4, 4), (3, 8)):
        for b in ends:
            ys, xs = kernels.line(a, b)
            assert [(int(y), int(x)) for y, x in zip(ys, xs)] == drawn(a, b), (a, b)
    nodes = spark.createDataFrame([(k, v, *p) for k, b in enumerate(ends) for v, p in ((0, (4, 4)), (1, b))], "image_id long, node_id long, y int, x int")
    edges = spark.createDataFrame([(k, 0, 1) for k in range(len(ends))], "image_id long, src long, dst long")
    got = {}
    for r in masks.rasterise(nodes, edges).collect():
        got.setdefault(r.image_id, set()).add((r.y, r.x))
    assert all(got[k] == set(drawn((4, 4), b)) for k, b in enumerate(ends))


@pytest.mark.parametrize("together", [True, False])
def test_network_masks(spark, together):
    """Against drawing, widening, blurring and filling on the whole image."""
    places = {0: {0: (2, 2), 1: (2, 17), 2: (12, 17), 3: (12, 2)}, 1: {0: (20, 5), 1: (25, 28)}}
    pairs = {0: [(0, 1), (1, 2), (2, 3), (0, 3)], 1: [(0, 1)]}
    rows = [(7, net, [{"node_id": v, "y": float(y), "x": float(x)} for v, (y, x) in xy.items()], [{"src": a, "dst": b, "r": 1.0} for a, b in pairs[net]]) for net, xy in places.items()]
    parts = spark.createDataFrame(rows, f"image_id long, network_id int, nodes {graphs.NODES}, edges {graphs.EDGES}")
    for area in (30, 64, 200):
        got = masks.network_masks(parts, 30, 30, 2, 0.5, area, by_network=not together).collect()
        for net in [None] if together else places:
            img = np.zeros((30, 30), bool)
            for k in places if together else [net]:
                for a, b in pairs[k]:
                    img[kernels.line(places[k][a], places[k][b])] = True
            want = kernels.fill_small(kernels.gaussian(kernels.dilate(img, 2).astype(float), 0.5, "constant") > 0, area)
            assert {(r.y, r.x) for r in got if net is None or r.network_id == net} == set(zip(*map(np.ndarray.tolist, np.nonzero(want))))


def test_batches_of_a_stream_are_analysed(spark, tmp_path):
    spark.createDataFrame(stack("a", 1), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    more = {"preprocess": plain, "buckets": 2}
    for _ in range(2):  # the second run has nothing new to read
        analysis.analyse_stream(stream, str(tmp_path / "out"), HOW, str(tmp_path / "state"), **more).awaitTermination()
    out = analysis.Outputs(spark, str(tmp_path / "out"), 2)
    assert {r.image_id for r in out.read("global").collect()} == {"a"} and out.read("network").count() >= 1
