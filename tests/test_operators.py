"""Published expected values of the table operators, on tiny tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrain.functions import pixels as px
from loomgrain.functions import stats
from loomgrain.operators import clusters, components, graphs, masks, regions, stencils
from loomgrain.plans import jobs
from loomgrain.sources import files, tables


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def probe(spark):
    """10 x 10 with a vertical and a horizontal bar that cross, and a short bar."""
    v = {}
    for y in range(6):
        v[y, 4] = v.get((y, 4), 0) + 2.0
    for x in range(4, 8):
        v[2, x] = v.get((2, x), 0) + 5.0
    for x in range(1, 4):
        v[8, x] = 10.0
    return table(spark, [(1, "0", y, x, v.get((y, x), 0.0)) for y in range(10) for x in range(10)], "image_id long, channel string, y int, x int, v double").cache()


def test_clip(spark):
    rows = [(1, "0", y, x, 10.0 if y == x == 2 else 5.0 if y == x == 1 else 1.0) for y in range(5) for x in range(5)]
    p = table(spark, rows, "image_id long, channel string, y int, x int, v double")
    got = {(r.y, r.x): r.v for r in px.clip_intensities(p, 1, 95).collect()}
    assert (got[2, 2], got[1, 1]) == pytest.approx((4.2, 4.2))
    got = {(r.y, r.x): r.v for r in px.clip_intensities(p, 1, 96).collect()}
    assert (got[2, 2], got[1, 1]) == pytest.approx((5.2, 5.0))


def test_tensor_analysis(spark):
    t = table(spark, [(0, 1.0, 0.0, 1.0), (1, 1.0, 0.0, -1.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 0.0, 1.0), (4, 0.0, 1.0, 0.0)], "i int, jxx double, jxy double, jyy double")
    got = [(r.coherence, r.angle, r.energy) for r in px.tensor_analysis(t).orderBy("i").collect()]
    for a, b in zip(got, [(0, 0, 2), (0, 90, 2), (1, 90, 1), (1, 0, 1), (0, 45, 0)], strict=True):
        assert a == pytest.approx(b)


def test_sdi(spark):
    v = table(spark, [(1, float(a), float(i)) for i, a in enumerate((45, 90, 100, 180, 45, 45, 45, 90, 180))], "g long, v double, w double")
    assert stats.angle_sdi(v, ("g",)).first().sdi == pytest.approx(0.01125)
    assert stats.angle_sdi(v, ("g",), bins=10).first().sdi == pytest.approx(0.225)
    assert stats.angle_sdi(v, ("g",), w="w").first().sdi == pytest.approx(0.012)
    assert stats.angle_sdi(v.filter("v = 100"), ("g",)).first().sdi == pytest.approx(1 / 200)


def test_nanmean(spark):
    d = table(spark, [(2.0, 3.0), (3.0, 2.0), (1.0, 5.0), (float("nan"), 1.0), (None, 4.0)], "x double, w double")
    r = d.agg(stats.nanmean(F.col("x")).alias("a"), stats.nanmean(F.col("x"), F.col("w")).alias("b")).first()
    assert (r.a, r.b) == pytest.approx((2, 1.7))


def test_fibre(spark):
    f = table(spark, [(1, 0, 0, s, y, x) for s, (y, x) in enumerate([(0, 0), (1, 1), (2, 2), (2, 3)])], "image_id long, network_id int, fibre_id int, seq int, y int, x int")
    r = stats.fibre_properties(f).first()
    assert (r.length, r.displacement, r.waviness, r.dir_y, r.dir_x, r.angle) == pytest.approx((3.82842712, 3.60555127, 0.94178396, -0.5547002, -0.83205029, 146.30993247))
    one = stats.fibre_properties(f.filter("seq = 0")).first()
    assert one.length == 0 and one.waviness is None and one.angle is None


def test_regions(spark, probe):
    mask = probe.filter("v > 0").select("image_id", "y", "x")
    got = regions.regions(mask, 10, 10, probe).orderBy("rank").collect()
    assert [(r.area, r.filled_area) for r in got] == [(9, 9), (3, 3)]
    assert regions.regions(mask, 10, 10, probe, 4).count() == 1
    only = regions.regions(mask, 10, 10, probe, 0, 3.6).collect()
    assert [r.area for r in only] == [3]
    parts = components.label_mask(mask, 10)
    s = regions.region_shape(parts).filter("area = 9").first()
    assert (s.extent, s.eccentricity, s.circularity) == pytest.approx((0.375, 0.69584728, 1.77245385))
    t = regions.region_texture(parts.join(probe, ["image_id", "y", "x"])).orderBy("mean").first()
    assert (t["mean"], t["std"], t["entropy"]) == pytest.approx((3.55555555, 1.83249138, 1.35164411))


def test_labels_of_an_empty_mask(spark, probe):
    assert components.label_mask(probe.filter("v > 99").select("image_id", "y", "x"), 10).count() == 0


def test_masks(spark):
    m = table(spark, [(1, 2, 2), (1, 2, 3)], "image_id long, y int, x int")
    assert masks.dilate(m, 5, 5, keys=("image_id",)).count() == 8
    assert masks.erode(masks.dilate(m, 5, 5, keys=("image_id",)), 5, 5, keys=("image_id",)).count() == 2
    assert masks.smooth(m, 5, 5, 0.5, keys=("image_id",)).count() == 25


def test_graph(spark):
    n = table(spark, [(1, 2, 0, 0), (1, 3, 1, 1), (1, 4, 2, 2), (1, 5, 2, 3)], "image_id long, node_id long, y int, x int")
    e = table(spark, [(1, 2, 3, math.sqrt(2)), (1, 3, 4, math.sqrt(2)), (1, 4, 5, 1.0)], "image_id long, src long, dst long, r double")
    assert {r.node_id: r.degree for r in graphs.node_degree(n, e).collect()} == {2: 1, 3: 2, 4: 2, 5: 1}
    _, s = graphs.simplify_network(n, e)
    assert [r.r for r in s.collect()] == pytest.approx([3.605551275463989])
    assert graphs.merge_near_nodes(n, e, 1.2)[0].count() == 3
    back_n, back_e = tables.graphs_from_json(tables.graphs_to_json(n.withColumns({"y": F.col("y").cast("double"), "x": F.col("x").cast("double")}), e))
    assert back_n.count() == 4 and {(r.src, r.dst) for r in back_e.collect()} == {(2, 3), (3, 4), (4, 5)}
    assert [r.node_id for r in graphs.assign_fibres(n, e).orderBy("seq").collect()] == [2, 3, 4, 5]


def test_thinning_keeps_the_lowest(spark, probe):
    p = probe.filter("v > 2").select("image_id", (F.col("y") * 10 + F.col("x")).alias("node_id"), "y", "x", F.lit(1.0).alias("w"))
    assert {(r.y, r.x) for r in graphs.reduce_coords(p, 1).collect()} == {(2, 7), (8, 3)}
    assert graphs.reduce_coords(p, 0).count() == p.count()


def test_file_names(spark):
    names = ["a/file-shg.tif", "a/file-pl.tif", "a/full_file-pl-shg.tif", "not/a/file.tif", "d/prefix-display-test.tif", "d/prefix-shg-virada.tif", "d/p-shg-test.png"]
    f = table(spark, list(enumerate(names)), "ord long, path string")
    assert files.image_files(f).count() == 4
    sets = {r.prefix: r for r in files.file_sets(files.image_files(f)).collect()}
    assert set(sets) == {"a/file", "a/full_file"} and sets["a/file"].shg == "a/file-shg.tif"
    acc = table(spark, [("some-file-acc2.tif",), ("some-acc12",), ("some.tif",), (None,)], "path string").select(files.accumulation_number(F.col("path")).alias("n"))
    assert [r.n for r in acc.collect()] == [2, 12, 1, 1]


def test_metadata(spark):
    rows = [("Gamma=1\nGamma=2\n", [20, 20], s) for s in ([2, 20, 20], [2, 3, 20, 20], [2, 20, 20, 2])]
    got = files.laser_meta(table(spark, rows, "description string, xy_dim array<int>, shape array<int>")).collect()
    assert [(r.minor_axis, r.n_modes) for r in got] == [(None, 2), (1, 2), (3, 2)]
    rows = [("images=1\nslices=3\n", [20, 20], s) for s in ([3, 20, 20], [2, 3, 20, 20])]
    got = files.stack_meta(table(spark, rows, "description string, xy_dim array<int>, shape array<int>")).collect()
    assert [(r.minor_axis, r.n_modes) for r in got] == [(0, 1), (1, 2)]


def test_tiles_are_independent_of_partitions(spark, probe):
    t = px.tiles_of(probe)
    many = t.union(t.withColumn("image_id", F.lit(2).cast("long"))).repartition(2)
    got = stencils.gaussian(many, 1.0).orderBy("image_id").collect()
    assert got[0].data == got[1].data
    assert stencils.gaussian(t.filter("image_id = 9"), 1.0).count() == 0


def test_keys_are_dropped(spark):
    d = spark.sql("select named_struct('a', 1, '_b', 2, 'c', array(named_struct('contraction', 3, 'd', 4))) as s")
    assert tables.drop_keys(d, "s").first().s.asDict(recursive=True) == {"a": 1, "c": [{"d": 4}]}


# ---------------------------------------------------------------- segmentation


def test_mean_of_masks(spark, probe):
    """The published 37 pixels: the probe's bars and a diagonal, widened by a pixel."""
    bars = probe.filter("v > 0").select("image_id", F.lit(0).alias("mask_id"), "y", "x")
    diagonal = probe.filter("y = x").select("image_id", F.lit(1).alias("mask_id"), "y", "x")
    assert masks.mean_of_masks(bars.union(diagonal), probe, 0.0, 10, 10).count() == 37
    assert masks.mean_of_masks(bars, probe, 0.0, 10, 10, layers=2, times=0).count() == 12
    assert masks.mean_of_masks(bars, probe, 0.0, 10, 10, area=4, times=0).count() == 9
    assert masks.mean_of_masks(bars.filter("false"), probe, 0.0, 10, 10).count() == 0


def test_region_swap(spark, probe):
    """The published 9 and 3 pixels; a region too small for its side joins the other whatever its size there."""
    bars = probe.filter("v > 0").select("image_id", F.lit(0).alias("mask_id"), "y", "x")
    values = probe.select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("mask_id"), "y", "x", "v")
    got = {r.mask_id: r["count"] for r in regions.region_swap(bars, values, 10, (4, 0), (0, 0)).groupBy("mask_id").count().collect()}
    assert got == {0: 9, 1: 3}
    dark = regions.region_swap(bars, values, 10, (4, 0), (0, 20)).groupBy("mask_id").count().collect()
    assert [(r.mask_id, r["count"]) for r in dark] == [(0, 9)]


def test_region_check(spark, probe):
    b = probe.filter("v > 0").select("image_id", "y", "x", "v")
    m = regions.measured(b, 10, b)
    first = m.filter("area = 9")
    assert first.first().total_v == 32 and regions.passing(first, 9, 3.5, total="total_v").count() == 1
    assert [regions.passing(first, *a, total="total_v").count() for a in ((10,), (0, 3.6), (0, None, (10, 10)))] == [0, 0, 0]
    assert regions.passing(m.filter("area = 3"), frame=(10, 10)).count() == 1


def test_cell_table(spark, probe):
    cells = components.label_images(probe.filter("y = 8 and v > 0"), 10)
    t = jobs.segment_table(cells, probe, "cell")
    r = jobs.cell_table(t, probe.groupBy("image_id").agg(F.count("*").alias("pixels"))).first()
    assert r.no_cells == 1 and r.cell_coverage == pytest.approx(3 / 100) and r.cell_mean == pytest.approx(10)
    base = jobs.metric_databases(cells, cells, graphs.network_parts(*empty_graph(spark)), probe)
    assert set(base) == {"global", "fibre", "network", "cell"} and base["cell"].count() == 1 and base["global"].first().no_cells == 1


def empty_graph(spark):
    return table(spark, [], "image_id long, node_id long, y int, x int"), table(spark, [], "image_id long, src long, dst long, r double")


def stack(spark, side=24):
    """Three channels: a bright diagonal band in the first, a bright block in the second, a gradient in the third."""
    rows = []
    for y in range(side):
        for x in range(side):
            v = (10.0 if abs(y - x) < 3 else 0.5 + (y * 7 + x * 3) % 5 * 0.05, 9.0 if y > 14 and x < 9 else 0.4 + (y + x) % 3 * 0.05, 1.0 + (x + y) / side)
            rows += [(1, str(c), y, x, v[c]) for c in range(3)]
    return table(spark, rows, "image_id long, channel string, y int, x int, v double")


def test_colour_segmentation(spark):
    s = stack(spark)
    rgb = clusters.composite_rgb(px.rescale(s))
    assert rgb.count() == 24 * 24 and rgb.filter("blue < 0 or blue > 1").count() == 0
    for scale in (1.0, 1.5):
        got = clusters.rgb_segmentation(rgb, scale, k=3, min_object=4)
        assert got.count() == 24 * 24 and got.select("y", "x").distinct().count() == 24 * 24
    one = clusters.rgb_segmentation(rgb.repartition(5), 1.0, k=3, min_object=4).filter("is_cell").count()
    assert one == clusters.rgb_segmentation(rgb, 1.0, k=3, min_object=4).filter("is_cell").count()
    none = clusters.rgb_segmentation(rgb, 1.0, k=3, classifier=lambda labels, centres, grey: (centres[:, 0] > 9, 0.0))
    assert none.filter("is_cell").count() == 0


def test_three_channel_segments(spark):
    s = stack(spark)
    network = s.filter("channel = '0' and v > 9").select("image_id", "y", "x")
    seg = jobs.segment_shg_pl_trans(s, network, 24, 24, min_sizes=(20, 20), min_fracs=(1.0, 0.1), swap_sizes=(30, 30), swap_fracs=(0.01, 0.1), holes=8, k=3, min_object=4).collect()
    assert {r.tag for r in seg} <= {"fibre", "cell"} and any(r.tag == "fibre" for r in seg) and any(r.tag == "cell" for r in seg)
    assert sum(r.area for r in seg) <= 24 * 24


def test_blurred_tensors(spark, probe):
    from loomgrain.functions import kernels

    img = np.zeros((10, 10))
    for r in probe.collect():
        img[r.y, r.x] = r.v
    want = kernels.gaussian(img, 1.0)
    got = {(r.y, r.x): r.v for r in px.blurred(probe, ("v",), 1.0).collect()}
    assert all(got[y, x] == pytest.approx(want[y, x]) for y in range(10) for x in range(10))
    zero = {(r.y, r.x): r.v for r in px.blurred(probe, ("v",), 1.0, mirrored=False).collect()}
    assert zero[5, 5] == pytest.approx(got[5, 5]) and zero[0, 4] < got[0, 4]
    assert px.structure_tensor(probe, 1.0).count() == px.nematic_tensor(probe, 1.0).count() == 100


def test_equalised_constant_and_steps(spark):
    flat = table(spark, [(1, "0", 0, x, 3.0) for x in range(4)], "image_id long, channel string, y int, x int, v double")
    assert [r.v for r in px.equalise(flat).collect()] == [1.0] * 4
    v = [0.0, 1.0, 2.0, 2.0, 7.0, 9.5]
    p = table(spark, [(1, "0", 0, x, a) for x, a in enumerate(v)], flat.schema)
    n, edges = np.histogram(v, 256)
    want = np.interp(v, (edges[:-1] + edges[1:]) / 2, n.cumsum() / n.sum())
    assert [r.v for r in px.equalise(p).orderBy("x").collect()] == pytest.approx(list(want))


# ---------------------------------------------------------------- networks and files


def test_seeds_and_branches(spark):
    img = np.zeros((20, 20))
    for k in (5, 4):
        img += 2 * np.eye(20, 20, k) + np.rot90(np.eye(20, 20, k))
    t = table(spark, [(1, "0", 20, 20, img.ravel().tolist()), (2, "0", 20, 20, None)], "image_id long, channel string, height int, width int, data array<double>")
    seeds = graphs.nucleation_points(t, 2.0, 8.0)
    assert [(r.image_id, r.y, r.x) for r in seeds.collect()] == [(1, 5, 10)]
    b = graphs.new_branches(seeds, px.pixels_of(t), 4, 0.15)
    assert {(r.y, r.x) for r in b.collect()} == {(1, 14), (2, 6), (9, 6), (9, 14)}
    assert all(r.r == pytest.approx(math.hypot(r.dy, r.dx)) and (r.y + r.dy, r.x + r.dx) == (5, 10) for r in b.collect())
    nodes, edges = jobs.trace_networks(t.filter("data is not null"), 2, 0.15, 70, 8)
    assert nodes.count() == 8 and sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (0, 2), (0, 3), (0, 4), (3, 5), (4, 6), (5, 7)]


def test_networks_are_assigned_and_contracted(spark):
    n = table(spark, [(1, 2, 0, 0), (1, 3, 1, 1), (1, 4, 2, 2), (1, 5, 2, 3), (1, 9, 7, 7), (2, 1, 0, 0)], "image_id long, node_id long, y int, x int")
    e = table(spark, [(1, 2, 3, 1.41), (1, 3, 4, 1.41), (1, 4, 5, 1.0)], "image_id long, src long, dst long, r double")
    fibres, nodes, edges = graphs.assign_networks(n, e)
    assert [r.node_id for r in fibres.orderBy("seq").collect()] == [2, 3, 4, 5]
    assert sorted((r.image_id, r.network_id, r.node_id) for r in nodes.collect()) == [(1, 0, 2), (1, 0, 5)]
    assert [(r.src, r.dst, r.r) for r in edges.collect()] == [(2, 5, pytest.approx(3.605551275463989))]
    assert all(t.count() == 0 for t in graphs.assign_networks(*empty_graph(spark)))


def test_inputs_are_listed(spark, tmp_path):
    (tmp_path / "deeper").mkdir()
    for name in ("a-shg.tif", "b-pl.tif", "deeper/c-shg.tif"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.list_inputs(spark, str(tmp_path)).collect()) == ["a-shg.tif", "b-pl.tif"]
    assert [r.path.rsplit("/", 1)[1] for r in files.list_inputs(spark, str(tmp_path), "-shg").collect()] == ["a-shg.tif"]
    assert files.list_inputs(spark, str(tmp_path / "b-pl.tif")).count() == 1


def test_masks_are_saved_and_loaded(spark, probe, tmp_path):
    layers = probe.filter("v > 0").select("image_id", F.lit(7).alias("mask_id"), "y", "x")
    tables.save_masks(layers, str(tmp_path / "m"))
    assert sorted(map(tuple, tables.load_masks(spark, str(tmp_path / "m")).select(*layers.columns).collect())) == sorted(map(tuple, layers.collect()))
    assert tables.load_masks(spark, str(tmp_path / "m"), 10, first_only=True).count() == 9


def test_stacks_keep_their_shape(spark):
    t = table(spark, [(1, "b", 1, 2, [1.0, 2.0]), (1, "a", 2, 1, [3.0, 4.0])], "image_id long, channel string, height int, width int, data array<double>")
    assert sorted(map(tuple, tables.from_stack(tables.to_stack(t)).collect())) == sorted(map(tuple, t.collect()))


def test_stacked_tiles(spark):
    """Images of several sizes and a null one in a batch; a stacked kernel is called far less than once an image."""
    rng = np.random.default_rng(2)
    rows = [(i, "0", h, w, None if i == 5 else rng.random(h * w).tolist()) for i in range(90) for h, w in [((4, 6), (3, 3), (7, 2))[i % 3]]]
    t = spark.createDataFrame(rows, "image_id int, channel string, height int, width int, data array<double>").coalesce(1)
    got = {r.image_id: r for r in stencils.map_tiles(t, lambda a: a[:, :, ::-1] + len(a), stacked=True).collect()}
    for i, _, h, w, data in rows:
        n = 30 - (h == 7)
        assert (got[i].height, got[i].width) == (h, w)
        assert got[i].data is None if data is None else np.array_equal(got[i].data, (np.reshape(data, (h, w))[:, ::-1] + n).ravel())


def test_morphology_goes_by_words(spark):
    """Masks over word borders as on whole images, repeated pixels too; rows aren't multiplied by the pixels reached."""
    from loomgrain.functions import kernels

    rng = np.random.default_rng(5)
    on = {i: rng.random((9, 70)) < share for i, share in enumerate((0.05, 0.9, 0.99))}
    rows = [(i, int(y), int(x)) for i, m in on.items() for y, x in zip(*np.nonzero(m), strict=True)]
    mask, key = spark.createDataFrame(rows + rows[:9], "image_id int, y int, x int"), ("image_id",)
    for t in (1, 10):
        want = {"dilate": lambda a, t=t: kernels.dilate(a, t), "erode": lambda a, t=t: kernels.erode(a, t)}
        want |= {"opened": lambda a, w=want: w["dilate"](w["erode"](a)), "closed": lambda a, w=want: w["erode"](w["dilate"](a))}
        for name, fn in want.items():
            got = sorted(map(tuple, getattr(masks, name)(mask, 9, 70, t, key).collect()))
            assert got == sorted((i, int(y), int(x)) for i, m in on.items() for y, x in zip(*np.nonzero(fn(m)), strict=True)), name
    full = spark.range(50).selectExpr("id as image_id", "explode(sequence(0, 31)) as y").selectExpr("image_id", "y", "explode(sequence(0, 31)) as x")
    assert masks._wider(masks._words(full, key), key, masks._cross(1)).count() <= 50 * 34 * 3  # 32 x 32 pixels an image


def test_measured_in_batches(spark):
    """Parts of many images are measured some hundred images a call, not by a call an image; empty values give no total."""
    rows = [(i, y, x) for i in range(300) for y in range(4) for x in range(4) if (y, x) not in ((1, 1), (0, 3))] + [(i, 6, 6) for i in range(300)]
    mask = spark.createDataFrame(rows + rows[:5], "image_id int, y int, x int")
    values = spark.createDataFrame([(i, y, x, 1.5) for i, y, x in rows if y < 6], "image_id int, y int, x int, v double")
    got = regions.measured(mask, 8, values)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(i, 0, 14, 15, 0, 0, 4, 4, 21.0) for i in range(300)} | {(i, 54, 1, 1, 6, 6, 7, 7, None) for i in range(300)}
    assert set(map(tuple, got.collect())) == want
    each = regions.measured(mask, 8, values, by_pixel=True).collect()
    assert {(r.image_id, r.y, r.x) for r in each} == set(rows) and len(each) == len(rows)
    assert regions.measured(mask.filter("false"), 8).count() == 0
