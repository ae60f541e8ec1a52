"""Network tables against plain Python, on networks that have nodes outside every fibre, and odd graphs."""

import math
import random

import numpy as np
import pytest

from loomgrain.functions import networks
from loomgrain.operators import graphs, spectra
from loomgrain.plans import jobs
from loomgrain.sources.stages import kept

N, E = "image_id {0}, node_id long, y int, x int", "image_id {0}, src long, dst long, r double"


def tables(spark, images, kind="long"):
    """images: {image: (places by node, pairs)}."""
    n = [(i, v, *p) for i, (xy, _) in images.items() for v, p in xy.items()]
    e = [(i, a, b, math.dist(xy[a], xy[b])) for i, (xy, pairs) in images.items() for a, b in pairs]
    return spark.createDataFrame(n, N.format(kind)), spark.createDataFrame(e, E.format(kind))


def contracted(nodes, pairs):
    """The rule of contraction, written out: sweeps over edges of nodes of at most two edges, not both of one."""
    near = {v: {} for v in nodes}
    for a, b in pairs:
        near[a][b] = near[b][a] = None
    while True:
        todo = [(a, b) for a in sorted(near) for b in near[a] if a < b and max(len(near[a]), len(near[b])) <= 2 < len(near[a]) + len(near[b])]
        todo = [(a, b) if len(near[a]) <= len(near[b]) else (b, a) for a, b in todo]
        if not todo:
            return near
        for a, b in todo:
            if a in near and b in near and b in near[a]:
                for c in list(near[b]):
                    del near[c][b]
                    if c != a:
                        near[c][a] = near[a][c] = None
                del near[b]


def table_of(xy, pairs, fibres):
    """(cross-links a fibre, squared degree correlation, eigenvalue, connectivity) of one component."""
    near = {v: [b if a == v else a for a, b in pairs if v in (a, b)] for v in xy}
    weight = {v: sum(math.dist(xy[v], xy[w]) for w in near[v]) for v in xy}
    da, db = zip(*[(weight[v], weight[w]) for v in near for w in near[v]], strict=True)
    same = np.std(da) * np.std(db) <= 1e-12
    red = contracted(list(xy), pairs)
    at = {v: i for i, v in enumerate(red)}
    a, w = np.zeros((len(at),) * 2), np.zeros((len(at),) * 2)
    for v in red:
        for u in red[v]:
            a[at[v], at[u]], w[at[v], at[u]] = 1, math.dist(xy[v], xy[u])
    lap = np.diag(w.sum(1)) - w
    return sum(len(x) > 2 for x in near.values()) / fibres, None if same else np.corrcoef(da, db)[0, 1] ** 2, np.linalg.eigvalsh(a)[-1], np.linalg.eigvalsh(lap)[1]


def comb(rng, teeth):
    """A straight fibre with short side branches that are in no fibre, as they turn back too sharply or are too short."""
    xy = {k: (10, 10 * k) for k in range(teeth)}
    pairs = [(k, k + 1) for k in range(teeth - 1)]
    for k in range(1, teeth - 1):
        if rng.random() < 0.6:
            v = 100 + k
            xy[v] = (10 + rng.randint(5, 9), 10 * k - rng.randint(0, 3))
            pairs.append((k, v))
    return xy, pairs


def test_network_table_counts_whole_components_and_contracts(spark):
    rng = random.Random(5)
    images = {i: comb(rng, rng.randint(5, 9)) for i in range(6)}
    images[6] = ({k: (0, k) for k in range(5)}, [(k, k + 1) for k in range(4)])
    parts = kept(graphs.network_parts(*tables(spark, images)), "test")
    outside = 0
    fibres = {}
    for r in parts.collect():
        fibres[r.image_id] = r.fibres
        outside += len(r.nodes) - len({v for f in r.fibres for v in f})
    assert outside > 3  # else the test holds nothing
    got = {r.image_id: r for r in jobs.network_table(parts).collect()}
    assert set(got) == set(images)
    for i, (xy, pairs) in images.items():
        r = got[i]
        cross, degree, top, second = table_of(xy, pairs, len(fibres[i]))
        assert r.no_fibres == len(fibres[i]) and r.cross_link_density == pytest.approx(cross)
        assert r.degree == (None if degree is None else pytest.approx(degree))
        assert (r.eigenvalue, r.connectivity) == (pytest.approx(top), pytest.approx(second))
    assert (got[6].eigenvalue, got[6].connectivity) == (pytest.approx(1.0), pytest.approx(8.0))


def test_a_path_is_one_edge_when_contracted(spark):
    n, e = tables(spark, {1: ({k: (0, k) for k in range(5)}, [(k, k + 1) for k in range(4)])})
    r = graphs.part_spectra(graphs.network_parts(n, e)).first()
    assert (r.eigenvalue, r.connectivity) == (pytest.approx(1.0), pytest.approx(8.0))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_graphs(spark, kind):
    """Nodes in one place, edges to nodes that aren't there, repeated rows, isolated nodes, images without edges."""
    name = int if kind == "long" else str
    xy = {0: (0, 0), 1: (0, 2), 2: (0, 4), 3: (0, 4), 4: (0, 6), 5: (0, 8), 6: (9, 9)}
    n, e = tables(spark, {name(1): (xy, [(0, 1), (1, 2), (2, 4), (3, 4), (4, 5)]), name(2): ({0: (1, 1)}, [])}, kind)
    e = e.union(spark.createDataFrame([(name(1), 5, 77, 1.0), (name(3), 1, 2, 1.0)], e.schema))
    n = n.union(n)
    fibres, nodes, edges = graphs.assign_networks(n, e)
    assert {r.image_id for r in fibres.collect()} == {name(1)}
    assert edges.count() >= 1 and {r.node_id for r in nodes.collect()} <= set(xy)
    assert jobs.network_table(graphs.network_parts(n, e)).count() == 1
    one = n.distinct()
    for step in (graphs.merge_near_nodes, graphs.simplify_network, graphs.clean_network):
        a, b = step(one, e)
        assert a.schema["image_id"].dataType == n.schema["image_id"].dataType and b.count() >= 0


def test_traces_carry_ids_of_any_type(spark):
    rows = [("a", 12, 12, [float(abs(y - x) < 2) * 3 for y in range(12) for x in range(12)]), ("b", 4, 4, [0.0] * 16)]
    tiles = spark.createDataFrame(rows, "image_id string, height int, width int, data array<double>")
    n, _ = jobs.trace_networks(tiles, 0.5, 0.1, 70, 4)
    assert {r.image_id for r in n.collect()} == {"a"}
    assert jobs.build_networks(tiles)[1].schema["image_id"].dataType.simpleString() == "string"


def test_spectrum_of_a_graph_as_a_table(spark):
    """10,003 nodes, three of them joined with all others, against the solver on whole graphs."""
    e = {(h, 3 + k): float(1 + (k % 5 == h)) for k in range(10_000) for h in range(3)}
    rows = [(a, b, r) for (a, b), r in e.items()] + [(5, 5, 9.0), (3, 0, 0.1)]
    top, second = spectra.graph_spectrum(spark.createDataFrame(rows, "src long, dst long, r double"))
    want = networks.spectrum(10_003, np.array(list(e)), np.array(list(e.values())))
    assert top == pytest.approx(want[0], abs=1e-8) and second == pytest.approx(want[1], abs=1e-8)
    assert top == pytest.approx(math.sqrt(30_000))


def test_spectrum_of_small_tables(spark):
    def of(rows):
        return spectra.graph_spectrum(spark.createDataFrame(rows, "src string, dst string, r double"))

    assert of([("a", "b", 2.0), ("b", "a", 1.0), ("b", "b", 7.0)]) == (pytest.approx(1.0), pytest.approx(4.0))
    assert of([("a", "b", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)]) == (pytest.approx(math.sqrt(2)), 0.0)
    assert of([("a", "a", 1.0)]) == (None, None)


def test_spectrum_of_uneven_degrees_takes_few_steps(spark):
    """A hundred hubs of up to 400 edges each: plain Lanczos steps took hundreds; also over several chunks and parts."""
    rng = random.Random(4)
    e = {(h, 100 + rng.randrange(1_500)): float(rng.randint(1, 3)) for h in range(100) for _ in range(rng.choice((40, 400)))}
    e |= {(h, 100 + k): 1.0 for k in range(1_500) for h in rng.sample(range(100), 4)}
    df = spark.createDataFrame([(a, b, r) for (a, b), r in e.items()], "src long, dst long, r double")
    top, second = spectra.graph_spectrum(df, most=60, chunk=500, part=2_000)
    want = networks.spectrum(1_600, np.array(list(e)), np.array(list(e.values())))
    assert top == pytest.approx(want[0], abs=1e-8) and second == pytest.approx(want[1], abs=1e-8)


def test_spectrum_keeps_tables_off_the_driver(spark):
    """Joins deal both sides, but for the list of packed parts; edges are packed by a few groups, of several chunks each."""
    rng = random.Random(5)
    e = {(h, 60 + k): float(rng.randint(1, 3)) for k in range(900) for h in rng.sample(range(60), 8)}
    df = spark.createDataFrame([(a, b, r) for (a, b), r in e.items()], "src long, dst long, r double")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    top, second = spectra.graph_spectrum(df, most=60, chunk=50, part=10_000)
    want = networks.spectrum(960, np.array(list(e)), np.array(list(e.values())))
    assert top == pytest.approx(want[0], abs=1e-8) and second == pytest.approx(want[1], abs=1e-8)
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription().split("== Initial Plan ==")[0].split("\n\n")[0] for i in range(before, ran.size())]
    steps = [p for p in plans if "CoGroups" in p]
    assert steps and all(p.count("BroadcastHashJoin") == 1 for p in steps)
    assert not [p for p in plans if "Broadcast" in p and p not in steps]
    named = e_of(spark, e)
    chunks, parts, groups = spectra.packed(*named, 960, 50, 10_000)
    assert chunks.count() == 20 and groups == 3 and parts.count() <= 12


def e_of(spark, e):
    """Edges (a, b, r) and nodes (node, d) as spectra.packed() takes them."""
    d = {}
    for (a, b), r in e.items():
        d[a], d[b] = d.get(a, 0.0) + r, d.get(b, 0.0) + r
    return spark.createDataFrame([(*k, r) for k, r in e.items()], "a long, b long, r double"), spark.createDataFrame(list(d.items()), "node long, d double")


def test_few_rows_at_once(spark):
    """Rows of lists go through Python some at a time, though a batch of the session holds them all."""
    from loomgrain.sources.stages import few_at_once

    df = spark.range(0, 500, 1, 1).selectExpr("id", "array(named_struct('a', id)) as s")
    sizes = few_at_once(df, lambda frames: (f.assign(k=len(f))[["id", "k"]] for f in frames), "id long, k int", 64).collect()
    assert max(r.k for r in sizes) <= 64 and len(sizes) == 500


def test_components_in_tasks_and_by_rounds(spark):
    """The same components for small keys (one pass, no rounds of joins) and for large ones."""
    from loomgrain.operators import components

    rng = random.Random(9)
    n = [(f"i{i}", v * 3) for i in range(40) for v in range(1 + i)]
    e = [(f"i{i}", rng.randrange(1 + i) * 3, rng.randrange(3 + i) * 3) for i in range(40) for _ in range(i // 2)]
    e += [("i39", v * 3, v * 3 + 3) for v in range(20, 38)] + [("absent", 0, 3)]
    nodes, edges = spark.createDataFrame(n, "image_id string, node_id long"), spark.createDataFrame(e, "image_id string, src long, dst long")
    want = set()
    for i in range(40):
        parts = networks.components(1 + i, [(a // 3, b // 3) for k, a, b in e if k == f"i{i}" and max(a, b) // 3 <= i])
        want |= {(f"i{i}", 3 * v, 3 * part[0]) for part in parts for v in part}
    for fits in (components.FITS, 30, 0):
        got = [tuple(r) for r in components.connected_components(nodes, edges, fits=fits).collect()]
        assert len(got) == len(want) and set(got) == want
    assert components.connected_components(nodes.filter("false"), edges).count() == 0
