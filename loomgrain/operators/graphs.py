"""Graphs as node and edge tables: degrees, distances, near pairs, thinning and statistics.

nodes: image_id, node_id, y, x; edges: image_id, src, dst, r with src < dst.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import kernels, networks
from loomgrain.functions.pixels import pixels_of
from loomgrain.operators import stencils
from loomgrain.operators.components import connected_components
from loomgrain.operators.masks import shifted, square
from loomgrain.sources.stages import few_at_once


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (image_id, a, b, r)."""
    return edges.select("image_id", F.col("src").alias("a"), F.col("dst").alias("b"), "r").union(edges.select("image_id", F.col("dst"), F.col("src"), "r"))


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, node_id, degree): isolated nodes have 0."""
    n = both_ways(edges).groupBy("image_id", F.col("a").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select("image_id", "node_id").join(n, ["image_id", "node_id"], "left").select("image_id", "node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def distance_matrix(nodes: DataFrame) -> DataFrame:
    """(image_id, a, b, dy, dx, r2) of all ordered pairs of an image's nodes; for small graphs."""
    a = nodes.select("image_id", F.col("node_id").alias("a"), F.col("y").alias("ya"), F.col("x").alias("xa"))
    b = nodes.select("image_id", F.col("node_id").alias("b"), F.col("y").alias("yb"), F.col("x").alias("xb"))
    p = a.join(b, "image_id").select("image_id", "a", "b", (F.col("yb") - F.col("ya")).alias("dy"), (F.col("xb") - F.col("xa")).alias("dx"))
    return p.withColumn("r2", F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))


def near_pairs(a: DataFrame, b: DataFrame, within: float, id_col: str = "node_id") -> DataFrame:
    """(image_id, a, b, r2) of points at most `within` apart, by an equi-join on grid cells of that size.

    Each point of b goes to the nine cells around its own, so the join never meets points further apart than two cells.
    """
    size = max(within, 1e-9)
    cell = lambda c: F.floor(F.col(c) / size)
    left = a.select("image_id", F.col(id_col).alias("a"), F.col("y").alias("ya"), F.col("x").alias("xa"), cell("y").alias("cy"), cell("x").alias("cx"))
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    right = b.select("image_id", F.col(id_col).alias("b"), F.col("y").alias("yb"), F.col("x").alias("xb"), cell("y").alias("cy"), cell("x").alias("cx")).withColumn("o", steps)
    right = right.select("image_id", "b", "yb", "xb", (F.col("cy") + F.col("o.dy")).alias("cy"), (F.col("cx") + F.col("o.dx")).alias("cx"))
    dy, dx = F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa")
    met = left.join(right, ["image_id", "cy", "cx"]).withColumn("r2", (dy * dy + dx * dx).cast("double"))
    return met.filter(F.col("r2") <= within * within + 1e-9).select("image_id", "a", "b", "r2")


def reduce_coords(points: DataFrame, thresh: float, keep: str = "lowest") -> DataFrame:
    """points (image_id, node_id, y, x, w) thinned: of every pair within sqrt(2) * thresh, the one of larger weight goes.

    Equal weights: the earlier one goes. All pairs are found first, then all marked points are dropped together.
    keep="highest" drops the smaller weight instead.
    """
    pairs = near_pairs(points, points, math.sqrt(2) * thresh).filter("a < b and r2 > 0")
    w = points.select("image_id", "node_id", "w")
    p = pairs.join(w.withColumnsRenamed({"node_id": "a", "w": "wa"}), ["image_id", "a"]).join(w.withColumnsRenamed({"node_id": "b", "w": "wb"}), ["image_id", "b"])
    first = F.col("wa") >= F.col("wb") if keep == "lowest" else F.col("wa") <= F.col("wb")
    gone = p.select("image_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("node_id")).distinct()
    return points.join(gone, ["image_id", "node_id"], "left_anti")


def branch_angle(dir_y: Column, dir_x: Column, dy: Column, dx: Column) -> Column:
    """Cosine between a direction and a displacement; null for no displacement."""
    return (dir_y * dy + dir_x * dx) / F.nullif(F.sqrt((dy * dy + dx * dx).cast("double")), F.lit(0.0))


def candidate_edges(nodes: DataFrame, edges: DataFrame, max_degree: int = 2) -> DataFrame:
    """(image_id, low, high) of edges whose ends have degrees up to max_degree and aren't both 1; the lower degree first."""
    d = node_degree(nodes, edges)
    e = edges.join(d.withColumnsRenamed({"node_id": "src", "degree": "ds"}), ["image_id", "src"]).join(d.withColumnsRenamed({"node_id": "dst", "degree": "dd"}), ["image_id", "dst"])
    e = e.filter((F.col("ds") <= max_degree) & (F.col("dd") <= max_degree) & ~((F.col("ds") == 1) & (F.col("dd") == 1)))
    up = F.col("ds") <= F.col("dd")
    return e.select("image_id", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("high"))


def transfer_edges(nodes: DataFrame, edges: DataFrame, moves: DataFrame) -> DataFrame:
    """edges with ends re-pointed by moves (image_id, source, target); self edges and doubles go, lengths are renewed."""
    m = moves.select("image_id", "source", "target")
    e = edges.select("image_id", "src", "dst")
    for end in ("src", "dst"):
        e = e.join(m.withColumnRenamed("source", end), ["image_id", end], "left").withColumn(end, F.coalesce("target", end)).drop("target")
    e = e.filter("src != dst").select("image_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return with_lengths(nodes, e)


def with_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, src, dst, r): straight distances between the ends."""
    n = nodes.select("image_id", "node_id", "y", "x")
    a = n.withColumnsRenamed({"node_id": "src", "y": "y0", "x": "x0"})
    b = n.withColumnsRenamed({"node_id": "dst", "y": "y1", "x": "x1"})
    e = edges.select("image_id", "src", "dst").join(a, ["image_id", "src"]).join(b, ["image_id", "dst"])
    return e.select("image_id", "src", "dst", F.hypot((F.col("y1") - F.col("y0")).cast("double"), (F.col("x1") - F.col("x0")).cast("double")).alias("r"))


def drop_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = both_ways(edges).select("image_id", F.col("a").alias("node_id")).distinct()
    return nodes.join(ends, ["image_id", "node_id"], "left_semi")


def renumber(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with ids 0, 1, … of each image, in the order of the old ones."""
    n = nodes.withColumn("new", (F.row_number().over(Window.partitionBy("image_id").orderBy("node_id")) - 1).cast("long"))
    to = n.select("image_id", "node_id", "new")
    e = edges.join(to.withColumnsRenamed({"node_id": "src", "new": "s"}), ["image_id", "src"]).join(to.withColumnsRenamed({"node_id": "dst", "new": "d"}), ["image_id", "dst"])
    return n.drop("node_id").withColumnRenamed("new", "node_id").select(*nodes.columns), e.select("image_id", F.col("s").alias("src"), F.col("d").alias("dst"), "r")


# ---------------------------------------------------------------- statistics


def cross_link_density(nodes: DataFrame, edges: DataFrame, fibres: DataFrame) -> DataFrame:
    """(image_id, cross_link_density): nodes of degree over 2 for each fibre (image_id, n_fibres)."""
    n = node_degree(nodes, edges).groupBy("image_id").agg(F.count_if(F.col("degree") > 2).alias("k"))
    return n.join(fibres, "image_id").select("image_id", (F.col("k") / F.nullif(F.col("n_fibres"), F.lit(0))).alias("cross_link_density"))


def degree_correlation(edges: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, degree): squared correlation of the ends' r-weighted degrees over edges in both directions; null if constant."""
    k = list(keys)
    both = edges.select(*k, F.col("src").alias("a"), F.col("dst").alias("b"), "r").union(edges.select(*k, F.col("dst"), F.col("src"), "r"))
    d = both.groupBy(*k, "a").agg(F.sum("r").alias("d"))
    p = both.join(d.withColumnRenamed("d", "da"), [*k, "a"]).join(d.withColumnsRenamed({"a": "b", "d": "db"}), [*k, "b"])
    s = p.groupBy(*k).agg(F.covar_pop("da", "db").alias("c"), (F.stddev_pop("da") * F.stddev_pop("db")).alias("s"))
    r = F.when(F.col("s") > 1e-12, F.col("c") / F.nullif(F.col("s"), F.lit(0.0)))
    return s.select(*k, (r * r).alias("degree"))


def spectra(edges: DataFrame, keys: tuple[str, ...] = ("image_id", "network_id"), dense: int = 2000) -> DataFrame:
    """(keys, eigenvalue, connectivity) of each graph: the largest adjacency eigenvalue (unweighted), and the second-smallest
    of the r-weighted Laplacian. Graphs of more than `dense` nodes use power iteration on their edge lists."""
    k = list(keys)
    head = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in k)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, flat = np.unique(pdf[["src", "dst"]].to_numpy(), return_inverse=True)
        e = flat.reshape(-1, 2)
        top, second = networks.spectrum(len(ids), e, pdf["r"].to_numpy(float), dense)
        return pd.DataFrame([[*key, top, second]], columns=[*k, "eigenvalue", "connectivity"])

    return edges.groupBy(*k).applyInPandas(run, head + ", eigenvalue double, connectivity double")


# ---------------------------------------------------------------- order-dependent steps, one image at a time


#: An image's or network's nodes and edges as they travel through one Python pass.
NODES, EDGES = "array<struct<node_id:long,y:double,x:double>>", "array<struct<src:long,dst:long,r:double>>"


def listed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, n, e): each image's nodes by id, and its edges by ends; e is null where there is none."""
    e = edges.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("e"))
    n = nodes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "y", "x"))).alias("n"))  # one image's
    return n.join(e, "image_id", "left")


def numbered(ns, es) -> tuple[list[int], networks.Points, networks.Pairs]:
    """(ids, places, edges by place in ids) of one image of listed(); edges whose ends aren't nodes are left out."""
    ids = [int(r["node_id"]) for r in ns]
    at = {v: i for i, v in enumerate(ids)}
    pairs = [(at[r["src"]], at[r["dst"]]) for r in (es if es is not None else []) if r["src"] in at and r["dst"] in at]
    return ids, [(float(r["y"]), float(r["x"])) for r in ns], pairs


def rows_of(ids: list[int], xy: networks.Points, pairs: networks.Pairs) -> tuple[list[dict], list[dict]]:
    """Nodes and edges as NODES and EDGES, the smaller id of an edge first, r its straight length."""
    n = [{"node_id": v, "y": y, "x": x} for v, (y, x) in zip(ids, xy, strict=True)]
    return n, [{"src": min(ids[a], ids[b]), "dst": max(ids[a], ids[b]), "r": math.dist(xy[a], xy[b])} for a, b in pairs]


def _per_image(nodes: DataFrame, edges: DataFrame, step) -> tuple[DataFrame, DataFrame]:
    """step(xy, edges) -> (xy, edges) run on each image's graph; ids are renumbered."""

    def run(batches):
        for pdf in batches:
            rows = []
            for image, ns, es in zip(pdf["image_id"], pdf["n"], pdf["e"], strict=True):
                xy, pairs = step(*numbered(ns, es)[1:])
                rows.append((image, *rows_of(list(range(len(xy))), xy, pairs)))
            yield pd.DataFrame(rows, columns=["image_id", "n", "e"])

    kind = nodes.schema["image_id"].dataType.simpleString()
    g = few_at_once(listed(nodes, edges), run, f"image_id {kind}, n {NODES}, e {EDGES}")
    return g.select("image_id", F.inline("n")), g.select("image_id", F.inline("e"))


def merge_near_nodes(nodes: DataFrame, edges: DataFrame, within: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Nodes closer than `within` become one, again and again; see networks.merge_near()."""
    return _per_image(nodes, edges, lambda xy, e: networks.merge_near(xy, e, within))


def simplify_network(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains contracted to their ends and branch points; see networks.simplify()."""
    return _per_image(nodes, edges, networks.simplify)


def clean_network(nodes: DataFrame, edges: DataFrame, within: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Isolated nodes dropped, near ones merged, small components dropped; ids renumbered."""
    return _per_image(nodes, edges, lambda xy, e: networks.clean(xy, e, within))


def nucleation_points(tiles: DataFrame, least: float, thresh: float) -> DataFrame:
    """(image_id, node_id, y, x, w): local maxima of at least `least`, thinned by reduce_coords(); node_id counts row-major.

    w is the value. Null tiles give no rows.
    """
    peak = pixels_of(stencils.local_maxima(tiles)).filter("v > 0").select("image_id", "y", "x")
    width = tiles.select("image_id", "width").distinct()
    p = pixels_of(tiles).filter(F.col("v") >= least).join(peak, ["image_id", "y", "x"], "left_semi").join(width, "image_id")
    return reduce_coords(p.select("image_id", (F.col("y") * F.col("width") + F.col("x")).cast("long").alias("node_id"), "y", "x", F.col("v").alias("w")), thresh)


def new_branches(points: DataFrame, pixels: DataFrame, half: int, least: float) -> DataFrame:
    """(image_id, node_id, y, x, v, dy, dx, r): where values peak on the square ring around each point (image_id, node_id, y, x).

    Of the pixels on a ring of half-width `half` the local maxima (all else counting 0, plateaus as one) of at least
    `least` > 0, thinned within sqrt(2); (dy, dx) leads back to the point and r is how far it is. Points and offsets meet
    pixels by equality; a group is one point's ring, at most 8 * half pixels.
    """
    offsets = tuple(o for o in square(half) if max(abs(o[0]), abs(o[1])) == half)
    around = shifted(points.select("image_id", "node_id", F.col("y").alias("cy"), F.col("x").alias("cx"), "y", "x"), offsets)
    ring = around.join(pixels.select("image_id", "y", "x", F.col("v").cast("double").alias("v")), ["image_id", "y", "x"])

    def run(batches):
        for pdf in batches:
            rows = []
            for image, node, cy, cx, places in zip(pdf["image_id"], pdf["node_id"], pdf["cy"], pdf["cx"], pdf["ring"], strict=True):
                win = np.zeros((2 * half + 3, 2 * half + 3))
                for p in places:
                    win[p["y"] - cy + half + 1, p["x"] - cx + half + 1] = p["v"]
                top = kernels.local_maxima(win)
                peak = [p for p in places if p["v"] >= least and top[p["y"] - cy + half + 1, p["x"] - cx + half + 1]]
                for i in networks.thin([(p["y"], p["x"]) for p in peak], [p["v"] for p in peak], 1):
                    dy, dx = cy - peak[i]["y"], cx - peak[i]["x"]
                    rows.append((image, node, peak[i]["y"], peak[i]["x"], peak[i]["v"], dy, dx, math.hypot(dy, dx)))
            yield pd.DataFrame(rows, columns=["image_id", "node_id", "y", "x", "v", "dy", "dx", "r"])

    kind = points.schema["image_id"].dataType.simpleString()
    rings = ring.groupBy("image_id", F.col("node_id").cast("long").alias("node_id"), "cy", "cx").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("ring"))
    return few_at_once(rings, run, f"image_id {kind}, node_id long, y int, x int, v double, dy int, dx int, r double")


def network_parts(nodes: DataFrame, edges: DataFrame, angle: float = 70.0, least: int = 4) -> DataFrame:
    """One row a network that has fibres: (image_id, network_id int, nodes, edges, fibres, red_nodes, red_edges).

    A network is a component of an image's graph; networks are numbered by node count ascending, then first node. nodes
    and edges are all of the component's, in a fibre or not; fibres are paths of node ids; red_nodes and red_edges are
    those left when chains are contracted to their ends and branch points, with ids as before and straight lengths. Edges
    whose ends aren't nodes are ignored, nodes in one place are nodes each, images without edges and networks without
    fibres give no rows, repeated nodes count once. Two shuffles by image and one pass; who needs several of the columns
    keeps the result (sources.stages.kept()).
    """
    kind = nodes.schema["image_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for image, ns, es in zip(pdf["image_id"], pdf["n"], pdf["e"], strict=True):
                ids, xy, pairs = numbered(ns, es)
                for net, (part, own, fibres) in enumerate(networks.networks_with_fibres(xy, pairs, angle, least)):
                    new = {v: i for i, v in enumerate(part)}
                    own = [(new[a], new[b]) for a, b in own]
                    names, places = [ids[v] for v in part], [xy[v] for v in part]
                    left, links = networks.contract(len(part), own)
                    red = networks.keep_nodes(places, links, left)
                    rows.append((image, net, *rows_of(names, places, own), [[ids[v] for v in f] for f in fibres], *rows_of([names[v] for v in left], *red)))
            yield pd.DataFrame(rows, columns=["image_id", "network_id", "nodes", "edges", "fibres", "red_nodes", "red_edges"])

    whole = listed(nodes.dropDuplicates(["image_id", "node_id"]), edges).filter(F.col("e").isNotNull())
    return few_at_once(whole, run, f"image_id {kind}, network_id int, nodes {NODES}, edges {EDGES}, fibres array<array<long>>, red_nodes {NODES}, red_edges {EDGES}")


def fibres_of_parts(parts: DataFrame) -> DataFrame:
    """(image_id, network_id, fibre_id, seq, node_id, y, x) of network_parts()."""
    places = F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["node_id"], n)))
    f = parts.select("image_id", "network_id", places.alias("at"), F.posexplode("fibres").alias("fibre_id", "path"))
    f = f.select("image_id", "network_id", "fibre_id", "at", F.posexplode("path").alias("seq", "node_id"))
    return f.select("image_id", "network_id", "fibre_id", "seq", "node_id", F.col("at")[F.col("node_id")]["y"].alias("y"), F.col("at")[F.col("node_id")]["x"].alias("x"))


def assign_fibres(nodes: DataFrame, edges: DataFrame, angle: float = 70.0, least: int = 4) -> DataFrame:
    """(image_id, network_id, fibre_id, seq, node_id, y, x): fibres of every network; see network_parts()."""
    return fibres_of_parts(network_parts(nodes, edges, angle, least))


def assign_networks(nodes: DataFrame, edges: DataFrame, angle: float = 70.0, least: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fibres, contracted nodes, contracted edges) of the networks that have fibres, by image_id and network_id; see network_parts()."""
    parts = network_parts(nodes, edges, angle, least)
    keys = ("image_id", "network_id")
    return fibres_of_parts(parts), parts.select(*keys, F.inline("red_nodes")), parts.select(*keys, F.inline("red_edges"))


def part_spectra(parts: DataFrame, dense: int = 2000) -> DataFrame:
    """(image_id, network_id, eigenvalue, connectivity) of the contracted networks of network_parts(), without a shuffle."""
    kind = parts.schema["image_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for image, net, ns, es in zip(pdf["image_id"], pdf["network_id"], pdf["red_nodes"], pdf["red_edges"], strict=True):
                _, _, pairs = numbered(ns, es)
                e = np.array(pairs, int).reshape(-1, 2)
                rows.append((image, net, *networks.spectrum(len(ns), e, np.array([r["r"] for r in es], float), dense)))
            yield pd.DataFrame(rows, columns=["image_id", "network_id", "eigenvalue", "connectivity"])

    return few_at_once(parts.select("image_id", "network_id", "red_nodes", "red_edges"), run, f"image_id {kind}, network_id int, eigenvalue double, connectivity double")


def component_metrics(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n_nodes, cross_links, degree) of whole components: nodes (keys, node_id), edges (keys, src, dst, r).

    cross_links counts nodes of more than two edges, degree is degree_correlation(). Nodes without edges count as nodes.
    """
    k = list(keys)
    ends = edges.select(*k, F.col("src").alias("node_id")).union(edges.select(*k, F.col("dst"))).groupBy(*k, "node_id").agg(F.count("*").alias("d"))
    n = nodes.select(*k, "node_id").join(ends, [*k, "node_id"], "left").groupBy(*k).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("d") > 2).alias("cross_links"))
    return n.join(degree_correlation(edges, keys), k, "left")
