"""Queries over graphs, fibres and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrain.functions import stats
from loomgrain.operators import components, graphs, masks, spectra
from loomgrain.plans import jobs
from loomgrain.plans.base import GR, PX, SIDE, graph, mosaics, parts_sql, pixels, q6, query, r6, rounded, stacks, table, tiles
from loomgrain.plans.image_queries import GAUSS
from loomgrain.plans.region_queries import SEGMENT_ROWS, segments_sql
from loomgrain.sources import tables as stores
from loomgrain.sources.stages import kept

DEG = "bo AS (SELECT image_id, src AS a, dst AS b, r FROM edges UNION ALL SELECT image_id, dst, src, r FROM edges), dg AS (SELECT n.image_id, n.node_id, count(b) AS degree FROM nodes n LEFT JOIN bo ON bo.image_id = n.image_id AND bo.a = n.node_id GROUP BY 1, 2)"


@query(f"WITH {GR}, {DEG} SELECT image_id, node_id, degree FROM dg")
def g1_node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.node_degree(*graph(spark, sf_dir))


@query(f"WITH {GR} SELECT a.image_id, a.node_id, count(*) AS n, CAST(sum((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) AS BIGINT) AS r2, CAST(sum(b.y - a.y) AS BIGINT) AS dy, CAST(sum(b.x - a.x) AS BIGINT) AS dx, max((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) AS farthest FROM nodes a JOIN nodes b ON a.image_id = b.image_id GROUP BY 1, 2")
def g2_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums of each image's distance matrix."""
    d = graphs.distance_matrix(graph(spark, sf_dir)[0])
    return d.groupBy("image_id", F.col("a").alias("node_id")).agg(F.count("*").alias("n"), F.sum("r2").alias("r2"), F.sum("dy").alias("dy"), F.sum("dx").alias("dx"), F.max("r2").alias("farthest"))


@query(f"WITH {GR} SELECT a.image_id, a.node_id AS a, b.node_id AS b, CAST((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) AS DOUBLE) AS r2 FROM nodes a JOIN nodes b ON a.image_id = b.image_id AND a.node_id < b.node_id WHERE (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) <= 4")
def g3_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir)[0]
    return graphs.near_pairs(n, n, 2.0).filter("a < b")


@query(f"WITH {GR}, pr AS (SELECT a.image_id, CASE WHEN a.v >= b.v THEN a.node_id ELSE b.node_id END AS gone FROM nodes a JOIN nodes b ON a.image_id = b.image_id AND a.node_id < b.node_id WHERE (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) <= 2) SELECT image_id, node_id, y, x FROM nodes WHERE (image_id, node_id) NOT IN (SELECT (image_id, gone) FROM pr)")
def g4_reduce_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir)[0].withColumnRenamed("v", "w")
    return graphs.reduce_coords(n, 1.0).select("image_id", "node_id", "y", "x")


@query(f"WITH {GR} SELECT e.image_id, src, dst, round((0.6 * (b.y - a.y) + 0.8 * (b.x - a.x)) / r, 6) + 0.0 AS cosine FROM edges e JOIN nodes a ON a.image_id = e.image_id AND a.node_id = src JOIN nodes b ON b.image_id = e.image_id AND b.node_id = dst")
def g5_branch_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    a = n.select("image_id", F.col("node_id").alias("src"), F.col("y").alias("y0"), F.col("x").alias("x0"))
    b = n.select("image_id", F.col("node_id").alias("dst"), F.col("y").alias("y1"), F.col("x").alias("x1"))
    p = e.join(a, ["image_id", "src"]).join(b, ["image_id", "dst"])
    cosine = graphs.branch_angle(F.lit(0.6), F.lit(0.8), F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    return p.select("image_id", "src", "dst", r6(cosine).alias("cosine"))


@query(f"WITH {GR}, {DEG} SELECT e.image_id, CASE WHEN a.degree <= b.degree THEN src ELSE dst END AS low, CASE WHEN a.degree <= b.degree THEN dst ELSE src END AS high FROM edges e JOIN dg a ON a.image_id = e.image_id AND a.node_id = src JOIN dg b ON b.image_id = e.image_id AND b.node_id = dst WHERE a.degree <= 2 AND b.degree <= 2 AND a.degree + b.degree > 2")
def g6_candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.candidate_edges(*graph(spark, sf_dir), 2)


@query(f"WITH {GR}, mv AS (SELECT image_id, src, dst, coalesce(s.t, src) AS s2, coalesce(d.t, dst) AS d2 FROM edges e LEFT JOIN (SELECT image_id AS i, node_id AS k, node_id - 1 AS t FROM nodes WHERE x % 2 = 1 AND (image_id, node_id - 1) IN (SELECT (image_id, node_id) FROM nodes)) s ON s.i = e.image_id AND s.k = src LEFT JOIN (SELECT image_id AS i, node_id AS k, node_id - 1 AS t FROM nodes WHERE x % 2 = 1 AND (image_id, node_id - 1) IN (SELECT (image_id, node_id) FROM nodes)) d ON d.i = e.image_id AND d.k = dst), di AS (SELECT DISTINCT image_id, least(s2, d2) AS src, greatest(s2, d2) AS dst FROM mv WHERE s2 <> d2) SELECT di.image_id, src, dst, {q6('sqrt(CAST((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS DOUBLE))')} AS r FROM di JOIN nodes a ON a.image_id = di.image_id AND a.node_id = src JOIN nodes b ON b.image_id = di.image_id AND b.node_id = dst")
def g7_transfer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of odd columns hand their edges to their left neighbour, where there is one."""
    n, e = graph(spark, sf_dir)
    left = n.select("image_id", (F.col("node_id") + 1).alias("source"), F.col("node_id").alias("target"))
    moves = n.filter("x % 2 = 1").select("image_id", F.col("node_id").alias("source")).join(left, ["image_id", "source"])
    return rounded(graphs.transfer_edges(n, e, moves))


@query(f"WITH {GR}, {DEG}, k AS (SELECT n.*, row_number() OVER (PARTITION BY n.image_id ORDER BY n.node_id) - 1 AS new_id FROM nodes n JOIN dg ON dg.image_id = n.image_id AND dg.node_id = n.node_id WHERE degree > 0) SELECT e.image_id, a.new_id AS src, b.new_id AS dst, {q6('r')} AS r FROM edges e JOIN k a ON a.image_id = e.image_id AND a.node_id = src JOIN k b ON b.image_id = e.image_id AND b.node_id = dst")
def g10_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return rounded(graphs.renumber(graphs.drop_isolates(n, e), e)[1])


REACH = "re(image_id, node_id, root) AS (SELECT image_id, node_id, node_id FROM nodes UNION SELECT re.image_id, bo.b, re.root FROM re JOIN bo ON bo.image_id = re.image_id AND bo.a = re.node_id), cc AS (SELECT image_id, node_id, min(root) AS component FROM re GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {GR}, {DEG}, {REACH}, ok AS (SELECT image_id, component FROM cc JOIN dg USING (image_id, node_id) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE degree > 1) >= 2 AND count(*) FILTER (WHERE degree = 1) >= 2) SELECT image_id, node_id FROM cc WHERE (image_id, component) IN (SELECT (image_id, component) FROM ok)")
def g11_drop_small_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.drop_small_components(*graph(spark, sf_dir))[0].select("image_id", "node_id")


@query()
def g8_merge_near_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graphs.merge_near_nodes(*graph(spark, sf_dir), 1.2)
    return n.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("y") * 8 + F.col("x")).alias("places"))


@query()
def g9_simplify_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.simplify_network(*graph(spark, sf_dir))[1])


@query()
def g12_clean_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.clean_network(*graph(spark, sf_dir), 1.2)[1])


PEAKS = "pk AS (SELECT a.image_id, a.y * 8 + a.x AS node_id, a.y, a.x, a.v FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3, 4, 5 HAVING a.v > max(b.v) AND a.v >= 0.1), cl AS (SELECT a.image_id, CASE WHEN a.v >= b.v THEN a.node_id ELSE b.node_id END AS gone FROM pk a JOIN pk b ON a.image_id = b.image_id AND a.node_id < b.node_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 8), nu AS (SELECT image_id, CAST(node_id AS BIGINT) AS node_id, y, x, v FROM pk ANTI JOIN cl ON cl.image_id = pk.image_id AND cl.gone = pk.node_id)"


@query(f"WITH {PX}, {PEAKS} SELECT image_id, node_id, y, x, {q6('v')} AS w FROM nu")
def g13_nucleation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.nucleation_points(tiles(spark, sf_dir), 0.1, 2.0))


RING = "ri AS (SELECT n.image_id, n.node_id, n.y AS cy, n.x AS cx, p.y, p.x, p.v, p.y * 8 + p.x AS id FROM nu n JOIN px p ON p.image_id = n.image_id AND greatest(abs(p.y - n.y), abs(p.x - n.x)) = 2), rp AS (SELECT * FROM ri a WHERE v >= 0.05 AND NOT EXISTS (SELECT 1 FROM ri b WHERE b.image_id = a.image_id AND b.node_id = a.node_id AND b.id <> a.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.v >= a.v))"


@query(f"WITH {PX}, {PEAKS}, {RING}, rc AS (SELECT a.image_id, a.node_id, CASE WHEN a.v >= b.v THEN a.id ELSE b.id END AS gone FROM rp a JOIN rp b ON a.image_id = b.image_id AND a.node_id = b.node_id AND a.id < b.id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 2) SELECT r.image_id, r.node_id, r.y, r.x, {q6('r.v')} AS v, cy - r.y AS dy, cx - r.x AS dx, {q6('sqrt(CAST((cy - r.y) * (cy - r.y) + (cx - r.x) * (cx - r.x) AS DOUBLE))')} AS r FROM rp r ANTI JOIN rc ON rc.image_id = r.image_id AND rc.node_id = r.node_id AND rc.gone = r.id")
def g14_new_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = graphs.nucleation_points(tiles(spark, sf_dir), 0.1, 2.0)
    return rounded(graphs.new_branches(seeds, pixels(spark, sf_dir), 2, 0.05))


@query()
def g15_trace_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks grown over each vector's image as it is."""
    return rounded(jobs.trace_networks(tiles(spark, sf_dir), 0.1, 0.05, 70, 4)[1])


@query()
def g19_assign_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracted networks of those with fibres."""
    return rounded(graphs.assign_networks(*graph(spark, sf_dir))[2])


@query()
def g16_build_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks traced over tiles of 64 vectors each."""
    return rounded(jobs.build_networks(mosaics(spark, sf_dir))[1])


@query()
def g18_assign_fibres(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = graphs.assign_fibres(*graph(spark, sf_dir))
    return f.groupBy("image_id", "network_id", "fibre_id").agg(F.count("*").alias("n"), F.sum(F.col("seq") * F.col("node_id")).alias("path"))


@query()
def a9_network_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.network_table(kept(graphs.network_parts(*graph(spark, sf_dir)), "networks")))


@query(
    f"WITH RECURSIVE {GR}, {DEG}, {REACH}, cm AS (SELECT cc.image_id, component, count(*) AS n_nodes, count(*) FILTER (WHERE degree > 2) AS cross_links FROM cc JOIN dg USING (image_id, node_id) GROUP BY 1, 2), "
    "w AS (SELECT bo.image_id, component, a, b, sum(r) OVER (PARTITION BY bo.image_id, a) AS da, sum(r) OVER (PARTITION BY bo.image_id, b) AS db FROM bo JOIN cc ON cc.image_id = bo.image_id AND cc.node_id = bo.a), "
    f"co AS (SELECT image_id, component, CASE WHEN stddev_pop(da) * stddev_pop(db) > 1e-12 THEN pow(covar_pop(da, db) / (stddev_pop(da) * stddev_pop(db)), 2) END AS degree FROM w GROUP BY 1, 2) SELECT image_id, component, n_nodes, cross_links, {q6('degree')} AS degree FROM cm LEFT JOIN co USING (image_id, component)"
)
def a9_component_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What network_table() counts over whole components, for every component of the foreground graphs."""
    n, e = graph(spark, sf_dir)
    c = kept(components.connected_components(n, e), "components")
    own = e.join(c.withColumnRenamed("node_id", "src"), ["image_id", "src"])
    return rounded(graphs.component_metrics(c, own, ("image_id", "component")))


@query()
def a7_a8_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.spectra(graph(spark, sf_dir)[1], ("image_id",)))


@query()
def a7_a8_whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum of one graph made of a whole table: parts and suppliers, joined by the lines that name both."""
    li = table(spark, sf_dir, "lineitem")
    e = li.groupBy((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).agg(F.count("*").cast("double").alias("r"))
    eigenvalue, connectivity = spectra.graph_spectrum(e)
    return rounded(spark.createDataFrame([(eigenvalue, connectivity)], "eigenvalue double, connectivity double"))


def database(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """One of the four tables: bright parts as fibres, dark parts as cells, foreground graphs as networks."""
    n, e = graph(spark, sf_dir)
    p = pixels(spark, sf_dir).drop("label")
    fibre, cell = (components.label_images(p.filter(c), SIDE) for c in ("v > 0.1", "v < -0.1"))
    return jobs.metric_databases(fibre, cell, graphs.network_parts(n, e), p, (which,))[which]


@query()
def a14_metric_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(database(spark, sf_dir, "global"))


@query(f"WITH RECURSIVE {segments_sql('v > 0.1', 'fibre')} {SEGMENT_ROWS}")
def a14_fibre_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(database(spark, sf_dir, "fibre"))


@query()
def a14_network_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(database(spark, sf_dir, "network"))


@query(f"WITH RECURSIVE {segments_sql('v < -0.1', 'cell')} {SEGMENT_ROWS}")
def a14_cell_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(database(spark, sf_dir, "cell"))


@query("SELECT l_orderkey % 100 AS k, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) + 0.0 AS price, round(avg(l_discount), 6) + 0.0 AS discount FROM (SELECT l_orderkey, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount FROM lineitem) GROUP BY 1")
def a1_nanmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 100).alias("k")).agg((F.round(stats.nanmean(F.col("l_extendedprice"), F.col("l_quantity")), 4) + 0.0).alias("price"), r6(stats.nanmean(F.col("l_discount"))).alias("discount"))


@query("SELECT l_suppkey AS image_id, round(sum(CAST(l_extendedprice AS DOUBLE) * CAST(l_quantity AS DOUBLE)) / nullif(sum(CAST(l_quantity AS DOUBLE)), 0), 4) + 0.0 AS l_extendedprice, round(sum(CAST(l_tax AS DOUBLE) * CAST(l_quantity AS DOUBLE)) / nullif(sum(CAST(l_quantity AS DOUBLE)), 0), 4) + 0.0 AS l_tax FROM lineitem GROUP BY 1")
def a2_metric_averaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "image_id")
    out = stats.metric_averages(li, ["l_extendedprice", "l_tax", "absent"], "l_quantity")
    return out.select("image_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("l_extendedprice", "l_tax")])


@query("WITH e AS (SELECT event_type, CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL), s AS (SELECT event_type, min(v) AS lo, max(v) AS hi FROM e GROUP BY 1), b AS (SELECT event_type, coalesce(least(floor((v - lo) * 200 / nullif(hi - lo, 0)), 199), 0) AS b, count(*) AS n FROM e JOIN s USING (event_type) GROUP BY 1, 2) SELECT event_type, round(sum(n) / (200.0 * max(n)), 6) + 0.0 AS sdi FROM b GROUP BY 1")
def a3_angle_sdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.angle_sdi(table(spark, sf_dir, "events"), ("event_type",), "value"))


@query(f"WITH {PX}, fn AS (SELECT image_id, y AS fibre_id, x AS seq, CAST(y + round(v * 10) AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM px), st AS (SELECT *, sqrt(CAST((y - lag(y) OVER w) * (y - lag(y) OVER w) + (x - lag(x) OVER w) * (x - lag(x) OVER w) AS DOUBLE)) AS d FROM fn WINDOW w AS (PARTITION BY image_id, fibre_id ORDER BY seq)), g AS (SELECT image_id, fibre_id, count(*) AS n_nodes, sum(d) AS length, max(CASE WHEN seq = 7 THEN y END) - max(CASE WHEN seq = 0 THEN y END) AS dy, 7 AS dx FROM st GROUP BY 1, 2), h AS (SELECT *, sqrt(CAST(dy * dy + dx * dx AS DOUBLE)) AS displacement FROM g) SELECT image_id, fibre_id, n_nodes, {q6('length')} AS length, {q6('displacement')} AS displacement, {q6('displacement / length')} AS waviness, {q6('acos(-dx / displacement) * 180 / pi()')} AS angle FROM h")
def a4_fibre_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    f = p.select("image_id", F.col("y").alias("fibre_id"), F.col("x").alias("seq"), (F.col("y") + F.round(F.col("v") * 10)).cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    out = stats.fibre_properties(f, ("image_id", "fibre_id"))
    return rounded(out.select("image_id", "fibre_id", "n_nodes", "length", "displacement", "waviness", "angle"))


@query(f"WITH {GR}, {DEG} SELECT image_id, round(count(*) FILTER (WHERE degree > 2) / 8.0, 6) + 0.0 AS cross_link_density FROM dg GROUP BY 1")
def a5_cross_link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return rounded(graphs.cross_link_density(n, e, n.select("image_id").distinct().withColumn("n_fibres", F.lit(8))))


@query(f"WITH {GR}, {DEG}, w AS (SELECT image_id, a, sum(r) AS d FROM bo GROUP BY 1, 2), p AS (SELECT bo.image_id, x.d AS da, y.d AS db FROM bo JOIN w x ON x.image_id = bo.image_id AND x.a = bo.a JOIN w y ON y.image_id = bo.image_id AND y.a = bo.b), c AS (SELECT image_id, covar_pop(da, db) AS c, stddev_pop(da) * stddev_pop(db) AS s FROM p GROUP BY 1) SELECT image_id, round(CASE WHEN s > 1e-12 THEN (c / s) * (c / s) END, 6) + 0.0 AS degree FROM c")
def a6_degree_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.degree_correlation(graph(spark, sf_dir)[1]))


@query(f"WITH {GR} SELECT e.image_id, src, dst, {q6('r')} AS r, CAST(a.y AS DOUBLE) AS y0, CAST(a.x AS DOUBLE) AS x0, CAST(b.y AS DOUBLE) AS y1, CAST(b.x AS DOUBLE) AS x1 FROM edges e JOIN nodes a ON a.image_id = e.image_id AND a.node_id = src JOIN nodes b ON b.image_id = e.image_id AND b.node_id = dst")
def s17_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs to JSON and back: the edges with the places of their ends."""
    n, e = graph(spark, sf_dir)
    nodes = n.select("image_id", "node_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    back_n, back_e = stores.graphs_from_json(stores.graphs_to_json(nodes, e))
    for end, k in (("src", 0), ("dst", 1)):
        back_e = back_e.join(back_n.withColumnsRenamed({"node_id": end, "y": f"y{k}", "x": f"x{k}"}), ["image_id", end])
    return rounded(back_e.select("image_id", "src", "dst", "r", "y0", "x0", "y1", "x1"))


def long_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Foreground pixels as nodes, each joined to the next but two in row-major order."""
    n = graph(spark, sf_dir)[0]
    dst = F.lead("node_id", 3).over(Window.partitionBy("image_id").orderBy("node_id"))
    return n, n.select("image_id", F.col("node_id").alias("src"), dst.alias("dst"), F.lit(1.0).alias("r")).filter("dst is not null")


GONE = "len(list_filter(range(1, abs({1} - {0}) + 1), lambda k: (2 * k - 1) * n <= 2 * abs({1} - {0}) * t))"
LONG = f"{GR}, lg AS (SELECT image_id, y AS y0, x AS x0, lead(y, 3) OVER w AS y1, lead(x, 3) OVER w AS x1 FROM nodes WINDOW w AS (PARTITION BY image_id ORDER BY node_id)), ln AS (SELECT *, greatest(abs(y1 - y0), abs(x1 - x0)) AS n FROM lg WHERE y1 IS NOT NULL), ra AS (SELECT DISTINCT image_id, CAST(y0 + sign(y1 - y0) * {GONE.format('y0', 'y1')} AS INTEGER) AS y, CAST(x0 + sign(x1 - x0) * {GONE.format('x0', 'x1')} AS INTEGER) AS x FROM (SELECT *, unnest(range(0, n + 1)) AS t FROM ln) UNION SELECT image_id, y, x FROM nodes)"


@query(f"WITH {LONG} SELECT image_id, y, x FROM ra")
def r11_rasterise_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.rasterise(*long_graph(spark, sf_dir))


HOLES = "wd AS (SELECT DISTINCT p.image_id, p.y, p.x FROM px p JOIN fg f ON f.image_id = p.image_id AND abs(f.y - p.y) + abs(f.x - p.x) <= 1), wi AS (SELECT DISTINCT p.image_id, p.y, p.x FROM px p JOIN wd f ON f.image_id = p.image_id AND abs(f.y - p.y) <= 1 AND abs(f.x - p.x) <= 1), bk AS (SELECT image_id, y, x, y * 8 + x AS id FROM px ANTI JOIN wi USING (image_id, y, x)), br(image_id, id, root) AS (SELECT image_id, id, id FROM bk UNION SELECT b.image_id, b.id, r.root FROM br r JOIN bk a ON a.image_id = r.image_id AND a.id = r.id JOIN bk b ON b.image_id = a.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1), bl AS (SELECT image_id, id, min(root) AS part FROM br GROUP BY 1, 2), bs AS (SELECT image_id, part FROM bl GROUP BY 1, 2 HAVING count(*) >= 4)"


@query(f"WITH RECURSIVE {GR.replace('WHERE v >= m', 'WHERE v >= m + 0.15')}, {HOLES} SELECT image_id, y, x FROM px WHERE (image_id, y * 8 + x) NOT IN (SELECT (image_id, id) FROM bl JOIN bs USING (image_id, part))")
def r12_network_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of the brightest pixels drawn, widened, smoothed, holes filled."""
    p = pixels(spark, sf_dir)
    mean = F.avg("v").over(Window.partitionBy("image_id"))
    top = p.withColumn("m", mean).filter("v >= m + 0.15").select("image_id", "y", "x")
    nodes = top.withColumn("node_id", (F.col("y") * SIDE + F.col("x")).cast("long"))
    n, e = graph(spark, sf_dir)
    e = e.join(nodes.select("image_id", F.col("node_id").alias("src")), ["image_id", "src"]).join(nodes.select("image_id", F.col("node_id").alias("dst")), ["image_id", "dst"])
    wide = masks.smooth(masks.dilate(masks.rasterise(nodes, e), SIDE, SIDE, 1, ("image_id",)), SIDE, SIDE, 0.3, ("image_id",))
    return components.fill_small(wide, p, SIDE, SIDE, 4)


FILTERED = f"{GR}, dr AS (SELECT p.image_id, p.y, p.x, CASE WHEN f.v IS NULL THEN 0.25 ELSE 2.0 END AS v FROM px p LEFT JOIN fg f ON f.image_id = p.image_id AND f.y = p.y AND f.x = p.x), {GAUSS}, ga AS (SELECT image_id, CAST(t AS INTEGER) AS y, x, sum(w * v) AS v FROM dr JOIN m ON m.s = dr.y GROUP BY 1, 2, 3), fl AS (SELECT image_id, y, CAST(t AS INTEGER) AS x, sum(w * v) AS v FROM ga JOIN m ON m.s = ga.x GROUP BY 1, 2, 3)"


@query(f"WITH {FILTERED} SELECT image_id, y, x, {q6('v')} AS v FROM fl")
def r13_fibre_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return rounded(jobs.fibre_filter(masks.rasterise(n, e), n, SIDE, SIDE))


@query(f"WITH RECURSIVE {FILTERED}, hi AS (SELECT image_id, y, x, v FROM fl WHERE v > 1.2), lo AS (SELECT image_id, y, x, v FROM fl WHERE v <= 1.2), {parts_sql('h', 'hi')}, {parts_sql('l', 'lo')} SELECT image_id, region_id, area, filled_area, 'fibre' AS tag FROM h_fa UNION ALL SELECT image_id, region_id, area, filled_area, 'cell' FROM l_fa")
def r18_segment_shg(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    s = jobs.segment_by_filter(jobs.fibre_filter(masks.rasterise(n, e), n, SIDE, SIDE), SIDE, SIDE, 1.2, fibre_above=True)
    return s.select("image_id", "region_id", "area", "filled_area", "tag")


@query()
def r19_segment_shg_pl_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fibre and cell segments of three-channel stacks, with the first channel's foreground as networks."""
    st = stacks(spark, sf_dir)
    network = masks.threshold_mean(st.filter("channel = '0'")).select("image_id", "y", "x")
    return rounded(jobs.segment_shg_pl_trans(st, network, SIDE, SIDE, min_sizes=(2, 2), min_fracs=(0.0, 0.0), swap_sizes=(4, 3), swap_fracs=(0.01, 0.1), holes=2, least=0.1, k=4, min_object=4))
