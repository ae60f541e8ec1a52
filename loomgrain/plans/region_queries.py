"""Queries over masks and regions: set operations, shape, texture, orientation, co-occurrence and labelled parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions import hooks, stats
from loomgrain.functions import pixels as px
from loomgrain.operators import components, masks, regions
from loomgrain.plans import jobs
from loomgrain.plans.base import FG, ORACLES, PX, SIDE, foreground, parts_sql, pixels, q6, query, r6, rounded
from loomgrain.plans.image_queries import SOB, analysed

TEX = "ent AS (SELECT image_id, -sum(n * 1.0 / t * log2(n * 1.0 / t)) AS entropy FROM (SELECT image_id, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY image_id) AS t FROM fg GROUP BY 1, 2) GROUP BY 1), tex AS (SELECT image_id, avg(v) AS mean, stddev_pop(v) AS std FROM fg GROUP BY 1)"


def one_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's foreground as one region, with values."""
    return foreground(spark, sf_dir).withColumn("region_id", F.lit(1))


@query(f"WITH {FG}, {TEX}, sh AS (SELECT image_id, count(*) AS area, count(*) * 1.0 / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS extent FROM fg GROUP BY 1), l AS (SELECT vec_id AS image_id, label FROM embeddings) SELECT label, count(*) AS n_images, CAST(sum(area) AS BIGINT) AS area, {q6('sum(mean * area) / sum(area)')} AS mean, {q6('sum(std * area) / sum(area)')} AS std, {q6('sum(entropy * area) / sum(area)')} AS entropy, {q6('sum(extent * area) / sum(area)')} AS extent FROM sh JOIN tex USING (image_id) JOIN ent USING (image_id) JOIN l USING (image_id) GROUP BY 1")
def w2_region_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted texture of each image set's foreground regions."""
    keys = ("label", "image_id")
    p = masks.threshold_mean(pixels(spark, sf_dir)).select(*keys, "y", "x", "v")
    box = (F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)
    per = p.groupBy(*keys).agg(F.count("*").alias("area"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.count("*") / box).alias("extent"))
    per = per.join(stats.entropy_of(p, keys), list(keys))
    out = per.groupBy("label").agg(F.count("*").alias("n_images"), F.sum("area").alias("area"), *[stats.nanmean(F.col(m), F.col("area")).alias(m) for m in ("mean", "std", "entropy", "extent")])
    return rounded(out)


@query(f"WITH {FG} SELECT DISTINCT image_id // 4 AS image_id, y, x FROM fg")
def r9_union_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = foreground(spark, sf_dir).select(F.floor(F.col("image_id") / 4).alias("image_id"), F.col("image_id").alias("mask_id"), "y", "x")
    return masks.union_masks(layers)


@query(f"WITH {FG}, t AS (SELECT p.image_id, p.y, p.x, f.v IS NOT NULL AS a, p.v > 0.1 AS b FROM px p LEFT JOIN fg f ON f.image_id = p.image_id AND f.y = p.y AND f.x = p.x) SELECT image_id, y, x, CASE WHEN NOT a THEN 'complement' WHEN NOT b THEN 'difference' ELSE 'intersection' END AS part FROM t")
def r10_mask_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    a = foreground(spark, sf_dir).select("image_id", "y", "x")
    b = p.filter("v > 0.1").select("image_id", "y", "x")
    told = masks.complement(a, p, SIDE, SIDE).withColumn("part", F.lit("complement"))
    told = told.unionByName(masks.difference(a, b).withColumn("part", F.lit("difference")))
    return told.unionByName(masks.intersect(a, b).withColumn("part", F.lit("intersection")))


@query(f"WITH {FG} SELECT image_id, count(*) AS n, {q6('min(v)')} AS least FROM fg GROUP BY 1")
def r16_threshold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreground(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n"), r6(F.min("v")).alias("least"))


SHAPE = "mo AS (SELECT image_id, count(*) AS area, min(y) AS min_y, min(x) AS min_x, max(y) + 1 AS max_y, max(x) + 1 AS max_x, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM fg GROUP BY 1), ec AS (SELECT *, sqrt((vy - vx) * (vy - vx) / 4 + c * c) AS h, (vy + vx) / 2 AS m FROM mo), bo AS (SELECT f.image_id, f.y, f.x FROM fg f JOIN fg g ON f.image_id = g.image_id AND abs(f.y - g.y) + abs(f.x - g.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) < 5), cd AS (SELECT a.image_id, a.y, a.x, sum(CASE WHEN a.y = b.y AND a.x = b.x THEN 1 WHEN a.y = b.y OR a.x = b.x THEN 2 ELSE 10 END) AS code FROM bo b JOIN bo a ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3), pe AS (SELECT image_id, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2.0) WHEN code IN (13, 23) THEN (1 + sqrt(2.0)) / 2 ELSE 0 END) AS perimeter FROM cd GROUP BY 1)"


@query(f"WITH {FG}, {SHAPE} SELECT image_id, area, {q6('area * 1.0 / ((max_y - min_y) * (max_x - min_x))')} AS extent, {q6('coalesce(sqrt(greatest(1 - (m - h) / nullif(m + h, 0), 0)), 0)')} AS eccentricity, {q6('perimeter')} AS perimeter, {q6('pi() * sqrt(4 * area / pi()) / nullif(perimeter, 0)')} AS circularity FROM ec JOIN pe USING (image_id)")
def r3_region_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = regions.region_shape(one_region(spark, sf_dir))
    return rounded(s.select("image_id", "area", "extent", "eccentricity", "perimeter", "circularity"))


@query(f"WITH {FG}, {TEX} SELECT image_id, {q6('mean')} AS mean, {q6('std')} AS std, {q6('entropy')} AS entropy FROM tex JOIN ent USING (image_id)")
def r4_region_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regions.region_texture(one_region(spark, sf_dir)).drop("region_id"))


COH = "coalesce(sqrt((jxx - jyy) * (jxx - jyy) + 4 * jxy * jxy) / nullif(jxx + jyy, 0), 0)"
STM = f"{SOB}, {analysed('so')}, rt AS (SELECT t.* FROM ta t JOIN fg USING (image_id, y, x)), me AS (SELECT image_id, avg(jxx) AS jxx, avg(jxy) AS jxy, avg(jyy) AS jyy, avg(coherence) AS local_coherence FROM rt GROUP BY 1), sp AS (SELECT image_id, min(energy) AS lo, max(energy) AS hi FROM rt GROUP BY 1), bn AS (SELECT image_id, coalesce(least(floor((energy - lo) * 200 / nullif(hi - lo, 0)), 199), 0) AS b, sum(coherence) AS s FROM rt JOIN sp USING (image_id) GROUP BY 1, 2), sd AS (SELECT image_id, sum(s) / nullif(200 * max(s), 0) AS angle_sdi FROM bn GROUP BY 1)"


@query(f"WITH {FG}, {STM} SELECT image_id, {q6(f'{COH} * {COH}')} AS coherence, {q6('local_coherence')} AS local_coherence, {q6('angle_sdi')} AS angle_sdi FROM me JOIN sd USING (image_id)")
def r7_structure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = px.structure_tensor(pixels(spark, sf_dir)).join(one_region(spark, sf_dir).drop("v"), ["image_id", "y", "x"])
    return rounded(regions.structure_metrics(t).select("image_id", "coherence", "local_coherence", "angle_sdi"))


@query(f"WITH {FG}, s AS (SELECT * FROM fg WHERE v > 0.15), b AS (SELECT image_id, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM s GROUP BY 1) SELECT image_id, count(*) AS n, {q6('sum(v)')} AS total FROM px JOIN b USING (image_id) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY 1")
def r8_bbox_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = regions.region_shape(one_region(spark, sf_dir).filter("v > 0.15"))
    got = regions.bbox_sample(shape, pixels(spark, sf_dir).select("image_id", "y", "x", "v"))
    return got.groupBy("image_id").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


GL = "gv AS (SELECT image_id, y, x, CAST(floor(least(abs(v), 1.0) * 255.99999) AS INTEGER) AS g FROM fg), of AS (SELECT * FROM (VALUES (1, 0, 0, 1), (1, 1, 1, 1), (1, 2, 1, 0), (1, 3, 1, -1), (2, 0, 0, 2), (2, 1, 1, 1), (2, 2, 2, 0), (2, 3, 1, -1)) t(distance, direction, dy, dx)), pr AS (SELECT a.image_id, distance, direction, a.g AS i, b.g AS j FROM gv a, of, gv b WHERE a.image_id = b.image_id AND b.y = a.y + dy AND b.x = a.x + dx), p2 AS (SELECT * FROM pr UNION ALL SELECT image_id, distance, direction, j, i FROM pr), gl AS (SELECT image_id, distance, direction, i, j, n / sum(n) OVER (PARTITION BY image_id, distance, direction) AS p FROM (SELECT image_id, distance, direction, i, j, CAST(count(*) AS DOUBLE) AS n FROM p2 GROUP BY ALL)), gz AS (SELECT * FROM gl WHERE i > 0 AND j > 0)"


def grey_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_region(spark, sf_dir).withColumn("v", F.least(F.abs("v"), F.lit(1.0)))


@query(f"WITH {FG}, {GL} SELECT image_id, distance, direction, count(*) AS pairs, {q6('sum(p)')} AS p, {q6('sum(p * abs(i - j))')} AS apart FROM gz GROUP BY 1, 2, 3")
def r5_glcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = regions.glcm(grey_regions(spark, sf_dir))
    return g.groupBy("image_id", "distance", "direction").agg(F.count("*").alias("pairs"), r6(F.sum("p")).alias("p"), r6(F.sum(F.col("p") * F.abs(F.col("i") - F.col("j")))).alias("apart"))


@query(f"WITH {FG}, {GL}, mu AS (SELECT image_id, distance, direction, sum(i * p * p) AS mu FROM gz GROUP BY 1, 2, 3), ea AS (SELECT image_id, distance, direction, sum(p * p) AS asm, sqrt(sum(p * p)) AS energy, -sum(p * ln(p)) AS entropy, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p / (1 + abs(i - j))) AS similarity, sum(p * i * j) AS autocorrelation, max(mu) AS mean, sum(p * (i - mu) * (j - mu)) AS covariance, sum(2 * p * mu) AS clustering, CASE WHEN sum(p * (i - mu) * (i - mu)) < 1e-30 THEN 1.0 ELSE sum(p * (i - mu) * (j - mu)) / sum(p * (i - mu) * (i - mu)) END AS correlation FROM gz JOIN mu USING (image_id, distance, direction) GROUP BY 1, 2, 3) SELECT image_id, {', '.join(f'round(avg({c}), 8) + 0.0 AS {c}' for c in ('asm', 'energy', 'entropy', 'contrast', 'dissimilarity', 'homogeneity', 'similarity', 'autocorrelation', 'mean', 'covariance', 'clustering', 'correlation'))} FROM ea GROUP BY 1")
def r6_glcm_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regions.glcm_props(regions.glcm(grey_regions(spark, sf_dir))).drop("region_id")
    return p.select("image_id", *[(F.round(c, 8) + 0.0).alias(c) for c in p.columns if c != "image_id"])


HI = f"{PX}, fg AS (SELECT image_id, y, x, v, y * 8 + x AS id FROM px WHERE v > 0.1)"
LAB = f"RECURSIVE_PLACEHOLDER {HI}, re(image_id, id, root) AS (SELECT image_id, id, id FROM fg UNION SELECT b.image_id, b.id, re.root FROM re JOIN fg a ON a.image_id = re.image_id AND a.id = re.id JOIN fg b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), lb AS (SELECT image_id, id, min(root) AS region_id FROM re GROUP BY 1, 2)".replace("RECURSIVE_PLACEHOLDER ", "")


def bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).filter("v > 0.1").select("image_id", "y", "x", "v")


@query(f"WITH RECURSIVE {LAB} SELECT image_id, CAST(id // 8 AS INTEGER) AS y, CAST(id % 8 AS INTEGER) AS x, region_id FROM lb")
def c1_label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.label_images(bright(spark, sf_dir), SIDE)


@query(f"WITH RECURSIVE {LAB} SELECT image_id, region_id, count(*) AS n FROM lb GROUP BY 1, 2")
def c1_label_large_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by rounds over the table, for images that don't fit a task."""
    return components.label_mask(bright(spark, sf_dir), SIDE).groupBy("image_id", "region_id").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {LAB}, s AS (SELECT image_id, region_id, count(*) AS area, {q6('sum(v)')} AS total FROM lb JOIN fg USING (image_id, id) GROUP BY 1, 2) SELECT image_id, region_id, area, total FROM s WHERE area >= 4".replace("area, total FROM s", "area, total FROM s"))
def f15_small_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of at least four pixels, with their total."""
    kept = components.drop_small(bright(spark, sf_dir), SIDE, 4, diagonal=True)
    parts = components.label_images(kept, SIDE).join(bright(spark, sf_dir), ["image_id", "y", "x"])
    return parts.groupBy("image_id", "region_id").agg(F.count("*").alias("area"), r6(F.sum("v")).alias("total"))


BG = f"{PX}, bgp AS (SELECT image_id, y, x, y * 8 + x AS id FROM px WHERE v <= 0.1), re(image_id, id) AS (SELECT image_id, id FROM bgp WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT b.image_id, b.id FROM re JOIN bgp a ON a.image_id = re.image_id AND a.id = re.id JOIN bgp b ON b.image_id = a.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1)"


@query(f"WITH RECURSIVE {BG} SELECT image_id, y, x FROM px WHERE (image_id, y * 8 + x) NOT IN (SELECT (image_id, id) FROM re)")
def f15_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bright(spark, sf_dir).select("image_id", "y", "x")
    return components.fill_enclosed(m, pixels(spark, sf_dir), SIDE, SIDE)


BR = f"{PX}, br AS (SELECT image_id, y, x, v FROM px WHERE v > 0.1), {parts_sql('a', 'br')}"
RANKED = "row_number() OVER (PARTITION BY image_id ORDER BY filled_area DESC, region_id) AS rank"


@query(f"WITH RECURSIVE {BR} SELECT image_id, region_id, area, filled_area, {q6('total')} AS total, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {RANKED} FROM a_fa WHERE filled_area >= 3 AND total / filled_area >= 0.12)")
def r1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of at least three filled pixels and a mean of at least 0.12, largest first."""
    return rounded(regions.regions(bright(spark, sf_dir), SIDE, SIDE, bright(spark, sf_dir), 3, 0.12))


@query(f"WITH RECURSIVE {BR}, bx AS (SELECT image_id, region_id FROM a_lb GROUP BY 1, 2 HAVING min(y) > 0 AND min(x) > 0 AND max(y) < 7 AND max(x) < 7) SELECT image_id, region_id, area, filled_area, {q6('total')} AS total FROM a_fa JOIN bx USING (image_id, region_id) WHERE filled_area >= 2 AND total / filled_area >= 0.11")
def r2_region_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size, mean and distance from the frame."""
    b = bright(spark, sf_dir)
    kept = regions.passing(regions.measured(b, SIDE, b), 2, 0.11, (SIDE, SIDE), total="total_v")
    return rounded(kept.select("image_id", "region_id", "area", "filled_area", F.col("total_v").alias("total")))


@query(f"WITH RECURSIVE {BR} SELECT image_id, region_id, area, filled_area, {q6('total')} AS total, CAST(rank AS INTEGER) AS rank, 'cell' AS tag FROM (SELECT *, {RANKED} FROM a_fa WHERE filled_area >= 2 AND total / filled_area >= 0.1)")
def r17_to_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regions.to_segments(bright(spark, sf_dir), "cell", SIDE, SIDE, bright(spark, sf_dir), 2, 0.1))


SWAP = f"""{PX}, im AS (SELECT image_id // 2 AS image_id, image_id % 2 AS k, y, x, v FROM px),
m0 AS (SELECT image_id, y, x, v FROM im WHERE k = 0 AND v > 0.1), {parts_sql('p', 'm0')},
p_t AS (SELECT image_id, region_id, sum(im.v) AS other FROM p_lb JOIN im USING (image_id, y, x) WHERE k = 1 GROUP BY 1, 2),
p_g AS (SELECT f.*, other / filled_area AS there, filled_area >= 3 AND total / filled_area >= 0.12 AS stays FROM p_fa f LEFT JOIN p_t USING (image_id, region_id)),
n0 AS (SELECT image_id, y, x FROM p_lb JOIN p_g USING (image_id, region_id) WHERE stays),
n1 AS (SELECT image_id, y, x FROM im WHERE k = 1 AND v > 0.1 UNION SELECT image_id, y, x FROM p_lb JOIN p_g USING (image_id, region_id) WHERE NOT stays AND there >= 0.12),
m1 AS (SELECT n1.image_id, n1.y, n1.x, im.v FROM n1 JOIN im ON k = 1 AND im.image_id = n1.image_id AND im.y = n1.y AND im.x = n1.x), {parts_sql('q', 'm1')},
q_t AS (SELECT image_id, region_id, sum(im.v) AS other FROM q_lb JOIN im USING (image_id, y, x) WHERE k = 0 GROUP BY 1, 2),
q_g AS (SELECT f.*, other / filled_area AS there, filled_area >= 3 AND total / filled_area >= 0.12 AS stays FROM q_fa f LEFT JOIN q_t USING (image_id, region_id))"""


@query(f"WITH RECURSIVE {SWAP} SELECT image_id, 0 AS mask_id, y, x FROM (SELECT image_id, y, x FROM n0 UNION SELECT image_id, y, x FROM q_lb JOIN q_g USING (image_id, region_id) WHERE NOT stays AND there >= 0.12) UNION ALL SELECT image_id, 1, y, x FROM q_lb JOIN q_g USING (image_id, region_id) WHERE stays")
def r14_region_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).select(F.floor(F.col("image_id") / 2).alias("image_id"), (F.col("image_id") % 2).cast("int").alias("mask_id"), "y", "x", "v")
    return regions.region_swap(p.filter("v > 0.1"), p, SIDE, (3, 3), (0.12, 0.12))


MEANS = """mk AS (SELECT image_id // 3 AS image_id, image_id AS mask_id, y, x FROM px WHERE v > 0.05), n AS (SELECT image_id, count(DISTINCT mask_id) AS n FROM mk GROUP BY 1), sh AS (SELECT image_id, y, x, count(*) AS k FROM mk GROUP BY 1, 2, 3), im AS (SELECT image_id // 3 AS image_id, y, x, sum(v) AS v FROM px GROUP BY 1, 2, 3),
th AS (SELECT image_id, y, x, v * coalesce(k, 0) / n.n > 0.02 AS on_ FROM im LEFT JOIN sh USING (image_id, y, x) JOIN n USING (image_id)),
nb AS (SELECT a.image_id, a.y, a.x, a.on_, coalesce(bool_or(b.on_), false) AS any_on, coalesce(bool_or(NOT b.on_), false) AS any_off FROM th a LEFT JOIN th b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2, 3, 4),
fi AS (SELECT image_id, y, x, on_ OR NOT any_off AS on_ FROM nb), ob AS (SELECT a.image_id, a.y, a.x FROM fi a JOIN fi b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.on_ WHERE a.on_ GROUP BY 1, 2, 3)"""


@query(f"WITH {PX}, {MEANS} SELECT DISTINCT f.image_id, f.y, f.x FROM fi f JOIN ob o ON o.image_id = f.image_id AND abs(o.y - f.y) + abs(o.x - f.x) <= 1")
def r15_mean_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three masks and the sum of their images; single-pixel holes and parts go, the rest is widened by one pixel."""
    p = pixels(spark, sf_dir)
    layers = p.filter("v > 0.05").select(F.floor(F.col("image_id") / 3).alias("image_id"), F.col("image_id").alias("mask_id"), "y", "x")
    whole = p.groupBy(F.floor(F.col("image_id") / 3).alias("image_id"), "y", "x").agg(F.sum("v").alias("v"))
    return masks.mean_of_masks(layers, whole, 0.02, SIDE, SIDE, area=2)


def segments_sql(condition: str, tag: str) -> str:
    """CTEs whose table sg is segment_table() of the parts of px where the condition holds; keys are image * 64 + part."""
    oriented = STM.replace("rt AS (SELECT t.* FROM ta t JOIN fg USING (image_id, y, x))", "rt AS (SELECT f.image_id, t.* EXCLUDE (image_id) FROM ta t JOIN fg f ON f.image_id // 64 = t.image_id AND f.y = t.y AND f.x = t.x)")
    made = f"{PX}, so_ AS (SELECT image_id, y, x, v FROM px WHERE {condition}), {parts_sql('s', 'so_')}, fg AS (SELECT image_id * 64 + region_id AS image_id, y, x, v FROM s_lb), {TEX}, {SHAPE}, {oriented}"
    return f"""{made}, sg AS (SELECT CAST(image_id // 64 AS BIGINT) AS image_id, CAST(image_id % 64 AS INTEGER) AS region_id, area, pi() * sqrt(4 * area / pi()) / nullif(perimeter, 0) AS circularity, coalesce(sqrt(greatest(1 - (m - h) / nullif(m + h, 0), 0)), 0) AS eccentricity, area * 1.0 / ((max_y - min_y) * (max_x - min_x)) AS coverage, mean, std, entropy, angle_sdi, {COH} * {COH} AS coherence, local_coherence, '{tag}' AS tag FROM ec JOIN pe USING (image_id) JOIN tex USING (image_id) JOIN ent USING (image_id) LEFT JOIN (me JOIN sd USING (image_id)) USING (image_id))"""


NUMBERS = ("circularity", "eccentricity", "coverage", "mean", "std", "entropy", "angle_sdi", "coherence", "local_coherence")
SEGMENT_ROWS = "SELECT image_id, region_id, area, " + ", ".join(f"{q6(c)} AS {c}" for c in NUMBERS) + ", tag FROM sg"


@query(f"WITH RECURSIVE {segments_sql('v > 0.1', 'fibre')} {SEGMENT_ROWS}")
def a10_segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = components.label_images(bright(spark, sf_dir), SIDE)
    return rounded(jobs.segment_table(parts, pixels(spark, sf_dir), "fibre"))


CELL_MEANS = ("circularity", "eccentricity", "mean", "std", "entropy", "angle_sdi", "coherence", "local_coherence")


@query(f"WITH RECURSIVE {segments_sql('v < -0.1', 'cell')} SELECT image_id, " + ", ".join(f"{q6(f'sum({c} * area) / sum(area) FILTER (WHERE {c} IS NOT NULL)')} AS cell_{c}" for c in CELL_MEANS) + f", count(*) AS no_cells, {q6('sum(area) / 64.0')} AS cell_coverage FROM sg GROUP BY 1")
def a13_global_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell metrics of each image: averages by area, number and coverage of its dark parts."""
    p = pixels(spark, sf_dir)
    cells = components.label_images(p.filter("v < -0.1"), SIDE)
    return rounded(jobs.cell_table(jobs.segment_table(cells, p, "cell"), p.groupBy("image_id").agg(F.count("*").alias("pixels"))))


@query(f"WITH {FG}, {TEX}, {STM}, ar AS (SELECT image_id, count(*) AS area FROM fg GROUP BY 1) SELECT image_id, area AS total_area, {q6('area / 64.0')} AS coverage, {q6('mean')} AS mean, {q6('entropy')} AS entropy, {q6('local_coherence')} AS local_coherence FROM ar JOIN tex USING (image_id) JOIN ent USING (image_id) JOIN me USING (image_id)")
def a12_image_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image row of a corpus with one segment an image: averages by area and coverage."""
    p = pixels(spark, sf_dir)
    seg = jobs.segment_table(one_region(spark, sf_dir).drop("v"), p, "fibre")
    size = p.groupBy("image_id").agg(F.count("*").alias("pixels"))
    whole = jobs.image_table(seg, size).join(seg.groupBy("image_id").agg(F.sum("area").alias("total_area")), "image_id")
    return rounded(whole.select("image_id", "total_area", "coverage", "mean", "entropy", "local_coherence"))


@query(f"WITH {FG} SELECT image_id, 'cell' AS tag, count(*) AS area, concat_ws('_', 'img' || image_id, 'cell_segment.npy') AS file FROM fg GROUP BY 1")
def a11_file_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = foreground(spark, sf_dir).groupBy("image_id").agg(F.lit("cell").alias("tag"), F.count("*").alias("area"))
    named = n.withColumn("name", F.concat(F.lit("img"), F.col("image_id").cast("string")))
    return jobs.file_tag(named, "name", "cell_segment.npy").drop("name")


@query(f"WITH {PX} SELECT image_id, count(*) AS n, {q6('max(v) - min(v)')} AS span FROM px GROUP BY 1")
def a15_own_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own per-image metric through the hook."""
    from loomgrain.operators.clusters import map_images

    def span(pdf):
        yield {"image_id": int(pdf["image_id"].iloc[0]), "n": len(pdf), "span": float(pdf["v"].max() - pdf["v"].min())}

    return rounded(map_images(pixels(spark, sf_dir).select("image_id", "v"), "image_id long, n long, span double", span))


@query(ORACLES["a15_own_metric"])
def a15_own_metric_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metric as SQL functions: an aggregate, and a table function over each image's pixels."""
    hooks.register_metric(spark, "own_span", lambda v: float(v.max() - v.min()))
    hooks.register_image_table(spark, "own_count", lambda pdf: iter([{"image_id": int(pdf["image_id"].iloc[0]), "n": len(pdf)}]), "image_id long, n long")
    pixels(spark, sf_dir).select("image_id", "v").createOrReplaceTempView("own_pixels")
    out = spark.sql("SELECT image_id, n, span FROM own_count(TABLE(own_pixels) PARTITION BY image_id) JOIN (SELECT image_id, own_span(v) AS span FROM own_pixels GROUP BY image_id) USING (image_id)")
    return rounded(out)
