"""Queries over images and stacks: ranges, norms, derivatives, tensors and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions import pixels as px
from loomgrain.operators import clusters, masks, stencils
from loomgrain.plans.base import FG, PX, SIDE, ST, foreground, pixels, q6, query, r6, rounded, stacks, tiles


@query(f"WITH {PX}, b AS (SELECT image_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM px GROUP BY 1) SELECT image_id, y, x, {q6('least(greatest(v, lo), hi)')} AS v FROM px JOIN b USING (image_id)")
def p1_clip_intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.clip_intensities(pixels(spark, sf_dir), 2, 98).select("image_id", "y", "x", "v"))


@query(f"WITH {PX}, b AS (SELECT image_id, min(v) FILTER (WHERE k >= ceil(0.02 * n)) AS lo, min(v) FILTER (WHERE k >= ceil(0.98 * n)) AS hi FROM (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM px) GROUP BY 1) SELECT image_id, y, x, {q6('least(greatest(v, lo), hi)')} AS v FROM px JOIN b USING (image_id)")
def p1_clip_intensities_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of up to a sketch's size: its quantiles are values of exact rank."""
    return rounded(px.clip_intensities_sketched(pixels(spark, sf_dir), 2, 98).select("image_id", "y", "x", "v"))


@query(f"WITH {PX}, b AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1) SELECT image_id, y, x, round(CASE WHEN lo < 0 THEN coalesce((v - lo) / nullif(hi - lo, 0), 0) * 2 - 1 ELSE coalesce((v - lo) / nullif(hi - lo, 0), 0) END, 6) + 0.0 AS v FROM px JOIN b USING (image_id)")
def p2_rescale_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.rescale(pixels(spark, sf_dir)).select("image_id", "y", "x", "v"))


@query(f"WITH {ST} SELECT image_id, CAST(channel AS VARCHAR) AS channel, y, x, round(CASE WHEN n <> 0 THEN v / n ELSE v END, 6) + 0.0 AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY image_id, y, x)) AS n FROM st)")
def p3_normalise_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.normalise_stack(stacks(spark, sf_dir)).select("image_id", "channel", "y", "x", "v"))


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS r FROM embeddings) SELECT vec_id, round(CASE WHEN r <> 0 THEN CAST(embedding[1] AS DOUBLE) / r ELSE 0.0 END, 6) + 0.0 AS first, round(CASE WHEN r <> 0 THEN CAST(embedding[64] AS DOUBLE) / r ELSE 0.0 END, 6) + 0.0 AS last FROM n")
def p4_unit_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = tiles(spark, sf_dir).select("image_id", px.unit_vector(F.col("data")).alias("u"))
    return u.select(F.col("image_id").alias("vec_id"), r6(F.col("u")[0]).alias("first"), r6(F.col("u")[63]).alias("last"))


RGB = "rgb AS (SELECT image_id, y, x, max(v) FILTER (WHERE channel = 0) AS red, sqrt(max(v) FILTER (WHERE channel = 1) * max(v) FILTER (WHERE channel = 2)) AS green, max(v) FILTER (WHERE channel = 2) AS blue FROM st GROUP BY 1, 2, 3)"


@query(f"WITH {ST}, {RGB} SELECT image_id, y, x, {q6('red')} AS red, {q6('green')} AS green FROM rgb")
def p5_composite_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two colours of the composite; the third is adaptively equalised: p5_composite_blue."""
    return rounded(clusters.composite_rgb(stacks(spark, sf_dir)).drop("blue"))


@query()
def p5_composite_blue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.composite_rgb(stacks(spark, sf_dir)).select("image_id", "y", "x", "blue"))


@query(f"WITH {ST}, {RGB}, g AS (SELECT image_id, y, x, 0.2125 * red + 0.7154 * green + 0.0721 * blue AS l FROM rgb) SELECT image_id, y, x, round(l / nullif(max(l) OVER (PARTITION BY image_id), 0), 6) + 0.0 AS grey FROM g")
def p6_greyscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.greyscale(px.composite(stacks(spark, sf_dir))))


@query(f"WITH {PX} SELECT image_id, y, x, {q6('CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN v ELSE 0 END')} AS v FROM px")
def p7_clear_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.clear_border(pixels(spark, sf_dir), 1).select("image_id", "y", "x", "v"))


@query(f"WITH {PX} SELECT image_id, CAST((CASE WHEN y < 4 THEN 0 ELSE 1 END) * 3 + (CASE WHEN x < 3 THEN 0 WHEN x < 6 THEN 1 ELSE 2 END) AS INTEGER) AS tile_id, count(*) AS n, {q6('sum(v)')} AS total FROM px GROUP BY 1, 2")
def p8_split_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = px.split_tiles(pixels(spark, sf_dir), 3, 2)
    return t.groupBy("image_id", "tile_id").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


@query(f"WITH {PX} SELECT image_id, count(*) AS n, {q6('sum(v)')} AS total FROM px WHERE greatest(abs(y - 3), abs(x - 4)) IN (1, 3) GROUP BY 1")
def p9_ring_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.ring_mask(pixels(spark, sf_dir), 3, 4, (1, 3)).groupBy("image_id").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


@query("SELECT DISTINCT label FROM embeddings WHERE label <> 0")
def p10_label_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.label_set(tiles(spark, sf_dir), 0)


@query(f"WITH {ST}, w AS (SELECT image_id, y, x, max(v) FILTER (WHERE channel = 0) AS a, max(v) FILTER (WHERE channel = 1) AS b, max(v) FILTER (WHERE channel = 2) AS c FROM st GROUP BY 1, 2, 3), u AS (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM w) SELECT image_id, y, x, {q6('asin(least(a / n, 1.0))')} AS theta0, {q6('asin(least(b / n, 1.0))')} AS theta1, {q6('acos(least(c / n, 1.0))')} AS theta2 FROM u WHERE n > 0")
def p11_spherical_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = px.normalise_stack(stacks(spark, sf_dir)).groupBy("image_id", "y", "x").pivot("channel", ["0", "1", "2"]).agg(F.first("v"))
    a, b, c = px.spherical(F.col("0"), F.col("1"), F.col("2"))
    return w.filter("`0` + `1` + `2` > 0").select("image_id", "y", "x", r6(a).alias("theta0"), r6(b).alias("theta1"), r6(c).alias("theta2"))


D1 = "d1 AS (SELECT image_id, y, x, v, coalesce(CASE WHEN y = 0 THEN lead(v) OVER c - v WHEN y = 7 THEN v - lag(v) OVER c ELSE (lead(v) OVER c - lag(v) OVER c) / 2 END, 0) AS dy, coalesce(CASE WHEN x = 0 THEN lead(v) OVER r - v WHEN x = 7 THEN v - lag(v) OVER r ELSE (lead(v) OVER r - lag(v) OVER r) / 2 END, 0) AS dx FROM px WINDOW c AS (PARTITION BY image_id, x ORDER BY y), r AS (PARTITION BY image_id, y ORDER BY x))"
NEM = f"{D1}, tn AS (SELECT image_id, y, x, v, coalesce(dx * dx / nullif(dy * dy + dx * dx, 0), 0) AS jxx, coalesce(-dy * dx / nullif(dy * dy + dx * dx, 0), 0) AS jxy, coalesce(dy * dy / nullif(dy * dy + dx * dx, 0), 0) AS jyy FROM d1)"
SOB = "n8 AS (SELECT a.image_id, a.y, a.x, a.v, sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y))) / 4 AS ix, sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x))) / 4 AS iy FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3, 4), so AS (SELECT image_id, y, x, v, ix * ix AS jxx, ix * iy AS jxy, iy * iy AS jyy FROM n8)"


def analysed(source: str) -> str:
    """SQL of tensor_analysis() over a tensor table."""
    ratio = "coalesce(sqrt((jxx - jyy) * (jxx - jyy) + 4 * jxy * jxy) / nullif(jxx + jyy, 0), 0)"
    return f"ta AS (SELECT *, {ratio} * {ratio} AS coherence, atan2(2 * jxy, jyy - jxx) * (90 / pi()) AS angle, abs(jxx) + abs(jyy) AS energy FROM {source})"


@query(f"WITH {PX}, {D1}, d2 AS (SELECT image_id, y, x, dy, dx, CASE WHEN y = 0 THEN lead(dy) OVER c - dy WHEN y = 7 THEN dy - lag(dy) OVER c ELSE (lead(dy) OVER c - lag(dy) OVER c) / 2 END AS dyy, CASE WHEN y = 0 THEN lead(dx) OVER c - dx WHEN y = 7 THEN dx - lag(dx) OVER c ELSE (lead(dx) OVER c - lag(dx) OVER c) / 2 END AS dydx, CASE WHEN x = 0 THEN lead(dy) OVER r - dy WHEN x = 7 THEN dy - lag(dy) OVER r ELSE (lead(dy) OVER r - lag(dy) OVER r) / 2 END AS dxdy, CASE WHEN x = 0 THEN lead(dx) OVER r - dx WHEN x = 7 THEN dx - lag(dx) OVER r ELSE (lead(dx) OVER r - lag(dx) OVER r) / 2 END AS dxx FROM d1 WINDOW c AS (PARTITION BY image_id, x ORDER BY y), r AS (PARTITION BY image_id, y ORDER BY x)) SELECT image_id, y, x, {', '.join(q6(c) + ' AS ' + c for c in ('dy', 'dx', 'dyy', 'dydx', 'dxdy', 'dxx'))} FROM d2")
def f2_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.derivatives(pixels(spark, sf_dir), 2).select("image_id", "y", "x", "dy", "dx", "dyy", "dydx", "dxdy", "dxx"))


GAUSS = "k AS (SELECT o, exp(-0.5 * o * o / 0.25) / sum(exp(-0.5 * o * o / 0.25)) OVER () AS w FROM (SELECT unnest(range(-2, 3)) AS o)), m AS (SELECT t, o, w, CASE WHEN t + o < 0 THEN -(t + o) - 1 WHEN t + o > 7 THEN 15 - (t + o) ELSE t + o END AS s FROM k, (SELECT unnest(range(0, 8)) AS t))"
J3 = ", ".join(q6(c) + " AS " + c for c in ("jxx", "jxy", "jyy"))


@query(f"WITH {PX}, {SOB} SELECT image_id, y, x, {J3} FROM so")
def f3_structure_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.structure_tensor(pixels(spark, sf_dir)).drop("channel"))


@query(f"WITH {PX}, {NEM} SELECT image_id, y, x, {J3} FROM tn")
def f4_nematic_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.nematic_tensor(pixels(spark, sf_dir)).drop("channel"))


#: A blur of 0.5 along one axis: mirrored() and with 0 beyond the border.
ZERO = "k AS (SELECT o, exp(-0.5 * o * o / 0.25) / sum(exp(-0.5 * o * o / 0.25)) OVER () AS w FROM (SELECT unnest(range(-2, 3)) AS o)), m AS (SELECT t, o, w, t + o AS s FROM k, (SELECT unnest(range(0, 8)) AS t))"


def blurred_sql(source: str) -> str:
    one = ", ".join(f"sum(w * {c}) AS {c}" for c in ("jxx", "jxy", "jyy"))
    two = ", ".join(f"round(sum(w * {c}), 6) + 0.0 AS {c}" for c in ("jxx", "jxy", "jyy"))
    return f"bl AS (SELECT image_id, CAST(t AS INTEGER) AS y, x, {one} FROM {source} JOIN m ON m.s = {source}.y GROUP BY 1, 2, 3) SELECT image_id, y, CAST(t AS INTEGER) AS x, {two} FROM bl JOIN m ON m.s = bl.x GROUP BY 1, 2, 3"


@query(f"WITH {PX}, {SOB}, {ZERO}, {blurred_sql('so')}")
def f3_blurred_structure_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.structure_tensor(pixels(spark, sf_dir), 0.5).drop("channel"))


@query(f"WITH {PX}, {NEM}, {GAUSS}, {blurred_sql('tn')}")
def f4_blurred_nematic_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.nematic_tensor(pixels(spark, sf_dir), 0.5).drop("channel"))


@query(f"WITH {PX}, {SOB}, {analysed('so')} SELECT image_id, y, x, {q6('coherence')} AS coherence, {q6('angle')} AS angle, {q6('energy')} AS energy FROM ta")
def f5_tensor_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.tensor_analysis(px.structure_tensor(pixels(spark, sf_dir))).select("image_id", "y", "x", "coherence", "angle", "energy"))


@query(f"WITH {PX}, {SOB}, {analysed('so')} SELECT image_id, y, x, {q6('(angle + 90) / 180')} AS hue, {q6('coalesce(coherence / nullif(max(coherence) OVER (PARTITION BY image_id), 0), 0)')} AS saturation, {q6('coalesce(v / nullif(max(v) OVER (PARTITION BY image_id), 0), 0)')} AS brightness FROM ta")
def p12_tensor_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return rounded(px.tensor_colour(px.structure_tensor(p), p.drop("label")).drop("channel"))


@query("SELECT label, count(*) AS n, round(sum(CAST(e AS DOUBLE)), 4) + 0.0 AS total FROM (SELECT label, unnest(embedding) AS e FROM embeddings) GROUP BY 1")
def p13_flatten_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tiles(spark, sf_dir).select("label", F.explode("data").alias("e"))
    return flat.groupBy("label").agg(F.count("*").alias("n"), (F.round(F.sum("e"), 4) + 0.0).alias("total"))




@query(f"WITH {PX}, {GAUSS}, a AS (SELECT image_id, CAST(t AS INTEGER) AS y, x, sum(w * v) AS v FROM px JOIN m ON m.s = px.y GROUP BY 1, 2, 3) SELECT image_id, y, CAST(t AS INTEGER) AS x, {q6('sum(w * v)')} AS v FROM a JOIN m ON m.s = a.x GROUP BY 1, 2, 3")
def f1_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.pixels_of(stencils.gaussian(tiles(spark, sf_dir), 0.5)).drop("channel"))


MIRROR = "m3 AS (SELECT t, greatest(least(t + o, 7), 0) AS s FROM (SELECT unnest(range(0, 8)) AS t), (SELECT unnest(range(-1, 2)) AS o))"


@query(f"WITH {PX}, {MIRROR} SELECT image_id, CAST(a.t AS INTEGER) AS y, CAST(b.t AS INTEGER) AS x, {q6('quantile_cont(v, 0.5)')} AS v FROM px JOIN m3 a ON a.s = px.y JOIN m3 b ON b.s = px.x GROUP BY 1, 2, 3")
def f9_median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.pixels_of(stencils.median_filter(tiles(spark, sf_dir), 3)).drop("channel"))


@query(f"WITH {PX}, s AS (SELECT *, min(v) OVER w AS lo, (max(v) OVER w - min(v) OVER w) / 256 AS st FROM px WINDOW w AS (PARTITION BY image_id)), b AS (SELECT *, least(floor((v - lo) / st), 255) AS b FROM s), side AS (SELECT *, greatest(least(b + CASE WHEN v < lo + (b + 0.5) * st THEN -1 ELSE 1 END, 255), 0) AS b2 FROM b), h AS (SELECT image_id, b, count(*) AS n FROM b GROUP BY 1, 2), c AS (SELECT image_id, b, sum(n) OVER (PARTITION BY image_id ORDER BY b) / 64.0 AS cdf FROM h), j AS (SELECT s.*, c.cdf, coalesce((SELECT max(c2.cdf) FROM c c2 WHERE c2.image_id = s.image_id AND c2.b <= s.b2), 0) AS cdf2 FROM side s JOIN c ON c.image_id = s.image_id AND c.b = s.b) SELECT image_id, y, x, round(CASE WHEN b2 = b THEN cdf ELSE cdf + (cdf2 - cdf) * abs(v - (lo + (b + 0.5) * st)) / st END, 5) + 0.0 AS v FROM j")
def f10_equalise_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = px.equalise(pixels(spark, sf_dir).drop("label"))
    return e.select("image_id", "y", "x", (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {FG}, o AS (SELECT unnest([0, -1, 1, 0, 0]) AS dy, unnest([0, 0, 0, -1, 1]) AS dx), s AS (SELECT image_id, y + dy AS y, x + dx AS x FROM fg, o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7), c AS (SELECT image_id, y, x, count(*) AS n FROM s GROUP BY 1, 2, 3) SELECT image_id, y, x, n = 5 AS eroded FROM c")
def f14_dilate_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the widened mask, and whether the narrowed one has them."""
    m = foreground(spark, sf_dir).select("image_id", "y", "x")
    small = masks.erode(m, SIDE, SIDE, keys=("image_id",)).withColumn("e", F.lit(True))
    return masks.dilate(m, SIDE, SIDE, keys=("image_id",)).join(small, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("e", F.lit(False)).alias("eroded"))


def stepped(name: str, source: str, narrow: bool) -> str:
    """SQL of one dilation of a pixel table, or of one erosion."""
    at_least = " HAVING count(*) = 5" if narrow else ""
    return f"{name} AS (SELECT p.image_id, p.y, p.x FROM px p JOIN {source} f ON f.image_id = p.image_id AND abs(f.y - p.y) + abs(f.x - p.x) <= 1 GROUP BY 1, 2, 3{at_least})"


@query(f"WITH {FG}, {stepped('er', 'fg', True)}, {stepped('op', 'er', False)}, {stepped('di', 'fg', False)}, {stepped('cl', 'di', True)} SELECT *, 'opened' AS part FROM op UNION ALL SELECT *, 'closed' FROM cl")
def f14_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = foreground(spark, sf_dir).select("image_id", "y", "x")
    opened = masks.opened(m, SIDE, SIDE, keys=("image_id",)).withColumn("part", F.lit("opened"))
    return opened.unionByName(masks.closed(m, SIDE, SIDE, keys=("image_id",)).withColumn("part", F.lit("closed")))


@query(f"WITH {FG} SELECT p.image_id, p.y, p.x FROM px p WHERE EXISTS (SELECT 1 FROM fg f WHERE f.image_id = p.image_id AND f.v > 0.2 AND abs(f.y - p.y) <= 2 AND abs(f.x - p.x) <= 2)")
def f17_smooth_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = foreground(spark, sf_dir).filter("v > 0.2").select("image_id", "y", "x")
    return masks.smooth(m, SIDE, SIDE, 0.5, keys=("image_id",))


@query(f"WITH {FG}, bg AS (SELECT image_id, y, x FROM px WHERE (image_id, y, x) NOT IN (SELECT (image_id, y, x) FROM fg)) SELECT f.image_id, f.y, f.x, {q6('sqrt(CAST(min((f.y - b.y) * (f.y - b.y) + (f.x - b.x) * (f.x - b.x)) AS DOUBLE))')} AS distance FROM fg f JOIN bg b ON f.image_id = b.image_id GROUP BY 1, 2, 3")
def f16_distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    mean = F.aggregate("data", F.lit(0.0), lambda s, v: s + v) / F.size("data")
    mask = t.withColumn("m", mean).withColumn("data", F.transform("data", lambda v: F.when(v >= F.col("m"), 1.0).otherwise(0.0)))
    d = px.pixels_of(stencils.distance_transform(mask)).filter("v > 0 and v < 1e9")
    return d.select("image_id", "y", "x", r6("v").alias("distance"))


@query(f"WITH {PX} SELECT a.image_id, a.y, a.x FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3, a.v HAVING a.v > max(b.v)")
def f18_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.pixels_of(stencils.local_maxima(tiles(spark, sf_dir))).filter("v > 0").select("image_id", "y", "x")


def slope(v: str, across: str, along: str) -> str:
    """Central differences along one axis of 8 x 8 images, one-sided at its ends."""
    w = f"OVER (PARTITION BY image_id, s, {across} ORDER BY {along})"
    return f"CASE {along} WHEN 0 THEN lead({v}) {w} - {v} WHEN 7 THEN {v} - lag({v}) {w} ELSE (lead({v}) {w} - lag({v}) {w}) / 2 END"


#: Blurs of widths 1 to 3 as 8 x 8 matrices with repeated edges, and the slopes of the blurred negated images.
RIDGE = f"""bw AS (SELECT s, k, exp(-0.5 * k * k / (s * s)) AS w FROM range(1, 4) a(s), range(-12, 13) b(k) WHERE abs(k) <= 4 * s), bm AS (SELECT s, i, least(greatest(i + k, 0), 7) AS j, sum(w / t) AS g FROM bw JOIN (SELECT s, sum(w) AS t FROM bw GROUP BY 1) USING (s), range(8) c(i) GROUP BY 1, 2, 3),
b1 AS (SELECT image_id, s, CAST(i AS INTEGER) AS y, x, -sum(g * v) AS v FROM px JOIN bm ON j = y GROUP BY 1, 2, 3, 4), b2 AS (SELECT image_id, s, y, CAST(i AS INTEGER) AS x, sum(g * v) AS v FROM b1 JOIN bm USING (s) WHERE j = x GROUP BY 1, 2, 3, 4),
s1 AS (SELECT *, {slope('v', 'x', 'y')} AS gy, {slope('v', 'y', 'x')} AS gx FROM b2), s2 AS (SELECT image_id, s, y, x, {slope('gy', 'x', 'y')} AS yy, {slope('gy', 'y', 'x')} AS yx, {slope('gx', 'y', 'x')} AS xx FROM s1)"""


@query(f"WITH {PX}, {RIDGE} SELECT image_id, y, x, {q6('max(greatest((yy + xx) / 2 + sqrt((yy - xx) * (yy - xx) / 4 + yx * yx), 0) * s * s)')} AS v FROM s2 GROUP BY 1, 2, 3")
def f6_tubeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.pixels_of(stencils.tubeness(tiles(spark, sf_dir), 3)).drop("channel"))


#: Minimum cross-entropy by rounds (l1), the first of 256 levels midway between the means beside it (l2), and what high pixels reach.
GROWN = f"""l0 AS (SELECT image_id, min(v) AS lo, max(v) AS hi, avg(v) AS mean, list(v) AS vs, min(v - b) / 2 AS tol FROM (SELECT image_id, v, nullif(lag(v) OVER (PARTITION BY image_id ORDER BY v), v) AS b FROM px) GROUP BY 1),
l1(image_id, k, t, stop) AS (SELECT image_id, 0, mean, false FROM l0 UNION ALL SELECT image_id, k + 1, new, abs(new - t) <= tol FROM (SELECT image_id, k, t, tol, lo + (back - front) / (ln(back) - ln(front)) AS new FROM (SELECT image_id, k, t, tol, lo, list_avg(list_filter(vs, lambda v: v > t)) - lo AS front, list_avg(list_filter(vs, lambda v: v <= t)) - lo AS back FROM l1 JOIN l0 USING (image_id) WHERE NOT stop AND k < 1000) WHERE back > 0 AND front IS NOT NULL)),
bi AS (SELECT image_id, lo, (hi - lo) / 256 AS w, least(floor((v - lo) * 256 / nullif(hi - lo, 0)), 255) AS b FROM px JOIN l0 USING (image_id)),
cu AS (SELECT image_id, lo + (k + 0.5) * w AS mid, w, (avg(lo + (b + 0.5) * w) FILTER (WHERE b <= k) + avg(lo + (b + 0.5) * w) FILTER (WHERE b > k)) / 2 - (lo + (k + 0.5) * w) AS gap FROM bi, range(255) t(k) GROUP BY image_id, lo, w, k),
l2 AS (SELECT image_id, coalesce(min(mid) FILTER (WHERE gap >= 0 AND gap < w), min(mid)) AS high FROM cu GROUP BY 1),
th AS (SELECT image_id, least(mean, li, high) AS low, high FROM l0 JOIN l2 USING (image_id) JOIN (SELECT image_id, max_by(t, k) AS li FROM l1 GROUP BY 1) USING (image_id)),
ab AS (SELECT image_id, y, x, v > high AS strong FROM px JOIN th USING (image_id) WHERE v > low),
gr(image_id, y, x) AS (SELECT image_id, y, x FROM ab WHERE strong UNION SELECT a.image_id, a.y, a.x FROM gr g JOIN ab a ON a.image_id = g.image_id AND abs(a.y - g.y) + abs(a.x - g.x) = 1)"""


@query(f"WITH RECURSIVE {PX}, {GROWN} SELECT image_id, y, x FROM gr")
def f7_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.pixels_of(stencils.hysteresis(tiles(spark, sf_dir), 1.0)).filter("v > 0").select("image_id", "y", "x")


@query()
def f8_nl_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.pixels_of(stencils.nl_means(tiles(spark, sf_dir), 3, 7)).drop("channel"))


@query()
def f12_equalise_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.pixels_of(stencils.equalise_adaptive(tiles(spark, sf_dir))).drop("channel"))


GROWN = "ax AS (SELECT t, CAST(floor(pos) AS INTEGER) AS lo, least(CAST(floor(pos) AS INTEGER) + 1, 7) AS hi, pos - floor(pos) AS f FROM (SELECT t, greatest(least((t + 0.5) * 8 / 12.0 - 0.5, 7.0), 0.0) AS pos FROM (SELECT unnest(range(0, 12)) AS t))), ro AS (SELECT image_id, t, x, sum(v * CASE WHEN lo = hi THEN 1 WHEN y = lo THEN 1 - f ELSE f END) AS v FROM px JOIN ax ON y = lo OR y = hi GROUP BY 1, 2, 3)"


@query(f"WITH {PX}, {GROWN} SELECT image_id, CAST(ro.t AS INTEGER) AS y, CAST(ax.t AS INTEGER) AS x, round(sum(v * CASE WHEN lo = hi THEN 1 WHEN x = lo THEN 1 - f ELSE f END), 6) + 0.0 AS v FROM ro JOIN ax ON x = lo OR x = hi GROUP BY 1, 2, 3")
def f13_rescale_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.pixels_of(stencils.rescale(tiles(spark, sf_dir), 1.5)).drop("channel"))


@query()
def f19_distance_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.pixels_of(stencils.distance_image(tiles(spark, sf_dir), 2.0)).drop("channel"))


@query()
def g17_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(px.pixels_of(stencils.preprocess(tiles(spark, sf_dir), patch=3, distance=5)).drop("channel"))


SCALED = """ch AS (SELECT image_id, y, x, c, CASE c WHEN 0 THEN red WHEN 1 THEN green ELSE blue END AS v FROM rgb, (SELECT unnest([0, 1, 2]) AS c)), cb AS (SELECT image_id, c, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM ch GROUP BY 1, 2), ci AS (SELECT image_id, c, y, x, floor(least(greatest(v, lo), hi) * 255.99999) AS v FROM ch JOIN cb USING (image_id, c)),
pi AS (SELECT t, CASE WHEN t < 0 THEN -t - 1 WHEN t > 7 THEN 15 - t ELSE t END AS s FROM (SELECT unnest(range(-2, 10)) AS t)), pd AS (SELECT image_id, c, a.t AS y, b.t AS x, v FROM ci JOIN pi a ON a.s = ci.y JOIN pi b ON b.s = ci.x),
sp AS (SELECT *, min(v) OVER w AS lo, (max(v) OVER w - min(v) OVER w) / 256 AS st FROM pd WINDOW w AS (PARTITION BY image_id, c)), bb AS (SELECT *, least(floor((v - lo) / st), 255) AS b FROM sp), sd AS (SELECT *, greatest(least(b + CASE WHEN v < lo + (b + 0.5) * st THEN -1 ELSE 1 END, 255), 0) AS b2 FROM bb),
hh AS (SELECT image_id, c, b, count(*) AS n FROM bb GROUP BY 1, 2, 3), cd AS (SELECT image_id, c, b, sum(n) OVER (PARTITION BY image_id, c ORDER BY b) / 144.0 AS cdf FROM hh), jn AS (SELECT s.*, d.cdf, coalesce((SELECT max(e.cdf) FROM cd e WHERE e.image_id = s.image_id AND e.c = s.c AND e.b <= s.b2), 0) AS cdf2 FROM sd s JOIN cd d ON d.image_id = s.image_id AND d.c = s.c AND d.b = s.b),
eq AS (SELECT image_id, c, y, x, CASE WHEN b2 = b THEN cdf ELSE cdf + (cdf2 - cdf) * abs(v - (lo + (b + 0.5) * st)) / st END AS v FROM jn),
d3 AS (SELECT unnest(range(-1, 2)) AS d), m1 AS (SELECT image_id, c, y + a.d AS y, x + b.d AS x, quantile_cont(v, 0.5) AS v FROM eq, d3 a, d3 b WHERE y + a.d BETWEEN -1 AND 8 AND x + b.d BETWEEN -1 AND 8 GROUP BY 1, 2, 3, 4), m2 AS (SELECT image_id, c, y + a.d AS y, x + b.d AS x, quantile_cont(v, 0.5) AS v FROM m1, d3 a, d3 b WHERE y + a.d BETWEEN 0 AND 7 AND x + b.d BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4),
sc AS (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, max(v) FILTER (WHERE c = 0) AS red, max(v) FILTER (WHERE c = 1) AS green, max(v) FILTER (WHERE c = 2) AS blue FROM m2 GROUP BY 1, 2, 3)"""


@query(f"WITH {ST}, {RGB}, {SCALED} SELECT image_id, y, x, {q6('red')} AS red, {q6('green')} AS green, {q6('blue')} AS blue, round((0.2125 * red + 0.7154 * green + 0.0721 * blue) / max(0.2125 * red + 0.7154 * green + 0.0721 * blue) OVER (PARTITION BY image_id), 6) + 0.0 AS grey FROM sc")
def f11_scale_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.scale_images(px.composite(stacks(spark, sf_dir))))


@query()
def k1_kmeans_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = clusters.kmeans_colours(px.composite(stacks(spark, sf_dir)), k=4)
    return k.groupBy("image_id", "run", "cluster").agg(F.count("*").alias("n"))


@query()
def k1_corpus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mini-batch model for all images: how many pixels each cluster has, and its mean."""
    labelled, _ = clusters.corpus_clusters(px.composite(stacks(spark, sf_dir)), k=4, share=0.2, rounds=15)
    return rounded(labelled.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in clusters.COLOURS]))


@query()
def k6_cell_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cell_masks(px.composite(stacks(spark, sf_dir)), k=4, min_object=4)


@query()
def k7_rgb_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell or fibre for every pixel, clustered at twice the size."""
    return clusters.rgb_segmentation(clusters.composite_rgb(stacks(spark, sf_dir)), 2.0, k=4, min_object=4)


def darkest_half(labels, centres, grey):
    """A classifier of one's own: the clusters of less than the mean brightness; the cost is their number."""
    light = centres.mean(axis=1)
    cells = light < light.mean()
    return cells, float(cells.sum())


@query()
def k8_own_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cell_masks(px.composite(stacks(spark, sf_dir)), k=4, min_object=2, classifier=darkest_half)


CL = f"{ST}, {RGB}, g0 AS (SELECT image_id, y, x, 0.2125 * red + 0.7154 * green + 0.0721 * blue AS l FROM rgb), gr AS (SELECT image_id, y, x, l / nullif(max(l) OVER (PARTITION BY image_id), 0) AS grey FROM g0), cl AS (SELECT r.image_id, CAST(r.y // 2 AS INTEGER) AS cluster, CAST(r.x // 4 AS INTEGER) AS run, avg(red) AS c0, avg(green) AS c1, avg(blue) AS c2, sum(grey) / nullif(count(*) FILTER (WHERE grey <> 0), 0) AS intensity FROM rgb r JOIN gr g ON r.image_id = g.image_id AND r.y = g.y AND r.x = g.x GROUP BY 1, 2, 3), un AS (SELECT *, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS n FROM cl), an AS (SELECT image_id, run, cluster, intensity, asin(least(c0 / n, 1.0)) AS a0, asin(least(c1 / n, 1.0)) AS a1, acos(least(c2 / n, 1.0)) AS a2 FROM un), co AS (SELECT image_id, run, -sum(abs(a0 - 0.65) + abs(a1 - 1.1) + abs(a2 - 1.4) + abs(intensity - 0.92)) AS cost FROM an GROUP BY 1, 2)"


def striped_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and intensities of clusters that are known beforehand: pairs of rows, two runs being the image's halves."""
    rgb = px.composite(stacks(spark, sf_dir))
    labels = rgb.select("image_id", "y", "x", F.floor(F.col("y") / 2).cast("int").alias("cluster"), F.floor(F.col("x") / 4).cast("int").alias("run"), "red", "green", "blue")
    light = clusters.cluster_intensity(labels, px.greyscale(rgb))
    centres = labels.groupBy("image_id", "run", "cluster").agg(F.array(F.avg("red"), F.avg("green"), F.avg("blue")).alias("centre"))
    return centres.join(light, ["image_id", "run", "cluster"])


@query(f"WITH {CL} SELECT image_id, run, cluster, {q6('intensity')} AS intensity FROM cl")
def k2_cluster_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(striped_clusters(spark, sf_dir).select("image_id", "run", "cluster", "intensity"))


@query(f"WITH {CL} SELECT image_id, run, cluster, {q6('a0')} AS a0, {q6('a1')} AS a1, {q6('a2')} AS a2, a0 <= 0.65 AND a1 <= 1.1 AND a2 <= 1.4 AND intensity <= 0.92 AS is_cell FROM an")
def k3_classify_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters.classify_clusters(striped_clusters(spark, sf_dir))
    return c.select("image_id", "run", "cluster", *[r6(F.col("angles")[i]).alias(f"a{i}") for i in range(3)], "is_cell")


@query(f"WITH {CL} SELECT image_id, run, {q6('cost')} AS cost FROM co")
def k4_separation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.separation_cost(clusters.classify_clusters(striped_clusters(spark, sf_dir))))


@query(f"WITH {CL} SELECT image_id, run, {q6('cost')} AS cost FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cost, run) AS k FROM co) WHERE k = 1")
def k5_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.best_run(clusters.separation_cost(clusters.classify_clusters(striped_clusters(spark, sf_dir)))))
