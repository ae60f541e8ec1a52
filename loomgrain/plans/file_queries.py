"""Queries over file names, metadata, work lists and stacks. Names are made from documents' ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.plans.analysis import Outputs
from loomgrain.plans.base import PX, SIDE, parts_sql, pixels, q6, query, r6, rounded, table, tiles
from loomgrain.sources import files, tables

#: Endings of the made-up names, by id modulo their number.
ENDINGS = ("-pl-shg-acc2.tif", "-pl.tif", "-shg.tif", "-shg-display.tif", "-SHG-virada.tif", "-pl-shg.png", "-SHG-acc12.tif", ".tif")
NAMES = "nm AS (SELECT doc_id AS ord, source || '/img' || (doc_id // 40) || (ARRAY[" + ", ".join(f"'{e}'" for e in ENDINGS) + "])[doc_id % 8 + 1] AS path FROM documents), bs AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM nm)"
TYPED = f"{NAMES}, ty AS (SELECT *, CASE WHEN lower(base) LIKE '%-pl-shg%' THEN 'SHG-PL-Trans' WHEN lower(base) LIKE '%-pl%' THEN 'PL-Trans' WHEN lower(base) LIKE '%-shg%' THEN 'SHG' ELSE 'Unknown' END AS image_type, CASE WHEN lower(base) LIKE '%-pl-shg%' THEN '-pl-shg' WHEN lower(base) LIKE '%-pl%' THEN '-pl' WHEN lower(base) LIKE '%-shg%' THEN '-shg' END AS mark FROM bs), pf AS (SELECT ord, path, image_type, CASE WHEN mark IS NOT NULL THEN path[:length(path) - length(base) + strpos(lower(base), mark) - 1] END AS prefix FROM ty)"
SETS = f"{TYPED}, fs AS (SELECT prefix, max_by(path, ord) FILTER (WHERE image_type = 'SHG-PL-Trans') AS shg_pl_trans, max_by(path, ord) FILTER (WHERE image_type = 'PL-Trans') AS pl_trans, max_by(path, ord) FILTER (WHERE image_type = 'SHG') AS shg FROM pf WHERE image_type <> 'Unknown' GROUP BY 1)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ending = F.array(*[F.lit(e) for e in ENDINGS])[(F.col("doc_id") % len(ENDINGS)).cast("int")]
    return d.select(F.col("doc_id").alias("ord"), F.concat(F.col("source"), F.lit("/img"), F.floor(F.col("doc_id") / 40).cast("string"), ending).alias("path"))


@query(f"WITH {NAMES} SELECT ord, path FROM nm WHERE contains(path, 'shg')")
def s1_list_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.keep_key(names(spark, sf_dir), "shg")


@query(f"WITH {NAMES} SELECT ord, path FROM bs WHERE path LIKE '%.tif' AND base NOT LIKE '%display%' AND base NOT LIKE '%virada%'")
def s2_filter_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.image_files(names(spark, sf_dir))


@query(f"WITH {TYPED} SELECT ord, image_type FROM ty")
def s3_image_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("ord", files.image_type(F.col("path")).alias("image_type"))


@query(f"WITH {TYPED} SELECT ord, prefix FROM pf")
def s4_extract_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.typed_files(names(spark, sf_dir)).select("ord", "prefix")


@query(f"WITH {SETS} SELECT prefix, shg_pl_trans, pl_trans, shg FROM fs")
def s5_file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_sets(names(spark, sf_dir))


@query(f"WITH {SETS} SELECT prefix, CASE WHEN shg_pl_trans IS NOT NULL THEN 'combined' ELSE 'separate' END AS mode, CASE WHEN shg_pl_trans IS NOT NULL THEN shg_pl_trans ELSE shg || ',' || pl_trans END AS files FROM fs WHERE shg_pl_trans IS NOT NULL OR (shg IS NOT NULL AND pl_trans IS NOT NULL)")
def s6_select_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = files.select_files(files.file_sets(names(spark, sf_dir)))
    return s.withColumn("files", F.array_join("files", ","))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS n_modes FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND event_id % 2 = 0")
def s7_described_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON descriptions that lack a key can't be loaded: here the odd events'."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    dims = F.when(F.col("event_id") % 2 == 0, F.lit(', "xy_dim": [8, 8]')).otherwise(F.lit(""))
    d = e.select("event_id", F.concat(F.lit('{"n_modes": '), F.col("k"), dims, F.lit("}")).alias("description"))
    return files.described_meta(d).select("event_id", "n_modes")


#: Numbers of modes and slices and the order of axes come from an event's props, user and value; images are 100 x 100.
META = "ev AS (SELECT event_id, 2 + CAST(json_extract(props, '$.k') AS INTEGER) % 7 AS m, 10 + user_id % 80 AS s, CAST(floor(value) AS INTEGER) % 4 AS layout FROM events), sh AS (SELECT event_id, m, s, CASE layout WHEN 0 THEN [m, 100, 100] WHEN 1 THEN [m, s, 100, 100] WHEN 2 THEN [s, m, 100, 100] ELSE [m, 100, 100, s] END AS shape FROM ev)"


def acquired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", (2 + F.get_json_object("props", "$.k").cast("int") % 7).alias("m"), (10 + F.col("user_id") % 80).cast("int").alias("s"), (F.floor("value") % 4).alias("layout"))
    m, s, side = F.col("m"), F.col("s"), F.lit(100)
    shape = F.when(F.col("layout") == 0, F.array(m, side, side)).when(F.col("layout") == 1, F.array(m, s, side, side)).when(F.col("layout") == 2, F.array(s, m, side, side)).otherwise(F.array(m, side, side, s))
    return e.select("event_id", "m", "s", shape.alias("shape"), F.array(side, side).alias("xy_dim"))


@query(f"WITH {META}, ax AS (SELECT event_id, m, shape, list_position(shape, m) AS mode FROM sh) SELECT event_id, CAST(list_filter(range(1, len(shape) + 1), lambda i: i <> mode AND shape[i] <> 100)[1] - 1 AS INTEGER) AS minor_axis, m AS n_modes FROM ax WHERE m IS NOT NULL")
def s8_laser_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Gamma line for each mode."""
    a = acquired(spark, sf_dir).filter("m is not null")
    lines = F.concat(F.lit("Images\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: F.concat(F.lit("Gamma="), i.cast("string"))), "\n"), F.lit("\nend"))
    return files.laser_meta(a.withColumn("description", lines)).select("event_id", "minor_axis", "n_modes")


@query(f"WITH {META}, ax AS (SELECT event_id, shape, list_position(shape, s) AS minor FROM sh WHERE m IS NOT NULL) SELECT event_id, CAST(minor - 1 AS INTEGER) AS minor_axis, CAST(coalesce(list_filter(range(1, len(shape) + 1), lambda i: (minor IS NULL OR i <> minor) AND shape[i] <> 100)[1], -1) AS INTEGER) AS axis, CAST(CASE WHEN len(list_filter(range(1, len(shape) + 1), lambda i: (minor IS NULL OR i <> minor) AND shape[i] <> 100)) = 0 THEN 1 ELSE shape[list_filter(range(1, len(shape) + 1), lambda i: (minor IS NULL OR i <> minor) AND shape[i] <> 100)[1]] END AS INTEGER) AS n_modes FROM ax".replace("CAST(coalesce(list_filter(range(1, len(shape) + 1), lambda i: (minor IS NULL OR i <> minor) AND shape[i] <> 100)[1], -1) AS INTEGER) AS axis, ", ""))
def s9_stack_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of slices is named; modes are what is left."""
    a = acquired(spark, sf_dir).filter("m is not null")
    a = a.withColumn("description", F.concat(F.lit("images=1\nslices="), F.col("s").cast("string"), F.lit("\n")))
    return files.stack_meta(a).select("event_id", "minor_axis", "n_modes")


@query(f"WITH {NAMES} SELECT ord, coalesce(CAST(nullif(regexp_extract(regexp_replace(base, '\\.[^.]*$', ''), 'acc(\\d+)$', 1), '') AS INTEGER), 1) AS acc FROM bs")
def s10_accumulation_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("ord", files.accumulation_number(F.col("path")).alias("acc"))


@query(f"WITH {PX} SELECT image_id // 4 AS image_id, y, x, {q6('avg(v) / 2')} AS v FROM px GROUP BY 1, 2, 3")
def s11_average_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    raw = p.select(F.floor(F.col("image_id") / 4).alias("image_id"), "channel", (F.col("image_id") % 4).alias("slice"), "y", "x", "v", F.lit(2).alias("acc"))
    return rounded(tables.average_stack(raw).drop("channel"))


@query("SELECT vec_id AS image_id, CASE WHEN label % 2 = 0 AND vec_id % 3 = 1 THEN 'PL' WHEN label % 2 = 0 AND vec_id % 3 = 2 THEN 'Trans' ELSE 'SHG' END AS channel FROM embeddings WHERE label % 2 = 0 OR vec_id % 3 = 0")
def s12_order_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of even labels are from combined files, all others from separate ones, of which only the first channel counts."""
    source = F.when(F.col("label") % 2 == 0, "combined").otherwise("separate")
    raw = tiles(spark, sf_dir).select("image_id", source.alias("source"), (F.col("image_id") % 3).cast("int").alias("idx"))
    wanted = spark.createDataFrame([("combined", 0, "SHG"), ("combined", 1, "PL"), ("combined", 2, "Trans"), ("separate", 0, "SHG")], "source string, idx int, channel string")
    return tables.order_channels(raw, wanted)


@query("SELECT vec_id // 3 AS image_id, CASE WHEN count(*) = 3 THEN 'whole' ELSE 'channels' END AS verdict FROM embeddings GROUP BY 1")
def s13_verify_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    t = t.select(F.floor(F.col("image_id") / 3).alias("image_id"), (F.col("image_id") % 3).cast("string").alias("channel"), "height", "width", "data")
    good, bad = tables.verify_stacks(t, 3)
    return good.select("image_id").distinct().withColumn("verdict", F.lit("whole")).union(bad.select("image_id", F.col("reason").alias("verdict")))


@query("WITH c AS (SELECT vec_id // 3 AS image_id, vec_id, embedding FROM embeddings WHERE vec_id % 3 <> 1), s AS (SELECT image_id, count(*) AS k, sum(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE)))) AS total, bool_or(vec_id % 3 = 0) AS appended, sum(CASE WHEN vec_id % 3 = 0 THEN list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))) END) AS more FROM c GROUP BY 1) SELECT image_id, k + CAST(appended AS INTEGER) AS n_channels, 8 AS height, 8 AS width, CAST((k + CAST(appended AS INTEGER)) * 64 AS BIGINT) AS n_values, round(total + coalesce(more, 0), 5) + 0.0 AS total FROM s")
def s14_stack_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel removed, the first one appended again under another name, packed into stacks and unpacked; shape and sum."""
    t = tiles(spark, sf_dir)
    t = t.select(F.floor(F.col("image_id") / 3).alias("image_id"), (F.col("image_id") % 3).cast("string").alias("channel"), "height", "width", "data")
    more = t.filter("channel = '0'").withColumn("channel", F.lit("3"))
    wrong = more.withColumns({"channel": F.lit("4"), "width": F.col("width") + 1})  # another shape: left out
    grown = tables.append_channel(tables.append_channel(tables.remove_channel(t, "1"), more), wrong)
    back = tables.from_stack(tables.to_stack(grown))
    total = back.groupBy("image_id").agg((F.round(F.sum(F.aggregate("data", F.lit(0.0), lambda s, v: s + v)), 5) + 0.0).alias("total"))
    return tables.stack_shape(back).join(total, "image_id")


@query(f"WITH {NAMES} SELECT ord, base, regexp_replace(path, '/?[^/]*$', '') AS folder, regexp_replace(path, '\\.[^./]*$', '') || '.json' AS json FROM bs")
def s15_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return names(spark, sf_dir).select("ord", files.base_name(p).alias("base"), files.directory(p).alias("folder"), files.replace_extension(p, "json").alias("json"))


def own_folder(spark: SparkSession, tag: str) -> str:
    """A folder that no other run uses, in the shared one that the session names; only local mode may go without."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named.rstrip('/')}/loomgrain/{tag}-{uuid.uuid4().hex}" if named else "file://" + tempfile.mkdtemp(prefix=f"loomgrain-{tag}-")


@query("SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) + 0.0 AS first FROM embeddings GROUP BY 1")
def s16_database_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table saved and loaded, as Parquet and from there as CSV."""
    folder = own_folder(spark, "db")
    made = tiles(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(F.col("data")[0])).alias("first"))
    tables.save_database(made, folder, "images", "global")
    tables.save_database(tables.load_database(spark, folder, "images", "global"), folder, "images", "csv", "csv")
    back = tables.load_database(spark, folder, "images", "csv", "csv")
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in made.schema])


@query("SELECT doc_id, '{\"lang\":\"' || coalesce(lang, '?') || '\",\"at\":[{\"n\":' || coalesce(n_chars, 0) || '}]}' AS kept FROM documents")
def s18_drop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private keys and those left by contractions, dropped at every level of a struct."""
    d = table(spark, sf_dir, "documents")
    n = F.coalesce(F.col("n_chars"), F.lit(0))
    inner = F.array(F.struct(n.alias("n"), F.col("source").alias("_source"), n.alias("contraction")))
    g = d.select("doc_id", F.struct(F.coalesce("lang", F.lit("?")).alias("lang"), F.col("source").alias("__source__"), F.col("doc_id").alias("contraction_of"), inner.alias("at")).alias("g"))
    return tables.drop_keys(g, "g").select("doc_id", F.to_json("g").alias("kept"))


@query("SELECT doc_id, '{\"' || coalesce(source, '?') || '\":' || coalesce(n_chars, 0) || '}' AS kept FROM documents")
def s18_drop_map_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n, name = F.coalesce(F.col("n_chars"), F.lit(0)), F.coalesce(F.col("source"), F.lit("?"))
    m = d.select("doc_id", F.create_map(F.concat(F.lit("_"), name), n, name, n, F.concat(F.lit("contraction"), name), n).alias("m"))
    return tables.drop_map_keys(m, "m").select("doc_id", F.to_json("m").alias("kept"))


@query("SELECT conv_id, '{\"id\":' || conv_id || ',\"turns\":[' || string_agg('{\"turn\":' || turn || CASE WHEN turn % 2 = 0 THEN ',\"inner\":[{\"n\":' || coalesce(length(text), 0) || '}]}' ELSE ',\"inner\":{\"deep\":{\"role\":\"' || coalesce(role, '') || '\"}}}' END, ',' ORDER BY turn, role, text) || ']}' AS kept FROM conversations GROUP BY conv_id")
def s18_drop_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON whose shape changes from turn to turn, with unwanted keys at every level."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    inner = F.when(F.col("turn") % 2 == 0, F.to_json(F.array(F.struct(F.char_length("text").alias("n"), F.lit(1).alias("_n")))))
    inner = inner.otherwise(F.to_json(F.struct(F.lit(2).alias("contraction_of"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.array(F.lit(1)).alias("_list")).alias("deep"))))
    one = F.concat(F.lit('{"_id":7,"turn":'), F.col("turn").cast("string"), F.lit(',"inner":'), inner, F.lit(',"contraction":{"a":[1]}}'))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", one.alias("json")))), lambda t: t["json"])
    rows = c.groupBy("conv_id").agg(turns.alias("t"))
    whole = F.concat(F.lit('{"id":'), F.col("conv_id").cast("string"), F.lit(',"_all":[{"x":1}],"turns":['), F.array_join("t", ","), F.lit("]}"))
    return tables.drop_json_keys(rows.select("conv_id", whole.alias("kept")), "kept")


@query(f"WITH RECURSIVE {PX}, hi AS (SELECT image_id, y, x, v FROM px WHERE v > 0.1), {parts_sql('a', 'hi')} SELECT image_id // 4 AS image_id, image_id AS mask_id, y, x FROM a_lb WHERE (image_id, region_id) IN (SELECT (image_id, min(region_id)) FROM a_lb GROUP BY image_id)")
def s19_masks_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layers an image, saved and loaded as objects: of each layer the first part is kept."""
    path = own_folder(spark, "masks") + "/layers"
    layers = pixels(spark, sf_dir).filter("v > 0.1").select(F.floor(F.col("image_id") / 4).alias("image_id"), F.col("image_id").alias("mask_id"), "y", "x")
    tables.save_masks(layers, path)
    return tables.load_masks(spark, path, SIDE, first_only=True)


@query("SELECT vec_id AS image_id, vec_id % 2 = 1 AS do_network, vec_id % 2 = 1 OR vec_id % 3 <> 0 AS do_segment, vec_id % 2 = 1 OR vec_id % 3 <> 0 OR vec_id % 5 <> 0 AS do_metric FROM embeddings")
def s20_plan_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = tiles(spark, sf_dir).select("image_id")
    return files.plan_recompute(i, i.filter("image_id % 2 = 0"), i.filter("image_id % 3 = 0"), i.filter("image_id % 5 = 0"))


@query("SELECT vec_id AS image_id, g = 0 AS do_network, g < 2 AS do_segment, g < 2 OR k = 1 AS do_metric FROM (SELECT vec_id, coalesce(label, 0) % 3 AS g, coalesce(label, 0) % 2 AS k FROM embeddings)")
def s20_plan_from_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What written outputs lack: tables made for some labels' images, one of them in two goes, and read back."""
    label = F.coalesce("label", F.lit(0))
    i = tiles(spark, sf_dir).select("image_id", "label")
    out = Outputs(spark, own_folder(spark, "outputs") + "/tables", 4)
    for group in (1, 2):  # the second go leaves the first one's images as they are
        out.replace("networks", i.filter(label % 2 == 1), i.filter(label % 3 == group))
    out.replace("segments", i.limit(0), i.filter(label % 3 == 2))
    out.replace("metrics", i, i.filter(label % 2 == 0))
    images = i.select("image_id")
    return files.plan_recompute(images, *(out.done(name, like=images) for name in ("networks", "segments", "metrics")))


@query("SELECT vec_id AS image_id, CASE WHEN vec_id % 2 = 0 THEN label END AS label, CASE WHEN vec_id % 2 = 1 THEN round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 END AS first FROM embeddings")
def s21_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    return files.collate(t.filter("image_id % 2 = 0").select("image_id", "label"), t.filter("image_id % 2 = 1").select("image_id", r6(F.col("data")[0]).alias("first")))


@query(f"WITH {TYPED}, c AS (SELECT DISTINCT prefix FROM pf WHERE image_type = 'SHG'), i AS (SELECT DISTINCT prefix FROM pf WHERE image_type = 'PL-Trans') SELECT prefix FROM c UNION SELECT prefix FROM i")
def s22_add_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = files.typed_files(names(spark, sf_dir))
    return files.add_new_only(t.filter("image_type = 'SHG'").select("prefix").distinct(), t.filter("image_type = 'PL-Trans'").select("prefix").distinct())
