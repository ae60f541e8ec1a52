"""Image files as tables: names, types, file sets, acquisition metadata and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Image types in order of precedence, and the file-name parts that say them.
TYPE_MARKS = (("SHG-PL-Trans", "-pl-shg"), ("PL-Trans", "-pl"), ("SHG", "-shg"))
#: Name parts of files that are no measurement.
SKIPPED = ("display", "virada")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; empty if there is none."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def list_inputs(spark: SparkSession, path: str, key: str = "") -> DataFrame:
    """(path, length, modified) of a file, or of a folder's direct children, whose path holds key. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return keep_key(files.select("path", "length", F.col("modificationTime").alias("modified")), key)


def keep_key(files: DataFrame, key: str, path_col: str = "path") -> DataFrame:
    """Rows whose path holds key; an empty key keeps all, a null path goes."""
    return files.filter(F.contains(F.col(path_col), F.lit(key)))


def image_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """TIFF measurements only: .tif files whose base name holds none of SKIPPED."""
    name = base_name(F.col(path_col))
    keep = F.endswith(F.col(path_col), F.lit(".tif"))
    for part in SKIPPED:
        keep = keep & ~F.contains(name, F.lit(part))
    return files.filter(keep)


def image_type(path: Column) -> Column:
    """The image type that a base name says, whatever its case; Unknown if none."""
    low = F.lower(base_name(path))
    out = F.lit("Unknown")
    for kind, mark in reversed(TYPE_MARKS):
        out = F.when(F.contains(low, F.lit(mark)), F.lit(kind)).otherwise(out)
    return out


def prefix(path: Column, label: Column) -> Column:
    """Directory and base name up to the first place of label (whatever its case); the whole path if it isn't there."""
    name = base_name(path)
    at = F.call_function("locate", F.lower(label), F.lower(name))
    head = F.length(path) - F.length(name)
    return F.when(at > 0, F.substring(path, F.lit(1), head + at - 1)).otherwise(path)


def typed_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """files plus image_type and prefix; the label is the mark that gave the type."""
    kind = image_type(F.col(path_col))
    mark = F.lit("")
    for k, m in TYPE_MARKS:
        mark = F.when(F.col("image_type") == k, F.lit(m)).otherwise(mark)
    out = files.withColumn("image_type", kind)
    return out.withColumn("prefix", F.when(F.col("image_type") == "Unknown", F.lit(None)).otherwise(prefix(F.col(path_col), mark)))


def file_sets(files: DataFrame, path_col: str = "path", order_col: str = "ord") -> DataFrame:
    """(prefix, shg_pl_trans, pl_trans, shg): one row a prefix with the last path of each type; unknown types are dropped."""
    typed = typed_files(files, path_col).filter("image_type != 'Unknown'")
    picks = [F.max_by(F.when(F.col("image_type") == k, F.col(path_col)), F.when(F.col("image_type") == k, F.col(order_col))).alias(k.lower().replace("-", "_")) for k, _ in TYPE_MARKS]
    return typed.groupBy("prefix").agg(*picks)


def select_files(sets: DataFrame) -> DataFrame:
    """(prefix, mode, files): the combined file if there is one, else SHG with PL; other sets are rejected."""
    combined = F.col("shg_pl_trans").isNotNull()
    both = F.col("shg").isNotNull() & F.col("pl_trans").isNotNull()
    out = sets.withColumn("mode", F.when(combined, F.lit("combined")).when(both, F.lit("separate")))
    out = out.withColumn("files", F.when(combined, F.array("shg_pl_trans")).when(both, F.array("shg", "pl_trans")))
    return out.filter("mode is not null").select("prefix", "mode", "files")


def accumulation_number(path: Column) -> Column:
    """The number after acc at the end of the name without extension; 1 if there is none."""
    stem = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"acc(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))


def strip_suffix(name: Column, suffix: str = "", extension: str = "") -> Column:
    """name without one trailing suffix, and before it one extension."""
    out = name
    for part in (extension, suffix):
        if part:
            out = F.when(F.endswith(out, F.lit(part)), F.substring(out, F.lit(1), F.length(out) - len(part))).otherwise(out)
    return out


def replace_extension(path: Column, extension: str) -> Column:
    """path with another extension after its last dot (or one added)."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.concat(stem, F.lit("." + extension.lstrip(".")))


# ---------------------------------------------------------------- acquisition metadata


META_SCHEMA = "minor_axis int, n_modes int, xy_dim array<int>"


def described_meta(meta: DataFrame, col: str = "description") -> DataFrame:
    """meta plus minor_axis, n_modes, xy_dim from a JSON description; rows without modes or dimensions are dropped."""
    parsed = F.from_json(F.col(col), META_SCHEMA)
    out = meta.withColumn("__m", parsed)
    return out.filter("__m.n_modes is not null and __m.xy_dim is not null").select(*meta.columns, "__m.minor_axis", "__m.n_modes", "__m.xy_dim")


def _axes_of(shape: Column, wanted) -> Column:
    return F.filter(F.transform(shape, lambda n, i: F.when(wanted(n), i).otherwise(F.lit(-1))), lambda i: i >= 0)


def laser_meta(meta: DataFrame) -> DataFrame:
    """(…, minor_axis, n_modes) from descriptions that name one Gamma a mode; description, xy_dim, shape are read.

    The mode axis is the first whose length is the number of modes; the minor axis is the single axis that is neither
    mode nor image; null if there is none. Shapes without a mode axis give null modes.
    """
    lines = F.split(F.col("description"), "\n")
    modes = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("Gamma"))))
    out = meta.withColumn("__n", modes)
    out = out.withColumn("__mode", F.get(_axes_of(F.col("shape"), lambda n: n == F.col("__n")), 0))
    rest = F.filter(
        F.transform(F.col("shape"), lambda n, i: F.when((i != F.col("__mode")) & ~F.array_contains(F.col("xy_dim"), n), i).otherwise(F.lit(-1))),
        lambda i: i >= 0,
    )
    out = out.withColumn("minor_axis", F.get(rest, 0).cast("int"))
    out = out.withColumn("n_modes", F.when(F.col("__mode").isNotNull(), F.col("__n")))
    return out.drop("__n", "__mode")


def stack_meta(meta: DataFrame) -> DataFrame:
    """(…, minor_axis, n_modes) from descriptions that say slices=N: the axis of that length, and the length left over (or 1)."""
    slices = F.nullif(F.regexp_extract("description", r"slices=(\d+)", 1), F.lit("")).cast("int")
    out = meta.withColumn("__s", slices)
    out = out.withColumn("minor_axis", F.get(_axes_of(F.col("shape"), lambda n: n == F.col("__s")), 0).cast("int"))
    rest = F.filter(
        F.transform(F.col("shape"), lambda n, i: F.when(~i.eqNullSafe(F.col("minor_axis")) & ~F.array_contains(F.col("xy_dim"), n), n).otherwise(F.lit(-1))),
        lambda n: n >= 0,
    )
    return out.withColumn("n_modes", F.coalesce(F.get(rest, 0), F.lit(1)).cast("int")).drop("__s")


# ---------------------------------------------------------------- work lists and collections


def plan_recompute(images: DataFrame, networks: DataFrame, segments: DataFrame, metrics: DataFrame, force_network: bool = False, force_segment: bool = False, force_metric: bool = False) -> DataFrame:
    """images plus do_network, do_segment, do_metric: what is missing or forced, and all that follows from it."""
    out = images
    for name, done in (("network", networks), ("segment", segments), ("metric", metrics)):
        seen = done.select(F.col("image_id").alias(f"__{name}")).distinct()
        out = out.join(seen, F.col("image_id") == F.col(f"__{name}"), "left")
    network = F.lit(force_network) | F.col("__network").isNull()
    segment = network | F.lit(force_segment) | F.col("__segment").isNull()
    metric = segment | F.lit(force_metric) | F.col("__metric").isNull()
    return out.select(*images.columns, network.alias("do_network"), segment.alias("do_segment"), metric.alias("do_metric"))


def collate(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; a column that a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def add_new_only(current: DataFrame, incoming: DataFrame, key: str = "prefix") -> DataFrame:
    """current and those rows of incoming whose key isn't in it."""
    return current.unionByName(incoming.join(current.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
