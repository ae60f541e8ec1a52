"""Averages that skip gaps, angular spread, and path and graph statistics, all as grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def nanmean(x: Column, w: Column | None = None) -> Column:
    """Aggregate: weighted mean over rows where neither value nor weight is null or NaN; null without weight."""
    x = x.cast("double")
    w = F.lit(1.0) if w is None else w.cast("double")
    valid = _number(x) & _number(w)
    return F.sum(F.when(valid, x * w)) / F.nullif(F.sum(F.when(valid, w)), F.lit(0.0))


def metric_averages(table: DataFrame, metrics: list[str], weight: str | None = None, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """One row a key with nanmean() of each listed metric that the table has."""
    w = None if weight is None else F.col(weight)
    return table.groupBy(*keys).agg(*[nanmean(F.col(m), w).alias(m) for m in metrics if m in table.columns])


def angle_sdi(values: DataFrame, keys: tuple[str, ...], v: str = "v", w: str | None = None, bins: int = 200, name: str = "sdi") -> DataFrame:
    """(keys, sdi): mean over maximum of each group's density histogram between its own extremes.

    That is sum(w) / (bins * heaviest bin). A group of one value is one bin wide: 1 / bins. No weight at all gives null.
    """
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    rows = values.filter(_number(F.col(v).cast("double"))).select(*keys, F.col(v).cast("double").alias("__v"), weight.alias("__w"))
    span = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    joined = rows.join(span, list(keys))
    place = F.floor((F.col("__v") - F.col("__lo")) * bins / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    joined = joined.withColumn("__bin", F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)))
    per_bin = joined.groupBy(*keys, "__bin").agg(F.sum("__w").alias("__s"))
    return per_bin.groupBy(*keys).agg((F.sum("__s") / F.nullif(bins * F.max("__s"), F.lit(0.0))).alias(name))


def histogram_edges(values: DataFrame, keys: tuple[str, ...], v: str = "v", bins: int = 200) -> DataFrame:
    """(keys, edges array<double>): the bins + 1 edges that angle_sdi() uses."""
    span = values.groupBy(*keys).agg(F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi"))
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    return span.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: lo + (hi - lo) * i / bins).alias("edges"))


def fibre_properties(nodes: DataFrame, keys: tuple[str, ...] = ("image_id", "network_id", "fibre_id")) -> DataFrame:
    """(keys, n_nodes, length, displacement, dir_y, dir_x, waviness, angle) of ordered paths (keys, seq, y, x).

    The direction points from last to first; waviness is displacement over length (null for length 0), the angle is that
    between direction and the x axis in degrees (null where there is no displacement).
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    gone = F.hypot((F.col("y") - F.lag("y").over(w)).cast("double"), (F.col("x") - F.lag("x").over(w)).cast("double"))
    per = (
        nodes.withColumn("__d", gone)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_nodes"),
            F.coalesce(F.sum("__d"), F.lit(0.0)).alias("length"),
            F.min_by(F.struct("y", "x"), "seq").alias("__a"),
            F.max_by(F.struct("y", "x"), "seq").alias("__b"),
        )
    )
    dy = (F.col("__b.y") - F.col("__a.y")).cast("double")
    dx = (F.col("__b.x") - F.col("__a.x")).cast("double")
    per = per.withColumns({"displacement": F.hypot(dy, dx)})
    far = F.nullif(F.col("displacement"), F.lit(0.0))
    per = per.withColumns({"dir_y": 0.0 - dy / far, "dir_x": 0.0 - dx / far})
    angle = F.acos(F.greatest(F.least(F.col("dir_x"), F.lit(1.0)), F.lit(-1.0))) * (180 / math.pi)
    angle = F.when(F.col("dir_x").isNotNull(), angle)
    return per.withColumns({"waviness": F.col("displacement") / F.nullif(F.col("length"), F.lit(0.0)), "angle": angle}).drop("__a", "__b")


def entropy_of(values: DataFrame, keys: tuple[str, ...], v: str = "v") -> DataFrame:
    """(keys, entropy): Shannon entropy in bits over distinct exact values of each group."""
    n = values.groupBy(*keys, v).agg(F.count("*").alias("__n"))
    return n.groupBy(*keys).agg((F.log2(F.sum("__n")) - F.sum(F.col("__n") * F.log2("__n")) / F.sum("__n")).alias("entropy"))
