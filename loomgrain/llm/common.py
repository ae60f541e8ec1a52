"""What the corpus operators share: the shared folder, written tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of characters that are not ASCII white space; the corpus notion of a word.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in local mode (tests) may the session name none; a temporary folder is made then. On a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="loomgrain-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/loomgrain/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that nothing upstream runs again.

    The table outlives the loss of any executor; forget() deletes it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(counts: DataFrame, key: str, total: int, share: int = 1000) -> list:
    """The keys whose count `c` is above total / share. There are fewer than `share` of them, whatever the table."""
    return [r[0] for r in counts.filter(F.col(key).isNotNull() & (F.col("c") * share > total)).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, on: tuple[str, str], hot: list, how: str = "inner", salts: int = 64) -> DataFrame:
    """left joined with right where left's column on[0] equals right's on[1].

    Rows of left with a hot key are dealt over `salts` tasks by the hash of the row, and right's rows of that key are
    repeated for each; so no task gets all rows of a frequent key, and keys that aren't frequent cost nothing more. Rows
    of left without a key are dealt likewise where they stay in the result.
    """
    a, b = on
    if not hot and how in ("inner", "left_semi"):
        return left.join(right, F.col(a) == F.col(b), how)
    many = F.col(a).isNull() | F.col(a).isin(hot) if hot else F.col(a).isNull()
    left = left.withColumn("__salt", F.when(many, F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    each = F.when(F.col(b).isin(hot) if hot else F.lit(False), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("__salt_", F.explode(each))
    return left.join(right, (F.col(a) == F.col(b)) & (F.col("__salt") == F.col("__salt_")), how).drop("__salt", "__salt_")


#: Bits of a key filter: 8 MB, however many keys.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, key: str):
    """A column function: longs -> whether a long may be among keys' column `key` (never wrong about one that is).

    A Bloom filter of FILTER_BITS bits with two probes, made by a grouped bit_or; at most FILTER_BITS / 64 words come back.
    It spares a later join rows that can't match: most of them up to some ten million keys, fewer and fewer beyond; what
    the join gives is the same.
    """
    spots = keys.select(F.explode(F.array(F.col(key), F.shiftright(key, 32))).alias("h")).select(F.pmod("h", F.lit(FILTER_BITS)).alias("bit"))
    words = spots.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).toPandas()
    filled = np.zeros(FILTER_BITS >> 6, np.int64)
    filled[words["at"].to_numpy("i8")] = words["bits"].to_numpy("i8")
    shared = keys.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        table = shared.value
        h = h.to_numpy("i8")
        out = np.ones(len(h), bool)
        for spot in (h & (FILTER_BITS - 1), (h >> 32) & (FILTER_BITS - 1)):
            out &= (table[spot >> 6] >> (spot & 63)) & 1 == 1
        return pd.Series(out)

    return may_be


def word_count(text: Column) -> Column:
    """Number of WORD matches as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
