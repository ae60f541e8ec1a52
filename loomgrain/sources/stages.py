"""Tables that several later steps read: written once as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only local mode may go without, in a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="loomgrain-stages-"))
    return _own_folder[0]


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written and read back, so that nothing upstream runs again, whoever reads it and whatever executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/loomgrain/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df as one side of a join, so that both sides are dealt by key.

    Spark takes a kept table's size, and that of what is made of it, from its compressed files: small numbers shrink there
    to some hundredths of their rows. A join that goes by this gathers rows on the driver and sends all to every task.
    """
    return df.hint("merge")


def forget(df: DataFrame) -> None:
    """Delete a kept table that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def few_at_once(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 64) -> DataFrame:
    """df.mapInPandas(run, schema) with frames of at most `rows` rows, whatever the session's batches are.

    For rows that hold lists of structs: as Python objects they take some ten times what they take in a batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows).to_pandas()

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(small(batches)):
            yield pa.RecordBatch.from_pandas(made, arrow, preserve_index=False)

    return df.mapInArrow(through, schema)
