"""Functions of one's own as SQL names: parsers of file names, metrics of images and tables made of images.

Each is registered in a session under a name and used in SQL like a built-in function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeResult


def register_parser(spark: SparkSession, name: str, parse: Callable[[str], Iterator[tuple]], schema: str) -> None:
    """`SELECT … FROM files, LATERAL name(path)`: the rows that parse(path) gives. A null path gives none."""
    shape = T.StructType.fromDDL(schema)

    class Parser:
        @staticmethod
        def analyze(path) -> AnalyzeResult:
            if not isinstance(path.dataType, T.StringType):
                raise ValueError(f"{name}() takes a string")
            return AnalyzeResult(shape)

        def eval(self, path):
            if path is not None:
                yield from parse(path)

    spark.udtf.register(name, F.udtf(Parser))


def register_image_table(spark: SparkSession, name: str, make: Callable[[pd.DataFrame], Iterator[dict]], schema: str) -> None:
    """`SELECT … FROM name(TABLE(pixels) PARTITION BY image_id)`: the rows that make(an image's pixels) gives.

    The columns of the table are those of the frame, in any order of rows; schema says what make() gives. An image must
    fit a task. An empty table gives no rows.
    """
    shape = T.StructType.fromDDL(schema)

    class Images:
        def __init__(self):
            self.rows = []

        @staticmethod
        def analyze(table) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError(f"{name}() takes a table")
            return AnalyzeResult(shape)

        def eval(self, row):
            self.rows.append(row.asDict())

        def terminate(self):
            if self.rows:
                for made in make(pd.DataFrame(self.rows)):
                    yield tuple(made[f.name] for f in shape.fields)

    spark.udtf.register(name, F.udtf(Images))


def register_metric(spark: SparkSession, name: str, metric: Callable[[pd.Series], float]) -> None:
    """`SELECT image_id, name(v) FROM pixels GROUP BY image_id`: metric(values) as an aggregate, double.

    Null values reach the metric as NaN; a group must fit a task.
    """

    @F.pandas_udf("double")
    def aggregate(v: pd.Series) -> float:
        return metric(v)

    spark.udf.register(name, aggregate)
