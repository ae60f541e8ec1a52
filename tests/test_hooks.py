"""Own functions in SQL, free JSON, mini-batch clusters and sketched percentiles."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgrain.functions import hooks
from loomgrain.functions import pixels as px
from loomgrain.operators import clusters
from loomgrain.sources import tables


def test_parsers_and_metrics_in_sql(spark):
    def parse(path):
        for k, part in enumerate(path.split("-")):
            yield part, k

    hooks.register_parser(spark, "own_parts", parse, "part string, place int")
    spark.createDataFrame([("a-b",), (None,), ("c",)], "path string").createOrReplaceTempView("files")
    got = spark.sql("SELECT path, part, place FROM files, LATERAL own_parts(path)").collect()
    assert sorted(map(tuple, got)) == [("a-b", "a", 0), ("a-b", "b", 1), ("c", "c", 0)]
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM own_parts(3)").collect()

    rows = [("x", y, float(y * y)) for y in range(5)] + [("z", 0, None)]
    p = spark.createDataFrame(rows, "image_id string, y int, v double")
    p.createOrReplaceTempView("own_px")

    def make(pdf):
        yield {"image_id": pdf["image_id"].iloc[0], "n": len(pdf), "top": float(pd.Series(pdf["v"], dtype=float).max())}

    schema = "image_id string, n int, top double"
    hooks.register_image_table(spark, "own_table", make, schema)
    one = spark.sql("SELECT * FROM own_table(TABLE(own_px) PARTITION BY image_id)").filter("image_id = 'x'").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in clusters.map_images(p.filter("image_id = 'x'"), schema, make).collect()] == [("x", 5, 16.0)]
    assert spark.sql("SELECT * FROM own_table(TABLE(SELECT * FROM own_px WHERE false) PARTITION BY image_id)").count() == 0
    hooks.register_metric(spark, "own_mean", lambda v: float(v.mean()))
    assert {r.image_id: r.m for r in spark.sql("SELECT image_id, own_mean(v) AS m FROM own_px WHERE v IS NOT NULL GROUP BY image_id").collect()} == {"x": 6.0}


def test_keys_of_free_json(spark):
    def drop(v):
        if isinstance(v, dict):
            return {k: drop(x) for k, x in v.items() if not k.startswith(("_", "contraction"))}
        return [drop(x) for x in v] if isinstance(v, list) else v

    texts = ['{"a":{"_b":1,"c":[{"contraction":2,"d":[[{"_e":1}]]},3,null]},"_f":{}}', "[1,{\"_x\":2}]", "5", '"_s"', "null", "{}", '{"é":"日"}', '{"deep":' * 50 + "1" + "}" * 50]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, "no json"), (102, "")]
    got = {r.id: r.t for r in tables.drop_json_keys(spark.createDataFrame(rows, "id int, t string"), "t").collect()}
    assert all(json.loads(got[i]) == drop(json.loads(t)) for i, t in enumerate(texts))
    assert got[100] is None and got[101] is None and got[102] is None and got[6] == '{"é":"日"}'


def colours(spark, n=6000):
    rng = np.random.default_rng(4)
    means = rng.random((5, 3)) * 10
    v = means[rng.integers(0, 5, n)] + rng.standard_normal((n, 3)) * 0.2
    rows = [(int(i % 7), int(i // 7), 0, *map(float, v[i])) for i in range(n)]
    return spark.createDataFrame(rows + [(9, 0, 0, None, 1.0, 1.0)], "image_id int, y int, x int, red double, green double, blue double"), v


def test_mini_batches_come_near_full_clustering(spark):
    df, v = colours(spark)
    out, centres = clusters.corpus_clusters(df, 5, seed=3, share=0.1, rounds=30)
    again, same = clusters.corpus_clusters(df.repartition(7), 5, seed=3, share=0.1, rounds=30)
    assert centres == same  # whatever the dealing
    assert out.exceptAll(again).isEmpty() and out.filter("cluster is null").count() == 1
    inertia = lambda c: np.min([((v - x) ** 2).sum(1) for x in c], axis=0).sum()
    full = np.array(centres)
    for _ in range(50):
        near = np.argmin([((v - x) ** 2).sum(1) for x in full], axis=0)
        full = np.array([v[near == i].mean(0) if (near == i).any() else full[i] for i in range(5)])
    assert inertia(centres) <= 1.01 * inertia(full)
    assert clusters.corpus_clusters(df.filter("false"), 5)[1] == []
    twice = spark.createDataFrame([(1, y, 0, 1.0, 2.0, 3.0) for y in range(9)], df.schema)
    assert clusters.corpus_clusters(twice, 5)[1] == [[1.0, 2.0, 3.0]]


def test_sketched_percentiles(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal(60_000) ** 3
    rows = [("a", "0", i // 300, i % 300, float(x)) for i, x in enumerate(v)] + [("b", "0", 0, 0, None), ("c", "0", 0, 0, 2.0), ("c", "0", 0, 1, None)]
    p = spark.createDataFrame(rows, "image_id string, channel string, y int, x int, v double").repartition(9)
    out = px.clip_intensities_sketched(p, 2, 98)
    a = out.filter("image_id = 'a'").agg(F.min("v"), F.max("v"), F.count("v")).first()
    ranks = [(v <= x).mean() for x in a[:2]]
    assert a[2] == len(v) and abs(ranks[0] - 0.02) < 0.0025 and abs(ranks[1] - 0.98) < 0.0025
    assert sorted(((r.image_id, r.v) for r in out.filter("image_id != 'a'").collect()), key=str) == [("b", None), ("c", 2.0), ("c", None)]
