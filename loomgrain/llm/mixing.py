"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target share; a document is taken floor(r) times for its source's ratio r = target / size, and once
more with probability r - floor(r). Those last choices are made by the cube method: inclusion probabilities move along
the null space of the balancing constraints (documents and words), three documents at a time, until each is 0 or 1.
Blocks of a source do so side by side; the few undecided ones of each block meet in fewer, larger-scale blocks, until
one block a source is left, whose last two are the landing problem.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.common import hot_keys, spread_join, word_count, written

#: The weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Units of each source that wait for the landing, so that small differences can be made up exactly.
LANDING = 14


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: float = 3.0) -> DataFrame:
    """(source, docs, source_size, target double): one row for each source, null being one too (last in order).

    units: (source, size, rows). docs counts units.

    Sources in order of code points weigh `weights` in turn and share the total size. No target is above ceiling times
    its source's size: with sources sorted by the level at which each hits its ceiling, the share per weight is the
    largest that the rest can take, found by running sums in one pass over the sources (one task: sources, not documents).
    """
    per = units.groupBy("source").agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.col("size") * F.col("rows")), F.lit(0)).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    level = per.withColumn("full_at", ceiling * F.col("source_size") / F.col("weight"))
    run = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = level.withColumns(
        {
            "below": F.coalesce(F.sum(ceiling * F.col("source_size")).over(run), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(run), F.lit(0.0)),
            "total": F.sum("source_size").over(everything),
        }
    )
    # the share per weight if all sources before this one are full, and the first source that isn't
    level = level.withColumn("share", (F.col("total") - F.col("below")) / F.col("open"))
    fits = F.min(F.when(F.col("share") <= F.col("full_at"), F.struct("full_at", "share"))).over(everything)
    share = F.coalesce(fits["share"], F.lit(float("inf")))
    level = level.withColumn("target", F.least(share * F.col("weight"), ceiling * F.col("source_size")).cast("double"))
    return level.select("source", "docs", "source_size", "target")


# ---------------------------------------------------------------- the cube


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities p along the null space of (count, size) until at most two are strictly between 0 and 1.

    Sums of p and of p * x stay as they are. Three open units move at a time; two do where their sizes agree.
    """
    eps = 1e-9
    p = np.where(p <= eps, 0.0, np.where(p >= 1 - eps, 1.0, p))
    open_ = [int(i) for i in np.flatnonzero((p > eps) & (p < 1 - eps))]
    draw = iter(rng.random(2 * len(open_) + 4).tolist())
    q, size = p.tolist(), x.tolist()
    held: list[int] = []
    at = 0
    while True:
        while len(held) < 3 and at < len(open_):
            held.append(open_[at])
            at += 1
        if len(held) < 2:
            break
        a, b = held[0], held[1]
        if size[a] == size[b]:
            move = ((a, 1.0), (b, -1.0))
        elif len(held) < 3:
            break
        else:
            c = held[2]
            move = ((a, size[c] - size[b]), (b, size[a] - size[c]), (c, size[b] - size[a]))
        up = down = float("inf")
        for i, u in move:
            if u > 0:
                up, down = min(up, (1 - q[i]) / u), min(down, q[i] / u)
            elif u < 0:
                up, down = min(up, -q[i] / u), min(down, (q[i] - 1) / u)
        step = up if next(draw) * (up + down) < down else -down
        for i, u in move:
            q[i] += step * u
        still = []
        for i in held:
            if q[i] <= eps:
                q[i] = 0.0
            elif q[i] >= 1 - eps:
                q[i] = 1.0
            else:
                still.append(i)
        held = still
    return np.array(q)


def landing(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle the open units, of which there are at most LANDING + 2, so that their words come nearest to what they owe.

    All their samples are enumerated; among equally near ones, the one whose count is nearest, then any.
    """
    p = p.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    if not len(at):
        return p
    words, units = np.zeros(1), np.zeros(1)
    for i in at:
        words, units = np.concatenate([words, words + x[i]]), np.concatenate([units, units + 1])
    far = np.abs(words - (p[at] * x[at]).sum())
    order = np.lexsort((rng.random(len(far)), np.abs(units - p[at].sum()), np.round(far, 6)))
    p[at] = (order[0] >> np.arange(len(at))) & 1
    return p


def spared(p: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The open units that a flight leaves for the landing: n of them, spread over all sizes but the largest tenth."""
    at = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9) & (x > 0))
    at = at[np.argsort(x[at], kind="stable")]
    return at[np.unique(np.linspace(0, max(0, int(0.9 * len(at)) - 1), min(n, len(at))).astype(int))] if len(at) else at


def take_counts(sized: DataFrame, seed: int = 1, block: int = 1000, weights: tuple[int, ...] = WEIGHTS, ceiling: float = 3.0) -> DataFrame:
    """(key, source, size, source_size long, target double, rows long, copies long) for each distinct (key, source, size).

    rows is how many rows of sized are equal in these, copies how often the mix takes them altogether: at most
    ceiling * rows. Copies of a source sum up, by size, to within about a document of its target. Equal seeds give equal
    results, however rows are dealt: blocks are formed by hash and sorted by key and size. A null key is a key, a null
    source a source; size 0 or null counts 0 (0 copies where the whole source is empty). Empty tables give empty tables.
    Hot sources are split into blocks of about `block` units, and equal rows are one unit, so no task holds a source.
    """
    units = sized.groupBy("key", "source", "size").agg(F.count("*").alias("rows"))
    units = written(units, "mix-units")
    targets = source_targets(units, weights, ceiling)
    # one row per source, joined by whatever way its measured size allows
    joined = units.withColumnRenamed("source", "__s").join(targets.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left").drop("__t")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("rows")
    # a ratio within rounding of a whole number is that number
    ratio = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    unit = joined.withColumn("__q", F.floor(ratio).cast("double")).withColumn("__p", ratio - F.floor(ratio))
    level = 0
    unit = unit.withColumn("__n", F.greatest(F.lit(1), F.ceil(F.col("docs") / block)).cast("long"))
    unit = unit.withColumn("__b", F.pmod(F.xxhash64("key", "size", F.lit(seed)), "__n"))
    unit = written(_fly(unit, seed, last=False), "mix-0")
    settled = unit.filter("__p in (0, 1)")
    undecided = unit.filter("__p not in (0, 1)")
    while not undecided.isEmpty():  # each level leaves at most 2 units of each block: log(documents) levels
        level += 1
        last = undecided.filter(F.col("__n") * 2 > block).isEmpty()
        n = F.lit(1).cast("long") if last else F.ceil(F.col("__n") * 2 / block).cast("long")
        undecided = undecided.withColumn("__n", n).withColumn("__b", F.pmod(F.xxhash64("key", "size", F.lit(seed + level)), "__n"))
        unit = written(_fly(undecided, seed + level, last=last), f"mix-{level}")
        settled = settled.unionByName(unit.filter("__p in (0, 1)"))
        undecided = unit.filter("__p not in (0, 1)")
    copies = (F.col("__q") + F.col("__p")).cast("long")
    return settled.select("key", F.col("__s").alias("source"), "size", "source_size", "target", "rows", copies.alias("copies"))


def _fly(units: DataFrame, seed: int, last: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "size"], kind="stable", na_position="last").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(pdf["__b"].iloc[0]), len(pdf)])
        p = pdf["__p"].to_numpy("f8")
        x = pdf["size"].fillna(0).to_numpy("f8")
        waits = np.zeros(len(p), bool)
        if pdf["__b"].iloc[0] == 0:  # one block of each source, at every level, keeps units for the landing
            waits[spared(p, x, LANDING)] = True
        mixed = np.flatnonzero(~waits)[np.argsort(rng.random((~waits).sum()), kind="stable")]
        p[mixed] = flight(p[mixed], x[mixed], rng)
        pdf["__p"] = landing(p, x, rng) if last else p
        return pdf

    return units.groupBy("__s", "__b").applyInPandas(run, units.schema)


def each_row(n: Column) -> Column:
    """0 to n - 1 for explode(), in arrays of at most 10,000."""
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 10_000)), lambda k: F.sequence(k * 10_000, F.least(k * 10_000 + 9_999, n - 1)))
    return F.when(n > 0, whole).otherwise(F.array().cast("array<array<bigint>>"))


def mixed_sizes(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size long, source_size long, target double, copies long, taken long) for every row of docs.

    size is the number of words of the whole text (null: 0); taken = copies * size. Only ids, sources and sizes are
    shuffled. Rows equal in these share their copies as evenly as can be. Null ids stay null, a null source is a source,
    other columns are ignored, an empty table gives an empty table.
    """
    sized = docs.select(F.col(id_col).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    out = take_counts(sized, seed)
    out = out.withColumn("__k", F.explode(each_row(F.col("rows")))).withColumn("__k", F.explode("__k"))
    own = (F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("__k") < F.col("copies") % F.col("rows"), 1).otherwise(0)).cast("long")
    return out.select(F.col("key").alias(id_col), "source", "size", "source_size", "target", own.alias("copies"), (own * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 1, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with the columns of docs, whatever their names.

    No text is cut: a row is left out, or there once or several times. Rows are known by the hash of all they hold; equal
    ones share what the mix takes of them. Null ids and sources are like others, documents without words (null texts too)
    have nothing to be taken for and come by the ratio of their source; an empty table gives an empty table.
    """
    rows = docs.select(F.struct("*").alias("d"), F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias("h"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    counts = written(take_counts(rows.select(F.col("h").alias("key"), "source", "size"), seed).groupBy(F.col("key").alias("g")).agg(F.sum("copies").alias("m"), F.sum("rows").alias("c")), "mix-counts")
    hot = hot_keys(counts, "g", rows.count())
    taken = spread_join(rows.select("d", "h"), counts.filter("m > 0"), ("h", "g"), hot)
    again = F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("copy")
    out = taken.filter("c = 1").select("d", again).select("d")
    if not counts.filter("c > 1 and m > 0").isEmpty():  # equal rows: one of them, as often as all are taken
        equal = taken.filter("c > 1").groupBy("h").agg(F.first("d").alias("d"), F.first("m").alias("m"))
        several = equal.withColumn("k", F.explode(each_row(F.col("m"))))
        out = out.unionByName(several.select("d", F.explode("k").alias("copy")).select("d"))
    return out.select("d.*")
