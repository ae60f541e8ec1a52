"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of m half-keys each (a half-key joins `rows` minimum hashes) are made per set; the m * m table keys
are all pairs of one half-key of either collection, so 2 * m * rows minimum hashes serve m * m tables. Documents with a key
in common are candidates and are confirmed on their full shingle sets.

Buckets are never paired out. Each bucket's members are held against the one of them that meets most others; what that
links becomes components. Where a bucket's members are of several components, candidates between those come from an
exact prefix filter (prefix, size and place) over the members of all such buckets. Links between members of one
component would change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.common import forget, free_name, hot_keys, key_filter, spread_join, written

U = np.uint64
SHINGLE = 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPOT = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (_BASE % 2**64, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted distinct 64-bit shingle hashes of each text, one text after another.

    A-Z are lowered, words stand between ASCII white space; a text of 1 to k - 1 words has its whole sequence as one.
    """
    with np.errstate(over="ignore"):
        data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        up, down = _power(len(data) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * up[: len(data)])])
        gap = _SPACE[data]
        edge = np.flatnonzero(np.diff(gap.view(np.int8)))
        starts = np.concatenate([np.zeros(0 if gap[0] else 1, np.int64), edge[gap[edge]] + 1])
        stops = edge[~gap[edge]] + 1
        word = mix((total[stops] - total[starts]) * down[starts])
        at = np.searchsorted(starts, np.concatenate([np.zeros(1, np.int64), bounds]))  # words before each text
        n_windows = max(0, len(word) - k + 1)
        windows = np.zeros(n_windows, U)
        for j in range(k):
            windows += word[j : j + n_windows] * _SPOT[j]
        windows = mix(windows)
        out, ends, n = [], [], 0
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(windows[a : b - k + 1])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                s = mix((word[a:b] * _SPOT[: b - a]).sum(keepdims=True, dtype=U) + U(b - a))
            else:
                s = np.zeros(0, U)
            out.append(s)
            n += len(s)
            ends.append(n)
        return (np.concatenate(out) if out else np.zeros(0, U)), np.array(ends, np.int64)


def half_keys(hashes: np.ndarray, ends: np.ndarray, halves: int, rows: int, seed: int = 7) -> np.ndarray:
    """For each non-empty set, `halves` numbers, each of `rows` minimum hashes of its own (rows of a matrix)."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, (halves, rows), dtype=np.uint64) * U(2) + U(1)
    shift = rng.integers(0, 1 << 63, (halves, rows), dtype=np.uint64)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    starts = starts[ends > starts]
    out = np.zeros((len(starts), halves), U)
    with np.errstate(over="ignore"):
        for h in range(halves):
            key = np.full(len(starts), h + 1, U)
            for r in range(rows):
                low = np.minimum.reduceat(hashes * factor[h, r] + shift[h, r], starts)
                key = mix(key * U(0x9E3779B97F4A7C15) + low)
            out[:, h] = key
    return out


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of consecutive rows with about `most` bytes; null is empty."""
    at, size, held = 0, 0, []
    for i, t in enumerate(batch.column(batch.num_columns - 1)):
        held.append(t.as_py().encode() if t.is_valid else b"")
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


def signatures(docs: DataFrame, m: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th long, n long, s long, keys array<long>): text hash, set size, set hash and the 2 * m half-keys."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _slices(b):
                hashes, ends = shingle_sets(texts)
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                n = ends - starts
                keys = np.zeros((len(n), 2 * m), U)
                keys[n > 0] = half_keys(hashes, ends, 2 * m, rows)
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes ^ U(0x5851F42D4C957F2D)))])
                    s = mix(total[ends] - total[starts] + n.astype(U))
                part = b.slice(at, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 2 * m), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(s.view(np.int64)), lists], names=["id", "th", "n", "s", "keys"])

    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {id_type}, th long, n long, s long, keys array<long>")


def similar_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of (x, y) those whose full shingle sets have 100 * intersection >= percent * union; texts: (s, text), s unique.

    A written table. An x or y of very many pairs is dealt over many tasks.
    """
    tx = texts.select(F.col("s").alias("sx"), F.col("text").alias("tx"))
    ty = texts.select(F.col("s").alias("sy"), F.col("text").alias("ty"))
    pairs = written(pairs.select("x", "y"), "pairs")
    n = pairs.count()
    hot_x, hot_y = (hot_keys(pairs.groupBy(c).agg(F.count("*").alias("c")), c, n) for c in "xy")
    # the one with the text of y comes second: its rows arrive in order of x
    both = spread_join(spread_join(pairs, ty, ("y", "sy"), hot_y).drop("sy"), tx, ("x", "sx"), hot_x).select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # the sets of the last few x: their pairs mostly come one after another
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                xs, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
                new = {}
                for x, t in zip(xs, b.column(2), strict=True):
                    if x not in known and x not in new:
                        new[x] = t.as_py().encode()
                if new:
                    hashes, ends = shingle_sets(list(new.values()))
                    known = {x: known[x] for x in {*xs} if x in known} | dict(zip(new, np.split(hashes, ends[:-1]), strict=True))
                hashes, ends = shingle_sets([t.as_py().encode() for t in b.column(3)])
                keep = []
                for x, ty_ in zip(xs, np.split(hashes, ends[:-1]), strict=True):
                    tx_ = known[x]
                    small, large = (tx_, ty_) if len(tx_) < len(ty_) else (ty_, tx_)
                    spot = np.searchsorted(large, small)
                    shared = int((large[np.minimum(spot, len(large) - 1)] == small).sum()) if len(large) else 0
                    keep.append(100 * shared >= percent * (len(tx_) + len(ty_) - shared) and shared > 0)
                k = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], names=["x", "y"])

    out = written(both.mapInArrow(run, "x long, y long"), "links")
    forget(pairs)
    return out


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s, low struct<id, s>): every end of a link with the smallest (id, s) that it reaches; nodes: (s, id), s unique.

    Each round takes the least label among neighbours and then the label's own label, so rounds grow with the logarithm
    of the longest path; each is written, and only counts come back. Minima are combined before they are shuffled, and
    neighbours and labels that very many share are dealt over many tasks.
    """
    ends = written(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "ends")
    hot = hot_keys(ends.groupBy("y").agg(F.count("*").alias("c")), "y", ends.count())
    own = nodes.select("s", F.struct("id", "s").alias("low"))
    label = written(own.join(ends.select(F.col("x").alias("s")).distinct(), "s", "left_semi"), "labels")
    n = label.count()
    while True:
        near = spread_join(ends, label, ("y", "s"), hot).groupBy("x").agg(F.min("low").alias("best"))
        step = label.join(near, F.col("s") == F.col("x")).select("s", F.col("low").alias("was"), F.least("low", "best").alias("low"))
        step = written(step.withColumn("t", F.col("low.s")), "steps")
        above = step.select(F.col("s").alias("u"), F.col("low").alias("up"))
        near_root = spread_join(step, above, ("t", "u"), hot_keys(step.groupBy("t").agg(F.count("*").alias("c")), "t", n))
        after = written(near_root.select("s", "was", F.least("low", "up").alias("low")), "labels")
        settled = after.filter("was != low").isEmpty()
        forget(label, step)
        label = after
        if settled:
            forget(ends)
            return label.select("s", "low")


def prefix_candidates(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(x, y) of members (s, n, comp) of different components that can be similar, by an exact prefix filter.

    Shingles stand in order of how many members hold them. Two sets with 100 * intersection >= percent * union share one
    of the first n - ceil(n * percent / 100) + 1 of both, so only those meet; shingles of one member only are counted as
    first, but not dealt further. Of a shingle's holders the most frequent component is held against the others only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, raw in _slices(b):
                hashes, ends = shingle_sets(raw)
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                rows = pa.array(np.repeat(np.arange(len(raw)), ends - starts) + at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(hashes.view(np.int64))], names=["s", "w"])

    members = written(members, "open")
    held = written(members.select("s").join(texts, "s").select("s", "text").mapInArrow(run, "s long, w long"), "shingles")
    df = written(held.groupBy(F.col("w").alias("dw")).agg(F.count("*").alias("c")).filter("c > 1"), "frequencies")
    shared = spread_join(held, df, ("w", "dw"), hot_keys(df, "dw", held.count())).select("s", "w", "c")
    by_rank = Window.partitionBy("s").orderBy("c", "w")
    # rank among the shared ones; the others stand before them
    ranked = shared.select("s", "w", F.row_number().over(by_rank).alias("rank"), F.count("*").over(Window.partitionBy("s")).alias("k"))
    ranked = ranked.join(members, "s").withColumn("place", F.col("n") - F.col("k") + F.col("rank"))
    first = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    first = written(first.select(F.col("w").alias("key"), "s", "n", "comp", "place"), "prefixes")

    sizes = first.groupBy("key", "comp").agg(F.count("*").alias("k"))
    top = sizes.groupBy(F.col("key").alias("tk")).agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.count("*").alias("comps"), F.sum("k").alias("c")).filter("comps > 1")
    top = written(top.select("tk", "most", "c"), "tops")
    hot = hot_keys(top, "tk", first.count())
    split = written(spread_join(first, top, ("key", "tk"), hot).select("key", "s", "n", "comp", "place", "most"), "split")
    out = split.filter("comp != most").select(F.col("key").alias("ok"), F.col("s").alias("os"), F.col("n").alias("on"), F.col("comp").alias("oc"), F.col("place").alias("op"))
    # at the first shingle that two sets share, only those after it can be shared too
    needed = F.ceil((F.col("n") + F.col("on")) * percent / (100 + percent))
    able = 1 + F.least(F.col("n") - F.col("place"), F.col("on") - F.col("op")) >= needed
    met = spread_join(split, out, ("key", "ok"), hot).filter((F.col("comp") != F.col("oc")) & similar_size(F.col("n"), F.col("on"), percent) & able)
    found = written(met.select(F.least("s", "os").alias("x"), F.greatest("s", "os").alias("y")).distinct(), "candidates")
    forget(members, held, df, first, top, split)
    return found


def shared_halves(rows: DataFrame, first: int, m: int) -> DataFrame:
    """(s, halves array<long>) of the rows (s, keys) that share one of keys[first : first + m] with another row."""
    half = rows.select("s", F.explode(F.slice("keys", first + 1, m)).alias("val"))
    common = written(half.groupBy("val").agg(F.count("*").alias("c")).filter("c > 1"), "common")
    hot = hot_keys(common, "val", rows.count() * m)
    live = spread_join(half, common.select(F.col("val").alias("cv")), ("val", "cv"), hot, "left_semi")
    out = written(live.groupBy("s").agg(F.collect_list("val").alias("halves")), "halves")
    forget(common)
    return out


def near_duplicates(docs: DataFrame, percent: int = 75, m: int = 10, rows: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles long, component_id, kept boolean) for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their sets of 5-word shingles; component_id is
    the smallest id reachable, kept is id = component_id. Null, empty and blank texts have no shingles and are linked
    with nothing. A null id is linked with nothing, its component is null and it is kept. Rows are judged by id and text:
    of rows with equal ids and unequal texts each has its own component, and all rows of a component's smallest id that
    belong to it are kept (drop_near_duplicates() keeps one). Other columns are ignored. An empty table gives an empty
    table. At the threshold a pair meets in some table with probability (1 - (1 - p**rows)**m)**2, 0.9995 for the
    defaults; above it, more. Sets are told apart by 64-bit hashes.
    """
    out = row_components(docs, percent, m, rows, id_col, text_col)
    component = F.coalesce("low.id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def row_components(docs: DataFrame, percent: int = 75, m: int = 10, rows: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th long, n long, s long, low struct<id, s>) for every row of docs.

    th is the hash of the text, n the size of its set and s the set's hash; low is the smallest (id, s) of its component,
    null where n is 0 or the id is null. See near_duplicates().
    """
    sig = written(signatures(docs, m, rows, id_col, text_col), "signatures")
    classed = sig.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("s").agg(F.min(F.struct("id", "th")).alias("head"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("c"))
    nodes = written(classed.select("s", "head.id", "head.th", "n", "keys", "c"), "classes")

    # a document needs a shared half-key of either collection, so the second one is for those of the first only
    a = shared_halves(nodes.select("s", "keys"), 0, m)
    b = shared_halves(nodes.join(a, "s", "left_semi").select("s", "keys"), m, m)
    live = nodes.select("s", "n").join(a.withColumnRenamed("halves", "a"), "s").join(b.withColumnRenamed("halves", "b"), "s")
    keyed = live.withColumn("u", F.explode("a")).withColumn("v", F.explode("b")).select(F.xxhash64("u", "v").alias("key"), "s", "n")
    keyed = written(keyed, "tables")
    shared = written(keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    hot = hot_keys(shared, "k", keyed.count())
    met = written(spread_join(keyed, shared, ("key", "k"), hot).select("key", "s", "n", "c"), "met")
    # the member that meets most others in all tables speaks for a bucket: of copies of one text, mostly that text
    known = met.groupBy(F.col("s").alias("ps")).agg(F.sum("c").alias("pop"))
    ranked = written(met.join(known, F.col("s") == F.col("ps")).select("key", "s", "n", "c", "pop"), "ranked")
    bucket = ranked.groupBy("key").agg(F.first("c").alias("c"), F.max(F.struct("pop", "s", "n")).alias("rep"), F.bit_xor(F.xxhash64("s")).alias("who"))
    # buckets with the same members say the same
    bucket = bucket.groupBy("c", "rep", "who").agg(F.min("key").alias("bk")).select("bk", F.col("rep.s").alias("rs"), F.col("rep.n").alias("rn"))
    members = written(spread_join(ranked, bucket, ("key", "bk"), hot).select("key", "s", "n", "rs", "rn"), "members")

    star = members.filter((F.col("s") != F.col("rs")) & similar_size(F.col("n"), F.col("rn"), percent)).select(F.col("rs").alias("x"), F.col("s").alias("y")).distinct()
    wanted = nodes.join(members.select("s").distinct(), "s", "left_semi").select("s", F.col("id").alias("hid"), F.col("th").alias("hth"))
    wanted = written(wanted.withColumn("h", F.xxhash64("hid", "hth")), "wanted")
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).withColumn("t", F.xxhash64("text"))
    texts = texts.filter(key_filter(wanted, "h")(F.xxhash64("i", "t")))
    texts = texts.join(wanted, (F.col("i") == F.col("hid")) & (F.col("t") == F.col("hth"))).select("s", "text").dropDuplicates(["s"])
    texts = written(texts, "texts")
    links = confirmed(star, texts, percent)

    comp = components(links, nodes)
    told = members.join(comp.select(F.col("s").alias("cs"), "low"), F.col("s") == F.col("cs"), "left").select("key", "s", "n", F.coalesce("low.s", "s").alias("comp"))
    told = written(told, "told")
    parts = told.groupBy(F.col("key").alias("pk")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("pk")
    open_ = spread_join(told, parts, ("key", "pk"), hot, "left_semi").select("s", "n", "comp").distinct()
    more = prefix_candidates(open_, texts, percent)
    tried = star.select(F.least("x", "y").alias("px"), F.greatest("x", "y").alias("py"))
    again = confirmed(more.join(tried, (F.col("x") == F.col("px")) & (F.col("y") == F.col("py")), "left_anti"), texts, percent)
    if not again.isEmpty():
        comp = components(links.union(again), nodes)

    heads = nodes.select("s", "id", "c").join(comp, "s", "left").select(F.col("s").alias("hs"), F.coalesce("low", F.struct("id", "s")).alias("low"))
    many = hot_keys(nodes, "s", sig.count())
    real = sig.select("id", "th", "n", "s", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("s")).alias("rs"))
    out = written(spread_join(real, heads, ("rs", "hs"), many, "left").select("id", "th", "n", "s", "low"), "components")
    forget(sig, nodes, a, b, keyed, shared, met, ranked, members, wanted, texts, links, told, more, again)
    return out


def drop_near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, that with the smallest id; its columns, and all other rows, as they are.

    Rows are known by id and text, so of rows with equal ids and unequal texts each is judged by its own text, and of rows
    equal in both one stays. Rows with null ids, and with null, empty or blank texts, all stay. An empty table gives an
    empty table; other columns stay whatever their names.
    """
    judged = row_components(docs, percent, id_col=id_col, text_col=text_col).filter("low is not null")
    # of a component's rows: those of the smallest id, of these the smallest set, of these the smallest text
    each = judged.groupBy("id", "th").agg(F.first("low").alias("low"), F.first("s").alias("s"), F.count("*").alias("k"))
    best = each.groupBy(F.col("low").alias("of")).agg(F.min(F.struct("id", "s", "th")).alias("best"))
    best = best.select(F.col("best.id").alias("bi"), F.col("best.th").alias("bt"))
    each = each.join(best, (F.col("id") == F.col("bi")) & (F.col("th") == F.col("bt")), "left")
    known, hashed = free_name(docs, "__id"), free_name(docs, "__th")
    change = written(each.filter("bi is null or k > 1").select(F.col("id").alias(known), F.col("th").alias(hashed), F.col("bi").isNotNull().alias("stays")), "copies")
    row = (F.col(id_col) == F.col(known)) & (F.xxhash64(text_col) == F.col(hashed))
    # only rows that may change go through the join with their texts
    may = key_filter(change.select(F.xxhash64(known, hashed).alias("h")), "h")(F.xxhash64(F.col(id_col), F.xxhash64(text_col)))
    once = docs.filter(~may).unionByName(docs.filter(may).join(change, row, "left_anti"))
    repeated = change.filter("stays")
    if repeated.isEmpty():
        return once
    few = docs.filter(may).join(repeated.select(known, hashed), row).dropDuplicates([known, hashed]).select(*[f"`{c}`" for c in docs.columns])
    return once.unionByName(few)
