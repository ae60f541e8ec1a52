"""Spectra of graphs too large for a task: products of the packed edges with a few vectors at a time, as keyed passes.

Nodes are dealt by hash into chunks, some chunks make a group, and nodes are numbered within it; edges are packed by their
two groups. A product sends each packed part the two groups it needs and adds up what the parts give. Beside the tables only
small matrices of sums are on the driver: a few hundred numbers a chunk and step. No table goes there to be joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.sources.stages import dealt, forget, kept

#: Nodes of a chunk, and edges of a packed part at most (about): what a task holds at a time.
CHUNK, PART = 1 << 16, 1 << 20
#: Chunks of a group at most. Vectors are sent once for each other group, so groups are as few as parts of PART edges allow.
GROUP = 8
#: Vectors of either matrix. More of them bring the next eigenvalues along, and the gap behind those sets the pace.
WIDTH = {"a": 2, "l": 4}
PARTS = ("x", "y", "p", "q", "w", "z")
SUMS = "c int, label array<bigint>, a array<double>, l array<double>"


def one_way(edges: DataFrame) -> DataFrame:
    """(a, b, r): each edge (src, dst, r) once, a < b, without loops; of repeated edges the largest r counts."""
    e = edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("r").cast("double").alias("r"))
    return e.groupBy("a", "b").agg(F.max("r").alias("r"))


def packed(edges: DataFrame, nodes: DataFrame, n: int, chunk: int, part: int) -> tuple[DataFrame, DataFrame, int]:
    """(chunks (c, d), parts (ga, gb, k, i, j, r), groups): weighted degrees, and edges by their ends' groups and places in them.

    Chunk c belongs to group c % groups. Places run through a group's chunks in order, so a chunk's nodes lie side by side.
    """
    count, many_chunks = edges.count(), -(-n // chunk)
    groups = min(many_chunks, max(math.ceil(math.sqrt(2 * count / part)), -(-many_chunks // GROUP)))
    place = (F.row_number().over(Window.partitionBy("g").orderBy("c", "node")) - 1).cast("int")  # a group's nodes
    numbered = nodes.withColumn("c", F.pmod(F.xxhash64("node"), F.lit(many_chunks)).cast("int")).withColumn("g", F.pmod("c", F.lit(groups)))
    numbered = kept(numbered.withColumn("i", place), "spectrum-nodes")
    chunks = numbered.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("i", "d"))).alias("s")).select("c", F.col("s.d").alias("d"))
    a, b = numbered.select(F.col("node").alias("a"), F.col("g").alias("ga"), "i"), numbered.select(F.col("node").alias("b"), F.col("g").alias("gb"), F.col("i").alias("j"))
    e = edges.join(dealt(a), "a").join(dealt(b), "b")
    turned = F.col("ga") > F.col("gb")
    e = e.select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"), F.when(turned, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(turned, F.col("i")).otherwise(F.col("j")).alias("j"), "r")
    many = max(1, math.ceil(count / (groups * groups / 2) / part))
    rows = e.groupBy("ga", "gb", F.pmod(F.xxhash64("i", "j"), F.lit(many)).cast("int").alias("k")).agg(F.collect_list(F.struct("i", "j", "r")).alias("s"))  # about `part` edges
    return kept(chunks, "spectrum-chunks"), kept(rows.select("ga", "gb", "k", F.col("s.i").alias("i"), F.col("s.j").alias("j"), F.col("s.r").alias("r")), "spectrum-edges"), groups


def _of(table: pa.Table, name: str, row: int = 0) -> np.ndarray:
    return table.column(name)[row].values.to_numpy(zero_copy_only=False)


def _sums(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["c", "label", "a", "l"])


def products(parts: DataFrame, sent: DataFrame, groups: int) -> DataFrame:
    """(c, label, a, l) from the same columns: least label of the neighbours, sums of their a, r-weighted sums of their l.

    a and l are matrices of one vector a row. What is empty (of all chunks) stays so.
    """
    places = parts.select("ga", "gb", "k")
    either = places.select(F.col("ga").alias("g"), "*").union(places.filter("ga != gb").select(F.col("gb").alias("g"), "*")).toDF("g", "to_a", "to_b", "to_k")

    def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        i, j, r = (_of(edges, c) for c in ("i", "j", "r"))
        vectors = vectors.sort_by("c")
        of_group = np.array(vectors.column("g").to_pylist())
        size = np.array(vectors.column("m").to_pylist())
        ends = [edges.column(c)[0].as_py() for c in ("ga", "gb")]
        out: list[list] = [[np.zeros(0, np.int64)] + [np.zeros(0)] * len(WIDTH) for _ in of_group]
        rows = {g: np.flatnonzero(of_group == g) for g in set(ends)}
        cuts = {g: np.cumsum(size[rows[g]])[:-1] for g in rows}
        turns = ((*ends, i, j), (*ends[::-1], j, i))

        def group(name: str, g: int) -> np.ndarray:
            return np.concatenate([_of(vectors, name, k).reshape(-1, size[k]) for k in rows[g]], axis=1)

        def deal(at: int, made: dict[int, np.ndarray]) -> None:
            for g, whole in made.items():
                for k, own in zip(rows[g], np.split(whole, cuts[g], axis=1), strict=True):
                    out[k][at] = own.ravel()

        label = {g: group("label", g) for g in rows}
        if len(label[ends[0]]):
            least = {g: np.full(x.shape, np.iinfo(np.int64).max) for g, x in label.items()}
            for p, q, to, of in turns:
                np.minimum.at(least[p][0], to, label[q][0][of])
            deal(0, least)
        for at, s in enumerate(WIDTH, 1):
            mats = {g: group(s, g) for g in rows}
            total = {g: np.zeros(m.shape) for g, m in mats.items()}
            for p, q, to, of in turns:
                for v in range(len(mats[q])):
                    total[p][v] += np.bincount(to, mats[q][v][of] * (r if s == "l" else 1.0), total[p].shape[1])
            deal(at, total)
        return _sums([(c, *out[k]) for k, c in enumerate(vectors.column("c").to_pylist())])

    def total(table: pa.Table) -> pa.Table:
        rows = range(table.num_rows)
        label, a, l = _of(table, "label").copy(), _of(table, "a").copy(), _of(table, "l").copy()  # noqa: E741
        for k in rows[1:]:
            np.minimum(label, _of(table, "label", k), out=label)
            a += _of(table, "a", k)
            l += _of(table, "l", k)  # noqa: E741
        return _sums([(table.column("c")[0].as_py(), label, a, l)])

    given = sent.withColumn("g", F.pmod("c", F.lit(groups))).join(F.broadcast(either), "g")  # a row for two groups
    given = given.select("to_a", "to_b", "to_k", "g", "c", "m", "label", "a", "l")
    return parts.groupBy("ga", "gb", "k").cogroup(given.groupBy("to_a", "to_b", "to_k")).applyInArrow(run, SUMS).groupBy("c").applyInArrow(total, SUMS)


class _Side:
    """One matrix's vectors as the driver knows them: how the last step's are mixed into the next, and what is found."""

    def __init__(self, sign: float, deflate: bool) -> None:
        self.sign, self.deflate = sign, deflate
        self.mix: np.ndarray | None = None
        self.means = self.theta = self.ritz = np.zeros(0)
        self.held, self.value, self.left, self.done = 0, 0.0, math.inf, False

    def judge(self, rest: float, tol: float) -> None:
        """rest: the residual's length of the first vector held."""
        if self.held and not self.done:
            self.value = self.sign * float(self.theta[0])
            others = self.ritz[self.ritz > self.theta[0] + 2 * rest + 1e-9 * abs(self.theta[0])]  # copies lie nearer
            gap = float(others[0] - self.theta[0]) if len(others) else 0.0
            self.left = min(rest, rest**2 / gap) if gap else rest
            self.done = self.left <= tol * abs(self.value) or rest <= 1e-14 * float(np.abs(self.ritz).max())

    def turn(self, g: np.ndarray, h: np.ndarray, sums: np.ndarray, n: int, wide: int) -> None:
        """The next vectors from the products of all vectors x, w, p with each other (g) and with the matrix's (h)."""
        self.means = sums / n if self.deflate else np.zeros(len(sums))
        g = g - n * np.outer(self.means, self.means)
        scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        g, h = g * np.outer(scale, scale), (h + h.T) / 2 * np.outer(scale, scale)
        size, base = np.linalg.eigh(g)
        base = base[:, size > 1e-12 * size[-1]] / np.sqrt(size[size > 1e-12 * size[-1]])
        self.ritz, mix = np.linalg.eigh(base.T @ h @ base)
        self.theta, mix = self.ritz[:wide], scale[:, None] * (base @ mix[:, :wide])
        self.mix, self.held, self.before = mix, mix.shape[1], self.held


def graph_spectrum(edges: DataFrame, tol: float = 1e-10, most: int = 1000, chunk: int = CHUNK, part: int = PART) -> tuple[float | None, float | None]:
    """(largest adjacency eigenvalue, second-smallest eigenvalue of the r-weighted Laplacian) of one graph (src, dst, r).

    Nodes are the ends of edges; weights r are positive. A few vectors of either matrix are improved at once: each step
    takes the best mixtures of the vectors, their residuals (of the Laplacian over its diagonal less the eigenvalue) and the
    last step's changes, on vectors of mean 0 for the Laplacian. A matrix is done when its eigenvalue's error, the
    residual or its square over the distance to the next eigenvalue, is at most tol times the eigenvalue; after `most` steps
    without that there is an error. Well-knit graphs take some dozens of steps, also where degrees differ widely; long
    paths take far too many. Each step also hands the least label to all neighbours; once none changes, the components are
    known and no labels are sent any more. A graph of several components has connectivity 0; without edges both are null. Loops are left out, of repeated
    edges the largest r counts.
    """
    e = kept(one_way(edges), "spectrum-pairs")
    nodes = kept(e.select(F.col("a").alias("node"), "r").union(e.select("b", "r")).groupBy("node").agg(F.sum("r").alias("d")), "spectrum-degrees")
    n = nodes.count()
    if not n:
        return None, None
    chunks, parts, groups = packed(e, nodes, n, chunk, part)
    sides = {"a": _Side(-1.0, False), "l": _Side(1.0, True)}
    cols = [s + p for s in WIDTH for p in PARTS]
    schema = "c int, d array<double>, label array<bigint>, moved bigint, " + ", ".join(f"{c} array<double>" for c in cols)

    def mapped(df: DataFrame, step, ddl: str) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromDDL(ddl))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(b.num_rows):
                    t = pa.Table.from_batches([b.slice(at, 1)])
                    yield pa.RecordBatch.from_pylist([step({f: _of(t, f) if pa.types.is_list(t.schema.field(f).type) else t.column(f)[0].as_py() for f in t.schema.names})], arrow)

        return df.mapInArrow(run, ddl)

    def begin(row: dict) -> dict:
        m, rng = len(row["d"]), np.random.default_rng(row["c"])
        starts = {"a": 1 + rng.random((WIDTH["a"], m)), "l": rng.standard_normal((WIDTH["l"], m))}
        empty = np.zeros(0)
        return {"c": row["c"], "d": row["d"], "label": (row["c"] << 32) + np.arange(m), "moved": 0, **{c: empty for c in cols}, **{s + "w": starts[s].ravel() for s in WIDTH}}

    def forward(how: dict, known: bool):
        def step(row: dict) -> dict:
            m, out = len(row["d"]), dict(row)
            if known:
                out["label"] = np.zeros(0, np.int64)
            mat = lambda c: row[c].reshape(-1, m)
            for s, (mix, means, theta, before, done) in how.items():
                if done:
                    out |= {s + p: np.zeros(0) for p in PARTS}
                    continue
                all_, of = np.concatenate([mat(s + c) for c in "xwp"]) - means[:, None], np.concatenate([mat(s + c) for c in "yzq"])
                change = mix.copy()
                change[:before] = 0
                x, y = mix.T @ all_, mix.T @ of
                rest = y - theta[:, None] * x
                if s == "l":
                    rest = rest / np.maximum(np.abs(row["d"] - theta[:, None]), 0.05 * np.abs(theta[:, None]) + 1e-300)
                last = (change.T @ all_, change.T @ of) if before else (np.zeros(0), np.zeros(0))
                out |= {s + "x": x.ravel(), s + "y": y.ravel(), s + "p": last[0].ravel(), s + "q": last[1].ravel(), s + "w": rest.ravel(), s + "z": np.zeros(0)}
            return out

        return step

    def met(row: dict) -> dict:
        label = np.minimum(row["label"], row["least"])
        return {**{c: row[c] for c in ("c", "d", *cols)}, "label": label, "moved": int((label != row["label"]).sum()), **{s + "z": (-row["w" + s] if s == "a" else (row["d"] * row["lw"].reshape(-1, len(row["d"]))).ravel() - row["wl"]) if len(row[s + "w"]) else np.zeros(0) for s in WIDTH}}

    def sums(row: dict) -> dict:
        m = len(row["d"])
        out = {"moved": row["moved"], "roots": int((row["label"] == (row["c"] << 32) + np.arange(len(row["label"]))).sum())}
        for s, side in thetas.items():
            all_, of = (np.concatenate([row[s + c].reshape(-1, m) for c in names]) for names in ("xwp", "yzq"))
            rest = row[s + "y"][:m] - side[0] * row[s + "x"][:m] if len(row[s + "x"]) else np.zeros(0)
            out |= {s + "g": (all_ @ all_.T).ravel(), s + "h": (all_ @ of.T).ravel(), s + "s": all_.sum(1), s + "r": float(rest @ rest)}
        return out

    found = "moved bigint, roots bigint, " + ", ".join(f"{s}g array<double>, {s}h array<double>, {s}s array<double>, {s}r double" for s in WIDTH)
    now, old, whole = mapped(chunks, begin, schema), None, None
    for _ in range(most):
        own = now.select("c", F.size("d").alias("m"), "label", F.col("aw").alias("a"), F.col("lw").alias("l"))
        back = products(parts, own, groups).select("c", F.col("label").alias("least"), F.col("a").alias("wa"), F.col("l").alias("wl"))
        state = kept(mapped(now.join(dealt(back), "c"), met, schema), "spectrum-step")
        if old is not None:
            forget(old)
        old = state
        thetas = {s: side.theta if len(side.theta) else np.zeros(1) for s, side in sides.items()}
        rows = mapped(state, sums, found).collect()
        if whole is None and not sum(r.moved for r in rows):
            whole = sum(r.roots for r in rows) == 1
            sides["l"].done = sides["l"].done or not whole
        for s, side in sides.items():
            side.judge(math.sqrt(sum(r[s + "r"] for r in rows)), tol)
        if sides["a"].done and sides["l"].done and whole is not None:
            return sides["a"].value, sides["l"].value if whole else 0.0
        for s, side in sides.items():
            if not side.done:
                k = len(rows[0][s + "s"])
                side.turn(*(sum(np.array(r[s + c]) for r in rows).reshape(shape) for c, shape in (("g", (k, k)), ("h", (k, k)), ("s", (k,)))), n, WIDTH[s])
        now = mapped(state, forward({s: (side.mix, side.means, side.theta, side.before if side.mix is not None else 0, side.done) for s, side in sides.items()}, whole is not None), schema)
    raise RuntimeError(f"no eigenvalue to {tol} after {most} steps: errors {sides['a'].left}, {sides['l'].left}")
