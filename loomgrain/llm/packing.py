"""Pattern packing: documents become token pieces, and a histogram of lengths decides which pieces share a sequence.

Only the histogram (one count per length, at most `capacity` of them, whatever the corpus) reaches the driver. There,
patterns of few lengths are fitted to it by non-negative least squares, repeat counts are rounded down, and what is left
is packed by best fit, all on counts. The plan says which ranks of which length stand where; pieces find their place by
their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.common import written
from loomgrain.llm.token_counts import byte_letters

#: Characters for which the library's normalising and splitting are plain lower case and white space.
BEYOND_LATIN = re.compile(r"[^\t\n\r -~À-ÿ]")
#: What the vocabulary's splitting rule sets apart from letters and white space, in lower-case texts of those characters.
APART = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Words this long go to the library, whose merging of long words is the faster one.
LONG = re.compile(r"(?<!\S)\S{1000}")


# ---------------------------------------------------------------- tokens


class WordEncoder:
    """Little-endian 32-bit ids of whole texts, equal to those of the tokenizers library.

    The vocabulary ends each word's last byte with a mark. Texts within Latin-1 are lowered and their words set apart by
    spaces, and the space after a word is taken for that mark: so the vocabulary is one of bytes, its ids are in order of
    rank (a byte and the mark come first), and tiktoken merges a text in one call. Texts beyond Latin-1, with very long
    words or with strings of special tokens go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tiktoken import Encoding

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        mark = model["end_of_word_suffix"]
        self.path = path
        self.specials = list(added.values())
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {}
        for token, i in model["vocab"].items():
            if i not in added:
                ends = token.endswith(mark) and token != mark
                ranks[bytes(byte_of[c] for c in token.removesuffix(mark if ends else "")) + b" " * ends] = i
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][a + b] != len(ranks) - len(merges) + k for k, (a, b) in enumerate(merges)):
            raise ValueError(f"the ids of {path} aren't in order of rank")
        self.words = Encoding(os.path.basename(path), pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        """The library's tokenizer, some 30 MB that a worker only holds once a text asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def apart(self, text: str) -> str | None:
        """The text with its words set apart by white space; None for a text that goes to the library."""
        if BEYOND_LATIN.search(text) or LONG.search(text) or any(s in text for s in self.specials):
            return None
        return APART.sub(r" \g<0> ", text.lower())

    def ids(self, text: str) -> list[int]:
        apart = self.apart(text)
        if apart is None:
            return self.library.encode(text, add_special_tokens=False).ids
        return self.words.encode_ordinary(apart.replace("\n", " ").replace("\t", " ").replace("\r", " ") + " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.ids(t)).tobytes() for t in texts]


_encoders: dict[str, WordEncoder] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece int, start long, length long, ids binary): each document's ids and then end_id, cut only beyond capacity.

    ids are unsigned 32-bit little-endian. Null text counts as empty: one piece that holds end_id alone. Null ids stay
    null, repeated rows give pieces each, other columns are ignored, an empty table gives no pieces. Row-wise.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        enc = _encoders[path]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [t or "" for t in b.column(1).to_pylist()]
                rows, out = [], []
                for k, ids in enumerate(enc.encode(texts)):
                    ids += end
                    for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        rows.append(k)
                        out.append((p, s // 4, len(part) // 4, part))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *cols], names=["id", *schema.names])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- the plan, on counts


def nonnegative_fit(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by an active set: add the column of steepest descent, solve, step back to bounds."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ (b - a @ x)
    for _ in range(rounds):
        if free.all() or slope[~free].max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
        slope = a.T @ (b - a @ x)
    return x


def length_patterns(classes: int, parts: int) -> list[tuple[int, ...]]:
    """All multisets of 2 to `parts` class numbers (1..classes) whose sum is exactly `classes`, and the full class alone."""
    found = [(classes,)]
    for k in range(1, parts):
        for head in combinations_with_replacement(range(1, classes), k):
            last = classes - sum(head)
            if last >= head[-1]:
                found.append((*head, last))
    return found


def plan_packing(counts: np.ndarray, capacity: int, classes: int = 64, parts: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many sequences)] that use up counts[l] pieces of each length l in 1..capacity.

    Work and result are bounded by the capacity and the number of classes, not by the counts.
    """
    left = counts.astype(np.int64).copy()
    done: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        done.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    width = -(-capacity // classes)
    cls = (np.arange(capacity + 1) + width // 2) // width  # the nearest multiple of the width
    h = np.bincount(cls, weights=left, minlength=classes + 1)[1 : classes + 1]
    patterns = [p for p in length_patterns(classes, parts) if all(h[c - 1] > 0 for c in p)]
    bins: list[tuple[tuple[int, ...], int]] = []
    if patterns:
        a = np.zeros((classes, len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                a[c - 1, j] += 1
        weight = np.sqrt(np.arange(1, classes + 1))  # a long piece left over costs more
        repeats = np.floor(nonnegative_fit(a * weight[:, None], h * weight) + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] <= 0:
                break
            bins += _realise(left, cls, patterns[j], int(repeats[j]), capacity)
    return done + _best_fit(left, bins, capacity)


def _realise(left: np.ndarray, cls: np.ndarray, pattern: tuple[int, ...], n: int, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Up to n sequences of a pattern out of what is left: the longest of one class meet the shortest of the next."""
    runs = []
    for k, c in enumerate(sorted(pattern, reverse=True)):
        lens = [int(x) for x in np.flatnonzero((cls == c) & (left > 0))]
        need, run = n, []
        for length in sorted(lens, reverse=k % 2 == 0):
            take = min(need, int(left[length]))
            if take:
                run.append([length, take])
                left[length] -= take
                need -= take
            if not need:
                break
        runs.append(run)
    out = []
    while all(runs):
        m = min(r[-1][1] for r in runs)
        lens = tuple(r[-1][0] for r in runs)
        if sum(lens) > capacity:  # the last one goes back to the rest
            left[lens[-1]] += m
            lens = lens[:-1]
        out.append((lens, m))
        for r in runs:
            r[-1][1] -= m
            if not r[-1][1]:
                r.pop()
    for r in runs:
        for length, m in r:
            left[length] += m
    return out


def _best_fit(left: np.ndarray, bins: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Place the rest, longest first, each in the fullest sequence that still has room, else in a new one."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for lens, n in bins:
        room.setdefault(capacity - sum(lens), []).append((lens, n))
    rooms = sorted(room)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length  # new sequences, filled with this length
                full, rest = divmod(n, each)
                for size, m in ((each, full), (rest, 1)):
                    if size and m:
                        _add(room, rooms, capacity - size * length, (length,) * size, m)
                n = 0
                continue
            space = rooms[at]
            lens, m = room[space].pop()
            if not room[space]:
                del room[space], rooms[at]
            fits = min(space // length, n)
            use = min(m, n // fits)
            if m > use:
                _add(room, rooms, space, lens, m - use)
            _add(room, rooms, space - fits * length, lens + (length,) * fits, use)
            n -= use * fits
        left[length] = 0
    return [x for group in room.values() for x in group]


def _add(room: dict, rooms: list[int], space: int, lens: tuple[int, ...], n: int) -> None:
    if space not in room:
        room[space] = []
        bisect.insort(rooms, space)
    room[space].append((lens, n))


# ---------------------------------------------------------------- places


def pack(pieces: DataFrame, capacity: int = 4096, classes: int = 64, parts: int = 3, spread: int = 256, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (with `length`, 1..capacity) plus sequence_id long and offset long, in as few sequences as the plan finds.

    Every row gets a place, gapless from offset 0 in its sequence; rows of equal length are interchangeable and ranked
    by `keys`, so ties and repeated rows get places each. A null or non-positive length gets null places; a length over
    the capacity is an error. Empty tables give empty tables. Existing columns sequence_id and offset are replaced. To
    rank, rows are dealt by (length, hash of keys), so that one frequent length is spread over `spread` groups times as
    many as the table needs; only counts meet across groups. pieces is read twice: pass a written table.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counted = pieces.filter("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted:
        if r["length"] > capacity:
            raise ValueError(f"a piece of {r['length']} is longer than a sequence of {capacity}")
        counts[r["length"]] = r["n"]
    total = int(counts.sum())
    plan = plan_packing(counts, capacity, classes, parts)

    # (length, first rank) -> first sequence, offset
    first_rank, first_seq = np.zeros(capacity + 1, np.int64), 0
    places = []
    for lens, n in plan:
        offset = 0
        for length in lens:
            places.append((length, first_rank[length], first_seq, offset))
            first_rank[length] += n
            offset += length
        first_seq += n
    places = np.array(sorted(places), np.int64).reshape(-1, 4)
    bits = 44  # ranks under 2**44 of a length
    starts = (places[:, 0] << bits) + places[:, 1]

    groups = spread * max(1, total // 10_000_000)
    salted = pieces.withColumn("__g", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("long"))
    within = salted.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__g").orderBy(*keys)) - 1)
    sizes = salted.filter("length > 0").groupBy("length", "__g").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("__l"), F.col("__g").alias("__h"), F.coalesce("__before", F.lit(0)).alias("__before"))
    ranked = within.join(before, (F.col("length") == F.col("__l")) & (F.col("__g") == F.col("__h")), "left")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ok = (length > 0) & rank.notna()
        key = (length.where(ok, 0).astype("int64").to_numpy() << bits) + rank.where(ok, 0).astype("int64").to_numpy()
        p = places[np.maximum(np.searchsorted(starts, key, "right") - 1, 0)] if len(places) else np.zeros((len(key), 4), np.int64)
        seq = pd.Series(p[:, 2] + key - ((p[:, 0] << bits) + p[:, 1]), dtype="Int64").where(ok.to_numpy())
        return pd.DataFrame({"sequence_id": seq, "offset": pd.Series(p[:, 3], dtype="Int64").where(ok.to_numpy())})

    placed = ranked.withColumn("__p", place("length", (F.col("__before") + F.col("__r")).cast("long")))
    return placed.select(*pieces.columns, "__p.sequence_id", "__p.offset")


def packed_documents(docs: DataFrame, path: str, capacity: int = 4096, digest: bool = True) -> DataFrame:
    """Token pieces of docs with their place; the ids themselves, or where `digest` their unsigned CRC-32.

    Nulls, repeated rows, other columns and empty tables: see token_pieces(). The number of a row in the written table
    tells equal ones apart, so that they are dealt and ranked like any others.
    """
    pieces = token_pieces(docs, path, capacity)
    if digest:
        pieces = pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    pieces = written(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity, keys=("doc_id", "piece", "__row")).drop("__row")
