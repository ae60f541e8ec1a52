"""Runs of repeated words, found while a suffix automaton grows word by word.

The states of the automaton form a tree by their suffix links; all suffixes of the words read so far that last ended in
one place lie on one path of it. Those paths are kept as splay trees (link-cut access). When a word is appended, the path
from its state to the root is recoloured with the new end, and the segments passed tell for each suffix where it ended
before: if the distance is among the segment's lengths, a suffix of that length stands twice in a row, and its root is
primitive. Squares of one half-length that end at consecutive words make a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that a task looks at in one go.
SLICE_BYTES = 4 << 20


class GrowingAutomaton:
    """Suffix automaton of a growing sequence, its suffix links as a link-cut tree coloured by last ends.

    State 1 is the empty suffix; it and 0 (no state) are outside the link-cut tree. `up` leads to the parent in a splay
    tree or, from its root, to the state above the path. All of a splay tree has one last end, kept at its root.
    """

    def __init__(self) -> None:
        self.length, self.link = [0, 0], [0, 0]
        self.next: list[dict[int, int]] = [{}, {}]
        self.up, self.left, self.right, self.end = [0, 0], [0, 0], [0, 0], [0, 0]
        self.whole, self.at = 1, -1

    def _state(self, length: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.next.append(after)
        for field in (self.link, self.up, self.left, self.right, self.end):
            field.append(0)
        return len(self.length) - 1

    def splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._rotate(p, g)
                self._rotate(x, p)
            else:
                self._rotate(x, p)
                if inner:
                    self._rotate(x, g)
            p = up[x]

    def _rotate(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
            else:
                self.end[x] = self.end[p]
        else:
            self.end[x] = self.end[p]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c:
            up[c] = p
        up[p], up[x] = x, g

    def append(self, word: int) -> list[int]:
        """Half-lengths of the squares with primitive root that end at the appended word."""
        self.at += 1
        length, link, after = self.length, self.link, self.next
        new = self._state(length[self.whole] + 1, {})
        p, self.whole = self.whole, new
        while p and word not in after[p]:
            after[p][word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = after[p][word]
            if length[p] + 1 != length[q]:
                q = self._divide(p, word, q)
            link[new] = q
        above = link[new] if link[new] != 1 else 0
        self.up[new] = above
        return self._access(new, above)

    def _divide(self, p: int, word: int, q: int) -> int:
        """A state for the shorter suffixes of q, just above q on its path, as they have ended where q's did."""
        after, link = self.next, self.link
        short = self._state(self.length[p] + 1, after[q].copy())
        link[short], link[q] = link[q], short
        while p and after[p].get(word) == q:
            after[p][word] = short
            p = link[p]
        self.splay(q)
        above = self.left[q]
        self.left[short], self.left[q], self.up[short] = above, short, q
        if above:
            self.up[above] = short
        return short

    def _access(self, below: int, x: int) -> list[int]:
        up, right, end, length, at = self.up, self.right, self.end, self.length, self.at
        squares = []
        while x:
            self.splay(x)
            was, above = end[x], up[x]
            if right[x]:
                end[right[x]] = was
            right[x] = below
            if length[above] < at - was <= length[x]:
                squares.append(at - was)
            below, x = x, above
        end[below] = at
        return squares


def runs_of(words: list[int], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence with length >= max(min_length, min_exponent * period), sorted.

    A run is maximal: no neighbour extends it with its smallest period. min_exponent is 2 or more.
    """
    grown, open_, out = GrowingAutomaton(), {}, []

    def close(period: int, first: int, last: int) -> None:
        start = first - 2 * period + 1
        if last - start + 1 >= max(min_length, min_exponent * period):
            out.append((start, last - start + 1, period))

    for i, w in enumerate(words):
        for period in grown.append(w):
            seen = open_.get(period)
            if seen and seen[1] == i - 1:
                seen[1] = i
            else:
                if seen:
                    close(period, *seen)
                open_[period] = [i, i]
    for period, seen in open_.items():
        close(period, *seen)
    return sorted(out)


def stretches(near: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of at least `least` trues."""
    edge = np.flatnonzero(np.diff(near.view(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2] - 1
    long = last - first + 1 >= least
    return first[long], last[long]


def pieces_with_runs(ids: np.ndarray, starts: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int]]:
    """(first, last) of the pieces of concatenated sequences outside of which there is no run; no run crosses their ends.

    Where a run of period p holds, each word but the first p has an equal one at most p before; so a run asks for a
    stretch of such words, max(min_length, min_exponent * p) - p of them. Periods are taken by powers of two.
    """
    n = len(ids)
    if not n:
        return []
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    back = np.full(n, n + 1, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    first, last = [], []
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    longest = int(np.diff(np.append(starts, n)).max())
    p = 1
    while min_exponent * p <= longest:
        a, b = stretches(back < 2 * p, max(min_length - (2 * p - 1), (min_exponent - 1) * p, 1))
        first.append(np.maximum(a - (2 * p - 1), begin[a]))
        last.append(b)
        p *= 2
    first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, last))
    out: list[list[int]] = []
    for k in np.argsort(first, kind="stable"):
        a, b = int(first[k]), int(last[k])
        if out and a <= out[-1][1] and begin[a] == begin[out[-1][0]]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_runs(texts: list[bytes], min_length: int = 6, min_exponent: int = 4) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """(words, runs) of each text: words are what ASCII white space sets apart."""
    words = [t.split() for t in texts]
    starts = np.cumsum([0, *(len(w) for w in words)])
    ids = []
    for at, w in zip(starts.tolist(), words):
        ids += map({}.setdefault, w, range(at, at + len(w)))  # a word's number is where it stands first
    ids = np.array(ids, np.int64)
    filled = starts[:-1][np.diff(starts) > 0]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in pieces_with_runs(ids, filled, min_length, min_exponent):
        k = int(np.searchsorted(starts, a, "right")) - 1
        found[k] += [(a - int(starts[k]) + s, n, p) for s, n, p in runs_of(ids[a : b + 1].tolist(), min_length, min_exponent)]
    return [(w, sorted(r)) for w, r in zip(words, found, strict=True)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, n, p in runs:
        keep[start + p : start + n] = False
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words long, runs array<struct<start, length, period long>>, collapsed string) for every row of docs.

    Words are runs of anything but ASCII white space, counted from 0; runs are sorted by start, then period; `collapsed`
    is the text with one period left of each run, words joined by one space. Null and empty texts have no words, no runs
    and an empty `collapsed`. Null ids stay, repeated rows give a row each, other columns are ignored, an empty table
    gives an empty one. Row-wise, whole texts: a document must fit a task, with about 1 KB for each of its words that
    stand where runs may be.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                got = find_runs([t or b"" for t in b.column(1).to_pylist()], min_length, min_exponent)
                listed = [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r in got]
                texts = [b" ".join(collapsed(w, r)) for w, r in got]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w, _ in got], pa.int64()), pa.array(listed, run_type), pa.array(texts, pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = src.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` bytes of one of its columns, or of one row."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
