"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its number of initial symbols minus the merges that apply; no identifiers are made.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa

from loomgrain.llm.runs import slices
from pyspark.sql import DataFrame

#: The byte-level splitting rule, for texts of printable ASCII, common controls and Latin-1 letters.
LATIN_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"
)
#: Anything outside the characters for which LATIN_SPLIT is known to be the library's rule.
BEYOND_LATIN = re.compile(r"[^\t\n\r -~À-ÿ]")
#: White space before a space: there, a space isn't simply the head of what follows.
SPACE_RUN = ("  ", "\n ", "\t ", "\r ")


class MergeCounter:
    """Counts the tokens of one byte-level BPE vocabulary (a tokenizers .json file).

    Merging pops the lowest rank from a heap of adjacent pairs, ties from the left; symbols form a linked list, so a
    merge costs O(log n) and a word of n bytes O(n log n). Counts of words are kept in tables of bounded size.
    """

    def __init__(self, path: str, keep: int = 250_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids = spec["model"]["vocab"]
        # (left, right) -> rank and the merged symbol, all as small integers
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_split = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        shown = byte_letters()
        self.symbol = [ids[shown[b]] for b in range(256)]
        self.library = Tokenizer.from_file(path)
        self.pre = self.library.pre_tokenizer
        self.letter_byte = {c: b for b, c in shown.items()}
        self.words = Kept(lambda w: self.merged(w.encode()), 2 * keep)
        self.chunks = Kept(self._spaced, keep)

    def merged(self, word: bytes) -> int:
        """Number of symbols left after all merges inside one word."""
        sym = [self.symbol[b] for b in word]
        n = len(sym)
        if n < 2:
            return n
        merge = self.merge
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := merge.get((sym[i], sym[i + 1])):
                heap.append((hit[0], i, hit[1], sym[i], sym[i + 1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged away meanwhile
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if hit := merge.get((new, sym[k])):
                    heapq.heappush(heap, (hit[0], i, hit[1], new, sym[k]))
            if (h := before[i]) >= 0 and (hit := merge.get((sym[h], new))):
                heapq.heappush(heap, (hit[0], h, hit[1], sym[h], new))
        return left

    def _spaced(self, chunk: str) -> int:
        return sum(map(self.words.__getitem__, LATIN_SPLIT.findall(" " + chunk)))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if BEYOND_LATIN.search(text):
            letter = self.letter_byte
            return sum(self.merged(bytes(letter[c] for c in w)) for w, _ in self.pre.pre_tokenize_str(text))
        if text[-1] == " " or any(s in text for s in SPACE_RUN):
            return sum(self.merged(w.encode()) for w in LATIN_SPLIT.findall(text))
        # each space heads the chunk after it, so chunks split alike wherever they stand
        chunks = iter(text.split(" "))
        first = next(chunks)
        return sum(self.merged(w.encode()) for w in LATIN_SPLIT.findall(first)) + sum(map(self.chunks.__getitem__, chunks))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special_split is None:
            return self._plain(text)
        parts = self.special_split.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


#: Longer words and chunks are counted anew each time.
LONG_KEY = 64


class Kept(dict):
    """Results by key in two generations of at most `keep` each; what the older one holds moves up when used again.

    Keys of more than LONG_KEY characters aren't kept, so the tables are bounded in bytes too.
    """

    def __init__(self, compute, keep: int):
        super().__init__()
        self.compute, self.keep, self.older = compute, keep, {}

    def __missing__(self, key):
        if len(key) > LONG_KEY:
            return self.compute(key)
        self.make_room()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def make_room(self) -> None:
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if visible, else the next free one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The counter of a vocabulary, loaded once in each Python worker."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long, over_limit boolean) for every row of docs.

    Null text counts as empty: 0 bytes, 0 tokens, false. A null id stays null, repeated rows give a row each, other
    columns are ignored whatever their names, an empty table gives an empty table. Texts are taken whole. Strings of the
    vocabulary's special tokens inside a text are one token each, as the library has it by default. Row-wise: no shuffle.
    """
    from pyspark.sql import functions as F

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for b in slices(whole, 1):
                texts = [t or "" for t in b.column(1).to_pylist()]
                n = [c.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
