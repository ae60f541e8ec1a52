"""Spelling variants: pairs of words exactly one edit apart, by dynamic programming over sorted lists.

Words are dealt into buckets that hold every near pair: of two words one edit apart, the shorter of m code points, either
the first m // 2 or the last m // 2 agree. In a bucket the words' rests are sorted, and each word is held against the
list from its own place on. The rows of the edit matrix that belong to the prefix shared with the entry before are kept;
a row needs three cells, as nothing further off the diagonal can be within one edit. Where all three exceed one edit, so
does every entry with that prefix, and the scan goes on behind them.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.common import forget, hot_keys, written

#: Letters a word of the vocabulary consists of, once A-Z is lower-cased.
LETTERS = re.compile(r"[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it passes them on.
HELD = 400_000
#: Lists longer than this are split on before they are scanned.
LONG_LIST = 256
LAST = chr(0x10FFFF)


def dropped_letter(word: str, seed: int, every: int) -> str:
    """word, or if its checksum (zlib's CRC-32, carried on from `seed`) is a multiple of `every`, word without one letter."""
    h = zlib.crc32(word.encode(), seed)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least_letters: int = 5, least_count: int = 3, misspell: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word string, n long): words of at least `least_letters` code points found at least `least_count` times in all texts.

    Words are maximal runs of LETTERS in whole texts, A-Z lower-cased and nothing else. With `misspell` each occurrence
    whose CRC-32 of `<id>:<word>` (a null id is empty) is a multiple of it loses a letter first. Null and empty texts have
    no words, repeated rows count each, other columns are ignored, an empty table gives an empty one. A task passes on
    counts, not occurrences, so a frequent word costs the shuffle no more than any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for b in batches:
            for row in range(b.num_rows):
                text = b.column(1)[row].as_py()
                if not text:
                    continue
                found = Counter(LETTERS.findall(text.lower().decode(errors="replace")))  # lower() of bytes is that of A-Z alone
                if misspell is None:
                    for w, n in found.items():
                        if len(w) >= least_letters:
                            counts[w] += n
                else:
                    seed = zlib.crc32(f"{b.column(0)[row].as_py() or ''}:".encode())
                    for w, n in found.items():
                        if len(w) >= least_letters:
                            w = dropped_letter(w, seed, misspell)
                            if len(w) >= least_letters:
                                counts[w] += n
                if len(counts) >= HELD:
                    yield out()
        yield out()

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    part = src.mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# ---------------------------------------------------------------- lists


def lcp(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            return k
        k += 1
    return k


def near_in_list(rests: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j) with i < j of all pairs of the sorted list whose edit distance is exactly 1; equal strings are no pair."""
    shared = [0, *(lcp(a, b) for a, b in zip(rests, rests[1:]))]
    n = len(rests)
    for i, word in enumerate(rests):
        w = len(word)
        # rows[r]: edit distances of a list entry's first r letters to word's first r - 1, r and r + 1
        rows = [(2, 0, 1), *[(1, 0, 1)] * (w - 1), (1, 0, 2)] if w else [(2, 0, 2)]
        known, j = w, i + 1  # rows up to `known` are those of entry j - 1
        while j < n:
            entry = rests[j]
            e = len(entry)
            r = known = min(known, shared[j])
            low, mid, high = rows[r]
            while r < e and (low < 2 or mid < 2 or high < 2):
                letter = entry[r]
                r += 1
                # columns r - 1, r, r + 1 of word; a column that word doesn't have is out of reach
                new_low = new_mid = new_high = 2
                if r - 1 <= w:
                    new_low = low if r > 1 and letter == word[r - 2] else 1 + (low if low < mid else mid)
                    if r == 1:
                        new_low = 1
                if r <= w:
                    new_mid = mid if letter == word[r - 1] else 1 + min(mid, high, new_low)
                if r < w:
                    new_high = high if letter == word[r] else 1 + min(high, new_mid)
                low, mid, high = new_low, new_mid, new_high
                if r < len(rows):
                    rows[r] = (low, mid, high)
                else:
                    rows.append((low, mid, high))
            known = r
            if low > 1 and mid > 1 and high > 1:  # so is all that begins with these r letters
                j += 1
                if j < n and shared[j] >= r:
                    j = bisect_right(rests, entry[:r] + LAST, j)
                    known = min(known, r)
                continue
            if r == e:
                end = (low, mid, high)[w - e + 1] if -1 <= w - e <= 1 else 2
                if end == 1:
                    yield i, j
            j += 1


def near_in_bucket(words: list[str], m: int, head: int, tail: int, limit: int = LONG_LIST) -> Iterator[tuple[str, str]]:
    """All pairs (each once) of words of m or m + 1 code points one edit apart, of which at least one has m.

    All words agree in their first `head` and last `tail` code points. Long lists are split again: of what is between,
    the first or else the last half agrees too.
    """
    half = (m - head - tail) // 2
    if len(words) > limit and half:
        fronts, backs = defaultdict(list), defaultdict(list)
        for w in words:
            fronts[w[head : head + half]].append(w)
            backs[w[len(w) - tail - half : len(w) - tail]].append(w)
        for part in fronts.values():
            if len(part) > 1:
                yield from near_in_bucket(part, m, head + half, tail, limit)
        for part in backs.values():
            if len(part) > 1:
                for a, b in near_in_bucket(part, m, head, tail + half, limit):
                    if a[head : head + half] != b[head : head + half]:  # else the pair comes from the fronts
                        yield a, b
        return
    if head >= tail:
        rests = sorted((w[head : len(w) - tail], w) for w in words)
    else:
        rests = sorted((w[head : len(w) - tail][::-1], w) for w in words)
    if len(rests) > 1:
        for i, j in near_in_list([r for r, _ in rests]):
            a, b = rests[i][1], rests[j][1]
            if len(a) == m or len(b) == m:
                yield a, b


def _split(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, head, tail, sides, key), each twice: the first half of the rest goes to the key, and the last half."""
    rest = F.col("m") - F.col("head") - F.col("tail")
    half = F.floor(rest / 2).cast("int")
    sides = F.explode(F.array(F.lit("f"), F.lit("b"))).alias("side")
    d = rows.select("*", half.alias("half"), sides)
    front = F.col("side") == "f"
    at = F.when(front, F.col("head") + 1).otherwise(F.char_length("word") - F.col("tail") - F.col("half") + 1)
    piece = F.substring("word", at, F.col("half"))
    return d.select("word", "n", "m", (F.col("head") + F.when(front, F.col("half")).otherwise(0)).alias("head"), (F.col("tail") + F.when(front, 0).otherwise(F.col("half"))).alias("tail"), F.concat("sides", "side").alias("sides"), F.concat_ws("/", "key", "side", piece).alias("key"))


def near_words(vocabulary: DataFrame, limit: int = 100_000, share: int = 1000) -> DataFrame:
    """(a, a_n, b, b_n): each pair of distinct words of vocabulary (word, n) exactly one edit apart, once, in no order.

    One edit is one code point inserted, deleted or replaced. Null and empty words are in no pair; a word that the
    vocabulary repeats gives its pairs again. Every word goes to four buckets; buckets of more than `limit` words and more
    than 1/`share` of all rows are split again as a table until none is left, so what a task holds is one bucket below
    that. vocabulary is read several times: pass a written table.
    """
    long = F.char_length("word")
    rows = vocabulary.select("word", F.col("n").cast("long").alias("n")).filter(long > 0)
    rows = rows.select("word", "n", F.explode(F.array(long, long - 1)).alias("m")).filter("m >= 1")
    rows = _split(rows.select("word", "n", "m", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit("").alias("sides"), F.col("m").cast("string").alias("key")))
    total, done, open_ = 4 * vocabulary.count(), None, rows
    while total > limit:
        sizes = open_.filter("m - head - tail >= 2").groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > limit)
        hot = hot_keys(sizes, "key", total, share)
        if not hot:
            break
        rest = open_.filter(~F.col("key").isin(hot))
        done = rest if done is None else done.unionByName(rest)
        open_ = _split(open_.filter(F.col("key").isin(hot)))
    rows = open_ if done is None else done.unionByName(open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        now, what = None, None
        found: list[tuple] = []

        def close() -> None:
            if len(counts) > 1:
                m, head, tail, sides = what
                for a, b in near_in_bucket(list(counts), m, head, tail):
                    if _first_way(a, b, m, sides):
                        found.append((a, counts[a], b, counts[b]))
            counts.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["a", "a_n", "b", "b_n"])
            found.clear()
            return batch

        for b in batches:
            for key, word, n, *bucket in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    close()
                    now, what = key, bucket
                    if len(found) > 50_000:
                        yield out()
                counts[word] = n
        close()
        yield out()

    dealt = rows.repartition("key").sortWithinPartitions("key").select("key", "word", "n", "m", "head", "tail", "sides")
    return dealt.mapInArrow(run, "a string, a_n long, b string, b_n long")


def _first_way(a: str, b: str, m: int, sides: str) -> bool:
    """Whether this is the bucket that speaks for a pair: the ends are taken only where the beginnings differ."""
    head = tail = 0
    for side in sides:
        half = (m - head - tail) // 2
        same = a[head : head + half] == b[head : head + half]
        if side == "f":
            head += half
        elif same:
            return False
        else:
            tail += half
    return True


# ---------------------------------------------------------------- groups


def variant_groups(vocabulary: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root string, n, n_near, form_n long) for each word of vocabulary (word, n).

    A word's form is its near word (near_words()) of largest n, of equal ones the first in code-point order, if that is at
    least `factor` times the word's own n; else null, and form_n too. root is where the forms lead from word; a word
    without a form is its own root. n_near is the number of near words. Counts rise along forms, so they never go round.
    An empty vocabulary gives an empty table; words must be distinct. vocabulary is read several times.
    """
    pairs = near_words(vocabulary)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("c"), F.col("other").alias("w"))).alias("best"))
    enough: Column = -F.col("best.c") >= factor * F.col("n")
    near = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.c")).alias("form_n"))
    table = written(near, "near-words")
    # each round a word learns the root of its root, so rounds grow with the logarithm of the longest way
    to = table.filter("form is not null").select("word", F.col("form").alias("root"))
    kept = None
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if kept is not None:
            forget(kept)
        kept, to = step, step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return table.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
