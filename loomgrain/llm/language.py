"""Language identification by interpolated Kneser-Ney character models.

Models are trained on a bounded sample of labelled rows and kept as sorted arrays of n-gram hashes with one column of log
probabilities a language. A text gets the language of lowest cross-entropy per character; one whose cross-entropy is far
above what its language's own texts of that length have is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.runs import slices

U = np.uint64
ORDER = 4
DISCOUNT = 0.75
_MULT = U(0x9E3779B97F4A7C15 | 1)
_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else a space."""
    if not _fold:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _fold.append(t)
    return _fold[0]


def folded(texts: list[str], pad: int = ORDER - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, at, n): letters in lower case, all else one space; `pad` spaces before each text and one after it.

    at are the places to score, text by text (its letters, the spaces between them and the one after), n their number by
    text. An n-gram that ends at one of them begins in its own text or in the spaces before it, never in another text.
    """
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = fold_table()[raw]
    gap = code == 32
    cut = raw == 0
    keep = ~(gap & np.concatenate([[False], gap[:-1]])) | cut
    keep[1:] &= ~(gap[1:] & ~cut[1:] & cut[:-1])
    code, cut = code[keep], cut[keep]
    # a space that ends a text stands before a cut; it goes, as the cut is one
    last = np.concatenate([(code[:-1] == 32) & ~cut[:-1] & cut[1:], [False]])
    code, cut = code[~last], cut[~last]
    n = np.diff(np.flatnonzero(cut))
    wide = np.repeat(code, np.where(cut, 1 + pad, 1))  # the space after a text, and those before the next
    first = np.cumsum(np.concatenate([[1 + pad], n[:-1] + pad]))
    at = np.arange(n.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(n[:-1])]), n)
    return wide, at, n


def gram_hashes(code: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place; the first order - 1 places reach back before the start."""
    with np.errstate(over="ignore"):
        c = code.astype(U) + U(1)
        h = np.zeros(len(c), U)
        for k in range(order - 1, -1, -1):
            part = c if k == 0 else np.concatenate([np.zeros(k, U), c[:-k]])
            h = (h + part) * _MULT
            h ^= h >> U(29)
        return h


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # by order - 1: sorted hashes
    logp: list[np.ndarray]  # by order - 1: float32, a column a language
    contexts: list[np.ndarray]  # by order - 1 (from 2): sorted hashes of the n - 1 characters before
    backoff: list[np.ndarray]  # log of the weight of lower orders
    floor: np.ndarray  # log probability of a character never seen
    usual: np.ndarray | None = None  # a row a language: mean cross-entropy, deviation among texts, among characters

    def scores(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters at some places, a column a language, by the longest n-gram known."""
        return self._order(len(self.grams), [gram_hashes(code, k + 1) for k in range(len(self.grams))], at)

    def _order(self, k: int, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        if k == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.languages)))
        h = hashes[k - 1][at]
        spot = np.minimum(np.searchsorted(self.grams[k - 1], h), len(self.grams[k - 1]) - 1)
        out = self.logp[k - 1][spot]
        miss = np.flatnonzero(self.grams[k - 1][spot] != h)
        if len(miss):
            low = self._order(k - 1, hashes, at[miss])
            if k > 1:
                before = hashes[k - 2][np.maximum(at[miss] - 1, 0)]
                c = np.minimum(np.searchsorted(self.contexts[k - 1], before), len(self.contexts[k - 1]) - 1)
                known = (self.contexts[k - 1][c] == before)[:, None]
                low = low + np.where(known, self.backoff[k - 1][c], 0)
            out[miss] = low
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats a character, number of characters) of each text, a column a language.

        A text's row depends on that text alone.
        """
        code, at, n = folded(texts, len(self.grams) - 1)
        p = self.scores(code, at).astype(np.float64)
        total = np.add.reduceat(p, np.concatenate([[0], np.cumsum(n[:-1])]), axis=0)
        return -total / n[:, None], n


def text_grams(text: str, order: int = ORDER) -> list[Counter]:
    """The n-grams of 1 to order characters that end at a scored place of a text, with their numbers."""
    code, at, _ = folded([text], order - 1)
    s = "".join(map(chr, code.tolist()))
    return [Counter(s[i - k + 1 : i + 1] for i in at.tolist()) for k in range(1, order + 1)]


def train(counts: dict[str, dict[int, Counter]], order: int = ORDER) -> Model:
    """counts: language -> order -> n-gram -> how often. Interpolated Kneser-Ney with one discount."""
    languages = sorted(counts)
    alphabet = {g for lang in languages for g in counts[lang][1]}
    floor = -np.log(len(alphabet) + 1.0)
    p: list[list[dict[str, float]]] = []
    weights: list[list[dict[str, float]]] = []
    for lang in languages:
        probs: list[dict[str, float]] = []
        backs: list[dict[str, float]] = []
        for k in range(1, order + 1):
            if k == order:
                c = counts[lang][k]
            else:  # in how many different contexts an n-gram continues
                c = Counter()
                for g in counts[lang][k + 1]:
                    c[g[1:]] += 1
            total, kinds = Counter(), Counter()
            for g, n in c.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            back = {h: DISCOUNT * kinds[h] / total[h] for h in total}
            lower = probs[-1] if probs else None
            now = {}
            for g, n in c.items():
                less = lower.get(g[1:]) if lower is not None else 1 / (len(alphabet) + 1.0)
                now[g] = (n - DISCOUNT) / total[g[:-1]] + back[g[:-1]] * (less if less is not None else 1e-9)
            probs.append(now)
            backs.append(back)
        p.append(probs)
        weights.append(backs)

    def full(i: int, k: int, g: str) -> float:
        """Probability of an n-gram under a language, by backing off where it isn't known."""
        if k == 0:
            return 1 / (len(alphabet) + 1.0)
        hit = p[i][k - 1].get(g)
        if hit is not None:
            return hit
        return weights[i][k - 1].get(g[:-1], 1.0) * full(i, k - 1, g[1:])

    grams, logp, contexts, backoff = [], [], [], []
    for k in range(1, order + 1):
        keys = sorted({g for probs in p for g in probs[k - 1]})
        h = _hash_strings(keys, k)
        table = np.array([[np.log(full(i, k, g)) for i in range(len(languages))] for g in keys], np.float32).reshape(len(keys), len(languages))
        by = np.argsort(h, kind="stable")
        grams.append(h[by])
        logp.append(table[by])
        if k == 1:
            contexts.append(np.zeros(0, U))
            backoff.append(np.zeros((0, len(languages)), np.float32))
            continue
        keys = sorted({c for b in weights for c in b[k - 1]})
        h = _hash_strings(keys, k - 1)
        table = np.array([[np.log(weights[i][k - 1].get(c, 1.0)) for i in range(len(languages))] for c in keys], np.float32).reshape(len(keys), len(languages))
        by = np.argsort(h, kind="stable")
        contexts.append(h[by])
        backoff.append(table[by])
    base = np.array([np.log(weights[i][0][""]) for i in range(len(languages))]) + floor
    return Model(languages, grams, logp, contexts, backoff, base.astype(np.float32))


def _hash_strings(grams: list[str], n: int) -> np.ndarray:
    code = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, n)
    h = np.zeros(len(code), U)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h + code[:, k].astype(U) + U(1)) * _MULT
            h ^= h >> U(29)
    return h


# ---------------------------------------------------------------- on tables


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 of 4. A null id is not."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text, fit boolean): about per_language labelled rows of each language, none held out, chosen by hash."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("id is not null and lang is not null and text is not null").filter(~held_out("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(chance)
    return rows.filter(draw < chance).select("lang", "text", (F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(4)) > 0).alias("fit"))


def fit_model(docs: DataFrame, per_language: int = 400, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from about per_language labelled rows of each language; None where no row is labelled.

    Three quarters of the sample give the n-gram counts (made and summed in tasks), one quarter what cross-entropies are
    usual. per_language is the bound on what is learnt from; predictions cover every row.
    """
    sample = training_sample(docs, per_language, id_col, text_col, lang_col).repartition(8).persist()
    try:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for k, grams_ in enumerate(text_grams(text, order), 1):
                        for g, n in grams_.items():
                            seen[lang, k, g] += n
            rows = list(seen.items())
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int32()), pa.array([r[0][2] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["lang", "k", "gram", "n"])

        grams = sample.filter("fit").select("lang", "text").mapInArrow(count, "lang string, k int, gram string, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas()
        if grams.empty:
            return None
        counts = {lang: {k: Counter(dict(zip(g["gram"], g["n"], strict=True))) for k, g in per.groupby("k")} for lang, per in grams.groupby("lang")}
        model = train(counts, order)

        def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    e, n = model.entropies(b.column(1).to_pylist())
                    own = e[np.arange(len(n)), [model.languages.index(x) if x in model.languages else 0 for x in b.column(0).to_pylist()]]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own), pa.array(n, pa.int64())], names=["lang", "e", "n"])

        seen = sample.filter("not fit").select("lang", "text").mapInArrow(usual, "lang string, e double, n long").toPandas()
        model.usual = np.array([_usual(seen[seen["lang"] == lang], seen) for lang in model.languages])
        return model
    finally:
        sample.unpersist()


def _usual(own, everyone) -> tuple[float, float, float]:
    """Mean cross-entropy, its deviation among long texts, and that of one character, from texts of one language.

    With fewer than 8 texts, those of all languages count instead; with fewer than 8 of these, nothing is unusual.
    """
    own = own if len(own) >= 8 else everyone
    if len(own) < 8:
        return np.inf, 1.0, 1.0
    e, n = own["e"].to_numpy(), own["n"].to_numpy()
    mean = float((e * n).sum() / n.sum())
    return mean, max(0.05, float(np.std(e[n >= np.median(n)]))), max(0.5, float(np.sqrt(np.median(n * (e - mean) ** 2) / 0.455)))


def identify(docs: DataFrame, model: Model | None, reject_at: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean) for every row.

    lang_pred is a learned language, or und if the text is null or has no letter (or nothing was learned): score 0,
    rejected. rejected: the cross-entropy is more than reject_at deviations above the usual for that length; the score is
    0 then. Else it is the posterior of the language among the learned ones at equal priors, with the evidence of at most
    100 characters. Whole texts are scored, each on its own, so equal texts get equal rows however the table is dealt; ties
    go to the first language in order. Null ids stay null and count as not held out, repeated rows give a row each, other
    columns are ignored, an empty table gives an empty table. No shuffle.
    """
    src = docs.select(F.col(id_col).alias("__k0"), held_out(id_col).alias("__k1"), F.col(text_col).alias("__text"))
    told = _judged(src, model, reject_at)
    return told.withColumnsRenamed({"__k0": id_col, "__k1": "held_out"})


def accepted(docs: DataFrame, model: Model | None, reject_at: float = 8.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, with its columns, whose language is identified and not rejected; see identify().

    Rows with null or letterless texts go. Null ids, repeated rows and all other columns, whatever their names, stay as they
    are; an empty table, or no model, gives an empty table.
    """
    src = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(docs.columns)], F.col(text_col).alias("__text"))
    told = _judged(src, model, reject_at).filter("not rejected")
    return told.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)])


def _judged(src: DataFrame, model: Model | None, reject_at: float) -> DataFrame:
    """src without its last column, the text, plus what the model says of it."""
    kept = src.schema.fields[:-1]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, len(kept)):
                texts = [t or "" for t in b.column(len(kept)).to_pylist()]
                names, scores, ents, out = [], [], [], []
                for at, end in _parts(texts):
                    for row in _judge(model, texts[at:end], reject_at):
                        names.append(row[0])
                        scores.append(row[1])
                        ents.append(row[2])
                        out.append(row[3])
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(ents, pa.float64()), pa.array(out, pa.bool_())], names=[*(f.name for f in kept), "lang_pred", "score", "cross_entropy", "rejected"])

    return src.mapInArrow(run, head + ", lang_pred string, score double, cross_entropy double, rejected boolean")


def _parts(texts: list[str], most: int = 300_000) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _judge(model: Model | None, texts: list[str], reject_at: float) -> Iterator[tuple]:
    if model is None:
        yield from (("und", 0.0, None, True) for _ in texts)
        return
    e, n = model.entropies(texts)
    best = e.argmin(axis=1)
    z = -(e - e[np.arange(len(best)), best][:, None]) * np.minimum(n, 100)[:, None]
    post = 1 / np.exp(z).sum(axis=1)
    lowest = e[np.arange(len(best)), best]
    mean, among, each = model.usual[best].T
    far = (lowest - mean) > reject_at * np.sqrt(among**2 + each**2 / n)
    for t, b, s, x, k, r in zip(texts, best.tolist(), post.tolist(), lowest.tolist(), n.tolist(), far.tolist(), strict=True):
        yield ("und", 0.0, None, True) if k <= 1 else (model.languages[b], 0.0 if r else s, x, r)
