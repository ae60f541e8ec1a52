"""Periodic runs, files of token ids and spelling variants against brute force, round trips and odd inputs."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgrain.llm import entry, runs, spelling, token_files

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, n long, word string, part int, h int, start long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash."""
    long, rep = " ".join(f"w{i}" for i in range(30_000)), "la " * 3000
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, long), (None, "a b a b a b a b c"), (6, rep), (7, "ÀÉ× colour color colours İ 日本語 <|endoftext|> x\x1cy\xa0z"), (8, "y" * 20_000), (29, ""), (None, None)]
    return spark.createDataFrame([(i, t, "en", 7, "p", 1, 2, 3) for i, t in texts], SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- 11


def brute_runs(w, shortest=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            if j > i and n >= max(shortest, exponent * q) and all(any(w[s + k] != w[s + k - p] for k in range(p, n)) for p in range(1, q)):
                out.append((s, n, q))
            i = j + 1
    return sorted(out)


def test_runs_of_random_words():
    rng = random.Random(0)
    for _ in range(600):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 8 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 6)
            w = [w[i] if i < a + p else w[a + (i - a) % p] for i in range(n)]
        assert runs.runs_of(w) == brute_runs(w)
        assert runs.runs_of(w, 2, 2) == brute_runs(w, 2, 2)
        texts = [b" ".join(b"w%d" % x for x in w), b"", b"x " * rng.randint(0, 9), b"a b c"]
        assert [r for _, r in runs.find_runs(texts)] == [brute_runs(t.split()) for t in texts]


def test_periodic_runs_of_odd_rows(odd):
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(odd).collect()}
    want = set()
    for i, t in rows_of(odd):
        w = WORD.findall(t or "")
        found = [] if len(w) > 10_000 else [(0, 3000, 1)] if w[:1] == ["la"] else brute_runs(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.add((i, len(w), tuple(found), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == want
    assert runs.periodic_runs(odd).count() == odd.count()
    assert runs.periodic_runs(odd.filter("false")).count() == 0


def test_query_of_runs(spark, docs):
    got = {r.doc_id: r for r in entry.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == docs.count()
    for i, t in rows_of(docs):
        w = WORD.findall(t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if n > 2000:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


def test_repeats_of_odd_rows(odd):
    assert entry.with_repeats(odd).count() == odd.count()


# ---- 12


@pytest.mark.parametrize("n", [0, 1, 2, 5, 2047, 2048, 2049, 7000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 300, 49_408, 65_536):
        ids = rng.integers(0, top, n).astype(np.uint32)
        codes = token_files.encode_blocks(ids)
        counts = [min(token_files.BLOCK, n - at) for at in range(0, n, token_files.BLOCK)]
        assert len(codes) == len(counts)
        assert np.array_equal(token_files.decode_blocks(codes, counts), ids)
    for ids in (np.full(n, 65_535, np.uint32), np.arange(n, dtype=np.uint32)[::-1].copy(), np.tile([5, 6, 7, 65_535], n)[:n].astype(np.uint32)):
        counts = [min(token_files.BLOCK, n - at) for at in range(0, n, token_files.BLOCK)]
        assert np.array_equal(token_files.decode_blocks(token_files.encode_blocks(ids), counts), ids)


def test_what_is_predicted_is_small():
    rng = np.random.default_rng(1)
    chain = np.tile(rng.integers(0, 49_408, 50), 200)[: token_files.BLOCK * 4].astype(np.uint32)
    noise = rng.integers(0, 49_408, token_files.BLOCK * 4).astype(np.uint32)
    sizes = [sum(map(len, token_files.encode_blocks(x))) for x in (chain, noise)]
    assert sizes[0] * 15 < sizes[1] < 4 * token_files.BLOCK * 2.1  # a repeated order, and no order


def test_blocks_learn_from_each_other():
    """What holds for all blocks is learnt once, not by each block anew."""
    ids = np.random.default_rng(5).integers(0, 512, 64 * token_files.BLOCK).astype(np.uint32)
    assert sum(map(len, token_files.encode_blocks(ids))) * 8 < 10.48 * len(ids)


def test_writer_predicts_what_the_reader_will():
    """The writer brings equal slots together instead of filling the reader's tables; both must say the same at each id."""
    rng = np.random.default_rng(9)
    rows = np.concatenate([rng.integers(0, 3, (3, 600)), rng.integers(0, 65_536, (2, 600)), np.tile(rng.integers(0, 49_408, 40), 15)[None]]).astype(np.uint16)
    code, extra = token_files.namings(rows)
    tables = token_files.Predictions(len(rows))
    for t in range(rows.shape[1]):
        context, way = tables.look(), code[:, t].astype(np.int64) & (token_files.WAYS - 1)
        assert np.array_equal(code[:, t] & ~np.uint16(token_files.WAYS - 1), context)
        right = tables.said == rows[:, t]
        assert np.array_equal(way, np.where(right[0], 0, np.where(right[1], 1, way))) and np.all((way > 1) == ~right.any(0))
        assert np.all(extra[way < 2, t] == 0)
        tables.learn(way, rows[:, t].astype(np.uint32))


def test_texts_in_one_pass():
    rng, letters = random.Random(6), "abAB '.,-\n\t09ÀÿßÖ×÷sS#é\r"
    texts = [None, "", " \n\t ", "İ 日本語", "<|endoftext|> x", "x\x1cy\xa0z", "x\x0by \x7f", "y" * 1000, "a" * 999 + " B", "ÿ" * 600, "don't DON'T it's ''s 'SAM É's Ö'LL", None]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    tok, words = Tokenizer.from_file(PATH), token_files.CachedWords(token_files._cached(PATH).encoder, most=500)
    for held in (pa.array(texts), pa.array(texts).slice(5, 900), pa.array(texts[:20], pa.large_string()), pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        ids, n = words.texts(held, 1)
        want = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in held.to_pylist()]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_damage_is_found():
    out, table = io.BytesIO(), pa.table({"id": [3, 4], "n_tokens": [2500, 500]})
    ids = np.random.default_rng(2).integers(0, 49_408, 3000).astype(np.uint32)
    token_files.write_file(out, table, ids)
    data = out.getvalue()
    back, again = token_files.read_file(data)
    assert back.equals(table) and np.array_equal(again, ids)
    for at in (0, 9, 2000, len(data) // 2, len(data) - 30, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, IndexError, OSError, zlib.error)):
            token_files.read_file(bytes(bad))


def test_token_files(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCKS", 4)  # so that parts have several files
    tok = Tokenizer.from_file(PATH)
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids) for r in token_files.token_round_trip(df, PATH, digest=False).collect()), key=lambda r: r[1])
        want = Counter()
        for i, t in rows_of(df):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            want[i, len(ids), struct.pack(f"<{len(ids)}I", *ids)] += 1
        assert Counter((i, n, bytes(b)) for i, _, n, b in got) == want
        at = 0
        for _, start, n, _ in got:
            assert start == at
            at += n
        ids = [i for i, *_ in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert token_files.token_round_trip(odd.filter("false"), PATH).count() == 0
    named = odd.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert token_files.token_round_trip(named, PATH).count() == odd.count()


def test_query_of_token_files(spark, docs):
    tok, at = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in entry.op12_token_files(spark, SF).collect()}
    for i, t in sorted(rows_of(docs)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


# ---- 13


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = spelling.lcp(a, b)
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def test_near_words_in_lists():
    rng = random.Random(3)
    for _ in range(400):
        letters = "abc"[: rng.randint(1, 3)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 60))})
        want = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and one_edit(a, b))
        assert sorted(spelling.near_in_list(words)) == want
        for m in range(1, 8):
            bucket = [w for w in words if len(w) in (m, m + 1)]
            pairs = [tuple(sorted(p)) for p in spelling.near_in_bucket(bucket, m, 0, 0, 2)]
            assert sorted(pairs) == sorted((a, b) for a in bucket for b in bucket if a < b and one_edit(a, b) and min(len(a), len(b)) == m)


@pytest.mark.parametrize("limit", [20, 100_000])
def test_near_words(spark, limit):
    """Long words of a few letters, so that buckets are split as a table and in tasks."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(700)} | {"prefix" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 6))) for _ in range(300)}
    vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long").cache()
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_words(vocabulary, limit, 1 << 40).collect()]
    ordered = sorted(words)
    want = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if one_edit(a, b)]
    assert sorted(got) == sorted(want)


def test_variants_of_odd_rows(spark, odd):
    got = {r.word: r for r in spelling.variant_groups(spelling.word_counts(odd, 1, 1)).collect()}
    counts = Counter(w for _, t in rows_of(odd) for w in re.findall("[a-zÀ-ÿ]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
    assert {w: r.n for w, r in got.items()} == counts
    assert "àé×" not in got and "ÀÉ×" in got  # only A-Z is lower-cased
    assert got["color"].n_near == 1 and got["color"].form is None
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variant_groups(none).count() == 0
    assert spelling.word_counts(odd.filter("false")).count() == 0


def test_forms_lead_to_roots(spark):
    """A chain of forms, ties by code point, and forms that aren't frequent enough."""
    rows = [("aaaaaa", 1), ("aaaaab", 2), ("aaaabb", 4), ("aaabbb", 9), ("zzzzz", 5), ("zzzzy", 9), ("zzzzé", 10), ("zzzzx", 10), ("solos", 3)]
    v = spark.createDataFrame(rows, "word string, n long").cache()
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variant_groups(v).collect()}
    assert got["aaaaaa"] == ("aaaaab", "aaabbb", 1, 2) and got["aaaabb"] == ("aaabbb", "aaabbb", 2, 9)
    assert got["zzzzz"] == ("zzzzx", "zzzzx", 3, 10) and got["zzzzy"] == (None, "zzzzy", 3, None)
    assert got["solos"] == (None, "solos", 0, None)


def test_query_of_variants(spark, tmp_path):
    odd = [(1, "bcolour " * 4), (2, None), (3, ""), (4, "Straße straße STRAßE strasse"), (None, "colour colour colour Colour bcolour×")]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for sf, files in ((SF, f"{SF}/documents.parquet"), (str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
        want = con.execute(entry.SPELLING_SQL).fetchall()
        got = entry.op13_spelling_variants(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert Counter(map(tuple, got)) == Counter(want) and want
