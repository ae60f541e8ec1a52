"""Token ids in files: an adaptive context-mixing range coder over blocks side by side.

A file is a head, blocks and a foot. Each block holds up to BLOCK ids and has a checksum of its own. All blocks of a file
are coded side by side: step t codes id t of every block, with numpy over the blocks.

What is coded of an id is how it is predicted. The last two ids name the id that followed them last in the block (order 2),
the last id names another (order 1), and order 0 names ids by how far back in the block they stand; an id that is new to
the block is named by its size. Distributions over these ways are learnt from all blocks of the file, at steps ever further
apart: one under how well the predictions did before, one under the way taken last, and one under both. The first two are
mixed by weights that follow the one that would have coded better, and the mixture stands in for what the third hasn't seen
yet. All numbers are integers, so that reader and writer agree on any machine.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.common import fresh_path, written
from loomgrain.llm.packing import APART, WordEncoder, _encoders
from loomgrain.llm.runs import slices
from loomgrain.llm.warc import store

#: Ids of a block, and blocks of a file at most.
BLOCK, BLOCKS = 2048, 2048
#: Fixed values of the format: its name, and the sizes of its head, block heads and tail.
MAGIC = b"LGTOKID1"
BLOCK_HEAD, TAIL = struct.Struct("<III"), struct.Struct("<QII8s")
#: Ways to name an id: order 2, order 1, six distances, eight sizes of new ids; contexts of the ways.
WAYS, CONTEXTS = 16, 512
NEW, BACK = 8, 2
#: Bits of the distributions, and slots of the prediction tables.
BITS, SLOTS = 12, 512
#: Steps before which distributions are learnt: each, then ever fewer.
STEPS = {t for k in range(64) if (t := max(k, int(4 * 1.2**k))) < BLOCK} | {1, 2, 3}

_EXTRA = np.array([0, 0, 2, 4, 6, 8, 10, 10, 9, *range(9, 16)], np.uint64)
_FULL = (1 << _EXTRA.astype(np.int64)).astype(np.uint64) - np.uint64(1)
_BASE = np.array([0, 0, 1, 5, 21, 85, 341, 1365, 0, *(512 << k for k in range(7))], np.int64)
_SIZE = (np.searchsorted(_BASE[NEW:], np.arange(1 << 16), "right") + NEW - 1).astype(np.uint8)
_NEAR = (np.searchsorted(_BASE[BACK:NEW], np.arange(BLOCK), "right") + BACK - 1).astype(np.uint8)
#: What a fresh model has seen: predictions that were right go on being right.
_FRESH = np.ones((2, 4, 4, WAYS, WAYS), np.int64)
_FRESH[..., 0] += np.array([0, 8, 80, 400])[None, :, None, None]
_FRESH[0, ..., 1] += np.array([0, 8, 40, 80])[None, :, None]


def shares(seen: np.ndarray) -> np.ndarray:
    """Rows of counts as shares of 1 << BITS; none is nothing."""
    out = 1 + seen * ((1 << BITS) - WAYS) // seen.sum(-1, keepdims=True)
    top = seen.argmax(-1)[..., None]
    np.put_along_axis(out, top, np.take_along_axis(out, top, -1) + (1 << BITS) - out.sum(-1, keepdims=True), -1)
    return out


class Model:
    """Distributions and weights, of all blocks together, that reader and writer share."""

    def __init__(self) -> None:
        self.seen, self.fresh = _FRESH.reshape(32, WAYS, WAYS).copy(), []
        self.fit()

    def fit(self) -> None:
        """Distributions and weights from what was seen; the older, the less it counts."""
        if self.fresh:
            self.seen -= self.seen >> 2
            self.seen += 16 * np.bincount(np.concatenate(self.fresh), minlength=CONTEXTS * WAYS).reshape(self.seen.shape)
            self.fresh = []
        by_trust, by_last = shares(self.seen.sum(1))[:, None], shares(self.seen.sum(0))[None]
        better = (self.seen * (by_trust > by_last)).sum((1, 2))
        weight = (256 * better // self.seen.sum((1, 2)))[:, None, None]
        mixed = weight * by_trust + (256 - weight) * by_last
        share = shares((self.seen << 8) + mixed)
        self.share = share.ravel().view(np.uint64)
        self.start = (share.cumsum(-1) - share).ravel().view(np.uint64)


class Predictions:
    """What the reader's blocks predict: the ids that followed last, in tables that grow id by id; of order 2, then of order 1."""

    def __init__(self, lanes: int):
        self.after = np.zeros(2 * lanes * SLOTS, np.uint32)
        self.tables = (np.arange(2 * lanes) * SLOTS).reshape(2, lanes)
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.last = np.zeros(lanes, np.int64)

    def narrow(self, lanes: int) -> None:
        """Only the first blocks go on."""
        self.tables = self.tables[:, :lanes].copy()
        self.one, self.two, self.last = (a[:lanes] for a in (self.one, self.two, self.last))

    def look(self) -> np.ndarray:
        """The context for the next id of each block, as the place of its first way; one and two are hashes of the last ids."""
        slot = np.empty(self.tables.shape, np.int64)
        np.add(self.one, self.two, out=slot[0])
        slot[0] >>= 1
        slot[1] = self.one
        slot >>= 4
        slot &= SLOTS - 1
        slot += self.tables
        said = self.after.take(slot)
        self.slot, self.trust = slot, said >> 16
        said &= 0xFFFF
        self.said = said
        context = self.trust[0] << 2
        context |= self.trust[1]
        context |= (said[0] == said[1]).view(np.uint8) << 4
        at = context.astype(np.int64)
        at <<= 4
        at |= self.last
        at <<= 4
        return at

    def learn(self, way: np.ndarray, ids: np.ndarray) -> None:
        """ids as 32-bit numbers. A prediction's trust rises to 3 while it is right; 1 is that of a fresh one."""
        trust = self.trust
        trust *= self.said == ids
        trust += 1
        np.minimum(trust, 3, out=trust)
        trust <<= 16
        trust |= ids
        self.after[self.slot] = trust
        self.two = self.one * 3
        self.one = ids * np.int64(40503)
        self.last = way


def distances(ids: np.ndarray) -> np.ndarray:
    """How far back each id of a block stands before (rows are blocks); 0 if it doesn't."""
    key = ids.astype(np.uint32)
    key <<= 11
    key |= np.arange(ids.shape[1], dtype=np.uint32)
    key.sort(axis=1)
    place = (key & (BLOCK - 1)).astype(np.int16)
    key >>= 11
    gap = place[:, 1:] - place[:, :-1]
    gap *= key[:, 1:] == key[:, :-1]
    spot = place[:, 1:] + np.arange(len(ids))[:, None] * ids.shape[1]
    back = np.zeros(ids.shape, np.int16)
    back.reshape(-1)[spot] = gap
    return back


def predicted(ids: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, trust) that Predictions says before each id of a block (rows are blocks), if it looks at these slots.

    The ids of one slot are brought together in their order, so each stands behind the one that it is predicted by.
    """
    key = slots.astype(np.uint32)
    key <<= 11
    key |= np.arange(ids.shape[1], dtype=np.uint32)
    key.sort(axis=1)
    spot = (key & (BLOCK - 1)).astype(np.int64)
    spot += np.arange(len(ids))[:, None] * ids.shape[1]
    key >>= 11
    own = ids.reshape(-1).take(spot)
    again = key[:, 1:] == key[:, :-1]
    right = own[:, 1:] == own[:, :-1]
    right &= again
    trust = again.astype(np.uint8)
    trust[:, 1:] += right[:, :-1] & again[:, 1:]
    trust[:, 2:] += right[:, 1:-1] & right[:, :-2] & again[:, 2:]
    said, trusted = np.zeros(ids.shape, np.uint16), np.zeros(ids.shape, np.uint8)
    said.reshape(-1)[spot[:, 1:]] = own[:, :-1] * again
    trusted.reshape(-1)[spot[:, 1:]] = trust
    return said, trusted


def namings(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, extra) of each id of a block (rows are blocks): context and way, and what the way leaves open."""
    back = distances(ids)
    one = np.zeros(ids.shape, np.uint16)  # of the hashes, what the slots are made of
    np.multiply(ids[:, :-1], np.uint16(40503), out=one[:, 1:])
    both = one.copy()
    both[:, 1:] += one[:, :-1] * np.uint16(3)
    id2, trust2 = predicted(ids, both >> np.uint16(5) & np.uint16(SLOTS - 1))
    id1, trust1 = predicted(ids, one >> np.uint16(4) & np.uint16(SLOTS - 1))
    right2 = id2 == ids
    known = right2 | (id1 == ids)
    near = back > 0
    way = np.where(known, ~right2, np.where(near, _NEAR.take(back), _SIZE.take(ids)))
    extra = np.where(near, back.view(np.uint16), ids)
    extra -= _BASE.astype(np.uint16).take(way)
    extra *= ~known
    code = (id1 == id2).astype(np.uint16)
    code <<= 2
    code |= trust2
    code <<= 2
    code |= trust1
    code <<= 4
    code[:, 1:] |= way[:, :-1]
    code <<= 4
    code |= way
    return code, extra


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Codes of consecutive blocks of BLOCK ids (the last may be shorter); ids are below 65,536."""
    if not len(ids):
        return []
    lanes = -(-len(ids) // BLOCK)
    steps = min(BLOCK, len(ids))
    rows = np.zeros(lanes * BLOCK, np.uint16)
    rows[: len(ids)] = ids
    rows = rows.reshape(lanes, BLOCK)[:, :steps]
    codes, extras = np.zeros((steps, lanes), np.uint16), np.zeros((steps, lanes), np.uint16)
    for at in range(0, lanes, 64):  # what the processor's caches hold
        code, extra = namings(np.ascontiguousarray(rows[at : at + 64]))
        codes[:, at : at + 64], extras[:, at : at + 64] = code.T, extra.T
    last = len(ids) - (lanes - 1) * BLOCK  # ids of the last block
    m = Model()
    lows, widths = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out, places = np.zeros((lanes, 2 * steps + 6), np.uint16), np.arange(lanes) * (2 * steps + 6)
    flat = out.ravel()
    low, width, pos = lows, widths, places
    top, sixteen, high, bits = np.uint64(1 << 48), np.uint64(16), np.uint64(48), np.uint64(BITS)
    for t in range(steps):
        if t == last and lanes > 1:
            low, width, pos = lows[:-1], widths[:-1], places[:-1]
        if t in STEPS:
            m.fit()
        n = len(low)
        m.fresh.append(codes[t, :n])
        code = codes[t, :n].astype(np.int64)
        r = width >> bits
        add = r * m.start.take(code)
        r *= m.share.take(code)
        code &= WAYS - 1
        r >>= _EXTRA.take(code)
        add += r * extras[t, :n]
        low += add
        over = (low < add).nonzero()[0]
        while over.size:  # carry into what is written
            at = pos[over] - 1
            while over.size:
                flat[at] += 1
                more = flat[at] == 0
                over, at = over[more], at[more] - 1
        full = r < top
        flat[pos] = low >> high  # written anew until the place is filled
        pos += full
        full = full * sixteen
        low <<= full
        r <<= full
        few = (r < top).nonzero()[0]
        while few.size:
            flat[pos[few]] = low[few] >> high
            pos[few] += 1
            low[few] <<= sixteen
            r[few] <<= sixteen
            few = few[r[few] < top]
        width[:] = r
    # any number from low up to low + width ends a block: the top 16 bits, rounded up, are enough
    end = lows + np.uint64((1 << 48) - 1)
    over = np.flatnonzero(end < lows)
    at = places[over] - 1
    while over.size:
        flat[at] += 1
        more = flat[at] == 0
        over, at = over[more], at[more] - 1
    flat[places] = end >> high
    return [out[k, : n + 1].tobytes() for k, n in enumerate((places - np.arange(lanes) * out.shape[1]).tolist())]


def decode_blocks(codes: list[bytes], counts: list[int]) -> np.ndarray:
    """The ids of blocks of encode_blocks(); all but the last have BLOCK ids."""
    lanes = len(codes)
    if not lanes:
        return np.zeros(0, np.uint32)
    steps, last = max(counts), counts[-1]
    words = max(2 * steps, max(len(c) for c in codes) // 2) + 8
    src = np.zeros((lanes, words), np.uint16)
    for k, c in enumerate(codes):
        src[k, : len(c) // 2] = np.frombuffer(c, "<u2")
    flat = src.ravel()
    m, p = Model(), Predictions(lanes)
    x, width, pos = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.arange(lanes) * words + 4
    for k in range(4):
        x = x << np.uint64(16) | src[:, k]
    ids = np.zeros((steps, lanes), np.uint16)
    flat_ids = ids.ravel()
    top, sixteen, bits, most = np.uint64(1 << 48), np.uint64(16), np.uint64(BITS), np.uint64((1 << BITS) - 1)
    ways = np.tile(np.arange(WAYS, dtype=np.uint8), CONTEXTS)
    for t in range(steps):
        if t == last and lanes > 1:
            p.narrow(lanes - 1)
            x, width, pos = x[:-1], width[:-1], pos[:-1]
        if t in STEPS:
            m.fit()
        if t in STEPS or not t:
            way_at = np.repeat(ways, m.share.view(np.int64))
        code = p.look()
        n = len(x)
        r = width >> bits
        at = x // r
        np.minimum(at, most, out=at)
        at = at.view(np.int64)
        at |= code << (BITS - 4)
        way = way_at.take(at).astype(np.int64)
        code |= way
        m.fresh.append(code.astype(np.uint16))
        x -= r * m.start.take(code)
        r *= m.share.take(code)
        r >>= _EXTRA.take(way)
        extra = x // r
        np.minimum(extra, _FULL.take(way), out=extra)
        x -= r * extra
        value = _BASE.take(way)
        value += extra.view(np.int64)
        back = ((way - BACK).view(np.uint64) < NEW - BACK).nonzero()[0]
        place = t - value.take(back)
        place *= lanes
        place += back
        value[back] = flat_ids.take(place)
        value = value.astype(np.uint32)
        np.copyto(value, p.said[0], where=way == 0)
        np.copyto(value, p.said[1], where=way == 1)
        ids[t, :n] = value
        full = r < top
        read = flat.take(pos) * full
        pos += full
        full = full * sixteen
        x <<= full
        x |= read
        r <<= full
        few = (r < top).nonzero()[0]
        while few.size:
            x[few] = x[few] << sixteen | flat[pos[few]]
            pos[few] += 1
            r[few] <<= sixteen
            few = few[r[few] < top]
        width = r
        p.learn(way, value)
    return np.ascontiguousarray(ids.T).ravel()[: (lanes - 1) * BLOCK + last].astype(np.uint32)


# ---------------------------------------------------------------- files


def write_file(out, docs: pa.Table, ids: np.ndarray) -> int:
    """Write docs (id, n_tokens) and their ids, one after the other, to a binary stream; the number of bytes."""
    out.write(MAGIC)
    size = len(MAGIC)
    for at in range(0, len(ids), BLOCK * BLOCKS):  # what is coded side by side is bounded, however long a document
        chunk = ids[at : at + BLOCK * BLOCKS]
        for k, code in enumerate(encode_blocks(chunk)):
            block = chunk[k * BLOCK : (k + 1) * BLOCK]
            out.write(BLOCK_HEAD.pack(len(block), len(code), zlib.crc32(block.astype("<u4").tobytes())))
            out.write(code)
            size += BLOCK_HEAD.size + len(code)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_table(docs)
    foot = zlib.compress(sink.getvalue())
    out.write(foot + TAIL.pack(size, len(foot), zlib.crc32(foot), MAGIC))
    return size + len(foot) + TAIL.size


def read_file(data: bytes) -> tuple[pa.Table, np.ndarray]:
    """(docs, ids) of a file of write_file(). A damaged block or foot is an error that says which."""
    if len(data) < TAIL.size or data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a file of token ids")
    at, length, crc, _ = TAIL.unpack(data[-TAIL.size :])
    foot = data[at : at + length]
    if at + length + TAIL.size != len(data) or zlib.crc32(foot) != crc:
        raise ValueError("the foot is damaged")
    docs = pa.ipc.open_stream(zlib.decompress(foot)).read_all()
    heads, codes, pos = [], [], len(MAGIC)
    while pos < at:
        n, size, crc = BLOCK_HEAD.unpack(data[pos : pos + BLOCK_HEAD.size])
        pos += BLOCK_HEAD.size
        heads.append((n, crc))
        codes.append(data[pos : pos + size])
        pos += size
    if pos != at or any(n != BLOCK for n, _ in heads[:-1]) or any(not 0 < n <= BLOCK for n, _ in heads):
        raise ValueError("the blocks are damaged")
    ids = [decode_blocks(codes[k : k + BLOCKS], [n for n, _ in heads[k : k + BLOCKS]]) for k in range(0, len(codes), BLOCKS)]
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    for k, (n, crc) in enumerate(heads):
        if zlib.crc32(ids[k * BLOCK : k * BLOCK + n].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    return docs, ids


#: What no plain text has; WordEncoder.apart() leaves the others to the library.
_ODD = np.ones(256, bool)
_ODD[[*b"\t\n\r", *range(32, 127), 0xC3, *range(0x80, 0xC0)]] = False  # UTF-8 of Latin-1's letters
#: Words of so many bytes go to the library, whose merging of long words is the faster one.
_LONG = 1000


class CachedWords:
    """Known words and their ids: word k has ids[bounds[k] : bounds[k + 1]]. All go when there are too many: about 50 MB at most."""

    def __init__(self, encoder: WordEncoder, most: int = 400_000):
        self.encoder, self.most = encoder, most
        self.last = np.zeros(encoder.words.n_vocab, bool)
        self.last[[encoder.words.encode_single_token(w) for w in encoder.words.token_byte_values() if w.endswith(b" ")]] = True  # they end words
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([""])
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def rows(self, words: pa.StringArray) -> np.ndarray:
        """The places of distinct lower-case words, set apart; those that aren't known are made in one call."""
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        new = np.flatnonzero(found < 0)
        if len(new) and len(self.words) > 1 and (len(self.words) + len(new) > self.most or len(self.ids) > 16 * self.most):
            self.forget()
            return self.rows(words)
        if len(new):
            made = words.take(pa.array(new))
            ids = self.encoder.words.encode_to_numpy(" ".join(made.to_pylist()) + " ")
            found = found.copy()
            found[new] = np.arange(len(new)) + len(self.words)
            self.words = pa.concat_arrays([self.words, made])
            self.bounds = np.concatenate([self.bounds, np.flatnonzero(self.last[ids]) + 1 + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        return found

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with end_id behind, and how many of each), equal to those of the tokenizers library.

        Texts are split as one array and only distinct words are looked up. A null text is empty.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n, (_, ends, data) = len(texts), texts.buffers()
        ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + n + 1]
        bad = np.flatnonzero(_ODD[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]) if ends[-1] > ends[0] else []
        odd = np.zeros(n, bool)
        odd[np.searchsorted(ends, bad + ends[0], "right") - 1 if len(bad) else []] = True
        raw = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes() if data else b""
        for special in (x for x in self.encoder.specials if x.encode() in raw):
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        while True:
            plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
            apart = pc.replace_substring_regex(pc.utf8_lower(plain), APART.pattern, r" \0 ")
            split = pc.ascii_split_whitespace(apart)
            of, words = split.offsets.to_numpy(), split.flatten()
            long = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) >= _LONG)
            if not len(long):
                break
            odd[np.searchsorted(of, long, "right") - 1] = True
        named = words.dictionary_encode()
        index = self.rows(named.dictionary).astype(np.int64).take(named.indices.to_numpy())
        # behind the words of each text all ids of an odd one, and then end_id
        rows, end = np.flatnonzero(odd), len(self.bounds) - 1
        more = [np.array([end_id], np.uint32), *(np.array(self.encoder.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) for k in rows.tolist())]
        held = np.concatenate([self.ids, *more])
        bounds = np.concatenate([self.bounds, len(self.ids) + np.cumsum([len(x) for x in more])])
        place = np.concatenate([rows, np.arange(n)])
        what = np.concatenate([np.arange(end + 1, end + len(more)), np.full(n, end)])
        order = np.argsort(place, kind="stable")
        index = np.insert(index, of[1:][place[order]], what[order])
        sizes = np.diff(bounds).take(index)
        upto = np.cumsum(sizes)
        ids = np.empty(upto[-1] if n else 0, "<u4")
        for at in range(0, len(index), 1 << 16):  # what the processor's caches hold
            part, size = index[at : at + (1 << 16)], sizes[at : at + (1 << 16)]
            stop = upto[at : at + (1 << 16)]
            first = stop[0] - size[0]
            spot = np.repeat(bounds.take(part) - (stop - size), size)
            spot += np.arange(first, stop[-1])
            held.take(spot, out=ids[first : stop[-1]], mode="clip")
        return ids, np.diff(upto[index == end], prepend=0)


_words: dict[str, CachedWords] = {}


def _cached(path: str) -> CachedWords:
    if path not in _words:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        _words[path] = CachedWords(_encoders[path])
    return _words[path]


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts, each with end_id behind, in ascending id order; (path, part, number, n_docs, n_ids, n_bytes).

    The result is a written table of the files; by part, then number, they are in order. A file closes with the document
    that fills BLOCKS blocks, so a task holds that many ids, or one document's. Null ids come first; rows equal in id are
    in the order of their texts' hashes, so reruns agree and a repeated id is dealt over tasks; a null or empty text is
    end_id alone; other columns are ignored; an empty table gives no files. A file appears under its final name only when
    complete and none is listed that a lost executor left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _cached(path)
        ids, names, counts, held, part, number = [], [], [], 0, None, 0

        def close() -> pa.RecordBatch:
            fs, base = store(folder)
            fs.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            table = pa.table({"id": pa.chunked_array(names), "n_tokens": pa.chunked_array([pa.array(c, pa.int64()) for c in counts])})
            with fs.open_output_stream(f"{base}/{name}.part") as out:
                size = write_file(out, table, np.concatenate(ids))
            fs.move(f"{base}/{name}.part", f"{base}/{name}.ids")
            row = {"path": f"{folder}/{name}.ids", "part": part, "number": number, "n_docs": sum(map(len, counts)), "n_ids": held, "n_bytes": size}
            return pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for whole in batches:
            for b in slices(whole, 1):
                part = b.column(2)[0].as_py()
                made, n = words.texts(b.column(1), end_id)
                upto, first, done = np.cumsum(n), 0, 0
                while first < len(n):
                    to = min(int(np.searchsorted(upto, done + BLOCK * BLOCKS - held)) + 1, len(n))
                    names.append(b.column(0).slice(first, to - first))
                    counts.append(n[first:to])
                    ids.append(made[done : upto[to - 1]])
                    held += int(upto[to - 1]) - done
                    first, done = to, int(upto[to - 1])
                    if held >= BLOCK * BLOCKS:
                        yield close()
                        ids, names, counts, held, number = [], [], [], 0, number + 1
        if counts:
            yield close()

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", "text", order[1].alias("h"), order[2].alias("row")).repartitionByRange(order[0], "h", "row").sortWithinPartitions(order[0], "h", "row")
    made = rows.select("id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "path string, part int, number int, n_docs long, n_ids long, n_bytes long")
    return written(made, "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """files of write_token_files() plus start long: the ids in all files before. Sums by part, then over parts."""
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead.orderBy("part")), F.lit(0)))
    inner = F.coalesce(F.sum("n_ids").over(ahead.partitionBy("part").orderBy("number")), F.lit(0))
    return files.withColumn("inner", inner).join(parts.select("part", "before"), "part").select(*files.columns, (F.col("before") + F.col("inner")).alias("start"))


def read_token_files(files: DataFrame, id_type: str, digest: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, start long, n_tokens long, ids binary) of every document in files (path, start), from the files alone.

    start counts the ids of all documents before; ids are unsigned little-endian 32-bit numbers, or with digest their
    CRC-32 as ids_crc32 long. A damaged file is an error. No files give an empty table.
    """
    last = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, p = store(uri)
                with fs.open_input_stream(p) as f:
                    docs, ids = read_file(f.read())
                counts = docs.column("n_tokens").to_numpy()
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                for at in range(0, len(counts), 2000):
                    ours = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends[at : at + 2000].tolist(), counts[at : at + 2000].tolist())]
                    value = pa.array([zlib.crc32(x) if digest else bytes(x) for x in ours], last.type)
                    n = pa.array(counts[at : at + 2000], pa.int64())
                    first = pa.array(start + ends[at : at + 2000] - counts[at : at + 2000], pa.int64())
                    yield pa.RecordBatch.from_arrays([docs.column("id").slice(at, 2000).combine_chunks(), first, n, value], names=["id", "start", "n_tokens", last.name])

    n = max(1, min(files.count(), 20_000))
    out = files.select("path", "start").repartition(n).mapInArrow(run, f"id {id_type}, start long, n_tokens long, {last.name} {'long' if digest else 'binary'}")
    return out.withColumnRenamed("id", id_col)


def token_round_trip(docs: DataFrame, path: str, digest: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files of docs' ids written into the shared folder, and read back; see write_token_files() and read_token_files()."""
    files = write_token_files(docs, fresh_path(docs.sparkSession, "ids"), path, id_col=id_col, text_col=text_col)
    return read_token_files(with_starts(files), docs.schema[id_col].dataType.simpleString(), digest, id_col)
