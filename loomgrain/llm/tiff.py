"""TIFF pages as rows: walk image directories, decode strips and tiles, undo predictors.

Reads classic TIFF of either byte order: uncompressed, PackBits, LZW and deflate data in strips or tiles, predictor 1 or
2, 8- or 16-bit samples interleaved by pixel. The writer makes what the reader reads.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the TIFF 6.0 format: tags, field type sizes and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 266, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray = field(repr=False)  # height x width x samples


# ---------------------------------------------------------------- codecs


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and (end + 1 >= n or data[end] != data[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one entry early, 256 clears and 257 ends."""
    base = [bytes((b,)) for b in range(256)] + [b"", b""]
    table, width, last = list(base), 9, None
    out, acc, held = bytearray(), 0, 0
    for byte in data:
        acc = (acc << 8) | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if code > len(table) - (last is None) or len(table) > 4096:
            raise ValueError(f"LZW code {code} comes before its entry")
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, held = bytearray(), 0, 0
    codes = {bytes((b,)): b for b in range(256)}
    free, width, now = 258, 9, b""

    def put(code: int) -> None:
        nonlocal acc, held
        acc = (acc << width) | code
        held += width
        while held >= 8:
            held -= 8
            out.append((acc >> held) & 255)
        acc &= (1 << held) - 1

    put(256)
    for k in range(len(data)):
        longer = now + data[k : k + 1]
        if longer in codes:
            now = longer
            continue
        put(codes[now])
        codes[longer] = free
        free += 1
        if free == (1 << width) and width < 12:
            width += 1
        if free == 4095:
            put(256)
            codes = {bytes((b,)): b for b in range(256)}
            free, width = 258, 9
        now = data[k : k + 1]
    if now:
        put(codes[now])
        free += 1
        if free == (1 << width) and width < 12:
            width += 1
    put(257)
    if held:
        out.append((acc << (8 - held)) & 255)
    return bytes(out)


def _decode(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression} isn't read here")


def _encode(data: bytes, compression: int, level: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, level)}[compression](data)


# ---------------------------------------------------------------- reading


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF in the order of its directory chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the chain of directories has a loop")
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags, order)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        letter = {1: "B", 3: "H", 4: "I"}.get(kind)
        if letter is None:
            continue  # texts, fractions and private fields say nothing about the pixels
        where = entry + 8 if count * TYPE_SIZE[kind] <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (8, 16) or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise ValueError(f"{bits} bits, planar {one(PLANAR, 1)}, predictor {predictor} aren't read here")
    if one(FILL_ORDER, 1) != 1:
        raise ValueError("bits in reverse order aren't read here")
    kind = np.dtype("u1") if bits == 8 else np.dtype(order + "u2")
    # nothing is made before the directory's numbers agree with each other and with the file
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if min(width, height, w, h, samples) < 1 or -(-height // h) * -(-width // w) != len(offsets) or len(counts) != len(offsets):
        raise ValueError(f"{len(offsets)} blocks of {w} x {h} can't hold {width} x {height} pixels")
    most = {NONE: 1, PACKBITS: 64, LZW: 2600}.get(compression, 1100)  # bytes that one stored byte can give
    size = samples * bits // 8
    short = any(n * most < w * h * size for n in counts) if tiled else sum(counts) * most < width * height * size
    if short or any(off + n > len(data) for off, n in zip(offsets, counts, strict=True)):
        raise ValueError(f"{sum(counts)} stored bytes can't hold {width} x {height} pixels")
    if tiled:
        spots = [(y, x) for y in range(0, height, h) for x in range(0, width, w)]
    else:
        spots = [(y, 0) for y in range(0, height, h)]
    pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
    for (y, x), off, count in zip(spots, offsets, counts, strict=True):
        rows = h if TILE_OFFSETS in tags else min(h, height - y)
        block = np.frombuffer(_decode(data[off : off + count], compression), kind, rows * w * samples).reshape(rows, w, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=pixels.dtype)
        part = pixels[y : y + rows, x : x + w]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return Page(width, height, samples, bits, compression, predictor, pixels)


# ---------------------------------------------------------------- writing


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A TIFF of 8- or 16-bit arrays (height x width, or with samples last), in strips of `rows` rows or in tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for img in pages:
        img = img if img.ndim == 3 else img[:, :, None]
        height, width, samples = img.shape
        bits = img.dtype.itemsize * 8
        h, w = tile or (min(rows, height), width)
        offsets, counts = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = img[y : y + h, x : x + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                packed = _encode(part.astype(part.dtype.newbyteorder(order)).tobytes(), compression, level)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [bits] * samples, COMPRESSION: [compression], PHOTOMETRIC: [1 if samples < 3 else 2], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [w], TILE_HEIGHT: [h], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [h], STRIP_COUNTS: counts}
        out += b"\0" * (len(out) % 2)
        entries = b""
        for tag, values in sorted(tags.items()):
            kind, letter = (3, "H") if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else (4, "I")
            raw = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


# ---------------------------------------------------------------- on tables


def text_payload(text: str | None) -> tuple[int, bytes]:
    """(unpadded length, UTF-8 bytes with zeros up to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 1) -> DataFrame:
    """(id, n_bytes long, media binary): every whole text as a one-page grey TIFF, 64 samples wide.

    Null text counts as empty (one row of zeros). Null ids stay null, repeated rows give a row each, other columns are
    ignored, an empty table gives an empty table. Row-wise: no shuffle. Equal texts give equal media.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                made = [text_payload(t) for t in b.column(1).to_pylist()]
                media = [write_pages([np.frombuffer(p, "u1").reshape(-1, 64)], compression, predictor) for _, p in made]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def media_pages(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), pixels: bool = True) -> DataFrame:
    """One row per page of each TIFF: the kept columns, then the page and what its decoded samples are.

    Columns: page int, width int, height int, samples int, bits int, compression int, predictor int, n_bytes_decoded
    long, sha256 string, tail_crc32 long (CRC-32 of the last 64 bytes), feature string, error string, and pixels binary
    (row-major little-endian samples) if asked for. Null media gives no row. A file that can't be decoded gives one row
    whose error says why, the pages before the fault being kept. Repeated rows give pages each. Row-wise: no shuffle.
    """
    kept = [media.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["page int", "width int", "height int", "samples int", "bits int", "compression int", "predictor int", "n_bytes_decoded long", "sha256 string", "tail_crc32 long", "feature string", "error string"] + ["pixels binary"] * pixels)
    types = [pa.int32()] * 7 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * pixels
    names = [c.strip().split(" ")[0] for c in schema.split(", ")][len(kept) :]

    def rows(data: bytes) -> Iterator[tuple]:
        n = 0
        try:
            for p in read_pages(data):
                raw = p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes()
                yield (n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), page_feature(p.pixels), None, *[raw] * pixels)
                n += 1
        except (ValueError, KeyError, IndexError, MemoryError, OverflowError, struct.error, zlib.error) as e:
            yield (n, *[None] * 10, f"{type(e).__name__}: {e}", *[None] * pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                at, out = [], []
                for k, data in enumerate(b.column(b.num_columns - 1)):
                    if data.is_valid:
                        for row in rows(data.as_py()):
                            at.append(k)
                            out.append(row)
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at, pa.int64())) for k in range(len(kept))), *cols], names=[*keep, *names])

    return media.select(*keep, F.col(media_col).alias("__media")).mapInArrow(run, schema)


def page_feature(pixels: np.ndarray) -> str:
    """Mean, deviation and Shannon entropy (bits) of the samples, and the share of zero samples."""
    n = pixels.size
    if not n:
        return "empty"
    h = np.bincount(pixels.reshape(-1), minlength=256)
    level = np.arange(len(h))
    mean = float((h * level).sum() / n)
    dev = float(np.sqrt((h * (level - mean) ** 2).sum() / n))
    p = h[h > 0] / n
    return f"mean={mean:.4f};dev={dev:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};zero={h[0] / n:.4f}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as TIFF, read the stored bytes back, and describe both.

    (id, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string,
    feature string, error string); payload columns are of the samples read back. Nulls and ties as in store_texts().
    """
    stored = store_texts(docs, id_col, text_col).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = media_pages(stored, keep=(id_col, "n_bytes", "media_bytes", "media_sha256"), pixels=False)
    return pages.select(id_col, "n_bytes", F.col("n_bytes_decoded").alias("payload_bytes"), F.col("sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
