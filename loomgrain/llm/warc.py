"""Web archives in ZIP packages: written by tasks, found by their directories, read by range.

A package is a ZIP whose members are stored, not compressed: archive/*.warc.gz (each record its own gzip member) and
indexes/index.cdxj (a line for each record: offset, length and digest). The reader walks the end-of-directory record, its
ZIP64 form, the central directory and the local headers, reads the index, and fetches records by range; members are
never unpacked as a whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm.common import fresh_path, hot_keys, key_filter, spread_join, written

#: Fixed values of the ZIP format: signatures.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records fetched by one range read, at most so many bytes (or one record).
RANGE_BYTES = 4 << 20
#: A package is closed once its archive has so many bytes.
PACKAGE_BYTES = 32 << 20


def store(uri: str):
    """(file system, path) of a URI in any store that pyarrow knows; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# ---------------------------------------------------------------- ZIP


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int  # where its local header starts
    crc: int


def zip_members(f, size: int) -> list[Member]:
    """The members that the central directory names; f has seek and read, size is the file's."""
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = _range(f, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end-of-directory record: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = _range(f, tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("the ZIP64 locator is missing")
        end = _range(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != END64:
            raise ValueError("the ZIP64 end-of-directory record is missing")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, at, found = _range(f, start, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", directory, at + 16)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        full, packed, header = _wide(extra, full, packed, header)
        found.append(Member(name, method, full, packed, header, crc))
        at += 46 + n_name + n_extra + n_comment
    return found


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values with those that are all ones taken from the ZIP64 extra field, where they stand in this order."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = extra[at + 4 : at + 4 + n]
        at += 4 + n
    out, at = [], 0
    for v in values:
        if v == 0xFFFFFFFF and at + 8 <= len(wide):
            v = struct.unpack_from("<Q", wide, at)[0]
            at += 8
        out.append(v)
    return out


def member_start(f, m: Member) -> int:
    """Where a member's data starts: after its local header, whose name and extra may differ from the directory's."""
    head = _range(f, m.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{m.name} has no local header")
    return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def _range(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise ValueError("the file ends too early")
    return data


class ZipWriter:
    """Appends stored members to a stream; sizes and places go to ZIP64 fields where they need to, or always."""

    def __init__(self, out, always64: bool = False):
        self.out, self.at, self.entries, self.always = out, 0, [], always64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, size: int, crc: int, chunks: Iterator[bytes]) -> None:
        raw, header = name.encode(), self.at
        wide = self.always or size >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = 0xFFFFFFFF if wide else size
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            self._put(c)
        self.entries.append((raw, size, crc, header))

    def close(self, comment: bytes = b"") -> None:
        start = self.at
        for raw, size, crc, header in self.entries:
            wide_size, wide_at = self.always or size >= 0xFFFFFFFF, self.always or header >= 0xFFFFFFFF
            body = (struct.pack("<QQ", size, size) if wide_size else b"") + (struct.pack("<Q", header) if wide_at else b"")
            extra = struct.pack("<HH", 1, len(body)) + body if body else b""
            shown, place = (0xFFFFFFFF if wide_size else size), (0xFFFFFFFF if wide_at else header)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        n, length = len(self.entries), self.at - start
        if self.always or n >= 0xFFFF or length >= 0xFFFFFFFF or start >= 0xFFFFFFFF:
            end = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
            n, length, start = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._put(END + struct.pack("<HHHHIIH", 0, 0, n, n, length, start, len(comment)) + comment)


# ---------------------------------------------------------------- WARC


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit (no payload) has the HTTP head of what it stands for, of `size` bytes, and no body."""
    response = payload is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if not response:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes | None  # None where the record has none of its own (revisits)


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(lines[1:])
    block = rest[: int(headers["content-length"])]
    http_head, _, body = block.partition(b"\r\n\r\n")
    http = _fields(http_head.decode("latin-1").split("\r\n")[1:])
    return Record(headers, http, body if headers["warc-type"] != "revisit" else None)


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


# ---------------------------------------------------------------- jobs


def with_revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, payload binary, size long, sha string, refers_to long) for every row of pages.

    Of equal payloads of at least `least` bytes the smallest page_id is the response and the rest refer to it, without a
    payload of their own. Null html is an empty payload. Rows that repeat the smallest page_id are responses too; null ids
    come last and are revisits unless all ids of the group are null. Other columns are ignored, an empty table gives an
    empty table. Groups are found by digests and ids alone; of the payloads only those that may repeat are shuffled, a
    frequent one over many tasks.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha"))
    groups = rows.filter(F.col("size") >= least).groupBy(F.col("sha").alias("s")).agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    groups = written(groups.withColumn("h", F.xxhash64("s")), "digests")
    repeats = key_filter(groups, "h")(F.xxhash64("sha"))
    alone = rows.filter(~repeats).withColumn("refers_to", F.lit(None).cast("long"))
    both = spread_join(rows.filter(repeats), groups.select("s", "first"), ("sha", "s"), hot_keys(groups, "s", pages.count()), "left")
    both = both.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    both = both.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    return alone.unionByName(both.select(*alone.columns))


def write_packages(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write rows of with_revisits() as packages in `folder`; (path, n_records, n_bytes) of each, a written table.

    A task closes a package at PACKAGE_BYTES (or one record), so that is what it holds in memory. A package appears under
    its final name only when complete, and the returned table is written, so a lost executor's work is done again without
    a trace. Null ids and urls are left out of the records; repeated rows are records each; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, lines, crc, at = [], [], 0, 0

        def close() -> pa.RecordBatch:
            fs, base = store(folder)
            fs.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{base}/{name}.part") as out:
                z = ZipWriter(out)
                z.add(ARCHIVE, at, crc, iter(body))
                index = "\n".join(lines).encode()
                z.add(INDEX, len(index), zlib.crc32(index), iter([index]))
                z.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}.wacz")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.wacz"]), pa.array([len(lines)], pa.int64()), pa.array([z.at], pa.int64())], names=["path", "n_records", "n_bytes"])

        for b in batches:
            for r in b.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                raw = warc_record(r["page_id"], r["url"], r["payload"], r["size"], digest, r["refers_to"])
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = squeeze.compress(raw) + squeeze.flush()
                lines.append(json.dumps({"url": r["url"], "digest": f"sha1:{digest}", "filename": ARCHIVE.rsplit("/", 1)[1], "offset": at, "length": len(packed)}))
                body.append(packed)
                crc = zlib.crc32(packed, crc)
                at += len(packed)
                if at >= PACKAGE_BYTES:
                    yield close()
                    body, lines, crc, at = [], [], 0, 0
        if body:
            yield close()

    return written(records.mapInArrow(run, "path string, n_records long, n_bytes long"), "packages")


def package_index(packages: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, start long, length long, offsets array, lengths array): ranges of whole records, from each package's index.

    Indexes are CDXJ lines, plain or compressed (.gz); they name an archive by its member's full name or by what follows
    archive/. A null path gives no row, an equal path its rows again; archives whose member is compressed can't be read by
    range and are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                if path is None:
                    continue
                fs, p = store(path)
                size = fs.get_file_info(p).size
                with fs.open_input_file(p) as f:
                    members = {m.name: m for m in zip_members(f, size)}
                    starts = {}
                    for m in members.values():
                        if m.name.startswith("indexes/") and m.name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
                            raw = _range(f, member_start(f, m), m.packed)
                            raw = raw if m.method == 0 else zlib.decompress(raw, -15)
                            raw = gzip.decompress(raw) if m.name.endswith(".gz") else raw
                            out += _ranges(path, raw, members, starts, f)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["path", "start", "length", "offsets", "lengths"])

    return packages.select(F.col(path_col).alias("path")).mapInArrow(run, "path string, start long, length long, offsets array<long>, lengths array<long>")


def _ranges(path: str, index: bytes, members: dict[str, Member], starts: dict[str, int], f) -> list[tuple]:
    out, now = [], None
    for line in index.decode().splitlines():
        if not line.strip() or line.startswith("!"):  # a head line of the index
            continue
        e = json.loads(line[line.index("{") :])
        m = members.get(e["filename"]) or members["archive/" + e["filename"]]
        if m.method != 0:
            raise ValueError(f"{m.name} in {path} isn't stored")
        if m.name not in starts:
            starts[m.name] = member_start(f, m)
        at, n = starts[m.name] + int(e["offset"]), int(e["length"])
        if now is None or at != now[1] + now[2] or now[2] + n > RANGE_BYTES:
            now = [path, at, 0, [], []]
            out.append(now)
        now[3].append(at - now[1])
        now[4].append(n)
        now[2] += n
    return [tuple(x) for x in out]


def read_records(ranges: DataFrame) -> DataFrame:
    """(record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary).

    One row for each record of the ranges; ids are the URIs of the records' headers, null where there is none. A response's
    length and digest (bare upper-case base32 SHA-1) are those of the payload read; a revisit's are the ones its headers
    give for the payload it stands for, and its payload is null. A payload that doesn't match the digest in its headers is
    an error; digests are checked by the algorithm they name, where hashlib has it.
    """
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def row(data: bytes) -> tuple:
        r = parse_record(data)
        h = r.headers
        kind, _, said = h.get("warc-payload-digest", "").partition(":")
        if r.payload is None:
            length = r.http.get("content-length")
            size, digest = None if length is None else int(length), said if kind == "sha1" else None
        else:
            size, digest = len(r.payload), bare_digest(r.payload)
            if kind.replace("-", "") in hashlib.algorithms_guaranteed and said:
                own = hashlib.new(kind.replace("-", ""), r.payload).digest()
                if said.rstrip("=").upper() not in (base64.b32encode(own).decode().rstrip("="), own.hex().upper()):
                    raise ValueError(f"the payload of {h.get('warc-record-id')} isn't what was written")
        return h.get("warc-record-id"), h.get("warc-target-uri"), h["warc-type"], h.get("warc-refers-to"), size, digest, r.payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                fs, p = store(x["path"])
                with fs.open_input_file(p) as f:
                    data = _range(f, x["start"], x["length"])
                rows = [row(zlib.decompress(data[o : o + n], 31)) for o, n in zip(x["offsets"], x["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    names = ", ".join(f"{f.name} {t}" for f, t in zip(schema, ("string", "string", "string", "string", "long", "string", "binary"), strict=True))
    return ranges.mapInArrow(run, names)


def archive_and_read(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write every page to packages in the shared folder and read all records back.

    read_records() with page_id and refers_to as longs, from ids <urn:page:N>, in place of record_id and refers_to. For
    nulls, repeated rows, other columns and empty tables see with_revisits().
    """
    packages = write_packages(with_revisits(pages, least), fresh_path(spark, "warc"))
    ranges = package_index(packages.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as long)")
    return read_records(ranges).select(number("record_id").alias("page_id"), "url", "record_type", number("refers_to").alias("refers_to"), "payload_bytes", "payload_digest", "payload")
