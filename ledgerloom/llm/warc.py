"""WARC archives inside ZIP packages: writing, and reading records by byte ranges without extraction.

A package holds two stored (not compressed) members: archive/data.warc.gz, one gzip member a record,
and indexes/index.cdxj, a line a record with its key, time and place. The reader takes the end of a file,
parses the (ZIP64) end record and the central directory, finds where the stored archive and index members
begin, and then reads only the ranges that the indexes name, in packages of its own and of others. Packages
are written by tasks into the shared folder under names that an attempt never shares, and a manifest table
says which of them count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialized, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
BIG = 0xFFFFFFFF


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a uri, or of a local path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class StoredZip:
    """Writes a ZIP of stored members to a stream; sizes and offsets from limit on take ZIP64 records."""

    def __init__(self, out, limit: int = BIG):
        self.out, self.limit, self.at, self.members = out, limit, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, pieces: list[bytes]) -> None:
        size, crc = sum(map(len, pieces)), 0
        for p in pieces:
            crc = zlib.crc32(p, crc)
        start, long = self.at, size >= self.limit
        extra = struct.pack("<HHQQ", 1, 16, size, size) if long else b""
        shown = BIG if long else size
        self._write(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, shown, shown, len(name.encode()), len(extra)) + name.encode() + extra)
        for p in pieces:
            self._write(p)
        self.members.append((name, start, size, crc))

    def close(self) -> None:
        start = self.at
        for name, offset, size, crc in self.members:
            wide = [x for x in (size, size, offset) if x >= self.limit]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            shown = [BIG if x >= self.limit else x for x in (size, offset)]
            self._write(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, shown[0], shown[0], len(name.encode()), len(extra), 0, 0, 0, 0, shown[1]) + name.encode() + extra)
        size, n = self.at - start, len(self.members)
        if start >= self.limit or size >= self.limit:
            end = self.at
            self._write(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._write(_LOCATOR + struct.pack("<IQI", 0, end, 1))
            start, size = BIG, BIG
        self._write(_END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


class Members(dict):
    """Stored members by name: (offset of the data, size). Asking for one that is not stored plainly raises ValueError."""

    packed: frozenset = frozenset()

    def __missing__(self, name: str):
        raise ValueError(f"{name} is not stored plainly" if name in self.packed else f"no member {name}")


def directory(read, length: int, wanted=lambda name: True) -> Members:
    """The stored members that are wanted; read(offset, size) gives bytes of the file.

    Raises ValueError if the file is no ZIP; members that are compressed or encrypted can't be asked for.
    """
    tail_at = max(0, length - 65557)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end of central directory")
    n, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if BIG in (size, start) or n == 0xFFFF:
        place = tail_at + at - 20
        locator = read(place, 20) if place >= 0 else b""
        if locator[:4] == _LOCATOR:
            end64 = read(struct.unpack("<Q", locator[8:16])[0], 56)
            if end64[:4] != _END64:
                raise ValueError("no ZIP64 end record where its locator points")
            n, size, start = struct.unpack("<QQQ", end64[32:56])
    central, found, packed_names, at = read(start, size), Members(), set(), 0
    for _ in range(n):
        if central[at : at + 4] != _CENTRAL:
            raise ValueError("a central directory entry is damaged")
        flags, method, _, _, _, packed, plain, name_len, extra_len, note_len = struct.unpack("<HHHHIIIHHH", central[at + 8 : at + 34])
        offset = struct.unpack("<I", central[at + 42 : at + 46])[0]
        name = central[at + 46 : at + 46 + name_len].decode("utf-8")
        extra, e = central[at + 46 + name_len : at + 46 + name_len + extra_len], 0
        while e + 4 <= len(extra):
            kind, m = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:
                wide = list(struct.unpack(f"<{m // 8}Q", extra[e + 4 : e + 4 + m // 8 * 8]))
                plain = wide.pop(0) if plain == BIG else plain
                packed = wide.pop(0) if packed == BIG else packed
                offset = wide.pop(0) if offset == BIG else offset
            e += 4 + m
        if method or flags & 1 or packed != plain:
            packed_names.add(name)
        elif wanted(name):
            found[name] = (offset, plain)
        at += 46 + name_len + extra_len + note_len
    for name, (offset, plain) in found.items():  # the local header's own name and extra field stand before the data
        head = read(offset, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"{name} has no local header")
        a, b = struct.unpack("<HH", head[26:30])
        found[name] = (offset + 30 + a + b, plain)
    found.packed = frozenset(packed_names)
    return found


def record_bytes(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    out = zlib.compressobj(1, zlib.DEFLATED, 31)
    return out.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n") + out.flush()


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the headers by lower-case name; lines that begin with white space go on."""
    first, *lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines() or [""]
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record, in a gzip member or plain."""
    plain = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, headers = _fields(head)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    n = int(headers["content-length"])
    if len(rest) < n or rest[n:].strip(b"\r\n"):
        raise ValueError("a WARC record's length is wrong")
    return headers, rest[:n]


def unchunked(body: bytes) -> bytes | None:
    """The content of a body sent in chunks; None if it isn't made of chunks, as where they were taken out before."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,16}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, int | None]:
    """(payload, its length as the HTTP head tells): what follows the HTTP head, where the block has one, without the sizes of its chunks."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, None
    head, _, body = block.partition(b"\r\n\r\n")
    http = _fields(head)[1]
    if http.get("transfer-encoding", "").lower().endswith("chunked") and (whole := unchunked(body)) is not None:
        return whole, None
    told = http.get("content-length", "")
    return body, int(told) if told.isdigit() else None


def record_places(read, start: int, size: int, span: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of an archive member at `start`, found by going through it; read(offset, size) gives bytes.

    Records are gzip members of their own, or plain. No more than about `span` bytes are held.
    """
    held = (0, b"")

    def get(at: int, n: int) -> bytes:
        nonlocal held
        n = max(0, min(n, size - at))
        if not held[0] <= at <= at + n <= held[0] + len(held[1]):
            held = (at, read(start + at, min(max(n, span), size - at)))
        return held[1][at - held[0] : at - held[0] + n]

    at = 0
    while at < size:
        if get(at, 2) == b"\x1f\x8b":
            out, end, left = zlib.decompressobj(31), at, b""
            while not out.eof:
                left = get(end, 1 << 14)
                end += len(left)
                if not left:
                    raise ValueError("an archive member ends within a record")
                more = True
                while more and not out.eof:
                    more = len(out.decompress(left, 1 << 20)) == 1 << 20 or bool(out.unconsumed_tail)
                    left = out.unconsumed_tail
            end -= len(out.unused_data)
        else:
            head = get(at, 1 << 12)
            while (cut := head.find(b"\r\n\r\n")) < 0 and len(head) < min(size - at, span):
                head = get(at, 2 * len(head))
            version, headers = _fields(head[: max(cut, 0)])
            if not version.startswith("WARC/") or not headers.get("content-length", "").isdigit():
                raise ValueError("no record where one should begin")
            end = at + cut + 4 + int(headers["content-length"])
            if end > size:
                raise ValueError("an archive member ends within a record")
            end += len(m[0]) if (m := re.match(rb"[\r\n]+", get(end, 64))) else 0
        yield at, end - at
        at = end


def hex_digest(told: str | None) -> str | None:
    """A SHA-1 digest header, in hexadecimal or base 32, as bare lower-case hexadecimal; None for others."""
    name, _, value = (told or "").partition(":")
    if name.lower() != "sha1" or len(value) not in (32, 40):
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def search_key(url: str) -> str:
    """A url with its host's parts turned around, as indexes are sorted: com,example)/path."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)(.*)", url, re.S)
    if not m:
        return re.sub(r"\s", "%20", url)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + re.sub(r"\s", "%20", m[2] or "/")


def write(pages: DataFrame, folder: str, id_col: str, payload_col: str, url: Column | None = None, date: str = "1970-01-01T00:00:00Z", dedup_from: int = 1000, roll: int = 64 << 20, limit: int = BIG) -> DataFrame:
    """Writes a record for each row of pages into packages of about `roll` bytes; returns the manifest (path, records, bytes).

    Of rows whose payloads are equal and at least dedup_from bytes long, those with the largest id are
    responses and the others revisits of that id; all else are responses. Payloads are UTF-8 (null: empty).
    Records hold the url (urn:record: and the id without one), the date and an HTTP head; rows without
    an id have record ids of their own.
    """
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")) if dict(pages.dtypes)[payload_col] == "string" else F.coalesce(F.col(payload_col), F.lit(b""))
    uri = F.concat(F.lit("urn:record:"), F.coalesce(F.col(id_col).cast("string"), F.lit("none")))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload"), (uri if url is None else F.coalesce(url, uri)).alias("url")).withColumn("digest", F.sha1("payload"))
    long = F.length("payload") >= dedup_from
    first = materialized(rows.where(long).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("key"), "first"))
    # short payloads, however many are alike, get keys that spread them
    known = rows.withColumn("key", F.when(long, F.col("digest")).otherwise(F.xxhash64("id", "url").cast("string"))).join(first, "key", "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        held: list[bytes] = []
        index: list[str] = []
        size, done = 0, []

        def flush() -> None:
            nonlocal held, index, size
            name = f"part-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{path}/{name}") as out:
                package = StoredZip(out, limit)
                package.add(DATA, held)
                package.add(INDEX, [("\n".join(sorted(index)) + "\n").encode("utf-8", "surrogatepass")])
                package.close()
            done.append((f"{folder}/{name}", len(held), size))
            held, index, size = [], [], 0

        for b in batches:
            for i, data, uri, digest, to in zip(*(b.column(c).to_pylist() for c in ("id", "payload", "url", "digest", "first"))):
                revisit = to is not None and i != to
                name = f"<urn:record:{i}>" if i is not None else f"<urn:uuid:{uuid.uuid4()}>"
                headers = [("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"\s", "%20", uri)), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")]
                if revisit:
                    headers += [("WARC-Refers-To", f"<urn:record:{to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                record = record_bytes("revisit" if revisit else "response", [*headers, ("Content-Type", "application/http; msgtype=response")], head if revisit else head + data)
                index.append(f"{search_key(uri)} {re.sub('[^0-9]', '', date)} " + json.dumps({"url": uri, "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(record)), "offset": str(size), "filename": DATA.split("/")[1]}))
                held.append(record)
                size += len(record)
                if size >= roll:
                    flush()
        if held:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return materialized(known.mapInArrow(run, "path string, records long, bytes long"))


def entries(line: bytes) -> tuple[str, int, int] | None:
    """(file name, offset, length) of an index line: JSON after key and time, or the columns of a CDX line; None for others."""
    text = line.decode("utf-8", "replace").strip()
    if "{" in text:
        told = json.loads(text[text.index("{") :])
        return (told["filename"], int(told["offset"]), int(told["length"])) if {"filename", "offset", "length"} <= set(told) else None
    parts = text.split(" ")
    return (parts[10], int(parts[9]), int(parts[8])) if len(parts) == 11 and parts[9].isdigit() and parts[8].isdigit() else None


def is_archive(name: str) -> bool:
    return name.startswith("archive/") and re.search(r"\.warc(\.gz)?$", name) is not None


def is_index(name: str) -> bool:
    return name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", name) is not None


def read(manifest: DataFrame, span: int = 1 << 20, task_bytes: int = 4 << 20, unnamed: bool = False) -> DataFrame:
    """(id, record_id, url, date, record_type, payload_bytes, payload_digest, refers_to, payload) of every record that the packages' indexes name.

    Archive members that no index names (archive/*.warc, .warc.gz), as in packages without one, are gone through for their records, each in
    one task and in bounded memory; with `unnamed` so are those of which the indexes leave something out.
    Bodies sent in chunks come without their chunks' sizes; a digest header may be over either form.

    manifest: (path) and, where they are known, bytes. Packages are first opened for their directory and
    indexes only; tasks then read stretches of about `span` bytes of neighbouring records, each in one range
    read. id and refers_to are numbers of records that write() made, else null. Payloads of responses are
    checked against their digest and length; a record's own digest header is taken for revisits, which
    have no payload (their length is what the HTTP head tells). Compressed members of the package that are no archives
    are left alone; a compressed archive or index is an error.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("path").to_pylist():
                store, path = filesystem(uri)
                with store.open_input_file(path) as file:
                    get = lambda at, n: file.read_at(n, at)
                    members = directory(get, file.size(), lambda name: name.startswith(("archive/", "indexes/")))
                    for name in members.packed:
                        if is_index(name) or is_archive(name):
                            raise ValueError(f"{name} is not stored plainly")
                    named = set()
                    for name in filter(is_index, list(members)):
                        data = get(*members[name])
                        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                        named |= {e for e in map(entries, data.splitlines()) if e}
                    named = {(name if name.startswith("archive/") else f"archive/{name}", offset, length) for name, offset, length in named}
                    told: dict[str, int] = {}
                    for name, _, length in named:
                        told[name] = told.get(name, 0) + length
                    for name in filter(is_archive, list(members)):
                        at, size = members[name]
                        if name not in told or unnamed and told[name] != size:
                            named |= {(name, *place) for place in record_places(get, at, size, span)}
                rows, held = [], []
                for name, offset, length in sorted(named):
                    at = members[name][0] + offset
                    if held and (at != held[0] + sum(held[1]) or sum(held[1]) >= span):
                        rows.append((uri, *held))
                        held = []
                    held = held or [at, []]
                    held[1].append(length)
                if held:
                    rows.append((uri, *held))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["path", "at", "lengths"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:record:(-?\d+)>", x or "")) else None
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["id", "record_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for b in batches:
            for uri, at, lengths in zip(*(b.column(c).to_pylist() for c in ("path", "at", "lengths"))):
                store, path = filesystem(uri)
                with store.open_input_file(path) as file:
                    data, rows, start = file.read_at(sum(lengths), at), [], 0
                for n in lengths:
                    h, block = parse_record(data[start : start + n])
                    start += n
                    kind, (payload, told), digest = h["warc-type"], payload_of(h, block), hex_digest(h.get("warc-payload-digest"))
                    if kind == "revisit":
                        payload, size = None, told
                    else:
                        own, size = hashlib.sha1(payload).hexdigest(), len(payload)
                        sent = block.partition(b"\r\n\r\n")[2]
                        if digest not in (None, own) and not (len(sent) != size and digest == hashlib.sha1(sent).hexdigest()) or kind == "response" and told not in (None, size):
                            raise ValueError(f"a payload in {uri} is damaged")
                        digest = own
                    rows.append((number(h.get("warc-record-id")), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), kind, size, digest, number(h.get("warc-refers-to")), payload))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), types)], names=names)

    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first() if "bytes" in manifest.columns else (0, manifest.count())
    tasks = int(max(1, size[0] // task_bytes, min(size[1], 10_000)))
    places = manifest.select("path").repartition(max(1, min(int(size[1]), 10_000)), "path").mapInArrow(locate, "path string, at long, lengths array<long>")
    return places.repartition(tasks, "path", "at").mapInArrow(records, "id long, record_id string, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for packages under the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, path = filesystem(folder)
    store.create_dir(path)
    return folder


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", dedup_from: int = 1000, url_col: str = "url") -> DataFrame:
    """Writes pages to archives and reads them back: (id_col, payload_bytes, payload_digest, record_type, refers_to).

    Null payloads are empty. Rows with equal id and payload are all responses, or all revisits; rows
    with a null id are revisits of the largest id where their payload is shared, and where no id is
    known they are responses. Other columns are ignored (url_col, where there is one, goes into the records).
    """
    folder = archive_folder(pages.sparkSession)
    back = read(write(pages, folder, id_col, payload_col, F.col(url_col) if url_col in pages.columns else None, dedup_from=dedup_from))
    return back.select(F.col("id").cast(pages.schema[id_col].dataType).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(pages.schema[id_col].dataType).alias("refers_to"))
