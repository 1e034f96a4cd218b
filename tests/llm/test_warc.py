import base64
import gzip
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import warc

SCHEMA = "page_id long, html string, url string, payload string, digest int, first string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "u", "p", 1, "f") for r in rows], SCHEMA)


BIG, OTHER = "é" * 600, "b" * 2000
ROWS = [(1, BIG), (2, "small"), (3, "small"), (4, BIG), (5, None), (6, ""), (7, OTHER), (8, OTHER), (9, OTHER), (9, OTHER), (None, OTHER), (None, "x"), (10, "c" * 999), (11, "c" * 999), (12, "d" * 1000), (13, "d" * 1000)]


def test_round_trip(spark):
    found = warc.round_trip(pages(spark, ROWS)).collect()
    want = []
    for i, html in ROWS:
        data = (html or "").encode()
        same = [j for j, h in ROWS if (h or "").encode() == data and j is not None]
        first = max(same) if len([1 for _, h in ROWS if (h or "").encode() == data]) > 1 and len(data) >= 1000 and same else None
        revisit = first is not None and i != first
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_payloads_come_back_from_small_packages(spark):
    folder = warc.archive_folder(spark)
    manifest = warc.write(pages(spark, ROWS), folder, "page_id", "html", roll=300, limit=200)  # several packages, ZIP64 records
    assert manifest.count() > 1
    back = warc.read(manifest, span=600).where("record_type = 'response'").collect()
    html = dict(ROWS[:-6])
    assert all(bytes(r.payload).decode() == (html[r.id] or "") for r in back if r.id is not None and r.id < 9)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def package(limit, members):
    out = io.BytesIO()
    z = warc.StoredZip(out, limit)
    for name, data in members.items():
        z.add(name, [data[:3], data[3:]])
    z.close()
    return out.getvalue()


@pytest.mark.parametrize("limit", [warc.BIG, 10, 1])
def test_directory_of_plain_and_zip64_files(limit):
    members = {"a/é.txt": b"hello world", "b": b"", "c": b"x" * 1000}
    data = package(limit, members)
    found = warc.directory(lambda at, n: data[at : at + n], len(data))
    assert {k: data[a : a + n] for k, (a, n) in found.items()} == members
    if limit > 10:
        import zipfile

        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert {i.filename: z.read(i) for i in z.infolist()} == members and z.testzip() is None


def test_zip64_files_of_others_are_read():
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"data of a zip64 member")
        z.writestr("plain", "text")
        z.comment = b"a comment PK\5"
    data = out.getvalue()
    found = warc.directory(lambda at, n: data[at : at + n], len(data))
    assert {k: data[a : a + n] for k, (a, n) in found.items()} == {"big": b"data of a zip64 member", "plain": b"text"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", "text" * 100)
        z.writestr(zipfile.ZipInfo("stored"), "as it is", zipfile.ZIP_STORED)
    data = out.getvalue()
    found = warc.directory(lambda at, n: data[at : at + n], len(data))
    assert list(found) == ["stored"]
    for name in ("packed", "absent"):
        with pytest.raises(ValueError):
            found[name]
    with pytest.raises(ValueError):
        warc.directory(lambda at, n: b"no zip at all"[at : at + n], 13)


def foreign_record(kind, url, block, extra="", http=True):
    digest = base64.b32encode(hashlib.sha1(block.partition(b"\r\n\r\n")[2] if http else block).digest()).decode()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{url[-1]}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{extra}Content-Type: {'application/http; msgtype=response' if http else 'text/plain'}\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n")


def test_packages_of_others_are_read_by_their_indexes(spark, tmp_path):
    """Compressed page lists, several archives, a gzipped and a plain index, records out of order, revisits, no private header."""
    import zipfile

    body = [b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello", b"HTTP/1.1 200 OK\r\nX: y\r\n z\r\n\r\nno length", b"just a note"]
    one = [foreign_record("response", "http://a.example/1", body[0]), foreign_record("response", "http://a.example/2", body[1])]
    two = [foreign_record("warcinfo", "x", b"software: none", http=False), foreign_record("resource", "http://a.example/3", body[2], http=False), foreign_record("revisit", "http://a.example/4", body[0][:-5], "WARC-Refers-To: <urn:uuid:1>\r\n")]
    line = lambda u, name, parts, k: f'{warc.search_key(u)} 20200101000000 {{"url": "{u}", "filename": "{name}", "offset": "{sum(map(len, parts[:k]))}", "length": {len(parts[k])}}}'
    first = "\n".join(['!meta {"format": "cdxj"}', line("http://a.example/2", "one.warc.gz", one, 1), line("http://a.example/1", "one.warc.gz", one, 0)])
    second = f" CDX N b a m s k r M S V g\nexample,a)/3 20200101000000 http://a.example/3 text/plain 200 X - - {len(two[1])} {len(two[0])} two.warc.gz\nexample,a)/4 20200101000000 http://a.example/4 warc/revisit 200 X - - {len(two[2])} {len(two[0]) + len(two[1])} two.warc.gz"
    with zipfile.ZipFile(tmp_path / "a.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo("pages/pages.jsonl"), "{}" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("archive/one.warc.gz", b"".join(one))
        z.writestr("archive/two.warc.gz", b"".join(two))
        z.writestr("indexes/index.cdx.gz", gzip.compress(first.encode()))
        z.writestr("indexes/other.cdx", second)
        z.writestr("datapackage.json", "{}")
    found = {r.url: r for r in warc.read(spark.createDataFrame([(str(tmp_path / "a.wacz"),)], "path string")).collect()}
    assert {u: (r.record_type, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for u, r in found.items()} == {
        "http://a.example/1": ("response", 5, b"hello"), "http://a.example/2": ("response", 9, b"no length"), "http://a.example/3": ("resource", 11, b"just a note"), "http://a.example/4": ("revisit", 5, None),
    }
    assert found["http://a.example/1"].payload_digest == hashlib.sha1(b"hello").hexdigest() and found["http://a.example/1"].id is None


def test_packages_without_an_index_and_chunked_bodies(spark, tmp_path):
    """Gzip members and plain records are found by going through; chunks are taken out, whichever form the digest is of."""
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=y\r\nhello\r\n4\r\n you\r\n0\r\n\r\n"
    over_content = gzip.decompress(foreign_record("response", "http://a.example/2", chunked)).decode()
    own = base64.b32encode(hashlib.sha1(b"hello you").digest()).decode()
    over_content = gzip.compress(re.sub("sha1:[A-Z2-7]+", f"sha1:{own}", over_content).encode())
    bare = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nchunks were taken out"
    noise = random.Random(1).randbytes(300_000)
    packed = [foreign_record("response", "http://a.example/1", chunked), over_content, foreign_record("response", "http://a.example/3", bare), foreign_record("resource", "http://a.example/4", noise, http=False), foreign_record("resource", "http://a.example/5", b"", http=False)]
    plain = [gzip.decompress(foreign_record("resource", f"http://b.example/{k}", bytes([65 + k]) * (k * 3000), http=False)) for k in range(4)]
    data = package(warc.BIG, {"archive/a.warc.gz": b"".join(packed), "archive/b.warc": b"".join(plain), "logs/x": b"no archive"})
    (tmp_path / "a.wacz").write_bytes(data)
    manifest = spark.createDataFrame([(str(tmp_path / "a.wacz"),)], "path string")
    for span in (100, 5000, 1 << 20):
        got = {r.url: bytes(r.payload) for r in warc.read(manifest, span=span).collect()}
        want = {"http://a.example/1": b"hello you", "http://a.example/2": b"hello you", "http://a.example/3": b"chunks were taken out", "http://a.example/4": noise, "http://a.example/5": b""}
        assert got == want | {f"http://b.example/{k}": bytes([65 + k]) * (k * 3000) for k in range(4)}
    # an index that names one record: the others of that member come only if asked for
    line = f'k 2020 {{"filename": "a.warc.gz", "offset": 0, "length": {len(packed[0])}}}'.encode()
    (tmp_path / "a.wacz").write_bytes(package(warc.BIG, {"archive/a.warc.gz": b"".join(packed), warc.INDEX: line}))
    assert (warc.read(manifest).count(), warc.read(manifest, unnamed=True).count()) == (1, 5)
    (tmp_path / "a.wacz").write_bytes(package(warc.BIG, {"archive/a.warc.gz": b"".join(packed)[:-3]}))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(manifest).collect()


def test_damaged_payloads_are_refused(spark, tmp_path):
    record = foreign_record("response", "http://a.example/1", b"HTTP/1.1 200 OK\r\n\r\nhello")
    record = gzip.compress(gzip.decompress(record).replace(b"hello", b"jello"))
    data = package(warc.BIG, {warc.DATA: record, warc.INDEX: f'k 2020 {{"filename": "data.warc.gz", "offset": 0, "length": {len(record)}}}'.encode()})
    (tmp_path / "a.wacz").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark.createDataFrame([(str(tmp_path / "a.wacz"),)], "path string")).collect()


def test_own_records_have_what_the_format_asks_for(spark):
    folder = warc.archive_folder(spark)
    (m,) = warc.write(pages(spark, ROWS).coalesce(1), folder, "page_id", "html", F.col("url"), "2024-02-03T04:05:06Z").collect()
    store, path = warc.filesystem(m.path)
    with store.open_input_file(path) as f:
        data = f.read()
    members = warc.directory(lambda at, n: data[at : at + n], len(data))
    at, n = members[warc.INDEX]
    lines = data[at : at + n].splitlines()
    assert len(lines) == len(ROWS) == m.records and lines == sorted(lines) and all(x.startswith(b"u 20240203040506 {") for x in lines)
    ids = set()
    for _, offset, length in map(warc.entries, lines):
        headers, block = warc.parse_record(data[members[warc.DATA][0] + offset :][:length])
        assert {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-target-uri"} <= set(headers) and block.startswith(b"HTTP/1.1 200 OK\r\n")
        ids.add(headers["warc-record-id"])
    assert len(ids) == len(ROWS) - 1  # of two rows of page 9 one name; rows without an id have names of their own
