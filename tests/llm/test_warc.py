"""ZIP-packaged web archives: round trip, revisits, ZIP64 directories, range reads."""

import hashlib
import io
import json
import zipfile
import zlib

import pytest

from riskroll.llm import warc

LONG, SHORT = "<p>é same page</p>" * 80, "x" * 999
PAGES = ([(i, f"http://a/{i} b\n", LONG) for i in range(40)] + [(50 + i, None, SHORT) for i in range(3)]
         + [(60, "http://n", None), (61, "", ""), (None, "u", "y" * 1000), (None, "u", "y" * 1000), (62, "u", "z" * 1000),
            (62, "u", "z" * 1000), (63, "u", "w" * 1000), (None, "v", "w" * 1000), (70, "big", "Ab9 é" * 600_000)])


def brute(pages):
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == data and p is not None]
        best = max(same, default=None)
        response = len(data) < 1000 or best is None or page_id == best
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit",
                    None if response else best))
    return sorted(out, key=str)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                                 "page_id long, url string, html string, payload string, size int, digest string")


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("limits", [{}, {"package_bytes": 500}, {"package_records": 3}])
def test_round_trip(spark, tmp_path, limits):
    path = str(tmp_path / "w")
    warc.write(pages_of(spark, PAGES).repartition(3), path, **limits)
    got = warc.read(spark, path).collect()
    assert sorted([tuple(r[c] for c in COLUMNS) for r in got], key=str) == brute(PAGES)
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id is not None}
    assert all(texts[p] == (h or "") for p, _, h in PAGES if p in texts)
    assert {r.url for r in got if r.page_id == 3} == {"http://a/3%20b%0A"} and {r.url for r in got if r.page_id == 50} == {None}
    assert sum(r.records for r in spark.read.parquet(f"{path}/packages").collect()) == len(PAGES)


def test_large_groups_are_salted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "GROUP_ROWS", 3)
    monkeypatch.setattr(warc, "SMALL_ROWS", 0)
    got = warc.marked(pages_of(spark, PAGES)).collect()
    assert sorted((str(r.page_id), str(r.original)) for r in got) == sorted((str(r[0]), str(r[4])) for r in brute(PAGES))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages_of(spark, []), path)
    assert warc.read(spark, path).collect() == []


def test_packages_are_plain_zip_and_warc(spark, tmp_path):
    path = tmp_path / "w"
    warc.write(pages_of(spark, PAGES).coalesce(1), str(path))
    (package,) = path.glob("*.wacz")
    with zipfile.ZipFile(package) as z:
        assert z.testzip() is None and z.namelist() == [warc.ARCHIVE, warc.INDEX]
        archive = z.read(warc.ARCHIVE)
        entries = [json.loads(x.split(" ", 2)[2]) for x in z.read(warc.INDEX).decode().splitlines()]
    whole, at = zlib.decompressobj(31), 0
    for e in sorted(entries, key=lambda e: e["offset"]):
        assert e["offset"] == at
        at += e["length"]
        assert zlib.decompress(archive[e["offset"]:at], 31).startswith(b"WARC/1.1\r\n")
    assert at == len(archive) and whole.decompress(archive).startswith(b"WARC/1.1")


class Counted:
    """A file in memory that counts the bytes read."""

    def __init__(self, data):
        self.data, self.total = data, 0

    def read_at(self, n, at):
        assert n >= 0 and at >= 0
        self.total += n
        return self.data[at:at + n]


def directory(data):
    file = Counted(data)
    return list(warc.directory(file, len(data))), file.total


def check_members(data, found):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [m["member"] for m in found] == z.namelist()
        for m, info in zip(found, z.infolist()):
            assert (m["method"], m["size"], m["stored"], m["crc"]) == (info.compress_type, info.file_size, info.compress_size, info.CRC)
            if m["method"] == 0:
                assert data[m["start"]:m["start"] + m["size"]] == z.read(info)


@pytest.mark.parametrize("wide", [False, True], ids=["zip", "zip64"])
@pytest.mark.parametrize("prefix,comment", [(b"", b""), (b"#!x" * 9, b""), (b"", b"PK\x05\x06 a comment"), (b"stub", b"c" * 65535)])
def test_directory(monkeypatch, wide, prefix, comment):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    out.write(prefix)
    with zipfile.ZipFile(out, "a" if prefix else "w") as z:
        z.writestr("ä.txt", b"1" * 90)
        z.writestr("empty", b"")
        z.writestr("archive/data.warc.gz", bytes(range(256)) * 40)
        z.writestr("packed", b"3" * 5000, zipfile.ZIP_DEFLATED)
        z.comment = comment
    assert (b"PK\x06\x06" in out.getvalue()) == wide
    data = out.getvalue()
    check_members(data[:len(data) - len(comment) - 2] + b"\0\0", directory(data)[0])  # zipfile stumbles over a comment
    found = directory(b"before" + data)[0]
    assert [m["start"] - 6 for m in found] == [m["start"] for m in directory(data)[0]]


def test_directory_of_a_streamed_package_reads_only_its_end(monkeypatch):
    class Sink(io.RawIOBase):  # can't seek, as a store's stream
        def __init__(self):
            self.data = bytearray()

        def writable(self):
            return True

        def write(self, b):
            self.data += b
            return len(b)

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 1000)
    sink = Sink()
    package = warc.Package(sink)
    for i in range(30):
        package.add(i, None, hashlib.sha256(str(i).encode()).digest() * 400_000, "0", None)
    package.size = 0
    package.close()
    found, total = directory(bytes(sink.data))
    check_members(bytes(sink.data), found)
    assert total < 70_000 < len(sink.data)


@pytest.mark.parametrize("data", [b"", b"no package", b"PK\x05\x06" + b"\0" * 10, b"PK\x05\x06" + b"\0" * 8 + b"\xff" * 8 + b"\0\0"])
def test_no_package(data):
    with pytest.raises(ValueError):
        directory(data)


def test_ranges():
    places = [(0, 5), (5, 5), (10, 90), (100, 1), (200, 3), (203, 3), (300, 1000), (1300, 2)]
    assert list(warc.ranges(places, 100)) == [(0, 3, 100), (3, 1, 1), (4, 2, 6), (6, 1, 1000), (7, 1, 2)]
    assert list(warc.ranges([])) == []


def test_damage_is_noticed(spark, tmp_path):
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse(warc.gzipped(good))["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(warc.gzipped(good.replace(b"payload", b"paYload")))
    with pytest.raises(ValueError):
        warc.parse(warc.gzipped(good[:-1]))
    with pytest.raises(ValueError):
        list(warc._lines(Counted(b"a\nb"), 0, 3, 7))
    assert list(warc._lines(Counted(b"xa\nb"), 1, 3, zlib.crc32(b"a\nb"))) == [b"a", b"b"]
