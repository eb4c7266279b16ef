"""Web archives in ZIP packages: written as a stream, read through directory, index and byte ranges.

``write`` makes a WARC record of every page and streams the records, each gzipped by itself, into ZIP packages whose
members are stored uncompressed: ``archive/data.warc.gz`` and ``indexes/index.cdxj``.  A task holds one record and the
index lines of one package.

The reader never extracts a package.  ``members`` reads the end of each package, finds the central directory (ZIP64
or not) and the place of every stored member.  ``index`` reads the index members line by line, in blocks.  ``records``
gathers index entries of about 16 MB by their place, reads those byte ranges and parses the records, however large
their package is.  Each step is a table, so a lost executor costs a repeated range read.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest page_id is written whole; the
others become revisits of it, with its HTTP headers (their Content-Length is the payload's) and digest but no payload.
Payloads are matched by SHA-1 and length, counted map-side; a group of over ``GROUP_ROWS`` copies is salted.

Packages are opened through ``pyarrow.fs`` by the URI of the folder, so they can lie in any store the executors share.
A package is named by its task attempt and listed by the committed table ``packages``: files of lost attempts are
never read.

Defined results: a null html is an empty payload; a null page_id is below every other and is written as ``null``; rows
that share the largest page_id of their group are all written whole; a null url has no target line; line breaks and
blanks of a url are percent-encoded; an empty table gives no package; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, shared_path, table, written

REVISIT_BYTES = 1000
GROUP_ROWS = 100_000
#: A table of groups up to so many rows (of under 100 bytes each) is broadcast.
SMALL_ROWS = 200_000
#: A package is closed beyond so many bytes of records, or so many records.
PACKAGE_BYTES = 1 << 30
PACKAGE_RECORDS = 1 << 17
#: Bytes of one range read, and of the part of an archive whose records are read by one task at a time.
RANGE_BYTES = 4 << 20
CHUNK_BYTES = 16 << 20
MAX_TASKS = 100_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"


# -- writing ------------------------------------------------------------------------------------------------------

def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, original (the page_id to revisit; null for a response) of every page."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html")).select(
        "page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    groups = written(page.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(
        F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1")
        .withColumn("salts", F.ceil(F.col("n") / GROUP_ROWS).cast("int")), "warc-groups")
    if groups.count() <= SMALL_ROWS:
        joined = page.join(F.broadcast(groups), ["digest", "size"], "left")
    else:
        hot = groups.filter("salts > 1").select("digest", "size", "salts")  # a row per 100,000 pages at most
        hot = F.broadcast(hot) if hot.count() <= SMALL_ROWS else hot
        salted = page.join(hot, ["digest", "size"], "left").withColumn(
            "salt", (F.monotonically_increasing_id() % F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        joined = salted.join(spread, ["digest", "size", "salt"], "left")
    revisits = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", F.col("html").cast("binary").alias("payload"), "digest",
                         F.when(revisits, F.col("original")).alias("original"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """One WARC record of a page: a response with the payload, or a revisit of ``original`` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_target(url)}")
    if original is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(original)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


class Package:
    """A ZIP package being written to a stream: the archive member as records come, the index at the end."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> None:
        data = gzipped(record(page_id, url, payload, digest, original))
        self.lines.append(f"{_target(url or '-')} {re.sub('[^0-9]', '', DATE)} " + json.dumps(
            {"offset": self.size, "length": len(data), "filename": "data.warc.gz", "digest": f"sha1:{digest}",
             "mime": "text/html" if original is None else "warc/revisit"}))
        self.archive.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.archive.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "".join(x + "\n" for x in sorted(self.lines)))
        self.zip.close()


def write(pages: DataFrame, path: str, package_bytes: int = PACKAGE_BYTES, package_records: int = PACKAGE_RECORDS) -> None:
    """Write all ``pages`` (page_id, url, html) as packages under ``path`` and their list as ``path``/packages."""
    _make(pages.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        context = TaskContext.get()
        name = f"part-{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        package = sink = file = None
        count = 0

        def done():
            package.close()
            sink.close()
            return pa.RecordBatch.from_pydict({"package": [file], "records": pa.array([len(package.lines)], pa.int64())})

        for batch in pieces(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "original"))):
                if package is None:
                    file = f"{name}-{count}.wacz"
                    sink, count = store.open_output_stream(f"{folder}/{file}", compression=None), count + 1
                    package = Package(sink)
                package.add(*row)
                if package.size >= package_bytes or len(package.lines) >= package_records:
                    yield done()
                    package = None
        if package is not None:
            yield done()

    marked(pages).mapInArrow(run, "package string, records long").write.parquet(f"{path}/packages")


def _make(spark: SparkSession, path: str) -> None:
    """Make the folder of the packages."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder given as a path or URI (``file:/x`` too, as Hadoop writes it)."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# -- reading ------------------------------------------------------------------------------------------------------

def directory(file, size: int) -> Iterator[dict]:
    """Members of an open ZIP package by its central directory: name, method, crc, stored, size, start (of the data).

    Only the end of the package, the directory (in blocks) and 30 bytes per member are read.  Sizes, offsets and
    counts beyond 32 (16) bits come from the ZIP64 records.
    """
    tail = min(size, 22 + 65535 + 20)
    end = file.read_at(tail, size - tail)
    at = end.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(end[at + 20:at + 22], "little") > len(end):
        at = end.rfind(b"PK\x05\x06", 0, at)  # a signature inside the comment
    if at < 0 or at + 22 > len(end):
        raise ValueError("not a ZIP package: no end of central directory")
    entries, length, start = struct.unpack("<H2L", end[at + 10:at + 20])
    finish = size - tail + at
    if at >= 20 and end[at - 20:at - 16] == b"PK\x06\x07":
        place = struct.unpack("<Q", end[at - 12:at - 4])[0]
        wide = file.read_at(56, place)
        if wide[:4] != b"PK\x06\x06":  # something stands before the package: the record is right before its locator
            place = max(finish - 20 - 56, 0)
            wide = file.read_at(56, place)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("damaged ZIP package: no ZIP64 record where its locator points")
        entries, length, start = struct.unpack("<3Q", wide[32:56])
        finish = place
    shift = finish - length - start  # bytes that stand before the package proper
    if shift < 0:
        raise ValueError("damaged ZIP package: the directory is out of place")
    buffer, read = b"", start + shift
    for _ in range(entries):
        while len(buffer) < 46 or len(buffer) < 46 + sum(struct.unpack("<3H", buffer[28:34])):
            more = file.read_at(min(RANGE_BYTES, finish - read), read)
            if not more:
                raise ValueError("damaged ZIP package: the directory is cut off")
            buffer, read = buffer + more, read + len(more)
        if buffer[:4] != b"PK\x01\x02":
            raise ValueError("damaged ZIP package: no entry where one is due")
        flags, method = struct.unpack("<2H", buffer[8:12])
        crc, stored, full = struct.unpack("<3L", buffer[16:28])
        n_name, n_extra, n_comment = struct.unpack("<3H", buffer[28:34])
        header = struct.unpack("<L", buffer[42:46])[0]
        name, extra = buffer[46:46 + n_name], buffer[46 + n_name:46 + n_name + n_extra]
        buffer = buffer[46 + n_name + n_extra + n_comment:]
        full, stored, header = _widened(extra, full, stored, header)
        local = file.read_at(30, header + shift)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("damaged ZIP package: no member where the directory points")
        data = header + shift + 30 + sum(struct.unpack("<2H", local[26:30]))
        yield {"member": name.decode("utf-8" if flags & 0x800 else "cp437"), "method": method, "crc": crc,
               "stored": stored, "size": full, "start": data}


def _widened(extra: bytes, *values: int) -> list[int]:
    """``values`` with those that are all ones taken from the ZIP64 extra field, which holds them in this order."""
    while len(extra) >= 4:
        kind, n = struct.unpack("<2H", extra[:4])
        if kind == 1:
            wide, out = io.BytesIO(extra[4:4 + n]), []
            for v in values:
                out.append(struct.unpack("<Q", wide.read(8))[0] if v == 0xFFFFFFFF else v)
            return out
        extra = extra[4 + n:]
    return list(values)


def _spread(df: DataFrame, tasks: int, *keys) -> DataFrame:
    """``df`` dealt by ``keys`` to a set number of tasks: its rows are small, what they stand for isn't."""
    return df.repartition(max(1, min(tasks, MAX_TASKS)), *keys)


def members(spark: SparkSession, path: str) -> DataFrame:
    """package, member, method, crc, stored, size, start of every member of the listed packages."""

    def run(batches):
        store, folder = _store(path)
        for batch in batches:
            for name in batch.column("package").to_pylist():
                with store.open_input_file(f"{folder}/{name}") as file:
                    rows = [{"package": name, **m} for m in directory(file, file.size())]
                yield pa.RecordBatch.from_pylist(rows, schema=_MEMBERS)

    listed = spark.read.parquet(f"{path}/packages").select("package")
    return _spread(listed, listed.count(), "package").mapInArrow(
        run, "package string, member string, method int, crc long, stored long, size long, start long")


_MEMBERS = pa.schema([("package", pa.string()), ("member", pa.string()), ("method", pa.int32()), ("crc", pa.int64()),
                      ("stored", pa.int64()), ("size", pa.int64()), ("start", pa.int64())])


def _lines(file, start: int, size: int, crc: int) -> Iterator[bytes]:
    """Lines of a stored member, read in blocks; its checksum is compared at the end."""
    rest, seen = b"", 0
    for at in range(start, start + size, RANGE_BYTES):
        block = file.read_at(min(RANGE_BYTES, start + size - at), at)
        seen = zlib.crc32(block, seen)
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    if rest:
        yield rest
    if seen != crc:
        raise ValueError("damaged ZIP package: checksum of the index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """package, url, digest, start (absolute), length of every record that the packages' index members name."""
    found = written(members(spark, path), "warc-members")
    stored = found.filter(F.col("method") == 0)
    archives = stored.filter(F.col("member").startswith("archive/")).groupBy("package").agg(
        F.map_from_entries(F.collect_list(F.struct(F.regexp_replace("member", "^archive/", ""), F.struct("start", "size"))))
        .alias("archives"))
    lists = stored.filter(F.col("member").startswith("indexes/")).select("package", "start", "size", "crc").join(
        archives, "package")

    def run(batches):
        store, folder = _store(path)
        for batch in batches:
            for name, start, size, crc, places in zip(*(batch.column(c).to_pylist() for c in (
                    "package", "start", "size", "crc", "archives"))):
                with store.open_input_file(f"{folder}/{name}") as file:
                    rows, places = [], dict(places)
                    for line in _lines(file, start, size, crc):
                        url, _, entry = line.decode().split(" ", 2)
                        entry = json.loads(entry)
                        place = places[entry["filename"]]
                        if int(entry["offset"]) + int(entry["length"]) > place["size"]:
                            raise ValueError("damaged index: a record beyond the end of its archive")
                        rows.append((name, url, entry["digest"], place["start"] + int(entry["offset"]), int(entry["length"])))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), schema=_INDEX)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), schema=_INDEX)

    return _spread(lists, lists.count(), "package").mapInArrow(run, "package string, url string, digest string, start long, length long")


_INDEX = pa.schema([("package", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("start", pa.int64()),
                    ("length", pa.int64())])


def ranges(places: Iterable[tuple[int, int]], limit: int = RANGE_BYTES) -> Iterator[tuple[int, int, int]]:
    """Ascending (start, length) merged into reads: first place, number of places, bytes.

    Neighbours without a gap share a read of at most ``limit`` bytes; a longer record is a read of its own.
    """
    first = count = begin = end = 0
    for i, (start, length) in enumerate(places):
        if count and start == end and start + length - begin <= limit:
            count, end = count + 1, start + length
            continue
        if count:
            yield first, count, end - begin
        first, count, begin, end = i, 1, start, start + length
    if count:
        yield first, count, end - begin


def _headers(data: bytes) -> tuple[str, dict[str, str], int]:
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def parse(data: bytes) -> dict:
    """A gzipped record as page_id, record_type, url, payload (None for a revisit), payload_bytes, payload_digest, refers_to."""
    data = zlib.decompress(data, 31)
    version, head, start = _headers(data)
    if not version.startswith("WARC/") or len(data) != start + int(head["content-length"]) + 4:
        raise ValueError("damaged record: length")
    _, http, body = _headers(data[start:-4])
    payload = data[start + body:-4] if head["warc-type"] == "response" else None
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
        raise ValueError("damaged record: digest of the payload")
    return {"page_id": _page_id(head["warc-record-id"]), "record_type": head["warc-type"], "url": head.get("warc-target-uri"),
            "payload": payload, "payload_bytes": int(http["content-length"]), "payload_digest": digest,
            "refers_to": _page_id(head.get("warc-refers-to"))}


def _page_id(record_id: str | None) -> int | None:
    value = (record_id or "null>").removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


_FIELDS = {"page_id": pa.int64(), "record_type": pa.string(), "url": pa.string(), "payload": pa.binary(),
           "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}


def records(entries: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """The records at index ``entries`` (package, start, length), read by byte ranges.

    page_id, record_type, url, payload (null for revisits; left out if not wanted), payload_bytes, payload_digest, refers_to.
    """
    fields = {k: v for k, v in _FIELDS.items() if payload or k != "payload"}
    size = entries.agg(F.sum("length")).first()[0] or 0
    placed = _spread(entries.select("package", "start", "length"), math.ceil(size / CHUNK_BYTES), "package",
                     F.floor(F.col("start") / CHUNK_BYTES)).sortWithinPartitions("package", "start")

    def run(batches):
        store, folder = _store(path)
        open_name = file = None
        for batch in batches:
            names, starts, lengths = (batch.column(c).to_pylist() for c in ("package", "start", "length"))
            cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if names[a] != open_name:
                    if file is not None:
                        file.close()
                    open_name, file = names[a], store.open_input_file(f"{folder}/{names[a]}")
                for first, count, size in ranges(zip(starts[a:b], lengths[a:b])):
                    data = file.read_at(size, starts[a + first])
                    if len(data) != size:
                        raise ValueError("damaged ZIP package: cut off")
                    out, at = [], 0
                    for i in range(a + first, a + first + count):
                        out.append(parse(data[at:at + lengths[i]]))
                        at += lengths[i]
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in out], t) for k, t in fields.items()})
        if file is not None:
            file.close()

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return placed.mapInArrow(run, ", ".join(f"{k} {kinds[t]}" for k, t in fields.items()))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the packages under ``path``."""
    return records(written(index(spark, path), "warc-index"), path, payload)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all pages written as records in ZIP packages and read back."""
    path = shared_path(spark, "warc")
    write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT size, digest, max(page_id) AS original FROM p WHERE size >= 1000 GROUP BY ALL)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN original IS NULL OR page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM p LEFT JOIN g USING (size, digest)
"""
