r"""WARC records in ZIP archives, read by range without extraction.

Each task writes its pages as one archive: a stored member archive/data.warc.gz, in which every record is a gzip
member of its own, and a stored member indexes/index.tsv with offset, length and page of every record. The reader
parses the end record, its ZIP64 form and the central directory by itself, finds where stored members lie, reads the
index by range, and deals the records out in runs of bounded size, each of which is one range read.

Payloads of MIN_BYTES or more that repeat are written once, as the response of the smallest page_id; the others are
revisit records, which keep the HTTP head and so the full length and digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship

MIN_BYTES = 100
#: Bytes of archive that one run of records has about, and that one reading task has at most (more only where one record is larger).
RUN_BYTES, TASK_BYTES = 4_000_000, 64_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# writing


class ZipWriter:
    """Stored members, one after another, each with sizes in ZIP64 fields; the directory comes last."""

    def __init__(self, out):
        self.out, self.at, self.entries, self.now = out, 0, [], None

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        self.now = [name.encode(), self.at, 0, 0]
        # flag 8: checksum and sizes follow the data
        self.put(struct.pack("<4s5H3L2H", LOCAL, 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(self.now[0]), 20) + self.now[0] + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.now[2] = zlib.crc32(data, self.now[2])
        self.now[3] += len(data)
        self.put(data)

    def end(self) -> None:
        name, at, crc, size = self.now
        self.put(struct.pack("<4sL2Q", b"PK\x07\x08", crc, size, size))
        self.entries.append(self.now)

    def close(self) -> None:
        start = self.at
        for name, at, crc, size in self.entries:
            extra = struct.pack("<2H3Q", 1, 24, size, size, at)
            self.put(struct.pack("<4s6H3L5H2L", ENTRY, 45, 45, 8, 0, 0, 33, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name + extra)
        size, n, end64 = self.at - start, len(self.entries), self.at
        self.put(struct.pack("<4sQ2H2L4Q", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self.put(struct.pack("<4sLQL", LOCATOR64, 0, end64, 1))
        self.put(struct.pack("<4s4H2LH", END, FULL16, FULL16, FULL16, FULL16, FULL32, FULL32, 0))


def page_urn(page: str | None) -> str:
    return "<urn:nopage>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def page_of(urn: str) -> str | None:
    return None if urn == page_urn(None) else unquote(urn[len("<urn:page:") : -1])


def record(page: str | None, url: str | None, payload: bytes, digest: str, original: str | None, revisit: bool) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_urn(original)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def written(base: str):
    """Each partition's rows (page, url, payload, digest, original) as one archive; its uri and number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = opened(base)
        fs.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.zip"
        hidden = f"{folder}/_{uuid.uuid4().hex}.tmp"  # a second attempt writes another file, and renames over the first
        index, n = [], 0
        with fs.open_output_stream(hidden, compression=None, buffer_size=1 << 20) as out:
            z = ZipWriter(out)
            z.start(DATA)
            for batch in batches:
                for page, url, payload, digest, original in zip(*(c.to_pylist() for c in batch.columns)):
                    revisit = original is not None and original != page
                    data = gzipped(record(page, url, payload, digest, original, revisit))
                    index.append(f"{z.now[3]}\t{len(data)}\t{page_urn(page)}\n")
                    z.write(data)
                    n += 1
            z.end()
            z.start(INDEX)
            for at in range(0, len(index), 10_000):
                z.write("".join(index[at : at + 10_000]).encode())
            z.end()
            z.close()
        fs.move(hidden, f"{folder}/{name}")
        yield pa.record_batch({"archive": pa.array([f"{base}/{name}"]), "n": pa.array([n], pa.int64())})

    return run


# reading


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name to offset and length of the data of each stored member, from the central directory."""
    tail_at = max(0, size - 22 - 65535)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HLL", tail, at + 10)
    if FULL16 == n or FULL32 in (length, start):
        if tail[at - 20 : at - 16] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        f.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        end = f.read(56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end record")
        n, length, start = struct.unpack_from("<3Q", end, 32)
    f.seek(start)
    directory, at, found = f.read(length), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, full, names, extras, comments = struct.unpack_from("<2L3H", directory, at + 20)
        offset, = struct.unpack_from("<L", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode()
        extra = directory[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<2H", extra)
            if kind == 1:  # holds, in this order, those of the three that are full in the entry
                values = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = values.pop(0) if full == FULL32 else full
                packed = values.pop(0) if packed == FULL32 else packed
                offset = values.pop(0) if offset == FULL32 else offset
            extra = extra[4 + width :]
        at += 46 + names + extras + comments
        if method == 0:
            f.seek(offset)
            local = f.read(30)
            found[name] = offset + 30 + sum(struct.unpack_from("<2H", local, 26)), packed
    return found


def runs(run_bytes: int):
    """For each archive, runs of records that lie together: archive, offset, and the length of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = opened(archive)
                with fs.open_input_file(path) as f:
                    found = members(f, f.size())
                    at, length = found[INDEX]
                    f.seek(at)
                    lines = f.read(length).decode().splitlines()
                base, offsets, lengths, held = found[DATA][0], [], [], run_bytes
                for line in lines:
                    offset, size = map(int, line.split("\t")[:2])
                    if held >= run_bytes:
                        offsets.append(base + offset)
                        lengths.append([])
                        held = 0
                    lengths[-1].append(size)
                    held += size
                yield pa.record_batch({"archive": pa.array([archive] * len(offsets), pa.string()), "offset": pa.array(offsets, pa.int64()), "lengths": pa.array(lengths, pa.list_(pa.int64()))})

    return run


def headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}, rest


def parsed(data: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of one record."""
    warc, block = headers(data)
    block = block[: int(warc["content-length"])]
    http, payload = headers(block)
    page, url, digest = page_of(warc["warc-record-id"]), warc["warc-target-uri"], warc["warc-payload-digest"].removeprefix("sha256:")
    if warc["warc-type"] == "revisit":
        return page, url, int(http["content-length"]), digest, "revisit", page_of(warc["warc-refers-to"]), None
    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"]):
        raise ValueError(f"record {page} doesn't have its digest or length")
    return page, url, len(payload), digest, "response", None, payload


RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def records(payloads: bool):
    names = [x.split()[0] for x in RECORD.split(", ")][: 7 if payloads else 6]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, offset, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = opened(archive)
                with fs.open_input_file(path) as f:
                    f.seek(offset)
                    data = memoryview(f.read(sum(lengths)))
                rows, at = [], 0
                for length in lengths:
                    rows.append(parsed(zlib.decompress(data[at : at + length], 31))[: len(names)])
                    at += length
                yield pa.record_batch({k: pa.array(v, t) for k, v, t in zip(names, zip(*rows), kinds)})

    return run


def write_archives(pages: DataFrame, folder: str, *, url: str = "url", payload: str = "html", key: str = "page_id", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages and return archive (uri) and n. Only digests and ids are shuffled to find repeats, then rows by digest.

    Null payloads count as empty. Equal payloads under min_bytes are all responses; rows that repeat a page's id and
    payload are all responses too. A null key is a record without a number, and never the smallest unless all are null.
    Any key type that can be cast to a string; other columns are ignored; an empty table may give empty archives.
    """
    ship(pages.sparkSession)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), F.encode(body, "utf-8").alias("payload"), F.sha2(F.encode(body, "utf-8"), 256).alias("digest"))
    many = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page").alias("original"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "original")
    many = Scratch(pages.sparkSession, "warc").written(many, "repeats")
    ready = rows.join(many, F.col("digest") == F.col("d"), "left").select(F.col("page").cast("string"), "url", "payload", "digest", F.col("original").cast("string"))
    return ready.mapInArrow(written(folder), "archive string, n long")


def read_archives(archives: DataFrame, *, payloads: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The records of the archives (column archive: uris); page ids are strings.

    The runs of all archives are written first, so that reading is dealt over tasks by the bytes that lie in the
    archives: TASK_BYTES a task at most, and as many tasks as there are cores where there are as many runs.
    """
    spark = archives.sparkSession
    ship(spark)
    schema = RECORD if payloads else RECORD.rsplit(",", 1)[0]
    found = archives.select("archive").mapInArrow(runs(run_bytes), "archive string, offset long, lengths array<long>")
    found = Scratch(spark, "runs").written(found, "runs")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    n, total = found.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    tasks = max(1, -(-total // TASK_BYTES), min(n, 2 * spark.sparkContext.defaultParallelism))
    return found.repartition(tasks).mapInArrow(records(payloads), schema)


def round_trip(pages: DataFrame, *, key: str = "page_id", **options) -> DataFrame:
    """Write archives into a new folder of the shared directory and read their records; ids have the type of the key."""
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "archives")
    archives = scratch.written(write_archives(pages, f"{scratch.base}/zip", key=key, **options), "list")
    kind = pages.schema[key].dataType
    return read_archives(archives).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
