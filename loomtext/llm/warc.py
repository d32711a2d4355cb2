"""WARC archives with revisit resolution.

1. Each task writes its rows as response records into an archive of its own (gzip member a record) and gives back only
   headers: digest, length, file, offset.
2. Headers are shuffled by payload digest; the smallest id of equal payloads is the original, the others' headers are
   joined to it. Payloads aren't shuffled.
3. The decisions of one archive go to one task, which copies its records to a deduplicated archive with fresh headers;
   revisit records lose their payload and name the original.
4. Reading goes over the archives in the order of their records, one record in memory at a time.

Archives lie in the shared folder and are named anew by each attempt; only those that a finished task reported are read,
so lost executors leave nothing behind but scratch files.

Defined results: null payload: empty; payloads under MIN_REVISIT bytes are always responses; ids are integers, null ones come last among
equals; of rows with the same id and payload the one with the smallest url, then archive position, is the response; an
empty table gives no archive and an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomtext.llm.common import Spilled, remove, scratch_path, small_batches, table

MIN_REVISIT = 100
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
READ = 1 << 20
#: Archives are rewritten by so many tasks for each, at most MOST_TASKS in all: their headers are too small to be dealt by size.
SPREAD, MOST_TASKS = 2, 20_000

HEADERS = "id long, url string, bytes long, digest string, file string, at long, size long"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder, local or remote, by its address."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def local_uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def record(kind: str, key: int | None, url: str | None, digest: str, payload: bytes, length: int, refers: int | None = None) -> bytes:
    """One gzip member. The block of both kinds is an HTTP response head, which holds the full payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    target = "".join(c for c in url or "" if c > " ")
    lines = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if key is None else key}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers is None else refers}>"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], memoryview]:
    """Record headers, HTTP headers and payload of one unpacked record."""
    end = raw.index(b"\r\n\r\n")
    fields = lambda part: dict(line.split(": ", 1) for line in part.decode().split("\r\n")[1:] if ": " in line)
    head = fields(raw[:end])
    block = memoryview(raw)[end + 4 : end + 4 + int(head["Content-Length"])]
    inner = bytes(block[:4096]).index(b"\r\n\r\n")
    return head, fields(bytes(block[:inner])), block[inner + 4 :]


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, unpacked record) of each gzip member of an archive."""
    at, held = 0, b""
    while True:
        held = held or stream.read(READ)
        if not held:
            return
        unpack, out, took = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not held:
                held = stream.read(READ)
                if not held:
                    raise ValueError("the archive ends within a record")
            out.append(unpack.decompress(held))
            took += len(held) - len(unpack.unused_data)
            held = unpack.unused_data
        yield at, b"".join(out)
        at += took


def write_responses(pages: DataFrame, folder: str) -> DataFrame:
    """(HEADERS) of the response records written for pages (id, url, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        stream, name, at = None, "", 0
        for batch in batches:
            rows = []
            for key, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs.open_output_stream(name, compression=None)
                payload = payload or b""
                digest = hashlib.sha256(payload).hexdigest()
                packed = record("response", key, url, digest, payload, len(payload))
                stream.write(packed)
                rows.append((key, url, len(payload), digest, name, at, len(packed)))
                at += len(packed)
                if at >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], HEADERS.replace(",", "").split()[::2])
        if stream is not None:
            stream.close()

    return pages.mapInArrow(run, HEADERS)


def resolve(headers: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Headers with kind and refers_to: revisits joined to the original of their digest."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.coalesce("url", F.lit("")).alias("url"), "file", "at")
    large = headers.filter(F.col("bytes") >= least)
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = headers.join(first, (headers["digest"] == first["digest"]) & (F.col("bytes") >= least), "left").drop(first["digest"])
    again = F.col("first").isNotNull() & ~((F.col("file") == F.col("first.file")) & (F.col("at") == F.col("first.at")))
    return joined.select(
        "file", "at", "size", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first.id")).alias("refers_to")
    )


def rewrite(decided: DataFrame, folder: str, archives: int) -> DataFrame:
    """(file): deduplicated archives, one for each old one; archives: how many there are."""

    def one(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = key[0].as_py()
        revisits = {}
        for b in batches:
            for at, kind, refers in zip(b.column("at").to_pylist(), b.column("kind").to_pylist(), b.column("refers_to").to_pylist(), strict=True):
                if kind == "revisit":
                    revisits[at] = refers
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        with fs.open_input_stream(old, compression=None) as source, fs.open_output_stream(name, compression=None) as sink:
            for at, raw in members(source):
                head, http, payload = parse(raw)
                again = at in revisits
                page = int(head["X-Page-Id"]) if head.get("X-Page-Id", "").strip() else None
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
                sink.write(record("revisit" if again else "response", page, head.get("WARC-Target-URI"), digest, b"" if again else bytes(payload), size, revisits.get(at)))
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    dealt = decided.repartition(max(1, min(MOST_TASKS, SPREAD * archives)), "file")
    return dealt.groupBy("file").applyInArrow(one, "file string")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record of the archives named.

    A response's digest and length are of the payload read; a revisit's are those that its headers state.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    names = schema.replace(",", "").split()[::2]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(file, compression=None) as source:
                    for _, raw in members(source):
                        rows.append(row(*parse(raw)))
                        if len(rows) >= 4096:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def row(head: dict[str, str], http: dict[str, str], payload: memoryview) -> tuple:
        page = head.get("X-Page-Id", "").strip()
        kind = head["WARC-Type"]
        refers = head.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">").strip()
        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha256:")
        size = len(payload) if kind == "response" else int(http["Content-Length"])
        return int(page) if page else None, size, digest, kind, int(refers) if refers else None, head.get("WARC-Target-URI")

    return files.mapInArrow(run, schema)


def write_warc(df: DataFrame, id_col: str, url_col: str, payload_col: str, folder: str, least: int = MIN_REVISIT) -> DataFrame:
    """Write deduplicated archives of all rows into the folder; gives the table of their names."""
    spark = df.sparkSession
    small_batches(spark)
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    raw = local_uri(scratch_path(spark, "responses"))
    payload = F.col(payload_col).cast("binary") if df.schema[payload_col].dataType.simpleString() != "binary" else F.col(payload_col)
    headers = Spilled(write_responses(df.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), payload), raw), "headers")
    archives = headers.df.select("file").distinct().count()
    files = Spilled(rewrite(resolve(headers.df, least), folder, archives), "archives").df
    remove(spark, raw)
    headers.drop()
    return files


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = local_uri(scratch_path(spark, "warc"))
    files = write_warc(table(spark, sf_dir, "pages"), "page_id", "url", "html", folder)
    spread = files.repartition(max(1, min(2000, files.count())))
    return read_archives(spread, folder).drop("url")
