"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own. A reading task takes a byte range of a file, looks for the gzip magic, accepts
a place only if a WARC header can be decoded there, and owns the records that start inside its range, reading beyond the
end to finish the last one. Files are opened by range in the tasks, so no task ever holds a whole archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm.common import whole
from gridcast.session import shared_dir, snapshot

MAGIC = b"\x1f\x8b\x08"
EOL = b"\r\n"
#: Bytes of a file after which a writing task begins another, and of the range that a reading task takes
ROLL, RANGE = 256 << 20, 16 << 20
CHUNK = 1 << 18


def store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c for c in value if c not in "\r\n")


def record(page: int | None, url: str | None, payload: bytes, leader: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member: a response with its payload, or, if ``leader`` is given, a revisit of that page without it.

    A revisit keeps the HTTP header of its payload, whose Content-Length is the full payload's.
    """
    http = EOL.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + EOL * 2
    block = http if leader is not None else http + payload
    head = {
        "WARC-Type": "response" if leader is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = _clean(url)
    if leader is not None:
        head["WARC-Refers-To"] = f"<urn:page:{leader}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items())]
    data = "\r\n".join(lines).encode("utf-8", "surrogatepass") + EOL * 2 + block + EOL * 2
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_leaders(pages: DataFrame, key: str, source: str, least: int) -> DataFrame:
    """id, url, payload and, for a page that repeats another's payload of ``least`` bytes or more, its leader.

    The leader is the largest id among equal payloads. Payloads are compared by SHA-256 and length; the largest ids
    combine before the shuffle. Only groups of two or more are joined back, so the payloads of single pages meet no list
    of leaders beyond the join itself, and a very common payload is left to adaptive skew handling.
    """
    rows = pages.select(F.col(key).alias("id"), F.col("url").alias("u"), whole(source).cast("binary").alias("payload"))
    rows = rows.withColumn("h", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    leaders = rows.groupBy("h", "n").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("many")).filter("many > 1 and top is not null").drop("many")
    other = (F.col("n") >= least) & F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    return rows.join(leaders, ["h", "n"], "left").select("id", "u", "payload", F.when(other, F.col("top")).alias("leader"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", source: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row below ``folder`` and return the files that count: path, bytes, records.

    Every attempt of a task writes files of its own name, so what a lost attempt leaves behind is in no list. Missing
    pages have an empty payload, missing ids and addresses are left out of the header, and rows that repeat an id and
    its payload are the same page: each is written as a response if that id is the largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        out, written, done = None, [0, 0], []

        def close() -> None:
            nonlocal out
            if out is not None:
                out[1].close()
                done.append((f"{folder}/{out[0]}", *written))
                out = None

        for batch in batches:
            # Payloads leave Arrow one by one: a batch is never there twice.
            for page, url, payload, leader in zip(*(batch.column(c) for c in ("id", "u", "payload", "leader"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, written = (name, system.open_output_stream(f"{root}/{name}", compression=None)), [0, 0]
                data = record(page.as_py(), url.as_py(), payload.as_py(), leader.as_py())
                out[1].write(data)
                written = [written[0] + len(data), written[1] + 1]
                if written[0] >= ROLL:
                    close()
        close()
        kinds = (("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])

    rows = with_leaders(pages, key, source, least)
    rows = rows.withColumns({"id": F.col("id").cast("long"), "leader": F.col("leader").cast("long")})
    return snapshot(rows.mapInArrow(run, "path string, bytes long, records long"))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of every .warc.gz file below ``folder``; one row per file, none if there is no such folder."""
    system, root = store(folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    scheme = folder.split(root)[0] if root in folder else ""
    rows = [(scheme + f.path, f.size) for f in found if f.is_file and f.path.endswith(".warc.gz")]
    return spark.createDataFrame(rows, "path string, bytes long")


class _Window:
    """Bytes of a file around a moving place; only what is being looked at stays in memory."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.over = file, at, b"", False

    def more(self) -> bool:
        got = self.file.read(CHUNK)
        self.over = not got
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n

    def magic(self, end: int) -> bool:
        """Go to the next gzip magic that starts before ``end``."""
        while True:
            found = self.data.find(MAGIC)
            if found >= 0:
                self.skip(found)
                return self.at < end
            if len(self.data) > 2:
                self.skip(len(self.data) - 2)
            if self.at >= end or not self.more():
                return False


def _member(window: _Window) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and length of the member at the window's place; None if no WARC record starts there.

    The header is decoded first, however long it is; a place whose first bytes are no WARC version is left at once.
    """
    unpack = zlib.decompressobj(31)
    data, fed, seen, header, length = bytearray(), 0, 0, None, 0
    try:
        while not unpack.eof:
            if fed == len(window.data) and not window.more():
                return None  # the file ends inside the member
            piece = window.data[fed : fed + CHUNK]
            fed += len(piece)
            data += unpack.decompress(piece)
            if header is None:
                if not b"WARC/1."[: len(data)] == data[:7]:
                    return None
                stop = data.find(EOL * 2, seen)
                if stop < 0:
                    seen = max(0, len(data) - 3)
                    continue
                lines = data[:stop].decode("utf-8", "surrogatepass").split("\r\n")
                header = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                length = int(header["content-length"])
                del data[: stop + 4]
    except (zlib.error, ValueError, KeyError):
        return None
    if header is None or len(data) < length:
        return None
    return header, bytes(data[:length]), fed - len(unpack.unused_data)


def read_range(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header and block of every record of the file that starts in [start, end)."""
    system, name = store(path)
    with system.open_input_file(name) as file:
        file.seek(start)
        window = _Window(file, start)
        while window.magic(end):
            found = _member(window)
            if found is None:
                window.skip(1)
                continue
            header, block, length = found
            yield window.at, header, block
            window.skip(length)


def read_archives(files: DataFrame, byte_range: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records of ``files`` (path, bytes), one row each, with payloads or only their digests.

    Columns: path, place, record_type, page_id, url, refers_to, payload_bytes and payload_digest (of the full payload, for
    a revisit as its header states them), intact (the payload, if stored, has the stated digest), payload (null for a
    revisit or on request). Members that are no WARC records are passed over, as are bytes between members. A record's
    address may be of any length; a record without an id has a null page_id. No files, or empty ones, give no rows.
    """
    size = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    spark = files.sparkSession
    ranges = files.filter("bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(byte_range).cast("long"))).alias("start")
    )
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // byte_range))
    kinds = "path string, place long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload binary"

    def number(urn: str | None) -> int | None:
        tail = (urn or "").removesuffix(">").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [k.split()[0] for k in kinds.split(", ")]
        rows, held = [], 0

        def frame() -> pd.DataFrame:
            # Typed column by column: a column of numbers and gaps would become floats.
            typed = {"place": "int64", "page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "intact": "boolean"}
            return pd.DataFrame({n: pd.array(c, dtype=typed.get(n, object)) for n, c in zip(names, zip(*rows))})

        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                for place, header, block in read_range(path, int(start), int(start) + byte_range):
                    http, _, payload = block.partition(EOL * 2)
                    kind = header.get("warc-type")
                    stated = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(EOL))}
                    if kind == "revisit":
                        n, digest, intact, payload = int(fields.get(b"content-length", b"0")), stated, None, None
                    else:
                        n, digest = len(payload), payload_digest(payload)
                        intact = stated is None or stated == digest
                    row = (path, place, kind, number(header.get("warc-record-id")), header.get("warc-target-uri"), number(header.get("warc-refers-to")), n, digest, intact, payload if payloads else None)
                    rows.append(row)
                    held += len(payload or b"") + 200
                    if held > 32 << 20:
                        yield frame()
                        rows, held = [], 0
        if rows:
            yield frame()

    return ranges.repartition(int(tasks)).mapInPandas(run, kinds)


def archive_round_trip(pages: DataFrame, least: int = 0, byte_range: int = RANGE) -> DataFrame:
    """Archive every page in the shared folder and read the archives back: one row per page.

    page_id, payload_bytes, payload_digest (upper-case base32 SHA-1), record_type (response or revisit), refers_to.
    A missing page is an empty payload; a missing id stays null and never leads a group. Rows that repeat an id are
    records of their own. An empty table gives an empty result; other columns are ignored.
    """
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    found = read_archives(write_archives(pages, folder, least=least), byte_range, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
