"""WARC files of gzip members: a writer, and a reader whose tasks share a file by byte ranges.

A task looks for the gzip magic from the start of its range on, takes a candidate for a member if its data decode and
begin with a record header, and then goes from member to member. It owns the records of all members that start inside
its range, and reads the last one to its end beyond it. So every member is read by exactly one task, and no index is
needed. Where a member ends beyond its range, the tasks of the next ranges begin after it.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm import common

MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _header(value: str) -> str:
    """A header's value; control characters, which would end it, are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, html: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One response record; headers are left out where a value is null, and a null page has no HTTP block."""
    lines = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    body = b"" if html is None else _HTTP + html.encode()
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.local_path(folder)
        name, n, stream = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                stream.write(gzip.compress(record(page_id, url, html), 6, mtime=0))
                n += 1
        if stream is not None:
            size = stream.tell()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` as one file of gzip members for each task; the files that belong to the result are returned (written).

    A task that runs again writes another file; only that of the run which counted is listed.
    """
    spark = pages.sparkSession
    common.ship(spark)
    made = spark._jvm.org.apache.hadoop.fs.Path(folder)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)
    return common.materialize(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_writer(folder), "path string, bytes long, records long"), "warc-files")


class _Window:
    """Bytes of a file from a moving position on, read in pieces."""

    def __init__(self, file: object, size: int) -> None:
        self.file, self.size = file, size
        self.at, self.data = 0, b""

    def get(self, pos: int, n: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.data):
            self.file.seek(pos)
            self.at, self.data = pos, self.file.read(max(n, _READ))
        return self.data[pos - self.at : pos - self.at + n]


def _member(window: _Window, pos: int) -> tuple[bytes, int] | None:
    """The data of the gzip member at ``pos`` and where it ends; None if no whole member of records is there."""
    decoder, parts, at = zlib.decompressobj(31), [], pos
    try:
        while not decoder.eof and at < window.size:
            data = window.get(at, 1 << 16)
            if not data:
                return None
            parts.append(decoder.decompress(data))
            at += len(data)
            if not parts[0].startswith(b"WARC/1.") and len(parts[0]) >= 7:
                return None
    except zlib.error:
        return None
    whole = b"".join(parts)
    if not decoder.eof or not whole.startswith(b"WARC/1."):
        return None
    return whole, at - len(decoder.unused_data)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a member: headers with names in lower case, and blocks. It ends at the first that is no record."""
    at = 0
    while data.startswith(b"WARC/1.", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            return
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


def members(file: object, start: int, stop: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """Offset, end and data of the members that start in [start, stop), one after the other."""
    window, pos = _Window(file, size), start
    while pos < stop:
        if window.get(pos, 3) == MAGIC and (found := _member(window, pos)):
            yield pos, found[1], found[0]
            pos = found[1]
            continue
        # The magic may lie across the end of a piece, so pieces overlap by two bytes.
        while True:
            pos += 1
            data = window.get(pos, min(_READ, stop - pos + 2)) if pos < stop else b""
            hit = data.find(MAGIC)
            if hit >= 0:
                pos += hit
                break
            if len(data) <= 3:
                return
            pos += len(data) - 3


def records(file: object, start: int, stop: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of all records whose member starts in [start, stop)."""
    for pos, _, data in members(file, start, stop, size):
        for headers, block in parse(data):
            yield pos, headers, block


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split with the end of the last member that starts in it, 0 where none does."""
    for batch in batches:
        ends = []
        for path, start, stop, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, name = common.local_path(path)
            with fs.open_input_file(name) as file:
                ends.append(max((end for _, end, _ in members(file, start, stop, size)), default=0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.int64())], names=["path", "start", "stop", "bytes", "end"])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, stop, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, name = common.local_path(path)
            rows: list[tuple] = []
            held = 0
            with fs.open_input_file(name) as file:
                for offset, headers, block in records(file, start, stop, size):
                    head, sep, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"x", block)
                    page = headers.get("x-page-id")
                    payload = None if not block else (body if sep else b"").decode("utf-8", "replace")
                    rows.append((path, offset, headers.get("warc-type"), int(page) if page else None, headers.get("warc-target-uri"), headers.get("warc-date"), payload))
                    held += len(block)
                    if held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)


_ROWS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("html", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def read(spark: SparkSession, files: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """The records of ``files`` (``path``, ``bytes``): ``path``, ``offset``, ``type``, ``page_id``, ``url``, ``date``, ``html``.

    Splits of ``split_bytes`` are spread evenly over tasks. Members that are damaged or hold no records are passed over;
    reading goes on at the next that is sound. A member may hold the bytes of others, as that of a stored WARC file does; those
    are none of its file's. So a first pass decodes members and notes where the last of each split ends, and a split reads on from
    where those before it ended: the records are the same at every split size. A record without a header or block has null
    there; a very large member has to fit into a task's memory. Files that aren't compressed give no records. Null paths are left
    out; repeated files give repeated records; an empty list of files gives no rows.
    """
    common.ship(spark)
    named = files.where("path IS NOT NULL AND bytes > 0").groupBy("path", "bytes").agg(F.count("*").alias("times"))
    splits = named.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "bytes", "times")
    # As many tasks as splits, but for sizes at which so many would burden the driver.
    tasks = max(1, min(splits.count(), 64 * common.partitions(spark)))
    spread = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("stop"), "bytes").repartition(tasks)
    ends = common.materialize(spread.mapInArrow(_ends, "path string, start long, stop long, bytes long, end long"), "ends")
    before = F.max("end").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    left = ends.withColumn("start", F.greatest("start", F.coalesce(before, F.lit(0)))).where("start < stop").join(named, ["path", "bytes"])
    again = left.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("path", "start", "stop", "bytes").repartition(tasks)
    return again.mapInArrow(_reader, "path string, offset long, type string, page_id long, url string, date string, html string")


def round_trip(pages: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """``page_id``, ``url`` and ``html`` of ``pages`` after a way through WARC files in the shared folder.

    Nulls, empty and long pages and repeated rows come back as they were; control characters in a url come back
    percent-encoded. Other columns are left out; an empty table gives no rows.
    """
    spark = pages.sparkSession
    files = write(pages, common.fresh_path(spark, "warc"))
    return read(spark, files, split_bytes).select("page_id", "url", "html")


ORACLE_SQL = "SELECT page_id, url, html FROM pages"
