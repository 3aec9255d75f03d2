"""WARC archives with a two-level capture index.

Writing: every page becomes a record, compressed on its own, so that any record can be read by its
offset and length.  Of the pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with
the smallest id is written as a response, the others as revisits that refer to it.

Index, level one: all captures sorted by reversed-host url key, cut into compressed blocks of
``BLOCK_LINES`` lines.  Level two: a sparse directory with one row per block (its first key, file,
offset and length).  A lookup finds the index file by binary search over the files' first keys,
the block by binary search in that file's part of the directory, the line by binary search in the
block, and then reads the byte range of the record.

Files go to a folder that all executors reach.  Every task attempt writes files of its own name and
reports them in its rows, so files of failed attempts are never referred to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from posttrain_spark.operators.skew import join_partitions, skew_join
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable, scratch_path

LEAST_REVISIT = 100
BLOCK_LINES = 1_000
# Blocks whose records one task reads.
BLOCKS_A_TASK = 16
# A task begins another archive from this size on.
FILE_BYTES = 256 << 20
# Archives a task holds open at once.
OPEN_FILES = 32

INDEX = "key string, page_id long, file string, offset long, length long"
BLOCKS = "first_key string, last_key string, file string, offset long, length long, lines long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, "
    "payload binary, payload_digest string, payload_bytes long"
)


@dataclass(frozen=True)
class Archive:
    """What ``write_archives`` made: capture index rows are in ``blocks``' files."""

    folder: str
    directory: DataFrame


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://a.b.org:81/x?y`` becomes ``org,b,a:81)/x?y``; '' without a host."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname, parts.port
    except ValueError:
        return ""
    if not host:
        return ""
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and folder.startswith("file:"):
        folder = folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _unpack(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    number = uri.rstrip(">").rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record.  A NULL url is ``urn:none:``; control characters of a url are escaped."""
    revisit = refers_to is not None
    target = "urn:none:" if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))) + " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if revisit:
        head.append(f"WARC-Refers-To: {_uri(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(headers["content-length"])
    if not lines[0].startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, rest[:length]


class _Files:
    """Open archives of one task, the least recently used closed first."""

    def __init__(self, folder: str):
        self.system, self.root = _place(folder)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.system.open_input_file(f"{self.root}/{name}")
        self.open.move_to_end(name)
        return self.open[name].read_at(length, offset)

    def close(self) -> None:
        for file in self.open.values():
            file.close()


class _Output:
    """Appends members to files of a task attempt, a new file from ``FILE_BYTES`` on."""

    def __init__(self, folder: str, kind: str):
        self.system, self.root = _place(folder)
        self.kind, self.name, self.stream, self.offset = kind, "", None, 0

    def write(self, data: bytes) -> tuple[str, int, int]:
        """File, offset and length of the member."""
        if self.stream is None or self.offset >= FILE_BYTES:
            self.close()
            self.name = f"{self.kind}-{uuid.uuid4().hex}.gz"
            self.stream = self.system.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.offset = 0
        packed = _member(data)
        self.stream.write(packed)
        self.offset += len(packed)
        return self.name, self.offset - len(packed), len(packed)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def _with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` and ``refers_to`` (NULL for responses)."""
    payload = F.coalesce("html", F.lit(""))
    narrow = durable(
        pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")),
        "payloads",
    )
    shared = durable(
        narrow.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("_rows"))
        .filter("_rows > 1 AND first IS NOT NULL"),
        "shared-payloads",
    )
    later = skew_join(
        narrow.select("page_id", "digest"), shared.drop("_rows"), "digest", ["page_id"],
        counts=shared.select("digest", "_rows"),
    )
    revisits = durable(
        later.filter("page_id IS NULL OR page_id > first")
        .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
        .distinct(),
        "revisits",
    )
    keyed = pages.withColumn("digest", F.sha2(payload, 256))
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return keyed.join(revisits, same, "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write ``pages`` (page_id, url, html; other columns play no part) and their index to ``folder``.

    NULL html is an empty payload, NULL urls have the empty key.  Pages that repeat an id and payload
    are one capture each; all that carry the smallest id of their payload are responses, so are
    pages without an id unless a page with one has their payload.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    system, root = _place(folder)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output(folder, "warc")
        try:
            for batch in batches:
                made = []
                for p, u, h, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (h or "").encode()
                    made.append((url_key(u), p, *out.write(record(p, u, payload, digest, refers, date))))
                columns = zip(*made, strict=True) if made else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["key", "page_id", "file", "offset", "length"],
                )
        finally:
            out.close()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, made = _Output(folder, "index"), [], []

        def block() -> None:
            text = "\n".join("\t".join(map(str, line)) for line in lines).encode()
            made.append((lines[0][0], lines[-1][0], *out.write(text), len(lines)))
            lines.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append((_escape(line[0]), "" if line[1] is None else line[1], *line[2:]))
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        out.close()
        columns = zip(*made, strict=True) if made else [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["first_key", "last_key", "file", "offset", "length", "lines"],
        )

    captures = durable(_with_revisits(source).mapInArrow(write, INDEX), "captures")
    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id")
    return Archive(folder, durable(ordered.mapInArrow(cut, BLOCKS), "directory"))


def _escape(key: str) -> str:
    """Keys hold no tab or line feed; both are escaped as in urls."""
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def _entries(files: _Files, file: str, offset: int, length: int) -> list[tuple[str, str, str, int, int]]:
    text = _unpack(files.read(file, offset, length)).decode()
    return [(k, p, f, int(o), int(n)) for k, p, f, o, n in (line.split("\t") for line in text.split("\n"))]


def _record_batch(found: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    rows = []
    for headers, body in found:
        revisit = headers["warc-type"] == "revisit"
        url = headers["warc-target-uri"]
        told = headers["warc-payload-digest"].removeprefix("sha256:")
        own = told if revisit else hashlib.sha256(body).hexdigest()
        if own != told:
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
        rows.append((
            _page(headers["warc-record-id"]), None if url == "urn:none:" else url, headers["warc-type"],
            _page(headers["warc-refers-to"]) if revisit else None,
            None if revisit else body, told, None if revisit else len(body),
        ))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64())
    names = [part.split()[0] for part in RECORDS.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


# Records read before they are handed on.
_AT_ONCE = 200


def read_captures(archive: Archive) -> DataFrame:
    """All records, block by block of the index: columns RECORDS.  A revisit has no payload here."""
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries = sorted(_entries(files, file, offset, length), key=lambda e: e[2:])
                for i in range(0, len(entries), _AT_ONCE):
                    yield _record_batch([parse(_unpack(files.read(*e[2:]))) for e in entries[i : i + _AT_ONCE]])
        files.close()

    blocks = archive.directory.select("file", "offset", "length")
    # By number: adaptive execution would join the tiny descriptors of all blocks into one task.
    return blocks.repartition(_read_tasks(archive), F.xxhash64("file", "offset")).mapInArrow(read, RECORDS)


def _read_tasks(archive: Archive) -> int:
    """Tasks to read records in: at most some BLOCKS_A_TASK blocks of the index for each."""
    blocks = archive.directory.count()
    return max(1, min(blocks, join_partitions(archive.directory)), -(-blocks // BLOCKS_A_TASK))


def _blocks_of(archive: Archive, asked: DataFrame) -> DataFrame:
    """The blocks that may hold each asked key: ``key``, ``file``, ``offset``, ``length``.

    Asked keys and the first keys of the blocks of an index file are sorted together; the last block
    that begins at or before a key is carried to it.  An earlier block holds the key only if it ends
    with it.
    """
    names = ("file", "offset", "length")
    block = F.struct(*names, "last_key").alias("_block")
    marks = archive.directory.select(F.col("file").alias("part"), F.col("first_key").alias("key"), block)
    wanted = asked.select("part", "key", F.lit(None).cast(marks.schema["_block"].dataType).alias("_block"))
    along = Window.partitionBy("part").orderBy("key", F.col("_block").isNull())
    carried = F.last("_block", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    both = marks.unionByName(wanted).withColumn("_found", carried).filter("_block IS NULL")
    latest = both.filter("_found.last_key >= key").select("key", *(f"_found.{n}" for n in names))
    ending = archive.directory.select(F.col("file").alias("part"), F.col("last_key").alias("key"), *names)
    return latest.unionByName(asked.join(ending, ["part", "key"]).select("key", *names)).distinct()


def lookup(archive: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """All captures of the urls (each asked url once), read by byte range: columns RECORDS.

    Keys are joined to blocks by range; a key with captures in many blocks is read by many tasks.
    """
    folder = archive.folder
    parts = archive.directory.groupBy("file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
    # One row per index file, of which there are at most as many as shuffle partitions (or 256 MB pieces).
    tops = sorted((r["low"], r["high"], r["file"]) for r in parts.collect())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = [t[0] for t in tops]
        for batch in batches:
            rows = []
            for u in batch.column(0).to_pylist():
                key = _escape(url_key(u))
                k = bisect_right(lows, key) - 1
                while k >= 0 and tops[k][1] >= key:
                    rows.append((key, tops[k][2]))
                    k -= 1
            columns = zip(*rows, strict=True) if rows else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["key", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        block, entries, keys = None, [], []
        for batch in batches:
            for key, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != block:
                    block, entries = place, _entries(files, *place)
                    keys = [e[0] for e in entries]
                found = entries[bisect_left(keys, key) : bisect_right(keys, key)]
                for i in range(0, len(found), _AT_ONCE):
                    yield _record_batch([parse(_unpack(files.read(*e[2:]))) for e in found[i : i + _AT_ONCE]])
        files.close()

    asked = urls.select(F.col(url).cast("string").alias("url")).distinct().mapInArrow(place, "key string, part string")
    pairs = _blocks_of(archive, asked.distinct()).select("key", "file", "offset", "length")
    dealt = pairs.repartition(_read_tasks(archive), F.xxhash64("file", "offset"))
    return dealt.sortWithinPartitions("file", "offset", "key").mapInArrow(read, RECORDS)


def with_referred_sizes(records: DataFrame) -> DataFrame:
    """Records with the payload size of revisits taken from the response that they refer to."""
    narrow = durable(records.drop("payload", "url"), "records")
    revisits = narrow.filter("record_type = 'revisit'")
    sizes = (
        narrow.filter("record_type = 'response' AND page_id IS NOT NULL")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("payload_bytes"))
    )
    wanted = revisits.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("_rows"))
    known = durable(sizes.join(wanted, ["refers_to", "payload_digest"]), "referred-sizes")
    key = F.concat_ws(":", F.col("refers_to").cast("string"), "payload_digest")
    filled = skew_join(
        revisits.drop("payload_bytes").withColumn("_key", key),
        known.select(key.alias("_key"), "payload_bytes"),
        "_key",
        ["page_id"],
        counts=known.select(key.alias("_key"), "_rows"),
    )
    return narrow.filter("record_type = 'response'").unionByName(filled.drop("_key"))


_ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


@query("op8_warc", _ORACLE)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture is looked up by its url."""
    pages = table(spark, sf_dir, "pages")
    archive = write_archives(pages, scratch_path(spark, "archive"))
    found = with_referred_sizes(lookup(archive, pages))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
