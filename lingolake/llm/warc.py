"""Web archives: pages become WARC records, one gzip member each, and archives are read back in byte ranges.

Writing: of pages with equal payloads the one with the smallest id is a response and others are revisits that refer to it. Smallest ids
of payloads that occur more than once are counted first and written as a table, so a payload that many pages share is an ordinary
skewed join. Each task writes its own files and returns a row for each that it has closed; the table of these rows is the archive.
A lost or repeated task leaves a file that no row names, so it is never read.

Reading: files are cut into ranges, a task each. It looks for the first bytes of a gzip member and takes a place for a record if the
member decodes to a WARC header; members that start in the range are its own, and the last one is read past the range's end. After a member the next one
is expected at once; where none is, the search goes on. A payload may hold an archive that was stored as it is, and a range may start within it:
members that lie inside another one are dropped afterwards (`outermost`), by places alone.

Defined results: a null html is an empty payload, equal to an empty one. Where every id of a group is null, and for rows that repeat the
smallest id, all are responses; a null id is otherwise a revisit. Ids and urls are percent-encoded; a null url is left out. Repeated rows are
records of their own. An empty table gives an archive without files, and no rows. Columns of the input but id, url and html are not read. A member with a WARC
header that does not decode to its end raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import new_path
from .shared import give_back, materialize, table

#: Compressed bytes after which a task begins another file, and bytes of a range that a task reads.
FILE_BYTES, SPLIT_BYTES = 256 << 20, 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_WINDOW, _PIECE = 4 << 20, 16 << 10
_URN = "urn:x-page:"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and its name there. Paths without a scheme are local ones; s3a is what Hadoop calls s3."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if ":/" in uri else "file://" + uri)


def record(kind: str, key: str, url: str | None, digest: str, refers: str | None, payload: bytes, size: int, date: str = DATE) -> bytes:
    """One record: an HTTP response whose body a revisit leaves out; its HTTP header gives the whole payload's bytes in both."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_URN}{key}:{digest}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"]),
        *([f"WARC-Refers-To: <{_URN}{refers}:{digest}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _text(value: str | None) -> str:
    return "" if value is None else quote(value, safe="")


def write_warc(pages: DataFrame, name: str = "warc", key: str = "page_id", url: str = "url", body: str = "html", least: int = 0, level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each page to new files in the shared folder; the table of files (file, bytes, records).

    Payloads of fewer than `least` bytes are all responses."""
    folder = new_path(pages.sparkSession, name)
    payload = F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = materialize(groups.filter("n > 1 and first is not null").select("sha1", "first"), "shared-payloads")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    named = rows.join(shared, "sha1", "left").select(F.col("id").cast("string"), "url", "payload", "sha1", F.when(F.col("first").isNotNull(), refers).cast("string").alias("refers"))

    def write(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part, out, size, records = TaskContext.get().partitionId(), None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["file", "bytes", "records"])

        for batch in batches:
            for k in range(batch.num_rows):  # one page at a time: payloads may be long
                id_, at, payload, sha1, refers = (batch.column(c)[k].as_py() for c in ("id", "url", "payload", "sha1", "refers"))
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                kind = "response" if refers is None else "revisit"
                packed = member(record(kind, _text(id_), at, digest, _text(refers), payload if refers is None else b"", len(payload)), level)
                if out is None:
                    file, size, records = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{file}", compression=None)
                out.write(packed)
                size, records = size + len(packed), records + 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()
        give_back()

    files = materialize(named.mapInArrow(write, "file string, bytes long, records long"), "warc-files")
    return files.select(F.concat(F.lit(folder + "/"), "file").alias("file"), "bytes", "records")


def list_warc(spark: SparkSession, path: str) -> DataFrame:
    """Files (file, bytes) of a path or pattern, listed by Spark without reading them."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


class _Reader:
    """A file from some place on, a window at a time."""

    def __init__(self, handle, size: int) -> None:
        self.handle, self.size, self.start, self.data = handle, size, 0, b""

    def at(self, place: int, n: int) -> memoryview:
        """n bytes from a place, or fewer at the file's end."""
        n = min(n, self.size - place)
        if place < self.start or place + n > self.start + len(self.data):
            self.handle.seek(place)
            self.start, self.data = place, self.handle.read(max(n, _WINDOW))
        return memoryview(self.data)[place - self.start : place - self.start + n]

    def find(self, place: int, end: int) -> int:
        """The first place from here, before `end`, where a gzip member may begin; or -1."""
        while place < end:
            n = len(self.at(place, min(_WINDOW, end + len(_MAGIC) - 1 - place)))
            low = place - self.start
            found = self.data.find(_MAGIC, low, low + n)  # in the window itself, which is not copied
            if found >= 0:
                return self.start + found
            if n < len(_MAGIC):
                return -1
            place += n - len(_MAGIC) + 1
        return -1

    def member(self, place: int) -> tuple[bytes, int] | None:
        """What a member decodes to, and where it ends; None if none with a WARC header begins here."""
        unpacker, parts, at, good, total = zlib.decompressobj(31), [], place, False, 0
        while not unpacker.eof:
            piece = self.at(at, _PIECE)
            at += len(piece)
            try:
                parts.append(unpacker.decompress(piece))
            except zlib.error as error:
                if good:
                    raise ValueError(f"a damaged record at {place}: {error}") from error
                return None
            total += len(parts[-1])
            if not good and (total >= 5 or unpacker.eof):
                head = b"".join(parts)
                if not head.startswith(b"WARC/"):
                    return None
                parts, good = [head], True
            if not len(piece) and not unpacker.eof:
                if good:
                    raise ValueError(f"a record at {place} has no end")
                return None
        return b"".join(parts), at - len(unpacker.unused_data)


def members(handle, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """Place, bytes and content of the members with a WARC header that begin in a range."""
    reader, place = _Reader(handle, size), start
    while place < end:
        place = reader.find(place, end)
        if place < 0:
            return
        found = reader.member(place)
        if found is None:
            place += 1
            continue
        yield place, found[1] - place, found[0]
        place = found[1]


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return found


def parsed(data: bytes) -> dict:
    """A record's fields, its payload (None for a revisit) and the payload's bytes and SHA-1 (those that a revisit states)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head.split(b"\r\n")[1:])
    block = rest[: int(fields.get("content-length", 0))]
    http, payload = {}, block
    if fields.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(top.split(b"\r\n")[1:])
    revisit = fields.get("warc-type") == "revisit"
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = http.get("content-length", "")
    return {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id", "").strip("<>") or None,
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "refers_to_id": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload": None if revisit else payload,
        "payload_bytes": (int(size) if size.isdigit() else None) if revisit else len(payload),
        "payload_digest": stated if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "stated_digest": stated,
    }


_READ = "file string, offset long, length long, record_type string, record_id string, target_uri string, date string, refers_to_id string, payload binary, payload_bytes long, payload_digest string, stated_digest string"


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of archives (file, bytes), in ranges of `split_bytes`; without `payloads` that column is null, and rows are small."""
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0))).first()[0]
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.filter("bytes > 0").select("file", "bytes", F.explode(starts).alias("start")).repartition(max(1, n), "file", "start")
    names = [f.split(" ")[0] for f in _READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64(), pa.string(), pa.string()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names)

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for file, size, start in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "start"))):
                store, path = _store(file)
                with store.open_input_file(path) as handle:
                    for offset, length, data in members(handle, size, start, min(start + split_bytes, size)):
                        row = parsed(data) | {"file": file, "offset": offset, "length": length}
                        held += len(row["payload"] or b"") if payloads else 0
                        rows.append(row if payloads else row | {"payload": None})
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
        if rows:
            yield packed(rows)
        give_back()

    return ranges.mapInArrow(read, _READ)


def outermost(records: DataFrame) -> DataFrame:
    """Records that do not begin inside another one of their file. One file's records are in order in one task, by place and length."""
    w = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.col("offset") + F.col("length")).over(w)
    return records.withColumn("_ends", ends).filter(F.col("_ends").isNull() | (F.col("_ends") <= F.col("offset"))).drop("_ends")


def page_of(record_id: Column) -> Column:
    """The page's id as text, from a record's."""
    found = F.regexp_extract(record_id, f"^{_URN}([^:]*):", 1)
    return F.when(record_id.isNotNull() & (found != ""), F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def op13_archive(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = outermost(read_warc(write_warc(pages), payloads=False))
    kind = pages.schema["page_id"].dataType
    return records.select(
        page_of(F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to_id")).cast(kind).alias("refers_to")
    )


_BITS = "CAST(instr('123456789abcdef', substr(h, CAST(i * 5 // 4 + {} AS BIGINT), 1)) AS BIGINT)"

OP13_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((({_BITS.format(1)} << 4) + {_BITS.format(2)}) >> CAST(3 - i * 5 % 4 AS BIGINT)) & 31), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)"""
