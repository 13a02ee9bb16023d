"""Web archives in ZIP packages: written by Spark, read back by byte ranges.

A package is one ZIP file whose members are stored, not compressed: `archive/data.warc.gz` with
one gzip member per WARC record, and `indexes/index.cdxj` with the place of each record. A reader
finds both through the central (or ZIP64) directory and range-reads single records; nothing is
extracted. Packages hold about `package_bytes` of records, or one longer record.

Records with equal payloads of at least `LEAST` bytes are stored once: the one with the smallest
page_id is a response, the others are revisits that name it. A third of all pages may share a
payload: the smallest id comes from an aggregation that collapses on the map side, and the table
of repeated digests is joined by broadcast below a checked size and with salted hot keys beyond.

A null html is an empty payload. A null page_id ranks after all others and stays null; where all
of a group are null the first row is the response. Of rows that repeat the smallest page_id of a
group one is the response. A null url is left out of the record; control characters and spaces in
a url come back percent-encoded. Empty tables give no package and no record. Payloads of any
length that fits a row are one record. Columns other than page_id, url and html play no part.
page_id is cast to long; ids that are no integers raise.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import zip_archive
from tradeloom.llm.tasks import Batches, importable, map_batches, written
from tradeloom.operators.scratch import scratch_path
from tradeloom.operators.skew import find_hot_keys, lookup_join

LEAST = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2000-01-01T00:00:00Z"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PACKAGE_BYTES = 16 << 20
_LEVEL = 3
_CLOSE = b"\n"  # Spark's text writer ends each row so; it is the comment of the ZIP file
_RECORDS = (
    "path string, offset long, length long, record_type string, page_id long, url string, payload_digest string,"
    " payload_bytes long, refers_to long, payload binary"
)
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in map(str.split, _RECORDS.split(","))])


# Writing


def decided(pages: DataFrame) -> DataFrame:
    """Per page: page_id, row, url, payload, digest, first_id, first_row; first_* name the
    response of pages that share a payload and are null for payloads that are alone."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    if own.groupBy("page_id").count().where("count > 1").take(1):
        # Rows that repeat an id are told apart by their place in a written table.
        rows = written(own.withColumn("row", F.monotonically_increasing_id()), "pages")
    else:
        rows = own.withColumn("row", F.lit(0).cast("long"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = rows.select("page_id", "row", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("first_id"), F.col("row").alias("first_row"))
    groups = keyed.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    shared = groups.where("n > 1").select("digest", "first.first_id", "first.first_row")
    shared = written(shared, "shared_payloads")
    return lookup_join(keyed, shared, "digest", lambda: find_hot_keys(keyed, "digest"), ["page_id", "row"], "left")


def _uri(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _name(page_id: int | None, row: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{row}>"


def record(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, first: tuple | None) -> bytes:
    """One WARC record; `first` is the (page_id, row) of the response that a revisit names."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {_name(page_id, row)}",
        f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first:
        head += [f"WARC-Profile: {_SAME}", f"WARC-Refers-To: {_name(*first)}"]
    block = http if first else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class _Package:
    """The records of one package, and their index lines."""

    def __init__(self) -> None:
        self.data, self.lines = bytearray(), []

    def add(self, url: str | None, digest: str, kind: str, whole: bytes) -> None:
        packed = gzip.compress(whole, _LEVEL, mtime=0)
        place = {"url": url, "digest": f"sha256:{digest}", "type": kind, "offset": len(self.data), "length": len(packed), "filename": DATA}
        self.lines.append(f"{_uri(url or '-')} {re.sub('[^0-9]', '', _DATE)} {json.dumps(place)}\n")
        self.data += packed

    def close(self, zip64: bool) -> bytes:
        members = [(DATA, bytes(self.data)), (INDEX, "".join(self.lines).encode())]
        return zip_archive.pack(members, _CLOSE, zip64)


def write_packages(pages: DataFrame, folder: str, package_bytes: int = _PACKAGE_BYTES, zip64: bool = False) -> None:
    """One ZIP file per package into `folder`, by Spark's own file commit.

    A row is one whole file: its bytes pass the text writer unchanged, and the line end that the
    writer adds is declared as the file's comment.
    """

    def run(batches: Batches) -> Batches:
        package = _Package()
        for batch in batches:
            names = ["page_id", "row", "url", "payload", "digest", "first_id", "first_row"]
            for page_id, row, url, payload, digest, first_id, first_row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                first = None if first_row is None or (first_id, first_row) == (page_id, row) else (first_id, first_row)
                package.add(url, digest, "revisit" if first else "response", record(page_id, row, url, payload, digest, first))
                if len(package.data) >= package_bytes:
                    yield pa.record_batch([pa.array([package.close(zip64)[: -len(_CLOSE)]], pa.binary())], names=["file"])
                    package = _Package()
        if package.lines:
            yield pa.record_batch([pa.array([package.close(zip64)[: -len(_CLOSE)]], pa.binary())], names=["file"])

    columns = ["page_id", "row", "url", "payload", "digest", "first_id", "first_row"]
    packages = map_batches(decided(pages), columns, run, "file binary")
    whole = packages.select(F.col("file").cast("string").alias("value"))
    whole.write.option("maxRecordsPerFile", 1).option("lineSep", _CLOSE.decode()).text(folder)


# Reading


def _index(read: zip_archive.Read, members: list[zip_archive.Member]) -> Iterator[tuple[int, int]]:
    """(offset, length) in the file of every record: from the stored indexes, or, in a package
    without one, by passing through the stored archives."""
    by_name = {m.name: m for m in members}
    start = {m.name: zip_archive.data_at(read, m) for m in members if m.name.startswith("archive/") and m.packed}
    indexes = [m for m in members if m.name.startswith("indexes/") and m.name.endswith((".cdxj", ".cdx"))]
    for member in indexes:
        for line in read(zip_archive.data_at(read, member), member.packed).decode().split("\n")[:-1]:
            place = json.loads(line.split(" ", 2)[2])
            name = place["filename"]
            name = name if name in by_name else f"archive/{name}"
            if name not in start or place_end(place) > by_name[name].packed:
                raise zip_archive.BadArchive(f"the index names bytes outside of {name}")
            yield start[name] + int(place["offset"]), int(place["length"])
    if not indexes:
        for name, at in start.items():
            yield from _passed(read, at, by_name[name].packed)


def place_end(place: dict) -> int:
    return int(place["offset"]) + int(place["length"])


def _passed(read: zip_archive.Read, at: int, size: int, step: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """The gzip members of size bytes from `at` on, found by inflating them one after another."""
    begin = here = at
    inflate = zlib.decompressobj(31)
    while here < at + size:
        rest = read(here, min(step, at + size - here))
        here += len(rest)
        while rest:
            inflate.decompress(rest)
            rest = inflate.unused_data
            if inflate.eof:
                yield begin, here - len(rest) - begin
                begin, inflate = here - len(rest), zlib.decompressobj(31)
    if begin != here:
        raise zip_archive.BadArchive("the last record is cut")


def parsed(raw: bytes) -> tuple:
    """(record_type, page_id, url, payload_digest, payload_bytes, refers_to, payload) of a record.

    The digest and length of a response are those of the bytes read; they must be as announced.
    """
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip(" ") for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    payload, size = None, int(fields["x-payload-length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise zip_archive.BadArchive(f"the payload of {fields['warc-record-id']} is damaged")
    return kind, _page(fields["warc-record-id"]), fields.get("warc-target-uri"), digest, size, _page(fields.get("warc-refers-to")), payload


def _page(name: str | None) -> int | None:
    number = (name or "::").split(":")[2]
    return int(number) if number else None


def read_packages(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of every package in `folder`, one row each; `payload` is null for revisits,
    and for all if `payloads` is false.

    Files on a mounted path are opened and read by ranges; from other stores, which only Spark
    can open, a package's bytes come as one row, and the same ranges are taken from them.
    """
    files = spark.read.format("binaryFile").load(folder)
    local = all(r["path"].startswith("file:") for r in files.select("path").limit(1).collect())

    def run(batches: Batches) -> Batches:
        for batch in batches:
            contents = batch.column("content").to_pylist() if not local else [None] * batch.num_rows
            for path, size, content in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), contents, strict=True):
                if content is None:
                    with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
                        yield from _records(path, size, lambda at, n, f=file: (f.seek(at), f.read(n))[1], payloads)
                else:
                    yield from _records(path, size, lambda at, n, c=content: c[at : at + n], payloads)

    importable(spark)
    return map_batches(files, ["path", "length", *([] if local else ["content"])], run, _RECORDS)


_FLUSH = 4 << 20


def _records(path: str, size: int, read: zip_archive.Read, payloads: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    try:
        for at, n in _index(read, zip_archive.directory(read, size)):
            *found, payload = parsed(read(at, n))
            rows.append((path, at, n, *found, payload if payloads else None))
            held += 200 + (len(payload) if payloads and payload else 0)
            if held >= _FLUSH:
                yield batch()
                rows, held = [], 0
    except (zip_archive.BadArchive, KeyError, OSError, zlib.error, EOFError) as error:
        raise zip_archive.BadArchive(f"{path}: {error!r}") from error
    if rows:
        yield batch()


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The records of all pages, written into packages and read back."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "packages")
    write_packages(pages, folder)
    return read_packages(spark, folder, payloads=False)


def query(spark: SparkSession, folder: str) -> DataFrame:
    records = round_trip(spark.read.parquet(f"{folder}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes
  FROM pages
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id
  FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN place > 1 AND payload_bytes >= {LEAST} THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN place > 1 AND payload_bytes >= {LEAST} THEN first_id END AS refers_to
FROM r
"""
