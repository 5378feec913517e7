"""WARC archives whose records are compressed one by one with a shared dictionary (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm.bloom import filter_of_ids
from haulspark.llm.common import Scratch

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_FRAME = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train_dictionary(numbered: DataFrame, date: str, most_records: int = 1000, most_bytes: int = 8 << 20, dictionary_bytes: int = 64 << 10) -> bytes:
    """A dictionary from a bounded sample of whole archived records, heads and payloads.

    The sample is at most ``most_records`` records in the order of a hash of their rows, as far as they fit in
    ``most_bytes`` together; a record that does not fit is passed over. Where a sample is too small to train on, its
    bytes are the dictionary. ``numbered`` has ``row, page_id, url, html, sha1, size``.
    """
    share = 1 << 30
    most = min(share, max(1, 2 * most_records * share // max(numbered.count(), 1)))
    order = F.pmod(F.xxhash64("row"), F.lit(share))
    told = numbered.where(order < most).select("row", "size", order.alias("place")).orderBy("place", "row").limit(2 * most_records).collect()
    rows, held = [], 0
    for r in told:
        if len(rows) < most_records and held + r["size"] <= most_bytes:
            rows.append(r["row"])
            held += r["size"]
    picked = numbered.where(F.col("row").isin(rows)).select("row", "page_id", "url", "html", "sha1").collect() if rows else []
    samples = [warc_record(f"row:{r['row']}", r["page_id"], r["url"], bytes(r["html"] or b""), len(r["html"] or b""), _base32(r["sha1"]), None, date) for r in sorted(picked, key=lambda r: r["row"])]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-dictionary_bytes:]


def _base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_record(name: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: tuple[int, str] | None, date: str) -> bytes:
    """One WARC/1.1 record, its id made of ``name``; a revisit keeps the HTTP head and points at the record that has the payload.

    ``refers_to`` is the page and the name of that record; ``size`` is the payload's, which a revisit does not hold.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(name)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to[1])), ("X-Refers-To-Page", str(refers_to[0]))] if refers_to is not None else []),
        ("X-Page", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


_FILES = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _writer(folder: str, run_name: str, dictionary: bytes, date: str, level: int, most_bytes: int, revisits: Broadcast | None):
    """Writes the rows of each task; with ``revisits``, a filter of row numbers, only those that it tells are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=level)
        out, name, size, records, number = None, "", 0, 0, 0
        for batch in batches:
            if revisits is not None:
                batch = batch.filter(pa.array(~revisits.value.holds_ids(batch.column("row").to_numpy())))
            columns = (batch.column(c) for c in ("row", "page_id", "url", "sha1", "size", "refers_to", "refers_row", "html"))
            for row, page, url, sha1, n, refers, refers_row, html in zip(*columns, strict=True):
                if out is None:
                    # the attempt is part of the name: what a lost attempt wrote is never read, as no list names it
                    name = f"{run_name}-{task.stageId():05d}-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    out, size, records, number = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0, number + 1
                    if dictionary:
                        size += out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                to = (refers.as_py(), f"{run_name}:{refers_row.as_py()}") if refers.is_valid else None
                record = warc_record(f"{run_name}:{row.as_py()}", page.as_py(), url.as_py(), (html.as_py() or b"") if to is None else None, n.as_py(), _base32(sha1.as_py()), to, date)
                size += out.write(compressor.compress(record))
                records += 1
                if size >= most_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], schema=_FILES)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], schema=_FILES)

    return run


def _maybe(revisits: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(revisits.value.holds_ids(batch.column("row").to_numpy())))

    return run


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3, most_bytes: int = 32 << 20) -> DataFrame:
    """Archive ``page_id, url, html`` under ``folder``, a shared one by any URI that pyarrow reads; returns ``file, records, bytes``.

    Each row is one record with a record id of its own. Payloads are the html in UTF-8, a null one empty. Of records
    with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a response and the others
    are revisits of it; rows that repeat that id are responses too, and so is a row without an id; revisits refer to
    one of the rows that repeat it. Smaller payloads are all responses. A null url becomes ``urn:page:<id>``. Archives
    are closed at about ``most_bytes``; each begins with the dictionary in a skippable frame and goes on with one
    Zstandard frame a record. No rows give no archive.

    Rows are numbered and written once, and roles found on digests. Revisits are written without their html; a filter
    of their numbers lets the responses be written where they lie, and only rows that the filter cannot tell from
    revisits are shuffled to be told by a join.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc-roles")
    data = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    numbered = scratch.save(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("html"))
        .select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html", F.sha1("html").alias("sha1"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size")),
        "numbered",
    )
    same = ["sha1", "sha256", "size"]
    keyed = numbered.select("row", "page_id", "url", *same)
    newest = F.max(F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id"), (-F.col("row")).alias("minus_row")))).alias("newest")
    latest = scratch.save(keyed.where(F.col("size") >= least_bytes).groupBy(*same).agg(newest, F.count("*").alias("n")).where("n > 1 and newest is not null").select(*same, "newest.page_id", "newest.minus_row"), "latest")
    revisits = scratch.save(
        keyed.alias("k").join(latest.withColumnRenamed("page_id", "refers_to"), same).where("page_id < refers_to")
        .select("row", "page_id", "url", "sha1", "size", "refers_to", (-F.col("minus_row")).alias("refers_row"), F.lit(None).cast("binary").alias("html")),
        "revisits",
    )
    told = spark.sparkContext.broadcast(filter_of_ids(revisits.select(F.col("row").alias("id")), revisits.count()))
    dictionary = train_dictionary(numbered, date)
    run_name = uuid.uuid4().hex
    none = [F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("long").alias("refers_row")]
    whole = numbered.select("row", "page_id", "url", "sha1", "size", *none, "html")
    unsure = whole.mapInArrow(_maybe(told), whole.schema).join(revisits.select("row"), "row", "left_anti").select(*whole.columns)
    ddl = "file string, records long, bytes long"
    write = lambda rows, only=None: rows.mapInArrow(_writer(folder, run_name, dictionary, date, level, most_bytes, only), ddl)
    files = scratch.save(write(whole, told).union(write(revisits.select(*whole.columns))).union(write(unsure)), "files")
    scratch.drop("numbered", "latest", "revisits")
    return files


def _frames(data: memoryview) -> Iterator[bytes]:
    """Decompressed frames of an archive, which may begin with its dictionary."""
    at, dictionary = 0, None
    magic, size = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    if magic == DICTIONARY_FRAME:
        dictionary, at = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])), 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            piece = data[at : at + 8192]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (the block after its HTTP head) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("payload", pa.binary())])


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                cols: list[list] = [[] for _ in _READ]
                held = 0
                for record in _frames(memoryview(content.as_buffer())):
                    fields, payload = parse_record(record)
                    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
                    page, refers = fields["X-Page"], fields.get("X-Refers-To-Page")
                    size = int(fields["X-Payload-Length"]) if revisit else len(payload)
                    for out, v in zip(cols, (int(page) if page else None, size, digest, fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Target-URI"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), payload if with_payload and not revisit else None), strict=True):
                        out.append(v)
                    held += len(payload) if with_payload else 100
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _READ, strict=True)], schema=_READ)
                        cols, held = [[] for _ in _READ], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _READ, strict=True)], schema=_READ)

    return run


def read_warc(spark: SparkSession, folder: str, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, refers_to_record, payload`` of the archives that ``files`` names.

    Every response's payload is checked against its digest; a revisit's payload is null.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_record string, payload binary"
    if files.isEmpty():
        return spark.createDataFrame([], schema)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = archives.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(files.select("file"), "file", "left_semi").select("content")
    return named.mapInArrow(_reader(with_payload), schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.path}/archives"
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder, files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex, max(page_id) over (partition by payload) as latest from p)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest,
       case when page_id = latest then 'response' else 'revisit' end as record_type, case when page_id <> latest then latest end as refers_to
from h
"""
