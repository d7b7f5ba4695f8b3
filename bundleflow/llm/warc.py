"""Dictionary-compressed WARC archives: writer and reader.

Payload digests decide first which record of equal payloads is the response and which ones revisit it.  Each task then
writes its pages to archives of about ``roll`` payload bytes.  An archive begins with a skippable frame (magic
0x184D2A5D) that holds a Zstandard dictionary built from the archive's own records; every record follows as a frame of
its own, so any record can be read with the dictionary and its place alone.

Archives are written by the tasks through pyarrow's file systems (local or mounted folders, object stores), under names
that hold the number of the attempt.  Spark commits a manifest of the attempts that counted, and the reader opens only
archives that the manifest lists, so what a lost or repeated attempt left is never read.

Defined results: a null html is an empty payload; payloads of fewer than 100 bytes are always responses; rows that
repeat the smallest page id of a payload are responses too, since nothing tells them apart; pages without id can revisit
but are never referred to, and equal payloads of which none has an id are all responses; a null url is left out;
an empty table gives no archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder

# Format of the archives.
DICT_MAGIC = 0x184D2A5D
LEAST_REVISIT = 100
ROLL_BYTES = 8 << 20
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # nothing reads the clock, so a task that runs again writes the same bytes


def with_roles(pages: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to (null: response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = (pages.select("page_id", "url", payload.alias("html"))
             .withColumn("payload_bytes", F.octet_length("html").cast("long"))
             .withColumn("payload_digest", F.sha2("html", 256)))
    first = (sized.where(F.col("payload_bytes") >= LEAST_REVISIT)
             .groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
             .where("copies > 1").select("payload_digest", "first_id"))
    return (sized.join(first, "payload_digest", "left")
            .withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")),
                                            F.col("first_id")))
            .drop("first_id"))


def _record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, which names the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if refers_to is not None else http + html
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]):
    """A dictionary from evenly spread records of the archive; None where they are too few or too alike to train on."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    samples = [r[:64 << 10] for r in records[::step]]
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 512:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return None


def archive_frames(records: list[bytes]) -> Iterator[bytes]:
    """The frames of one archive: dictionary, then a frame per record."""
    import zstandard

    trained = train_dictionary(records)
    body = trained.as_bytes() if trained else b""
    yield struct.pack("<II", DICT_MAGIC, len(body)) + body
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True,
                                          write_checksum=True)
    for r in records:
        yield compressor.compress(r)


def write(pages: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives below ``folder``; returns the manifest (archive, records, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        context = TaskContext.get()
        records: list[bytes] = []
        held = number = 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal held, number
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:05d}.warc.zst"
            size = 0
            with store.open_output_stream(f"{root}/archives/{name}", compression=None) as out:
                for frame in archive_frames(records):
                    out.write(frame)
                    size += len(frame)
            done.append((name, len(records), size))
            records.clear()
            held, number = 0, number + 1

        for batch in batches:
            for page in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to")),
                            strict=True):
                page_id, url, html, digest, refers_to = (v.as_py() for v in page)
                records.append(_record(page_id, url, html.encode(), digest, refers_to))
                held += len(records[-1])
                if held >= roll:
                    close()
        if records:
            close()
        yield pa.RecordBatch.from_pydict({"archive": [d[0] for d in done], "records": [d[1] for d in done],
                                          "bytes": [d[2] for d in done]},
                                         pa.schema([("archive", pa.string()), ("records", pa.int64()),
                                                    ("bytes", pa.int64())]))

    store, root = _store(folder)
    store.create_dir(f"{root}/archives", recursive=True)
    manifest = f"{folder}/manifest"
    with_roles(pages).mapInArrow(run, "archive string, records long, bytes long").write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def records(content: bytes) -> Iterator[bytes]:
    """The records of one archive, in order."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != DICT_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    body = content[8:8 + size]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
    rest = memoryview(content)[8 + size:]
    while rest:
        one = reader.decompressobj()
        yield one.decompress(rest)
        rest = memoryview(one.unused_data)


def _parse(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its header")
    ids = [fields.get(k, "").removeprefix("<urn:page:").rstrip(">") for k in ("WARC-Record-ID", "WARC-Refers-To")]
    return (*[int(i) if i else None for i in ids], fields.get("WARC-Target-URI"), kind, length, digest,
            payload if kind == "response" else None)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record: page_id, refers_to, url, record_type, payload_bytes, payload_digest (checked), and the payload."""
    schema = pa.schema([("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()),
                        ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        *([("payload", pa.binary())] if payloads else [])])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/archives/{name}") as file:
                    content = file.read()
                rows: list[tuple] = []
                for record in records(content):
                    rows.append(_parse(record)[:len(schema)])
                    if len(rows) == 1000:
                        yield table(rows)
                        rows.clear()
                if rows:
                    yield table(rows)

    columns = ("page_id long, refers_to long, url string, record_type string, payload_bytes long, payload_digest string"
               + ", payload binary" * payloads)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return (spark.read.parquet(f"{folder}/manifest").select("archive").repartition(tasks)
            .mapInArrow(run, columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to a new shared folder and read them back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder, payloads=False)
