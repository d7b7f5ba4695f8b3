"""Mail files (``.eml``) as message and attachment rows."""

from __future__ import annotations

import email.policy
from email.parser import BytesParser
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ordering import dense_positions
from . import archives

_PARSED = ("path string, subject string, sender string, date string, body string, error string, "
           "attachments array<struct<att_ord:int,file_name:string,content:binary>>")


_FLUSH_BYTES = 16 << 20  # bytes of mail per output batch


# parsed headers are never changed, so one that is asked for again (a part's are, about ten times) need not be parsed again
_header = lru_cache(maxsize=1 << 10)(email.policy.default.header_fetch_parse)


class _ParsedOnce(email.policy.EmailPolicy):
    """The default policy, which parses a header whenever it is asked for, with the last ones kept."""

    def header_fetch_parse(self, name, value):
        return value if hasattr(value, "name") else _header(name, value)


_POLICY = _ParsedOnce()


def _content(part) -> str:
    try:
        return part.get_content()
    except Exception:
        return str(part.get_payload(decode=True))


def _read_one(path: str, raw: bytes) -> dict:
    row = {"path": path, "subject": "", "sender": "", "date": "", "body": "", "error": None, "attachments": []}
    try:
        msg = BytesParser(policy=_POLICY).parsebytes(raw)
        row.update(subject=str(msg.get("subject", "") or ""), sender=str(msg.get("from", "") or ""),
                   date=str(msg.get("date", "") or ""))
        body = msg.get_body(preferencelist=("plain",))
        if body is not None:
            row["body"] = _content(body)
        elif not msg.is_multipart():
            row["body"] = _content(msg)
        kept = []
        for part in msg.iter_attachments():
            # inline parts (logos, tracking pixels) are no attachments
            name = part.get_filename() if part.get_content_disposition() == "attachment" else None
            data = part.get_payload(decode=True) if name else None
            if data is not None:
                kept.append({"att_ord": len(kept) + 1, "file_name": name, "content": data})
        row["attachments"] = kept
    except Exception as e:  # one bad file is one error row, never a failed run
        row.update(error=str(e) or type(e).__name__, attachments=[])
    return row


def _parse(batches):
    schema = pa.schema([
        ("path", pa.string()), ("subject", pa.string()), ("sender", pa.string()), ("date", pa.string()),
        ("body", pa.string()), ("error", pa.string()),
        ("attachments", pa.list_(pa.struct([("att_ord", pa.int32()), ("file_name", pa.string()),
                                            ("content", pa.binary())])))])
    for batch in batches:
        rows, size = [], 0
        for path, raw in zip(batch.column("path"), batch.column("content")):
            raw = raw.as_py()
            rows.append(_read_one(path.as_py(), raw))
            size += len(raw)
            if size > _FLUSH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_mail_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of the ``.eml`` files of an inbox."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][mM][lL]").load(root)
            .select("path", "content"))


def parse_eml(files: DataFrame) -> DataFrame:
    """One row per file with headers, plain body and an attachment array.

    Mails are dealt to tasks by their number: parsing takes far longer than reading, and many mails may lie in one split.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = files.select("path", "content").repartition(tasks).mapInArrow(_parse, _PARSED)
    received = text.date_to_iso("date")
    return parsed.select(
        F.col("path").alias("message_id"), text.base_name("path").alias("file_name"),
        text.strip("subject").alias("subject"), "body", text.parse_sender("sender").alias("s"),
        received.alias("received_raw"), text.iso_to_timestamp(received).alias("received_at"), "error", "attachments",
        text.sanitize_folder("subject", text.sanitize_folder(text.file_stem("path"), "message")).alias("folder_stem"),
    ).select("message_id", "file_name", "subject", "body", "s.*", "received_raw", "received_at", "error",
             "attachments", "folder_stem")


def messages(parsed: DataFrame) -> DataFrame:
    return parsed.drop("attachments")


def attachments(parsed: DataFrame) -> DataFrame:
    """One row per attachment, with its bytes and a clean file name."""
    return (parsed.select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.*")
            .withColumn("clean_name", text.sanitize_file(
                "file_name", F.concat(F.lit("attachment_"), F.col("att_ord").cast("string")))))


def run_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``messages, attachments, members`` as a run takes them, from :func:`parse_eml`.

    Mails stand in the order of their paths.  A file that is no mail holds no message.  No probe for locked files is
    built in, so none counts as locked.
    """
    good = dense_positions(parsed.where(F.col("error").isNull()), ["message_id"], "msg_ord")
    mails = good.select("message_id", "msg_ord", "subject", "body", F.col("message_id").alias("msg_path"), "folder_stem")
    files = good.select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.*")
    listed = files.select("message_id", F.col("att_ord").cast("long").alias("att_ord"), "file_name",
                          F.lit(True).alias("is_binary"), F.lit(False).alias("is_locked"))
    members = archives.expand_zip(files).select(
        "message_id", F.col("att_ord").cast("long").alias("att_ord"), F.col("seq").cast("long").alias("seq"), "rel_dir",
        "file_name", F.lit(False).alias("is_locked"), "reason")
    return mails, listed, members
