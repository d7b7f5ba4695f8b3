"""Members of ``.zip`` attachments, nested archives included."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text

_ROWS = ("message_id string, att_ord int, archive string, seq int, depth int, rel_dir string, "
         "member string, unsafe boolean, content binary, reason string")


_FLUSH_BYTES = 16 << 20  # bytes of members per output batch


def _members(data: bytes, name: str, folder: str, depth: int, limit: int, skip: tuple):
    """Yield ``(depth, folder, member, unsafe, content, reason)`` of one archive."""
    if depth >= limit:
        yield depth, folder, None, False, None, f"zip nested deeper than {limit} levels: {name}"
        return
    nested, unsafe = [], []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as zf:
            infos = zf.infolist()
            if any(i.flag_bits & 1 for i in infos):
                yield depth, folder, None, False, None, f"password-protected zip: {name}"
                return
            for info in infos:
                path = info.filename.replace("\\", "/")
                steps = [p for p in path.split("/") if p not in ("", ".", "..")]
                if info.is_dir() or not steps:
                    continue
                risky = path.startswith("/") or ".." in path.split("/")
                if risky:
                    unsafe.append(info.filename)
                if steps[-1].lower() in skip:
                    continue
                where = "/".join(([folder] if folder else []) + steps[:-1])
                content = zf.read(info)
                if steps[-1].lower().endswith(".zip"):
                    nested.append((content, steps[-1], where))
                else:
                    yield depth, where, steps[-1], risky, content, None
    except zipfile.BadZipFile:
        yield depth, folder, None, False, None, f"unreadable or corrupt zip: {name}"
        return
    except Exception as e:
        yield depth, folder, None, False, None, f"failed extracting {name}: {e}"
        return
    if unsafe:
        yield (depth, folder, None, True, None,
               f"unsafe path(s) in zip {name} (contained, not extracted outside): {unsafe[:3]}")
    for content, inner, where in nested:
        yield from _members(content, inner, where, depth + 1, limit, skip)


def _expand(limit: int, skip: tuple):
    schema = pa.schema([
        ("message_id", pa.string()), ("att_ord", pa.int32()), ("archive", pa.string()), ("seq", pa.int32()),
        ("depth", pa.int32()), ("rel_dir", pa.string()), ("member", pa.string()), ("unsafe", pa.bool_()),
        ("content", pa.binary()), ("reason", pa.string())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for a in batch.to_pylist():
                for seq, row in enumerate(_members(a["content"], a["file_name"], "", 0, limit, skip)):
                    rows.append((a["message_id"], a["att_ord"], a["file_name"], seq, *row))
                    size += len(row[4] or b"")
                    if size > _FLUSH_BYTES:
                        yield table(rows)
                        rows, size = [], 0
            if rows:
                yield table(rows)
    return run


def expand_zip(attachments: DataFrame, limit: int = lx.MAX_ZIP_DEPTH) -> DataFrame:
    """One row per member, and one per reason to hold the message back.

    Input ``message_id, att_ord, file_name, content``.  Member rows carry the folder
    path (each part cleaned), a clean file name and the bytes; reason rows carry only
    ``reason``.
    """
    zips = attachments.where(F.lower(text.file_suffix("file_name")).isin(lx.ZIP_TYPES)).select(
        F.col("message_id").cast("string").alias("message_id"), F.col("att_ord").cast("int").alias("att_ord"),
        "file_name", "content")
    rows = zips.mapInArrow(_expand(limit, tuple(lx.SKIP_ATTACHMENTS)), _ROWS)
    parts = F.filter(F.split("rel_dir", "/"), lambda p: p != "")
    return rows.withColumn("rel_dir", F.array_join(
        F.transform(parts, lambda p: text.sanitize_folder(p, "folder")), "/")).withColumn(
        "file_name", F.when(F.col("member").isNotNull(), text.sanitize_file("member", "extracted")))
