"""Packs documents into training sequences by order-preserving dynamic programming.

The documents of an input partition form one token stream in their stored order.  A window is a stretch of the stream
of at most ``window`` tokens; the programme chooses the cuts.  A cut at a document end is free, one at a sentence end
or at any other token costs a penalty in tokens, and each window costs its padding, ``window`` minus its length.
With ``best[j]`` the least cost of a packing that ends at candidate j::

    best[j] = penalty[j] + min(best[i] + window - (place[j] - place[i]))   over place[j] - place[i] <= window

The last window of a partition alone may be shorter than ``window`` at no cost, where its length is a power of two.
``best[i] + place[i]`` is all that depends on i, so the minimum over the sliding window comes from a monotone queue:
each candidate enters and leaves it once.  Candidates are document ends, sentence ends, and hard cuts: the places one
window after another candidate, so that a full window is possible from each document or sentence end.

No shuffle: a partition is packed where it is read.  The stream is cut into stretches of ``stretch`` tokens; the
windows before the last one of a stretch are final, the rest begins the next stretch, so memory stays bounded for any
partition and any document.  Rows of a file scan keep their order when a task runs again, so results are stable.

Defined results: a null text is an empty one, whose only token is the end id; null or repeated ids are packed row by
row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
SENTENCE_PENALTY = 2.0
TOKEN_PENALTY = 12.0
STRETCH = 64 * WINDOW

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

_tokenizers: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokenizer:
    """Ids of a byte-level BPE file.

    Where the rank file of the same vocabulary lies beside it, the faster of the two libraries encodes; both give the
    same ids.  Texts with unbroken runs of over 1,000 characters, whose merging it does in quadratic time, and texts
    that hold a control string go to the other library.
    """

    def __init__(self, path: str):
        self.path, self._slow, self.fast = path, None, None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = [t["content"] for t in content["added_tokens"]]
        words = content["model"]["vocab"]
        self.ends_sentence = np.zeros(max(words.values()) + len(self.special) + 1, bool)
        for word, i in words.items():
            # a byte-level vocabulary writes a line feed as Ċ
            self.ends_sentence[i] = "Ċ" in word or word.rstrip("\"')]")[-1:] in (".", "!", "?")
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges,
                                          special_tokens={})

    @property
    def slow(self):
        if self._slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or self._long_run(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    @staticmethod
    def _long_run(text: str) -> bool:
        """Whether a run of word or of space characters may have 1,000 of them."""
        if len(text) < 1000:
            return False
        lengths = [len(w) for w in text.split()]
        return max(lengths, default=0) >= 1000 or len(text) - sum(lengths) - len(lengths) >= 900


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def candidates(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int,
               sentence_penalty: float, token_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places 0..total where a window may end, and their penalties."""
    soft = np.unique(np.concatenate([[0, total], doc_ends, sentence_ends]))
    # a full window from every cut of either kind, and whole windows through stretches without any sentence end
    hard = [soft + window]
    for k in np.flatnonzero(np.diff(soft) > window):
        hard.append(np.arange(soft[k], soft[k + 1], window))
    places = np.unique(np.concatenate([soft, *hard]))
    places = places[places <= total]
    penalty = np.full(len(places), token_penalty)
    penalty[np.isin(places, sentence_ends, assume_unique=False)] = sentence_penalty
    penalty[np.isin(places, doc_ends, assume_unique=False)] = 0.0
    penalty[0] = 0.0
    return places, penalty


def cuts(places: np.ndarray, penalty: np.ndarray, window: int, last: bool = True) -> list[int]:
    """Places of the least-cost cuts, the first and the last place included.

    Unless it is the ``last`` window of all, the final one stays open: tokens that follow fill it, so it costs nothing.
    """
    p, pen = places.tolist(), penalty.tolist()
    n = len(p)
    best, before = [0.0] * n, [0] * n
    index = {place: i for i, place in enumerate(p)}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # best[i] + p[i], rising from left to right
    for j in range(1, n):
        at = p[j]
        while p[queue[0][1]] < at - window:
            queue.popleft()
        key, i = queue[0]
        cost = key + window - at
        if j == n - 1 and not last:
            cost, i = min((best[k], k) for _, k in queue)
        for s in powers if last and j == n - 1 else ():  # the last window: a power of two needs no padding
            k = index.get(at - s)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        best[j] = cost + pen[j]
        before[j] = i
        key = best[j] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [p[-1]], n - 1
    while j > 0:
        j = before[j]
        out.append(p[j])
    return out[::-1]


class _Stream:
    """The token stream of one partition: takes documents, gives finished pieces."""

    def __init__(self, first_sequence: int, ends_sentence: np.ndarray, window: int, stretch: int,
                 sentence_penalty: float, token_penalty: float):
        self.next, self.marks = first_sequence, ends_sentence
        self.window, self.stretch = window, max(stretch, 2 * window)
        self.penalties = (sentence_penalty, token_penalty)
        self.docs: deque[list] = deque()  # [doc_id, ids, tokens already given]
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        while self.held >= 2 * self.stretch:
            yield from self.pack(self.stretch, last=False)

    def pack(self, total: int, last: bool) -> Iterator[tuple]:
        """Pack the first ``total`` tokens; unless it is the last stretch, leave its last window open."""
        parts, ends, seen = [], [], 0
        for _, ids, given in self.docs:
            part = ids[given:given + total - seen]
            parts.append(part)
            seen += len(part)
            if given + len(part) == len(ids):
                ends.append(seen)
            if seen == total:
                break
        if not seen:
            return
        stream = np.concatenate(parts)
        doc_ends = np.array(ends, np.int64)
        sentence_ends = np.flatnonzero(self.marks[stream]) + 1
        where = cuts(*candidates(seen, doc_ends, sentence_ends, self.window, *self.penalties), self.window, last)
        for a, b in zip(where[:-1] if last else where[:-2], where[1:], strict=False):
            yield from self._window(b - a)

    def _window(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            doc = self.docs[0]
            doc_id, ids, given = doc
            piece = ids[given:given + length - offset]
            crc = zlib.crc32(piece.astype("<u4").tobytes())
            yield doc_id, given, len(piece), crc, len(ids), self.next, offset
            offset += len(piece)
            self.held -= len(piece)
            if given + len(piece) == len(ids):
                self.docs.popleft()
            else:
                doc[2] = given + len(piece)
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        while self.held > self.stretch:
            yield from self.pack(self.stretch, last=False)
        yield from self.pack(self.held, last=True)


def pack(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", doc_id: str = "doc_id",
         window: int = WINDOW, stretch: int = STRETCH, sentence_penalty: float = SENTENCE_PENALTY,
         token_penalty: float = TOKEN_PENALTY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence_id`` holds the partition above bit 40 and a running number below.
    """
    path = tokenizer_path or default_tokenizer()
    columns = SCHEMA.replace("doc_id", doc_id)
    names = [c.split()[0] for c in columns.split(", ")]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        stream = _Stream(TaskContext.get().partitionId() << 40, encoder.ends_sentence, window, stretch,
                         sentence_penalty, token_penalty)
        rows: list[tuple] = []

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encoder.encode(t.as_py() or ""), np.uint32(END_ID))
                rows.extend(stream.add(i.as_py(), ids))
                if len(rows) >= 20000:
                    yield full()
        rows.extend(stream.finish())
        if rows:
            yield full()

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias("_text")).mapInArrow(run, columns)
