"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time.  Two GRUs read the bytes of a text, one from either
side; at every position a softmax over their two states labels the byte, and a document's probabilities are the mean
over its positions.  Texts are read whole, in segments of ``SEGMENT`` bytes; each direction warms up on the
``OVERLAP`` bytes beside its segment, so segments of all texts of a batch run side by side in one matrix.

Training takes a bounded, documented sample: per language at most ``SAMPLE_BUCKETS`` snippets of ``SNIPPET`` bytes, one
per bucket of a hash of the id, from a place in the text that the hash names.  Picking them is one aggregation that
combines before its shuffle; what reaches the driver is at most ``SAMPLE_BUCKETS`` rows for each language.

A label says which learned language is nearest, not that the text is in any of them.  ``known`` tells that: the share of
a text's neighbouring byte pairs that the training snippets hold.  Other scripts, encoded data and markup lie low.

Defined results: ``und`` with score 0 and ``known`` 0 for a null text or one without letters, and for every text when no labelled row
exists; rows with a null language never teach; a null id is not held out and teaches if it has a language; repeated
rows are predicted row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import has_letter

UNKNOWN = "und"
HIDDEN = 8
SEGMENT = 256
OVERLAP = 16
SNIPPET = 192
SAMPLE_BUCKETS = 384
STEPS = 240
BATCH = 96
TRAIN_LENGTH = 48
ROWS_AT_ONCE = 2048
PAIRS_AT_ONCE = 1 << 20


def held_out(doc_id) -> F.col:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    """Per direction: input table (256, 3H) for update, reset and candidate, recurrent (H, 3H); output (2H+1, L).

    ``pairs`` tells which of the 2**16 byte pairs the training snippets hold.
    """
    labels: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    pairs: np.ndarray | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_network(labels: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    return Network(
        labels,
        [rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32) for _ in range(2)],
        [rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32) for _ in range(2)],
        rng.normal(0, 0.3, (2 * h + 1, len(labels))).astype(np.float32))


def _run(x: np.ndarray, table: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States after each step for byte columns x (T, B); also what the backward pass needs."""
    h = recurrent.shape[0]
    state, states, kept = np.zeros((x.shape[1], h), np.float32), [], []
    for column in x:
        given = table[column]
        gates = _sigmoid(given[:, :2 * h] + state @ recurrent[:, :2 * h])
        update, reset = gates[:, :h], gates[:, h:]
        candidate = np.tanh(given[:, 2 * h:] + (reset * state) @ recurrent[:, 2 * h:])
        before = state
        state = before + update * (candidate - before)
        states.append(state)
        kept.append((column, before, update, reset, candidate))
    return np.stack(states), kept


def _back(kept: list[tuple], d_states: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent weights from those of the states."""
    h = recurrent.shape[0]
    d_table, d_recurrent = np.zeros((256, 3 * h), np.float32), np.zeros_like(recurrent)
    d_state = np.zeros_like(d_states[0])
    for (column, before, update, reset, candidate), given in zip(reversed(kept), d_states[::-1], strict=True):
        d = d_state + given
        d_candidate = d * update * (1 - candidate * candidate)
        d_update = d * (candidate - before) * update * (1 - update)
        through = d_candidate @ recurrent[:, 2 * h:].T
        d_reset = through * before * reset * (1 - reset)
        d_gates = np.concatenate([d_update, d_reset], 1)
        d_recurrent[:, 2 * h:] += (reset * before).T @ d_candidate
        d_recurrent[:, :2 * h] += before.T @ d_gates
        np.add.at(d_table, column, np.concatenate([d_gates, d_candidate], 1))
        d_state = d * (1 - update) + through * reset + d_gates @ recurrent[:, :2 * h].T
    return d_table, d_recurrent


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(snippets: list[bytes], languages: list[str], seed: int = 7, steps: int = STEPS) -> Network:
    """Fit on snippets by backpropagation through time and Adam; languages weigh alike."""
    labels = sorted(set(languages))
    net = new_network(labels, seed)
    rng = np.random.default_rng(seed + 1)
    target = np.array([labels.index(x) for x in languages])
    groups = [np.flatnonzero(target == k) for k in range(len(labels))]
    bytes_of = [np.frombuffer(s, np.uint8) for s in snippets]
    weights = [*net.tables, *net.recurrent, net.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        chosen = np.array([rng.choice(groups[k]) for k in rng.integers(0, len(labels), BATCH)])
        x = np.full((TRAIN_LENGTH, BATCH), 32, np.uint8)
        for b, i in enumerate(chosen):
            s = bytes_of[i]
            at = int(rng.integers(0, max(1, len(s) - TRAIN_LENGTH + 1)))
            part = s[at:at + TRAIN_LENGTH]
            x[:len(part), b] = part
        right, kept_right = _run(x, net.tables[0], net.recurrent[0])
        left, kept_left = _run(x[::-1], net.tables[1], net.recurrent[1])
        states = np.concatenate([right, left[::-1], np.ones((*right.shape[:2], 1), np.float32)], 2)
        p = _softmax(states @ net.out)
        p[:, np.arange(BATCH), target[chosen]] -= 1
        d = (p / p[..., 0].size).astype(np.float32)
        d_states = d @ net.out.T
        h = HIDDEN
        table_r, recurrent_r = _back(kept_right, d_states[..., :h], net.recurrent[0])
        table_l, recurrent_l = _back(kept_left, d_states[::-1, :, h:2 * h], net.recurrent[1])
        gradients = [table_r, table_l, recurrent_r, recurrent_l,
                     states.reshape(-1, 2 * h + 1).T @ d.reshape(-1, len(labels))]
        rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, gradients, first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


def _states(x: np.ndarray, table: np.ndarray, recurrent: np.ndarray, keep: int) -> np.ndarray:
    """States of the last ``keep`` steps of byte columns x (T, B), as (keep, H, B); x has no state before its start.

    The same arithmetic as in training, with halved gate inputs so that one tanh serves all three gates.
    """
    h = recurrent.shape[0]
    half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
    table, gates_w, candidate_w = table * half, (recurrent[:, :2 * h] * 0.5).T.copy(), recurrent[:, 2 * h:].T.copy()
    columns = table.T.copy()  # (3H, 256)
    n = x.shape[1]
    state = np.zeros((h, n), np.float32)
    out = np.empty((keep, h, n), np.float32)
    skip = x.shape[0] - keep
    for t, column in enumerate(x):
        given = np.take(columns, column, axis=1)
        gates = given[:2 * h]
        gates += gates_w @ state
        np.tanh(gates, gates)
        gates += 1
        gates *= 0.5
        candidate = given[2 * h:]
        candidate += candidate_w @ (gates[h:] * state)
        np.tanh(candidate, candidate)
        candidate -= state
        candidate *= gates[:h]
        state = state + candidate
        if t >= skip:
            out[t - skip] = state
    return out


def position_scores(net: Network, x: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Sum over real positions of the label probabilities, for segments x (OVERLAP + SEGMENT + OVERLAP, B)."""
    h = HIDDEN
    right = _states(x[:OVERLAP + SEGMENT], net.tables[0], net.recurrent[0], SEGMENT)
    left = _states(x[:OVERLAP - 1:-1], net.tables[1], net.recurrent[1], SEGMENT)[::-1]
    weights = [net.out[:h].T.copy(), net.out[h:2 * h].T.copy(), net.out[2 * h][:, None]]
    total = np.zeros((len(net.labels), x.shape[1]), np.float32)
    for t in range(SEGMENT):
        z = weights[0] @ right[t] + weights[1] @ left[t] + weights[2]
        z -= z.max(0)
        np.exp(z, z)
        z *= real[t] / z.sum(0)
        total += z
    return total.T


def _segments(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner of each segment, bytes (steps, B), which of the SEGMENT middle positions are real)."""
    counts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(-OVERLAP, SEGMENT + OVERLAP)[:, None]
    for a in range(0, len(owner), ROWS_AT_ONCE):
        own, first = owner[a:a + ROWS_AT_ONCE], number[a:a + ROWS_AT_ONCE] * SEGMENT
        at = first + place
        inside = (at >= 0) & (at < sizes[own])
        x = np.where(inside, data[np.where(inside, starts[own] + at, 0)], 32).astype(np.uint8)
        yield own, x, inside[OVERLAP:OVERLAP + SEGMENT]


def probabilities(net: Network, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, labels): mean label probabilities over all bytes of each text; zeros for empty texts."""
    total = np.zeros((len(sizes), len(net.labels)))
    if len(data):
        for own, x, real in _segments(data, starts, sizes):
            np.add.at(total, own, position_scores(net, x, real))
    return total / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, text: str, lang: str, doc_id: str) -> list[tuple[bytes, str]]:
    """At most SAMPLE_BUCKETS snippets per language; the smallest hash of a bucket wins."""
    mark = F.xxhash64(F.col(doc_id), F.substring(F.col(text), 1, 64))
    size = F.length(text)
    snippet = F.substr(F.col(text), (F.pmod(mark, F.greatest(size - SNIPPET, F.lit(1))) + 1).cast("int"), F.lit(SNIPPET))
    rows = (docs.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id)) & has_letter(F.col(text)))
            .select(F.col(lang).alias("lang"), F.pmod(mark, F.lit(SAMPLE_BUCKETS)).alias("bucket"),
                    F.struct(mark.alias("mark"), snippet.alias("snippet")).alias("pick"))
            .groupBy("lang", "bucket").agg(F.min("pick").alias("pick"))
            .select("lang", "pick.mark", "pick.snippet").collect())
    rows.sort(key=lambda r: (r["lang"], r["mark"], r["snippet"]))
    return [(r["snippet"].encode(), r["lang"]) for r in rows]


def pairs_of(data: np.ndarray) -> np.ndarray:
    """Each byte with its next one, as a number."""
    return data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]


def known_share(pairs: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The share of each text's byte pairs that are in ``pairs``; 0 for a text without any.  Texts follow each other."""
    out = np.zeros(len(sizes))
    a = 0
    while a < len(sizes):  # some texts at a time: the sums are eight times as large as their bytes
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PAIRS_AT_ONCE)))
        begin, end = starts[a], starts[b - 1] + sizes[b - 1]
        if end - begin > 1:
            sums = np.concatenate([[0], np.cumsum(pairs[pairs_of(data[begin:end])])])
            first = starts[a:b] - begin
            last = first + np.maximum(sizes[a:b] - 1, 0)
            out[a:b] = sums[np.minimum(last, len(sums) - 1)] - sums[np.minimum(first, len(sums) - 1)]
        a = b
    return out / np.maximum(sizes - 1, 1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network | None:
    sample = training_sample(docs, text, lang, doc_id)
    if not sample:
        return None
    net = train([s for s, _ in sample], [x for _, x in sample])
    net.pairs = np.zeros(1 << 16, bool)
    for snippet, _ in sample:
        net.pairs[pairs_of(np.frombuffer(snippet, np.uint8))] = True
    return net


def predict(docs: DataFrame, net: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``keep``, lang_pred, score (the mean probability of that label), known.

    ``keep`` may hold the text itself.
    """
    source = docs.select(*keep, F.coalesce(F.when(has_letter(F.col(text)), F.col(text)), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            if pa.types.is_large_string(texts.type):
                wide = np.int64
            else:
                wide = np.int32
            ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            sizes = np.diff(ends)
            labels, scores, known = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
            if net is not None and len(texts):
                p = probabilities(net, data, ends[:-1], sizes)
                best = p.argmax(1)
                found = sizes > 0
                labels[found] = np.array(net.labels, object)[best[found]]
                scores[found] = np.clip(p[np.arange(len(p)), best][found], 0, 1)
                if net.pairs is not None:
                    known = known_share(net.pairs, data, ends[:-1], sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "known"])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])
    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Fit on the rows that are not held out and predict every row: doc_id, held_out, lang_pred, score."""
    net = fit(docs, text, lang, doc_id)
    return (predict(docs, net, text, (doc_id,))
            .select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "lang_pred", "score"))
