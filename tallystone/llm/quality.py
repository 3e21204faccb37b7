"""Quality scores by a byte-level convolutional network in numpy.

Every document is cut into overlapping chunks that cover all of its bytes. Learned filters of a few bytes run
over each chunk; each filter's largest response in a chunk is kept. The mean and the maximum of these over all
chunks go through a logistic layer to one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.scratch import Scratch
from tallystone.llm.texthash import chunks, string_buffers

#: Filters and their bytes; chunks of four segments that start every three.
FILTERS, WIDTH, SEGMENT = 12, 5, 64
CHUNK_SEGMENTS, CHUNK_STEP = 4, 3
#: Labelled documents that the network is fitted on, at most: those of least hash of their id.
SAMPLE = 5000
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.02, 1e-4
THRESHOLD = 0.7
SCORE_BYTES = 1 << 18
#: Segments that filters run over at once, and chunks that are pooled at once.
SEGMENTS, POOLED = 512, 1 << 15
#: Bytes of the texts that the network is fitted on, at most: texts are taken in the order of their hash until then.
FIT_BYTES = 64 << 20


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows one after another, each of whole segments: WIDTH - 1 zero bytes, the row, and zero bytes up to the
    end. So a filter that reaches beyond a row's end meets zeros, whatever row follows. Also the segment offsets."""
    length = np.diff(offsets)
    segments = -(-(length + WIDTH - 1) // SEGMENT)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(segments)])
    out = np.zeros(int(at[-1]) * SEGMENT + WIDTH - 1, np.uint8)
    for a, n, to in zip(offsets[:-1].tolist(), length.tolist(), (at[:-1] * SEGMENT + WIDTH - 1).tolist(), strict=True):
        out[to : to + n] = data[a : a + n]
    return out, at


def responses(filters: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(segments, SEGMENT, FILTERS): each filter's response at each place. ``filters``: (WIDTH, 256, FILTERS)."""
    n = len(data) - WIDTH + 1
    out = np.take(filters[0], data[:n], axis=0)
    held = np.empty_like(out)
    for k in range(1, WIDTH):
        np.take(filters[k], data[k : n + k], axis=0, out=held, mode="clip")
        out += held
    return out.reshape(-1, SEGMENT, filters.shape[2])


def segment_maxima(filters: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(segments, FILTERS): each filter's largest response in each segment; some segments at a time."""
    n = (len(data) - WIDTH + 1) // SEGMENT
    out = np.empty((n, filters.shape[2]), filters.dtype)
    for a in range(0, n, SEGMENTS):
        b = min(a + SEGMENTS, n)
        out[a:b] = responses(filters, data[a * SEGMENT : b * SEGMENT + WIDTH - 1]).max(axis=1)
    return out


def chunk_index(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK_SEGMENTS) segment numbers, the last repeated at a row's end, and the rows' chunk offsets."""
    segments = np.diff(at)
    count = np.maximum(1, -(-(segments - CHUNK_SEGMENTS) // CHUNK_STEP) + 1)
    own = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    first = (np.arange(int(own[-1]), dtype=np.int64) - np.repeat(own[:-1], count)) * CHUNK_STEP
    last = np.repeat(segments - 1, count)
    inside = np.minimum(first[:, None] + np.arange(CHUNK_SEGMENTS), last[:, None])
    return inside + np.repeat(at[:-1], count)[:, None], own


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each row."""
        flat, at = padded(data, offsets)
        segment = segment_maxima(self.filters, flat)
        index, own = chunk_index(at)
        rows, width = len(own) - 1, segment.shape[1]
        total, most = np.zeros((rows, width)), np.zeros((rows, width))
        for a in range(0, len(index), POOLED):
            b = min(a + POOLED, len(index))
            pooled = np.maximum(segment[index[a:b]].max(axis=1) + self.bias, 0.0)
            edges = np.clip(own, a, b) - a
            some = np.flatnonzero(np.diff(edges))
            total[some] += np.add.reduceat(pooled, edges[:-1][some], axis=0)
            most[some] = np.maximum(most[some], np.maximum.reduceat(pooled, edges[:-1][some], axis=0))
        z = np.hstack([total / np.diff(own)[:, None], most]).astype(np.float64) @ self.weights + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)])


def fit(texts: list[bytes], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Train by Adam on the logistic loss. Without texts of both labels the score is their smoothed share."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS), float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0.0
        return net
    shapes = (net.filters, net.bias, net.weights, np.zeros(1))
    first, second, step = [np.zeros_like(p, np.float64) for p in shapes], [np.zeros_like(p, np.float64) for p in shapes], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            data, offsets = _joined([texts[i] for i in rows])
            flat, at = padded(data, offsets)
            full = responses(net.filters, flat)
            where = full.argmax(axis=1)
            segment = np.take_along_axis(full, where[:, None, :], axis=1)[:, 0, :]
            index, own = chunk_index(at)
            of_chunk = segment[index]
            pick = of_chunk.argmax(axis=1)
            best = np.take_along_axis(of_chunk, pick[:, None, :], axis=1)[:, 0, :]
            pooled = np.maximum(best + net.bias, 0.0)
            count = np.diff(own)
            mean = np.add.reduceat(pooled, own[:-1], axis=0) / count[:, None]
            most = np.maximum.reduceat(pooled, own[:-1], axis=0)
            hidden = np.hstack([mean, most]).astype(np.float64)
            z = hidden @ net.weights + net.offset
            delta = (1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) - labels[rows]) / len(rows)
            back = delta[:, None] * net.weights[None, :]
            row = np.repeat(np.arange(len(rows)), count)
            grad = (back[:, :FILTERS] / count[:, None])[row]
            leads = pooled == most[row]
            shared = np.add.reduceat(leads.astype(np.float64), own[:-1], axis=0)
            grad += leads * (back[:, FILTERS:] / shared)[row]
            grad *= pooled > 0
            seg = np.take_along_axis(index, pick, axis=1)
            place = seg * SEGMENT + where[seg, np.arange(FILTERS)]
            by_filter = np.zeros_like(net.filters, np.float64)
            column = np.broadcast_to(np.arange(FILTERS), place.shape)
            for k in range(WIDTH):
                cell = flat[place + k].astype(np.int64) * FILTERS + column
                by_filter[k] = np.bincount(cell.ravel(), weights=grad.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            grads = (by_filter + DECAY * net.filters, grad.sum(axis=0), hidden.T @ delta + DECAY * net.weights, np.array([delta.sum()]))
            step += 1
            rate = RATE * (1 - 0.9 * (epoch + a / len(order)) / epochs)
            moves = []
            for j, g in enumerate(grads):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.99 * second[j] + 0.01 * g * g
                moves.append(rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8))
            net.filters = (net.filters - moves[0]).astype(np.float32)
            net.bias = (net.bias - moves[1]).astype(np.float32)
            net.weights = net.weights - moves[2]
            net.offset = float(net.offset - moves[3][0])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int, fit_bytes: int = FIT_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most ``limit`` labelled texts of at most ``fit_bytes`` bytes together, those of least id hash; a longer
    text than what is left of these is passed over, whole. A document of several labels has the least; of the
    texts of a repeated id the least counts."""
    sound = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sound = sound.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    chosen = sound.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` rows of two numbers: small enough to be sent to every executor
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= fit_bytes)
    texts = Scratch(docs.sparkSession, "labelled").save(sized.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "texts")
    # at most ``limit`` rows of three numbers
    left, out = fit_bytes, []
    for r in sorted(texts.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.octet_length("text").alias("n")).collect()):
        if r["n"] > left:
            out.append(r["doc_id"])
        else:
            left -= r["n"]
    rows = sorted(texts.where(~F.col("doc_id").isin(out)).select("doc_id", "text", "quality").collect())
    return [r["text"].encode("utf-8") for r in rows], np.array([r["quality"] for r in rows], np.float64)


def scored_batches(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        parts = [net.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, SCORE_BYTES)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    The network is fitted on at most ``sample`` labelled documents, none of them held out (crc32 of the id as
    text, modulo 4, is 2), and sees bytes only. Null texts count as empty and are scored like any other text.
    Equal texts have equal scores, repeated rows give repeated rows, an empty table gives an empty table, and
    labels of one kind only or none give every document their smoothed share.
    """
    texts, marks = labelled_sample(docs, labels, sample)
    net = fit(texts, marks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(lambda it: scored_batches(it, net), "doc_id long, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text the network accepts; all columns as they are."""
    texts, marks = labelled_sample(docs, labels, sample)
    net = fit(texts, marks)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(at).fill_null(""))
            for a, b in chunks(offsets, SCORE_BYTES):
                good = net.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
