"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of its bytes.  Each filter answers at every
byte of a chunk to the ``WIDTH`` bytes from there on; its greatest answer in the chunk is kept.
A document is the mean over its chunks of these maxima, plus the mean over all bytes of each
filter's rectified answers, and a logistic layer turns that into one probability.  Filters are
tables (one number for each place and byte), so a convolution is a few table look-ups.

Training runs on the driver over the whole texts of at most ``SAMPLE_DOCUMENTS`` labelled documents,
drawn by hash: the filters learn from all of their chunks, each text's together weighing as much as
any other's, and the output layer is then fitted on whole texts.  Scoring reads every byte of every
document.  A null text is scored as an empty one: an empty chunk.  Without labels of both kinds
every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.text import utf8_parts

CHUNK = 256
STEP = 192
WIDTH = 4
#: Bytes whose answers are in memory at once (a multiple of CHUNK - STEP).
SEGMENT = 1 << 16
FILTERS = 12
#: Labelled documents that a model is trained on.
SAMPLE_DOCUMENTS = 1500
#: Bytes at which a text's answers weigh as much as the share of label 1 in the sample.
SHORT = 64
ROUNDS = 5
BATCH = 64
RATE = 0.02
#: A document is of good quality from this score on.
ACCEPT = 0.7


@dataclass(frozen=True)
class Model:
    """Filter tables (place, byte, filter), filter offsets, and the output layer."""

    tables: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float = 0.0
    constant: float | None = None


def _answers(model_tables: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The answer of each filter at each byte; ``data`` is padded by WIDTH - 1 zeros."""
    n = len(data) - WIDTH + 1
    out = np.take(model_tables[0], data[:n], axis=0)
    for k in range(1, WIDTH):
        out += np.take(model_tables[k], data[k : k + n], axis=0)
    return out + offsets


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of a text of ``n`` bytes begin: every STEP bytes, until the end is covered."""
    return np.arange(0, max(1, n - CHUNK + STEP), STEP)


def features(tables: np.ndarray, offsets: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The pooled answers of one text (its bytes)."""
    n = len(text)
    count = max(1, n - WIDTH + 1)
    padded = np.concatenate([text, np.zeros(WIDTH, np.uint8)])
    unit = CHUNK - STEP
    # chunks overlap: maxima of blocks of CHUNK - STEP bytes are shared between neighbours
    blocks, total = [], np.zeros(len(offsets))
    for at in range(0, count, SEGMENT):
        size = min(SEGMENT, count - at)
        answers = np.maximum(_answers(tables, offsets, padded[at : at + size + WIDTH - 1]), 0)
        blocks.append(np.maximum.reduceat(answers, np.arange(0, size, unit), axis=0))
        total += answers.sum(axis=0)
    peaks, starts = np.concatenate(blocks), np.arange(len(chunk_starts(n))) * (STEP // unit)
    chunks = [peaks[np.minimum(starts + k, len(peaks) - 1)] for k in range(CHUNK // unit)]
    return np.concatenate([np.maximum.reduce(chunks).mean(axis=0), total / count])


def score_text(model: Model, text: np.ndarray) -> float:
    """The probability that a text is of good quality."""
    if model.constant is not None:
        return model.constant
    z = features(model.tables, model.offsets, text) @ model.weights + model.bias
    z = model.prior + (z - model.prior) * (len(text) + 1) / (len(text) + SHORT)  # a short text says little
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(documents: list[tuple[np.ndarray, int]], seed: int = 7) -> Model:
    """Learns filters and output layer by Adam on the logistic loss over all chunks of (bytes, label) documents."""
    rng = np.random.default_rng(seed)
    starts = [chunk_starts(len(x)) for x, _ in documents]
    samples = [(x[s : s + CHUNK], y) for (x, y), own in zip(documents, starts) for s in own]
    labels = np.array([y for _, y in samples])
    empty = np.zeros((WIDTH, 256, FILTERS), np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(empty, np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    share = np.concatenate([np.full(len(own), 1 / len(own)) for own in starts])
    tables = rng.normal(0, 0.3, empty.shape).astype(np.float32)
    offsets, weights, bias = np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS), 0.0
    padded = np.zeros((len(samples), CHUNK + WIDTH), np.uint8)
    sizes = np.array([max(1, min(CHUNK, len(x)) - WIDTH + 1) for x, _ in samples])
    for k, (x, _) in enumerate(samples):
        padded[k, : min(CHUNK, len(x))] = x[:CHUNK]
    inside = np.arange(CHUNK)[None, :] < sizes[:, None]
    state = [[np.zeros_like(np.asarray(p, np.float64)) for _ in range(2)] for p in (tables, offsets, weights, bias)]
    turn = 0
    balance = share * np.where(labels == 1, 0.5 / share[labels == 1].sum(), 0.5 / share[labels == 0].sum()) * len(labels)
    for _ in range(ROUNDS):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            x, ok, y = padded[own], inside[own], labels[own]
            raw = sum(np.take(tables[k], x[:, k : k + CHUNK], axis=0) for k in range(WIDTH)) + offsets
            live = np.where(ok[:, :, None], np.maximum(raw, 0), 0)
            where = live.argmax(axis=1)
            peak, mean = live.max(axis=1), live.sum(axis=1) / sizes[own][:, None]
            pooled = np.concatenate([peak, mean], axis=1)
            p = 1 / (1 + np.exp(-np.clip(pooled @ weights + bias, -30, 30)))
            slope = (p - y) * balance[own] / len(own)
            to_peak, to_mean = np.outer(slope, weights[:FILTERS]), np.outer(slope, weights[FILTERS:]) / sizes[own][:, None]
            on = (raw > 0) & ok[:, :, None]
            flow = on * to_mean[:, None, :]
            rows = np.arange(len(own))[:, None]
            flow[rows, where, np.arange(FILTERS)] += to_peak * on[rows, where, np.arange(FILTERS)]
            flat = flow.reshape(-1, FILTERS)
            to_tables = np.stack([_by_byte(x[:, k : k + CHUNK].ravel(), flat) for k in range(WIDTH)])
            grads = [to_tables, flat.sum(axis=0), pooled.T @ slope + 1e-4 * weights, slope.sum()]
            turn += 1
            steps = []
            for (m, v), g in zip(state, grads):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                steps.append(RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8))
            tables -= steps[0].astype(np.float32)
            offsets -= steps[1].astype(np.float32)
            weights -= steps[2]
            bias -= float(steps[3])
    return Model(tables, offsets, weights, bias)


def _by_byte(data: np.ndarray, flow: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(data, weights=flow[:, f], minlength=256) for f in range(FILTERS)], axis=1)


def calibrate(model: Model, documents: list[tuple[np.ndarray, int]]) -> Model:
    """Fits the output layer anew on pooled answers of whole sample documents."""
    if model.constant is not None or len({y for _, y in documents}) < 2:
        return model
    x = np.array([features(model.tables, model.offsets, t) for t, _ in documents])
    y = np.array([label for _, label in documents])
    weights, bias = model.weights.copy(), model.bias
    scale = x.std(axis=0) + 1e-3
    z, w, b = x / scale, weights * scale, bias
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-6), 0.5 / max((y == 0).mean(), 1e-6))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        slope = (p - y) * weight / len(y)
        w -= 2.0 * (z.T @ slope + 1e-4 * w)
        b -= 2.0 * float(slope.sum())
    share = float((y == 1).mean())
    return Model(model.tables, model.offsets, w / scale, b, float(np.log(share / (1 - share))))


def training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def fit_quality(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model fitted on a bounded sample of the labelled documents of the training fold."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & training_fold(F.col(doc_id))).select(F.col(doc_id).cast("long").alias("__doc"), F.col(label).cast("int").alias("__label"))
    drawn = known.orderBy(F.xxhash64("__doc"), "__doc", "__label").limit(SAMPLE_DOCUMENTS)
    texts = documents.select(F.col(doc_id).cast("long").alias("__doc"), F.col(text).alias("__text"))
    rows = texts.join(F.broadcast(drawn), "__doc").select("__doc", F.encode(F.coalesce("__text", F.lit("")), "UTF-8").alias("__text"), "__label").collect()
    rows.sort(key=lambda r: (r["__doc"], r["__label"], bytes(r["__text"])))
    sample = [(np.frombuffer(bytes(r["__text"]), np.uint8), r["__label"]) for r in rows]
    return calibrate(train(sample), sample)


def score_quality(documents: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``documents`` with the probability of good quality in a new column."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own = [c for c in documents.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            scores = [score_text(shared.value, data[offsets[k] : offsets[k + 1]]) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in own], F.col("score").alias(into))


def op4_quality(spark, folder: str) -> DataFrame:
    """A quality score for every document."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = fit_quality(documents, labels)
    scored = score_quality(documents, model)
    return scored.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"))
