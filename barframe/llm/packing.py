"""Packing along a space-filling curve.

A document's ids, hashed into buckets, give a vector; a fixed projection takes it to a few
dimensions; its place on the Hilbert curve through that space is the sort key.  Documents are
range-sorted by key and id and cut into sequences in that order, so neighbours in content share
sequences.  Every sequence holds ``length`` ids, but for the last ids of each partition: these
go to sequences of a power of two each, which need no padding.

Null and empty texts are the end id alone.  Documents with equal keys (copies) are told apart by
id, so a large group of copies spreads over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.shared import written
from barframe.llm.tokens import default_vocabulary, encoder

LENGTH = 1024
END_ID = 0
BUCKETS = 512
DIMENSIONS = 4
BITS = 8
#: Bytes of ids that a partition is to hold.
PARTITION_BYTES = 32 << 20
#: Sequences of a partition are numbered from its own multiple of this.
PARTITION_SHIFT = 33


def projection(seed: int = 11) -> np.ndarray:
    """Fixed signs that take a bucket vector to DIMENSIONS numbers."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))


def hilbert_key(cells: np.ndarray) -> int:
    """The place on the Hilbert curve of a cell (DIMENSIONS numbers of BITS bits), after Skilling."""
    x, n = [int(c) for c in cells], len(cells)
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (BITS - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> bit & 1)
    return key


def document_key(ids: np.ndarray, signs: np.ndarray) -> int:
    """The curve key of a document's ids."""
    counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(23), minlength=BUCKETS)
    vector = np.sqrt(counts)
    place = vector @ signs / (np.linalg.norm(vector) or 1.0)
    return hilbert_key(np.clip((place / 4 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, signs = encoder(path), projection()
        end = np.array([END_ID], own.kind).tobytes()
        for batch in batches:
            ids = [x + end for x in own.encode(batch.column(1).to_pylist())]
            keys = [document_key(np.frombuffer(x, own.kind), signs) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc", "key", "size", "ids"])

    return run


def tail_lengths(n: int) -> list[int]:
    """``n`` as powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _tail(pieces: list[tuple], filled: int) -> list[tuple]:
    """The pieces of a sequence that isn't full, cut anew into sequences of a power of two each."""
    rooms, out = tail_lengths(filled), []
    sequence, offset = (pieces[0][5] if pieces else 0), 0
    for doc, start, size, ids, total, _, _ in pieces:
        at = 0
        while at < size:
            take = min(rooms[0] - offset, size - at)
            out.append((doc, start + at, take, ids[4 * at : 4 * (at + take)], total, sequence, offset))
            at += take
            offset += take
            if offset == rooms[0]:
                rooms, sequence, offset = rooms[1:], sequence + 1, 0
    return out


def _pack(path: str, length: int):
    names = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        sequence = TaskContext.get().partitionId() << PARTITION_SHIFT
        filled, waiting, out = 0, [], []  # waiting: pieces of the sequence that isn't full
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(ids.as_buffer(), kind)
                at = 0
                while at < len(own):
                    take = min(length - filled, len(own) - at)
                    waiting.append((doc, at, take, own[at : at + take].astype("<u4").tobytes(), len(own), sequence, filled))
                    at += take
                    filled += take
                    if filled == length:
                        out += waiting
                        filled, waiting, sequence = 0, [], sequence + 1
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        out += _tail(waiting, filled)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def pack_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces: ``doc``, ``start``, ``length``, ``ids`` (little-endian, 32 bits), ``doc_tokens``, ``sequence_id``, ``offset``."""
    path = vocabulary or default_vocabulary()
    encoded = written(documents.select(F.col(doc_id).cast("long"), text).mapInArrow(_encode(path), "doc long, key long, size long, ids binary"), "tokens")
    volume = encoded.agg(F.sum("size")).first()[0] or 0
    partitions = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), volume // PARTITION_BYTES)
    ordered = encoded.repartitionByRange(partitions, "key", "doc").sortWithinPartitions("key", "doc").select("doc", "ids")
    return ordered.mapInArrow(_pack(path, length), "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    pieces = pack_documents(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return pieces.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
