"""Line deduplication through sharded minimal perfect hashes.

Every line has a 128-bit hash of its key (blanks at both ends stripped, A-Z lower-cased).  The
distinct hashes are counted by Spark and dealt into shards; each shard becomes one row that holds
a minimal perfect hash and, in its order, arrays of fingerprints, counts and first documents.
Documents are dealt into small buckets, and a bucket probes the shards with its distinct hashes,
so a line that stands in a third of all documents costs one probe for each bucket.  No line text
is shuffled or joined.

A line is dropped where a document with a smaller id holds its key and the key has at least
``least`` code points.  Rows with equal ids count as one document.  A null or empty text is one
empty line; a null text stays null.  Rows with a null id are passed on as they are and don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.text import mix

#: Code points that a key needs for its line to be dropped.
LEAST = 10
#: Shards of the index, and buckets of documents, for each shuffle partition; and the bytes of text for one more of them.
SHARDS_PER_PARTITION, SHARD_BYTES = 4, 16 << 20
BUCKETS_PER_PARTITION, BUCKET_BYTES = 8, 32 << 20
_BLANKS = " \t\n\x0b\x0c\r"
_LEVELS = 48


# --- minimal perfect hash -------------------------------------------------------------------


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def build_mphf(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct 64-bit keys.

    Level by level, the keys that are alone in their slot set a bit there and the others go on.
    Returns the bits of each level, the few keys left after the last level, and for each key its
    index: the rank of its bit, or a place after all bits.
    """
    levels, index, rank, left = [], np.empty(len(keys), np.int64), 0, np.arange(len(keys))
    for level in range(_LEVELS):
        if not len(left):
            break
        size = 2 * len(left)
        at = _slots(keys[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        ranks = np.cumsum(alone) - 1
        index[left[mine]] = rank + ranks[at[mine]]
        rank += int(mine.sum())
        levels.append(alone)
        left = left[~mine]
    index[left] = rank + np.arange(len(left))
    return levels, keys[left], index


def probe_mphf(levels: list[np.ndarray], rest: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The index of each key; a key that was not built in gets any index, or -1."""
    index, rank, left = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for level, alone in enumerate(levels):
        if not len(left):
            return index
        at = _slots(keys[left], level, len(alone))
        mine = alone[at]
        ranks = np.cumsum(alone) - 1
        index[left[mine]] = rank + ranks[at[mine]]
        rank += int(ranks[-1]) + 1
        left = left[~mine]
    for k, key in enumerate(rest):
        index[left[keys[left] == key]] = rank + k
    return index


# --- lines ----------------------------------------------------------------------------------


def line_key(line: str) -> bytes:
    """What is compared of a line (``bytes.lower`` touches A-Z alone)."""
    return line.strip(_BLANKS).encode("utf-8", "surrogatepass").lower()


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _hashes_of(text: str | None, least: int) -> list[bytes | None]:
    """The 16-byte hash of each line, None where its key is too short."""
    return [_hash(line_key(line)) if len(line.strip(_BLANKS)) >= least else None for line in (text or "").split("\n")]


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].view(np.int64), both[:, 1].view(np.int64)


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {h for h in _hashes_of(text, least) if h}
                found += own
                owners += [doc] * len(own)
            h1, h2 = _halves(found)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(h1), pa.array(h2)], names=["doc", "h1", "h2"])

    return run


_INDEX = "shard long, bits binary, sizes array<int>, rest binary, prints binary, counts binary, firsts binary"


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    keys = rows["h1"].to_numpy().view(np.uint64)
    levels, rest, index = build_mphf(keys)
    prints, counts, firsts = (np.empty(len(keys), t) for t in (np.int64, np.uint32, np.int64))
    prints[index] = rows["h2"].to_numpy()
    counts[index] = np.minimum(rows["n"].to_numpy(), 2**32 - 1)
    firsts[index] = rows["first"].to_numpy()
    bits = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
    values = [[key[0].as_py()], [bits.tobytes()], [[len(x) for x in levels]], [rest.tobytes()], [prints.tobytes()], [counts.tobytes()], [firsts.tobytes()]]
    types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, t) for v, t in zip(values, types)], names=[f.split()[0] for f in _INDEX.split(", ")])


def _probe(probes: pa.Table, index: pa.Table) -> pa.Table:
    names = ["bucket", "h1", "h2", "first"]
    if not probes.num_rows or not index.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, names=names)
    one = index.to_pylist()[0]
    bits = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=sum(one["sizes"])).astype(bool)
    levels = np.split(bits, np.cumsum(one["sizes"])[:-1]) if one["sizes"] else []
    prints, counts, firsts = (np.frombuffer(one[k], t) for k, t in (("prints", np.int64), ("counts", np.uint32), ("firsts", np.int64)))
    h1, h2 = probes["h1"].to_numpy(), probes["h2"].to_numpy()
    at = probe_mphf(levels, np.frombuffer(one["rest"], np.uint64), h1.view(np.uint64))
    known = at >= 0
    hit = known & (prints[np.where(known, at, 0)] == h2) & (counts[np.where(known, at, 0)] >= 2)
    return pa.table([pa.array(x[hit]) for x in (probes["bucket"].to_numpy(), h1, h2)] + [pa.array(firsts[at[hit]])], names=names)


def _apply(least: int):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        first = {}
        if answers.num_rows:
            both = np.stack([answers["h1"].to_numpy(), answers["h2"].to_numpy()], axis=1).view(np.uint64).astype(">u8").tobytes()
            first = {both[16 * k : 16 * k + 16]: f for k, f in enumerate(answers["first"].to_pylist())}
        kept, lines, dropped = [], [], []
        for doc, text in zip(documents["doc"].to_pylist(), documents["text"].to_pylist()):
            own = (text or "").split("\n")
            lines.append(len(own))
            out = own
            if doc is not None and first:
                out = [line for line, h in zip(own, _hashes_of(text, least)) if h is None or first.get(h, doc) >= doc]
            dropped.append(len(own) - len(out))
            kept.append(None if text is None else "\n".join(out))
        return pa.table([documents["row"], pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "kept", "n_lines", "n_dropped"])

    return run


def _groups(documents: DataFrame, text: str) -> tuple[int, int]:
    """How many shards and buckets keep a group small, whatever the size of the table."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    volume = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(SHARDS_PER_PARTITION * partitions, volume // SHARD_BYTES), max(BUCKETS_PER_PARTITION * partitions, volume // BUCKET_BYTES)


def line_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, shards: int | None = None) -> DataFrame:
    """The index: one row for each shard of the distinct line hashes."""
    shards = shards or _groups(documents, text)[0]
    lines = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long"), text).mapInArrow(_lines(least), "doc long, h1 long, h2 long")
    counted = lines.groupBy(F.pmod("h1", F.lit(shards)).cast("long").alias("shard"), "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
    return counted.groupBy("shard").applyInArrow(_build, _INDEX)


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``documents`` with repeated lines dropped, ``n_lines`` and ``n_dropped``.

    The two counts replace columns of the same names.
    """
    shards, buckets = _groups(documents, text)
    known, unknown = documents.filter(F.col(doc_id).isNotNull()), documents.filter(F.col(doc_id).isNull())
    bucket = F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text)), F.lit(buckets)).cast("long")
    index = line_index(documents, doc_id, text, least, shards)
    lines = known.select(bucket, text).mapInArrow(_lines(least), "doc long, h1 long, h2 long").withColumnRenamed("doc", "bucket")
    probes = lines.select("bucket", F.pmod("h1", F.lit(shards)).cast("long").alias("shard"), "h1", "h2").distinct()
    answers = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "bucket long, h1 long, h2 long, first long")
    rows = known.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), bucket.alias("bucket"))
    schema = T.StructType([T.StructField("row", documents.schema), T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_apply(least), schema)
    whole = unknown.select(F.struct("*").alias("row"), F.col(text).alias("kept"), F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    same = [F.col("kept").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns if c not in ("n_lines", "n_dropped")]
    return done.union(whole).select(*same, "n_lines", "n_dropped")


def op8_line_dedup(spark, folder: str) -> DataFrame:
    """Lines dropped from every document, with a digest of what stays."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(documents)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


#: DuckDB's lower() also lower-cases letters beyond ASCII; translate() keeps to A-Z.
OP8_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) <> max(doc_id)
), marked AS (
  SELECT l.*, coalesce(f.first < l.doc_id, false) AS gone FROM lines l LEFT JOIN firsts f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
