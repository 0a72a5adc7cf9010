"""Exact top-k inner products through a pivot-distance index.

Vectors become whole numbers (floor(scale * x)).  One more coordinate, sqrt(M^2 - |x|^2) with M
the largest length, puts all of them on a sphere, where the greatest inner product is the least
distance; a query gets 0 there.  Every vector is keyed by its nearest pivot and by the annulus
(distance to that pivot, in steps of a width); the vectors of a key are packed into blocks of at
most ``BLOCK`` rows.  Pivots are drawn by hash, a bounded number whatever the input's size.

A search expands annuli in two rounds.  The first reads the query's own annulus and its
neighbours and gives a bound for the k-th distance r; by the triangle inequality the second
needs no annulus of a pivot p outside d(q, p) - r to d(q, p) + r.  Scores are whole numbers, so
the result is exact; the bounds leave room for rounding.

Vectors that are null or hold null or non-finite numbers take no part, as queries or otherwise.
Shorter vectors are filled up with zeros.  Rows of equal ids are all candidates; a query's own
id is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.shared import written

PIVOTS = 48
#: Annuli across the diameter of the sphere.
RINGS = 64
#: Vectors of a block.
BLOCK = 1024
#: Queries that visit a block at once; more of them visit copies of it.
VISITORS = 4096
#: Room for rounding in squared distances, relative to the square of the diameter.
SLACK = 1e-9


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where these are exact, else one by one."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**52:
        exact = np.array([[int(v) for v in row] for row in a], dtype=object) @ np.array([[int(v) for v in row] for row in b], dtype=object).T
        return np.clip(exact, -(2**63), 2**63 - 1)
    return a @ b.T


class Space:
    """The sphere and its pivots."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.square, self.pivots = longest, pivots
        self.step = 2 * np.sqrt(max(longest, 1.0)) / RINGS
        self.lifted = self._lift(pivots)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.square - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """From each row to each pivot."""
        y = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self._lift(x)
        gaps = (y * y).sum(axis=1)[:, None] + (self.lifted * self.lifted).sum(axis=1)[None, :] - 2 * y @ self.lifted.T
        return np.sqrt(np.maximum(0, gaps))

    def radius(self, squares: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far from a query candidates can be that score at least ``scores``."""
        return np.sqrt(np.maximum(0, squares + self.square - 2 * scores)) + SLACK * (squares + self.square + 1)


def _index(space, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch.column(1), width)
            d = space.value.distances(x)
            pivot = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            ring = (d[np.arange(len(x)), pivot] / space.value.step).astype(np.int64)
            data = [row.astype("<f8").tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pivot.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(data, pa.binary())], names=["id", "pivot", "ring", "data"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one pivot and ring as blocks (the rows come sorted)."""
    names = ["pivot", "ring", "block", "ids", "data"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    run, ids, data = None, [], []
    number = TaskContext.get().partitionId() << 33

    def block() -> pa.RecordBatch:
        nonlocal number
        number += 1
        row = [run[0], run[1], number, np.array(ids, np.int64).tobytes(), b"".join(data)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    for batch in batches:
        for own, pivot, ring, values in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if run != (pivot, ring) or len(ids) >= BLOCK:
                if ids:
                    yield block()
                run, ids, data = (pivot, ring), [], []
            ids.append(own)
            data.append(values)
    if ids:
        yield block()


def _aims(space, width: int, first: bool):
    """The keys that each query visits: around its own annulus, or all within its radius."""
    names, types = ["query", "pivot", "low", "high", "data"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = space.value
        for batch in batches:
            x = _numbers(batch.column(1), width)
            d = own.distances(x, query=True)
            if first:
                near = d.argsort(axis=1)[:, :2]
                rows = np.repeat(np.arange(len(x)), near.shape[1])
                pivots = near.ravel()
                ring = (own.distances(x)[rows, pivots] / own.step).astype(np.int64)
                low, high = ring - 1, ring + 1
            else:
                bound = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                r = own.radius((x * x).sum(axis=1), bound)
                r = np.where(np.isnan(bound), np.inf, r)
                rows = np.repeat(np.arange(len(x)), d.shape[1])
                pivots = np.tile(np.arange(d.shape[1]), len(x))
                low = np.floor(np.maximum(0, d - r[:, None]) / own.step).astype(np.int64).ravel() - 1
                high = np.floor(np.minimum(4 * RINGS * own.step, d + r[:, None]) / own.step).astype(np.int64).ravel() + 1
            blobs = [v.astype("<f8").tobytes() for v in x]
            columns = [batch.column(0).take(pa.array(rows)), pa.array(pivots.astype(np.int32)), pa.array(np.maximum(low, 0).astype(np.int32)), pa.array(high.astype(np.int32)), pa.array([blobs[k] for k in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names=names)

    return run


def _visit(k: int, width: int):
    """The k best rows of a block for each query that visits it."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and blocks.num_rows:
            q = np.frombuffer(b"".join(queries["data"].to_pylist()), "<f8").reshape(queries.num_rows, width)
            names = queries["query"].to_numpy()
            for ids, data in zip(blocks["ids"].to_pylist(), blocks["data"].to_pylist()):
                own = np.frombuffer(ids, np.int64)
                scores = _products(q, np.frombuffer(data, "<f8").reshape(len(own), width))
                for at in range(len(q)):
                    row = scores[at]
                    keep = np.flatnonzero(own != names[at])
                    if len(keep) > k:
                        cut = np.partition(row[keep], len(keep) - k)[len(keep) - k]
                        keep = keep[row[keep] >= cut]
                    keep = keep[np.lexsort((own[keep], -row[keep].astype(np.float64) if row.dtype != object else [-int(v) for v in row[keep]]))[:k]]
                    found.append((np.full(len(keep), names[at]), own[keep], row[keep].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], names=["query", "id", "score"])

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query``, ``rank``, ``id`` and ``score`` of the k greatest inner products of each query.

    ``queries`` has the same columns as ``vectors``; both are scaled and floored alike.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        whole = F.transform(F.col(vector), lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
        finite = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
        return df.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(ident).cast("long").alias("id"), whole.alias("x"))

    rows, asked = clean(vectors), clean(queries)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    facts = rows.agg(F.max(F.size("x")).alias("width"), F.max(square).alias("longest"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, facts.width or 1, asked.agg(F.max(F.size("x"))).first()[0] or 1)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("x").collect()
    pivots = np.zeros((max(1, len(drawn)), width))
    for at, row in enumerate(drawn):
        pivots[at, : len(row.x)] = row.x
    space = spark.sparkContext.broadcast(Space(np.unique(pivots, axis=0), float(facts.longest or 0.0)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = written(rows.mapInArrow(_index(space, width), "id long, pivot int, ring int, data binary"), "keyed")
    ordered = keyed.repartitionByRange(partitions, "pivot", "ring", "id").sortWithinPartitions("pivot", "ring", "id").select("id", "pivot", "ring", "data")
    blocks = written(ordered.mapInArrow(_pack, "pivot int, ring int, block long, ids binary, data binary"), "blocks")
    asked = written(asked, "queries")
    parts = asked.count() // VISITORS + 1
    places = blocks.select("pivot", "ring", F.col("block").alias("place"))

    def visit(aims: DataFrame) -> DataFrame:
        own = aims.select("query", "data", "pivot", F.explode(F.sequence("low", "high")).alias("ring")).join(places, ["pivot", "ring"])
        own = own.select("query", "data", "place", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("long").alias("part"))
        copies = blocks.select("block", "ids", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
        return own.groupBy("place", "part").cogroup(copies.groupBy("block", "part")).applyInArrow(_visit(k, width), "query long, id long, score long")

    schema = "query long, pivot int, low int, high int, data binary"
    first = visit(asked.select("id", "x").mapInArrow(_aims(space, width, True), schema))
    bounds = written(_best(first, k).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound")).filter(F.col("n") >= k).select("query", "bound"), "bounds")
    bounded = asked.join(bounds, asked["id"] == bounds["query"], "left").select("id", "x", F.col("bound").cast("double"))
    return _best(visit(bounded.mapInArrow(_aims(space, width, False), schema)), k)


def op9_top_products(spark, folder: str) -> DataFrame:
    """The five greatest whole-number inner products of each fiftieth vector."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    found = top_products(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
