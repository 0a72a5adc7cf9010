"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every run of ``seed_words`` words of a test item is a seed.  A document that holds any seed of an
item is aligned with the item around the places of its seeds, word by word; the alignment's score
over the item's best possible score is the ``overlap``.  So a copy is found whichever of its words
are edited, as long as one seed stays.  Seeds are often common phrases: before an alignment,
the words that an item has in common with the stretch of text bound its score, and what cannot
reach the limit is not aligned.

The test items are read in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents for
each block, so what is broadcast is bounded whatever the benchmark's size.  Null and empty texts and
items match nothing; items shorter than a seed are one seed of all their words.  Rows that repeat an
item's id are texts of their own; a document gets one row for each item id, with the best overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.text import gram_hashes, slices, utf8_parts, word_hashes

SEED_WORDS = 4
#: Words of test items that are broadcast at once.
BLOCK_WORDS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: An item is leaked when its alignment reaches this share of the best possible score.
LEAKED = 0.5
#: Items of fewer words only count when they are found whole.
LEAST_WORDS = 8


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment: its score, and the begin and end of its words in ``words``.

    One row of the table is worked out at a time.  Gaps along the row are a running maximum, since
    a gap costs the same for each word.
    """
    n = len(words)
    ramp = np.arange(n + 1) * -GAP
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(words == word, MATCH, MISMATCH)
        up = row + GAP
        new, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        new[1:] = np.maximum(diagonal, 0)
        start[1:] = np.where(diagonal > 0, begin[:-1], start[1:])
        better = up > new
        new[better], start[better] = up[better], begin[better]
        lifted = new + ramp
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(n + 1), 0))
        along = reach - ramp
        gap = along > new
        new[gap], start[gap] = along[gap], start[source[gap]]
        row, begin = new, start
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best


def _batches(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = utf8_parts(column)
    for first, last in slices(offsets):
        words, at = word_hashes(data, offsets[first : last + 1])
        grams, start = gram_hashes(words, at, n)
        yield first, words, at, grams, start


def item_seeds(texts: list[str], n: int) -> tuple[list[np.ndarray], list[tuple[int, int, int]]]:
    """The words of each item's text, and its seeds: hash, number of the text, place."""
    words_of, seeds = [], []
    for number, text in enumerate(texts):
        words_of.append(np.zeros(0, np.uint64))
        for _, words, _, grams, _ in _batches(pa.array([text or ""], pa.string()), n):
            words_of[-1] = words
            own = grams if len(grams) else gram_hashes(words, np.array([0, len(words)]), max(1, len(words)))[0]
            seeds += [(int(np.int64(np.uint64(g))), number, k) for k, g in enumerate(own)]
    return words_of, seeds


def _short_sizes(words_of: list[np.ndarray], n: int) -> list[int]:
    return sorted({len(w) for w in words_of if 0 < len(w) < n})


def _all_grams(words: np.ndarray, at: np.ndarray, grams: np.ndarray, start: np.ndarray, sizes: list[int]):
    yield grams, start
    for size in sizes:
        yield gram_hashes(words, at, size)


def _found(hashes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The places of ``grams`` that are among the sorted ``hashes``."""
    if not len(hashes) or not len(grams):
        return np.zeros(0, np.int64)
    # a small table of low bits throws out almost all before the search
    table = np.zeros(1 << 20, bool)
    table[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(hashes, grams[maybe]), len(hashes) - 1)
    return maybe[hashes[at] == grams[maybe]]


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded number of words (an item of more words is a block)."""
    size = F.size(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+")).cast("long")
    running = F.sum(size).over(Window.partitionBy("part").orderBy("item", "text").rowsBetween(Window.unboundedPreceding, 0))
    items = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text"))
    parts = int((items.agg(F.sum(size)).first()[0] or 0) // BLOCK_WORDS) + 1
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts))).withColumn("block", F.floor(running / (2 * BLOCK_WORDS)))
    for part in range(parts):
        one = dealt.filter(F.col("part") == part)
        for block in [r.block for r in one.select("block").distinct().orderBy("block").collect()]:
            yield [(r.item, r.text) for r in one.filter(F.col("block") == block).select("item", "text").collect()]


def _align(shared, n: int, sizes: list[int], leaked: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, words_of, items = shared.value
        for batch in batches:
            rows: list[tuple] = []
            docs = batch.column(0).to_pylist()
            for first, words, at, grams, start in _batches(batch.column(1), n):
                spots: dict[tuple[int, int], list[int]] = {}
                for g, begin in _all_grams(words, at, grams, start, sizes):
                    hit = _found(hashes, g)
                    if not len(hit):
                        continue
                    row = np.searchsorted(begin, hit, side="right") - 1
                    for place, k in zip((hit - begin[row]).tolist(), row.tolist()):
                        for number, offset in owners[int(g[begin[k] + place])]:
                            spots.setdefault((k, number), []).append(place - offset)
                for (k, number), diagonals in spots.items():
                    own = words_of[number]
                    found = _best(own, words[at[k] : at[k + 1]], diagonals, leaked)
                    share = found[0] / (MATCH * len(own))
                    if share >= leaked and (len(own) >= LEAST_WORDS or share == 1):
                        rows.append((docs[first + k], items[number], round(share, 6), found[1], found[2]))
            names, types = ["doc", "item", "overlap", "begin", "end"], [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=names)

    return run


def _best(item: np.ndarray, words: np.ndarray, diagonals: list[int], leaked: float) -> tuple[int, int, int]:
    """The best alignment near any of the diagonals; diagonals close together share a stretch.

    A stretch that lacks too many of the item's words to reach ``leaked`` is left out.
    """
    best, reach, margin = (0, 0, 0), None, len(item) // 2 + 8
    stretches: list[list[int]] = []
    for d in sorted(set(diagonals)):
        if reach is None or d - margin > reach:
            stretches.append([d - margin, d + len(item) + margin])
        else:
            stretches[-1][1] = d + len(item) + margin
        reach = stretches[-1][1]
    for low, high in stretches:
        low = max(0, low)
        stretch = words[low : max(low, high)]
        if np.isin(item, stretch).sum() < leaked * len(item):
            continue
        score, begin, end = smith_waterman(item, stretch)
        best = max(best, (score, low + begin, low + end), key=lambda x: x[0])
    return best


def find_leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", seed_words: int = SEED_WORDS, leaked: float = LEAKED) -> DataFrame:
    """``doc``, ``item``, ``overlap`` and the words ``begin`` to ``end`` of each leaked item in each document."""
    spark = documents.sparkSession
    own = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    found = None
    for items in _blocks(benchmark, item_id, item_text):
        words_of, seeds = item_seeds([t for _, t in items], seed_words)
        if not seeds:
            continue
        sizes = _short_sizes(words_of, seed_words)
        owners: dict[int, list[tuple[int, int]]] = {}
        for seed, number, place in seeds:
            owners.setdefault(seed % 2**64, []).append((number, place))
        shared = spark.sparkContext.broadcast((np.array(sorted(owners), np.uint64), owners, words_of, [i for i, _ in items]))
        part = own.mapInArrow(_align(shared, seed_words, sizes, leaked), "doc long, item long, overlap double, begin long, end long")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "doc long, item long, overlap double, begin long, end long")
    best = F.max(F.struct("overlap", (-F.col("begin")).alias("back"), "end")).alias("best")
    return found.groupBy("doc", "item").agg(best).select("doc", "item", "best.overlap", (-F.col("best.back")).alias("begin"), "best.end")


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` without those that hold a leaked item; rows with a null id stay."""
    leaks = find_leaks(documents, benchmark, doc_id, text, **options).select(F.col("doc").alias("__leaked")).distinct()
    return documents.join(leaks, documents[doc_id] == leaks["__leaked"], "left_anti")


def op2_decontamination(spark, folder: str) -> DataFrame:
    """Every test item found in every document."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = find_leaks(documents, benchmark)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "overlap", F.col("begin").alias("first_word"), F.col("end").alias("end_word"))
