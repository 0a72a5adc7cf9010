"""Exact Jaccard join of word n-gram sets by partition of the universe.

Two sets link when their similarity is at least ``num / den``.  Sets of equal content are one
class from the start.  Sizes fall into bands.  Within a band at most H elements can differ, so
when hashing spreads the elements over segments, one segment differs by no more than its share:
none at all ("full" segments) or one element ("deletion" segments, whose neighbourhood is the
segment and all that is left of it when one element goes).  A full segment counts one and a
deletion segment two towards the H + 1 that are needed; what a band has beyond that is spare, and
each set leaves out as many of its most frequent full segments as are spare: any two sets that
link still share a signature, because both leave out from the same end of the same order.
``allocate`` picks for each band the segments of both kinds and the spare ones by the cost of the
signatures and of their chance meetings, with the share of elements that several sets hold, as
counted (exactly, for one in ``SAMPLED`` hash values of the universe; it steers cost alone).

Signatures travel once, as sorted differences in pages of the hash range; a page gives back those
that several sets hold.  A signature's sets are not paired with each other.  Each is held against one hub: first by
sketches (a bit for the parity of the elements of each hash value: no more bits differ than elements do),
then, unless those tell that the sets are far apart, by their texts.  Then
components are formed, and only what can still join two components is looked at: sets that share
a hub and also a rare element of their differences to it (x and y differ by the symmetric
difference of their differences to the hub), or that share a signature and are both far from its hub; in
both cases only what their sketches don't rule out, compared as arrays in blocks that are dealt over
tasks.  A hub's sets are dealt over ``SALTS`` tasks.  All this is exact, up to equal 64-bit hashes of
different shingles.

Null and empty texts link with nothing, nor do rows with a null id, whose component is null.  Each
row with an id that repeats gets the component of its own set; where different sets have the same
least id, they count as linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.components import connected_components
from barframe.llm.shared import written
from barframe.llm.text import gram_hashes, mix, slices, utf8_parts, word_hashes

#: Sizes of a band reach up to this times its least (and at least so far that partners are in the next band).
BAND_GROWTH = 1.4
#: Spare segments for each element that may differ, and deletion segments in a band: what the costs choose from.
SPARES, ONES = (0.1, 0.2, 0.35), (0, 1, 2, 4, 8, 16, 32)
#: Cost of a meeting of a signature with sets that don't link, in signatures.
MEETING = 8
#: One in so many hash values of elements is counted to learn the share that several sets hold.
SAMPLED = 512
#: Signatures of a page, and those that a task holds before it deals them out.
PAGE, HELD = 1 << 20, 1 << 20
#: A task sends so many of a signature's sets to its page; the page knows by two that it is shared, so the others go to any page.
REPEATED = 2
#: Tasks that a hub's sets are dealt over.
SALTS = 32
#: Ids for each word of a filter of ids while there are few, and words at most (beyond, more of the other rows pass).
FILTERED, FILTER = 4, 1 << 20
#: Open pairs that are verified at once; more of them go in rounds.
ROUND = 1 << 14
#: A set is near a hub when at most this share of its size differs; else it is far.
NEAR = 0.45
#: Bits of a sketch (more for sets of more elements, whose sketches else look alike), and words of one that are compared at once.
SKETCH, LANE = 2048, 8
#: Rows of a block of a group whose rows are compared with each other.
BLOCK = 512


# --- sets -----------------------------------------------------------------------------------


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each row's distinct n-grams; of all its words if they are fewer."""
    data, offsets = utf8_parts(column)
    for first, last in slices(offsets):
        words, at = word_hashes(data, offsets[first : last + 1])
        grams, start = gram_hashes(words, at, n)
        for k in range(last - first):
            own = grams[start[k] : start[k + 1]]
            if len(own):
                yield np.unique(own)
            elif at[k + 1] > at[k]:
                whole = np.uint64(at[k + 1] - at[k])
                for word in words[at[k] : at[k + 1]]:
                    whole = mix(np.array([whole]) * np.uint64(31) + word)[0]
                yield np.array([whole], dtype=np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _identity(own: np.ndarray) -> tuple[int, int]:
    return int(mix(own).sum().astype(np.int64)), int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64))


_PLACE = np.uint64(0xA0761D6478BD642F)
#: Sums the eight bytes of a word.
_EVEN, _SUM = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


def _sketch(own: np.ndarray) -> np.ndarray:
    """The parity of the elements of each hash value, as SKETCH bits or the power of two that reaches the set's size."""
    bits = max(SKETCH, 1 << (len(own) - 1).bit_length())
    at = (mix(own ^ _PLACE) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, h1, h2, sketches, some = [], [], [], [], []
            for own in _sets(batch.column(1), n):
                a, b = _identity(own)
                sizes.append(len(own))
                h1.append(a)
                h2.append(b)
                sketches.append(_sketch(own))
                some.append(own[own % np.uint64(SAMPLED) == 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(sketches), _lists(some)], names=["doc", "size", "h1", "h2", "sketch", "some"])

    return run


# --- signatures -----------------------------------------------------------------------------


def band_edges(num: int, den: int) -> np.ndarray:
    """The least size of each band."""
    edges = [1]
    while edges[-1] < 2**31:
        edges.append(max(edges[-1] + 1, int(edges[-1] * max(BAND_GROWTH, den / num)) + 1))
    return np.array(edges)


def differing(a: int, b: int, num: int, den: int) -> int:
    """How many elements of sets of these sizes can differ if the sets link."""
    return (a + b) * (den - num) // (den + num)


def allocate(size: int, h: int, shared: float = 0.0) -> tuple[int, int, int]:
    """Segments, how many of them may differ by one element, and spare ones, for sets of ``size``.

    ``shared`` is the chance that an element stands in other sets as well.  A segment holds a Poisson
    number of elements, e on average; a full one meets others where all its elements are shared, a
    deletion segment where all or all but one are.  As many meetings as there are spare segments are
    left out.
    """

    def cost(m: int, ones: int, spare: int) -> float:
        e = size / m
        full = math.exp(-e * (1 - shared))
        lacking = full * (1 + e * (1 - shared))
        return m + ones * e + MEETING * (max(0.0, (m - ones) * full - spare) + ones * lacking)

    choices = []
    for spare in {math.ceil(h * s) for s in SPARES}:
        for ones in ONES:
            if 2 * ones <= h + 1:
                choices.append((h + 1 + spare - ones, ones, spare))
    return min(choices, key=lambda c: (cost(*c), c))


def plans(num: int, den: int, shared: float = 0.0) -> list[tuple[int, int, int, int]]:
    """For each band: least size, segments, deletion segments, spare segments (no segments where only equal sets link)."""
    edges = band_edges(num, den)
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        h = differing(int(high) - 1, int(high) - 1, num, den)
        out.append((int(low), *(allocate(int((low + high) // 2), h, shared) if h else (0, 0, 0))))
    return out


#: Marks the band of a deletion segment's signature.
_ONE = 0x80


def _signatures(own: np.ndarray, bands: list[tuple[int, int, int, int]], lows: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of a set: in its own band, and in the next if a partner can be there.  The low byte is the band."""
    size, out = len(own), []
    k = int(np.searchsorted(lows, size, side="right")) - 1
    place, value = mix(own ^ np.uint64(0x2545F4914F6CDD1D)), mix(own ^ np.uint64(0x9E6C63D0876A9A47))
    for band in (k, k + 1):
        low, m, ones, _ = bands[band]
        if not m or band > k and size * den < low * num:
            continue
        segment = (place % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, segment, value)
        seed = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
        keys = mix(sums ^ seed) & ~np.uint64(0xFF) | np.uint64(band)
        if ones:
            some = segment < ones
            less = mix((sums[segment[some]] - value[some]) ^ seed[segment[some]]) & ~np.uint64(0xFF) | np.uint64(band)
            keys = np.concatenate([keys[ones:], np.unique(np.concatenate([keys[:ones], less])) | np.uint64(_ONE)])
        out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: all low bytes, then all of the next, up to the highest that is used."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 0
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<u8")


_DEALT = "to long, page long, n long, whole boolean, least long, places binary, sets binary"


def _deal(keys: np.ndarray, sets: np.ndarray, pages: int) -> Iterator[pa.RecordBatch]:
    """Signatures and their sets, by page; a place is the band and 32 bits of the hash."""
    hashed = keys >> np.uint64(8)
    page = (hashed >> np.uint64(32)) % np.uint64(pages)
    place = (keys & np.uint64(0xFF)) << np.uint64(32) | hashed & np.uint64(0xFFFFFFFF)
    order = np.lexsort((place, page))
    page, place, sets = page[order].astype(np.int64), place[order], sets[order]
    new = np.ones(len(page), bool)
    new[1:] = (page[1:] != page[:-1]) | (place[1:] != place[:-1])
    begins = np.flatnonzero(new)
    rest = np.arange(len(page)) - begins[np.cumsum(new) - 1] >= REPEATED
    rows = []
    for whole in (False, True):
        some = np.flatnonzero(rest == whole)
        cuts = np.flatnonzero(np.diff(page[some])) + 1
        for own in np.split(some, cuts) if len(some) else []:
            least = int(sets[own].min())
            here = int(page[own[0]])
            to = pages + (here * 0x9E3779B1 + least & 0x7FFFFFFF) % pages if whole else here
            rows.append((to, here, len(own), whole, least, _planes(np.diff(place[own], prepend=np.uint64(0))), _planes((sets[own] - least).astype(np.uint64))))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in _DEALT.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)


def _sign(n: int, num: int, den: int, bands: list[tuple[int, int, int, int]], pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.array([b[0] for b in bands])
        keys, sets, held = [], [], 0
        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), _sets(batch.column(1), n)):
                if len(own):
                    keys.append(_signatures(own, bands, lows, num, den))
                    sets.append(np.full(len(keys[-1]), doc, np.int64))
                    held += len(keys[-1])
                if held > HELD:
                    yield from _deal(np.concatenate(keys), np.concatenate(sets), pages)
                    keys, sets, held = [], [], 0
        if held:
            yield from _deal(np.concatenate(keys), np.concatenate(sets), pages)

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """The signatures of one page that several sets hold, with these sets."""
    places, sets, pages, whole = [], [], [], []
    for _, page, n, all_of, least, some, own in zip(*(c.to_pylist() for c in rows.columns)):
        places.append(np.cumsum(_from_planes(some, n), dtype=np.uint64))
        sets.append(_from_planes(own, n).astype(np.int64) + least)
        pages.append(np.full(n, page, np.int64))
        whole.append(np.full(n, all_of))
    if not places:
        return pa.table({"key": pa.array([], pa.int64()), "rep": pa.array([], pa.int64())})
    keys = np.concatenate(places).astype(np.int64) | np.concatenate(pages) << 40
    reps = np.concatenate(sets)
    order = np.argsort(keys, kind="stable")
    keys, reps, kept = keys[order], reps[order], np.concatenate(whole)[order]
    same = keys[1:] == keys[:-1]
    kept[1:] |= same
    kept[:-1] |= same
    return pa.table({"key": pa.array(keys[kept]), "rep": pa.array(reps[kept])})


# --- verification ---------------------------------------------------------------------------


def _verify(n: int, num: int, den: int):
    """Compares the sets of two texts; gives what differs unless that is too much to be of use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["x", "hub", "size", "hub_size", "common", "linked", "delta"]
        for batch in batches:
            left, right, known = _sets(batch.column(2), n), list(batch.column(3).to_pylist()), {}
            rows: list[tuple] = []
            deltas: list[np.ndarray] = []
            far: list[bool] = []
            for own, text in zip(left, right):
                hub = known.get(text)
                if hub is None:
                    if len(known) > 64:
                        known.clear()
                    hub = known[text] = next(_sets(pa.array([text], pa.string()), n))
                common = len(np.intersect1d(own, hub, assume_unique=True))
                apart = len(own) + len(hub) - 2 * common
                linked = den * common >= num * (len(own) + len(hub) - common)
                far.append(apart > NEAR * len(own))
                deltas.append(np.zeros(0, np.int64) if far[-1] else np.setxor1d(own, hub, assume_unique=True).view(np.int64))
                rows.append((len(own), len(hub), common, linked))
            columns = list(zip(*rows)) if rows else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            delta = pc.if_else(pa.array(far, pa.bool_()), pa.scalar(None, pa.list_(pa.int64())), _lists(deltas))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [pa.array(list(c), t) for c, t in zip(columns, types)] + [delta], names=names)

    return run


def _among(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``doc`` is among ``ids`` (of one column), and a few others.

    Three bits of a word for each id, broadcast: a join that follows moves no rows that it would drop.
    """
    words = min(FILTER, ids.count() // FILTERED + 1)
    bits = [f"shiftleft(1L, cast(shiftright(xxhash64({{0}}, 1), {at}) & 63 as int))" for at in (0, 6, 12)]
    word, mask = f"pmod(xxhash64({{0}}), {words}L) as __word", f"{' | '.join(bits)} as __mask"
    held = ids.selectExpr(*(e.format(ids.columns[0]) for e in (word, mask))).groupBy("__word").agg(F.bit_or("__mask").alias("__held"))
    asked = table.selectExpr("*", *(e.format("doc") for e in (word, mask)))
    return asked.join(F.broadcast(held), "__word").filter("__held & __mask = __mask").select(*table.columns)


def _beside(pairs: DataFrame, table: DataFrame, own: list[str], hub: list[str]) -> DataFrame:
    """``pairs`` (x, hub), as written, with columns of ``table`` (by ``doc``) for both; a hub's sets are dealt over SALTS tasks."""
    salt = F.pmod(F.xxhash64("x"), F.lit(SALTS)).alias("salt")
    left = pairs.select("x", "hub", salt).join(_among(table, pairs.select("x")).select(F.col("doc").alias("x"), *map(F.expr, own)), "x")
    right = pairs.select("hub", salt).distinct().join(_among(table, pairs.select("hub")).select(F.col("doc").alias("hub"), *map(F.expr, hub)), "hub")
    return left.join(right, ["hub", "salt"])


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int, name: str) -> DataFrame:
    """``pairs`` (x, hub) with sizes, common elements, whether they link, and the difference."""
    both = _beside(pairs, texts, ["text as tx"], ["text as th"]).select("x", "hub", "tx", "th")
    return written(both.mapInArrow(_verify(n, num, den), "x long, hub long, size long, hub_size long, common long, linked boolean, delta array<long>"), name)


def _folded(sketch: Column, words: Column) -> Column:
    """A sketch of as many words: parities of several places are the parity of all."""
    parity = lambda i: F.aggregate(F.sequence(i, F.size(sketch) - 1, words), F.lit(0).cast("long"), lambda s, at: s.bitwiseXOR(F.get(sketch, at)))
    return F.when(F.size(sketch) <= words, sketch).otherwise(F.transform(F.sequence(F.lit(0), words - 1), parity))


def _sketched(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (x, hub) with both sizes and ``gap``: at least so many elements differ."""
    two = _beside(pairs, facts.withColumnRenamed("rep", "doc"), ["size", "sketch"], ["size as hub_size", "sketch as hub_sketch"])
    words = F.least(F.size("sketch"), F.size("hub_sketch"))
    bits = F.zip_with(_folded(F.col("sketch"), words), _folded(F.col("hub_sketch"), words), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return two.select("x", "hub", "size", "hub_size", F.aggregate(bits, F.lit(0), lambda s, v: s + v).cast("long").alias("gap"))


# --- join -----------------------------------------------------------------------------------


def _share_counted(described: DataFrame) -> float:
    """The share of elements that several classes of sets hold, over one in SAMPLED of the universe."""
    classes = described.filter("size > 0").select("h1", "h2", "size", F.explode("some").alias("element")).distinct()
    counts = classes.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("several")).first()
    return (found.several or 0) / found.all if found.all else 0.0


def _kept_signatures(rows: DataFrame, bands: list[tuple[int, int, int, int]]) -> DataFrame:
    """Signatures that sets share, without each set's most frequent full segments where it has spare ones."""
    counts = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts")
    spare = F.array(*[F.lit(s) for *_, s in bands])
    byte = F.shiftright("key", 32).bitwiseAND(F.lit(0xFF)).cast("int")
    ones = byte >= _ONE
    order = Window.partitionBy("rep", "band").orderBy(F.desc("n"), "key")
    ranked = rows.join(counts, "key").withColumn("band", byte).withColumn("place", F.row_number().over(order))
    return ranked.filter(ones | (F.col("place") > F.get(spare, F.least(F.col("band"), F.lit(_ONE - 1))))).select("rep", "key")


def _with_hub(signatures: DataFrame) -> DataFrame:
    hubs = written(signatures.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub < top").select("key", "hub"), "hubs")
    return signatures.join(hubs, "key").filter("rep <> hub").select("key", "hub", F.col("rep").alias("x"))


def _power(least: Column) -> Column:
    """The least power of two that is no less."""
    return F.call_function("shiftleft", F.lit(1), F.when(least > 1, F.length(F.bin(least.cast("long") - 1))).otherwise(0))


def _sketch_words(differing_most: Column, smallest: Column) -> Column:
    """Words of a sketch in which sets of so many differing elements look unlike sets that have nothing in common, if the sketch of the smallest has them."""
    held = F.greatest(F.lit(SKETCH // 64), F.call_function("shiftright", _power(smallest), F.lit(6)))
    return F.least(F.greatest(F.lit(LANE), _power(F.ceil(differing_most / (64 * 0.4)))), held)


def _unlike(own: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of sketches differ in more bits than ``most``, LANE words at a time."""
    far, rest, bits = np.ones(len(i), bool), np.arange(len(i)), np.zeros(len(i), np.int64)
    for k in range(own.shape[1]):
        counts = np.bitwise_count(own[i[rest], k] ^ own[j[rest], k]).view(np.uint64)[:, 0]
        counts = (counts & _EVEN) + (counts >> np.uint64(8) & _EVEN)
        bits[rest] += (counts * _SUM >> np.uint64(48)).astype(np.int64)
        rest = rest[bits[rest] <= most[rest]]
    far[rest] = False
    return far


def _units(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where the rows of each unit begin, in a table sorted by ``by``."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for name in by:
        own = table[name].to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.flatnonzero(new)


def _meet(table: pa.Table, begins: np.ndarray, num: int, den: int, reach) -> Iterator[pa.RecordBatch]:
    """The pairs of each unit that may link: rows that stand 1, 2, 3 ... apart, in all units at once."""
    column = {name: table[name].to_numpy() for name in table.column_names if name != "bits"}
    column["unit"] = np.repeat(np.arange(len(begins)), np.diff(begins, append=table.num_rows))
    sketches = table["bits"].combine_chunks()
    width = pc.list_value_length(sketches).to_numpy(zero_copy_only=False)
    for words in np.unique(width):
        some = np.flatnonzero(width == words)
        c = {name: values[some] for name, values in column.items()}
        own = sketches.take(pa.array(some)).flatten().to_numpy().view(np.uint64).reshape(len(some), -1, LANE)
        at, step = np.arange(len(some) - 1), 1
        while len(at := at[: np.searchsorted(at, len(some) - step)]):
            at = at[c["unit"][at] == c["unit"][at + step]]
            i, j = at, at + step
            fits = (c["component"][i] != c["component"][j]) & (c["free"][i] | c["free"][j]) & ((c["first"][i] == c["second"][i]) | (c["block"][i] != c["block"][j]))
            i, j = i[fits], j[fits]
            both = c["size"][i] + c["size"][j]
            fits = (np.minimum(c["size"][i], c["size"][j]) * den >= np.maximum(c["size"][i], c["size"][j]) * num) & reach(c, i, j)
            i, j, both = i[fits], j[fits], both[fits]
            alike = ~_unlike(own, i, j, both * (den - num) // (den + num))
            x, y = c["x"][i[alike]], c["x"][j[alike]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "hub"])
            step += 1


def _meetings(by: list[str], num: int, den: int, reach):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest else table
            begins = _units(table, by)
            if len(begins):
                yield from _meet(table.slice(0, begins[-1]), begins[:-1], num, den, reach)
                rest = table.slice(begins[-1])
        if rest:
            yield from _meet(rest, np.zeros(1, np.int64), num, den, reach)

    return run


def _compared(rows: DataFrame, by: list[str], differing_most: Column, sketches: DataFrame, num: int, den: int, reach) -> DataFrame:
    """Pairs (x, hub) of the rows of a group (equal ``by``) that may link: one of them ``free``, components that differ,
    sizes and sketches (folded to what ``differing_most`` elements need) that allow it, and ``reach`` (of columns and two arrays of places).

    A group of many rows is dealt over blocks of about BLOCK; every two blocks meet in a unit of their own.
    """
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c"), F.max("component").alias("d"), F.bool_or("free").alias("some"), F.min("size").alias("smallest"))
    asked = rows.join(groups.filter("n > 1 and c < d and some").select(*by, "n", "smallest"), by)
    last = F.floor((F.col("n") - 1) / BLOCK)
    block = F.pmod(F.xxhash64("x"), last + 1)
    asked = asked.join(sketches.select(F.col("rep").alias("x"), "sketch"), "x").withColumn("words", _sketch_words(differing_most, F.col("smallest"))).withColumn("bits", _folded(F.col("sketch"), F.col("words"))).withColumn("last", last).withColumn("block", block)
    met = asked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    unit = [*by, "first", "second"]
    dealt = met.drop("n", "smallest", "words", "sketch", "last", "other").repartition(*unit).sortWithinPartitions(*unit)
    return dealt.mapInArrow(_meetings(unit, num, den, reach), "x long, hub long")


def _open_pairs(stars: DataFrame, tested: DataFrame, component: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of sets in different components that may still link."""
    label = component.select(F.col("node").alias("x"), "component")
    seen = written(tested.join(label, "x", "left").withColumn("component", F.coalesce("component", "x")), "seen")
    # Close to a common hub: |x - y| is |dx| + |dy| - 2 |dx and dy| for the differences dx and dy to
    # it, so a pair that links shares so many elements of them that it shares one of the rarest.
    salt = F.pmod(F.xxhash64("x"), F.lit(SALTS))
    open_hubs = seen.groupBy("hub").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.min("linked").alias("all")).filter("c < d and not all").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    width = F.size("delta").cast("long")
    slack = width * (den - num) / (den + num)
    most = F.floor(F.col("size") * (den - num) / num)
    overlap = F.when(F.col("linked"), F.ceil((1 + width - F.ceil(slack)) / 2)).otherwise(F.greatest(F.ceil((width - F.floor(slack)) / 2), width - most))
    near = seen.filter(F.col("delta").isNotNull()).withColumn("salt", salt).join(open_hubs, ["hub", "salt"]).withColumn("apart", width)
    near = near.withColumn("short", F.col("apart") - F.greatest(overlap, F.lit(1)) + 1).withColumn("long", F.least("apart", most + 1))
    facts = ["hub", "x", "component", "linked", "size", "hub_size", "apart", "short", "long"]
    near = written(near.select(*facts, F.explode("delta").alias("element")), "differences")
    counts = written(near.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    rarest = Window.partitionBy("hub", "x").orderBy("n", "element")
    everything = near.join(counts, ["hub", "element"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    placed = everything.withColumn("place", F.row_number().over(rarest).cast("long"))
    prefix = placed.filter((F.col("n") > 1) & (F.col("place") <= F.when(F.col("linked"), F.col("short")).otherwise(F.col("long")))).withColumn("free", ~F.col("linked"))
    prefix = written(prefix.select(*[c for c in facts if c != "linked"], "free", "element", "place"), "prefixes")
    bound = F.lit(2 * (den - num) / (den + num) / (1 - NEAR))  # a set near a hub is at most so much larger

    def reach(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        free, other = c["free"][i], c["free"][j]
        short, long = c["place"] <= c["short"], c["place"] <= c["long"]
        alike = np.abs(c["apart"][i] - c["apart"][j]) * (den + num) <= (c["size"][i] + c["size"][j]) * (den - num)
        return alike & (free & other & short[i] & short[j] | free & ~other & long[i] | ~free & other & long[j])

    close = _compared(prefix, ["hub", "element"], F.col("hub_size") * bound, sketches, num, den, reach)
    # far from the hub of a signature: so is any partner
    away = F.coalesce(F.col("size") + F.col("hub_size") - 2 * F.col("common"), F.col("gap"))
    far = seen.filter(away > (NEAR * num / den - (den - num) / num) * F.col("size") - 1).withColumn("free", F.col("delta").isNull())
    lows = F.array(*[F.lit(int(e)) for e in band_edges(num, den)])
    differing_most = F.get(lows, F.shiftright("key", 32).bitwiseAND(F.lit(_ONE - 1)).cast("int") + 1) * F.lit(2 * (den - num) / (den + num))
    members = written(stars.join(far.select("x", "hub", "component", "size", "free"), ["x", "hub"]).select("key", "x", "component", "size", "free"), "far")
    apart = _compared(members, ["key"], differing_most, sketches, num, den, lambda c, i, j: np.ones(len(i), bool))
    return close.union(apart).distinct()


def _foremost(pairs: DataFrame, component: DataFrame, share: int) -> DataFrame:
    """For each component, the pairs of the least gap that lead out of it, one of each of ``share`` parts."""
    part = F.pmod(F.xxhash64("x", "hub"), F.lit(share)).alias("part")
    ends = pairs.select(F.explode(F.array("x", "hub")).alias("node"), part, F.struct("gap", "x", "hub").alias("pair")).join(component, "node", "left")
    return ends.groupBy(F.coalesce("component", "node").alias("component"), "part").agg(F.min("pair").alias("pair")).select("pair.x", "pair.hub").distinct()


def _settled(pairs: DataFrame, component: DataFrame, own: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``component`` (node, component) with what the ``pairs`` (x, hub, gap) that link bring together.

    Many pairs go in rounds, each component's most alike first and four times as many in each round:
    what these bring together needs none of the others.
    """
    share = 1
    while True:
        many = pairs.count() > ROUND
        chosen = written(_foremost(pairs, component, share), "foremost") if many else pairs.select("x", "hub")
        links = _verified(chosen, own, n, num, den, "late").filter("linked").select(F.col("x").alias("a"), F.col("hub").alias("b"))
        if not links.isEmpty():
            component = connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
        if not many:
            return component
        rest = pairs.join(chosen, ["x", "hub"], "left_anti")
        for end in ("x", "hub"):
            rest = rest.join(component.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
        pairs = written(rest.filter("coalesce(x_in, x) <> coalesce(hub_in, hub)").select("x", "hub", "gap"), "rest")
        share *= 4


def jaccard_components(documents: DataFrame, n: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text", shared: float | None = None) -> DataFrame:
    """``doc``, ``size`` (of its set) and ``component`` (least linked id) for each row.

    ``shared`` overrides the counted share of elements that several sets hold.
    """
    everything = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    described = written(everything.mapInArrow(_describe(n), "doc long, size long, h1 long, h2 long, sketch array<long>, some array<long>"), "sets")
    members, identity = described.select("doc", "size", "h1", "h2"), ["h1", "h2", "size"]
    own, known = everything.filter("doc is not null"), described.filter("doc is not null and size > 0")
    facts = written(known.groupBy(*identity).agg(F.min("doc").alias("rep"), F.first("sketch").alias("sketch")), "facts")
    bands = plans(num, den, _share_counted(known) if shared is None else shared)
    volume = facts.agg(F.sum("size")).first()[0] or 0
    pages = int(volume * (den - num) * 2 // (num * PAGE)) + 1
    texts = own.join(facts.select(F.col("rep").alias("doc")), "doc", "left_semi").select("doc", "text")
    dealt = texts.mapInArrow(_sign(n, num, den, bands, pages), _DEALT)
    rows = written(dealt.groupBy("to").applyInArrow(_shared, "key long, rep long"), "signatures")
    stars = written(_with_hub(written(_kept_signatures(rows, bands), "kept")), "stars")
    pairs = written(_sketched(written(stars.select("x", "hub").distinct(), "starred"), facts), "pairs")
    near = F.col("gap") <= NEAR * F.col("size")
    tested = _verified(pairs.filter(near), own, n, num, den, "tested")
    links = tested.filter("linked").select(F.col("x").alias("a"), F.col("hub").alias("b"))
    component = connected_components(links)
    seen = tested.withColumn("gap", F.lit(None).cast("long")).unionByName(pairs.filter(~near).withColumn("linked", F.lit(False)), allowMissingColumns=True)
    still = written(_sketched(written(_open_pairs(stars, seen, component, facts, num, den), "unsettled"), facts), "open")
    alike = (F.col("gap") * (den + num) <= (F.col("size") + F.col("hub_size")) * (den - num)) & (F.least("size", "hub_size") * den >= F.greatest("size", "hub_size") * num)
    component = _settled(still.filter(alike).select("x", "hub", (F.col("gap") / (F.col("size") + F.col("hub_size"))).alias("gap")), component, own, n, num, den)
    labelled = facts.select("rep", *identity).join(component.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "size", F.coalesce("component", "rep").alias("component"))
    return members.join(labelled, identity, "left").select("doc", "size", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def op3_ngram_join(spark, folder: str) -> DataFrame:
    """Components of all documents under similarity of at least 0.9 of their 3-word sets."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = jaccard_components(documents, 3, 90, 100)
    return found.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


#: Counts what every two sets have in common; the least id of a component reaches all of it over greater ids.
OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i : i + 2], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS i FROM w WHERE len(l) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), links AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.d WHERE links.b > reach.r
), least AS (
  SELECT d, min(r) AS component_id FROM reach GROUP BY d
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.d = w.doc_id
"""
