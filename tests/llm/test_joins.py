"""Line dedup, Jaccard join, decontamination, search, archives and packing against plain versions."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from barframe.llm import decontaminate, line_dedup, ngram_join, packing, topk, warc
from barframe.llm.components import connected_components

WORDS = "ash birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def corpus(seed=5):
    """Copies, near copies of all grades, shared passages, short, empty and null texts, one long text."""
    rng, out = random.Random(seed), []
    for _ in range(8):
        base = text(rng, rng.choice([12, 30, 60, 150])).split()
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 99))
            out.append(" ".join(own))
    passage = text(rng, 50)
    out += [passage + " " + text(rng, n) for n in (1, 2, 4, 8, 30)] + ["", None, "one", "one two", "One  two", text(rng, 20_000), "  \n ", passage.upper()]
    return list(enumerate(out))


# --- components ---------------------------------------------------------------------------


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 140)} == {100} and got[201] == got[200] == 200


# --- n-gram join --------------------------------------------------------------------------


def plain_components(docs, n, num, den):
    sets = {}
    for doc, t in docs:
        words = (t or "").lower().split()
        sets[doc] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def large_sets(seed=9):
    """Near copies of 400 to 3,000 shingles around both thresholds, a cluster, and boilerplate that many share."""
    rng, out = random.Random(seed), []
    common = text(rng, 120)
    for size in (400, 700, 1200, 3000):
        base = text(rng, size).split()
        for share in (0.005, 0.01, 0.016, 0.02, 0.03, 0.045):
            own = list(base)
            for at in rng.sample(range(len(own)), int(share * len(own))):
                own[at] = f"edit{rng.randint(0, 10**6)}"
            out.append(" ".join(own))
        out += [" ".join(base), " ".join(base[: int(0.93 * size)]), " ".join(base[: int(0.83 * size)])]
    base = text(rng, 500).split()
    for k in range(40):
        own = list(base)
        for at in rng.sample(range(len(own)), 1 + k // 4):
            own[at] = f"turn{k}"
        out.append(" ".join(own))
    out += [common + " " + text(rng, rng.randint(5, 60)) for _ in range(30)]
    return list(enumerate(out))


@pytest.mark.parametrize("make", [corpus, large_sets])
@pytest.mark.parametrize("n,num,den,shared", [(3, 90, 100, None), (5, 80, 100, None), (5, 80, 100, 0.9)])
def test_join_finds_every_link(spark, make, n, num, den, shared):
    docs = make()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("x")).withColumn("component", F.lit(0))
    got = {r.doc: (r["size"], r.component) for r in ngram_join.jaccard_components(table, n, num, den, shared=shared).collect()}
    assert got == plain_components(docs, n, num, den)


def test_common_elements_buy_deletion_segments():
    assert sum(ones > 1 for _, _, ones, _ in ngram_join.plans(80, 100, 0.9)[5:25]) > 5
    assert all(ones == 0 for _, _, ones, _ in ngram_join.plans(80, 100, 0.01)[5:25])


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_deletion_segments_alone_lose_no_link(spark, monkeypatch, n, num, den):
    monkeypatch.setattr(ngram_join, "allocate", lambda size, h, shared=0.0: (h + 1 - (h + 1) // 2, (h + 1) // 2, 0))
    docs = large_sets(4)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc: (r["size"], r.component) for r in ngram_join.jaccard_components(table, n, num, den).collect()} == plain_components(docs, n, num, den)


def test_places_come_back():
    rng = np.random.default_rng(3)
    keys, sets = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 300, 5000)
    keys[:600], keys[600:900] = keys[0], np.repeat(keys[1000:1150], 2)
    rows = pa.Table.from_batches(list(ngram_join._deal(keys, sets, 7)))
    found = []
    for to in set(rows["to"].to_pylist()):
        part = ngram_join._shared(rows.filter(pa.compute.equal(rows["to"], to)))
        found += zip(part["key"].to_pylist(), part["rep"].to_pylist())
    by_key = defaultdict(list)
    for k, s in zip(keys.tolist(), sets.tolist()):
        by_key[k].append(s)
    assert sorted(sorted(v) for v in by_key.values() if len(v) > 1) == sorted(sorted(s for k2, s in found if k2 == k) for k in {k for k, _ in found})


def test_join_of_nothing_and_of_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty, 3, 90, 100).count() == 0
    some = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "A B C D"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc, r.component) for r in ngram_join.jaccard_components(some, 3, 90, 100).collect()), key=str) == [(2, 2), (3, 2), (3, 2), (None, None), (None, None)]


def shuffled_rows(df):
    """Rows that the exchanges of an executed DataFrame wrote."""

    def below(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return below(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return below(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        children = node.children()
        return own + sum(below(children.apply(k)) for k in range(children.size()))

    df.collect()
    return below(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("most", [1 << 20, 8])
def test_only_texts_of_pairs_are_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "FILTER", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(k, f"t{k}") for k in range(5000)] + [(8, "again"), (-3, "below")], "doc long, text string")
        pairs = spark.createDataFrame([(8, 7), (900, 7), (4001, -3), (4002, 12)], "x long, hub long")
        both = ngram_join._beside(pairs, texts, ["text as tx"], ["text as th"]).select("x", "hub", "tx", "th")
        assert sorted(map(tuple, both.collect())) == [(8, 7, "again", "t7"), (8, 7, "t8", "t7"), (900, 7, "t900", "t7"), (4001, -3, "t4001", "below"), (4002, 12, "t4002", "t12")]
        assert shuffled_rows(both) < 500
        # a full filter lets other rows pass and loses none
        ids = spark.range(0, 5000, 2).select(F.col("id").alias("x"))
        kept = {r.doc for r in ngram_join._among(texts, ids).collect()}
        assert kept >= set(range(0, 5000, 2)) and (most == 8 or len(kept) < 2700)
        assert ngram_join._among(texts, ids.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def some_sets(rng, n, low, high):
    """Sets of sizes from low to high, each third one unlike the others and followed by two near copies, of different sizes."""
    out = []
    for x in range(n):
        if x % 3 == 0:
            own = rng.integers(0, 2**63, int(rng.integers(low, high)), dtype=np.uint64)
        else:
            own = np.concatenate([own[int(rng.integers(0, low // 20)) :], rng.integers(0, 2**63, int(rng.integers(0, low // 20)), dtype=np.uint64)])
        out.append(np.unique(own))
    return out


def bits_apart(a, b, words):
    folded = [np.bitwise_xor.reduce(s.reshape(-1, words), axis=0) for s in (a, b)]
    return int(np.bitwise_count(folded[0] ^ folded[1]).sum())


@pytest.mark.parametrize("block,low,high", [(3, 90, 110), (8, 3900, 4300), (512, 2000, 2100)])
def test_rows_of_a_group_meet_over_all_blocks(spark, monkeypatch, block, low, high):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(block)
    sets = some_sets(rng, 70, low, high)
    bits = [ngram_join._sketch(s) for s in sets]
    rows = [(g, x, int(rng.integers(0, 5)), len(sets[x]), bool(rng.integers(0, 2))) for x in range(70) for g in (x % 2, 2 + x % 4, 6, 7 + x)]
    table = spark.createDataFrame(rows, "key long, x long, component long, size long, free boolean")
    facts = spark.createDataFrame([(x, bits[x].tolist()) for x in range(70)], "rep long, sketch array<long>")
    got = ngram_join._compared(table, ["key"], F.col("key") % 3 * 400 + 100, facts, 80, 100, lambda c, i, j: np.abs(c["size"][i] - c["size"][j]) < low // 15)
    plain, shortest = set(), {g: min(len(bits[z]) for k, z, *_ in rows if k == g) for g, *_ in rows}
    for g, x, c, size, free in rows:
        for h, y, d, width, other in rows:
            words = min((8, 32, 64)[g % 3], shortest[g])
            if g == h and x < y and c != d and (free or other) and abs(size - width) < low // 15 and 100 * min(size, width) >= 80 * max(size, width):
                if 180 * bits_apart(bits[x].view(np.uint64), bits[y].view(np.uint64), words) <= 20 * (size + width):
                    plain.add((x, y))
    assert plain and {(r.x, r.hub) for r in got.collect()} == plain


def test_many_sets_of_one_signature_are_compared_in_time(spark):
    n, alike, rng = 6000, [(a, a + 1) for a in range(1, 5990, 500)], np.random.default_rng(1)
    bits = rng.integers(0, 2**64, (n, ngram_join.SKETCH // 64), dtype=np.uint64)
    for a, b in alike:
        bits[b] = bits[a]
        bits[b, :10] ^= np.uint64(1) << rng.integers(0, 64, 10, dtype=np.uint64)
    key = int(np.searchsorted(ngram_join.band_edges(80, 100), 1000, side="right") - 1) << 32
    x = [(k,) for k in range(1, n)]
    stars = spark.createDataFrame([(key, 0, *k) for k in x], "key long, hub long, x long")
    seen = spark.createDataFrame([(*k, 0, 1000, 1000, False, 900) for k in x], "x long, hub long, size long, hub_size long, linked boolean, gap long").withColumn("common", F.lit(None).cast("long")).withColumn("delta", F.lit(None).cast("array<long>"))
    facts = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(bits.view(np.int64))], "rep long, sketch array<long>")
    component = spark.createDataFrame([], "node long, component long")
    began = time.monotonic()
    got = ngram_join._open_pairs(stars, seen, component, facts, 80, 100).collect()
    assert {(r.x, r.hub) for r in got} == set(alike)
    assert time.monotonic() - began < 40


@pytest.mark.parametrize("low,high", [(20, 60), (1900, 2200), (3900, 4300), (9000, 20000)])
def test_sketches_tell_sets_of_any_size_apart(spark, low, high):
    rng = np.random.default_rng(low)
    sets = some_sets(rng, 24, low, high)
    facts = spark.createDataFrame([(x, len(s), ngram_join._sketch(s).tolist()) for x, s in enumerate(sets)], "rep long, size long, sketch array<long>")
    pairs = spark.createDataFrame([(x, y) for x in range(24) for y in range(x)], "x long, hub long")
    for r in ngram_join._sketched(pairs, facts).collect():
        assert r.gap <= len(np.setxor1d(sets[r.x], sets[r.hub]))
        if r.x // 3 != r.hub // 3 and 100 * min(r["size"], r.hub_size) >= 80 * max(r["size"], r.hub_size):
            assert 180 * r.gap > 30 * (r["size"] + r.hub_size)  # a third more than 20, what may differ


def test_pairs_that_bring_together_spare_the_others(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUND", 10)
    looked, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *rest: looked.append(pairs.count()) or verified(pairs, *rest))
    rng = random.Random(2)
    docs = []
    for base in (text(rng, 200).split(), text(rng, 200).split()):
        docs += [(len(docs) + k, " ".join(base[:k] + [f"own{len(docs) + k}"] + base[k + 1 :])) for k in range(0, 30)]
    own = spark.createDataFrame(docs, "doc long, text string")
    pairs = [(x, y, abs(x - y) / 100) for x in range(60) for y in range(x)]
    component = spark.createDataFrame([(k, 0) for k in range(5)], "node long, component long")
    found = ngram_join._settled(spark.createDataFrame(pairs, "x long, hub long, gap double"), component, own, 5, 80, 100)
    assert {r.node: r.component for r in found.collect()} == {k: k // 30 * 30 for k in range(60)}
    assert sum(looked) < len(pairs)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_join_in_rounds_and_small_blocks_finds_every_link(spark, monkeypatch, n, num, den):
    monkeypatch.setattr(ngram_join, "ROUND", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    docs = large_sets(11)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc: (r["size"], r.component) for r in ngram_join.jaccard_components(table, n, num, den).collect()} == plain_components(docs, n, num, den)


def test_plans_cover_what_may_differ():
    for num, den, shared in ((90, 100, 0), (80, 100, 0), (1, 2, 0), (80, 100, 0.95), (90, 100, 0.99)):
        edges = ngram_join.band_edges(num, den)
        for (low, m, ones, spare), high in zip(ngram_join.plans(num, den, shared)[:40], edges[1:]):
            h = ngram_join.differing(int(high) - 1, int(high) - 1, num, den)
            assert not h and not m or m + ones >= h + 1 + spare


# --- lines --------------------------------------------------------------------------------


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    levels, rest, index = line_dedup.build_mphf(keys)
    assert sorted(index) == list(range(len(keys)))
    assert (line_dedup.probe_mphf(levels, rest, keys) == index).all()
    assert line_dedup.build_mphf(keys[:0])[2].size == 0


def test_lines_stay_in_the_smallest_document(spark):
    line = "A line that is long enough"
    docs = [(4, f"{line}\nshort\nown text of four\n{line}"), (2, f"  {line.upper()}\t\nshort"), (9, line), (9, line), (5, ""), (6, None), (None, line), (7, f"x\n\n{line} \n")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("h1", F.lit("a"))
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.row, r.h1) for r in line_dedup.dedup_lines(table).collect()), key=str)
    want = [(4, "short\nown text of four", 4, 2, 1, "a"), (2, f"  {line.upper()}\t\nshort", 2, 0, 1, "a"), (9, "", 1, 1, 1, "a"), (9, "", 1, 1, 1, "a"), (5, "", 1, 0, 1, "a"), (6, None, 1, 0, 1, "a"), (None, line, 1, 0, 1, "a"), (7, "x\n\n", 4, 1, 1, "a")]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(table.filter("doc_id > 99")).count() == 0


# --- leaks --------------------------------------------------------------------------------


def plain_alignment(item, words):
    best, row = 0, [0] * (len(words) + 1)
    for a in item:
        new = [0]
        for k, b in enumerate(words):
            new.append(max(0, row[k] + (2 if a == b else -1), row[k + 1] - 1, new[k] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_the_plain_one():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, words = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        score, begin, end = decontaminate.smith_waterman(item, words)
        assert score == plain_alignment(list(item), list(words))
        assert score == 0 or plain_alignment(list(item), list(words[begin:end])) == score


def test_leaks_are_found_and_clean_documents_stay(spark):
    rng = random.Random(3)
    items = [(k, text(rng, 30)) for k in range(6)] + [(6, None), (7, ""), (8, "two words")]
    edited = items[1][1].split()
    for k in (4, 12, 20, 27):
        edited[k] = "changed"
    del edited[9]
    docs = [(1, text(rng, 40) + " " + items[0][1].upper() + " " + text(rng, 40)), (2, " ".join(edited)), (3, text(rng, 200)), (4, None), (5, ""), (6, " ".join(items[2][1].split()[:9]) + " " + text(rng, 60)), (None, items[0][1]), (7, "here are two words"), (8, items[3][1]), (8, items[3][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("overlap", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc, r.item): r.overlap for r in decontaminate.find_leaks(table, bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (7, 8), (8, 3)} and found[1, 0] == 1.0
    assert sorted(map(str, (r.doc_id for r in decontaminate.decontaminate(table, bench).collect()))) == ["3", "4", "5", "6", "None"]
    assert decontaminate.find_leaks(table, bench.filter("item_id > 99")).count() == 0
    assert decontaminate.find_leaks(table.filter("doc_id > 99"), bench).count() == 0


def test_repeated_items_are_all_looked_for(spark):
    rng = random.Random(12)
    a, b = text(rng, 25), text(rng, 25)
    bench = spark.createDataFrame([(7, a), (7, b), (7, b)], "item_id long, text string")
    table = spark.createDataFrame([(1, "so " + a), (2, b + " end"), (3, a + " " + b)], "doc_id long, text string")
    assert sorted((r.doc, r.item, r.overlap) for r in decontaminate.find_leaks(table, bench).collect()) == [(1, 7, 1.0), (2, 7, 1.0), (3, 7, 1.0)]


@pytest.mark.parametrize("replaced", [0.0, 0.1, 0.2, 0.3])
def test_leaks_equal_brute_force_and_recall_stays(spark, replaced):
    rng = random.Random(int(replaced * 100))
    items = [(k, text(rng, rng.choice([5, 12, 20, 40]))) for k in range(12)] + [(3, text(rng, 15))]
    docs = []
    for k in range(60):
        words = rng.choice(items)[1].split()
        edited = []
        for w in words:
            chance = rng.random()
            if chance < replaced:
                edited += rng.choice([[], ["other"], [w, "more"]])
            else:
                edited.append(w)
        docs.append((k, " ".join([text(rng, rng.randint(0, 30)), *edited, text(rng, rng.randint(0, 30))])))
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc, r.item): r.overlap for r in decontaminate.find_leaks(table, bench).collect()}
    want, seeded = {}, {}
    for d, t in docs:
        words = t.split()
        runs = {tuple(words[k : k + 4]) for k in range(len(words) - 3)}
        for item, own in items:
            own = own.split()
            share = plain_alignment(own, words) / (2 * len(own))
            if share >= 0.5 and (len(own) >= 8 or share == 1):
                want[d, item] = max(share, want.get((d, item), 0))
                if any(tuple(own[k : k + 4]) in runs for k in range(len(own) - 3)):
                    seeded[d, item] = want[d, item]
    assert set(got) == set(seeded) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("every", [5, 6])
@pytest.mark.parametrize("size", [20, 40, 60])
def test_copies_with_regular_edits_are_found(spark, every, size):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(size))) for k in range(8)]
    edited = [" ".join("new" if j % every == every - 1 else w for j, w in enumerate(t.split())) for _, t in items]
    docs = [(k, f"before it {t} and after") for k, t in enumerate(edited)] + [(100, items[0][1]), (101, "just " * 50)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc, r.item): r.overlap for r in decontaminate.find_leaks(table, bench).collect()}
    assert set(found) == {(k, k) for k in range(8)} | {(100, 0)} and found[100, 0] == 1.0
    words = [t.split() for _, t in items]
    assert all(found[k, k] == round(plain_alignment(words[k], edited[k].split()) / (2 * size), 6) for k in range(8))


# --- search -------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [1.0, 1e-3])
def test_search_equals_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(0, spread, 6) + (k % 3)).tolist()) for k in range(300)] + [(300 + k, [0.5] * 6) for k in range(40)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (450, []), (500, [9.0, 1.0]), (500, [9.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("data", F.lit(1))
    clean = [(i, np.pad(np.floor(256 * np.array(v, float)), (0, 6 - len(v)))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = defaultdict(list)
    for r in topk.top_products(table, table.filter("vec_id % 50 = 0"), 5).collect():
        got[r.query].append((r["rank"], r["id"], r.score))
    for i, q in {i: q for i, q in clean if i % 50 == 0 and i != 500}.items():
        want = sorted(((-int(q @ x), j) for j, x in clean if j != i))[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]


def test_search_of_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query, r["id"], r.score) for r in topk.top_products(table, table.filter("vec_id = 0"), 5).collect()] == [(0, 1, 131072)]
    assert topk.top_products(table.filter("vec_id > 5"), table.filter("vec_id > 5"), 5).count() == 0


# --- archives -----------------------------------------------------------------------------


def test_archives_come_back_with_revisits(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 600
    rows = [(1, "http://a/", big), (5, "http://b/\r\n", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", ""), (7, "u", None)]
    pages = spark.createDataFrame(rows, "id long, url string, payload string")
    records = pages.select("*", F.octet_length(F.coalesce("payload", F.lit(""))).cast("long").alias("payload_bytes"), F.sha1(F.encode(F.coalesce("payload", F.lit("")), "UTF-8")).alias("digest"))
    path = warc.shared_folder(spark, "test")
    warc.write_archives(warc.resolve_revisits(records), path)
    back = {r.id: r for r in warc.read_archives(spark, path).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in back.items()} == {5: ("response", None), 1: ("revisit", 5), 3: ("revisit", 5), **{k: ("response", None) for k in (2, 4, 6, 7)}}
    assert bytes(back[5].payload).decode() == big and bytes(back[2].payload) == b"small" and bytes(back[7].payload) == b"" and back[1].payload is None
    warc.write_archives(warc.resolve_revisits(records.filter("id > 99")), path + "-none")
    assert warc.read_archives(spark, path + "-none").count() == 0


def test_archives_of_repeated_and_null_ids_and_of_many_copies(spark, tmp_path):
    big, other = "b" * 1500, "o" * 1200
    rows = [(5, "u", big), (5, "u", big), (1, "u", big), (None, "u", big), (None, "v", "x"), (5, "u", other), (4, " u: ", other)]
    rows += [(1000 + k, f"http://h/{k}", "copy" * 300) for k in range(10_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op10_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    few = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got if (r.page_id or 0) < 1000), key=str)
    want = [(5, 1500, "response", None), (5, 1500, "response", None), (1, 1500, "revisit", 5), (None, 1500, "response", None), (None, 1, "response", None), (5, 1200, "response", None), (4, 1200, "revisit", 5)]
    assert few == sorted(want, key=str)
    many = [(r.record_type, r.refers_to) for r in got if (r.page_id or 0) >= 1000]
    assert many.count(("revisit", 10_999)) == 9999 and many.count(("response", None)) == 1


# --- packing ------------------------------------------------------------------------------


def test_pieces_round_trip_without_padding(spark):
    from tokenizers import Tokenizer

    docs = corpus() + [(900, "a <|endoftext|> b 中文   x"), (901, "  it's  12 ½ 3rd\t\n\n"), (902, "it's")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1))
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs}
    sequences, own = defaultdict(list), defaultdict(dict)
    for r in packing.pack_documents(table, length=128).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r["length"] and r.doc_tokens == len(want[r.doc])
        own[r.doc][r.start] = ids
        sequences[r.sequence_id].append((r.offset, len(ids)))
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in own.items()} == want
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and (ends[-1] == 128 or ends[-1] & (ends[-1] - 1) == 0)
    assert packing.pack_documents(table.filter("doc_id > 999")).count() == 0


def test_curve_visits_neighbours():
    keys = {}
    for a in range(8):
        for b in range(8):
            for c in range(2):
                for d in range(2):
                    keys[packing.hilbert_key(np.array([a, b, c, d]))] = (a, b, c, d)
    assert len(keys) == 256
    runs = sorted(keys)
    near = sum(sum(abs(x - y) for x, y in zip(keys[p], keys[q])) == 1 for p, q in zip(runs, runs[1:]) if q == p + 1)
    assert near == sum(q == p + 1 for p, q in zip(runs, runs[1:]))
    assert zlib.crc32(b"") == 0 and pa.array([1]).type == pa.int64()
