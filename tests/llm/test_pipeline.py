"""Every stage of the corpus pipeline, as wired, against a plain version on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barframe.llm import packing, quality
from tests.llm.test_joins import plain_alignment, plain_components, text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, component long, h1 string"


def rows(seed=21):
    """Good prose, junk, shared lines, copies and near copies, leaked items; repeated and null ids, null and empty texts."""
    rng = random.Random(seed)
    items = [(k, text(rng, 25)) for k in range(4)] + [(2, text(rng, 25)), (9, None)]
    docs = [(k, "\n".join(text(rng, 30) for _ in range(rng.randint(1, 4)))) for k in range(40)]
    docs += [(100 + k, "".join(rng.choice("#@$%!?*&") for _ in range(300))) for k in range(20)]
    docs += [(200 + k, docs[k][1].replace("oak", "tree") if k % 2 else docs[k][1]) for k in range(6)]
    shared = "this line stands in several documents"
    docs += [(300 + k, f"{text(rng, 40)}\n{shared.upper() if k == 1 else shared}\n{text(rng, 10)}") for k in range(3)]
    docs += [(400 + k, f"{text(rng, 20)} {t} {text(rng, 20)}") for k, (_, t) in enumerate(items) if t]
    docs += [(500, ""), (501, None), (None, docs[3][1]), (None, None), (3, docs[3][1]), (600, docs[5][1] + "\n" + docs[5][1])]
    labels = [(d, int(d < 100), 0) for d, _ in docs[:60]]
    return docs, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs, items, labels = rows()
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 1, "y") for d, t in docs], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_quality_keeps_what_the_plain_score_keeps(spark, folder):
    docs = documents(spark, folder)
    kept = corpus_pipeline.quality(spark, docs, folder)
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    plain = [(r.doc_id, r.text) for r in docs.collect() if quality.score_text(model, np.frombuffer((r.text or "").encode(), np.uint8)) >= corpus_pipeline.REJECT]
    assert kept.columns == docs.columns and pairs(kept) == sorted(plain, key=repr)
    ids = {d for d, _ in plain}
    assert set(range(40)) <= ids and not ids & set(range(100, 120))


def test_lines_equal_the_plain_ones(spark, folder):
    docs = documents(spark, folder)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    first = {}
    for r in docs.collect():
        for line in (r.text or "").split("\n") if r.doc_id is not None else []:
            first[key(line)] = min(first.get(key(line), r.doc_id), r.doc_id)
    plain = []
    for r in docs.collect():
        own = [line for line in (r.text or "").split("\n") if r.doc_id is None or len(key(line)) < 10 or first[key(line)] >= r.doc_id]
        plain.append((r.doc_id, None if r.text is None else "\n".join(own)))
    kept = corpus_pipeline.lines(spark, docs, folder)
    assert kept.columns == docs.columns and pairs(kept) == sorted(plain, key=repr)
    assert all(r.n_chars == len(r.text) for r in kept.filter("text is not null").collect())


def test_one_document_of_each_group_stays(spark, folder):
    docs = documents(spark, folder)
    kept = corpus_pipeline.near_duplicates(spark, docs, folder)
    group = {d: c for d, (_, c) in plain_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 5, 80, 100).items()}
    plain = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or group[r.doc_id] == r.doc_id]
    assert kept.columns == docs.columns and pairs(kept) == sorted(plain, key=repr)
    assert len(plain) < docs.count() - 4


def test_leaks_equal_brute_force(spark, folder):
    docs = documents(spark, folder)
    items = [r.text.split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    plain = []
    for r in docs.collect():
        words = (r.text or "").split()
        leaked = r.doc_id is not None and any(plain_alignment(i, words) >= 0.5 * 2 * len(i) for i in items)
        plain.append((r.doc_id, r.text, leaked))
    gone = {d for d, _, leaked in plain if leaked}
    kept = corpus_pipeline.leaks(spark, docs, folder)
    assert kept.columns == docs.columns and pairs(kept) == sorted(((d, t) for d, t, _ in plain if d not in gone), key=repr)
    assert len(gone) == 5


def test_packing_holds_every_id_of_what_stays(spark, folder):
    from tokenizers import Tokenizer

    docs = documents(spark, folder).filter("doc_id is not null").dropDuplicates(["doc_id"])
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = corpus_pipeline.packing(spark, docs, folder).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id: r.n for r in got} == want == {r.doc_id: r["all"] for r in got}


def test_stages_of_an_empty_table(spark, folder):
    none = documents(spark, folder).filter("doc_id > 9999")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_run_is_the_stages_in_turn(spark, folder):
    pieces = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert set(range(40)) <= ids and not ids & {*range(100, 120), *range(400, 405)}
