import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from barframe.llm import html_extract, quality

FOLDER = "/root/testdata/sf0.01"


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 255, 256, 257, 1000, 4096):
        starts = quality.chunk_starts(n)
        assert starts[0] == 0 and starts[-1] + quality.CHUNK >= n and (np.diff(starts) == quality.STEP).all()


def test_features_equal_a_plain_forward_pass():
    rng = np.random.default_rng(5)
    tables = rng.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32)
    offsets = rng.normal(0, 1, quality.FILTERS).astype(np.float32)
    for n in (0, 1, 3, 4, 70, 256, 257, 700, 2000):
        text = rng.integers(0, 256, n).astype(np.uint8)
        padded = list(text) + [0] * quality.WIDTH
        answers = [[max(0.0, offsets[f] + sum(tables[k][padded[at + k]][f] for k in range(quality.WIDTH))) for f in range(quality.FILTERS)] for at in range(max(1, n - quality.WIDTH + 1))]
        peaks = [np.max(answers[s : s + quality.CHUNK], axis=0) for s in quality.chunk_starts(n) if s < len(answers)]
        assert np.allclose(quality.features(tables, offsets, text), np.concatenate([np.mean(peaks, axis=0), np.mean(answers, axis=0)]), atol=1e-4), n


def test_odd_columns_and_repeated_rows_are_scored(spark):
    table = spark.createDataFrame([(1, "a b", 2), (1, "a b", 2), (None, None, None)], "doc_id long, text string, `my col` long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(table, quality.fit_quality(table, labels)).columns == ["doc_id", "text", "my col", "quality_score"]


def test_held_out_documents_are_told_apart(spark):
    rows = quality.op4_quality(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def test_scores_of_odd_texts_and_without_labels(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["and", "the", "oak"]) for _ in range(30)) if k % 2 else "@@## !!" * 20) for k in range(80)] + [(90, None), (91, ""), (92, "x" * 100_000), (None, "a"), (1, "and the")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(None, 1, 0), (5, None, 0), (200, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(table, labels)
    scored = quality.score_quality(table, model).collect()
    assert len(scored) == len(docs) and all(0 <= r.quality_score <= 1 for r in scored)
    good, bad = ([r.quality_score for r in scored if r.doc_id in range(2, 80) and r.doc_id % 2 == k] for k in (1, 0))
    assert min(good) > max(bad)
    none = quality.fit_quality(table, labels.filter("doc_id > 999"))
    assert {r.quality_score for r in quality.score_quality(table, none).collect()} == {0.5}
    assert quality.score_quality(table.filter("doc_id > 999"), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="page"><nav><ul><li><a>menu</a></ul></nav>
<div class="ad">buy</div><div id=cookie-notice>we use</div><article><h1>Title &amp; more</h1><p><b>One
 two.<br><p>Th&eacute; <i>third</i>&nbsp;x</p><form>send</form><div class="comments"><p>first!</p></div><!-- no --><p hidden>gone</p></article><aside>side</aside><footer>&copy; end</footer></body></html>"""


def test_only_slots_with_template_words_are_searched_for_them(monkeypatch):
    page = "<div>By <b>Ann</b> on</div>" + "".join(f"<p>text {k}\u00a0 and\x1fmore\u2003</p>" for k in range(50)) + "<p>the\nend</p> <i></i>"
    slots, tags = html_extract.walk(page)
    found, _, begins = html_extract.page_tokens(slots, tags)
    names = [int(found[begins[k]]) for k in (0, 2)]  # the words By and on
    searched = []

    class Counted:
        @staticmethod
        def sub(replace, text):
            searched.append(text)
            return html_extract.re.sub(r"[^\x20\x09-\x0D]+", replace, text)

    monkeypatch.setattr(html_extract, "_WORD", Counted)
    got = html_extract.main_text(page, [names[:2]])
    assert got == "\n".join(["Ann", *(f"text {k} and more" for k in range(50)), "the end"])
    assert searched == ["By ", " on"]
    assert all((" ".join(f"a{chr(c)}b".split()) == "a b") == bool(html_extract.re.match(r"\s", chr(c))) or chr(c) == " " for c in range(0x110000))


def test_main_text_of_pages():
    assert html_extract.main_text(PAGE) == "Title & more\nOne two.\nThé third x"
    assert html_extract.main_text(None) == "" == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>")
    assert html_extract.main_text("<div><p>a<p>b</div>tail") == "a\nb\ntail"
    assert html_extract.main_text("no markup <  here & there") == "no markup < here & there"
    assert html_extract.main_text("<p>" * 5000 + "deep") == "deep"


def test_template_words_go_where_no_element_tells(spark):
    rows = [(k, "http://h.example/x", f"<div>Welcome to our site</div><div>story {'abcdefghij'[k]} tells {k}</div>") for k in range(10)] + [(20, None, "<p>lone</p>"), (21, "nonsense", None), (1, "http://h.example/y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("template", F.lit("t"))
    got = [(r.page_id, r.text, r.host) for r in html_extract.extract_main_text(pages).collect()]
    assert len(got) == len(rows) and (20, "lone", 1) in got and (21, "", 1) in got
    assert all("Welcome" not in t for i, t, _ in got) and any("abcdefghij"[3] in t for i, t, _ in got if i == 3)
    assert html_extract.extract_main_text(pages.filter("page_id > 99")).count() == 0


def test_copied_articles_stay_and_blanks_between_slots_stay(spark):
    story = " ".join(f"word{k}" for k in range(40))
    rows = [(k, "http://copies.example/", f"<div>{story}</div><!-- {k} --><script>track({k})</script>") for k in range(30)]
    rows += [(100 + k, "http://copies.example/", f"<div>other{k} text{k}</div>") for k in range(3)]
    rows += [(200 + k, "http://most.example/", f"<nav>go{k} there{k}</nav><div>{story if k else 'lone page'}</div>") for k in range(12)]
    rows += [(300 + k, "http://blank.example/", f"<div>Welcome to our site</div><div>by n{k} on Hello{k} <b>big{k}</b> world{k}</div>") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    assert all(got[k] == story for k in range(30)) and got[101] == "other1 text1"
    assert all(got[200 + k] == story for k in range(1, 12)) and got[200] == "lone page"
    assert all(got[300 + k] == f"n{k} Hello{k} big{k} world{k}" for k in range(12))


def test_templates_are_read_off_pages_with_articles_too(spark):
    rows = [(k, "http://h.example/", f"<main><p>Written by a{k} on day{k}</p><p>It was day{k} {'and ' * (k % 3)}so</p></main>") for k in range(12)]
    rows += [(50, "http://h.example/", "<main><p>on by Written notes</p></main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    assert got[5].split() == "a5 day5 day5 and and".split() and got[3].split() == "a3 day3 day3".split()
    assert got[50] == "on by Written notes"  # out of order, so no template words


def plain_template(pages):
    """Classes by whole occurrence vectors, for pages of one host that all differ."""
    seen = [html_extract.page_tokens(*html_extract.walk(h))[0].tolist() for h in pages]
    vectors = {t: tuple(own.count(t) for own in seen) for own in seen for t in own}
    often = {t: v for t, v in vectors.items() if sum(x > 0 for x in v) >= max(html_extract.LEAST_PAGES, html_extract.SHARE * len(pages))}
    groups = {}
    for t, v in often.items():
        groups.setdefault(v, []).append(t)
    found = set()
    for v, own in groups.items():
        holders = [p for p, n in zip(seen, v) if n]
        own.sort(key=lambda t: (sum(p.index(t) for p in holders), t))
        between = [len({tuple(p[p.index(a) : p.index(b)]) for p in holders}) > 1 for a, b in zip(own, own[1:])]
        if any(between):
            found.add(tuple(own))
    return found


def test_classes_equal_those_of_whole_vectors(spark):
    rng = random.Random(8)
    rows = []
    for host in range(3):
        for k in range(8 + 5 * host):
            parts = [f"<li>item <b>n{rng.randint(0, 99)}</b> in stock</li>" for _ in range(rng.randint(1, 3))]
            extra = "<p>Seldom seen</p>" if k % 3 == 0 else ""
            rows.append((f"h{host}.example", f"<div class=top>Shop {host} of all</div><div>by k{k} for everyone</div>{extra}<ul>{''.join(parts)}</ul><i>{k}</i>"))
    pages = spark.createDataFrame(rows, "host string, html string")
    got = {r.host: {tuple(c) for c in r.template} for r in html_extract.templates(pages).collect()}
    assert got == {f"h{host}.example": plain_template([h for o, h in rows if o == f"h{host}.example"]) for host in range(3)} and all(got.values())


def test_deep_paths_tell_places_apart_and_odd_columns_pass(spark):
    deep = "<section>" * 9
    a = html_extract.page_tokens(*html_extract.walk(f"<div>{deep}word"))[0]
    b = html_extract.page_tokens(*html_extract.walk(f"<ul>{deep}word"))[0]
    assert a[-1] != b[-1]
    pages = spark.createDataFrame([(1, "http://x/", "<p>a b", 5)], "page_id long, url string, html string, `my col` long")
    assert [tuple(r) for r in html_extract.extract_main_text(pages).collect()] == [(1, "http://x/", 5, "a b")]


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.written(stage(spark, rows, FOLDER), "test")
        assert rows.columns == docs.columns
        kept.append(rows.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER)
    assert pieces.select("doc_id").distinct().count() == kept[-1]
