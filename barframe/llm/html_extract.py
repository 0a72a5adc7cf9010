"""Main text of web pages by equivalence classes of template tokens.

Pages of one host share a template.  A page is a sequence of tokens: tags with the path of elements
they stand in, and words at such a path.  Template tokens stand equally often in the same pages, so
tokens with equal occurrence vectors form an equivalence class.  A class is part of the host's
template when it is frequent and encloses text that varies; constant text alone (an article
that many pages copy) is content.  Pages of a host that are equal but for comments, scripts and
styles count once.

Spark counts, for each host and token, the pages, the occurrences and linear sketches (sums over
pages of a page hash times the count, the hash itself, and the tokens before the first place), all
combined before the shuffle; equal sketches mean equal vectors, and sketches of two tokens tell
whether what stands between them varies.  A first pass counts hash buckets of words and labels
without paths: a token that is frequent has a frequent word or label, so the second pass leaves
out what is in no frequent bucket.

A page is read with its template: a class holds where its tokens come in their order, again and
again, and nest with the other classes; of two that cross, the one of fewer pages (or more
occurrences) gives way.  Its words are dropped, and the slots between template tokens remain.  Of
these the slots in content elements are the main text.

A slot is content unless it lies in an element that is boilerplate by its name (nav, header, footer,
aside, form and the like) or by a word of its class, id or role.  Where a page has an article or
main element, slots outside are not content.  The block-level elements of a page divide its text.

Null or empty pages have empty texts; pages without a host form a host of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.html_tokens import VOID, decoded, tokens
from barframe.llm.shared import written
from barframe.llm.text import mix, word_hashes

#: A class belongs to a template when it stands in this share of a host's pages, and in this many.
SHARE = 0.8
LEAST_PAGES = 8
#: Tokens that a template's class needs.
LEAST_CLASS = 2
#: Template tokens of all hosts that are broadcast (8 bytes each) instead of shuffling the pages.
BROADCAST_TOKENS = 1 << 20
#: Hash buckets of a host's tokens, and the hosts whose buckets a task keeps at once.
BUCKETS, HOSTS = 1 << 12, 1 << 10
#: Sketches are sums modulo this prime.
PRIME = (1 << 40) - 87

BOILERPLATE = frozenset({"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "noscript", "template", "svg", "canvas", "object", "audio", "video", "head", "label", "fieldset"})
CONTENT = frozenset({"article", "main"})
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an open one of the same family ends.
_ENDS = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
_SCOPES = frozenset({"ul", "ol", "dl", "table", "article", "section", "div", "nav", "header", "footer", "aside", "main", "body", "html", "form", "blockquote"})
_HINT = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|comment\w*|discussion|disqus|replies|reply|sidebar|side-bar|widget\w*|menu\w*|nav\w*|breadcrumb\w*|footer|header|masthead|cookie\w*|consent|gdpr|notice\w*|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|copyright|legal|disclaimer|complementary|contentinfo|navigation|search|alert\w*|teaser\w*|skip\w*)(?:$|[\s_-])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What pages may differ in and still be equal: comments, scripts and styles.
UNSEEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"


_MASK = 2**64 - 1


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


class _Hashes(dict):
    """Hashes of labels, remembered up to a bounded number."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 16:
            self.clear()
        found = self[token] = _hash(token)
        return found


_KNOWN = _Hashes()


def _below(path: int, label: int) -> int:
    """The hash of the path that goes on from ``path`` with a label."""
    return ((path ^ label) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK


def _label(name: str, hints: str) -> str:
    return f"<{name}.{hints.split()[0]}" if hints and hints != "!hidden" else f"<{name}"


class _Openings(dict):
    """The label's hash of a name with its hints, and whether it is boilerplate, remembered up to a bounded number."""

    def __missing__(self, key: tuple[str, str]) -> tuple[int, bool]:
        if len(self) > 1 << 14:
            self.clear()
        name, hints = key
        bad = name in BOILERPLATE or "!hidden" in hints or bool(hints and name not in ("body", "html", "article", "main") and _HINT.search(hints))
        found = _KNOWN["<" + name if name in VOID else _label(name, hints)], bad
        if len(hints) <= 256:
            self[key] = found
        return found


_OPENINGS = _Openings()


class Slot:
    """Text between two tags: the hash of its path of elements, its block, the tags before it, and whether it is content."""

    __slots__ = ("path", "parts", "content", "inside", "block", "at")

    def __init__(self, path: int, content: bool, inside: bool, block: int, at: int):
        self.path, self.parts, self.content, self.inside, self.block, self.at = path, [], content, inside, block, at


def walk(html: str) -> tuple[list[Slot], list[tuple[int, int]]]:
    """The slots of a page and its tags: the hashes of each one's path and of its label."""
    root = ("", 0, False, False, 0)
    stack: list[tuple[str, int, bool, bool, int]] = []  # name, path, boilerplate so far, in content so far, label
    slots: list[Slot] = []
    tags: list[tuple[int, int]] = []
    known, block, fresh = _KNOWN, 0, True
    for kind, name, hints in tokens(html):
        if kind == "text":
            if fresh:
                top = stack[-1] if stack else root
                slots.append(Slot(top[1], not top[2], top[3], block, len(tags)))
                fresh = False
            slots[-1].parts.append(name)
            continue
        fresh = True
        if kind == "raw":
            label = known["<" + name]
            tags.append((_below(stack[-1][1] if stack else 0, label), label))
            continue
        if name in BLOCKS:
            block += 1
        if kind == "open":
            family = _ENDS.get(name)
            if family or name in BLOCKS and stack and stack[-1][0] == "p":
                _end(stack, family or frozenset({"p"}))
            above = stack[-1] if stack else root
            label, bad = _OPENINGS[name, hints]
            path = _below(above[1], label)
            tags.append((path, label))
            if name in VOID:
                continue
            stack.append((name, path, above[2] or bad, above[3] or name in CONTENT, label))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    tags.append((_below(stack[k][1], 1), stack[k][4]))
                    del stack[k:]
                    break
    return slots, tags


def _end(stack: list[tuple[str, int, bool, bool, int]], family: frozenset[str]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in family:
            del stack[k:]
            return
        if stack[k][0] in _SCOPES:
            return


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts (ASCII blanks divide them, case of A-Z is ignored), and where each text's begin."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(c) for c in coded], out=offsets[1:])
    return word_hashes(np.frombuffer(b"".join(coded), np.uint8), offsets)


def page_words(html: str) -> np.ndarray:
    """The hashes of a page's words and labels, without their paths."""
    labels: set[str] = set()
    texts: list[str] = []
    text: list[str] = []
    for kind, name, hints in tokens(html):
        if kind == "text":
            text.append(name)
            continue
        if text:
            texts.append(decoded("".join(text)))
            text = []
        if kind != "close":
            labels.add("<" + name if kind == "raw" or name in VOID else _label(name, hints))
    texts.append(decoded("".join(text)))
    return np.concatenate([_hashes(texts)[0], np.array([_KNOWN[x] for x in labels], np.uint64)])


def page_tokens(slots: list[Slot], tags: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The hashes of a page's tags and words in order, those without their paths, and where the words of each slot begin."""
    words, starts = _hashes([decoded("".join(s.parts)) for s in slots])
    at, counts = np.array([s.at for s in slots], np.int64), np.diff(starts)
    bare, paths = (np.empty(len(tags) + len(words), np.uint64) for _ in range(2))
    word = np.zeros(len(bare), bool)
    word[np.arange(len(words)) + np.repeat(at, counts)] = True
    bare[word], paths[word] = words, np.repeat(np.array([s.path for s in slots], np.uint64), counts)
    both = np.array(tags, np.uint64).reshape(-1, 2)
    paths[~word], bare[~word] = both[:, 0], both[:, 1]
    return mix(bare ^ mix(paths)).view(np.int64), bare, (starts[:-1] + at).tolist()


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host, the pages, and the pages that hold a word or label of each bucket."""
    total: dict[str, tuple[list[int], np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(host, n[0], zlib.compress(own.tobytes(), 1)) for host, (n, own) in total.items()]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 3, [pa.string(), pa.int64(), pa.binary()])], names=["host", "n", "held"])

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if host not in total:
                if len(total) >= HOSTS:
                    yield flush()
                total[host] = ([0], np.zeros(BUCKETS, np.uint32))
            n, own = total[host]
            n[0] += 1
            own[np.unique(_bucket(page_words(html)))] += 1
    yield flush()


def _often(table: pa.Table) -> pa.Table:
    """The buckets of one host that can hold template tokens."""
    n = sum(table.column("n").to_pylist())
    held = np.zeros(BUCKETS, np.int64)
    for one in table.column("held").to_pylist():
        held += np.frombuffer(zlib.decompress(one), np.uint32)
    found = np.flatnonzero((held >= LEAST_PAGES) & (held >= SHARE * n))
    return pa.table({"host": table.column("host").slice(0, 1), "all": pa.array([n], pa.int64()), "buckets": pa.array([found.tolist()], pa.list_(pa.int32()))})


_COUNTS = "host string, all long, token long, pages long, times long, sketch long, marks long, at long, before long, marked long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a batch, by host and token, for tokens of frequent buckets.

    Besides pages, times and sketch: the pages' marks, the first places, the sum of all tokens
    before them, and these sums times the marks.
    """
    for batch in batches:
        total: dict[tuple[str, int, int], list[int]] = {}
        masks: dict[str, np.ndarray] = {}
        buckets = batch.column("buckets")
        for k, (mark, host, size, html) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("mark", "host", "all", "html")))):
            if host not in masks:
                masks[host] = np.zeros(BUCKETS, bool)
                masks[host][buckets[k].as_py()] = True
            found, bare, _ = page_tokens(*walk(html))
            before = np.cumsum(found.view(np.uint64) >> np.uint64(24)) - (found.view(np.uint64) >> np.uint64(24))
            some = np.flatnonzero(masks[host][_bucket(bare)])
            mark %= PRIME
            tokens_of, first, times = np.unique(found[some], return_index=True, return_counts=True)
            at = some[first]
            for token, n, place, h in zip(tokens_of.tolist(), times.tolist(), at.tolist(), before[at].tolist()):
                own = total.setdefault((host, size, token), [0] * 7)
                h %= PRIME
                own[0] += 1
                own[1] += n
                own[2] = (own[2] + mark * n) % PRIME
                own[3] = (own[3] + mark) % PRIME
                own[4] += place
                own[5] = (own[5] + h) % PRIME
                own[6] = (own[6] + mark * h) % PRIME
        keys = list(total)
        columns = [pa.array([k[0] for k in keys], pa.string()), *[pa.array([k[c] for k in keys], pa.int64()) for c in (1, 2)], *[pa.array([total[k][c] for k in keys], pa.int64()) for c in range(7)]]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _COUNTS.split(", ")])


def varies(a: dict, b: dict) -> bool:
    """Whether the tokens between the first places of two tokens of a class differ among its pages."""
    between, marked = b["before"] - a["before"], b["marked"] - a["marked"]
    return (a["marks"] * between - a["pages"] * marked) % PRIME != 0


def _classes(table: pa.Table) -> pa.Table:
    """The template of one host: its classes, outer ones first, each in order."""
    groups: dict[tuple[int, int, int], list[dict]] = {}
    for row in table.to_pylist():
        groups.setdefault((-row["pages"], row["times"], row["sketch"]), []).append(row)
    template = []
    for _, own in sorted(groups.items()):
        own.sort(key=lambda r: (r["at"], r["token"]))
        if len(own) >= LEAST_CLASS and any(varies(a, b) for a, b in zip(own, own[1:])):
            template.append([r["token"] for r in own])
    return pa.table({"host": table.column("host").slice(0, 1), "template": pa.array([template], pa.list_(pa.list_(pa.int64())))})


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without a port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``host``, ``html`` and ``mark`` of pages, equal ones of a host once.

    Marks travel without their pages; pages are kept apart by their order in the input's partitions,
    which is written with the marks, and of equal pages the first one stays.
    """
    html = F.coalesce("html", F.lit(""))
    seen = F.regexp_replace(html, UNSEEN, "")
    keyed = written(pages.select("host", html.alias("html"), F.xxhash64(seen).alias("mark"), F.length(seen).alias("long"), F.monotonically_increasing_id().alias("row")), "marked-pages")
    by = ["host", "mark", "long"]
    copied = keyed.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).filter("n > 1").select(*by, "first")
    copied = written(copied, "copied-pages")
    if copied.count() <= BROADCAST_TOKENS:
        copied = F.broadcast(copied)
    return keyed.join(copied, by, "left").filter(F.col("first").isNull() | (F.col("first") == F.col("row"))).select("host", "html", "mark")


def templates(pages: DataFrame) -> DataFrame:
    """For each host, the classes of its template; ``pages`` has ``host`` and ``html``.

    A host's template is bounded by what a page holds, as each of its tokens stands in most of the
    host's pages.
    """
    own = distinct_pages(pages)
    held = own.select("host", "html").mapInArrow(_count_buckets, "host string, n long, held binary").groupBy("host").applyInArrow(_often, "host string, all long, buckets array<int>")
    held = written(held.filter(F.size("buckets") > 0), "token-buckets")
    if (held.agg(F.sum(F.size("buckets"))).first()[0] or 0) <= BROADCAST_TOKENS:
        held = F.broadcast(held)
    counted = own.join(held, "host").select("mark", "host", "all", "buckets", "html").mapInArrow(_count, _COUNTS)
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "at")] + [(F.sum(c) % PRIME).alias(c) for c in ("sketch", "marks", "before", "marked")]
    often = counted.groupBy("host", "all", "token").agg(*sums).filter((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= SHARE * F.col("all")))
    return often.drop("all").groupBy("host").applyInArrow(_classes, "host string, template array<array<long>>").filter(F.size("template") > 0)


def placed(tokens_of: np.ndarray, template: list[list[int]]) -> set[int]:
    """The places of a page's template tokens: classes that come in order and nest."""
    role = {token: (c, k) for c, own in enumerate(template) for k, token in enumerate(own)}
    some = np.flatnonzero(np.isin(tokens_of, np.fromiter(role, np.int64, len(role))))
    spots = [(at, *role[token]) for at, token in zip(some.tolist(), tokens_of[some].tolist())]
    while spots:
        open_classes: list[list[int]] = []
        bad = None
        for _, c, k in spots:
            top = open_classes[-1] if open_classes else None
            if k == 0:
                open_classes.append([c, 1])
            elif top and top == [c, k]:
                top[1] += 1
            else:  # classes are listed outer first, so the later one gives way
                bad = max(c, top[0]) if top else c
                break
            if open_classes[-1][1] == len(template[c]):
                open_classes.pop()
        if bad is None and open_classes:
            bad = max(c for c, _ in open_classes)
        if bad is None:
            break
        spots = [s for s in spots if s[1] != bad]
    return {s[0] for s in spots}


def _with_gone(slots: list[Slot], tags: int, begins: list[int], places: int, gone: set[int]) -> set[int]:
    """The slots that hold words of these places; a slot's words end where as many tags stand before the next one's."""
    at = np.array([s.at for s in slots] + [tags], np.int64)
    starts = np.array([*begins, places], np.int64)
    edges = np.sort(np.fromiter(gone, np.int64, len(gone)))
    ends = starts[1:] - at[1:] + at[:-1]
    return set(np.flatnonzero(np.searchsorted(edges, ends) > np.searchsorted(edges, starts[:-1])).tolist())


def main_text(html: str | None, template: list[list[int]] = ()) -> str:
    """The content slots of a page, block by block."""
    if not html:
        return ""
    slots, tags = walk(html)
    inside = any(s.inside and s.content for s in slots)
    gone, begins, cut = set(), [0] * len(slots), set()
    if template and slots:
        found, _, begins = page_tokens(slots, tags)
        gone = placed(found, template)
        cut = _with_gone(slots, len(tags), begins, len(found), gone)
    blocks: dict[int, list[str]] = {}
    for k, (slot, begin) in enumerate(zip(slots, begins)):
        if not slot.content or inside and not slot.inside:
            continue
        text = decoded("".join(slot.parts))
        if k in cut:
            place = iter(range(begin, begin + len(text)))
            text = _WORD.sub(lambda m: "" if next(place) in gone else m.group(), text)
        blocks.setdefault(slot.block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[list[int]]] = {}
    for batch in batches:
        texts = []
        hosts, templates_of = batch.column("host").to_pylist(), batch.column("template")
        for k, (host, html) in enumerate(zip(hosts, batch.column("html").to_pylist())):
            if host not in known:
                if len(known) > 256:
                    known.clear()
                known[host] = templates_of[k].as_py() or []
            texts.append(main_text(html, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without the markup column, with the main text in ``into``."""
    keyed = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    learnt = written(templates(keyed), "templates")
    tokens_of_all = learnt.agg(F.sum(F.size(F.flatten("template")))).first()[0] or 0
    if tokens_of_all <= BROADCAST_TOKENS:  # else the pages are shuffled by host
        learnt = F.broadcast(learnt)
    kept = [c for c in pages.columns if c not in (html, into)]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    joined = rows.join(learnt, "host", "left").select("row", "host", "html", "template")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType())])
    done = joined.mapInArrow(_extract, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("text").alias(into))


def op7_html(spark, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
