"""Licenses and personal data: edge cases and plain versions."""

import random
import re
import re._constants as constants
import re._parser as parser

from pyspark.sql import functions as F

from barframe.llm import licenses, pii

TEXTS = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, "The Apache License, Version 2.0 and mit-license MIT LICENSE; GNU General\nPublic  License, version 3"), (5, "SPDX-License-Identifier: GPL-3.0-or-later"), (6, "été naïve 12"), (7, "x " * 30_000 + "mit license"), (7, "Released under the MIT License."), (None, "mit license")]


def plain_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        own = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scan(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses_of_old", F.lit(1))
    counted = table.withColumn("n_words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(licenses.RAW_WORD)).cast("long"))
    found = licenses.scan_licenses(counted)
    return found.select("doc_id", "text", "n_words", *licenses.license_columns(F.col("license_words"), F.col("licenses"), F.col("n_words")), "licenses", "licenses_of_old").collect()


def test_base_phrases_match_a_plain_scan(spark):
    for r in scan(spark, TEXTS):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_license(r.text), r.doc_id
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_nested_matches_give_way(spark):
    found = {r.doc_id: r for r in scan(spark, TEXTS[:1] + TEXTS[4:5] + [(9, "licensed under the Apache License, Version 2.0")])}
    assert [x.label for x in found[1].licenses] == ["mit"]
    assert [x.label for x in found[5].licenses] == ["gpl"]
    assert [x.label for x in found[9].licenses] == ["apache", "apache-2.0"] or [x.label for x in found[9].licenses] == ["apache-2.0"]


def held(parsed):
    """Runs of letters that every match of a pattern holds."""
    out = [""]
    for op, arg in parsed:
        if op is constants.LITERAL:
            out[-1] += chr(arg)
        elif op is constants.SUBPATTERN:
            inner = held(arg[3])
            out[-1] += inner[0]
            out += inner[1:]
        else:
            out.append("")
    return out


def test_every_match_of_a_rule_holds_its_keyword_and_passes_the_gate():
    assert len(licenses.rules()) > 400
    for keyword, pattern, priority, _ in licenses.rules():
        assert priority in (0, 1, 2)
        literals = held(parser.parse(pattern))
        assert any(keyword in x for x in literals), pattern
        assert keyword.startswith("cc by") or any(g in x for g in licenses.GATE for x in literals), pattern


def test_names_without_the_label_are_found(spark):
    rows = [(1, "This is under the X11 license."), (2, "Released under the Expat License."), (3, 'The software is provided "as is", without warranty of any kind, express or implied')]
    assert [[x.label for x in r.licenses] for r in sorted(scan(spark, rows), key=lambda r: r.doc_id)] == [["mit"]] * 3


def plain_matches(text):
    norm = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip(" ")
    found = []
    for k, (_, pattern, priority, label) in enumerate(licenses.rules()):
        found += [(m.start(), m.end(), priority, k, label) for m in re.finditer(f"(?<![^ ])(?:{pattern})(?![^ ])", norm)]
    found.sort(key=lambda x: (x[0], -x[1], -x[2], x[3]))
    inside = [x for n, x in enumerate(found) if not any(y[0] <= x[0] and x[1] <= y[1] and y[2] >= x[2] and (y[:3] != x[:3] or m < n) and (y[2] > x[2] or y[:2] != x[:2] or m < n) for m, y in enumerate(found) if m < n)]
    return [x for x in inside if not any(x[0] <= y[0] and y[1] <= x[1] and y[2] > x[2] for y in inside if y is not x)]


def test_suppression_equals_brute_force(spark):
    rng = random.Random(6)
    parts = ["mit license", "licensed under the", "apache license version 2 0", "the gnu general public license", "gplv3 or later", "version 3", "public domain", "is in the public domain", "see license", "copyright c 2020", "all rights reserved", "released under the terms of the", "bsd license", "x", "Apache Software License", "creative commons", "cc by sa 4 0", "affero", "general public license"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.choice([3, 10, 40, 300])))) for k in range(40)]
    for r in scan(spark, rows):
        assert [tuple(x) for x in r.licenses] == plain_matches(r.text), r.text


def test_many_matches_in_one_text(spark):
    (r,) = scan(spark, [(1, "see the MIT license and " * 20_000)])
    assert len(r.licenses) == 20_000 and r.n_base == 20_000 and r.labels == "mit"


def test_no_rows(spark):
    assert scan(spark, []) == []


def plain_base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_match_the_patterns():
    texts = ["a@b.c@d.e.f x@y x@@y.z .@q.w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4321720528180570 12", "+1 (543) 555-9258 +12 3 +1() +4930123456+49 30 123", "é" * 50 + " a.b@c-d.org +1 227 555 6828 10.0.0.255", "1" * 3000, "a" * 3000, "a@" * 500, "", None]
    for text in texts:
        assert [s for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS] == plain_base(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    (span,) = [s for s in pii.spans_of("IBAN GB82 WEST 1234 5698 7654 32 end") if s[0] == "iban"]
    assert span == ("iban", 5, 32)
    near, far = "call my phone +1 543 555 9258", "zz zz zz zz zz zz +1 543 555 9258"
    (a,), (b,) = ([s for s in pii.spans_of(t) if s[0] == "phone"] for t in (near, far))
    assert pii.score_of("phone", near, *a[1:]) > pii.score_of("phone", far, *b[1:])


def test_pii_columns_and_masking(spark):
    table = spark.createDataFrame([(1, "mail a@b.co now", 5), (1, None, None), (None, "", 1)], "doc_id long, text string, pii_old int")
    found = {(r.doc_id, r.text): r.pii for r in pii.find_pii(table).collect()}
    assert [tuple(x)[:3] for x in found[1, "mail a@b.co now"]] == [("email", 5, 11)] and found[1, None] == [] == found[None, ""]
    assert sorted(map(str, (r.text for r in pii.mask_pii(table).collect()))) == ["", "None", "mail [EMAIL] now"]
    assert pii.find_pii(table.filter("doc_id > 9")).count() == 0


def test_context_decides_where_nothing_else_confirms():
    assert pii.score_of("ssn", "order 123-45-6789 shipped", 6, 17) == 0.25
    assert pii.score_of("ssn", "social security 123-45-6789", 16, 27) > 0.7
