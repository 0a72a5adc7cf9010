"""Personal data: patterns propose spans, checksums confirm them, context words score them.

``find_pii`` is the operator.  Its spans are code-point offsets, end exclusive.  Null or empty
texts have no spans; nothing is cut short, whatever the length, because each pattern walks a text
once (no pattern backs up over a run it has already read).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans are listed.  The first four follow the base rules.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "account", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

# The local part is found backwards from each '@', so that a long run without one costs one pass.
_EMAIL_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A leftmost match can only begin where a run of digits begins.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_CLOUD_KEY = re.compile(r"(?<![A-Z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Z0-9])")
_SECRET = re.compile(r"(?i:password|passwd|secret|token|api_?key)[ ]?[=:][ ]?[\"']?([A-Za-z0-9+/_-]{12,})")
_ACCOUNT = re.compile(r"(?i:account|konto|compte|cuenta)(?: (?:no\.?|number|nr\.?))?[ :#]{1,3}([0-9]{8,15})(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Code points looked at on either side of a span for context words.
CONTEXT = 48
_CONTEXT = {
    "email": ("mail", "contact", "write to", "@"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "konto", "compte", "cuenta", "transfer"),
    "ssn": ("ssn", "social", "security", "tax"),
    "account": ("account", "bank", "konto", "compte", "cuenta"),
    "secret": ("password", "token", "key", "secret", "login"),
}
#: How sure a span is before its surroundings are read: patterns with a checksum are surer.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "ssn": 0.5, "account": 0.6, "secret": 0.7}
#: Kinds that neither a checksum nor the pattern's own words confirm: context decides, and without any they score half.
_UNCONFIRMED = frozenset({"ssn"})
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """The card checksum."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += _DOUBLED[d] if k % 2 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of an international bank account number, blanks removed."""
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _EMAIL_AT.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind and then by start."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += (("email", s, e) for s, e in _emails(text))
    if _DIGIT.search(text) is None and "=" not in text and ":" not in text:
        return found
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    for m in _IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            found.append(("iban", *m.span()))
    if "-" in text:
        for m in _SSN.finditer(text):
            area, group, serial = m.groups()
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                found.append(("ssn", *m.span()))
    found += (("account", *m.span(1)) for m in _ACCOUNT.finditer(text))
    secret = [m.span() for m in _CLOUD_KEY.finditer(text)] + [m.span(1) for m in _SECRET.finditer(text) if _DIGIT.search(m.group(1))]
    found += (("secret", s, e) for s, e in sorted(set(secret)))
    return found


def score_of(kind: str, text: str, start: int, end: int) -> float:
    """The prior of the kind, raised for each context word near the span; halved where only context could confirm it and none does."""
    near = text[max(0, start - CONTEXT) : start].lower() + "\n" + text[end : end + CONTEXT].lower()
    hits = sum(word in near for word in _CONTEXT[kind])
    if not hits and kind in _UNCONFIRMED:
        return _PRIOR[kind] / 2
    return round(1 - (1 - _PRIOR[kind]) * 0.5 ** min(hits, 3), 4)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


@F.pandas_udf(SPAN)
def _find(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e, "score": score_of(k, t, s, e)} for k, s, e in spans_of(t)] for t in texts])


def pii_spans(text: Column) -> Column:
    """The spans of a text column: an array of (kind, start, end, score), never null."""
    return _find(text)


def find_pii(documents: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``documents`` with its spans of personal data in a new column."""
    return documents.withColumn(into, pii_spans(F.col(text)))


def mask_pii(documents: DataFrame, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """``documents`` with each span of at least ``least_score`` replaced by its kind in brackets."""

    @F.pandas_udf(T.StringType())
    def masked(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            out, last = [], 0
            for kind, s, e in sorted(spans_of(t), key=lambda x: (x[1], -x[2])):
                if s >= last and score_of(kind, t, s, e) >= least_score:
                    out += [t[last:s], f"[{kind.upper()}]"]
                    last = e
            return "".join([*out, t[last:]])

        return pd.Series([one(t) for t in texts], dtype=object)

    return documents.withColumn(text, masked(F.col(text)))


def _of_kinds(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def op5_pii(spark, folder: str) -> DataFrame:
    """Personal data in every document, as counts, a digest of the base spans and all spans."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = find_pii(documents)
    listed = lambda kinds: F.array_join(F.transform(_of_kinds("pii", *kinds), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(_of_kinds("pii", k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.encode(listed(BASE_KINDS), "UTF-8"), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
        F.aggregate("pii", F.lit(0.0), lambda a, x: F.greatest(a, x["score"])).alias("top_score"),
    )
