"""Text functions; lengths and places are in bytes, as the functions of a byte-string language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+"


def length(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def substring(s: Column, begin: Column, end: Column | None = None) -> Column:
    """Bytes from ``begin`` up to ``end``; null outside the text or within a character."""
    data, stop = F.encode(s, "UTF-8"), end if end is not None else F.octet_length(s)
    ok = (begin >= 0) & (begin <= stop) & (stop <= F.octet_length(s))
    part = F.substring(data, begin + 1, stop - begin)
    return F.when(ok & F.is_valid_utf8(part.cast("string")), part.cast("string"))


def replace_all(s: Column, old: Column, new: Column) -> Column:
    return F.replace(s, old, new)


def split(s: Column, by: Column) -> Column:
    """Pieces between literal separators, empty ones too; of null, none."""
    return F.coalesce(F.split(s, F.concat(F.lit("\\Q"), by, F.lit("\\E")), -1), F.array().cast("array<string>"))


def contains(s: Column, part: Column) -> Column:
    return F.coalesce(F.contains(s, part), F.lit(False))


def startswith(s: Column, part: Column) -> Column:
    return F.coalesce(F.startswith(s, part), F.lit(False))


def endswith(s: Column, part: Column) -> Column:
    return F.coalesce(F.endswith(s, part), F.lit(False))


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, f"^{BLANKS}", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, f"{BLANKS}$", "")


def trim(s: Column) -> Column:
    return trim_end(trim_start(s))


def tonumber(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def join(parts: Column, by: str) -> Column:
    """Texts of an array, nulls left out."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), by)


def pos(s: Column, part: Column) -> Column:
    """The byte at which ``part`` begins, from 0; null where it isn't there."""
    at = F.instr(s, part)
    return F.when(at > 0, F.octet_length(F.substring(s, F.lit(1), at - 1)).cast("long"))


def formatted(pattern: str, *values: Column) -> Column:
    """``{0}``, ``{1}``, ... replaced by the values; null is written NaN."""
    out = F.lit(pattern)
    for k, value in enumerate(values):
        out = F.replace(out, F.lit(f"{{{k}}}"), F.coalesce(value.cast("string"), F.lit("NaN")))
    return out


def match(s: Column, part: Column) -> Column:
    """``part`` where the text holds it, else null (no pattern)."""
    return F.when(F.contains(s, part), part)
