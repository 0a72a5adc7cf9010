"""Colours: structs r, g, b, a of whole numbers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named colours.
NAMED = {
    "aqua": "#00bcd4", "black": "#000000", "blue": "#0078ff", "fuchsia": "#e040fb", "gray": "#787b86", "green": "#4caf50", "lime": "#00e676", "maroon": "#880e4f",
    "navy": "#311b92", "olive": "#808000", "orange": "#ff9800", "purple": "#9c27b0", "red": "#ff5252", "silver": "#b2b5be", "teal": "#00897b", "white": "#ffffff", "yellow": "#ffeb3b",
}


def _make(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in zip("rgba", (r, g, b, a))])


def rgba(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """Null unless every part is from 0 to 255."""
    a = F.lit(255) if a is None else a
    ok = r.between(0, 255) & g.between(0, 255) & b.between(0, 255) & a.between(0, 255)
    return F.when(ok, _make(r, g, b, a))


def from_hex(text: Column) -> Column:
    """``#rrggbb`` or ``#rrggbbaa``; else null."""
    part = lambda k: F.conv(F.substring(text, k, 2), 16, 10).cast("int")
    alpha = F.when(F.length(text) == 9, part(8)).otherwise(255)
    return F.when(F.rlike(text, F.lit("^#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")), _make(part(2), part(4), part(6), alpha))


def to_hex(c: Column) -> Column:
    two = lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))
    return F.concat(F.lit("#"), two(c["r"]), two(c["g"]), two(c["b"]), F.when(c["a"] == 255, "").otherwise(two(c["a"])))


def transparency(c: Column) -> Column:
    return 100 - c["a"] / 255.0 * 100


def with_transparency(c: Column, t: Column) -> Column:
    """Alpha is 255 less the truncated share ``t`` (in per cent) of 255."""
    return _make(c["r"], c["g"], c["b"], (255 - t / 100.0 * 255).cast("int"))


def mix(a: Column, b: Column, weight: float = 0.5) -> Column:
    """Linear, truncated."""
    part = lambda n: (a[n] * (1 - weight) + b[n] * weight).cast("int")
    return _make(part("r"), part("g"), part("b"), part("a"))


def lighten(c: Column, amount: float) -> Column:
    part = lambda n: (c[n] + (255 - c[n]) * amount).cast("int")
    return _make(part("r"), part("g"), part("b"), c["a"])


def darken(c: Column, amount: float) -> Column:
    part = lambda n: (c[n] * (1 - amount)).cast("int")
    return _make(part("r"), part("g"), part("b"), c["a"])
