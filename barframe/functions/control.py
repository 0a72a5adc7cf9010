"""Control flow of scripts as column expressions and folds.

Loops with bounds known from a row become aggregates over a sequence or an array; assignments
are columns made one after the other; a variable that persists from bar to bar is a ``Fold``;
a function is a Python function that returns a column, so each call has its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.operators.folds import Fold


def for_range(first: Column, last: Column, initial: Column, body: Callable[[Column, Column], Column], step: int = 1) -> Column:
    """``body(accumulator, i)`` for i from ``first`` to ``last``, both included; counts down if ``step`` is negative.

    No turn is made where ``last`` lies the other way, or where a bound is null.
    """
    if step == 0:
        raise ValueError("a loop needs a step that isn't 0")
    reached = (first <= last) if step > 0 else (first >= last)
    turns = F.when(reached, F.sequence(first, F.when(reached, last).otherwise(first), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.coalesce(turns, F.array().cast("array<int>")), initial, body)


def for_each(items: Column, initial: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(accumulator, index, item)`` for each item of an array; none for null."""
    placed = F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.coalesce(F.aggregate(placed, initial, lambda s, p: body(s, p["i"], p["x"])), initial)


def for_until(items: Column, initial: Column, body: Callable[[Column, Column], Column], stop: Callable[[Column, Column], Column]) -> Column:
    """As ``for_each`` without the index, but leaves the loop before the first item where ``stop(accumulator, item)``."""
    state = F.struct(initial.alias("v"), F.lit(False).alias("done"))
    turn = lambda s, x: F.when(s["done"] | F.coalesce(stop(s["v"], x), F.lit(False)), F.struct(s["v"].alias("v"), F.lit(True).alias("done"))).otherwise(F.struct(body(s["v"], x).alias("v"), F.lit(False).alias("done")))
    return F.aggregate(items, state, turn)["v"]


def while_loop(initial: dict[str, Column], condition: Callable[[Column], Column], body: Callable[[Column], dict[str, Column]], most: Column) -> Column:
    """Turns while ``condition(state)`` holds, at most ``most`` of them; gives the last state as a struct.

    ``body(state)`` gives the fields that change.  To continue with the next turn, it gives a field's
    old value; to break, it makes the condition false.  A null condition ends the loop.
    """
    names = list(initial)
    state = lambda values, going: F.struct(*[values[n].alias(n) for n in names], going.alias("__going"))

    def turn(s: Column, _: Column) -> Column:
        going = s["__going"] & F.coalesce(condition(s), F.lit(False))
        new = body(s)
        return F.when(going, state({n: new.get(n, s[n]) for n in names}, F.lit(True))).otherwise(state({n: s[n] for n in names}, F.lit(False)))

    turns = F.when(most > 0, F.sequence(F.lit(1), F.greatest(most, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, state(initial, F.lit(True)), turn, lambda s: F.struct(*[s[n].alias(n) for n in names]))


def persistent(inputs: tuple[str, ...], out: str, initial: float, update: Callable[..., float | None]) -> Fold:
    """A variable kept from bar to bar: ``update(value, *inputs)`` gives the next value."""

    def make() -> Callable[..., tuple]:
        value = initial

        def step(*xs):
            nonlocal value
            value = update(value, *xs)
            return (value,)

        return step

    return Fold(inputs, ((out, "double"),), make)


def setting(default: float, least: float | None = None, most: float | None = None, given: float | None = None) -> float:
    """A script's input: the given value, or the default, within its bounds."""
    value = default if given is None else given
    value = max(value, least) if least is not None else value
    return min(value, most) if most is not None else value


def option(default, given=None, options: tuple = ()):
    """A script's input of text, truth, colour, symbol or timeframe: the given value, or the default; one of ``options`` if there are any."""
    value = default if given is None else given
    if options and value not in options:
        raise ValueError(f"{value!r} is none of {options}")
    return value


def source(name: str) -> Column:
    """A price by name: a bar column, or hl2, hlc3, ohlc4."""
    parts = {"hl2": ("high", "low"), "hlc3": ("high", "low", "close"), "ohlc4": ("open", "high", "low", "close")}.get(name, (name,))
    return sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts) if len(parts) > 1 else F.col(name)
