"""Folds over long arrays in time that does not grow with their square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(
    items: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]],
    end: Callable[[Column], Column] | None = None,
) -> Column:
    """array<kind> of all that ``step(state, item) -> (state, array<kind>)`` gives out, in order.

    ``zero`` is the first state and ``end`` gives out what the last one still holds. Appending to one
    growing array copies it for each item, which is quadratic; here items are cut into about sqrt(n)
    stretches, what a stretch gives out joins the rest once, and n items cost about n * sqrt(n) copies.
    Null items give null.
    """
    empty = F.array().cast(f"array<{kind}>")
    nothing = F.array().cast(f"array<array<{kind}>>")

    def one(s: Column, x: Column) -> Column:
        state, out = step(s["state"], x)
        return F.struct(state.alias("state"), F.concat(s["open"], out).alias("open"))

    def stretch(acc: Column, part: Column) -> Column:
        first = F.struct(acc["state"].alias("state"), empty.alias("open"))
        return bind(F.aggregate(part, first, one), lambda s: F.struct(
            s["state"].alias("state"), F.concat(acc["done"], F.array(s["open"])).alias("done")))

    def fold(held: Column) -> Column:
        n = F.size(held)
        width = F.ceil(F.sqrt(n)).cast("int")
        parts = F.transform(
            F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda i: F.slice(held, i * width + 1, width))
        final = (lambda s: F.flatten(F.concat(s["done"], F.array(end(s["state"]))))) if end else (lambda s: F.flatten(s["done"]))
        whole = F.aggregate(parts, F.struct(zero.alias("state"), nothing.alias("done")), stretch, final)
        return F.when(n > 0, whole).when(n == 0, end(zero) if end else empty)

    return bind(items, fold)


def cut(text: Column, spans: Column) -> Column:
    """array<string>: the characters of each span (start, end), which are in order of both.

    ``substr`` walks a text from its start, so n spans are cut out of about sqrt(n) stretches of the text.
    """
    def part(cuts: Column, g: Column, width: Column) -> Column:
        def inner(mine: Column) -> Column:
            start = F.get(mine, F.lit(0))["start"]
            stretch = text.substr(start + 1, F.get(mine, F.size(mine) - 1)["end"] - start)
            return bind(stretch, lambda t: F.transform(mine, lambda c: t.substr(c["start"] - start + 1, c["end"] - c["start"])))

        return bind(F.slice(cuts, g * width + 1, width), inner)

    def whole(cuts: Column) -> Column:
        n = F.size(cuts)
        width = F.ceil(F.sqrt(n)).cast("int")
        return F.when(n > 0, F.flatten(F.transform(
            F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda g: part(cuts, g, width)))).otherwise(F.array().cast("array<string>"))

    return bind(spans, whole)
