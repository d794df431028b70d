"""Column expressions that stay linear in the matches of one text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands before and after each match; texts have the other one in its place.
MARK, STAND_IN = "\u0003", "\u0002"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(text: Column, pattern: str | Column) -> Column:
    """What lies between matches (even places from 0) and the matches (odd places), in one pass of the pattern."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def fields(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def folded(items: Column, kind: str, begin: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]]) -> Column:
    """A struct of the state and ``out``, an array of ``kind``, after ``step(state, item)`` for each item: the new state, what to add, and whether.

    A fold copies what it carries at each step, so the items are cut into blocks as
    long as there are many; only the list of a block is carried from item to item,
    and the whole list from block to block.
    """
    empty = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, item: Column) -> Column:
        state, new, use = step(acc, item)
        return fields({**state, "out": F.when(use, F.concat(acc["out"], F.array(new))).otherwise(acc["out"])})

    def outer(acc: Column, block: Column) -> Column:
        own = F.aggregate(block, fields({**{n: acc[n] for n in begin}, "out": empty}), inner)
        return let(own, lambda r: fields({**{n: r[n] for n in begin}, "out": F.concat(acc["out"], r["out"])}))

    def cut(every: Column) -> Column:
        side = F.greatest(F.ceil(F.sqrt(F.size(every))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(every) - 1, F.lit(0)), side), lambda i: F.slice(every, i + 1, side))

    return F.aggregate(let(items, cut), fields({**begin, "out": empty}), outer)
