"""Shapes of a text: every line becomes one letter, and shapes are regular expressions over the letters.

What stands where in a noisy form is a matter of the order of labels and
values.  `code_lines` gives each line the letter of its kind,
so a text is a short string; `locate` finds a line by what stands before and
behind it; `fold` applies an ordered list of proposals to a pair of fields.
All of it works inside a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_lines(lines: Column, kind: Callable[[Column], Column]) -> Column:
    """One letter a line, as `kind` gives it."""
    return F.array_join(F.transform(lines, kind), "")


def locate(codes: Column, before: str, at: str, behind: str = "", last: bool = False) -> Column:
    """Index (from 0) of the first line `at` that follows `before` and is followed by `behind`, or of the last; else null."""
    head = ".*" if last else ".*?"
    shape = f"^({head}(?:{before})){at}" + (f"(?={behind})" if behind else "")
    return F.when(codes.rlike(shape), F.length(F.regexp_extract(codes, shape, 1)))


def line_at(values: Column, index: Column) -> Column:
    """The value of a line; null without an index."""
    return F.when(index.isNotNull(), F.get(values, index))


#: A proposal for two fields and when it holds: where one is missing or bad (`fills`), where the first has what is
#: proposed for the second (`shifts`), where each has what is the other's (`swaps`), where both are equal (`equals`).
PROPOSAL = "struct<first:string,second:string,fills:boolean,shifts:boolean,swaps:boolean,equals:boolean>"


def proposal(first: Column, second: Column, fills: bool | Column = False, shifts: bool = False, swaps: bool = False, equals: bool | Column = False) -> Column:
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(first.alias("first"), second.alias("second"), flag(fills).alias("fills"), flag(shifts).alias("shifts"), flag(swaps).alias("swaps"), flag(equals).alias("equals")).cast(PROPOSAL)


def fold(first: Column, second: Column, proposals: list[Column], is_bad: Callable[[Column], Column]) -> Column:
    """(first, second) after all proposals in order, each applied to what those before it left."""

    def apply(now: Column, p: Column) -> Column:
        both = p["first"].isNotNull() & p["second"].isNotNull()
        same = now["first"] == now["second"]
        turned = p["swaps"] & (now["first"] == p["second"]) & (now["second"] == p["first"])
        moved = p["shifts"] & (now["first"] == p["second"])
        all_new = F.coalesce(both & (turned | moved | (p["equals"] & same)), F.lit(False))
        bad = lambda v: F.coalesce(is_bad(v) | same, v.isNull())
        taken = lambda k: F.when(all_new | (p["fills"] & p[k].isNotNull() & bad(now[k])), p[k]).otherwise(now[k]).alias(k)
        return F.struct(taken("first"), taken("second"))

    start = F.struct(first.alias("first"), second.alias("second")).cast("struct<first:string,second:string>")
    return F.aggregate(F.array(*proposals), start, apply)
