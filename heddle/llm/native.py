"""Span expressions built of DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
SPAN_AROUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
BLOCK = 128
TEXT_BLOCK = 2048
FAR = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas of the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(xs: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What ``merge`` makes of the elements before each one, by blocks: the cost grows as n * BLOCK, not as the square of n."""

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, merge)

    def scanned(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))
        return let(
            blocks,
            lambda bs: let(
                F.transform(bs, lambda _, b: total(F.slice(bs, F.lit(1), b))),
                lambda before: F.transform(xs, lambda _, i: merge(F.get(before, F.floor(i / BLOCK).cast("int")), total(F.slice(xs, i - i % BLOCK + 1, i % BLOCK)))),
            ),
        )

    return F.when(F.size(xs) > 0, let(xs, scanned)).otherwise(F.array().cast("array<int>"))


def running(lengths: Column) -> Column:
    """Sums of the elements before each one."""
    return before_each(lengths, F.lit(0), lambda a, x: a + x)


def reached(ends: Column) -> Column:
    """The greatest of the ends before each one (0: none)."""
    return before_each(ends, F.lit(0), lambda a, x: F.greatest(a, x))


def blocks_of(text: Column) -> Column:
    """The text in blocks of TEXT_BLOCK code points, from which cut() takes parts without a walk from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text's code points from start to end."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    around = F.array_join(F.slice(blocks, first + 1, F.floor(end / TEXT_BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(around, start % TEXT_BLOCK + 1, end - start)).otherwise("")


def spans(text: Column, pattern: str, present: Column | None = None, around: int = 0) -> Column:
    """Leftmost non-overlapping matches of a Java pattern, with places in code points, end exclusive.

    The pieces between the matches give the places: their lengths and the matches' add up. A row
    without any match costs one search (or only ``present``, a cheap necessary condition). With ``around``, spans
    have so many code points ``before`` and ``after`` them, as far as the neighbouring matches.
    """
    some = text.rlike(pattern) if present is None else present & text.rlike(pattern)

    def place(both: Column) -> Column:
        gaps, hits = both["gaps"], both["hits"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))

        def span(h: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            parts = [start.alias("start"), (start + F.length(h)).alias("end"), h.alias("value")]
            if around:
                parts += [F.substring(F.get(gaps, i), -around, around).alias("before"), F.substring(F.get(gaps, i + 1), 1, around).alias("after")]
            return F.struct(*parts)

        return let(running(steps), lambda before: F.transform(hits, lambda h, i: span(h, i, before)))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(some, let(both, place)).otherwise(F.array().cast(SPAN_AROUND if around else SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string have a valid check digit."""

    def add(acc: Column, d: Column) -> Column:
        twice = d * 2
        return F.struct(
            (acc["sum"] + F.when(acc["odd"], F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)).alias("sum"),
            (~acc["odd"]).alias("odd"),
        )

    figures = F.transform(F.split(F.reverse(digits(value)), ""), lambda c: F.ascii(c) - 48)
    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(figures, start, add, lambda acc: acc["sum"] % 10 == 0)


def shown(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def apart_from(found: Column, others: Column) -> Column:
    """The spans (in order, none overlapping) that overlap none of the others: one sort and two sweeps."""

    def marked(both: Column) -> Column:
        """Whether each span of ``found``, in order, is clear."""
        ends = F.transform(both, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0))
        back = F.reverse(F.transform(both, lambda x: F.when(x["own"] == 0, -x["start"]).otherwise(-FAR)))
        ahead = before_each(back, F.lit(-FAR), lambda a, x: F.greatest(a, x))

        def clear(x: Column, i: Column, behind: Column, later: Column) -> Column:
            return (F.get(behind, i) <= x["start"]) & (-F.get(later, F.size(both) - 1 - i) >= x["end"])

        flags = let(reached(ends), lambda behind: let(ahead, lambda later: F.transform(both, lambda x, i: F.struct(x["own"].alias("own"), clear(x, i, behind, later).alias("clear")))))
        return F.transform(F.filter(flags, lambda x: x["own"] == 1), lambda x: x["clear"])

    def placed(xs: Column, own: int) -> Column:
        return F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own")))

    def chosen(flags: Column) -> Column:
        return F.filter(found, lambda _, i: F.get(flags, i))

    both = F.sort_array(F.concat(placed(others, 0), placed(found, 1)))
    return F.when((F.size(found) > 0) & (F.size(others) > 0), let(let(both, marked), chosen)).otherwise(found)


def first_of_overlapping(found: Column) -> Column:
    """Of spans in order of start those that overlap none before them."""
    return F.when(F.size(found) > 1, let(reached(F.transform(found, lambda x: x["end"])), lambda behind: F.filter(found, lambda x, i: F.get(behind, i) <= x["start"]))).otherwise(found)
