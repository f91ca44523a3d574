"""Span search: every match of a pattern with its offsets, as an array column.

Offsets are half-open and count code points, as do Spark's ``length`` and ``substring``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<type:string,start:int,end:int,value:string,normalized_value:string>"
SPANS = f"array<{SPAN}>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(type_, start, end, text: Column, norm: Column) -> Column:
    return F.struct(
        F.lit(type_).alias("type") if isinstance(type_, str) else type_.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"),
        F.substring(text, start + 1, end - start).alias("value"), F.substring(norm, start + 1, end - start).alias("normalized_value"),
    )


def find_spans(text: Column, norm: Column, pattern: str, type_: str, scan_original: bool = False, likely: str | None = None, valid: Callable[[Column], Column] | None = None) -> Column:
    """Array of the spans of non-overlapping matches, left to right, that ``valid`` accepts.

    ``likely`` is a cheap pattern that any text with a match contains; other texts are not searched. A match that
    ``valid`` refuses is dropped and nothing shorter is tried in its place. Null text gives null.
    """
    source = text if scan_original else norm
    matches = F.regexp_extract_all(source, F.lit(pattern), 0)
    gaps = F.split(source, pattern, -1)
    steps = F.zip_with(matches, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))
    # gaps has one more element than matches: the padded last pair has no match and is cut off.
    steps = F.filter(steps, lambda s: s["len"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc, s):
        begin = acc["at"] + s["gap"]
        end = begin + s["len"]
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("s"), end.alias("e"))).alias("out"))

    found = F.aggregate(steps, start, step, lambda acc: acc["out"])
    spans = F.transform(found, lambda x: span(type_, x["s"], x["e"], text, norm))
    if valid is not None:
        spans = F.filter(spans, lambda x: valid(x["normalized_value"] if not scan_original else x["value"]))
    return F.when(source.rlike(likely or pattern), spans).when(source.isNotNull(), no_spans())


def sorted_spans(spans: Column) -> Column:
    """By start, end and type; ties keep the detectors' order, so equal spans of two detectors stay two."""
    keyed = F.transform(spans, lambda x, i: F.struct(x["start"].alias("a"), x["end"].alias("b"), x["type"].alias("c"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
