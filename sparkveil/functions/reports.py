"""Value-free reports over an array of spans, and their JSON forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conflicts import conflict_pairs
from .spans import overlap


def report(spans: Column) -> Column:
    """Struct of total, counts by type (sorted map), distinct types, and what overlaps or repeats.

    Overlapping spans count by position, so equal spans each count; a group of duplicates agrees on all five fields.
    """
    types = F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["type"])))
    counts = F.map_from_arrays(types, F.transform(types, lambda t: F.size(F.filter(spans, lambda x: x["type"] == t))))
    numbered = F.transform(spans, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    pairs = F.size(conflict_pairs(spans))
    involved = F.size(F.filter(numbered, lambda a: F.exists(numbered, lambda b: (a["i"] != b["i"]) & overlap(a["x"], b["x"]))))
    groups = F.size(F.filter(F.array_distinct(spans), lambda x: F.size(F.filter(spans, lambda y: x == y)) > 1))
    return F.struct(
        F.size(spans).alias("total_detections"), counts.alias("counts"), F.size(types).alias("distinct_types"), (pairs > 0).alias("has_conflicts"),
        pairs.alias("conflict_pairs"), involved.alias("conflicting_detections"), groups.alias("duplicate_groups"),
    )


def report_is_consistent(r: Column) -> Column:
    """The invariants that every report obeys."""
    total = F.aggregate(F.map_values(r["counts"]), F.lit(0), lambda a, b: a + b)
    return (
        (r["total_detections"] == total) & (r["distinct_types"] == F.size(r["counts"])) & (r["has_conflicts"] == (r["conflict_pairs"] > 0))
        & (r["conflicting_detections"] <= r["total_detections"]) & (r["has_conflicts"] == (r["conflicting_detections"] >= 2))
        & (2 * r["duplicate_groups"] <= r["total_detections"]) & ~F.exists(F.map_values(r["counts"]), lambda n: n <= 0)
    )


def safe_spans(spans: Column) -> Column:
    """Type, start and end alone, in order, repeats kept."""
    return F.transform(spans, lambda x: F.struct(x["type"], x["start"], x["end"]))


def spans_json(spans: Column) -> Column:
    return F.to_json(safe_spans(spans))


def report_json(r: Column) -> Column:
    return F.to_json(r)


def spans_json_indented(spans: Column, indent: int = 2) -> Column:
    """The indented form with one line break at the end, as Python's ``json.dumps(..., indent)`` writes it."""
    one, two = " " * indent, " " * (2 * indent)
    items = F.transform(spans, lambda x: F.concat(F.lit(one + "{\n" + two + '"type": '), F.concat(F.lit('"'), x["type"], F.lit('"')), F.lit(",\n" + two + '"start": '), x["start"].cast("string"), F.lit(",\n" + two + '"end": '), x["end"].cast("string"), F.lit("\n" + one + "}")))
    return F.when(F.size(spans) == 0, F.lit("[]\n")).otherwise(F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("\n]\n")))
