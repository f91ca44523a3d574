"""Placeholders: allocation by first appearance, splicing, and restoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import bind

#: A literal that looks like a placeholder; the type holds no bracket and no line break.
TOKEN = r"\[[^\[\]\r\n]+_[1-9][0-9]*\]"


def allocated(text: Column, spans: Column) -> Column:
    """Array of structs (type, normalized_value, placeholder, value): the identities of resolved spans in order.

    Per type the numbers count from 1 and pass over those whose placeholder the text already contains.
    """
    seen = F.array().cast("array<struct<type:string,normalized_value:string,value:string>>")

    def add(acc, x):
        own = F.struct(x["type"].alias("type"), x["normalized_value"].alias("normalized_value"), x["value"].alias("value"))
        known = F.exists(acc, lambda o: (o["type"] == x["type"]) & (o["normalized_value"] == x["normalized_value"]))
        return F.when(known, acc).otherwise(F.array_append(acc, own))

    identities = F.aggregate(spans, seen, add)
    literals = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1))
    start = F.struct(F.array().cast("array<struct<type:string,normalized_value:string,placeholder:string,value:string>>").alias("out"))

    def place(acc, x):
        mine = F.filter(acc["out"], lambda o: o["type"] == x["type"])
        label = lambda n: F.concat(F.lit("["), x["type"], F.lit("_"), n.cast("string"), F.lit("]"))
        last = F.coalesce(F.element_at(F.split(F.get(F.reverse(mine), F.lit(0))["placeholder"], "_"), -1), F.lit("0]"))
        number = F.regexp_replace(last, r"\]", "").cast("int")
        free = F.filter(F.sequence(number + 1, number + 1 + F.size(literals)), lambda n: ~F.array_contains(literals, label(n)))
        own = F.struct(x["type"].alias("type"), x["normalized_value"].alias("normalized_value"), label(F.get(free, F.lit(0))).alias("placeholder"), x["value"].alias("value"))
        return F.struct(F.array_append(acc["out"], own).alias("out"))

    return F.aggregate(identities, start, place, lambda acc: acc["out"])


def spliced(text: Column, spans: Column, placeholders: Column) -> Column:
    """The text with each of the disjoint sorted spans replaced by its identity's placeholder."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        found = F.filter(placeholders, lambda o: (o["type"] == x["type"]) & (o["normalized_value"] == x["normalized_value"]))
        before = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(x["end"].alias("at"), F.array_append(F.array_append(acc["out"], before), F.get(found, F.lit(0))["placeholder"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def redacted(text: Column, spans: Column) -> Column:
    """One document redacted on its own; a text without spans is unchanged."""
    return bind(text, lambda t: bind(spans, lambda s: F.when(F.size(s) == 0, t).otherwise(bind(allocated(t, s), lambda p: spliced(t, s, p)))))


def restored(text: Column, mapping: Column) -> Column:
    """The text with every known placeholder of a map column replaced, in one pass; unknown ones stay."""
    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)
    gaps = F.split(text, TOKEN, -1)
    parts = F.zip_with(gaps, tokens, lambda g, t: F.concat(g, F.coalesce(F.element_at(mapping, t), t, F.lit(""))))
    return F.when(mapping.isNull(), text).otherwise(F.array_join(parts, ""))
