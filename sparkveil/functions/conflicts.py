"""Conflict policies over an array of spans.

``reject`` raises on any overlap or duplicate. ``longest`` and ``priority`` collapse equal spans and accept greedily
by length, or by rank of type and then length; two overlapping spans that compare equal while both are open are
ambiguous and raise. ``resolution`` returns an error text in place of raising.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import SPANS, bind, overlap, sorted_spans

POLICIES = ("reject", "longest", "priority")


def check_policy(policy: str, type_priority: Sequence[str] | None) -> None:
    if not isinstance(policy, str):
        raise TypeError("policy must be a str")
    if policy not in POLICIES:
        raise ValueError(f"unknown conflict policy {policy!r}")
    if policy != "priority":
        if type_priority is not None:
            raise ValueError("type_priority goes with the priority policy alone")
        return
    if type_priority is None:
        raise ValueError("the priority policy needs type_priority")
    if isinstance(type_priority, (str, bytes)) or not isinstance(type_priority, Sequence):
        raise TypeError("type_priority must be a sequence of str")
    if any(not isinstance(t, str) for t in type_priority):
        raise TypeError("type_priority must hold str")
    if not type_priority or any(not t.strip() for t in type_priority) or len(set(type_priority)) < len(type_priority):
        raise ValueError("type_priority must be non-empty, without blanks or repeats")


def _where(x: Column) -> Column:
    return F.concat(F.lit("["), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"), F.lit("] ("), x["type"], F.lit(")"))


def _message(text: str, a: Column, b: Column) -> Column:
    return F.concat(F.lit(text + " at spans "), _where(a), F.lit(" and "), _where(b))


def conflict_pairs(spans: Column) -> Column:
    """Array of structs (i, j) of overlapping spans, i < j."""
    numbered = F.transform(spans, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.flatten(F.transform(numbered, lambda a: F.transform(F.filter(numbered, lambda b: (b["i"] > a["i"]) & overlap(a["x"], b["x"])), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j")))))


def _sweep(spans: Column) -> Column:
    """Error text of the first overlap of sorted spans, by comparing each start with the furthest end so far."""
    start = F.struct(F.lit(None).cast("struct<start:int,end:int,type:string>").alias("last"), F.lit(None).cast("string").alias("error"))

    def step(acc, x):
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"))
        hit = acc["error"].isNull() & acc["last"].isNotNull() & (x["start"] < acc["last"]["end"])
        further = acc["last"].isNull() | (x["end"] > acc["last"]["end"])
        return F.struct(F.when(further, own).otherwise(acc["last"]).alias("last"), F.when(hit, _message("Overlapping detections", acc["last"], x)).otherwise(acc["error"]).alias("error"))

    return F.aggregate(spans, start, step, lambda acc: acc["error"])


def resolution(spans: Column, policy: str = "reject", type_priority: Sequence[str] | None = None) -> Column:
    """Struct (spans, error): the accepted spans by start, end and type, or null and why there are none."""
    check_policy(policy, type_priority)
    return bind(spans, lambda x: bind(sorted_spans(x), lambda base: _resolution(x, base, policy, type_priority)))


def _resolution(spans: Column, base: Column, policy: str, type_priority: Sequence[str] | None) -> Column:
    if policy == "reject":
        return bind(_sweep(base), lambda error: F.struct(F.when(error.isNull(), base).alias("spans"), error.alias("error")))
    known = {t: i for i, t in enumerate(type_priority or ())}
    rank = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in known.items() for v in kv]), x["type"]), F.lit(len(known) + 1)) if known else F.lit(0)
    keyed = F.transform(F.array_distinct(spans), lambda x: F.struct(rank(x).alias("r"), (x["start"] - x["end"]).alias("l"), x["start"].alias("a"), x["end"].alias("b"), x.alias("x")))
    start = F.struct(F.array().cast("array<struct<r:int,l:int,x:struct<type:string,start:int,end:int,value:string,normalized_value:string>>>").alias("out"), F.lit(None).cast("string").alias("error"))
    what = "equal-length" if policy == "longest" else "equal-priority"

    def step(acc, k):
        x = k["x"]
        hits = F.filter(acc["out"], lambda o: overlap(o["x"], x))
        peer = (lambda o: o["l"] == k["l"]) if policy == "longest" else (lambda o: (o["l"] == k["l"]) & (o["r"] == k["r"]))
        better = F.exists(hits, lambda o: ~peer(o))
        tie = (F.size(hits) > 0) & ~better
        own = F.struct(k["r"].cast("int").alias("r"), k["l"].cast("int").alias("l"), x.alias("x"))
        error = F.when(acc["error"].isNull() & tie, _message(f"Ambiguous conflict between {what} detections", F.get(hits, F.lit(0))["x"], x)).otherwise(acc["error"])
        return F.struct(F.when(F.size(hits) == 0, F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"), error.alias("error"))

    return bind(F.aggregate(F.array_sort(keyed), start, step), lambda done: _accepted(done, base, policy, list(known)))


def _accepted(done: Column, base: Column, policy: str, known: list[str]) -> Column:
    error = done["error"]
    if policy == "priority":
        numbered = F.transform(base, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        loose = F.filter(numbered, lambda a: ~a["x"]["type"].isin(known) & F.exists(numbered, lambda b: (b["i"] != a["i"]) & overlap(a["x"], b["x"])))
        first = F.get(loose, F.lit(0))["x"]
        error = F.coalesce(F.when(F.size(loose) > 0, F.concat(F.lit("Conflicting detection has no configured priority: "), _where(first))), error)
    accepted = sorted_spans(F.transform(done["out"], lambda o: o["x"]))
    return F.struct(F.when(error.isNull(), accepted).cast(SPANS).alias("spans"), error.alias("error"))


def resolve(spans: Column, policy: str = "reject", type_priority: Sequence[str] | None = None) -> Column:
    """The accepted spans; a conflict that the policy does not settle raises when the row is computed."""
    return bind(resolution(spans, policy, type_priority), lambda done: F.when(done["error"].isNotNull(), F.raise_error(done["error"]).cast(SPANS)).otherwise(done["spans"]))
