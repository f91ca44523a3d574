"""Field-targeted operations on nested records: struct columns addressed by dotted paths."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conflicts import check_policy, resolution
from ..functions.redact import TOKEN, spliced
from ..functions.reports import report
from .detectors import detections


def parse_path(path: str) -> tuple[str, ...]:
    if not isinstance(path, str):
        raise TypeError("a field path must be a str")
    parts = tuple(path.split("."))
    if not path or any(not p for p in parts):
        raise ValueError("a field path must not be empty or hold an empty part")
    return parts


def check_fields(fields: Sequence[str]) -> list[tuple[str, ...]]:
    if isinstance(fields, (str, bytes)) or not isinstance(fields, Sequence):
        raise TypeError("fields must be a sequence of paths")
    paths = []
    for i, f in enumerate(fields):
        if not isinstance(f, str):
            raise TypeError(f"field {i} must be a str")
        paths.append(parse_path(f))
    if not paths:
        raise ValueError("fields must not be empty")
    if len(set(paths)) < len(paths):
        raise ValueError("fields must not repeat")
    return paths


def target(df: DataFrame, path: tuple[str, ...]) -> Column:
    """The string column at a path, checked against the schema when the plan is made."""
    kind: T.DataType = df.schema
    for i, name in enumerate(path):
        if not isinstance(kind, T.StructType):
            raise TypeError(f"{'.'.join(path[:i])!r} is not a record")
        if name not in kind.fieldNames():
            raise KeyError(".".join(path))
        kind = kind[name].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"{'.'.join(path)!r} is not a string")
    return F.col(".".join(f"`{p}`" for p in path))


def _put(df: DataFrame, path: tuple[str, ...], value: Column) -> DataFrame:
    if len(path) == 1:
        return df.withColumn(path[0], value)
    return df.withColumn(path[0], F.col(f"`{path[0]}`").withField(".".join(f"`{p}`" for p in path[1:]), value))


def detect_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str], detectors: Sequence[Any] | None = None) -> DataFrame:
    """One row per span: keys, path, type, start, end, value, normalized_value. Only the named fields are read."""
    paths = check_fields(fields)
    found = F.array(*[F.struct(F.lit(".".join(p)).alias("path"), F.coalesce(detections(target(df, p), detectors), F.expr("array()")).alias("found")) for p in paths])
    return df.select(*keys, F.explode(found).alias("f")).select(*keys, "f.path", F.inline("f.found"))


def report_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str], detectors: Sequence[Any] | None = None) -> DataFrame:
    """One row per record and field: keys, path and the field's report."""
    paths = check_fields(fields)
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(".".join(p)).alias("path"), target(df, p).alias("text")) for p in paths])).alias("f"))
    rows = rows.select(*keys, "f.path", detections(F.col("f.text"), detectors).alias("found"))
    return rows.select(*keys, "path", report(F.col("found")).alias("report")).select(*keys, "path", "report.*")


def redact_fields(df: DataFrame, fields: Sequence[str], detectors: Sequence[Any] | None = None, conflict_policy: str = "reject", type_priority: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the named fields redacted by one session per record, in the order of ``fields``.

    Identities keep their placeholder across fields, numbers pass over literal placeholders of this and earlier fields,
    and a later field that holds a placeholder assigned before raises. All other values stay as they are. Null fields
    stay null.
    """
    check_policy(conflict_policy, type_priority)
    paths = check_fields(fields)
    out = df
    known = F.array().cast("array<struct<type:string,normalized_value:string,placeholder:string,value:string>>")
    reserved = F.array().cast("array<string>")
    out = out.withColumns({"_known": known, "_reserved": reserved})
    for i, path in enumerate(paths):
        text = target(df, path)
        out = out.withColumn(f"_d{i}", F.when(text.isNotNull(), resolution(detections(text, detectors), conflict_policy, type_priority)))
        error = F.col(f"_d{i}.error")
        spans = F.when(error.isNotNull(), F.raise_error(error).cast("array<struct<type:string,start:int,end:int,value:string,normalized_value:string>>")).otherwise(F.coalesce(F.col(f"_d{i}.spans"), F.expr("array()")))
        literals = F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)), reserved)
        clash = F.array_sort(F.array_intersect(literals, F.transform("_known", lambda o: o["placeholder"])))
        spans = F.when(F.size(clash) > 0, F.raise_error(F.concat(F.lit("Input contains a placeholder already assigned by this session: "), F.get(clash, F.lit(0)))).cast("array<struct<type:string,start:int,end:int,value:string,normalized_value:string>>")).otherwise(spans)
        out = out.withColumn(f"_s{i}", spans).withColumn("_reserved", F.array_union("_reserved", literals))
        out = out.withColumn("_known", _extended(F.col("_known"), F.col(f"_s{i}"), F.col("_reserved")))
        out = out.withColumn(f"_r{i}", F.when(text.isNotNull(), spliced(text, F.col(f"_s{i}"), F.col("_known"))))
    for i, path in enumerate(paths):
        out = _put(out, path, F.col(f"_r{i}"))
    return out.select(*df.columns)


def _extended(known: Column, spans: Column, reserved: Column) -> Column:
    """The identities known so far and those that the spans add, numbered past reserved literals."""

    def add(acc, x):
        mine = F.filter(acc, lambda o: o["type"] == x["type"])
        label = lambda n: F.concat(F.lit("["), x["type"], F.lit("_"), n.cast("string"), F.lit("]"))
        last = F.coalesce(F.array_max(F.transform(mine, lambda o: F.regexp_extract(o["placeholder"], r"_([0-9]+)\]$", 1).cast("int"))), F.lit(0))
        free = F.filter(F.sequence(last + 1, last + 1 + F.size(reserved)), lambda n: ~F.array_contains(reserved, label(n)))
        own = F.struct(x["type"].alias("type"), x["normalized_value"].alias("normalized_value"), label(F.get(free, F.lit(0))).alias("placeholder"), x["value"].alias("value"))
        seen = F.exists(mine, lambda o: o["normalized_value"] == x["normalized_value"])
        return F.when(seen, acc).otherwise(F.array_append(acc, own))

    return F.aggregate(spans, known, add)
