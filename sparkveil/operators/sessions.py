"""Pseudonymisation of conversations: stable placeholders within a session, turn by turn."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conflicts import check_policy, resolution
from ..functions.redact import TOKEN, restored
from .detectors import detections

Span = tuple[str, int, int, str, str]


class SessionState:
    """What a session remembers. ``turn`` either takes effect whole or leaves the state as it was."""

    def __init__(self, placeholders=(), reserved=(), counters=()):
        self.by_identity: dict[tuple[str, str], str] = {(t, n): p for t, n, p, _ in placeholders}
        self.value: dict[str, str] = {p: v for _, _, p, v in placeholders}
        self.reserved: set[str] = set(reserved)
        self.counter: dict[str, int] = dict(counters)

    def turn(self, text: str, spans: Sequence[Span]) -> str:
        """The text with its resolved spans replaced; raises if it holds a placeholder this session has assigned."""
        literals = set(re.findall(TOKEN, text))
        if clash := sorted(literals & self.value.keys()):
            raise ValueError(f"Input contains a placeholder already assigned by this session: {clash[0]}")
        new, number, out, at = {}, {}, [], 0
        for type_, start, end, value, norm in spans:
            known = self.by_identity.get((type_, norm)) or (new[type_, norm][0] if (type_, norm) in new else None)
            if known is None:
                n = number.get(type_, self.counter.get(type_, 0)) + 1
                while (known := f"[{type_}_{n}]") in text or known in self.value or known in self.reserved or known in literals:
                    n += 1
                number[type_] = n
                new[type_, norm] = (known, value)
            out += (text[at:start], known)
            at = end
        self.reserved |= literals
        self.counter |= number
        self.by_identity |= {k: p for k, (p, _) in new.items()}
        self.value |= dict(new.values())
        return "".join(out) + text[at:]


def _resolved(df: DataFrame, text: str, detectors, policy: str, priority) -> DataFrame:
    check_policy(policy, priority)
    return df.withColumn("_done", resolution(detections(F.col(text), detectors), policy, priority))


def _fold(session: str, order: str, text: str, name: str, mapping: bool, on_error: str):
    def run(key: tuple[Any, ...], groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = SessionState(), None
        for rows in groups:
            out, errors = [], []
            for t, done in zip(rows[text], rows["_done"], strict=True):
                error, result = (None if done is None else done["error"]), None
                if t is not None and not error:
                    try:
                        result = state.turn(t, [(s["type"], s["start"], s["end"], s["value"], s["normalized_value"]) for s in done["spans"]])
                    except ValueError as e:
                        error = str(e)
                if error and on_error == "raise":
                    raise ValueError(error)
                out.append(result)
                errors.append(error)
            if not mapping:
                yield rows.drop(columns="_done").assign(**{name: pd.Series(out, index=rows.index, dtype=object), "error": pd.Series(errors, index=rows.index, dtype=object)})
            last = rows
        if mapping and last is not None:
            yield pd.DataFrame({session: [key[0]] * len(state.value), "placeholder": list(state.value), "value": list(state.value.values())})

    return run


def pseudonymize(df: DataFrame, session: str = "session_id", order: str = "turn", text: str = "text", detectors: Sequence[Any] | None = None, conflict_policy: str = "reject", type_priority: Sequence[str] | None = None, name: str = "pseudonymized", on_error: str = "raise") -> DataFrame:
    """``df`` with each turn pseudonymised and column ``error``; a turn that fails leaves its session as it was.

    Spans are found and resolved in the JVM, row by row; then one exchange by session, sorted by turn, and a fold over
    each session in batches: a session is streamed, not held.
    """
    ready = _resolved(df, text, detectors, conflict_policy, type_priority)
    return _grouped(ready, session, order, _fold(session, order, text, name, False, on_error), _schema(df, name))


def session_mapping(df: DataFrame, session: str = "session_id", order: str = "turn", text: str = "text", detectors: Sequence[Any] | None = None, conflict_policy: str = "reject", type_priority: Sequence[str] | None = None, on_error: str = "raise") -> DataFrame:
    """Rows (session, placeholder, value): the first surface form of each identity. Sensitive."""
    ready = _resolved(df, text, detectors, conflict_policy, type_priority)
    kind = df.schema[session].dataType.simpleString()
    return _grouped(ready, session, order, _fold(session, order, text, "", True, on_error), f"`{session}` {kind}, placeholder string, value string")


def _schema(df: DataFrame, name: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` string, error string"


def _grouped(df: DataFrame, session: str, order: str, fold, schema: str) -> DataFrame:
    """Sessions in order: partitioned by session, sorted by session and turn, then cut at each change of session."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A session's rows stand together; a generator per session is fed piece by piece.
        pieces = ((key, part) for batch in batches for key, part in _cut(batch, session))
        held: list = next(pieces, None)
        while held is not None:
            key = held[0]
            rest: list = []

            def own(first=held, key=key, rest=rest):
                item = first
                while item is not None:
                    if item[0] != key:
                        rest.append(item)
                        return
                    yield item[1]
                    item = next(pieces, None)

            yield from fold((key[0],), own())
            held = rest[0] if rest else None

    return df.repartition(session).sortWithinPartitions(session, order).mapInPandas(run, schema)


def _cut(batch: pd.DataFrame, session: str):
    keys = batch[session]
    changed = (keys != keys.shift()) & ~(keys.isna() & keys.shift().isna())
    for _, part in batch.groupby(changed.cumsum(), sort=False):
        key = part[session].iloc[0]
        yield (None if pd.isna(key) else key,), part


def restore(df: DataFrame, mapping: DataFrame, session: str = "session_id", text: str = "text", name: str = "restored") -> DataFrame:
    """``df`` with known placeholders of each row's session put back; a session without any keeps its text."""
    maps = mapping.groupBy(F.col(session).alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("_map"))
    return df.join(maps, F.col(session).eqNullSafe(F.col("_s")), "left").withColumn(name, restored(F.col(text), F.col("_map"))).drop("_s", "_map")
