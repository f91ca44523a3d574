"""Streaming pseudonymisation: session state kept by key, turns of a micro-batch taken in order.

Detection, redaction and reports of single texts are narrow projections and run on a stream as they are; only
sessions need state. Turns that come late, after a higher turn of an earlier batch, are numbered as they arrive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.reports import report
from ..operators.detectors import detections
from ..operators.sessions import SessionState, _resolved


def pseudonymize_stream(df: DataFrame, session: str = "session_id", order: str = "turn", text: str = "text", detectors: Sequence[Any] | None = None, conflict_policy: str = "reject", type_priority: Sequence[str] | None = None) -> DataFrame:
    """Rows (session, order, pseudonymized, error) in append mode; an error leaves the session's state as it was."""
    ready = _resolved(df, text, detectors, conflict_policy, type_priority).select(F.col(session), F.col(order), F.col(text), F.to_json("_done").alias("_done"))
    kind = df.schema[session].dataType.simpleString()
    turn_kind = df.schema[order].dataType.simpleString()

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = SessionState(*map(_pairs, json.loads(state.get[0]))) if state.exists else SessionState()
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out, errors = [], []
        for t, done in zip(rows[text], rows["_done"], strict=True):
            found = json.loads(done) if done else {}
            error, result = found.get("error"), None
            if t is not None and not error:
                try:
                    result = held.turn(t, [(s["type"], s["start"], s["end"], s["value"], s["normalized_value"]) for s in found.get("spans", ())])
                except ValueError as e:
                    error = str(e)
            out.append(result)
            errors.append(error)
        state.update((json.dumps([[[t, n, p, held.value[p]] for (t, n), p in held.by_identity.items()], sorted(held.reserved), list(held.counter.items())]),))
        yield pd.DataFrame({session: rows[session], order: rows[order], "pseudonymized": pd.Series(out, index=rows.index, dtype=object), "error": pd.Series(errors, index=rows.index, dtype=object)})

    return ready.groupBy(session).applyInPandasWithState(run, f"`{session}` {kind}, `{order}` {turn_kind}, pseudonymized string, error string", "state string", "append", GroupStateTimeout.NoTimeout)


def _pairs(x):
    return [tuple(i) if isinstance(i, list) else i for i in x]


def windowed_counts(df: DataFrame, time: str = "ts", text: str = "text", detectors: Sequence[Any] | None = None, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """An extra over event time: detections per type and tumbling window, late rows admitted up to a watermark."""
    found = df.withWatermark(time, late).select(F.col(time), F.explode(F.map_entries(report(detections(F.col(text), detectors))["counts"])).alias("c"))
    return found.groupBy(F.window(time, width).alias("window"), F.col("c.key").alias("type")).agg(F.sum("c.value").alias("n"))
