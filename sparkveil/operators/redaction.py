"""Redaction and reports over a DataFrame column: narrow projections."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conflicts import check_policy, resolution, resolve
from ..functions.redact import redacted
from ..functions.reports import report
from .detectors import check_text_column, detect, detections


def redact(df: DataFrame, column: str = "text", detectors: Sequence[Any] | None = None, conflict_policy: str = "reject", type_priority: Sequence[str] | None = None, name: str = "redacted", on_error: str = "raise") -> DataFrame:
    """``df`` with each text redacted on its own; numbering restarts in every row. Null text gives null.

    ``on_error='record'`` gives null text and the reason in column ``error`` where the policy does not settle a
    conflict; ``'raise'`` fails the job there. Reasons hold types and offsets, never text.
    """
    check_policy(conflict_policy, type_priority)
    check_text_column(df, column)
    text = F.col(column)
    found = detect(df, column, detectors, "_found")
    if on_error == "record":
        done = found.withColumn("_done", resolution(F.col("_found"), conflict_policy, type_priority))
        return done.withColumns({name: F.when(F.col("_done.error").isNull(), redacted(text, F.col("_done.spans"))), "error": F.col("_done.error")}).drop("_found", "_done")
    return found.withColumn("_spans", resolve(F.col("_found"), conflict_policy, type_priority)).withColumn(name, redacted(text, F.col("_spans"))).drop("_found", "_spans")


def report_column(df: DataFrame, column: str = "text", detectors: Sequence[Any] | None = None, name: str = "report") -> DataFrame:
    """``df`` with a value-free report of each text; no conflict is resolved."""
    check_text_column(df, column)
    return df.withColumn("_found", detections(F.col(column), detectors)).withColumn(name, F.when(F.col("_found").isNotNull(), report(F.col("_found")))).drop("_found")
