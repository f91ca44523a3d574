"""Profiles: a named, frozen choice of detectors and conflict policy for clinical texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..functions.conflicts import check_policy
from . import records, redaction
from .detectors import BANK_CARD, DEFAULTS, EMAIL, PatternDetector, PatternRule, detect, detect_long

TEMPLATES = ("outpatient_note", "discharge_summary", "referral_letter")


@dataclass(frozen=True)
class ClinicalProfile:
    """The template is a label and changes nothing; only redaction uses the conflict policy."""

    template: str
    detectors: tuple[Any, ...]
    conflict_policy: str = "reject"
    type_priority: tuple[str, ...] | None = None

    def detect(self, df: DataFrame, column: str = "text") -> DataFrame:
        return detect(df, column, self.detectors)

    def detect_long(self, df: DataFrame, keys: Sequence[str], column: str = "text") -> DataFrame:
        return detect_long(df, keys, column, self.detectors)

    def redact(self, df: DataFrame, column: str = "text", **options) -> DataFrame:
        return redaction.redact(df, column, self.detectors, self.conflict_policy, self.type_priority, **options)

    def report(self, df: DataFrame, column: str = "text") -> DataFrame:
        return redaction.report_column(df, column, self.detectors)

    def detect_fields(self, df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
        return records.detect_fields(df, keys, fields, self.detectors)

    def report_fields(self, df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
        return records.report_fields(df, keys, fields, self.detectors)

    def redact_fields(self, df: DataFrame, fields: Sequence[str]) -> DataFrame:
        return records.redact_fields(df, fields, self.detectors, self.conflict_policy, self.type_priority)


def clinical_profile(template: str, institutional_rules: Sequence[PatternRule] = (), include_email: bool = True, include_bank_card: bool = False, person_detector: Any = None, conflict_policy: str = "reject", type_priority: Sequence[str] | None = None) -> ClinicalProfile:
    """National id, mobile, IBAN, e-mail unless left out, cards if asked for, the institution's rules, person names."""
    if not isinstance(template, str):
        raise TypeError("template must be a str")
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}")
    if not isinstance(include_email, bool) or not isinstance(include_bank_card, bool):
        raise TypeError("include_email and include_bank_card must be bool")
    if isinstance(institutional_rules, (str, bytes)) or not isinstance(institutional_rules, Sequence) or any(not isinstance(r, PatternRule) for r in institutional_rules):
        raise TypeError("institutional_rules must be a sequence of PatternRule")
    if person_detector is not None and not callable(getattr(person_detector, "detect", None)):
        raise TypeError("person_detector must have a detect method")
    check_policy(conflict_policy, type_priority)
    chosen = [*DEFAULTS, *[EMAIL] * include_email, *[BANK_CARD] * include_bank_card]
    if institutional_rules:
        chosen.append(PatternDetector(institutional_rules))
    if person_detector is not None:
        chosen.append(person_detector)
    return ClinicalProfile(template, tuple(chosen), conflict_policy, tuple(type_priority) if type_priority else None)
