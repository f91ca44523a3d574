"""Length-preserving digit and letter normalisation: one code point becomes one code point, so offsets are shared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERSIAN_DIGITS = "".join(chr(0x06F0 + i) for i in range(10))
ARABIC_DIGITS = "".join(chr(0x0660 + i) for i in range(10))
ASCII_DIGITS = "0123456789"
#: Arabic yeh and kaf, and the Persian letters they become.
ARABIC_LETTERS, PERSIAN_LETTERS = "يك", "یک"


def normalize_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def normalize_letters(text: Column) -> Column:
    return F.translate(text, ARABIC_LETTERS, PERSIAN_LETTERS)


def normalize_text(text: Column) -> Column:
    """Digits and letters in one pass; everything else, blanks and joiners included, stays."""
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS + ARABIC_LETTERS, ASCII_DIGITS * 2 + PERSIAN_LETTERS)


def to_persian_digits(text: Column) -> Column:
    return F.translate(text, ASCII_DIGITS, PERSIAN_DIGITS)


def to_arabic_indic_digits(text: Column) -> Column:
    return F.translate(text, ASCII_DIGITS, ARABIC_DIGITS)


#: Unicode blanks that trimming removes; the zero-width joiners are not among them.
BLANKS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def trimmed_span(text: Column, start: Column, end: Column) -> Column:
    """Struct (start, end) without blanks at either side, or null if nothing is left."""
    part = F.substring(text, start + 1, end - start)
    lead = F.length(part) - F.length(F.regexp_replace(part, f"^{BLANKS}+", ""))
    trail = F.length(part) - F.length(F.regexp_replace(part, f"{BLANKS}+$", ""))
    return F.when(lead < F.length(part), F.struct((start + lead).alias("start"), (end - trail).alias("end")))


def unicode_audit(text: Column) -> Column:
    """Struct of flags: text holds a zero-width non-joiner, an Arabic yeh, an Arabic kaf."""
    return F.struct(text.contains("‌").alias("zwnj"), text.contains("ي").alias("arabic_yeh"), text.contains("ك").alias("arabic_kaf"))
