"""SQL exposure: scalar functions registered on a session, and a table function for Python detectors."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.checks import EMAIL_SHAPE, LEGAL_WEIGHTS, MOBILE_PREFIXES


def register_sql(spark: SparkSession) -> list[str]:
    """Temporary SQL functions over native expressions where SQL can hold them: pii_normalize and is_valid_*.

    They are defined in SQL, so Catalyst inlines them; no Python runs.
    """
    digits = "".join(chr(b + i) for b in (0x06F0, 0x0660) for i in range(10))
    n = f"translate(v, '{digits}', '01234567890123456789')"
    d = lambda i: f"CAST(substring({n}, {i + 1}, 1) AS INT)"
    nid = " + ".join(f"{d(i)} * {10 - i}" for i in range(9))
    defs = {
        "pii_normalize": ("STRING", f"translate(v, '{digits}\u064a\u0643', '01234567890123456789\u06cc\u06a9')"),
        "is_valid_bank_card": ("BOOLEAN", f"coalesce({n} RLIKE '^[0-9]{{16}}\\\\z' AND NOT {n} RLIKE '^(.)\\\\1*\\\\z' AND luhn_check({n}), false)"),
        "is_valid_iban": ("BOOLEAN", f"coalesce(CASE WHEN {n} RLIKE '^IR[0-9]{{24}}\\\\z' THEN CAST(concat(substring({n}, 5, 22), '1827', substring({n}, 3, 2)) AS DECIMAL(38,0)) % 97 = 1 END, false)"),
        "is_valid_national_id": ("BOOLEAN", f"coalesce(CASE WHEN {n} RLIKE '^[0-9]{{10}}\\\\z' AND NOT {n} RLIKE '^(.)\\\\1*\\\\z' THEN {d(9)} = CASE WHEN ({nid}) % 11 < 2 THEN ({nid}) % 11 ELSE 11 - ({nid}) % 11 END END, false)"),
    }
    legal = " + ".join(f"({d(i)} + {d(9)} + 2) * {w}" for i, w in enumerate(LEGAL_WEIGHTS))
    shape = EMAIL_SHAPE.replace("\\", "\\\\").replace("'", "\\'")
    defs |= {
        "is_valid_mobile": ("BOOLEAN", f"coalesce({n} RLIKE '^(?:\\\\+98|0098|0)(?=(?:{'|'.join(MOBILE_PREFIXES)}))[0-9]{{10}}\\\\z', false)"),
        "is_valid_legal_id": ("BOOLEAN", f"coalesce(CASE WHEN {n} RLIKE '^[0-9]{{11}}\\\\z' AND NOT {n} RLIKE '^(.)\\\\1*\\\\z' THEN {d(10)} = ({legal}) % 11 % 10 END, false)"),
        "is_valid_email": ("BOOLEAN", f"coalesce(CASE WHEN length(v) <= 254 AND length(substring_index(v, '@', 1)) <= 64 AND length(substring_index(v, '@', -1)) <= 253 THEN v RLIKE '{shape}' END, false)"),
    }
    for name, (kind, body) in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {kind} RETURN {body}")
    return list(defs)


def register_table_function(spark: SparkSession, name: str, detector) -> None:
    """``SELECT t.id, d.* FROM t, LATERAL name(t.text) d`` for any object with ``detect(original, normalized)``."""
    from ..functions.normalize import ARABIC_DIGITS, ARABIC_LETTERS, ASCII_DIGITS, PERSIAN_DIGITS, PERSIAN_LETTERS

    table = str.maketrans(PERSIAN_DIGITS + ARABIC_DIGITS + ARABIC_LETTERS, ASCII_DIGITS * 2 + PERSIAN_LETTERS)

    @udtf(returnType="type string, start int, end int, value string, normalized_value string")
    class Detect:
        def eval(self, text: str):
            if text is None:
                return
            norm = text.translate(table)
            for x in detector.detect(text, norm):
                kind, s, e = x if isinstance(x, tuple) else (x.type, x.start, x.end)
                yield kind, s, e, text[s:e], norm[s:e]

    spark.udtf.register(name, Detect)



def rewritten(pattern: str) -> str | None:
    """A Python pattern of a safe subset as Java's, or None: word and digit classes, named groups; nothing else differs."""
    import re

    if re.search(r"\\[bBsSWDAZ]|\(\?[aiLmsux(P=<]", re.sub(r"\(\?P<\w+>|\(\?<[=!]", "(", pattern)):
        return None
    return re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", r"\p{Nd}"))


