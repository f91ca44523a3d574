"""Synthetic identifiers from integer keys, as SQL that Spark and DuckDB both run.

The driver's tables hold no Persian text and few identifiers, so queries make theirs from keys: check digits follow
the published formulas, every seventh key gets a wrong one, and digits come in three scripts.
"""

from __future__ import annotations

ASCII = "0123456789"
PERSIAN = "".join(chr(0x06F0 + i) for i in range(10))
ARABIC = "".join(chr(0x0660 + i) for i in range(10))
LEGAL = (29, 27, 23, 19, 17, 29, 27, 23, 19, 17)


def digit(s: str, i: int) -> str:
    return f"CAST(substring({s}, {i + 1}, 1) AS INT)"


def padded(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


def national_id_digit(s: str) -> str:
    r = "((" + " + ".join(f"{digit(s, i)} * {10 - i}" for i in range(9)) + ") % 11)"
    return f"(CASE WHEN {r} < 2 THEN {r} ELSE 11 - {r} END)"


def luhn_digit(s: str) -> str:
    terms = [f"(CASE WHEN {digit(s, i)} > 4 THEN {digit(s, i)} * 2 - 9 ELSE {digit(s, i)} * 2 END)" if i % 2 == 0 else digit(s, i) for i in range(15)]
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


def legal_digit(s: str, add: str | None = None) -> str:
    add = add if add is not None else f"({digit(s, 9)} + 2)"
    r = "((" + " + ".join(f"({digit(s, i)} + {add}) * {w}" for i, w in enumerate(LEGAL)) + ") % 11)"
    return f"(CASE WHEN {r} = 10 THEN 0 ELSE {r} END)"


def iban_digits(bank: str, account: str) -> str:
    """Two check digits of a BBAN of three bank digits and nineteen account digits, both integers."""
    rest = f"((({bank} % 97) * {pow(10, 19, 97)} + {account} % 97) % 97)"
    return f"(98 - ({rest} * {pow(10, 6, 97)} + {182700 % 97}) % 97)"


def script(expr: str, k: str) -> str:
    return f"(CASE {k} % 3 WHEN 0 THEN {expr} WHEN 1 THEN translate({expr}, '{ASCII}', '{PERSIAN}') ELSE translate({expr}, '{ASCII}', '{ARABIC}') END)"


def _spoilt(expr: str, k: str) -> str:
    return f"(({expr} + CASE WHEN {k} % 7 = 3 THEN 1 ELSE 0 END) % 10)"


def identifiers(source: str, key: str) -> str:
    """SELECT of (k, nid, mobile, iban, card, legal, email) for each row of a table with an integer key."""
    return f"""
SELECT k, n9 || CAST({_spoilt(national_id_digit("n9"), "k")} AS STRING) AS nid,
       CASE k % 4 WHEN 0 THEN '0912' WHEN 1 THEN '+98935' WHEN 2 THEN '0098901' ELSE '09' || CASE WHEN k % 8 = 3 THEN '40' ELSE '21' END END || m7 AS mobile,
       'IR' || {padded(f"CASE WHEN k % 7 = 3 THEN 99 ELSE {iban_digits('b3', 'k')} END", 2)} || CAST(b3 AS STRING) || {padded("k", 19)} AS iban,
       c15 || CAST({_spoilt(luhn_digit("c15"), "k")} AS STRING) AS card,
       n10 || CAST({_spoilt(legal_digit("n10"), "k")} AS STRING) AS legal,
       CASE WHEN k % 5 = 0 THEN n9 || CAST({national_id_digit("n9")} AS STRING) ELSE 'user.' || CAST(k AS STRING) END || CASE WHEN k % 11 = 0 THEN '@localhost' ELSE '@mail.example.com' END AS email
FROM (SELECT k, {padded("(k * 104729 + 13) % 1000000000", 9)} AS n9, {padded("(k * 7919 + 101) % 10000000", 7)} AS m7, 100 + (k * 17) % 900 AS b3,
             '6037' || {padded("(k * 1299709 + 7) % 100000000000", 11)} AS c15, {padded("(k * 31337 + 1000000007) % 10000000000", 10)} AS n10
      FROM (SELECT CAST({key} AS BIGINT) AS k FROM {source}))"""


def notes(source: str, key: str) -> str:
    """SELECT of (id, text): a short Persian note with all six identifiers, in one of three scripts by key."""
    s = lambda c: script(c, "k")
    return f"""
SELECT k AS id, 'پرونده Customer#' || {padded("k", 9)} || ' کد ملی ' || {s("nid")} || '، موبایل ' || {s("mobile")} || ' شبا ' || substring(iban, 1, 2) || {s("substring(iban, 3, 24)")}
       || ' کارت ' || {s("card")} || ' شناسه ' || {s("legal")} || ' ایمیل ' || email || ' پایان' AS text
FROM ({identifiers(source, key)})"""


def turns(source: str) -> str:
    """SELECT of (conv_id, turn, text): every turn ends in a mobile number that two turns of the conversation share."""
    number = f"'0912' || {padded('(conv_id * 7919 + turn % 3) % 10000000', 7)}"
    return f"SELECT conv_id, turn, coalesce(text, '') || ' شماره ' || {script(number, 'turn')} AS text FROM {source}"
