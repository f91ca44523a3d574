"""Validators: string column to boolean column. Null gives false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import normalize_digits

# Service prefixes of the national mobile numbering plan.
MOBILE_PREFIXES = (
    "900", "901", "902", "903", "904", "905", "91", "920", "921", "922", "923", "93", "990", "991", "992", "993", "994",
    "99510", "99550", "996", "9981", "9982", "99830", "99831", "99832", "99888", "99900", "99901", "99902", "99903", "9991",
    "99921", "99930", "99931", "99932", "99933", "99934", "9995", "99969", "99977", "9998", "9999",
)
# Weights of the first ten digits of a legal-entity id.
LEGAL_WEIGHTS = (29, 27, 23, 19, 17, 29, 27, 23, 19, 17)


def _digit(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1).cast("int")


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _digits(s: Column, n: int) -> Column:
    """n ASCII digits, not all the same."""
    return s.rlike(f"^[0-9]{{{n}}}\\z") & ~s.rlike(r"^(.)\1*\z")


def _guarded(shape: Column, check: Column) -> Column:
    return F.coalesce(F.when(shape, check), F.lit(False))


def is_valid_national_id(value: Column) -> Column:
    """Ten digits in any of three scripts, not all the same, with the weighted check digit modulo 11."""
    s = normalize_digits(value)
    rest = _sum(_digit(s, i) * (10 - i) for i in range(9)) % 11
    return _guarded(_digits(s, 10), _digit(s, 9) == F.when(rest < 2, rest).otherwise(11 - rest))


def is_valid_mobile_number(value: Column) -> Column:
    """09…, +989… or 00989… whose ten national digits begin with a prefix of the plan."""
    s = normalize_digits(value)
    plan = "|".join(MOBILE_PREFIXES)
    return F.coalesce(s.rlike(rf"^(?:\+98|0098|0)(?=(?:{plan}))[0-9]{{10}}\z"), F.lit(False))


def is_valid_iranian_iban(value: Column) -> Column:
    """IR and 24 digits whose rearranged number leaves 1 modulo 97."""
    s = normalize_digits(value)
    number = F.concat(F.substring(s, 5, 22), F.lit("1827"), F.substring(s, 3, 2)).cast("decimal(38,0)")
    return _guarded(s.rlike(r"^IR[0-9]{24}\z"), number % 97 == 1)


def is_valid_bank_card_number(value: Column) -> Column:
    """Sixteen digits, not all the same, with a valid Luhn digit."""
    s = normalize_digits(value)
    return _guarded(_digits(s, 16), F.call_function("luhn_check", s))


def legal_entity_check_digit(s: Column, variant: str = "A") -> Column:
    """Check digit of the first ten digits by one of four published variants; A is the one in force."""
    if variant == "C":
        rest = _sum(_digit(s, i) * (11 - i) for i in range(10)) % 11
        return F.when(rest < 2, rest).otherwise(11 - rest)
    add = {"A": _digit(s, 9) + 2, "B": F.lit(2), "D": F.lit(0)}[variant]
    rest = _sum((_digit(s, i) + add) * w for i, w in enumerate(LEGAL_WEIGHTS)) % 11
    return F.when(rest == 10, 0).otherwise(rest)


def is_valid_iranian_legal_entity_id(value: Column, variant: str = "A") -> Column:
    s = normalize_digits(value)
    return _guarded(_digits(s, 11), _digit(s, 10) == legal_entity_check_digit(s, variant))


# The characters of an unquoted local part, as a class.
ATOM = r"A-Za-z0-9!#$%&'*+\-/=?^_`{|}~"


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_TOP = r"(?:[A-Za-z]{2,63}|xn--(?!-*\z)[A-Za-z0-9-]{0,58}[A-Za-z0-9])"
EMAIL_SHAPE = rf"^[{ATOM}]++(?:\.[{ATOM}]++)*+@(?:{_LABEL}\.)+{_TOP}\z"


def is_valid_email(value: Column) -> Column:
    """ASCII dot-atom of up to 64 characters, a domain of up to 253 with a dot, 254 in all. Nothing is normalised."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    sizes = (F.length(value) <= 254) & (F.length(local) <= 64) & (F.length(domain) <= 253)
    # Sizes first: a long text never meets the pattern.
    return F.coalesce(F.when(sizes, value.rlike(EMAIL_SHAPE)), F.lit(False))
