import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkveil.functions import checks, conflicts, normalize, reports
from sparkveil.functions.spans import find_spans
from sparkveil.operators import detectors as D

TABLE = str.maketrans("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "0123456789" * 2)


def nid_ok(s):
    s = s.translate(TABLE)
    if not re.fullmatch("[0-9]{10}", s) or len(set(s)) == 1:
        return False
    r = sum(int(c) * (10 - i) for i, c in enumerate(s[:9])) % 11
    return int(s[9]) == (r if r < 2 else 11 - r)


def luhn_ok(s):
    s = s.translate(TABLE)
    if not re.fullmatch("[0-9]{16}", s) or len(set(s)) == 1:
        return False
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(s)) % 10 == 0


def iban_ok(s):
    s = s.translate(TABLE)
    return bool(re.fullmatch("IR[0-9]{24}", s)) and int(s[4:] + "1827" + s[2:4]) % 97 == 1


def legal_ok(s):
    s = s.translate(TABLE)
    if not re.fullmatch("[0-9]{11}", s) or len(set(s)) == 1:
        return False
    d = [int(c) for c in s]
    r = sum((d[i] + d[9] + 2) * checks.LEGAL_WEIGHTS[i] for i in range(10)) % 11
    return d[10] == r % 10


def mobile_ok(s):
    m = re.fullmatch(r"(?:\+98|0098|0)([0-9]{10})", s.translate(TABLE))
    return bool(m) and m[1].startswith(checks.MOBILE_PREFIXES)


def email_ok(s):
    if len(s) > 254 or s.count("@") != 1:
        return False
    local, domain = s.split("@")
    atom = r"[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~]+"
    labels = domain.split(".")
    if not 1 <= len(local) <= 64 or len(domain) > 253 or len(labels) < 2 or not re.fullmatch(rf"{atom}(\.{atom})*", local):
        return False
    if any(not re.fullmatch(r"(?!-)[A-Za-z0-9-]{1,63}(?<!-)", x) for x in labels):
        return False
    return bool(re.fullmatch("[A-Za-z]{2,63}", labels[-1]) or re.fullmatch("xn--[A-Za-z0-9-]{1,59}", labels[-1]))


def candidates():
    rnd = random.Random(3)
    out = ["", "0" * 10, "1" * 16, "0" * 11, "0499370899", "04993708990", "+989123456789", "00989123456789", "0912345678", "09400000000", "09950000000", "09951012345", "9123456789"]
    for _ in range(400):
        n = rnd.choice([10, 11, 16])
        s = "".join(rnd.choice("0123456789") for _ in range(n))
        out += [s, "09" + s[:9], "+989" + s[:9], "IR" + (s * 3)[:24], s.translate(str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹"))]
    for k in range(60):
        body = f"{k * 7919 % 10**9:09d}"
        out += [body + str(c) for c in range(10)] + [f"10{body[:8]}{c}" for c in range(10)] + [f"6037{body}12{c}" for c in range(10)]
        bban = f"{k + 100}{k:019d}"
        out.append(f"IR{98 - int(bban + '182700') % 97:02d}{bban}")
    out += ["a@b.co", "a.b@c.d.org", ".a@b.co", "a.@b.co", "a..b@c.co", "a@b", "a@-b.co", "a@b-.co", "a@b.c", "a@b.c1", "a@b.xn--p1ai", "a@b.xn--", "a@b.xn--a-", "ä@b.co", "x" * 64 + "@b.co", "x" * 65 + "@b.co"]
    out += ["a@" + "b" * 63 + ".co", "a@" + "b" * 64 + ".co", "a@b.co\n", "a@@b.co", "a@" + ".".join(["b" * 60] * 4) + ".co", "a@" + ".".join(["b" * 62] * 4) + ".co", "۱@b.co"]
    return out


@pytest.mark.parametrize(
    ("check", "truth"),
    [(checks.is_valid_national_id, nid_ok), (checks.is_valid_bank_card_number, luhn_ok), (checks.is_valid_iranian_iban, iban_ok), (checks.is_valid_iranian_legal_entity_id, legal_ok), (checks.is_valid_mobile_number, mobile_ok), (checks.is_valid_email, email_ok)],
)
def test_validators_agree_with_plain_python(spark, check, truth):
    rows = candidates()
    df = spark.createDataFrame([(x,) for x in [*rows, None]], "v string").select("v", check(F.col("v")).alias("ok"))
    wrong = [r.v for r in df.collect() if r.ok != (r.v is not None and truth(r.v))]
    assert not wrong
    assert any(truth(x) for x in rows)


def test_normalisation_keeps_length(spark):
    text = "كتاب ي‌ ۱۲٣ é😀"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(normalize.normalize_text(F.col("t")).alias("n"), normalize.normalize_letters(F.col("t")).alias("l"), normalize.normalize_digits(F.col("t")).alias("d")).collect()
    assert row[0].n == "کتاب ی‌ 123 é😀" and len(row[0].n) == len(text)
    assert row[0].l == "کتاب ی‌ ۱۲٣ é😀" and row[0].d == "كتاب ي‌ 123 é😀"
    assert row[1].n is None


def test_find_spans_equals_finditer(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab1 😀é") for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", find_spans(F.col("t"), F.col("t"), "(?:ab|[0-9])+", "X").alias("s")).collect()
    for r in got:
        assert [(s.start, s.end, s.value) for s in r.s] == [(*m.span(), m[0]) for m in re.finditer("(?:ab|[0-9])+", r.t)]


BOUNDS = ["", " ", "ا", "_", "‌", "ً", "²", "😀", ".", "+", "-", "x", "5"]


@pytest.mark.parametrize(
    ("detector", "value", "pattern", "original"),
    [
        (D.BANK_CARD, "6037000000000079", r"(?<!\w)[0-9]{16}(?!\w)", False), (D.NATIONAL_ID, "0000000132", r"(?<![0-9])[0-9]{10}(?![0-9])", False), (D.MOBILE, "09120000101", r"(?<![0-9+])0[0-9]{10}(?![0-9])", False),
        (D.IBAN, "IR301000000000000000000000", r"(?<!\w)IR[0-9]{24}(?!\w)", False), (D.EMAIL, "a.b@c.co", r"(?<![\w!#$%&'*+\-/=?^`{|}~.])a\.b@c\.co(?![\w-])", True),
    ],
)
def test_boundaries_as_in_python(spark, detector, value, pattern, original):
    texts = [a + value + b for a in BOUNDS for b in BOUNDS]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in D.detect(df, "text", [detector]).collect():
        whole = any(m[0] == value for m in re.finditer(pattern, r.text.translate(TABLE)))
        if detector is D.EMAIL and re.search(r"co[.\-x5]", r.text):
            continue  # the address itself grows
        assert any(s.value == value for s in r.detections) == whole, r.text


def brute(spans, policy, rank):
    cross = lambda a, b: a[1] < b[2] and b[1] < a[2]
    if policy == "reject":
        return None if any(cross(a, b) for i, a in enumerate(spans) for b in spans[i + 1 :]) else sorted(spans, key=lambda x: (x[1], x[2], x[0]))
    if policy == "priority" and any(a[0] not in rank and any(i != j and cross(a, b) for j, b in enumerate(spans)) for i, a in enumerate(spans)):
        return None
    key = (lambda x: x[1] - x[2]) if policy == "longest" else lambda x: (rank.index(x[0]) if x[0] in rank else 99, x[1] - x[2])
    left, out = list(dict.fromkeys(spans)), []
    while left:
        top = [x for x in left if key(x) == min(map(key, left))]
        if any(cross(a, b) for i, a in enumerate(top) for b in top[i + 1 :]):
            return None
        out += top
        left = [x for x in left if not any(cross(x, t) for t in top)]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


@pytest.mark.parametrize("policy", conflicts.POLICIES)
def test_conflict_policies_against_brute_force(spark, policy):
    rnd = random.Random(policy)
    cases = []
    for _ in range(250):
        spans = []
        for _ in range(rnd.randint(0, 6)):
            s = rnd.randint(0, 14)
            spans.append((rnd.choice("ABC"), s, s + rnd.randint(1, 5)))
        cases.append(spans)
    rows = [(i, [(t, s, e, "v", "v") for t, s, e in c]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, d array<struct<type:string,start:int,end:int,value:string,normalized_value:string>>")
    rank = ["B", "A"]
    got = df.select("id", conflicts.resolution(F.col("d"), policy, rank if policy == "priority" else None).alias("r"), reports.report(F.col("d")).alias("rep"), reports.report_is_consistent(reports.report(F.col("d"))).alias("fine")).collect()
    for r in got:
        want = brute(cases[r.id], policy, rank)
        assert (r.r.error is not None) == (want is None), cases[r.id]
        if want is not None:
            assert [(s.type, s.start, s.end) for s in r.r.spans] == want
        c = cases[r.id]
        pairs = [(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if c[i][1] < c[j][2] and c[j][1] < c[i][2]]
        assert (r.rep.total_detections, r.rep.conflict_pairs, r.rep.conflicting_detections) == (len(c), len(pairs), len({x for p in pairs for x in p}))
        assert r.rep.duplicate_groups == sum(c.count(x) > 1 for x in set(c)) and r.fine


def test_policy_arguments():
    for policy, priority, error in [("best", None, ValueError), (3, None, TypeError), ("priority", None, ValueError), ("priority", "AB", TypeError), ("priority", [], ValueError), ("priority", ["A", "A"], ValueError), ("longest", ["A"], ValueError), ("priority", [1], TypeError)]:
        with pytest.raises(error):
            conflicts.check_policy(policy, priority)


def test_reject_raises_without_text(spark):
    df = spark.createDataFrame([("0000000132@mail.co",)], "text string").select(conflicts.resolve(D.detections(F.col("text"), [D.NATIONAL_ID, D.EMAIL])).alias("x"))
    with pytest.raises(PySparkException) as e:
        df.collect()
    assert "0000000132" not in str(e.value).split("SQLSTATE")[0] and "IR_NATIONAL_ID" in str(e.value)
