import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkveil.functions import checks
from sparkveil.operators import bio, detectors, evaluation, names, profiles, records, redaction, sessions, udtf
from sparkveil.operators.detectors import BANK_CARD, EMAIL, MOBILE, NATIONAL_ID, PatternDetector, PatternRule

NID, MOB, CARD = "0000000132", "09120000101", "6037000000000079"


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string").coalesce(1)


def test_detect_defaults_empty_and_null(spark):
    df = texts(spark, f"کد {NID}، {MOB} {CARD}", "", None)
    rows = detectors.detect(df).orderBy("id").collect()
    assert [s.type for s in rows[0].detections] == ["IR_NATIONAL_ID", "IR_MOBILE"]
    assert rows[1].detections == [] and rows[2].detections is None
    assert detectors.detect(df, detectors=[]).orderBy("id").collect()[0].detections == []
    with pytest.raises(TypeError):
        detectors.detect(df, "id")


def test_detect_long_searches_once(spark):
    plan = detectors.detect_long(texts(spark, "x"), ["id"], "text", [BANK_CARD])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Python" not in plan


def test_pattern_rules(spark):
    d = PatternDetector([PatternRule("CASE_NO", r"case (?P<n>\d+)", group="n"), PatternRule("CASE_NO", "[A-Z]{3}")])
    rows = detectors.detect(texts(spark, "case ۱۲ ABC", None, "none"), "text", [d, NATIONAL_ID]).orderBy("id").collect()
    assert [(s.start, s.end, s.value, s.normalized_value) for s in rows[0].detections] == [(5, 7, "۱۲", "12"), (8, 11, "ABC", "ABC")]
    assert rows[1].detections is None and rows[2].detections == []
    for bad in [dict(type="x", pattern="a"), dict(type="X", pattern=""), dict(type="X", pattern="a", source="s"), dict(type="X", pattern="a", group=-1)]:
        with pytest.raises(ValueError):
            PatternRule(**bad)
    for bad in [PatternRule("X", "("), PatternRule("X", "a", group=1), PatternRule("X", "a", group="g")]:
        with pytest.raises(ValueError):
            PatternDetector([bad])
    with pytest.raises(PySparkException):
        detectors.detect(texts(spark, "b"), "text", [PatternDetector([PatternRule("X", "(a)?b", group=1)])]).collect()


def test_redaction_golden(spark):
    fa = NID.translate(str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹"))
    df = texts(spark, f"{NID} و {fa} و {MOB}", "[IR_MOBILE_1] " + MOB, "plain", None, f"{NID}@mail.co")
    out = [r.redacted for r in redaction.redact(df, detectors=[NATIONAL_ID, MOBILE, EMAIL], conflict_policy="longest").orderBy("id").collect()]
    assert out == ["[IR_NATIONAL_ID_1] و [IR_NATIONAL_ID_1] و [IR_MOBILE_1]", "[IR_MOBILE_1] [IR_MOBILE_2]", "plain", None, "[EMAIL_1]"]
    rows = redaction.redact(df, detectors=[NATIONAL_ID, EMAIL], on_error="record").orderBy("id").collect()
    assert rows[4].redacted is None and "Overlapping" in rows[4].error and rows[0].error is None


def turns(spark, *rows):
    return spark.createDataFrame(rows, "session_id string, turn int, text string").repartition(3)


def test_sessions_fold_restore_and_roll_back(spark):
    df = turns(spark, ("a", 1, f"{MOB} x"), ("a", 0, "[IR_MOBILE_1] first"), ("a", 2, f"{MOB} {NID}"), ("b", 0, MOB), ("a", 3, "[IR_MOBILE_2] clash 09120000202"), ("a", 4, "09120000202"), (None, 0, MOB), ("b", 1, None))
    got = {(r.session_id, r.turn): (r.pseudonymized, r.error) for r in sessions.pseudonymize(df, on_error="record").collect()}
    assert got["a", 0] == ("[IR_MOBILE_1] first", None)
    assert got["a", 1] == ("[IR_MOBILE_2] x", None) and got["a", 2] == ("[IR_MOBILE_2] [IR_NATIONAL_ID_1]", None)
    assert got["a", 3][0] is None and "[IR_MOBILE_2]" in got["a", 3][1]
    assert got["a", 4] == ("[IR_MOBILE_3]", None) and got["b", 0] == ("[IR_MOBILE_1]", None) and got[None, 0] == ("[IR_MOBILE_1]", None)
    mapping = sessions.session_mapping(df, on_error="record")
    assert {(r.session_id, r.placeholder, r.value) for r in mapping.collect()} >= {("a", "[IR_MOBILE_2]", MOB), ("b", "[IR_MOBILE_1]", MOB)}
    reply = turns(spark, ("a", 9, "call [IR_MOBILE_2], not [IR_MOBILE_9] or [IR_MOBILE_20]"), ("zz", 1, "[IR_MOBILE_1]"))
    back = {r.session_id: r.restored for r in sessions.restore(reply, mapping).collect()}
    assert back == {"a": f"call {MOB}, not [IR_MOBILE_9] or [IR_MOBILE_20]", "zz": "[IR_MOBILE_1]"}
    with pytest.raises(PySparkException):
        sessions.pseudonymize(df).collect()


def test_stream_equals_batch(spark, tmp_path):
    from sparkveil.streaming.sessions import pseudonymize_stream

    for i, rows in enumerate([[("a", 1, MOB), ("a", 0, NID), ("b", 0, MOB)], [("a", 2, f"{NID} {MOB} 09120000202"), ("b", 1, "09120000202")]]):
        spark.createDataFrame(rows, "session_id string, turn int, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("session_id string, turn int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = pseudonymize_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    stream = {(r.session_id, r.turn): r.pseudonymized for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.session_id, r.turn): r.pseudonymized for r in sessions.pseudonymize(spark.read.parquet(str(tmp_path / "in/*"))).collect()}
    assert stream == batch and len(batch) == 5


def test_records(spark):
    df = spark.createDataFrame([(1, f"نمبر {NID}", (f"{MOB} {NID}", 3), ["x"]), (2, None, ("[IR_MOBILE_1]", 4), [])], "id int, note string, meta struct<contact:string,n:int>, tags array<string>")
    out = records.redact_fields(df, ["meta.contact", "note"]).orderBy("id").collect()
    assert out[0].note == "نمبر [IR_NATIONAL_ID_1]" and out[0].meta.contact == "[IR_MOBILE_1] [IR_NATIONAL_ID_1]" and out[0].meta.n == 3 and out[0].tags == ["x"]
    assert out[1].note is None and out[1].meta.contact == "[IR_MOBILE_1]"
    clash = spark.createDataFrame([(NID, "[IR_NATIONAL_ID_1]")], "a string, b string")
    with pytest.raises(PySparkException):
        records.redact_fields(clash, ["a", "b"]).collect()
    assert records.redact_fields(clash, ["b", "a"]).first().a == "[IR_NATIONAL_ID_2]"
    assert {(r.path, r.total_detections) for r in records.report_fields(df.where("id = 1"), ["id"], ["note", "meta.contact"]).collect()} == {("note", 1), ("meta.contact", 2)}
    for fields, error in [("note", TypeError), ([], ValueError), (["note", "note"], ValueError), (["meta..n"], ValueError), (["nope"], KeyError), (["id"], TypeError), (["note.x"], TypeError), ([3], TypeError)]:
        with pytest.raises(error):
            records.detect_fields(df, ["id"], fields)


def test_profiles(spark):
    p = profiles.clinical_profile("referral_letter", [PatternRule("CASE_NO", "C-[0-9]+")], include_bank_card=True, conflict_policy="priority", type_priority=["EMAIL", "IR_NATIONAL_ID"])
    assert p.redact(texts(spark, f"C-12 {NID}@mail.co {CARD}")).first().redacted == "[CASE_NO_1] [EMAIL_1] [BANK_CARD_1]"
    assert p.report(texts(spark, CARD)).first().report.counts == {"BANK_CARD": 1}
    for kw, error in [(dict(template="x"), ValueError), (dict(template=1), TypeError), (dict(template="outpatient_note", include_email=1), TypeError), (dict(template="outpatient_note", institutional_rules="x"), TypeError), (dict(template="outpatient_note", person_detector=3), TypeError)]:
        with pytest.raises(error):
            profiles.clinical_profile(**kw)


def spans(spark, *rows):
    return spark.createDataFrame(rows, "doc_id int, start int, end int, type string")


def test_evaluation(spark):
    gold = spans(spark, (1, 0, 5, "A"), (1, 6, 9, "B"), (2, 0, 3, "A"))
    pred = spans(spark, (1, 0, 5, "A"), (1, 0, 5, "A"), (1, 6, 9, "C"), (2, 1, 3, "A"))
    total = {r.type: r for r in evaluation.evaluate_exact(gold, pred).collect()}
    assert (total[None].tp, total[None].fp, total[None].fn) == (1, 3, 2) and total["A"].precision == pytest.approx(1 / 3)
    kinds = sorted(r.kind for r in evaluation.errors(gold, pred).collect())
    assert kinds == ["boundary", "exact", "false_negative", "false_negative", "false_positive", "false_positive", "type_mismatch"]
    with pytest.raises(PySparkException):
        evaluation.evaluate_exact(gold, pred, "reject").collect()
    with pytest.raises(PySparkException):
        evaluation.evaluate_exact(gold.union(gold), pred).collect()
    nothing = evaluation.evaluate_exact(gold.limit(0), pred.limit(0)).where("type is null").first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (1.0, 1.0, 1.0)
    empty = evaluation.latency(spark.createDataFrame([], "seconds double")).first()
    assert (empty.n, empty.mean, empty.p95) == (0, 0.0, 0.0)
    four = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "seconds double")
    assert evaluation.latency(four).first().p95 == pytest.approx(8.95) and evaluation.latency_by_rank(four).first().median == 3.0


def test_merge_of_gold(spark):
    rows = [(1, "GIVENNAME", 0, 3, 50), (1, "SURNAME", 4, 9, 50), (1, "CITY", 8, 12, 50), (1, "CITY", 12, 15, 50), (1, "X", 40, 60, 50)]
    df = spark.createDataFrame(rows, "doc_id int, label string, start int, end int, n_chars int")
    out = {(r.start, r.end, r.type) for r in evaluation.merged_gold(df, {"GIVENNAME": "PERSON", "SURNAME": "PERSON", "CITY": "ADDRESS"}).collect()}
    assert out == {(0, 9, "PERSON"), (12, 15, "ADDRESS")}


def test_bio(spark):
    rows = [(1, i, t, g) for i, (t, g) in enumerate([("ab", "I-PER"), ("c", "I_PER"), ("d", "O"), ("e", "B-PER"), ("f", "B-PER"), ("g", "I-LOC"), ("h", "I-Person")])]
    out = [(r.start, r.end, r.recovered) for r in bio.spans_from_tags(spark.createDataFrame(rows, "sent_id int, pos int, token string, tag string")).orderBy("start").collect()]
    assert out == [(0, 4, True), (7, 8, False), (9, 10, False), (13, 14, True)]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("Q-PER",)], "t string").select(bio.parse_label(F.col("t"), strict=True).alias("l")).collect()


def test_name_windows_decode_and_merge():
    assert names.windows(5, 12) == [(0, 5)] and names.windows(12, 10) == [(0, 8), (4, 12)] and names.windows(9, 6) == [(0, 4), (2, 6), (4, 8), (6, 9)]
    with pytest.raises(ValueError):
        names.windows(4, 2)
    plain = names.Labels.of({"0": "O", "1": "B_PER", "2": "I-PERSON"})
    text, at = "ab cd ef", [(0, 2), (3, 5), (6, 8)]
    assert [(c.start, c.end, c.continues, c.reaches_end) for c in names.decode(text, at, [2, 2, 1], plain)] == [(0, 5, True, False), (6, 8, False, True)]
    full = names.Labels.of({0: "O", 1: "B-GIVENNAME", 2: "B-SURNAME", 3: "I-SURNAME", 4: "B-TITLE"}, compose=True)
    assert [(c.start, c.end) for c in names.decode(text, at, [1, 2, 3], full, True)] == [(0, 8)]
    assert [(c.start, c.end) for c in names.decode("ab,cd ef", at, [1, 2, 4], full, True)] == [(0, 2), (3, 5)]
    C = names.Candidate
    assert names.merge([C(0, 5, False, True, 0), C(6, 8, True, False, 1)], text) == [(0, 8)]
    assert names.merge([C(0, 5, False, True, 0), C(6, 8, True, False, 2), C(0, 2, False, False, 1)], text) == [(0, 5), (6, 8)]
    assert names.merge([C(0, 5), C(3, 8)], text) == [(0, 5), (3, 8)] and names.merge([C(0, 2), C(0, 5)], text) == [(0, 5)]
    assert names.merge([], text) == [] and names.merge([C(2, 5), C(0, 8), C(0, 8, window=1)], text) == [(0, 8)]
    cut, rest = C(0, 2, False, True, 0), C(3, 5, True, False, 1)
    assert names.merge([cut, rest], "ab cd") == [(0, 5)] and names.merge([cut, rest], "ab,cd") == [(0, 2), (3, 5)]
    assert names.merge([rest, C(6, 8, True, True, 3), cut, C(3, 5, False, True, 2)], "ab cd ef") == [(0, 8)]
    for bad in [{}, {"x": "B-PER"}, {0: "B-PER"}]:
        with pytest.raises(ValueError):
            names.Labels.of(bad)
    for bad in (0, True, "5"):
        with pytest.raises(ValueError):
            names.check_length(bad)
    with pytest.raises(ValueError):
        names.check_offsets([(0, 0), (4, 5), (2, 3)], 9)


def test_person_detector_in_windows(spark):
    import re

    def load():
        def tokenize(text):
            found = [m.span() for m in re.finditer(r"\w+", text)]
            return [9, *(1 if text[s:e].istitle() else 2 for s, e in found), 9], [(0, 0), *found, (0, 0)]

        return tokenize, lambda ids: [1 if i == 1 else 0 for i in ids], names.Labels.of({0: "O", 1: "B-PER", 2: "I-PER"})

    text = "Ali met Reza and then Sara left"
    rows = detectors.detect(texts(spark, text), "text", [names.PersonDetector(load, 5)]).first()
    assert [s.value for s in rows.detections] == ["Ali", "Reza", "Sara"]


def test_onnx_session_predictor_and_model_files(tmp_path):
    import numpy as np

    class Session:
        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "token_type_ids")]

        def run(self, _, feed):
            assert set(feed) == {"input_ids", "token_type_ids"}
            return [np.eye(4)[feed["input_ids"]]]

    assert names.session_predictor(Session())([3, 0, 2]) == [3, 0, 2]
    for make, error in [(lambda: None, FileNotFoundError), (lambda: [(tmp_path / f"{x}.onnx").touch() for x in "ab"], ValueError)]:
        make()
        with pytest.raises(error):
            names.model_file(str(tmp_path))
    (tmp_path / "model.onnx").touch()
    assert names.model_file(str(tmp_path)).name == "model.onnx"


def test_sql_and_table_function(spark):
    udtf.register_sql(spark)
    assert spark.sql(f"SELECT is_valid_bank_card('{CARD}'), is_valid_national_id('{NID}'), is_valid_iban('IR00'), pii_normalize('۱ك')").first()[:] == (True, True, False, "1ک")
    assert udtf.rewritten(r"(?P<n>\w+)\d") == r"(?<n>[\p{L}\p{N}_]+)\p{Nd}" and udtf.rewritten(r"\bx") is None


def test_json_forms(spark):
    from sparkveil.functions import reports

    d = detectors.detections(F.col("text"), [NATIONAL_ID, MOBILE])
    r = texts(spark, f"{NID} {MOB}", "").select("id", reports.spans_json(d).alias("j"), reports.spans_json_indented(d).alias("i")).orderBy("id").collect()
    plain = [{"type": "IR_NATIONAL_ID", "start": 0, "end": 10}, {"type": "IR_MOBILE", "start": 11, "end": 22}]
    assert json.loads(r[0].j) == plain and r[0].i == json.dumps(plain, indent=2) + "\n" and r[1].i == "[]\n"


def test_email_of_a_very_long_text(spark):
    """A run of a million dots neither overflows the stack nor hides the address behind it."""
    texts = {1: "a." * 500_000 + "a@x.com", 2: "a." * 500_000 + "a@" + "b." * 500_000 + "com x@mail.com", 3: "m@b.com.x_ n@c-.com o@d.e-f.org- (p@q.rs)", 4: "." + "z@y.xw " + "é" + "u@v.wx q@w.ér", 5: "@" * 300_000}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {(r.id, r.value) for r in detectors.detect_long(df, ["id"], "text", [detectors.EMAIL]).collect()}
    assert got == {(2, "x@mail.com"), (3, "m@b.com"), (3, "p@q.rs")}
    assert [r.ok for r in df.orderBy("id").select(checks.is_valid_email(F.col("text")).alias("ok")).collect()] == [False] * 5


def test_sql_functions_take_no_line_break(spark):
    from sparkveil.operators import udtf

    udtf.register_sql(spark)
    good = {"is_valid_national_id": "0013542419", "is_valid_mobile": "09123456789", "is_valid_email": "a.b@mail.example", "is_valid_bank_card": "6037997551234566"}
    for name, value in good.items():
        column = {"is_valid_national_id": checks.is_valid_national_id, "is_valid_mobile": checks.is_valid_mobile_number, "is_valid_email": checks.is_valid_email, "is_valid_bank_card": checks.is_valid_bank_card_number}[name]
        for v in (value, value + "\n", "", None, "x", value[:-1] + "0"):
            df = spark.createDataFrame([(v,)], "v string")
            df.createOrReplaceTempView("one_value")
            assert spark.sql(f"SELECT {name}(v) AS ok FROM one_value").first().ok == df.select(column(F.col("v")).alias("ok")).first().ok, (name, v)
            assert v != value + "\n" or not df.select(column(F.col("v")).alias("ok")).first().ok
    legal = spark.createDataFrame([(f"{n:011d}",) for n in range(10380284790, 10380284800)], "v string")
    legal.createOrReplaceTempView("legal_values")
    assert [r.ok for r in spark.sql("SELECT is_valid_legal_id(v) AS ok FROM legal_values").collect()] == [r.ok for r in legal.select(checks.is_valid_iranian_legal_entity_id(F.col("v")).alias("ok")).collect()]
