"""One query per operator. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, conflicts, normalize, reports
from ..operators import bio, detectors, evaluation, names, profiles, records, redaction, sessions, udtf
from ..streaming.sessions import pseudonymize_stream
from . import synth

ALL = (*detectors.DEFAULTS, detectors.EMAIL, detectors.BANK_CARD, detectors.LEGAL_ENTITY_ID)
#: Without the legal-entity id, whose eleven digits a mobile number can equal: a tie that no length settles.
FIVE = ALL[:5]
DOC = (detectors.EMAIL, detectors.BANK_CARD)
TAXONOMY = {"GIVENNAME": "PERSON", "SURNAME": "PERSON", "CITY": "ADDRESS", "STREET": "ADDRESS"}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def _table(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`"


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def notes(spark, sf_dir):
    return spark.sql(synth.notes(_table(sf_dir, "customer"), "c_custkey"))


def identifiers(spark, sf_dir):
    return spark.sql(synth.identifiers(_table(sf_dir, "customer"), "c_custkey"))


def turns(spark, sf_dir):
    return spark.sql(synth.turns(_table(sf_dir, "conversations")))


# Normalisation


@query
def normalize_digits(spark, sf_dir):
    return notes(spark, sf_dir).select("id", normalize.normalize_digits(F.col("text")).alias("norm"))


@query
def normalize_letters(spark, sf_dir):
    text = F.translate("text", "یک", "يك")
    return notes(spark, sf_dir).select("id", normalize.normalize_letters(text).alias("norm"))


@query
def normalize_text(spark, sf_dir):
    norm = normalize.normalize_text(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.sha2(norm, 256).alias("norm_sha256"), F.length(norm).cast("long").alias("n_chars"))


@query
def to_scripts(spark, sf_dir):
    c = F.col("card")
    return identifiers(spark, sf_dir).select("k", normalize.to_persian_digits(c).alias("persian"), normalize.to_arabic_indic_digits(c).alias("arabic"))


@query
def trim_spans(spark, sf_dir):
    part = F.concat(F.lit(" \t"), "text", F.lit(" \n"))
    t = docs(spark, sf_dir).select("doc_id", part.alias("t")).withColumn("s", normalize.trimmed_span(F.col("t"), F.lit(0), F.length("t")))
    return t.where("s is not null").select("doc_id", F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"))


@query
def unicode_audit(spark, sf_dir):
    flags = notes(spark, sf_dir).select(normalize.unicode_audit(F.concat("text", F.when(F.col("id") % 3 == 0, "‌ي").otherwise(""))).alias("f"))
    return flags.agg(*[F.count_if(F.col(f"f.{c}")).alias(c) for c in ("zwnj", "arabic_yeh", "arabic_kaf")])


# Validators


def _valid(column, check):
    def run(spark, sf_dir):
        v = F.col(column)
        return identifiers(spark, sf_dir).select("k", v.alias("v"), check(v).alias("ok"))

    return run


valid_national_id = _QUERIES["valid_national_id"] = _valid("nid", checks.is_valid_national_id)
valid_mobile = _QUERIES["valid_mobile"] = _valid("mobile", checks.is_valid_mobile_number)
valid_iban = _QUERIES["valid_iban"] = _valid("iban", checks.is_valid_iranian_iban)
valid_card = _QUERIES["valid_card"] = _valid("card", checks.is_valid_bank_card_number)
valid_legal_id = _QUERIES["valid_legal_id"] = _valid("legal", checks.is_valid_iranian_legal_entity_id)
valid_email = _QUERIES["valid_email"] = _valid("email", checks.is_valid_email)


@query
def legal_id_variants(spark, sf_dir):
    return identifiers(spark, sf_dir).select("k", *[checks.is_valid_iranian_legal_entity_id(F.col("legal"), v).alias(f"variant_{v.lower()}") for v in "ABCD"])


@query
def synth_identifiers(spark, sf_dir):
    return identifiers(spark, sf_dir)


@query
def sql_functions(spark, sf_dir):
    udtf.register_sql(spark)
    identifiers(spark, sf_dir).createOrReplaceTempView("_sql_identifiers")
    return spark.sql("SELECT k, pii_normalize(iban) AS iban, is_valid_bank_card(card) AS card_ok, is_valid_iban(iban) AS iban_ok, is_valid_national_id(nid) AS nid_ok FROM _sql_identifiers")


# Detection


def _long(df):
    return df.select(df.columns[0], "type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "value", "normalized_value")


def _detect(detector, source, key):
    def run(spark, sf_dir):
        return _long(detectors.detect_long(source(spark, sf_dir), [key], "text", [detector]))

    return run


for _name, _d in {"national_id": detectors.NATIONAL_ID, "mobile": detectors.MOBILE, "iban": detectors.IBAN, "legal_id": detectors.LEGAL_ENTITY_ID, "email_notes": detectors.EMAIL, "card_notes": detectors.BANK_CARD}.items():
    _QUERIES[f"detect_{_name}"] = _detect(_d, notes, "id")
for _name, _d in {"email": detectors.EMAIL, "bank_card": detectors.BANK_CARD}.items():
    _QUERIES[f"detect_{_name}"] = _detect(_d, docs, "doc_id")


@query
def detect_all_long(spark, sf_dir):
    return _long(detectors.detect_long(notes(spark, sf_dir), ["id"], "text", ALL))


@query
def detect_default(spark, sf_dir):
    return _long(detectors.detect_long(notes(spark, sf_dir), ["id"]))


@query
def detect_pattern_rules(spark, sf_dir):
    rules = [detectors.PatternRule("CUSTOMER_NO", r"Customer#(?P<no>[0-9]{9})", group="no"), detectors.PatternRule("NOTE_END", "پایان$", source="original")]
    return _long(detectors.detect_long(notes(spark, sf_dir), ["id"], "text", [detectors.PatternDetector(rules)]))


@query
def detect_table_function(spark, sf_dir):
    udtf.register_table_function(spark, "detect_customer_no", detectors.PatternDetector([detectors.PatternRule("CUSTOMER_NO", "Customer#[0-9]{9}")]))
    notes(spark, sf_dir).createOrReplaceTempView("_udtf_notes")
    return spark.sql("SELECT n.id, d.type, CAST(d.start AS BIGINT) AS span_start, CAST(d.end AS BIGINT) AS span_end, d.value FROM _udtf_notes n, LATERAL detect_customer_no(n.text) d")


@query
def detect_per_type_counts(spark, sf_dir):
    return detectors.detect_long(notes(spark, sf_dir), ["id"], "text", ALL).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("notes"))


@query
def person_windows(spark, sf_dir):
    def load():
        import re

        def tokenize(text):
            found = [m.span() for m in re.finditer(r"\w+", text)]
            words = [text[s:e].lower() for s, e in found]
            return [0, *(1 if w == "the" else 2 for w in words), 0], [(0, 0), *found, (0, 0)]

        return tokenize, lambda ids: [1 if i == 1 else 0 for i in ids], names.Labels.of({0: "O", 1: "B-PER", 2: "I-PER"})

    found = detectors.detect_long(docs(spark, sf_dir), ["doc_id"], "text", [names.PersonDetector(load, 512)])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("start").cast("long")).alias("starts"))


# Conflicts, redaction, sessions


@query
def conflict_pairs(spark, sf_dir):
    rows = notes(spark, sf_dir).select("id", detectors.detections(F.col("text"), ALL).alias("d"))
    rows = rows.select("id", "d", F.explode(conflicts.conflict_pairs(F.col("d"))).alias("p"))
    a, b = F.get("d", F.col("p.i")), F.get("d", F.col("p.j"))
    return rows.select("id", a["type"].alias("type_a"), a["start"].cast("long").alias("start_a"), b["type"].alias("type_b"), b["start"].cast("long").alias("start_b"))


def _resolved(policy, priority=None):
    def run(spark, sf_dir):
        found = conflicts.resolve(detectors.detections(F.col("text"), ALL if priority else FIVE), policy, priority)
        return _long(notes(spark, sf_dir).select("id", F.inline(found)))

    return run


PRIORITY = ("IR_NATIONAL_ID", "EMAIL", "IR_MOBILE", "IR_LEGAL_ENTITY_ID", "BANK_CARD", "IR_IBAN")
resolve_longest = _QUERIES["resolve_longest"] = _resolved("longest")
resolve_priority = _QUERIES["resolve_priority"] = _resolved("priority", PRIORITY)


@query
def redact_documents(spark, sf_dir):
    out = redaction.redact(docs(spark, sf_dir), "text", DOC, "longest")
    return out.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), F.length("redacted").cast("long").alias("n_chars"))


@query
def redact_notes(spark, sf_dir):
    return redaction.redact(notes(spark, sf_dir), "text", FIVE, "longest").select("id", "redacted")


@query
def redact_cross_script(spark, sf_dir):
    twice = notes(spark, sf_dir).select("id", F.concat("text", F.lit(" | "), normalize.to_persian_digits(F.col("text"))).alias("text"))
    return redaction.redact(twice, "text", [detectors.NATIONAL_ID]).select("id", "redacted")


@query
def redact_literal_collision(spark, sf_dir):
    marked = notes(spark, sf_dir).select("id", F.concat(F.lit("[IR_MOBILE_1] "), "text").alias("text"))
    return redaction.redact(marked, "text", [detectors.MOBILE]).select("id", "redacted")


@query
def redact_reject_errors(spark, sf_dir):
    return redaction.redact(notes(spark, sf_dir), "text", ALL, on_error="record").select("id", F.col("error").isNotNull().alias("failed"), F.col("redacted").isNull().alias("empty"))


@query
def session_pseudonymize(spark, sf_dir):
    return sessions.pseudonymize(turns(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "pseudonymized")


@query
def session_mapping(spark, sf_dir):
    return sessions.session_mapping(turns(spark, sf_dir), "conv_id", "turn")


@query
def session_restore(spark, sf_dir):
    t = turns(spark, sf_dir)
    done = sessions.pseudonymize(t, "conv_id", "turn").select("conv_id", "turn", F.col("pseudonymized").alias("text"))
    return sessions.restore(done, sessions.session_mapping(t, "conv_id", "turn"), "conv_id").select("conv_id", "turn", "restored")


@query
def stream_sessions(spark, sf_dir):
    at = f"{(spark.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints/sparkveil').rstrip('/')}/stream-{uuid.uuid4().hex}"
    turns(spark, sf_dir).write.parquet(f"{at}/in")
    source = spark.readStream.schema("conv_id long, turn long, text string").parquet(f"{at}/in")
    done = pseudonymize_stream(source, "conv_id", "turn")
    run = done.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{at}/out").select("conv_id", "turn", "pseudonymized")


# Reports, records, profiles, JSON


@query
def report_documents(spark, sf_dir):
    return redaction.report_column(docs(spark, sf_dir), "text", DOC).select("doc_id", *[F.col(f"report.{c}").cast("long").alias(c) for c in ("total_detections", "distinct_types", "conflict_pairs", "conflicting_detections", "duplicate_groups")])


@query
def report_notes(spark, sf_dir):
    out = redaction.report_column(notes(spark, sf_dir), "text", (*ALL, detectors.NATIONAL_ID))
    r = F.col("report")
    return out.select("id", *[r[c].cast("long").alias(c) for c in ("total_detections", "distinct_types", "conflict_pairs", "conflicting_detections", "duplicate_groups")], r["has_conflicts"].alias("has_conflicts"), reports.report_is_consistent(r).alias("consistent"))


def _records(spark, sf_dir):
    s = lambda c: F.expr(synth.script(c, "k"))
    return identifiers(spark, sf_dir).select(
        F.col("k").alias("id"), F.concat(F.lit("کد "), s("nid")).alias("note"),
        F.struct(F.concat(F.lit("تماس "), s("mobile"), F.lit(" / "), "nid").alias("contact"), F.lit(3).alias("visits")).alias("meta"),
    )


@query
def detect_fields(spark, sf_dir):
    out = records.detect_fields(_records(spark, sf_dir), ["id"], ["note", "meta.contact"])
    return out.select("id", "path", "type", F.col("start").cast("long").alias("span_start"), "normalized_value")


@query
def report_fields(spark, sf_dir):
    return records.report_fields(_records(spark, sf_dir), ["id"], ["note", "meta.contact"]).select("id", "path", F.col("total_detections").cast("long").alias("n"))


@query
def redact_fields(spark, sf_dir):
    out = records.redact_fields(_records(spark, sf_dir), ["meta.contact", "note"])
    return out.select("id", "note", F.col("meta.contact").alias("contact"), F.col("meta.visits").cast("long").alias("visits"))


@query
def profile_outpatient(spark, sf_dir):
    profile = profiles.clinical_profile("outpatient_note", include_bank_card=True, conflict_policy="longest")
    return profile.redact(notes(spark, sf_dir)).select("id", "redacted")


@query
def serialize_detections(spark, sf_dir):
    return notes(spark, sf_dir).select("id", reports.spans_json(detectors.detections(F.col("text"), ALL)).alias("json"))


@query
def serialize_indented(spark, sf_dir):
    return notes(spark, sf_dir).select("id", reports.spans_json_indented(detectors.detections(F.col("text"), [detectors.NATIONAL_ID])).alias("json"))


# Evaluation


def _gold(spark, sf_dir):
    """Planted spans: the six identifiers of each note, with some bounds moved and some types changed."""
    found = detectors.detect_long(notes(spark, sf_dir), ["id"], "text", ALL)
    kind = F.when((F.col("id") % 13 == 0) & (F.col("type") == "BANK_CARD"), "IR_MOBILE").otherwise(F.col("type"))
    moved = F.when((F.col("id") % 9 == 0) & (F.col("type") == "IR_IBAN"), 1).otherwise(0)
    return found.where("NOT (id % 10 = 4 AND type = 'EMAIL')").select(F.col("id").alias("doc_id"), (F.col("start") + moved).cast("int").alias("start"), "end", kind.alias("type"))


def _predicted(spark, sf_dir):
    found = detectors.detect_long(notes(spark, sf_dir), ["id"], "text", ALL).where("NOT (id % 8 = 1 AND type = 'IR_MOBILE')").select(F.col("id").alias("doc_id"), "start", "end", "type")
    times = F.when(F.expr("doc_id % 17 = 0 AND type = 'IR_IBAN'"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return found.select("*", F.explode(times).alias("time")).drop("time")


def _metric_row(df, *keys):
    return df.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def eval_exact(spark, sf_dir):
    return _metric_row(evaluation.evaluate_exact(_gold(spark, sf_dir), _predicted(spark, sf_dir)).na.fill("(all)", ["type"]), "type")


@query
def eval_cases(spark, sf_dir):
    cases = notes(spark, sf_dir).select(F.col("id").alias("doc_id"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("category"))
    return _metric_row(evaluation.evaluate_cases(cases, _gold(spark, sf_dir), _predicted(spark, sf_dir)), "scope", "name", F.col("failed").cast("long").alias("failed"))


@query
def eval_failed_cases(spark, sf_dir):
    return evaluation.failed_cases(_gold(spark, sf_dir), _predicted(spark, sf_dir))


@query
def eval_errors(spark, sf_dir):
    return evaluation.errors(_gold(spark, sf_dir), _predicted(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("docs"))


def _placed(df):
    from pyspark.sql import Window

    return df.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "type")))


@query
def eval_relaxed(spark, sf_dir):
    out = evaluation.relaxed(_placed(_gold(spark, sf_dir)), _placed(_predicted(spark, sf_dir)))
    return out.agg(*[F.sum(c).alias(c) for c in ("gold", "predicted", "matched")])


@query
def eval_predictions(spark, sf_dir):
    d = notes(spark, sf_dir).select(F.col("id").alias("doc_id"), "text")
    out = evaluation.evaluate_predictions(d, _placed(_gold(spark, sf_dir)), _placed(_predicted(spark, sf_dir)))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("true_positives", "false_positives", "false_negatives", "total_gold", "total_predicted", "documents_with_fp", "offset_failures")], "precision", "recall", "entity_leakage_rate", "document_leakage_rate", "doc_fp_rate")


@query
def eval_gate(spark, sf_dir):
    rows = evaluation.evaluate_exact(_gold(spark, sf_dir), _predicted(spark, sf_dir)).na.fill("(all)", ["type"])
    gated = evaluation.gate(rows, {"precision": (">=", 0.95), "recall": (">=", 0.9)})
    return gated.select("type", "passed", evaluation.recommendation(F.col("passed"), "It").alias("text"))


@query
def eval_negatives(spark, sf_dir):
    d = notes(spark, sf_dir).select(F.col("id").alias("doc_id"))
    person = lambda df: df.where("type = 'EMAIL'")
    out = evaluation.negative_documents(d, person(_gold(spark, sf_dir)), person(_predicted(spark, sf_dir)))
    return out.select("negatives", "with_prediction", F.round("fp_rate", 6).alias("fp_rate"))


@query
def eval_deterministic(spark, sf_dir):
    """Three detections of every note, each over other partitions."""

    def run(i):
        dealt = notes(spark, sf_dir).repartition(3 + i, F.xxhash64("id", F.lit(i)))
        return dealt.select(F.col("id").alias("doc_id"), F.lit(i).alias("run"), detectors.detections(F.col("text")).alias("spans"))

    runs = run(0).union(run(1)).union(run(2))
    return evaluation.deterministic(runs).groupBy("same").agg(F.count(F.lit(1)).alias("n"))


@query
def latency_percentiles(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluation.latency(events, "value", by=["event_type"]).select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")])


@query
def latency_ranks(spark, sf_dir):
    return evaluation.latency_by_rank(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")


@query
def error_classes(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("event_id") % 10 == 0, F.col("event_type")).alias("error_class"))
    return evaluation.error_classes(events)


@query
def canonical_merge(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("GIVENNAME", "SURNAME", "CITY", "STREET", "OTHER")])
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("doc_id"), F.get(kinds, F.col("l_linenumber") % 5).alias("label"),
        (F.col("l_linenumber") * 6).cast("int").alias("start"), (F.col("l_linenumber") * 6 + 5 + F.col("l_partkey") % 3).cast("int").alias("end"), F.lit(40).alias("n_chars"),
    )
    return evaluation.merged_gold(items.distinct(), TAXONOMY).select("doc_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "type")


def _tokens(spark, sf_dir, dealt=False):
    """Tokens of whole texts; with ``dealt`` texts go to their place before they are split, so that no exchange of tokens follows."""
    texts = docs(spark, sf_dir).withColumnRenamed("doc_id", "sent_id")
    texts = texts.repartition("sent_id") if dealt else texts
    words = texts.select("sent_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    n = F.length("token") % 5
    tag = F.when(n == 1, "B_PER").when(n == 2, "I-Person").when(n == 3, "B-LOC").otherwise("O")
    return words.withColumn("tag", tag)


@query
def bio_labels(spark, sf_dir):
    labels = _tokens(spark, sf_dir).select(F.explode(F.array("tag", F.lit("b-pers"), F.lit("X"), F.lit(""), F.lit("I"), F.lit("BLOC"), F.lit("Z-PER"))).alias("tag"))
    return labels.select("tag", bio.parse_label(F.col("tag")).alias("l")).select("tag", "l.prefix", "l.type").groupBy("tag", "prefix", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def bio_to_spans(spark, sf_dir):
    return bio.spans_from_tags(_tokens(spark, sf_dir, dealt=True)).select("sent_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "recovered")


@query
def offset_audit(spark, sf_dir):
    at = bio.token_offsets(_tokens(spark, sf_dir, dealt=True)).select(F.col("sent_id").alias("doc_id"), "pos", F.when(F.col("pos") == 0, 0).otherwise(F.col("start")).alias("start"), F.when(F.col("pos") == 0, 0).otherwise(F.col("end")).alias("end"), F.lit(300).alias("n_chars"))
    return bio.offset_audit(at)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
