"""DuckDB SQL for the queries, written apart from the engine's expressions.

DuckDB's regular expressions have no lookaround, so candidates are found as maximal runs of a character class that
match a shape whole; offsets are sums of the runs and gaps before.
"""

from __future__ import annotations

from ..functions.checks import MOBILE_PREFIXES
from . import synth
from .queries import PRIORITY

FROM = synth.PERSIAN + synth.ARABIC + "يك"
TO = synth.ASCII * 2 + "یک"
WORD = r"\p{L}\p{N}_"
ATOM = r"[A-Za-z0-9!#$%&''*+\-/=?^_`{|}~]+"
LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
ADDRESS = rf"{ATOM}(?:\.{ATOM})*@{LABEL}(?:\.{LABEL})+"
NOTES = synth.notes("customer", "c_custkey")
IDS = synth.identifiers("customer", "c_custkey")
TURNS = synth.turns("conversations")
DOCS = "SELECT doc_id AS id, text FROM documents"


def norm(t: str) -> str:
    return f"translate({t}, '{FROM}', '{TO}')"


def digits(t: str) -> str:
    return f"translate({t}, '{synth.PERSIAN + synth.ARABIC}', '{synth.ASCII * 2}')"


def _shape(v: str, n: int) -> str:
    return f"regexp_full_match({v}, '[0-9]{{{n}}}') AND replace({v}, substring({v}, 1, 1), '') <> ''"


def _guard(shape: str, check: str) -> str:
    return f"coalesce(CASE WHEN {shape} THEN {check} END, false)"


def ok_national_id(v: str) -> str:
    return _guard(_shape(v, 10), f"{synth.digit(v, 9)} = {synth.national_id_digit(v)}")


def ok_mobile(v: str) -> str:
    local = f"regexp_extract({v}, '^(?:\\+98|0098|0)([0-9]{{10}})$', 1)"
    return "coalesce(" + " OR ".join(f"starts_with({local}, '{p}')" for p in MOBILE_PREFIXES) + ", false)"


def ok_iban(v: str) -> str:
    return _guard(f"regexp_full_match({v}, 'IR[0-9]{{24}}')", f"CAST(substring({v}, 5, 22) || '1827' || substring({v}, 3, 2) AS HUGEINT) % 97 = 1")


def ok_card(v: str) -> str:
    total = f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substring({v}, i, 1) AS INT) ELSE (CAST(substring({v}, i, 1) AS INT) * 2) // 10 + (CAST(substring({v}, i, 1) AS INT) * 2) % 10 END))"
    return _guard(_shape(v, 16), f"{total} % 10 = 0")


def ok_legal(v: str, add: str | None = None) -> str:
    return _guard(_shape(v, 11), f"{synth.digit(v, 10)} = {synth.legal_digit(v, add)}")


def ok_legal_c(v: str) -> str:
    r = "((" + " + ".join(f"{synth.digit(v, i)} * {11 - i}" for i in range(10)) + ") % 11)"
    return _guard(_shape(v, 11), f"{synth.digit(v, 10)} = CASE WHEN {r} < 2 THEN {r} ELSE 11 - {r} END")


def ok_email(v: str) -> str:
    parts = f"split_part({v}, '@', 2)"
    labels = f"string_split({parts}, '.')"
    label_ok = f"len(list_filter({labels}, lambda x: NOT (regexp_full_match(x, '[A-Za-z0-9-]{{1,63}}') AND NOT starts_with(x, '-') AND NOT ends_with(x, '-')))) = 0"
    top = f"{labels}[-1]"
    return f"""coalesce(length({v}) <= 254 AND len(string_split({v}, '@')) = 2 AND length(split_part({v}, '@', 1)) <= 64 AND length({parts}) <= 253
      AND regexp_full_match(split_part({v}, '@', 1), '{ATOM}(?:\\.{ATOM})*') AND len({labels}) >= 2 AND {label_ok}
      AND (regexp_full_match({top}, '[A-Za-z]{{2,63}}') OR regexp_full_match({top}, 'xn--[A-Za-z0-9-]{{1,59}}')), false)"""


#: type: (scans the normalised text, class of runs, shape of the run with the span as group 1, check)
KINDS = {
    "IR_NATIONAL_ID": (True, "[0-9]+", "^([0-9]{10})$", ok_national_id),
    "IR_MOBILE": (True, "[0-9+]+", r"^(\+98[0-9]{10}|0098[0-9]{10}|0[0-9]{10})(?:\+|$)", ok_mobile),
    "IR_IBAN": (True, f"[{WORD}]+", "^(IR[0-9]{24})$", ok_iban),
    "BANK_CARD": (True, f"[{WORD}]+", "^([0-9]{16})$", ok_card),
    "IR_LEGAL_ENTITY_ID": (True, "[0-9]+", "^([0-9]{11})$", ok_legal),
}


def _runs(source: str, kind: str) -> str:
    _, runs, shape, check = KINDS[kind]
    return f"""
SELECT id, '{kind}' AS type, s AS span_start, s + length(v) AS span_end, substring(text, s + 1, length(v)) AS value, v AS normalized_value
FROM (SELECT id, text, regexp_extract(run, '{shape}', 1) AS v,
             CAST(sum(length(gap) + length(run)) OVER (PARTITION BY id ORDER BY i) - length(run) AS BIGINT) AS s
      FROM (SELECT id, text, unnest(ms) AS run, unnest(gs[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i
            FROM (SELECT id, text, regexp_extract_all(n, '{runs}') AS ms, string_split_regex(n, '{runs}') AS gs
                  FROM (SELECT id, text, {norm('text')} AS n FROM ({source})) WHERE regexp_matches(n, '[0-9]{{10}}'))))
WHERE v <> '' AND {check('v')}"""


def _emails(source: str) -> str:
    left = r"[^\p{L}\p{N}_!#$%&''*+\-/=?^`{|}~.]"
    whole = f"(^|{left})({ADDRESS})($|[^\\p{{L}}\\p{{N}}_-])"
    return f"""
SELECT id, 'EMAIL' AS type, s AS span_start, s + length(v) AS span_end, v AS value, {norm('v')} AS normalized_value
FROM (SELECT id, v, CAST(sum(length(gap) + length(run)) OVER (PARTITION BY id ORDER BY i) - length(run) + length(before) AS BIGINT) AS s
      FROM (SELECT id, unnest(regexp_extract_all(text, '{whole}')) AS run, unnest(regexp_extract_all(text, '{whole}', 1)) AS before, unnest(regexp_extract_all(text, '{whole}', 2)) AS v,
                   unnest(string_split_regex(text, '{whole}')[1:len(regexp_extract_all(text, '{whole}'))]) AS gap, generate_subscripts(regexp_extract_all(text, '{whole}'), 1) AS i
            FROM ({source}) WHERE strpos(text, '@') > 0))
WHERE {ok_email('v')}"""


def detected(source: str, *kinds: str) -> str:
    return " UNION ALL ".join(f"({_emails(source) if k == 'EMAIL' else _runs(source, k)})" for k in kinds)


ALL = ("IR_NATIONAL_ID", "IR_MOBILE", "IR_IBAN", "EMAIL", "BANK_CARD", "IR_LEGAL_ENTITY_ID")
DEFAULT = ALL[:3]
CROSS = "a.id = b.id AND a.span_start < b.span_end AND b.span_start < a.span_end AND (a.span_start, a.span_end, a.type) <> (b.span_start, b.span_end, b.type)"


def resolved(found: str, by: str) -> str:
    """Survivors where conflicts are pairs: a span goes if one that overlaps it ranks before it."""
    rank = "b.span_end - b.span_start > a.span_end - a.span_start" if by == "longest" else f"list_position({list(PRIORITY)}, b.type) < list_position({list(PRIORITY)}, a.type)"
    return f"SELECT a.* FROM ({found}) a WHERE NOT EXISTS (SELECT 1 FROM ({found}) b WHERE {CROSS} AND {rank})"


def redacted(source: str, spans: str, first: int = 1) -> str:
    """(id, redacted): numbers per type by first appearance, pieces joined in order."""
    return f"""
SELECT t.id, coalesce(string_agg(p.gap || p.label, '' ORDER BY p.span_start) || substring(any_value(t.text), CAST(max(p.span_end) AS BIGINT) + 1), any_value(t.text)) AS redacted
FROM ({source}) t LEFT JOIN (
  SELECT s.id, s.span_start, s.span_end, '[' || s.type || '_' || CAST(n.n AS VARCHAR) || ']' AS label,
         substring(s.text, CAST(lag(s.span_end, 1, 0) OVER (PARTITION BY s.id ORDER BY s.span_start) AS BIGINT) + 1,
                   CAST(s.span_start - lag(s.span_end, 1, 0) OVER (PARTITION BY s.id ORDER BY s.span_start) AS BIGINT)) AS gap
  FROM (SELECT f.*, x.text FROM ({spans}) f JOIN ({source}) x USING (id)) s
  JOIN (SELECT id, type, normalized_value, row_number() OVER (PARTITION BY id, type ORDER BY min(span_start)) + {first - 1} AS n FROM ({spans}) GROUP BY id, type, normalized_value) n
    ON s.id = n.id AND s.type = n.type AND s.normalized_value = n.normalized_value
) p ON t.id = p.id
GROUP BY t.id"""


def _report(found: str, source: str, key: str) -> str:
    return f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY span_start, span_end, type) AS i FROM ({found})),
pairs AS (SELECT a.id, a.i AS i, b.i AS j FROM f a JOIN f b ON a.id = b.id AND a.i < b.i AND a.span_start < b.span_end AND b.span_start < a.span_end),
p AS (SELECT id, count(*) AS n FROM pairs GROUP BY id),
c AS (SELECT id, count(DISTINCT i) AS n FROM (SELECT id, i FROM pairs UNION ALL SELECT id, j FROM pairs) GROUP BY id),
d AS (SELECT id, count(*) AS n FROM (SELECT id FROM f GROUP BY id, type, span_start, span_end, value, normalized_value HAVING count(*) > 1) GROUP BY id),
t AS (SELECT id, count(*) AS n, count(DISTINCT type) AS k FROM f GROUP BY id)
SELECT s.id AS {key}, coalesce(t.n, 0) AS total_detections, coalesce(t.k, 0) AS distinct_types, coalesce(p.n, 0) AS conflict_pairs, coalesce(c.n, 0) AS conflicting_detections, coalesce(d.n, 0) AS duplicate_groups
FROM ({source}) s LEFT JOIN t ON s.id = t.id LEFT JOIN p ON s.id = p.id LEFT JOIN c ON s.id = c.id LEFT JOIN d ON s.id = d.id"""


GOLD = f"""SELECT id AS doc_id, span_start + CASE WHEN id % 9 = 0 AND type = 'IR_IBAN' THEN 1 ELSE 0 END AS s, span_end AS e,
  CASE WHEN id % 13 = 0 AND type = 'BANK_CARD' THEN 'IR_MOBILE' ELSE type END AS type FROM ({detected(NOTES, *ALL)}) WHERE NOT (id % 10 = 4 AND type = 'EMAIL')"""
_PRED = f"SELECT id AS doc_id, span_start AS s, span_end AS e, type FROM ({detected(NOTES, *ALL)}) WHERE NOT (id % 8 = 1 AND type = 'IR_MOBILE')"
PRED = f"SELECT * FROM ({_PRED}) UNION ALL SELECT * FROM ({_PRED}) WHERE doc_id % 17 = 0 AND type = 'IR_IBAN'"
WITH_EVAL = f"""WITH gold AS MATERIALIZED ({GOLD}), pred AS MATERIALIZED ({PRED}),
m AS MATERIALIZED (SELECT doc_id, type, s, e, least(g, p, 1) AS tp, p - least(g, p, 1) AS fp, g - least(g, p, 1) AS fn FROM (
  SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.type, p.type) AS type, coalesce(g.s, p.s) AS s, coalesce(g.e, p.e) AS e, coalesce(g.n, 0) AS g, coalesce(p.n, 0) AS p
  FROM (SELECT doc_id, s, e, type, count(*) AS n FROM gold GROUP BY ALL) g FULL JOIN (SELECT doc_id, s, e, type, count(*) AS n FROM pred GROUP BY ALL) p
    ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.type = p.type))
"""
METRICS = """tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1"""


def _with_ratios(counts: str) -> str:
    return f"""(SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS pr,
      CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS re FROM ({counts}))"""


SUMS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"
EXACT = f"SELECT type, {SUMS} FROM m GROUP BY type UNION ALL SELECT '(all)', {SUMS} FROM m"
TOKENS = """(SELECT doc_id AS sent_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, ' ') AS ts FROM documents))"""
TAGGED = f"""(SELECT *, CASE length(token) % 5 WHEN 1 THEN 'B_PER' WHEN 2 THEN 'I-Person' WHEN 3 THEN 'B-LOC' ELSE 'O' END AS tag,
  sum(length(token) + 1) OVER (PARTITION BY sent_id ORDER BY pos) - 1 - length(token) AS s, sum(length(token) + 1) OVER (PARTITION BY sent_id ORDER BY pos) - 1 AS e FROM {TOKENS})"""


def _fields() -> str:
    s = lambda c: synth.script(c, "k")
    return f"""SELECT k * 2 AS id, k, 'note' AS path, 'کد ' || {s('nid')} AS text FROM ({IDS})
      UNION ALL SELECT k * 2 + 1, k, 'meta.contact', 'تماس ' || {s('mobile')} || ' / ' || nid FROM ({IDS})"""


def oracle_sql() -> dict[str, str]:
    long = lambda found, key="id": f"SELECT id AS {key}, type, span_start, span_end, value, normalized_value FROM ({found})"
    valid = lambda col, check: f"SELECT k, {col} AS v, {check('v0')} AS ok FROM (SELECT k, {col}, {digits(col)} AS v0 FROM ({IDS}))"
    swapped = f"SELECT id, translate(text, 'یک', 'يك') AS text FROM ({NOTES})"
    rule = f"""SELECT id, 'CUSTOMER_NO' AS type, strpos(text, 'Customer#') + 8 AS span_start, strpos(text, 'Customer#') + 17 AS span_end, substring(text, strpos(text, 'Customer#') + 9, 9) AS value,
      substring(text, strpos(text, 'Customer#') + 9, 9) AS normalized_value FROM ({NOTES})
      UNION ALL SELECT id, 'NOTE_END', length(text) - 5, length(text), 'پایان', 'پایان' FROM ({NOTES})"""
    found, doc_found = detected(NOTES, *ALL), detected(DOCS, "EMAIL", "BANK_CARD")
    five = resolved(detected(NOTES, *ALL[:5]), "longest")
    crossed = f"SELECT id, text || ' | ' || translate(text, '{synth.ASCII}', '{synth.PERSIAN}') AS text FROM ({NOTES})"
    marked = f"SELECT id, '[IR_MOBILE_1] ' || text AS text FROM ({NOTES})"
    numbered = f"""SELECT t.*, regexp_extract({norm('text')}, '([0-9]{{11}})$', 1) AS v, length(text) - 11 AS s FROM ({TURNS}) t"""
    named = f"""SELECT n.*, '[IR_MOBILE_' || CAST(r.r AS VARCHAR) || ']' AS label, r.first FROM ({numbered}) n JOIN (
      SELECT conv_id, v, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS r, arg_min(substring(text, length(text) - 10), turn) AS first FROM ({numbered}) GROUP BY conv_id, v) r USING (conv_id, v)"""
    session = f"SELECT conv_id, turn, substring(text, 1, s) || label AS pseudonymized FROM ({named})"
    field_found = f"SELECT f.k, f.path, d.* FROM ({_fields()}) f JOIN ({detected(f'SELECT id, text FROM ({_fields()})', *DEFAULT)}) d USING (id)"
    in_order = f"""SELECT *, CASE path WHEN 'note' THEN 1 ELSE 0 END AS o FROM ({field_found})"""
    field_no = f"""SELECT k, type, normalized_value, row_number() OVER (PARTITION BY k, type ORDER BY min(o * 1000 + span_start)) AS n FROM ({in_order}) GROUP BY k, type, normalized_value"""
    field_out = f"""SELECT f.k, f.path, coalesce(string_agg(p.gap || p.label, '' ORDER BY p.span_start) || substring(any_value(f.text), CAST(max(p.span_end) AS BIGINT) + 1), any_value(f.text)) AS text
      FROM ({_fields()}) f LEFT JOIN (SELECT i.k, i.path, i.span_start, i.span_end, '[' || i.type || '_' || CAST(n.n AS VARCHAR) || ']' AS label,
        substring(x.text, CAST(lag(i.span_end, 1, 0) OVER w AS BIGINT) + 1, CAST(i.span_start - lag(i.span_end, 1, 0) OVER w AS BIGINT)) AS gap
        FROM ({in_order}) i JOIN ({_fields()}) x USING (id) JOIN ({field_no}) n ON n.k = i.k AND n.type = i.type AND n.normalized_value = i.normalized_value
        WINDOW w AS (PARTITION BY i.k, i.path ORDER BY i.span_start)) p ON p.k = f.k AND p.path = f.path GROUP BY f.k, f.path"""
    item = "'{\"type\":\"' || type || '\",\"start\":' || CAST(span_start AS VARCHAR) || ',\"end\":' || CAST(span_end AS VARCHAR) || '}'"
    wide = "'  {' || chr(10) || '    \"type\": \"' || type || '\",' || chr(10) || '    \"start\": ' || CAST(span_start AS VARCHAR) || ',' || chr(10) || '    \"end\": ' || CAST(span_end AS VARCHAR) || chr(10) || '  }'"
    inside = "CASE WHEN tag IN ('B_PER', 'I-Person') THEN 1 ELSE 0 END"
    exact_pair = "g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.type = p.type"
    miss = f"SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE {exact_pair})"
    extra = f"SELECT * FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE {exact_pair})"
    counted = lambda kind, rows: f"SELECT '{kind}' AS kind, count(*) AS n, sum(doc_id)::BIGINT AS docs FROM ({rows}) HAVING count(*) > 0"
    hit = "EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.type = g.type AND p.s < g.e AND g.s < p.e)"
    out = {
        "normalize_digits": f"SELECT id, {digits('text')} AS norm FROM ({NOTES})",
        "normalize_letters": f"SELECT id, replace(replace(text, 'ي', 'ی'), 'ك', 'ک') AS norm FROM ({swapped})",
        "normalize_text": f"SELECT doc_id, sha256({norm('text')}) AS norm_sha256, length(text) AS n_chars FROM documents",
        "to_scripts": f"SELECT k, translate(card, '{synth.ASCII}', '{synth.PERSIAN}') AS persian, translate(card, '{synth.ASCII}', '{synth.ARABIC}') AS arabic FROM ({IDS})",
        "trim_spans": r"""SELECT doc_id, a AS span_start, a + length(b) AS span_end FROM (SELECT doc_id, 2 + length(p) - length(regexp_replace(p, '^\s+', '')) AS a, regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS b
          FROM (SELECT doc_id, text AS p FROM documents)) WHERE b <> ''""",
        "unicode_audit": f"SELECT count(*) FILTER (id % 3 = 0) AS zwnj, count(*) FILTER (id % 3 = 0) AS arabic_yeh, count(*) FILTER (strpos(text, 'ك') > 0) AS arabic_kaf FROM ({NOTES})",
        "valid_national_id": valid("nid", ok_national_id), "valid_mobile": valid("mobile", ok_mobile), "valid_iban": valid("iban", ok_iban), "valid_card": valid("card", ok_card), "valid_legal_id": valid("legal", ok_legal),
        "valid_email": f"SELECT k, email AS v, {ok_email('email')} AS ok FROM ({IDS})",
        "legal_id_variants": f"SELECT k, {ok_legal('legal')} AS variant_a, {ok_legal('legal', '2')} AS variant_b, {ok_legal_c('legal')} AS variant_c, {ok_legal('legal', '0')} AS variant_d FROM ({IDS})",
        "synth_identifiers": IDS,
        "sql_functions": f"SELECT k, iban, {ok_card('card')} AS card_ok, {ok_iban('iban')} AS iban_ok, {ok_national_id('nid')} AS nid_ok FROM ({IDS})",
        "detect_national_id": long(detected(NOTES, "IR_NATIONAL_ID")), "detect_mobile": long(detected(NOTES, "IR_MOBILE")), "detect_iban": long(detected(NOTES, "IR_IBAN")), "detect_legal_id": long(detected(NOTES, "IR_LEGAL_ENTITY_ID")),
        "detect_email_notes": long(detected(NOTES, "EMAIL")), "detect_card_notes": long(detected(NOTES, "BANK_CARD")),
        "detect_email": long(detected(DOCS, "EMAIL"), "doc_id"), "detect_bank_card": long(detected(DOCS, "BANK_CARD"), "doc_id"),
        "detect_all_long": long(found), "detect_default": long(detected(NOTES, *DEFAULT)), "detect_pattern_rules": long(rule),
        "detect_table_function": f"SELECT id, 'CUSTOMER_NO' AS type, strpos(text, 'Customer#') - 1 AS span_start, strpos(text, 'Customer#') + 17 AS span_end, substring(text, strpos(text, 'Customer#'), 18) AS value FROM ({NOTES})",
        "detect_per_type_counts": f"SELECT type, count(*) AS n, count(DISTINCT id) AS notes FROM ({found}) GROUP BY type",
        "person_windows": rf"""SELECT doc_id, count(*) AS n, sum(s)::BIGINT AS starts FROM (SELECT doc_id, w, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS s
          FROM (SELECT doc_id, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[{WORD}]+') AS ws, string_split_regex(text, '[{WORD}]+') AS gs FROM documents)))
          WHERE lower(w) = 'the' GROUP BY doc_id""",
        "conflict_pairs": f"""SELECT a.id, a.type AS type_a, a.span_start AS start_a, b.type AS type_b, b.span_start AS start_b FROM ({found}) a JOIN ({found}) b
          ON a.id = b.id AND a.span_start < b.span_end AND b.span_start < a.span_end AND (a.span_start, a.span_end, a.type) < (b.span_start, b.span_end, b.type)""",
        "resolve_longest": long(five), "resolve_priority": long(resolved(found, "priority")),
        "redact_documents": f"SELECT id AS doc_id, sha256(redacted) AS redacted_sha256, length(redacted) AS n_chars FROM ({redacted(DOCS, resolved(doc_found, 'longest'))})",
        "redact_notes": redacted(NOTES, five), "redact_cross_script": redacted(crossed, detected(crossed, "IR_NATIONAL_ID")),
        "redact_literal_collision": redacted(marked, detected(marked, "IR_MOBILE"), 2),
        "redact_reject_errors": f"SELECT n.id, c.id IS NOT NULL AS failed, c.id IS NOT NULL AS empty FROM ({NOTES}) n LEFT JOIN (SELECT DISTINCT a.id FROM ({found}) a JOIN ({found}) b ON {CROSS}) c ON n.id = c.id",
        "session_pseudonymize": session, "stream_sessions": session,
        "session_mapping": f"SELECT DISTINCT conv_id, label AS placeholder, first AS value FROM ({named})",
        "session_restore": f"SELECT conv_id, turn, substring(text, 1, s) || first AS restored FROM ({named})",
        "report_documents": _report(doc_found, DOCS, "doc_id"),
        "report_notes": f"SELECT *, conflict_pairs > 0 AS has_conflicts, true AS consistent FROM ({_report(found + ' UNION ALL ' + detected(NOTES, 'IR_NATIONAL_ID'), NOTES, 'id')})",
        "detect_fields": f"SELECT k AS id, path, type, span_start, normalized_value FROM ({field_found})",
        "report_fields": f"SELECT f.k AS id, f.path, count(d.id) AS n FROM ({_fields()}) f LEFT JOIN ({field_found}) d ON f.id = d.id GROUP BY f.k, f.path",
        "redact_fields": f"SELECT k AS id, max(text) FILTER (path = 'note') AS note, max(text) FILTER (path = 'meta.contact') AS contact, 3::BIGINT AS visits FROM ({field_out}) GROUP BY k",
        "profile_outpatient": redacted(NOTES, five),
        "serialize_detections": f"SELECT n.id, '[' || coalesce(string_agg({item}, ',' ORDER BY span_start, span_end, type), '') || ']' AS json FROM ({NOTES}) n LEFT JOIN ({found}) f ON n.id = f.id GROUP BY n.id",
        "serialize_indented": f"SELECT n.id, CASE WHEN count(f.id) = 0 THEN '[]' || chr(10) ELSE '[' || chr(10) || string_agg({wide}, ',' || chr(10) ORDER BY span_start) || chr(10) || ']' || chr(10) END AS json FROM ({NOTES}) n LEFT JOIN ({detected(NOTES, 'IR_NATIONAL_ID')}) f ON n.id = f.id GROUP BY n.id",
        "eval_exact": f"{WITH_EVAL} SELECT type, {METRICS} FROM {_with_ratios(EXACT)}",
        "eval_cases": f"""{WITH_EVAL}, c AS (SELECT m.*, 'c' || CAST(doc_id % 4 AS VARCHAR) AS category FROM m),
          s AS (SELECT 'overall' AS scope, '' AS name, {SUMS}, count(DISTINCT doc_id) FILTER (fp + fn > 0) AS failed FROM c
            UNION ALL SELECT 'type', type, {SUMS}, count(DISTINCT doc_id) FILTER (fp + fn > 0) FROM c GROUP BY type UNION ALL SELECT 'category', category, {SUMS}, count(DISTINCT doc_id) FILTER (fp + fn > 0) FROM c GROUP BY category)
          SELECT scope, name, failed, {METRICS} FROM {_with_ratios('SELECT * FROM s')}""",
        "eval_failed_cases": f"{WITH_EVAL} SELECT DISTINCT doc_id FROM m WHERE fp + fn > 0",
        "eval_errors": f"""{WITH_EVAL}, miss AS ({miss}), extra AS ({extra}) {counted('exact', f'SELECT * FROM gold g WHERE EXISTS (SELECT 1 FROM pred p WHERE {exact_pair})')}
          UNION ALL {counted('type_mismatch', 'SELECT g.doc_id FROM miss g JOIN extra p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.type <> p.type')}
          UNION ALL {counted('boundary', 'SELECT g.doc_id FROM miss g JOIN extra p ON g.doc_id = p.doc_id AND NOT (g.s = p.s AND g.e = p.e) AND g.s < p.e AND p.s < g.e')}
          UNION ALL {counted('false_positive', 'SELECT * FROM extra')} UNION ALL {counted('false_negative', 'SELECT * FROM miss')}""",
        "eval_relaxed": f"{WITH_EVAL} SELECT (SELECT count(*) FROM gold) AS gold, (SELECT count(*) FROM pred) AS predicted, (SELECT count(*) FROM gold g WHERE {hit}) AS matched",
        "eval_predictions": f"""{WITH_EVAL}, x AS (SELECT doc_id, tp, CASE WHEN fp > 0 AND tp = 0 THEN 1 ELSE 0 END AS fp, fn FROM m), d AS (SELECT doc_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM x GROUP BY doc_id),
          a AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) FILTER (fp > 0) AS with_fp, count(*) FILTER (fn > 0) AS missed FROM d)
          SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, (SELECT count(*) FROM gold) AS total_gold, (SELECT count(*) FROM pred) AS total_predicted, with_fp AS documents_with_fp, 0::BIGINT AS offset_failures,
            round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / (tp + fn), 4) AS recall, round(fn::DOUBLE / (SELECT count(*) FROM gold), 4) AS entity_leakage_rate,
            round(missed::DOUBLE / (SELECT count(DISTINCT doc_id) FROM gold), 4) AS document_leakage_rate, round(with_fp::DOUBLE / (SELECT count(*) FROM customer), 4) AS doc_fp_rate FROM a""",
        "eval_gate": f"{WITH_EVAL} SELECT type, pr >= 0.95 AND re >= 0.9 AS passed, CASE WHEN pr >= 0.95 AND re >= 0.9 THEN 'It meets every threshold and can be recommended' ELSE 'It misses a threshold and is not recommended' END AS text FROM {_with_ratios(EXACT)}",
        "eval_negatives": f"""{WITH_EVAL}, n AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM gold WHERE type = 'EMAIL'))
          SELECT count(*) AS negatives, count(*) FILTER (id IN (SELECT doc_id FROM pred WHERE type = 'EMAIL')) AS with_prediction, round(count(*) FILTER (id IN (SELECT doc_id FROM pred WHERE type = 'EMAIL'))::DOUBLE / count(*), 6) AS fp_rate FROM n""",
        "eval_deterministic": "SELECT true AS same, count(*) AS n FROM customer",
        "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
        "latency_ranks": "SELECT max(value) FILTER (r = n // 2) AS median, max(value) FILTER (r = floor(n * 0.95)) AS p95 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)",
        "error_classes": "SELECT event_type AS error_class, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY event_type",
        "bio_labels": f"""SELECT tag, prefix, type, count(*) AS n FROM (SELECT unnest([tag, 'b-pers', 'X', '', 'I', 'BLOC', 'Z-PER']) AS tag FROM {TAGGED}) JOIN (VALUES ('B_PER', 'B', 'PERSON'), ('I-Person', 'I', 'PERSON'), ('B-LOC', 'B', 'LOC'), ('O', 'O', NULL),
          ('b-pers', 'B', 'PERS'), ('X', 'B', 'X'), ('', 'O', NULL), ('I', 'O', NULL), ('BLOC', 'B', 'LOC'), ('Z-PER', 'B', 'PERSON')) v(tag, prefix, type) USING (tag) GROUP BY ALL""",
        "bio_to_spans": f"""WITH t AS (SELECT *, {inside} AS inn FROM {TAGGED} WHERE token <> ''), o AS (SELECT *, CASE WHEN inn = 1 AND (tag = 'B_PER' OR coalesce(lag(inn) OVER (PARTITION BY sent_id ORDER BY pos), 0) = 0) THEN 1 ELSE 0 END AS op FROM t),
          i AS (SELECT *, sum(op) OVER (PARTITION BY sent_id ORDER BY pos) AS island FROM o) SELECT sent_id, min(s)::BIGINT AS span_start, max(e)::BIGINT AS span_end, arg_min(tag, pos) = 'I-Person' AS recovered FROM i WHERE inn = 1 GROUP BY sent_id, island""",
        "offset_audit": f"""WITH t AS (SELECT sent_id, pos, CASE WHEN pos = 0 THEN 0 ELSE s END AS s, CASE WHEN pos = 0 THEN 0 ELSE e END AS e FROM {TAGGED})
          SELECT count(*) FILTER (s = 0 AND e = 0) AS special, count(*) FILTER (NOT (s = 0 AND e = 0) AND e > 300) AS outside, 0::BIGINT AS backward, count(*) AS tokens FROM t""",
    }
    out["canonical_merge"] = _merge()
    return out


def _merge() -> str:
    """The fold over sorted labels as a recursive query, one label of a document per step."""
    return """
WITH RECURSIVE l AS (
  SELECT doc_id, s, e, type, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, type) AS i FROM (
    SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 6 AS s, l_linenumber * 6 + 5 + l_partkey % 3 AS e,
           CASE l_linenumber % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'ADDRESS' WHEN 3 THEN 'ADDRESS' ELSE 'OTHER' END AS type
    FROM lineitem) WHERE e <= 40
), f AS (
  SELECT doc_id, i, [{'s': s, 'e': e, 'type': type}] AS acc FROM l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, CASE
    WHEN acc[-1].type = l.type AND l.s <= acc[-1].e + 1 THEN list_append(acc[:-2], {'s': acc[-1].s, 'e': greatest(acc[-1].e, l.e), 'type': l.type})
    WHEN l.s >= acc[-1].e THEN list_append(acc, {'s': l.s, 'e': l.e, 'type': l.type}) ELSE acc END
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1
)
SELECT doc_id, x.s::BIGINT AS span_start, x.e::BIGINT AS span_end, x.type FROM (SELECT doc_id, unnest(acc) AS x FROM (SELECT doc_id, arg_max(acc, i) AS acc FROM f GROUP BY doc_id))
"""
