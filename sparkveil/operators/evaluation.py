"""Evaluation of predicted against gold spans, as joins and grouping sets.

Spans are rows (doc_id, start, end, type); documents come along where documents without spans matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import bind

KEY = ["doc_id", "start", "end", "type"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def metrics(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1: all 1 if nothing was there and nothing found; a zero denominator gives 0."""
    none = (tp + fp + fn) == 0
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return tuple(F.when(none, F.lit(1.0)).otherwise(x) for x in (p, r, f1))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Rows with tp, fp, fn, and precision, recall, f1 beside them."""
    p, r, f1 = metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def matched(gold: DataFrame, predicted: DataFrame, duplicates: str = "count_as_fp") -> DataFrame:
    """Rows (KEY, tp, fp, fn): a duplicate prediction counts once as hit and then as false positive, or raises.

    Duplicate gold spans raise.
    """
    if duplicates not in ("count_as_fp", "reject"):
        raise ValueError("duplicates must be 'count_as_fp' or 'reject'")
    g = gold.groupBy(*KEY).agg(F.count(F.lit(1)).alias("g"))
    p = predicted.groupBy(*KEY).agg(F.count(F.lit(1)).alias("p"))
    both = g.join(p, KEY, "full_outer").select(*KEY, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    g_ok = F.when(F.col("g") > 1, F.raise_error(F.lit("duplicate gold span")).cast("long")).otherwise(F.col("g"))
    p_ok = F.when(F.col("p") > 1, F.raise_error(F.lit("duplicate predicted span")).cast("long")).otherwise(F.col("p")) if duplicates == "reject" else F.col("p")
    both = both.select(*KEY, g_ok.alias("g"), p_ok.alias("p"))
    hit = F.least("g", "p", F.lit(1))
    return both.select(*KEY, hit.alias("tp"), (F.col("p") - hit).alias("fp"), (F.col("g") - hit).alias("fn"))


def evaluate_exact(gold: DataFrame, predicted: DataFrame, duplicates: str = "count_as_fp") -> DataFrame:
    """Overall and per type: (type, tp, fp, fn, precision, recall, f1); type is null in the overall row."""
    rows = matched(gold, predicted, duplicates)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    # One pass for both: a row that counts for nothing keeps the overall row where there is no span.
    nothing = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("type"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn", "real")])
    all_ = rows.select("type", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.lit(1).cast("long").alias("real")).union(nothing)
    summed = all_.rollup("type").agg(*sums, F.sum("real").alias("real"), F.grouping("type").alias("whole")).where("whole = 1 OR real > 0")
    return with_metrics(summed.select("type", "tp", "fp", "fn"))


def evaluate_cases(cases: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Corpus report by grouping sets: overall, by type, by category; rows (scope, name, tp, fp, fn, failed, ...).

    ``cases`` is (doc_id, category). ``failed`` counts documents with a false positive or a miss.
    """
    rows = matched(gold, predicted).join(cases, "doc_id")
    out = cases.sparkSession.sql("""
        SELECT CASE grouping_id(type, category) WHEN 3 THEN 'overall' WHEN 1 THEN 'type' ELSE 'category' END AS scope,
               coalesce(type, category, '') AS name, coalesce(sum(tp), 0L) AS tp, coalesce(sum(fp), 0L) AS fp, coalesce(sum(fn), 0L) AS fn,
               count(DISTINCT CASE WHEN fp + fn > 0 THEN doc_id END) AS failed
        FROM {rows} GROUP BY GROUPING SETS ((), (type), (category))""", rows=rows)
    return with_metrics(out)


def failed_cases(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Ids of documents with a false positive or a miss, sorted."""
    return matched(gold, predicted).where("fp + fn > 0").select("doc_id").distinct().orderBy("doc_id")


def errors(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rows (doc_id, kind, gold_start, gold_end, gold_type, pred_start, pred_end, pred_type).

    Kinds: exact, type_mismatch (same bounds), boundary (overlap, other bounds), false_positive, false_negative. The
    first is per gold span, the pairs are of spans without exact match, the last two list those spans.
    """
    span = F.struct(*KEY[1:])
    both = gold.select("doc_id", span.alias("g"), F.lit(None).cast(gold.select(span.alias("s")).schema["s"].dataType).alias("p"))
    both = both.union(predicted.select("doc_id", F.lit(None).cast(both.schema["g"].dataType).alias("g"), span.alias("p")))
    # Both lists of a document side by side: each input is read once, in one exchange.
    lists = both.groupBy("doc_id").agg(F.collect_list("g").alias("g"), F.collect_list("p").alias("p"))

    def row(kind, g=None, p=None):
        cols = [(F.lit(None).cast("string" if c == "type" else "int") if x is None else x[c].cast("string" if c == "type" else "int")).alias(f"{s}_{c}") for s, x in (("gold", g), ("pred", p)) for c in KEY[1:]]
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *cols)

    def of(miss, extra):
        def pair(g, p):
            same = (g["start"] == p["start"]) & (g["end"] == p["end"])
            cross = F.greatest(g["start"], p["start"]) < F.least(g["end"], p["end"])
            return F.when(same, F.when(g["type"] != p["type"], "type_mismatch")).when(cross, "boundary")

        pairs = F.flatten(F.transform(miss, lambda g: F.transform(extra, lambda p: row(pair(g, p), g, p))))
        exact = F.transform(F.filter("g", lambda x: F.array_contains("p", x)), lambda x: row("exact", x))
        return F.concat(exact, F.filter(pairs, lambda x: x["kind"].isNotNull()), F.transform(extra, lambda p: row("false_positive", None, p)), F.transform(miss, lambda g: row("false_negative", g)))

    miss, extra = F.filter("g", lambda x: ~F.array_contains("p", x)), F.filter("p", lambda x: ~F.array_contains("g", x))
    return lists.select("doc_id", F.inline(bind(miss, lambda m: bind(extra, lambda e: of(m, e)))))


def relaxed(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rows (doc_id, gold, predicted, matched): greedy one-to-one overlap of equal types, predictions in row order.

    Both inputs carry ``pos``, the position within the document. The fold is over arrays of one document's spans.
    """
    both = _side_by_side(gold, predicted)
    return both.select("doc_id", F.size("g").cast("long").alias("gold"), F.size("p").cast("long").alias("predicted"), F.size(_hits()).cast("long").alias("matched"))


def _side_by_side(gold: DataFrame, predicted: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, g, p) of sorted spans, and with ``docs`` (text, listed): each input is read once, in one exchange."""
    kind = "struct<pos:int,start:int,end:int,type:string>"
    span, none = F.struct("pos", "start", "end", "type").cast(kind), F.lit(None).cast(kind)
    rest = [F.lit(None).cast("string").alias("text"), F.lit(0).alias("listed")] if docs is not None else []
    rows = gold.select("doc_id", span.alias("g"), none.alias("p"), *rest).union(predicted.select("doc_id", none.alias("g"), span.alias("p"), *rest))
    lists = [F.array_sort(F.collect_list(c)).alias(c) for c in ("g", "p")]
    if docs is None:
        return rows.groupBy("doc_id").agg(*lists)
    rows = rows.union(docs.select("doc_id", none.alias("g"), none.alias("p"), F.col("text").cast("string").alias("text"), F.lit(1).alias("listed")))
    return rows.groupBy("doc_id").agg(*lists, F.max("text").alias("text"), F.sum("listed").alias("listed"))


def _hits() -> Column:
    """Positions of the spans of column ``g`` that those of ``p`` take, one after the other."""

    def step(used, x):
        open_ = F.filter(F.col("g"), lambda y: (y["type"] == x["type"]) & (F.greatest(y["start"], x["start"]) < F.least(y["end"], x["end"])) & ~F.array_contains(used, y["pos"]))
        return F.when(F.size(open_) > 0, F.array_append(used, F.get(open_, F.lit(0))["pos"])).otherwise(used)

    return F.aggregate("p", F.array().cast("array<int>"), step)


def evaluate_predictions(docs: DataFrame, gold: DataFrame, predicted: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """One row of corpus statistics: exact (as sets), relaxed, leakage, false-positive documents, offset failures.

    ``docs`` is (doc_id, text), a row for each document; gold and predicted carry ``pos``, and their spans have no null.
    Each input is read once: a document's text and spans meet in one exchange. Ratios are rounded to four places.
    """
    if types is not None:
        gold, predicted = gold.where(F.col("type").isin(list(types))), predicted.where(F.col("type").isin(list(types)))
    g, p = (F.array_distinct(F.transform(c, lambda x: F.struct(*[x[k] for k in KEY[1:]]))) for c in ("g", "p"))

    def ok(x):
        inside = (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("text"))
        return F.coalesce(inside & (F.length(F.trim(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]))) > 0), F.lit(False))

    per_doc = _side_by_side(gold, predicted, docs).where("listed > 0").select(
        F.size(F.array_intersect(g, p)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"),
        F.size("g").alias("gold"), F.size("p").alias("predicted"), F.size(_hits()).alias("matched"), F.size(F.filter("p", lambda x: ~ok(x))).alias("off"),
    )
    total = per_doc.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "gold", "predicted", "matched", "off")], F.count(F.lit(1)).alias("docs"),
        F.count_if(F.col("gold") > 0).alias("with_gold"), F.count_if((F.col("fn") > 0) & (F.col("gold") > 0)).alias("missed"), F.count_if(F.col("fp") > 0).alias("with_fp"),
    )
    c = F.col
    exact, loose = metrics(c("tp"), c("fp"), c("fn")), metrics(c("matched"), c("predicted") - c("matched"), c("gold") - c("matched"))
    four = lambda x: F.round(x, 4)
    return total.select(
        c("tp").alias("true_positives"), c("fp").alias("false_positives"), c("fn").alias("false_negatives"), *[four(x).alias(n) for x, n in zip(exact, ("precision", "recall", "f1"), strict=True)],
        c("gold").alias("total_gold"), c("predicted").alias("total_predicted"), *[four(x).alias(n) for x, n in zip(loose, ("relaxed_precision", "relaxed_recall", "relaxed_f1"), strict=True)],
        four(_ratio(c("fn"), c("gold"))).alias("entity_leakage_rate"), four(_ratio(c("missed"), c("with_gold"))).alias("document_leakage_rate"), c("with_fp").alias("documents_with_fp"),
        four(_ratio(c("with_fp"), c("docs"))).alias("doc_fp_rate"), c("off").alias("offset_failures"), four(_ratio(c("off"), c("predicted"))).alias("offset_failure_rate"),
    )


def negative_documents(docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: documents without gold, those of them with a prediction, and their share (null without any)."""
    flags = docs.select("doc_id").join(gold.select("doc_id").distinct(), "doc_id", "left_anti").join(predicted.select("doc_id").distinct().withColumn("hit", F.lit(1)), "doc_id", "left")
    n = flags.agg(F.count(F.lit(1)).alias("negatives"), F.count("hit").alias("with_prediction"))
    return n.withColumn("fp_rate", F.when(F.col("negatives") > 0, F.col("with_prediction") / F.col("negatives")))


def gate(df: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """``df`` with a boolean ``passed``: every named column is >= or <= its threshold."""
    tests = [F.col(c) >= v if op == ">=" else F.col(c) <= v for c, (op, v) in thresholds.items()]
    passed = F.lit(True)
    for t in tests:
        passed = passed & F.coalesce(t, F.lit(False))
    return df.withColumn("passed", passed)


def recommendation(passed: Column, subject: str) -> Column:
    return F.when(passed, F.lit(f"{subject} meets every threshold and can be recommended")).otherwise(F.lit(f"{subject} misses a threshold and is not recommended"))


def latency(df: DataFrame, value: str = "seconds", chars: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and interpolated percentiles of a column, per group; 0 for no rows. With ``chars`` throughput too."""
    v = F.col(value)
    stats = [F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.median(v), F.lit(0.0)).alias("median"), F.coalesce(F.percentile(v, F.lit(0.95)), F.lit(0.0)).alias("p95")]
    total = F.sum(v)
    if chars:
        stats += [F.coalesce(F.when(total > 0, F.count(v) / total), F.lit(0.0)).alias("docs_per_second"), F.coalesce(F.when(total > 0, F.sum(chars) / total), F.lit(0.0)).alias("chars_per_second")]
    return df.groupBy(*by).agg(*stats)


def latency_by_rank(df: DataFrame, value: str = "seconds") -> DataFrame:
    """The other convention: the element at floor(n / 2) and at floor(0.95 n) of the sorted values, by rank."""
    n = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(value)) - 1
    ranked = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), rank.alias("r")).crossJoin(F.broadcast(n))
    return ranked.agg(F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("v"))).alias("median"), F.max(F.when(F.col("r") == F.floor(F.col("n") * 0.95), F.col("v"))).alias("p95"))


def improvement_gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether a change pays: 20 % less latency or 25 % more throughput, and memory within 1.25 times."""
    b, a = before.select(*[F.col(c).alias(f"b_{c}") for c in ("latency", "throughput", "rss")]), after.select("latency", "throughput", "rss")
    gain = (F.col("latency") <= 0.8 * F.col("b_latency")) | (F.col("throughput") >= 1.25 * F.col("b_throughput"))
    return b.crossJoin(a).select((gain & (F.col("rss") <= 1.25 * F.col("b_rss"))).alias("accepted"))


def pure_totals(df: DataFrame) -> DataFrame:
    """``df`` (fp, fn, boundary) with false positives and misses that no boundary error explains."""
    return df.withColumns({"pure_fp": F.greatest(F.lit(0), F.col("fp") - F.col("boundary")), "pure_fn": F.greatest(F.lit(0), F.col("fn") - F.col("boundary"))})


def error_classes(df: DataFrame, column: str = "error_class") -> DataFrame:
    """Rows (error class, n) of the errors recorded."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def deterministic(runs: DataFrame) -> DataFrame:
    """Rows (doc_id, same): whether all runs of a document gave the same spans. ``runs`` is (doc_id, run, spans)."""
    return runs.groupBy("doc_id").agg((F.count_distinct(F.to_json("spans")) == 1).alias("same"))


def merged_gold(labels: DataFrame, taxonomy: dict[str, str], length: str = "n_chars") -> DataFrame:
    """Labels mapped to canonical types and merged: rows (doc_id, start, end, type).

    ``labels`` is (doc_id, label, start, end, <length>). Spans out of bounds go. In order of start and end, a span of
    the last one's type that starts at most one past its end extends it; one that overlaps another type goes.
    """
    names = F.create_map(*[F.lit(x) for kv in taxonomy.items() for x in kv])
    rows = labels.where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col(length)))
    rows = rows.select("doc_id", "start", "end", F.coalesce(F.element_at(names, F.col("label")), F.col("label")).alias("type"))
    spans = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("s"))

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (last["type"] == x["type"]) & (x["start"] <= last["end"] + 1)
        longer = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["type"].alias("type")))
        apart = (F.size(acc) == 0) | (x["start"] >= last["end"])
        return F.when(joins, longer).when(apart, F.array_append(acc, x)).otherwise(acc)

    done = F.aggregate("s", F.array().cast("array<struct<start:int,end:int,type:string>>"), step)
    return spans.select("doc_id", F.inline(done))
