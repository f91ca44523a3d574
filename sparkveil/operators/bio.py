"""BIO tags as relations: label parsing, and spans from tagged tokens by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels that mean a person.
PERSON_LABELS = ("PER", "PERS", "Person", "PERSON", "person")


def parse_label(label: Column, strict: bool = False) -> Column:
    """Struct (prefix, type): B, I or O, and the type in capitals with person labels as PERSON; null type for O.

    The prefix ends at the first underscore, else at the first hyphen, else after one letter. With ``strict`` a
    malformed label raises; otherwise an unknown prefix counts as B and a label without type as O.
    """
    s = F.trim(label)
    cut = F.when(F.locate("_", s) > 0, F.locate("_", s)).otherwise(F.locate("-", s))
    first = F.upper(F.substring(s, 1, 1))
    bare = cut == 0
    known = first.isin("B", "I", "O")
    prefix = F.when(bare, F.when(known, first).otherwise("?")).otherwise(F.upper(F.substring(s, F.lit(1), cut - 1)))
    kind = F.trim(F.when(bare, F.when(known, F.substring(s, F.lit(2), F.length(s))).otherwise(s)).otherwise(F.substring(s, cut + 1, F.length(s))))
    odd = ~prefix.isin("B", "I", "O")
    out_side = (s == "") | (s == "O") | (~odd & (prefix == "O")) | (kind == "")
    named = F.when(kind.isin(*PERSON_LABELS), "PERSON").otherwise(F.upper(kind))
    wrong = (s == "") | ((s != "O") & (odd | ((prefix != "O") & (kind == ""))))
    prefix = F.when(out_side, "O").when(odd, "B").otherwise(prefix)
    if strict:
        prefix = F.when(wrong, F.raise_error(F.lit("malformed BIO label"))).otherwise(prefix)
    return F.struct(prefix.alias("prefix"), F.when(~out_side, named).alias("type"))


def token_offsets(tokens: DataFrame) -> DataFrame:
    """Tokens (sent_id, pos, token, ...) with start and end in the text that joins them by one blank."""
    order = Window.partitionBy("sent_id").orderBy("pos")
    end = F.sum(F.length("token") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return tokens.withColumns({"start": (end - F.length("token")).cast("int"), "end": end.cast("int")})


def spans_from_tags(tokens: DataFrame, target: str = "PERSON", strict: bool = False) -> DataFrame:
    """Rows (sent_id, start, end, type, recovered) from tokens (sent_id, pos, token, tag) or with own start and end.

    A span opens at B, or at an I that continues nothing (``recovered``), and lasts while I tags of the target follow.
    """
    at = tokens if {"start", "end"} <= set(tokens.columns) else token_offsets(tokens)
    at = at.withColumn("l", parse_label(F.col("tag"), strict)).where("end > start")
    order = Window.partitionBy("sent_id").orderBy("pos")
    inside = F.coalesce(F.col("l.type") == target, F.lit(False)) & (F.col("l.prefix") != "O")
    before = F.coalesce(F.lag("inside").over(order), F.lit(False))
    at = at.withColumn("inside", inside)
    at = at.withColumn("opens", F.col("inside") & ((F.col("l.prefix") == "B") | ~before)).withColumn("island", F.sum(F.col("opens").cast("int")).over(order))
    found = at.where("inside").groupBy("sent_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(F.col("l.prefix") == "I", "pos").alias("recovered"))
    return found.select("sent_id", "start", "end", F.lit(target).alias("type"), "recovered")


def offset_audit(tokens: DataFrame) -> DataFrame:
    """One row of counts over tokenizer offsets (doc_id, pos, start, end, n_chars): special, out of bounds, backward."""
    real = ~((F.col("start") == 0) & (F.col("end") == 0))
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = F.max(F.when(real, F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = tokens.withColumns({"special": ~real, "outside": real & ((F.col("start") < 0) | (F.col("start") > F.col("end")) | (F.col("end") > F.col("n_chars"))), "backward": real & F.coalesce(F.col("start") < before, F.lit(False))})
    return flagged.agg(*[F.count_if(c).alias(c) for c in ("special", "outside", "backward")], F.count(F.lit(1)).alias("tokens"))
