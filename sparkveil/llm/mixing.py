"""Mixing sources to target weights by systematic sampling.

Expected copies of a document are its source's target over its source's size. Within a source the documents
stand in order of size and id; their expected copies are summed from the front, one seeded offset is added
for the source, and a document is taken once for each integer that its stretch of the sum crosses. Neighbours
in that order are alike in size, so the words taken stray from the target by about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .exact_dedup import fitting_bits, settled

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null counts as no word."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    flat = F.regexp_replace(spaced, "[^ ]+", "a")
    return F.coalesce(F.length(F.replace(flat, F.lit(" "), F.lit(""))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target of each source: rows (source, source_size, target) from rows (source, source_size).

    Sources by code point, null last, take the weights in turn. All share ``share`` of the whole by weight; no
    target passes ``cap`` times its source's size and what is over is shared again by weight. The result is
    the level at which the capped sources, those with the least size for their weight, fill up. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.alias("w")).withColumn("limit", F.col("source_size") * float(cap))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    w = w.withColumns({
        "place": F.row_number().over(fill),
        "total": F.sum("source_size").over(everything) * float(share),
        "capped": F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit"),
        "open_w": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
    })
    # The level if this source and those after it stay under their limits; the first place where that holds is right.
    w = w.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    w = w.withColumn("turn", F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("place"))).over(everything))
    w = w.withColumn("level", F.min(F.when(F.col("place") == F.col("turn"), F.col("level"))).over(everything))
    return w.select("source", "source_size", F.when(F.col("place") >= F.col("turn"), F.col("level") * F.col("w")).otherwise(F.col("limit")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The source's random offset in [0, 1): 32 bits of an MD5 of seed and source."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the document is in the mix, ``taken = copies * size``. A null text has size 0 and
    takes no part in a target, but is a document like any other in its source's order; a source without words
    has target 0 and copies 0. A null source is a source of its own. Equal rows stay apart. An empty table
    gives an empty result. The same rows and seed give the same mix whatever the partitions.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = scratch.table(sized, "mix-sizes")
    share_of = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    share_of = scratch.table(share_of, "mix-targets").withColumnRenamed("source", "_s")
    placed = scratch.ranked(sized, ["source"], ["size", "id"])
    out = placed.join(share_of, F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = (F.floor(u + rate * F.col("rank_in_key")) - F.floor(u + rate * (F.col("rank_in_key") - 1))).cast("long")
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, not at all for none.

    Options are those of :func:`mix`. All columns are kept. Rows that share id, source and size are taken as often in all as
    :func:`mix` takes them, spread evenly; which of them gets one copy more follows from their columns. A row's copies are the
    whole part of its source's rate or one more: :func:`settled` tells which, so that texts are shuffled only of the few rows
    it leaves open and of rows that share id and source.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text, source = (F.col(f"c{names.index(c)}") for c in (id_col, text_col, source_col))
    with scratch.scope(docs.sparkSession) as keep:
        placed = mix(docs, id_col, text_col, source_col, **options)
        base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        placed = placed.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col("size").alias("_size"), "copies", base.alias("_base"))
        placed = keep(scratch.table(placed, "mix-copies"))
    taken = placed.groupBy("_id", "_source").agg(F.sum("copies").alias("_copies"), F.max("_base").alias("_base"), F.count(F.lit(1)).alias("_rows"))
    taken = scratch.table(taken.withColumn("_mark", F.xxhash64("_id", "_source")), "mix-taken")
    bases = scratch.table(taken.groupBy(F.col("_source").alias("_of")).agg(F.max("_base").alias("_least")), "mix-bases")
    more = F.col("_copies") - F.col("_base")
    yes, no = (taken.where((F.col("_rows") > 1) | (more != other)).select("_mark") for other in (0, 1))
    told = settled(own, F.xxhash64(id_, source), yes, no, fitting_bits(taken.count()), "_more")
    sure = told.where("_more is not null").join(bases, source.eqNullSafe(F.col("_of"))).select(*own.columns, (F.col("_least") + F.col("_more")).alias("_copies"))
    left = told.where("_more is null").select(own.columns)
    taken = taken.where("_copies > 0").drop("_base", "_mark")
    rows = left.join(taken, id_.eqNullSafe(F.col("_id")) & source.eqNullSafe(F.col("_source")))
    out = sure.where("_copies > 0").union(rows.where("_rows = 1").select(*own.columns, "_copies"))
    if not taken.where("_rows > 1").isEmpty():
        keys = "_id", "_source", "_size"
        twins = placed.groupBy(*keys).agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_alike")).toDF("k0", "k1", "k2", "_sum", "_alike")
        several = rows.where("_rows > 1").withColumn("_size", word_count(text)).select(*own.columns, *keys)
        several = several.withColumns({"_mark": F.xxhash64(*own.columns), "_any": F.rand(1)})
        several = scratch.ranked(several, list(keys), ["_mark", "_any"], "_rank")
        several = several.join(twins, F.col("_id").eqNullSafe(F.col("k0")) & F.col("_source").eqNullSafe(F.col("k1")) & (F.col("_size") == F.col("k2")))
        share = F.floor(F.col("_sum") / F.col("_alike")) + F.when(F.col("_rank") <= F.col("_sum") % F.col("_alike"), 1).otherwise(0)
        out = out.union(several.select(*own.columns, share.cast("long").alias("_copies")).where("_copies > 0"))
    return out.select(*own.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("col").toDF(*names)
