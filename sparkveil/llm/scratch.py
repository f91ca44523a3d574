"""Shared-folder tables, distributed ranks and connected components used by the operators."""

from __future__ import annotations

import atexit
import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_DIR = "/tmp/checkpoints/sparkveil"
#: Bytes of an Arrow batch, whatever the length of its texts.
ARROW_BYTES = 4 << 20
_RUNS: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """This session's folder among those that driver and executors share: in ``spark.checkpoint.dir``, or where that is unset
    and Spark runs in one process, as in tests, in a local one. It goes when the program ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = DEFAULT_DIR
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{root.rstrip('/')}/sparkveil-{uuid.uuid4().hex}"
        atexit.register(clear, spark)
    return _RUNS[app]


def clear(spark: SparkSession) -> None:
    """Delete all tables of this session. Results that are still to be computed read them."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped() and (at := _RUNS.pop(context.applicationId, None)):
        path = context._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``ARROW_BYTES`` where the session leaves the default of 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("bB") == str(64 << 20):
        spark.conf.set(name, str(ARROW_BYTES))


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage without depending on any executor's disk: a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`table` once nothing that is still to be computed reads them."""
    for df in tables:
        for folder in _folders(df):
            _delete(df.sparkSession, folder)


@contextmanager
def scope(spark: SparkSession):
    """Tables made inside go at the end, but for those given to the function it yields."""
    since, kept = len(_MADE), set()
    yield lambda df: kept.update(f.rsplit("/", 1)[1] for f in _folders(df)) or df
    for path in _MADE[since:]:
        if path.rsplit("/", 1)[1] not in kept:
            _delete(spark, path)
    _MADE[since:] = [path for path in _MADE[since:] if path.rsplit("/", 1)[1] in kept]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank_in_key") -> DataFrame:
    """1-based rank of each row among rows of equal ``keys`` in ``order``, without a task that holds a key.

    Rows are range-partitioned by keys and order, so a hot key spreads over many tasks; a table of one row
    for each key in each partition carries the counts of the partitions before.
    """
    spark = df.sparkSession
    cols = keys + order
    spread = df.repartitionByRange(partitions(spark), *cols).sortWithinPartitions(*cols)
    at = table(spread.withColumn("_row", F.monotonically_increasing_id()), "ranked")
    at = at.withColumn("_part", F.shiftright("_row", 33))
    runs = at.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A key has at most one run in each partition, so this window's groups are bounded by partitions, not rows.
    past = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.col("_first").alias("_f"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = at.join(table(before, "ranked-before"), on)
    return out.select(*df.columns, (F.col("_row") - F.col("_f") + F.col("_before") + 1).alias(name))


def _digest(pairs: DataFrame) -> tuple:
    """Number of pairs and two sums of their hashes: alike for the same set of pairs."""
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``edges(a, b)``: rows (vertex, component).

    Alternating large-star and small-star rounds; each round is an aggregate by vertex with map-side
    combination and a join, and its result is a table in the shared folder. Converges in a number of
    rounds that grows with the logarithm of the component size.
    """
    pairs = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    before = _digest(pairs)
    for _ in range(max_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: every larger neighbour of u moves to u's least neighbour.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = table(large, "cc-large")
        # Small star: u and its smaller neighbours move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = table(small.where("u <> v").distinct(), "cc")
        drop(large, pairs)
        pairs, now = after, _digest(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v"))).distinct()
