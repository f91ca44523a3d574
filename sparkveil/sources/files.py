"""Readers and writers."""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    """One row (path, text) for each file, strict UTF-8: an undecodable file raises, or has null text."""
    files = spark.read.format("binaryFile").load(path)
    ok = F.expr("is_valid_utf8(CAST(content AS STRING))")
    bad = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string") if errors == "raise" else F.lit(None).cast("string")
    return files.select("path", F.when(ok, F.decode("content", "UTF-8")).otherwise(bad).alias("text"))


def read_text(path: str) -> str:
    """A whole file, or standard input for ``-``, as strict UTF-8; what goes wrong has an error of its own kind."""
    if path == "-":
        return sys.stdin.buffer.read().decode("utf-8")
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"input file not found: {path}")
    if p.is_dir():
        raise IsADirectoryError(f"input is a directory: {path}")
    return p.read_bytes().decode("utf-8")


def write_text(text: str, path: str, source: str = "-") -> None:
    """A whole file, or standard output for ``-``; refuses to write over its own input."""
    if path == "-":
        sys.stdout.buffer.write(text.encode("utf-8"))
        sys.stdout.buffer.flush()
        return
    if source != "-" and (Path(path).resolve() == Path(source).resolve() or os.path.exists(path) and os.path.exists(source) and os.path.samefile(path, source)):
        raise ValueError("input and output are the same file")
    Path(path).write_bytes(text.encode("utf-8"))


def dumps(value: Any, indent: int | None = 2) -> str:
    """JSON with its characters as they are and one line break at the end."""
    return json.dumps(value, ensure_ascii=False, indent=indent) + "\n"


def write_artifact(value: Any, path: str) -> None:
    """A result file: sorted keys; refuses values that name raw text."""
    private = {"value", "normalized_value", "text", "mapping"}

    def walk(x):
        if isinstance(x, dict):
            if private & x.keys():
                raise ValueError("a result file must not hold raw text")
            for y in x.values():
                walk(y)
        elif isinstance(x, list):
            for y in x:
                walk(y)

    walk(value)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", "utf-8")


def private_columns(df: DataFrame) -> list[str]:
    """Paths of columns, nested ones too, that hold raw text."""
    from pyspark.sql import types as T

    out = []

    def walk(kind, at):
        if isinstance(kind, T.StructType):
            for f in kind:
                if f.name in ("value", "normalized_value", "text"):
                    out.append(f"{at}{f.name}")
                walk(f.dataType, f"{at}{f.name}.")
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, at)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, at)

    walk(df.schema, "")
    return out


def conll_tokens(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Tokens (path, sent_id, pos, token, tag) from rows (path, line_no, line).

    A line is ``token|tag``, cut at the last bar, or two fields between blanks; a blank line ends a sentence. With
    ``strict`` another line raises with its number; otherwise it is passed over.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    s = F.trim("line")
    at = lines.withColumn("s", s).withColumn("block", F.sum(F.when(F.col("s") == "", 1).otherwise(0)).over(order))
    bar = F.col("s").contains("|")
    fields = F.split("s", r"\s+")
    token = F.when(bar, F.trim(F.regexp_extract("s", r"^(.*)\|", 1))).when(F.size(fields) == 2, F.get(fields, F.lit(0)))
    tag = F.when(bar, F.trim(F.regexp_extract("s", r"\|([^|]*)$", 1))).when(F.size(fields) == 2, F.get(fields, F.lit(1)))
    rows = at.where("s <> ''").select("path", "block", "line_no", token.alias("token"), tag.alias("tag"))
    good = F.coalesce((F.col("token") != "") & (F.col("tag") != ""), F.lit(False))
    if strict:
        rows = rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("malformed line "), F.col("line_no").cast("string"))).cast("boolean")))
    else:
        rows = rows.where(good)
    sentence = F.dense_rank().over(Window.partitionBy("path").orderBy("block")) - 1
    inner = F.row_number().over(Window.partitionBy("path", "block").orderBy("line_no")) - 1
    return rows.select("path", sentence.alias("sent_id"), inner.alias("pos"), "token", "tag")


def read_conll(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    files = spark.read.format("text").option("wholetext", True).load(path).select(F.input_file_name().alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    return conll_tokens(lines, strict)


def sha256_of(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sha256) of files, for a gate on canonical inputs."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def first_rows(spark: SparkSession, path: str, n: int, order: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(order).limit(n)
