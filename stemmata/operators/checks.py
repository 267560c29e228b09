"""Integrity checks: each is a relation of (name, ok, failed); a report unions them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(df: DataFrame, name: str, good: Column) -> DataFrame:
    """How many rows satisfy `good`; a null counts as failed."""
    good = F.coalesce(good, F.lit(False))
    return df.agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed")).select(F.lit(name).alias("name"), "ok", "failed")


def equal(found: DataFrame, told: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """Whether two relations of (key, value) agree, key by key, either way."""
    both = found.select(key, F.col(value).alias("_a"), F.lit(True).alias("_x")).join(told.select(key, F.col(value).alias("_b"), F.lit(True).alias("_y")), key, "full")
    return predicate(both, name, F.col("_x") & F.col("_y") & F.col("_a").eqNullSafe(F.col("_b")))


def contained(rows: DataFrame, raw: DataFrame, name: str, key: str, quote: Column) -> DataFrame:
    """Whether each row's quote condition holds on the raw row with its key; a missing raw row fails."""
    return predicate(rows.join(raw, key, "left"), name, quote)


def report(checks: list[DataFrame]) -> DataFrame:
    """name, passed, ok, failed."""
    return reduce(DataFrame.unionByName, checks).select("name", (F.col("failed") == 0).alias("passed"), F.col("ok").cast("long").alias("ok"), F.col("failed").cast("long").alias("failed"))


def row_counts(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """table, rows, expected, ok: counts against a manifest (table, expected), either side may lack a table."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows") for t, df in tables.items()])
    return counts.join(manifest, "table", "full").select("table", "rows", "expected", F.coalesce(F.col("rows") == F.col("expected"), F.lit(False)).alias("ok"))


def doc_markers(docs: DataFrame, text: str) -> DataFrame:
    """path, told: the numbers that a document marks as `n<!--f:path-->`."""
    pairs = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"([\d.,]+<!--f:[\w./-]+-->)"), F.lit(1))).alias("m")
    return docs.select(pairs).select(F.regexp_extract("m", r"f:([\w./-]+?)-->", 1).alias("path"), F.regexp_replace(F.regexp_extract("m", r"^([\d.,]+)", 1), ",", "").alias("told"))


def file_hashes(spark, path: str) -> DataFrame:
    """file, sha256 of the files under path."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))
