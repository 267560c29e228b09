"""Facts files against what can be recomputed, and documents against facts: key by key, numbers as numbers.

A facts file is one nested JSON value. It becomes rows (parts, kind, number, text), one for each leaf, by exploding VARIANT
values level by level: each level is a generator of one plan, so nothing meets the driver and a file of any size is a
table like others. `parts` are the keys and places on the way; an empty object or array is a leaf of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 12
MARKER = r"(-?[\d.,]+<!--f:[\w./-]+-->)"


def _kind(v: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)
    return F.when(name.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "number").otherwise(F.lower(name))


def leaves(df: DataFrame, value: str, keep: tuple[str, ...] = (), depth: int = DEPTH) -> DataFrame:
    """keep, parts, kind, number, text of each leaf of a VARIANT column; kind: number, string, boolean, void, object or array (empty ones).

    A value nested deeper than `depth` fails the query. Null values of the column have no rows.
    """
    spark = df.sparkSession
    level = df.where(F.col(value).isNotNull()).select(*keep, F.array().cast("array<string>").alias("parts"), F.col(value).alias("_v"))
    for _ in range(depth):
        level = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()))
        inner = F.col("value").isNotNull()  # a JSON null is a value; what isn't a container has none
        parts = F.when(inner, F.concat("parts", F.array(F.coalesce("key", F.col("pos").cast("string"))))).otherwise(F.col("parts"))
        level = level.select(*keep, parts.alias("parts"), F.coalesce("value", "_v").alias("_v"))
    level = level.withColumn("kind", _kind(F.col("_v")))
    text = F.try_variant_get("_v", "$", "string")
    deeper = F.col("kind").isin("object", "array") & ~text.isin("{}", "[]")
    kind = F.when(deeper, F.raise_error(F.concat(F.lit("nested too deep at "), F.array_join("parts", ".")))).otherwise(F.col("kind"))
    return level.select(*keep, "parts", kind.alias("kind"), F.when(F.col("kind") == "number", F.try_variant_get("_v", "$", "double")).alias("number"), text.alias("text"))


def path(parts: Column) -> Column:
    return F.array_join(parts, ".")


def compared(saved: DataFrame, now: DataFrame) -> DataFrame:
    """parts, saved, now, status of two tables of leaves: ok, changed, missing (only now), extra (only saved). Numbers compare by value, all else by kind and text."""
    a = saved.select("parts", F.struct("kind", "number", "text").alias("_a"))
    b = now.select("parts", F.struct("kind", "number", "text").alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    equal = (x["kind"] == y["kind"]) & F.when(x["kind"] == "number", x["number"] == y["number"]).otherwise(x["text"].eqNullSafe(y["text"]))
    status = F.when(x.isNull(), "missing").when(y.isNull(), "extra").when(equal, "ok").otherwise("changed")
    return a.join(b, "parts", "full").select("parts", x["text"].alias("saved"), y["text"].alias("now"), status.alias("status"))


def markers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, told: the numbers that documents mark as `n<!--f:path-->`; told is null for what is no number."""
    found = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(MARKER), F.lit(1))).alias("_m"))
    told = F.regexp_replace(F.regexp_extract("_m", r"^(-?[\d.,]+?)[.,]?<", 1), ",", "")
    return found.select(key, F.regexp_extract("_m", r"f:([\w./-]+?)-->", 1).alias("path"), told.try_cast("double").alias("told"))


def marked(docs: DataFrame, key: str, text: str, facts: DataFrame) -> DataFrame:
    """key, path, told, value, ok: each number that a document marks beside the fact of its path; without such a fact it is wrong."""
    known = facts.where("kind = 'number'").select(path(F.col("parts")).alias("path"), F.col("number").alias("value"))
    told = markers(docs, key, text)
    return told.join(known, "path", "left").select(key, "path", "told", "value", F.coalesce(F.col("told") == F.col("value"), F.lit(False)).alias("ok"))
