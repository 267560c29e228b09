"""Run files and label stores: timestamped JSON results, the newest per name, appends without repeats, manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..operators.checks import file_hashes

STAMPED = r"(\d{8}T\d{6}Z)-(.+)\.json$"


def write_run(spark: SparkSession, folder: str, name: str, result: dict, at: datetime | None = None) -> str:
    """Writes <folder>/<time>-<name>.json through the cluster's file system; returns its path."""
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    path = f"{folder}/{stamp}-{name}.json"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps(result, ensure_ascii=False, sort_keys=True, indent=1).encode()))
    finally:
        out.close()
    return path


def newest(files: DataFrame, path: str = "path") -> DataFrame:
    """name, path: the newest run of each name among paths of timestamped files."""
    stamp, name = F.regexp_extract(path, STAMPED, 1), F.regexp_extract(path, STAMPED, 2)
    return files.where(stamp != "").groupBy(name.alias("name")).agg(F.max_by(path, stamp).alias("path"))


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")


def read_run(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A run as one row; with a schema, fields that a run lacks are null and their types don't depend on its content."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def strings(df: DataFrame) -> DataFrame:
    """path, value: every string of a nested table, structs and arrays of any depth walked; paths leave array places out."""

    def walk(c: Column, kind: DataType, path: str) -> Column | None:
        if isinstance(kind, StringType):
            return F.array(F.struct(F.lit(path).alias("path"), c.alias("value")))
        if isinstance(kind, StructType):
            inner = [x for f in kind.fields if (x := walk(c.getField(f.name), f.dataType, f"{path}.{f.name}")) is not None]
            return F.concat(*inner) if inner else None
        if isinstance(kind, ArrayType) and walk(F.lit(None), kind.elementType, path) is not None:
            return F.flatten(F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: walk(x, kind.elementType, path)))
        return None

    every = [x for f in df.schema.fields if (x := walk(F.col(f"`{f.name}`"), f.dataType, f.name)) is not None]
    found = F.concat(*every) if every else F.array().cast("array<struct<path:string,value:string>>")
    return df.select(F.explode(found).alias("x")).select("x.path", "x.value").where("value IS NOT NULL")


def write_rows(df: DataFrame, path: str, keys: list[str], parts: int = 1) -> None:
    """Writes rows as gzipped JSON Lines, byte for byte the same for the same rows: dealt by key, sorted by every column."""
    names = sorted(df.columns)
    line = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    df.repartition(parts, *keys).sortWithinPartitions(*names).select(line.alias("value")).write.mode("overwrite").text(path, compression="gzip")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_labels(spark: SparkSession, store: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Appends the rows whose keys the store lacks; returns what was appended."""
    try:
        stored = spark.read.parquet(store)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new = rows.dropDuplicates(keys)
    else:
        new = rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(store)
    return new


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """file, status (ok, changed, missing, extra) of files against a manifest (file, sha256)."""
    now = file_hashes(spark, folder).withColumnRenamed("sha256", "_now")
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("_now") == F.col("sha256"), "ok").otherwise("changed")
    return manifest.join(now, "file", "full").select("file", status.alias("status"))
