"""Tables in the shared folder, and connected components by alternating large-star and small-star rounds.

Both rounds are a grouped minimum with map-side combine and an equality join, so a hub is never gathered in one task.
Each round is written as a table in the shared folder, which cuts the lineage and survives lost executors; the table of
the round before is deleted then. Only two numbers a round reach the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session in one process, as in tests, gets a folder of its own without it."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if have is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster share no other folder")
        have = "file://" + tempfile.mkdtemp(prefix="ckpt-")
        spark.sparkContext.setCheckpointDir(have)
    return have


def saved(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder. Any names, clashing ones too, pass."""
    spark, names = df.sparkSession, df.columns
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    out = spark.read.schema(spark.read.parquet(path).schema).parquet(path).toDF(*names)
    out._saved_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that saved() wrote and nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """node, component: the smallest node reachable, for every node with an edge. Loops, repeats and nulls are allowed."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = saved(e)
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        last, e = e, saved(small)
        dropped(last)
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
