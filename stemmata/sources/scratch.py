"""Tables that one query writes and reads again: they cut long plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession, hours: float = 24) -> int:
    """Deletes what queries wrote to the shared folder and nobody has touched for `hours`; returns how many tables went.

    A table of a query that is still read must be younger, so take more hours than the longest query.
    """
    from time import time

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    for name in ("tables", "rows", "facts"):
        top = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
        fs = top.getFileSystem(conf)
        if fs.exists(top):
            for f in fs.listStatus(top):
                if f.getModificationTime() <= (time() - hours * 3600) * 1000:
                    gone += bool(fs.delete(f.getPath(), True))
    return gone
