"""The model's roles over the given tables, in Spark and in SQL.

snapshots: documents, agent = source, time = doc_id minutes. memory: the lines of an agent's last three documents, a
rolling memory that keeps and drops lines. chat: conversations. stances: events by type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.temporal import versions

MEMORY = 3


@dataclass(frozen=True)
class Era:
    """A part of the time of the tables in a folder, in minutes: low <= time < high. Takes the place of the folder in any view of documents."""

    folder: str
    low: int
    high: int


def table(spark: SparkSession, sf_dir: str | Era, name: str) -> DataFrame:
    """A table of the folder; of an era's documents only those written in it, a bound that the scan takes."""
    if not isinstance(sf_dir, Era):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = spark.read.parquet(f"{sf_dir.folder}/{name}.parquet")
    return df.where((F.col("doc_id") >= sf_dir.low) & (F.col("doc_id") < sf_dir.high)) if name == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """df on at least as many partitions as there are cores: a small file of one row group is one task otherwise.

    A large table has more partitions than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of documents, for work on their texts."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, agent, minute, content, k."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("agent"), F.col("doc_id").alias("minute"), F.col("text").alias("content"))
    return versions(d, "agent", ["minute", "id"])


def snapshot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, agent, minute, k: without the text, so the window sorts keys alone."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("agent"), F.col("doc_id").alias("minute"))
    return versions(d, "agent", ["minute", "id"])


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, agent, pos, line: trimmed lines of at least three characters, before any shuffle."""
    d = texts(spark, sf_dir, "doc_id", "source", "text").select(F.col("doc_id").alias("id"), F.col("source").alias("agent"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.withColumn("line", F.trim("line")).where(F.char_length("line") >= 3)


def hashed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, k, h, pos: lines by digest; the text itself isn't shuffled."""
    rows = line_rows(spark, sf_dir).select("id", "agent", "pos", F.substring(F.sha2("line", 256), 1, 24).alias("h"))
    return rows.join(snapshot_keys(spark, sf_dir).select("id", "k", "minute"), "id")


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, k, h: what each version of the rolling memory holds. Dealt by line and agent once, which what is grouped by them needs no more."""
    rows = hashed_lines(spark, sf_dir).select("agent", "k", "h").repartition("h", "agent").distinct()
    last = final_k(spark, sf_dir).withColumnRenamed("final_k", "last")
    held = rows.join(last, "agent").select("agent", "h", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + MEMORY - 1, F.col("last")))).alias("k"))
    return held.distinct()


def final_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, final_k: the number of its last version, which follows from how many it has."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("agent")).agg((F.count("*") - 1).alias("final_k"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, speaker, minute, text."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("role").alias("speaker"), (F.col("conv_id") * 8 + F.col("turn")).alias("minute"), "text")


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, agent, us (microseconds), belief, label."""
    e = table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "purchase", "affirms").when(F.col("event_type") == "error", "denies").when(F.col("event_type") == "signup", "doubts").otherwise("unrelated")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("agent"), F.unix_micros(F.to_utc_timestamp("ts", "UTC")).alias("us"), (F.get_json_object("props", "$.k").cast("long") % 10).alias("belief"), label.alias("label"), "event_type")


def daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, k, day, state: one version of an agent for each day with events; its state from the stances of the day."""
    from ..operators.labels import state

    s = stances(spark, sf_dir).groupBy("agent", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.bool_or(F.col("label") == "affirms").alias("a"), F.bool_or(F.col("label") == "denies").alias("d"))
    s = s.select("agent", "day", state(F.col("a"), F.col("d")).alias("state"))
    return s.withColumn("k", (F.row_number().over(Window.partitionBy("agent").orderBy("day")) - 1).cast("long"))


SNAP = "snap AS (SELECT doc_id AS id, source AS agent, doc_id AS minute, text AS content, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)"
LINE = "line AS (SELECT id, agent, k, minute, i - 1 AS pos, trim(l[i]) AS line, substr(sha256(trim(l[i])), 1, 24) AS h FROM (SELECT *, string_split(content, chr(10)) AS l FROM snap), unnest(generate_series(1, len(l))) AS u(i) WHERE length(trim(l[i])) >= 3)"
MEM = "mem AS (SELECT DISTINCT x.agent, x.k + o AS k, x.h FROM line x JOIN (SELECT agent, max(k) AS last FROM snap GROUP BY agent) m ON x.agent = m.agent, unnest([0, 1, 2]) AS t(o) WHERE x.k + o <= last)"
LIVES = "lives AS (SELECT h, agent, min(k) AS first_k, max(k) AS last_k, count(DISTINCT k) AS versions FROM mem GROUP BY h, agent)"
BASE = f"{SNAP}, {LINE}, {MEM}, {LIVES}"
STANCE = "stance AS (SELECT event_id AS id, user_id AS agent, epoch_us(ts) AS us, CAST(props->>'k' AS BIGINT) % 10 AS belief, CASE event_type WHEN 'purchase' THEN 'affirms' WHEN 'error' THEN 'denies' WHEN 'signup' THEN 'doubts' ELSE 'unrelated' END AS label, event_type FROM events)"
DAILY = f"{STANCE}, daily AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY day) - 1 AS k FROM (SELECT agent, us // 86400000000 AS day, CASE WHEN bool_or(label = 'affirms') AND bool_or(label = 'denies') THEN 'both' WHEN bool_or(label = 'affirms') THEN 'holds' WHEN bool_or(label = 'denies') THEN 'denies' ELSE 'absent' END AS state FROM stance GROUP BY 1, 2))"
