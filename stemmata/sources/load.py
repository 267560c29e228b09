"""Loading of gzipped JSON Lines exports by explicit schemas.

gz files are not splittable, so rows are dealt out by the sort key right after the scan; the big tables are written
partitioned by agent and sorted by time inside each partition, so that row groups can be skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import row_counts


def _none(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return df


@dataclass(frozen=True)
class Spec:
    """A table: its source file, typed columns, what is derived at load, and how it is laid out."""

    table: str
    source: str
    columns: str
    derive: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] = field(default=_none)
    sort: tuple[str, ...] = ()
    by_agent: bool = False
    needs: tuple[str, ...] = ()  # tables that derive reads


def _events(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    f = lambda name: F.get_json_object("data", f"$.{name}")
    return df.select("*", f("actionType").alias("action_type"), F.coalesce(f("agentId"), F.when(f("actionType") == "AGENT_TALK", f("speakerId"))).alias("agent_id"), f("roomId").alias("room_id"))


def _turns(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Turns with the agent of their session; one whose session is missing or null keeps a null agent."""
    sessions = tables["computer_use_sessions"].select(F.col("id").alias("_session"), "agent_id")
    return df.join(sessions, F.col("session_id") == F.col("_session"), "left").drop("_session")


#: The specs of the model's tables; another export gives its own.
SPECS = (
    Spec("agents", "agents", "id string, name string, model_string string, is_participating boolean, created_at timestamp_ntz"),
    Spec("goals", "goals", "id string, goal string, start_time timestamp_ntz, end_time timestamp_ntz", sort=("start_time",)),
    Spec("agent_goals", "agent_goals", "id string, agent_id string, name string, short_name string, description string, start_time timestamp_ntz, end_time timestamp_ntz"),
    Spec("chat_rooms", "chat_rooms", "id string, name string, created_at timestamp_ntz, deleted_at timestamp_ntz"),
    Spec("summaries", "summaries", "id string, type string, summary_target string, summary_date date, content string, generated_by string, created_at timestamp_ntz"),
    Spec("events", "events", "id string, event_index bigint, data string, created_at timestamp_ntz", _events, ("created_at", "event_index")),
    Spec("chat_messages", "chat_messages", "id string, speaker_type string, agent_speaker_id string, user_speaker_id string, content string, room_id string, created_at timestamp_ntz", sort=("created_at",)),
    Spec("computer_use_sessions", "computer_use_sessions", "id string, agent_id string, session_goal string, created_at timestamp_ntz", sort=("agent_id", "created_at")),
    Spec("agent_memories", "agent_memories", "id string, agent_id string, content string, created_at timestamp_ntz", sort=("created_at", "id"), by_agent=True),
    Spec("computer_use_turns", "computer_use_turns", "id string, session_id string, agent_action string, output string, error string, system string, screenshot_is_redacted boolean, created_at timestamp_ntz", _turns, ("created_at", "id"), True, ("computer_use_sessions",)),
    Spec("turn_messages", "computer_use_turns", "id string, agent_messages string"),
)


def read_source(spark: SparkSession, spec: Spec, folder: str) -> DataFrame:
    """The spec's columns of its file, <folder>/<source>.jsonl.gz; nested JSON in a string column stays raw text."""
    return spark.read.schema(spec.columns).json(f"{folder}/{spec.source}.jsonl.gz")


def load(spark: SparkSession, folder: str, target: str, only: Iterable[str] | None = None, specs: tuple[Spec, ...] = SPECS) -> dict[str, DataFrame]:
    """Writes the tables as Parquet under target and returns them. Unknown names in `only` are an error."""
    names = {s.table for s in specs}
    if only is not None and (unknown := set(only) - names):
        raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}; known: {', '.join(sorted(names))}")
    tables: dict[str, DataFrame] = {}
    for spec in specs:
        if only is not None and spec.table not in only:
            continue
        # a table that this call doesn't load stands from an earlier one, or there is nothing to derive from
        stored = {need: spark.read.parquet(f"{target}/{need}") for need in spec.needs if need not in tables}
        df = spec.derive(read_source(spark, spec, folder), {**stored, **tables})
        order = [F.col(c).asc_nulls_last() for c in (("agent_id", *spec.sort) if spec.by_agent else spec.sort)]
        if order:  # dealt by agent or by time range and sorted within; row groups are skipped without a global order
            df = (df.repartition("agent_id") if spec.by_agent else df.repartitionByRange(*order)).sortWithinPartitions(*order)
        df.write.mode("overwrite").parquet(f"{target}/{spec.table}")
        tables[spec.table] = spark.read.parquet(f"{target}/{spec.table}")
    return tables


def provenance(spark: SparkSession, exported_at: str, revision: str) -> DataFrame:
    """One row: exported_at (naive UTC), revision, loaded_at, engine_version."""
    return spark.range(1).select(F.to_timestamp_ntz(F.to_utc_timestamp(F.to_timestamp(F.lit(exported_at)), "UTC").cast("string")).alias("exported_at"), F.lit(revision).alias("revision"), F.localtimestamp().alias("loaded_at"), F.lit(spark.version).alias("engine_version"))


def reconcile(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    return row_counts(tables, manifest)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent row."""
    return child.join(parent.select(key), key, "left_anti")
