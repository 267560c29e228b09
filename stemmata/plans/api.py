"""The read-only surface: named temporary views over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

VIEWS = {"v_cases": "q49_case_summary", "v_trail": "q33_trail_status", "v_score": "q58_final_score", "v_alive": "q26_alive_trace", "v_discover": "q23_belief_rollup_lead", "v_summary": "q37_population_summary", "v_health": "q01_manifest_counts", "v_population": "q80_population", "v_checks": "q50_check_report", "v_marks": "q64_marks"}


def register(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Creates the views and returns them; v_cases comes in order of featured cases, then id."""
    out = {}
    for view, name in VIEWS.items():
        df = catalog.queries()[name](spark, sf_dir)
        if view == "v_cases":
            df = df.orderBy("ord", "belief")
        df.createOrReplaceTempView(view)
        out[view] = df
    return out


def trail(spark: SparkSession, sf_dir: str, belief: int) -> DataFrame:
    """One case; an unknown one is an error, not an empty answer."""
    df = catalog.queries()["q33_trail_status"](spark, sf_dir).where(F.col("belief") == belief)
    if df.isEmpty():
        raise KeyError(f"no such case: {belief}")
    return df


def find_agent(names: DataFrame, query: str, name: str = "name", id_: str = "id") -> str:
    """The id of the agent that a query means: by its exact name, else by the start of an id, else by a part of one name alone.

    None or several at the first of these that finds any is an error that says so.
    """
    tiers = (F.col(name) == query, F.col(id_).startswith(query), F.contains(F.lower(name), F.lit(query.lower())))
    for test in tiers:
        found = names.where(test).select(id_, name).distinct().limit(2).collect()
        if len(found) > 1:
            raise ValueError(f"{query!r} is ambiguous: {', '.join(r[1] for r in found)}, ..")
        if found:
            return found[0][0]
    raise KeyError(f"no such agent: {query!r}")
