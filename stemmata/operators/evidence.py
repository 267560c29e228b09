"""Evidence for a line: what its agent saw in the window before writing it, ranked, cut to a budget, and verified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted_in
from .temporal import budget_fill

#: Sizes of items and windows, in characters and minutes.
ITEM_CHARS, TOTAL_CHARS, TOTAL_CHARS_V2, LOOK_BACK = 1200, 45_000, 24_000, 30
OWN_SOURCES = ("session_summary", "consolidate")
OUTSIDE = ("human", "turn", "search")


def gathered(sources: list[DataFrame]) -> DataFrame:
    """source, id, agent, at, speaker, text of several logs as one."""
    return reduce(DataFrame.unionByName, [s.select("source", "id", "agent", "at", "speaker", "text") for s in sources])


def in_window(lines: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Pairs of lines (line_id, agent, start, written) and items of the same agent with start < at <= written.

    Equality on agent and time bucket; items after the window's end or before its start go by the residual.
    """
    l = lines.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("written") / width))))
    return l.join(items.withColumn("_b", F.floor(F.col("at") / width)), ["agent", "_b"]).where((F.col("at") > F.col("start")) & (F.col("at") <= F.col("written"))).drop("_b")


def own_narration(agent_name: Column, summaries: bool = True) -> Column:
    """The agent's own chat, and its summaries: never evidence for its own memory."""
    own = (F.col("source") == "chat") & (F.col("speaker") == agent_name)
    return own | F.col("source").isin(*OWN_SOURCES) if summaries else own


def rank_v1(mentions: Column, agent_name: Column) -> Column:
    """Five classes: mentions from outside, other mentions, humans, other agents, the rest."""
    other = (F.col("source") == "chat") & (F.col("speaker") != agent_name)
    return F.when(mentions & F.col("source").isin(*OUTSIDE), 0).when(mentions, 1).when(F.col("source") == "human", 2).when(other, 3).otherwise(4)


def rank_v2(about: Column, number: Column, agent_name: Column) -> Column:
    """Six classes: about the fact from outside, about it from others, a bare number from outside, humans, others, the rest."""
    own, outside = own_narration(agent_name), F.col("source").isin(*OUTSIDE)
    return F.when(about & outside, 0).when(about & ~own, 1).when(number & outside, 2).when(F.col("source") == "human", 3).when((F.col("source") == "chat") & ~own, 4).otherwise(5)


def picked(pairs: DataFrame, rank: Column, budget: int = TOTAL_CHARS) -> DataFrame:
    """The items of each line that fit the budget, best class first, then by time."""
    sized = pairs.withColumn("rank", rank).withColumn("size", F.least(F.char_length("text"), F.lit(ITEM_CHARS)))
    return budget_fill(sized, ["line_id"], "rank", "at", "id", "size", budget)


def verified(verdicts: DataFrame, rows: DataFrame, agent_name: Column, lenient: bool = True) -> DataFrame:
    """line_id, label, quotes, dropped: verdicts (line_id, label, item, quote) whose quotes stand in the rows they cite.

    A verdict that says something about the fact without one verified quote becomes no_evidence.
    """
    joined = verdicts.join(rows.select("line_id", F.col("id").alias("item"), "source", "speaker", "text"), ["line_id", "item"], "left")
    good = quoted_in(F.col("quote"), F.col("text"), lenient) & ~F.coalesce(own_narration(agent_name, summaries=lenient), F.lit(True))
    counted = joined.groupBy("line_id", "label").agg(F.count_if(good).alias("quotes"), F.count_if(F.col("quote").isNotNull() & ~F.coalesce(good, F.lit(False))).alias("dropped"))
    claims = F.col("label").isin("supported", "contradicted", "hearsay")
    return counted.withColumn("label", F.when(claims & (F.col("quotes") == 0), "no_evidence").otherwise(F.col("label")))
