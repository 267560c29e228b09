"""How a fact spread, as a forest for each belief: every holder hangs below the agent whose message it most likely came from.

A holder has one parent at most, so parents make a functional graph. A link that closes a loop is left out, and its holder
stands at the top. All steps double the way that they look ahead (pointer jumping): rounds grow with the logarithm of
the longest chain, each is an equality join of a table with itself, written to the shared folder and deleted after the
next. Only a number or two a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written
from .temporal import asof_other


def carriers(holders: DataFrame, mentions: DataFrame, width: int = 1440) -> DataFrame:
    """belief, agent, first_at, parent, carried_at: who last wrote about the belief before the holder took it up, other than
    itself. holders: belief, agent, first_at; mentions: belief, agent, minute."""
    asks = holders.select("belief", "agent", F.col("first_at").alias("minute"))
    told = mentions.select("belief", "agent", "minute").withColumn("value", F.col("agent"))
    seen = asof_other(asks, told, ["belief"], "minute", "agent", "value", width)
    return seen.select("belief", "agent", F.col("minute").alias("first_at"), F.col("other").alias("parent"), F.col("other_at").alias("carried_at"))


def on_loops(links: DataFrame) -> DataFrame:
    """belief, agent: those whose parents lead back to them. links: belief, agent, parent, a parent for each agent at most.

    Where all agents arrive after many steps is a loop, and every agent of a loop is arrived at; enough steps were made when
    twice as many arrive at no fewer.
    """
    to = written(links.where("parent IS NOT NULL").select("belief", "agent", F.col("parent").alias("_to")).distinct())
    arrived = lambda t: t.select("belief", F.col("_to").alias("agent")).distinct()
    n = arrived(to).count()
    while n:
        further = written(to.join(to.select("belief", F.col("agent").alias("_to"), F.col("_to").alias("_next")), ["belief", "_to"]).select("belief", "agent", F.col("_next").alias("_to")))
        dropped(to)
        to, before = further, n
        n = arrived(to).count()
        if n == before:
            break
    return arrived(to)


def forest(links: DataFrame) -> DataFrame:
    """belief, agent, parent, root, depth: links (belief, agent, parent) without those that close a loop; parents that are no agents are roots."""
    loops = on_loops(links).withColumn("_loop", F.lit(True))
    outside = links.where("parent IS NOT NULL").select("belief", F.col("parent").alias("agent")).distinct().join(links.select("belief", "agent"), ["belief", "agent"], "left_anti")
    open_ = links.join(loops, ["belief", "agent"], "left").select("belief", "agent", F.when(F.col("_loop").isNull(), F.col("parent")).alias("parent"))
    every = written(open_.unionByName(outside.withColumn("parent", F.lit(None).cast(links.schema["parent"].dataType))))
    far = written(every.where("parent IS NOT NULL").select("belief", "agent", F.col("parent").alias("root"), F.lit(1).alias("depth")))  # what has no parent stays where it is
    total = lambda t: t.agg(F.sum("depth")).first()[0]
    n = total(far)
    while n:
        ahead = far.select("belief", F.col("agent").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        further = written(far.join(ahead, ["belief", "root"], "left").select("belief", "agent", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
        dropped(far)
        far, before = further, n
        n = total(far)
        if n == before:
            break
    return every.join(far, ["belief", "agent"], "left").withColumns({"root": F.coalesce("root", "agent"), "depth": F.coalesce("depth", F.lit(0))})
