"""Line diffs and the lineage of facts through the versions of many agents.

Everything works on rows (agent, k, key); key is a line hash, a word or an anchor.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import pair_lines
from ..sources.scratch import written

MIN_VERSIONS = 3
SPAN = 64  # versions whose differences are told together


def multiset_diff(lines: DataFrame, agent: str = "agent", k: str = "k", line: str = "line") -> DataFrame:
    """agent, k, line, change (added, removed), n: multiset differences of consecutive versions, as counts.

    Counts by (agent, k, line) meet the counts of version k - 1 in one aggregation: each row also votes, negatively,
    for the version after it. The vote of an agent's last version is left out.
    """
    count = lines.groupBy(agent, k, line).agg(F.count("*").alias("n"))
    last = lines.groupBy(agent).agg(F.max(k).alias("_last"))
    votes = count.select(agent, k, line, "n").unionByName(count.select(agent, (F.col(k) + 1).alias(k), line, (-F.col("n")).alias("n")))
    net = votes.groupBy(agent, k, line).agg(F.sum("n").alias("n")).where("n <> 0").join(last, agent).where(F.col(k) <= F.col("_last")).drop("_last")
    return net.select(agent, k, line, F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), F.abs("n").alias("n"))


def paired_diff(changes: DataFrame, anchors: Column | None = None) -> DataFrame:
    """agent, k, kind (added, changed, reworded, vanished), old, new: diffs with similar lines paired.

    changes: agent, k, line, change, n, pos. One group is the difference of two versions.
    """

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pos", "line"])
        rep = lambda kind: [x for x, n in zip(group.line[group.change == kind], group.n[group.change == kind]) for _ in range(int(n))]
        out = pd.DataFrame(_paired(rep("added"), rep("removed")), columns=["kind", "old", "new"])
        out.insert(0, "k", group.k.iloc[0])
        out.insert(0, "agent", group.agent.iloc[0])
        return out

    return changes.groupBy("agent", "k").applyInPandas(pair, "agent string, k long, kind string, old string, new string")


def _paired(added: list[str], removed: list[str]) -> list[tuple[str, str | None, str | None]]:
    """kind, old, new of one difference."""
    pairs = pair_lines(added, removed)
    left = list(added)
    for _, new in pairs:
        left.remove(new)
    olds = {old for old, _ in pairs}
    return [("added", None, x) for x in left] + [("paired", o, n) for o, n in pairs] + [("vanished", x, None) for x in removed if x not in olds]


def paired_versions(versions: DataFrame, span: int = SPAN) -> DataFrame:
    """agent, k, kind, old, new: paired_diff() of the multiset_diff() of consecutive versions, from their lines in order.

    versions: agent, k, lines, last: rows of one k count together, a k without rows has no lines, and nothing is told after
    the agent's version `last`. Versions are dealt out once, `span` consecutive ones of an agent together; the last of
    these goes to the next ones too. A line's place is its first one in the new version, or else in the old one.
    """
    part = F.floor(F.col("k") / span)
    dealt = versions.where("agent IS NOT NULL AND k <= last").select("agent", "k", "lines", "last", F.explode(F.when(F.col("k") % span == span - 1, F.array(part, part + 1)).otherwise(F.array(part))).alias("part"))

    def diffs(group: pd.DataFrame) -> pd.DataFrame:
        count: dict[int, Counter[str]] = defaultdict(Counter)
        place: dict[int, dict[str, int]] = defaultdict(dict)
        for k, lines in zip(group.k.tolist(), group.lines):
            count[k].update(lines)
            for pos, x in enumerate(lines):
                place[k][x] = min(pos, place[k].get(x, pos))
        first, rows = int(group.part.iloc[0]) * span, []
        for k in range(max(1, first), min(first + span - 1, int(group["last"].iloc[0])) + 1):
            new, old, at = count[k], count[k - 1], place[k - 1] | place[k]
            order = lambda some: [x for x in sorted(some, key=lambda x: (at[x], x)) for _ in range(some[x])]
            rows += [(group.agent.iloc[0], k, *row) for row in _paired(order(new - old), order(old - new))]
        return pd.DataFrame(rows, columns=["agent", "k", "kind", "old", "new"])

    return dealt.groupBy("agent", "part").applyInPandas(diffs, "agent string, k long, kind string, old string, new string")


def lives(held: DataFrame, key: str, agent: str = "agent", k: str = "k") -> DataFrame:
    """key, agent, first_k, last_k, versions."""
    return held.groupBy(key, agent).agg(F.min(k).alias("first_k"), F.max(k).alias("last_k"), F.count_distinct(k).alias("versions"))


def births(changes: DataFrame, lived: DataFrame, key: str, history_from: int = 0) -> DataFrame:
    """agent, k, key: added keys that the agent held at no earlier version since history_from; not at its first version."""
    added = changes.where(F.col("change") == "added").select("agent", "k", key).where(F.col("k") > history_from)
    return added.join(lived.select(key, "agent", "first_k"), [key, "agent"], "left").where(F.col("first_k").isNull() | (F.col("first_k") >= F.col("k"))).select("agent", "k", key)


def beliefs(lived: DataFrame, final_k: DataFrame, disputes: DataFrame, key: str) -> DataFrame:
    """key, agents, rewrites, versions, alive, caught, disputes: keys held in MIN_VERSIONS versions or more, over all agents."""
    rolled = lived.join(final_k, "agent").groupBy(key).agg(
        F.count("*").alias("agents"),
        F.sum(F.col("last_k") - F.col("first_k")).alias("rewrites"),
        F.sum("versions").alias("versions"),
        F.count_if(F.col("last_k") == F.col("final_k")).alias("alive"),
        F.min(F.struct("first_k", "agent")).alias("_born"),
    )
    rolled = rolled.where(F.col("versions") >= MIN_VERSIONS).withColumn("caught", F.col("agents") - 1)
    return rolled.join(disputes, key, "left").select(key, "agents", "rewrites", "versions", "alive", "caught", F.coalesce("disputes", F.lit(0)).cast("long").alias("disputes"), F.col("_born.agent").alias("born_by"), F.col("_born.first_k").alias("born_k"))


def lead(caught: Column, rewrites: Column, alive: Column, disputes: Column) -> Column:
    """Score of a lead: spread, persistence, whether somebody still holds it, and how often it is disputed."""
    return (1 + caught) * F.log2(2 + rewrites) * F.when(alive > 0, 2).otherwise(1) * (1 + F.log2(1 + disputes))


def alive_lead(caught: Column, rewrites: Column, alive: Column, disputes: Column) -> Column:
    return (1 + caught) * F.log2(2 + rewrites) * (1 + alive) * (1 + F.log2(1 + disputes))


def disputes(rows: DataFrame, doc: str, key: str, against: str) -> DataFrame:
    """key, disputes: how many distinct disputing keys the documents that hold a key have.

    The disputing keys of a document are one set; a key meets each distinct set once, however many documents share it.
    """
    sets = rows.where(against).groupBy(doc).agg(F.sort_array(F.collect_set(key)).alias("_set")).withColumn("_sign", F.sha2(F.array_join("_set", ","), 256))
    met = rows.select(doc, key).join(sets.select(doc, "_sign"), doc).select(key, "_sign").distinct()
    each = sets.groupBy("_sign").agg(F.first("_set").alias("_set")).select("_sign", F.explode("_set").alias("_x"))
    return met.join(each, "_sign").groupBy(key).agg(F.count_distinct("_x").alias("disputes"))


def copies(lived: DataFrame, key: str, first: str = "first_at") -> DataFrame:
    """key, source, agent, born, first: every other agent that held a key after its first holder. Ties: the smaller agent is first."""
    w = Window.partitionBy(key).orderBy(first, "agent")
    rows = lived.withColumn("source", F.first("agent").over(w)).withColumn("born", F.first(first).over(w))
    return rows.where((F.col("agent") != F.col("source")) & (F.col(first) > F.col("born"))).select(key, "source", "agent", "born", F.col(first))


def spread_tree(edges: DataFrame, root: str, rounds: int = 64) -> DataFrame:
    """agent, parent, depth: children join under their source, level by level; an agent is placed once, so no cycle closes."""
    roots = edges.sparkSession.createDataFrame([(root,)], "agent string")
    return _trees(edges, roots, rounds).drop("root")


def spread_trees(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """agent, root, parent, depth: the trees below every source that is nobody's child, and below the smallest source."""
    roots = edges.select(F.col("source").alias("agent")).join(edges.select("agent"), "agent", "left_anti")
    first = edges.agg(F.min("source").alias("agent")).where("agent IS NOT NULL")
    return _trees(edges, roots.unionByName(first).distinct(), rounds)


def _trees(edges: DataFrame, roots: DataFrame, rounds: int) -> DataFrame:
    edges = written(edges.select("source", "agent").distinct())  # read once a level
    placed = written(roots).select("agent", F.col("agent").alias("root"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    level = placed
    for depth in range(1, rounds + 1):
        step = edges.join(level.select(F.col("agent").alias("source"), "root"), "source").join(placed.select("agent", "root"), ["agent", "root"], "left_anti")
        level = step.groupBy("agent", "root").agg(F.min("source").alias("parent")).withColumn("depth", F.lit(depth)).select("agent", "root", "parent", "depth")
        level = written(level)
        if level.isEmpty():
            break
        placed = placed.unionByName(level)
    return placed
