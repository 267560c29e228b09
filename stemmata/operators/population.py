"""All facts of a population: anchors held, new and kept, the beliefs they make up, who has them when, and why.

Everything joins on digests and anchors: versions are rows (agent, k, h) of line digests, lines are one dimension table
(h, anchor) that is extracted once, and a belief is a table of its anchors. `alike` is a table of pairs of line digests
whose texts are similar: two of them that share an anchor state the same fact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.anchors import as_pattern

HOUR = 60  # minutes
SHARED = 2  # strong anchors that make two lines one fact


def line_anchors(lines: DataFrame, extract: Column) -> DataFrame:
    """h, anchor: of each distinct line (h, line); extract: an array of anchors of column line."""
    return lines.groupBy("h").agg(F.min("line").alias("line")).select("h", F.explode(F.array_distinct(extract)).alias("anchor"))


def held(versions: DataFrame, anchors: DataFrame) -> DataFrame:
    """agent, k, anchor: what each version holds. versions: agent, k, h."""
    return versions.join(anchors, "h").select("agent", "k", "anchor").distinct()


def candidates(versions: DataFrame) -> DataFrame:
    """agent, k, h: lines that a version has and the one before it lacks; not of the first version."""
    now = versions.select("agent", "k", "h").distinct()
    votes = now.select("agent", "k", "h", F.lit(1).alias("n")).unionByName(now.select("agent", (F.col("k") + 1).alias("k"), "h", F.lit(-1).alias("n")))
    return votes.groupBy("agent", "k", "h").agg(F.sum("n").alias("n")).where("n > 0 AND k > 0").drop("n")


def anchor_lives(held: DataFrame) -> DataFrame:
    """anchor, agent, first_k, last_k, versions."""
    return held.groupBy("anchor", "agent").agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count("*").alias("versions"))


def anchor_births(new: DataFrame, anchors: DataFrame, lives: DataFrame) -> DataFrame:
    """anchor, agent, k, h: anchors that a candidate line brings and no earlier version of the agent held, with its line."""
    met = new.join(anchors, "h").join(lives.select("anchor", "agent", "first_k"), ["anchor", "agent"]).where("first_k = k")
    return met.groupBy("anchor", "agent", "k").agg(F.min("h").alias("h"))


def beliefs(births: DataFrame, keys: DataFrame, lives: DataFrame, least: int = 3) -> DataFrame:
    """belief, agent, k, h, born, anchor: a row for each anchor of each belief.

    An anchor belongs to the line that brought it first of all agents; the anchors of one line are one belief, kept in
    `least` versions or more. keys: agent, k, minute.
    """
    at = births.join(keys.select("agent", "k", "minute"), ["agent", "k"])
    first = at.groupBy("anchor").agg(F.min(F.struct("minute", "agent", "k", "h")).alias("x")).select("anchor", "x.*")
    kept = first.join(lives.groupBy("anchor").agg(F.sum("versions").alias("versions")), "anchor")
    total = kept.groupBy("agent", "k", "h").agg(F.sum("versions").alias("versions")).where(F.col("versions") >= least).drop("versions")
    name = F.concat_ws(":", "h", "agent", F.col("k").cast("string"))
    return kept.join(total, ["agent", "k", "h"]).select(name.alias("belief"), "agent", "k", "h", F.col("minute").alias("born"), "anchor")


def presence(facts: DataFrame, held: DataFrame, keys: DataFrame) -> DataFrame:
    """belief, agent, k, minute: the versions since its birth that hold an anchor of a belief: the inverted index of a population."""
    index = facts.select("belief", "born", "anchor")
    met = index.join(held, "anchor").select("belief", "born", "agent", "k").distinct()
    return met.join(keys.select("agent", "k", "minute"), ["agent", "k"]).where("minute >= born").select("belief", "agent", "k", "minute")


def holdings(index: DataFrame, keys: DataFrame) -> DataFrame:
    """belief, agent, first_at, last_at, versions, gaps, final_at, held_at_end."""
    final = keys.groupBy("agent").agg(F.max("minute").alias("final_at"))
    run = F.col("k") - F.row_number().over(Window.partitionBy("belief", "agent").orderBy("k"))
    rows = index.withColumn("_run", run).groupBy("belief", "agent").agg(F.min("minute").alias("first_at"), F.max("minute").alias("last_at"), F.count("*").alias("versions"), (F.count_distinct("_run") - 1).alias("gaps"))
    return rows.join(final, "agent").select("belief", "agent", "first_at", "last_at", "versions", "gaps", "final_at", (F.col("last_at") == F.col("final_at")).alias("held_at_end"))


def sharing(pairs: DataFrame, facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """belief, h, n: how many anchors the line has in common with the belief, at least one. An anchor is of one belief, so this grows with the anchors of the lines."""
    return pairs.select("belief", "h").distinct().join(anchors, "h").join(facts.select("belief", "anchor"), ["belief", "anchor"]).groupBy("belief", "h").agg(F.count("*").alias("n"))


def near_lines(facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """a, b: lines with an anchor of a belief, and the belief's birth line: what the similarity of lines is asked of."""
    met = facts.select(F.col("h").alias("b"), "anchor").join(anchors.select(F.col("h").alias("a"), "anchor"), "anchor")
    return met.where("a <> b").select("a", "b").distinct()


def same_fact(pairs: DataFrame, facts: DataFrame, anchors: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """The rows of pairs (belief, h) whose line states the fact of the belief: it is its line, has SHARED anchors in common, or one and
    is similar (alike: a, b, from near_lines())."""
    born = facts.select("belief", F.col("h").alias("_born")).distinct()
    shared = sharing(pairs, facts, anchors)
    good = shared.where(F.col("n") >= SHARED).select("belief", "h").unionByName(born.select("belief", F.col("_born").alias("h")))
    if alike is not None:
        good = good.unionByName(shared.join(born, "belief").join(alike, (F.col("h") == F.col("a")) & (F.col("_born") == F.col("b"))).select("belief", "h"))
    return pairs.join(good.distinct(), ["belief", "h"], "left_semi")


def stating(facts: DataFrame, anchors: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """belief, h: every line that states the fact of a belief, by the rule of same_fact(). An anchor is of one belief, so
    candidates are no more than the anchors of the lines."""
    born = facts.select("belief", F.col("h").alias("_born")).distinct()
    shared = facts.select("belief", "anchor").join(anchors, "anchor").groupBy("belief", "h").agg(F.count("*").alias("n"))
    good = shared.where(F.col("n") >= SHARED).select("belief", "h").unionByName(born.select("belief", F.col("_born").alias("h")))
    if alike is not None:
        one = shared.where(F.col("n") < SHARED).join(born, "belief")
        good = good.unionByName(one.join(alike, (F.col("h") == F.col("a")) & (F.col("_born") == F.col("b"))).select("belief", "h"))
    return good.distinct()


def stated(facts: DataFrame, versions: DataFrame, anchors: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """belief, agent, k: the versions that state the fact of a belief. Lines bring their few beliefs to their versions; no holding is multiplied with the lines of a version."""
    return versions.select("agent", "k", "h").join(stating(facts, anchors, alike), "h").select("belief", "agent", "k").distinct()


def copies(held_by: DataFrame, facts: DataFrame, versions: DataFrame, keys: DataFrame, anchors: DataFrame, alike: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """belief, agent, first_at: holdings of other agents after the birth whose first version states the same fact. told: stated(), if at hand."""
    told = stated(facts, versions, anchors, alike) if told is None else told
    born = facts.select("belief", F.col("agent").alias("_by"), F.col("born")).distinct()
    later = held_by.join(born, "belief").where((F.col("agent") != F.col("_by")) & (F.col("first_at") > F.col("born"))).select("belief", "agent", "first_at")
    first = later.join(keys.select("agent", "k", F.col("minute").alias("first_at")), ["agent", "first_at"])
    return first.join(told, ["belief", "agent", "k"], "left_semi").select("belief", "agent", "first_at").distinct()


def returns(index: DataFrame, facts: DataFrame, versions: DataFrame, keys: DataFrame, anchors: DataFrame, least: int = HOUR, alike: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """belief, agent, gone_at, back_at, same_fact: gaps between two holding versions of an agent, of at least `least` minutes from the
    first version without the fact to the one that has it again, and whether that one states the same fact. told: stated(), if at hand."""
    told = stated(facts, versions, anchors, alike) if told is None else told
    order = Window.partitionBy("belief", "agent").orderBy("k")
    gaps = index.withColumn("_k", F.lag("k").over(order)).where(F.col("k") > F.col("_k") + 1).select("belief", "agent", (F.col("_k") + 1).alias("_gone"), "k", F.col("minute").alias("back_at"))
    gone = keys.select("agent", F.col("k").alias("_gone"), F.col("minute").alias("gone_at"))
    gaps = gaps.join(gone, ["agent", "_gone"]).where(F.col("back_at") - F.col("gone_at") >= least)
    return gaps.join(told.withColumn("_same", F.lit(True)), ["belief", "agent", "k"], "left").select("belief", "agent", "gone_at", "back_at", F.coalesce("_same", F.lit(False)).alias("same_fact"))


def chat_index(chat: DataFrame, extract: Column) -> DataFrame:
    """anchor, agent, minute: what agents mention in chat, by line; chat: agent, minute, text. extract: anchors of column line."""
    lines = chat.select("agent", "minute", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("agent", "minute", F.explode(F.array_distinct(extract)).alias("anchor")).distinct()


def mentions(facts: DataFrame, chat: DataFrame) -> DataFrame:
    """belief, agent, minute: messages that mention an anchor of a belief."""
    return facts.select("belief", "anchor").join(chat, "anchor").select("belief", "agent", "minute").distinct()


def case_patterns(facts: DataFrame) -> DataFrame:
    """belief, pattern: the anchors of a belief as one regular expression."""
    return facts.groupBy("belief").agg(F.array_join(F.sort_array(F.collect_set(as_pattern(F.col("anchor")))), "|").alias("pattern"))


def first_carriers(copied: DataFrame, facts: DataFrame, told: DataFrame) -> DataFrame:
    """belief, agent, first_at, carried_at: the first mention between birth and pickup; a belief has one first mention for all its copies."""
    born = facts.select("belief", "born").distinct()
    first = told.join(born, "belief").where("minute > born").groupBy("belief").agg(F.min("minute").alias("_first"))
    return copied.join(first, "belief", "left").select("belief", "agent", "first_at", F.when(F.col("_first") < F.col("first_at"), F.col("_first")).alias("carried_at"))


def backward(held: DataFrame, keys: DataFrame, least: int = 3) -> DataFrame:
    """anchor, agents, alive, old: anchors of the latest versions followed back. old: an agent that has a history before its first
    scanned version held it there already, so its birth isn't known."""
    ends = keys.groupBy("agent").agg(F.max("k").alias("final_k"), F.min("k").alias("start_k"))
    latest = held.join(ends, "agent").where("k = final_k").select("anchor").distinct()
    lives = anchor_lives(held.join(latest, "anchor", "left_semi")).join(ends, "agent")
    every = lives.groupBy("anchor").agg(F.count("*").alias("agents"), F.count_if(F.col("last_k") == F.col("final_k")).alias("alive"), F.bool_or((F.col("first_k") == F.col("start_k")) & (F.col("start_k") > 0)).alias("old"), F.sum("versions").alias("versions"))
    return every.where(F.col("versions") >= least).drop("versions")


def same_lines(pairs: DataFrame, anchors: DataFrame, alike: DataFrame) -> DataFrame:
    """The rows of pairs (a, b) of lines that state one fact: the same line, SHARED anchors in common, or similar (alike: a, b)."""
    asked = pairs.select("a", "b").distinct()
    shared = asked.join(anchors.select(F.col("h").alias("a"), "anchor"), "a").join(anchors.select(F.col("h").alias("b"), "anchor"), ["b", "anchor"])
    good = shared.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("a", "b")
    good = good.unionByName(asked.where("a = b")).unionByName(alike.select("a", "b")).distinct()
    return pairs.join(good, ["a", "b"], "left_semi")


class Alive:
    """Facts that the latest versions still hold, rolled up from anchors traced back: their own filters and their own holders.

    An anchor counts if it tells facts apart, if nobody who holds it now held it before the scan (it is older then, and its
    birth unknown), and if it was held in `least` versions. Its holders are those whose own first line of it states the fact
    of the birth line. Anchors of one birth line are one belief, with the figures of its best anchor.

    held: agent, k, anchor; births: anchor, agent, k, h; keys: agent, k, minute, all of the scanned versions. lives: those of
    held, if at hand; held isn't read then.
    """

    def __init__(self, held: DataFrame | None, births: DataFrame, keys: DataFrame, telling: Column, least: int = 3, lives: DataFrame | None = None):
        ends = keys.groupBy("agent").agg(F.max("k").alias("final_k"), F.min("k").alias("start_k"))
        lives = (anchor_lives(held) if lives is None else lives).where(telling).join(ends, "agent")
        now = F.col("last_k") == F.col("final_k")
        lives = lives.withColumn("now", now).withColumn("old", now & (F.col("first_k") == F.col("start_k")) & (F.col("start_k") > 0))
        every = lives.groupBy("anchor").agg(F.bool_or("now").alias("now"), F.bool_or("old").alias("old"), F.sum("versions").alias("versions")).where("now")
        self.older = every.where("old").select("anchor")
        at = births.join(keys.select("agent", "k", "minute"), ["agent", "k"])
        first = at.groupBy("anchor").agg(F.min(F.struct("minute", "agent", "k", "h")).alias("x"))
        first = first.select("anchor", F.col("x.minute").alias("born"), F.col("x.agent").alias("by"), F.col("x.h").alias("b"))
        kept = every.where(~F.col("old") & (F.col("versions") >= least)).select("anchor").join(first, "anchor")
        own = births.select("anchor", "agent", F.col("h").alias("a"))
        began = keys.select("agent", F.col("k").alias("first_k"), F.col("minute").alias("first_at"))
        self.holders = lives.join(kept, "anchor").join(began, ["agent", "first_k"]).join(own, ["anchor", "agent"], "left")

    def pairs(self) -> DataFrame:
        """a, b: first lines of other holders, and the birth line."""
        return self.holders.where("agent <> by AND a IS NOT NULL").select("a", "b").distinct()

    def beliefs(self, anchors: DataFrame, alike: DataFrame, disputes: DataFrame, score: Callable[..., Column]) -> DataFrame:
        """by, h, anchors, anchor, agents, rewrites, alive, caught, disputes, lead. alike: a, b; disputes: anchor, disputes; score: of caught, rewrites, alive, disputes."""
        same = same_lines(self.pairs(), anchors, alike).withColumn("_same", F.lit(True))
        mine = self.holders.join(same, ["a", "b"], "left").where((F.col("agent") == F.col("by")) | F.col("_same"))
        rolled = mine.groupBy("anchor", "by", "b").agg(
            F.count("*").alias("agents"),
            F.sum(F.col("last_k") - F.col("first_k")).alias("rewrites"),
            F.count_if("now").alias("alive"),
            F.count_if((F.col("agent") != F.col("by")) & (F.col("first_at") > F.col("born"))).alias("caught"),
        )
        rolled = rolled.where("alive > 0").join(disputes, "anchor", "left").withColumn("disputes", F.coalesce("disputes", F.lit(0)).cast("long"))
        rolled = rolled.withColumn("lead", score(*map(F.col, ("caught", "rewrites", "alive", "disputes"))))
        best = F.min_by(F.struct("anchor", "agents", "rewrites", "alive", "caught", "disputes", "lead"), F.struct(-F.col("lead"), F.col("anchor")))
        return rolled.groupBy("by", F.col("b").alias("h")).agg(F.count("*").alias("anchors"), best.alias("x")).select("by", "h", "anchors", "x.*")


def summary(facts: DataFrame, held_by: DataFrame, copied: DataFrame, came: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row of measures of a population. copied: belief, agent, first_at; came: copied with gap (minutes since a message of
    someone else, null for none) and p (its chance); gaps: of returns()."""
    one = lambda df, **a: df.agg(*[c.alias(n) for n, c in a.items()])
    per = copied.groupBy("belief").agg(F.count("*").alias("n"))
    days = F.col("last_at") - F.col("first_at")
    is_copy = copied.select("belief", "agent", F.lit(True).alias("_copy"))
    h = held_by.join(is_copy, ["belief", "agent"], "left")
    g = F.col("gap")
    flat = [
        one(facts.select("belief").distinct(), beliefs=F.count("*")),
        one(facts, anchors=F.count("*")),
        one(per, spread=F.count("*"), widest=F.coalesce(F.max("n"), F.lit(0)), copies=F.coalesce(F.sum("n"), F.lit(0)), to_one=F.count_if(F.col("n") == 1), to_many=F.count_if(F.col("n") > 1)),
        one(h, holdings=F.count("*"), by_copy=F.count("_copy"), at_end=F.count_if("held_at_end"), copies_at_end=F.count_if(F.col("held_at_end") & F.col("_copy").isNotNull()), dropped=F.count_if(~F.col("held_at_end")), once=F.count_if(F.col("versions") == 1), versions=F.coalesce(F.sum("versions"), F.lit(0)), with_gaps=F.count_if(F.col("gaps") > 0), flickers=F.coalesce(F.sum("gaps"), F.lit(0)), longest=F.max(days), lasting=F.coalesce(F.sum(days), F.lit(0)), lasting_copies=F.coalesce(F.sum(F.when(F.col("_copy"), days)), F.lit(0))),
        one(came, told=F.count("gap"), within=F.count_if(g <= HOUR), late=F.count_if(g > HOUR), untold=F.count_if(g.isNull()), soonest=F.min("gap"), latest=F.max("gap"), expected=F.coalesce(F.sum("p"), F.lit(0.0))),
        one(gaps, returns=F.count("*"), came_back=F.count_if("same_fact"), longest_gap=F.max(F.col("back_at") - F.col("gone_at"))),
        median(h.where("NOT held_at_end"), days).select(F.col("median").alias("median_kept")),
        median(came.where("gap IS NOT NULL"), g).select(F.col("median").alias("median_gap")),
    ]
    out = flat[0]
    for more in flat[1:]:
        out = out.crossJoin(more)  # one row each
    return out


def shares(measured: DataFrame, held_by: DataFrame) -> DataFrame:
    """The row of summary() as the shares and means that eras are compared by; null where there is nothing to share.

    gone: holdings that ended or had a gap; for good: those that ended; back: gaps after which the same fact came again.
    """
    gone = held_by.agg(F.count_if(~F.col("held_at_end") | (F.col("gaps") > 0)).alias("gone"))
    both = measured.crossJoin(gone)  # one row each
    pct = lambda part, whole: F.when(F.col(whole) > 0, 100 * F.col(part) / F.col(whole))
    copies_gone = F.col("by_copy") - F.col("copies_at_end")
    return both.select(
        "beliefs",
        "spread",
        "copies",
        "holdings",
        "gone",
        "widest",
        "came_back",
        pct("spread", "beliefs").alias("spread_pct"),
        F.when(F.col("spread") > 0, F.col("copies") / F.col("spread")).alias("mean_others"),
        pct("within", "copies").alias("within_pct"),
        pct("expected", "copies").alias("expected_pct"),
        pct("gone", "holdings").alias("gone_pct"),
        pct("dropped", "holdings").alias("for_good_pct"),
        F.when(F.col("by_copy") > 0, 100 * copies_gone / F.col("by_copy")).alias("copies_for_good_pct"),
        F.when(F.col("holdings") > 0, F.col("lasting") / F.col("holdings")).alias("mean_kept"),
        "median_kept",
        "median_gap",
    )


def median(df: DataFrame, value: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, median: exact, from counts of distinct values, which combine before the shuffle; null for no value."""
    counts = df.select(*keys, value.alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_v")
    rows = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    inside = lambda place: (F.col("_to") >= place) & (F.col("_to") - F.col("_n") < place)
    middle = (F.max(F.when(inside(low), F.col("_v"))) + F.max(F.when(inside(high), F.col("_v")))) / 2
    return rows.groupBy(*keys).agg(middle.alias("median"))
