"""Trails: one fact followed by stored labels, with the deciding lines checked again by a stronger labeler."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .labels import labelled, overlay, todo
from .temporal import asof_other, covered, following, levels, ranks

ROUNDS = 6


def nodes(marked: DataFrame, keys: list[str] = ("belief", "agent")) -> DataFrame:
    """keys, first and last affirming, first doubting and denying row (k, at, h), and counts, of rows (keys, k, at, h, label)."""
    at = lambda label: F.when(F.col("label") == label, F.struct("at", "k", "h"))
    return marked.groupBy(*keys).agg(F.min(at("affirms")).alias("first"), F.max(at("affirms")).alias("last"), F.min(at("doubts")).alias("doubt"), F.min(at("denies")).alias("denial"), F.count_if(F.col("label") == "affirms").alias("affirming"), F.count("*").alias("seen"))


def decisive(n: DataFrame) -> DataFrame:
    """h: the lines on which the state of some node rests."""
    return n.select(F.explode(F.array("first.h", "last.h", "doubt.h", "denial.h")).alias("h")).where("h IS NOT NULL").distinct()


def rechecked(marked: DataFrame, lines: DataFrame, labeler: Callable[[str], str], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, strong labels): the deciding lines are relabelled until no new line decides, at most `rounds` times.

    marked: belief, agent, k, at, h, label; lines: h, line. Each round reads only lines that no round has read.
    """
    strong = lines.sparkSession.createDataFrame([], "h string, label string")
    now = marked
    for _ in range(rounds):
        new = labelled(todo(lines.join(decisive(nodes(now)), "h", "left_semi"), strong, ["h"]), labeler, "line").select("h", "label")
        new = written(new)  # each row was a call outside: it is made once
        if new.isEmpty():
            break
        strong = strong.unionByName(new)
        now = marked.join(strong.withColumnRenamed("label", "_strong"), "h", "left").withColumn("label", overlay(F.col("_strong"), F.col("label"))).drop("_strong")
    return nodes(now), strong


def heard(mentions: DataFrame, gap: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(belief, lo, hi; belief, agent, lo, hi): times (lo, hi] within `gap` after a message about a belief, and those of them after messages of one agent alone.

    A message counts until `gap` after it or its agent's next one, so an agent is there once at a time; running sums over
    starts and ends say how many agents are there and, of one alone, who.
    """
    own = following(mentions.select("belief", "agent", "minute").distinct(), ["belief", "agent"], "minute", width)
    own = own.withColumn("end", F.least(F.col("minute") + gap, F.coalesce("next_at", F.col("minute") + gap))).withColumn("code", F.xxhash64("agent").cast("decimal(38,0)"))
    step = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).cast("long").alias("agents"), (F.col("code") * sign).cast("decimal(38,0)").alias("code"))
    steps = own.select("belief", F.explode(F.array(step("minute", 1), step("end", -1))).alias("s")).select("belief", "s.*")
    parts = levels(steps, ["belief"], "at", ["agents", "code"], width).where("agents > 0")
    who = mentions.select("belief", "agent").distinct().withColumn("code", F.xxhash64("agent").cast("decimal(38,0)"))
    alone = parts.where("agents = 1").join(who, ["belief", "code"]).select("belief", "agent", F.col("at").alias("lo"), F.col("next_at").alias("hi"))
    # what follows without a break is one: an end that no part starts at, and a start that no part ends at
    edge = parts.select("belief", F.explode(F.array(F.struct(F.col("at"), F.lit(1).cast("long").alias("n")), F.struct(F.col("next_at").alias("at"), F.lit(-1).cast("long").alias("n")))).alias("s")).select("belief", "s.*")
    whole = levels(edge.groupBy("belief", "at").agg(F.sum("n").alias("n")).where("n <> 0"), ["belief"], "at", ["n"], width).where("n > 0")
    return whole.select("belief", F.col("at").alias("lo"), F.col("next_at").alias("hi")), alone


def chance_cases(copied: DataFrame, mentions: DataFrame, keys: DataFrame, spans: DataFrame, gap: int, width: int = 1440) -> DataFrame:
    """copied (belief, agent, first_at) with what was observed and what two null models expect.

    gap: minutes since the latest message of someone else about the belief, null for none; writes, near, p_own: the agent's
    own versions in the belief's span, those within `gap` after such a message, and their share, 0 without a version;
    covered, lo, hi, p_uniform: the part of the span within `gap` after any message. mentions: belief, agent, minute;
    keys: agent, k, minute; spans: belief, lo, hi.

    Copies never meet versions. How many versions of an agent lie in a stretch of time is the difference of two ranks; the
    stretches of a copy are its span and, in it, those within `gap` after others' messages: after anyone's, less those
    after the agent's alone. So rows are the copies times the unbroken stretches of their beliefs, and the versions once.
    """
    asks = copied.select("belief", "agent", F.col("first_at").alias("minute"), F.col("first_at").alias("value"))
    seen = asof_other(asks, mentions.withColumn("value", F.col("minute")), ["belief"], "minute", "agent", "value", width)
    found = seen.select("belief", "agent", F.col("minute").alias("first_at"), (F.col("minute") - F.col("other_at")).alias("gap"))
    holders = copied.select("belief", "agent").distinct().join(spans, "belief")
    anyone, alone = heard(mentions.join(copied.select("belief").distinct(), "belief", "left_semi"), gap, width)
    stretch = lambda df, on, sign: df.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).join(holders, on).select("belief", "agent", F.greatest("_lo", F.col("lo") - 1).alias("a"), F.least("_hi", "hi").alias("b"), F.lit(0).alias("own"), F.lit(sign).alias("near")).where("a < b")
    every = holders.select("belief", "agent", (F.col("lo") - 1).alias("a"), F.col("hi").alias("b"), F.lit(1).alias("own"), F.lit(0).alias("near"))
    every = written(every.unionByName(stretch(anyone, ["belief"], 1)).unionByName(stretch(alone, ["belief", "agent"], -1)))
    place = ranks(every.select("agent", F.explode(F.array("a", "b")).alias("minute")), keys, ["agent"], "minute", width)
    at = lambda c: place.select("agent", F.col("minute").alias(c), F.col("rank").alias(f"_{c}"))
    counted = every.join(at("a"), ["agent", "a"]).join(at("b"), ["agent", "b"]).withColumn("n", F.col("_b") - F.col("_a"))
    own = counted.groupBy("belief", "agent").agg(F.sum(F.col("n") * F.col("own")).alias("writes"), F.sum(F.col("n") * F.col("near")).alias("near"))
    points = mentions.select("belief", "minute").distinct().join(spans, "belief").where("minute BETWEEN lo AND hi")
    measure = covered(points, ["belief"], "minute", gap, "lo", "hi", width).select("belief", "covered")
    out = found.join(own, ["belief", "agent"], "left").join(spans, "belief").join(measure, "belief", "left").fillna(0, ["writes", "near", "covered"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.withColumn("p_own", share(F.col("near"), F.col("writes"))).withColumn("p_uniform", share(F.col("covered"), F.col("hi") - F.col("lo")))


def draws(spans: DataFrame, n: int, seed: int) -> DataFrame:
    """belief, at: n seeded draws of each span (belief, lo, hi), uniform in [lo, hi).

    A counter-based generator: the number of a draw is hashed with the seed and the belief, so a draw is the same on any
    partitioning and after any retry, and no draw waits for another.
    """
    rows = spans.select("belief", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("no"))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("belief").cast("string"), F.col("no").cast("string"))), 1, 13)
    share = F.conv(digits, 16, 10).cast("double") / float(1 << 52)
    return rows.select("belief", (F.col("lo") + F.floor(share * (F.col("hi") - F.col("lo")))).alias("at"))


def drawn_cases(copied: DataFrame, mentions: DataFrame, spans: DataFrame, gap: int, n: int, seed: int, width: int) -> DataFrame:
    """belief, agent, near, closed, span: how many of n draws of a copy's belief fall within `gap` after someone else's message,
    and the same in closed form: the length of that time in the span. copied: belief, agent; mentions: belief, agent, minute; spans: belief, lo, hi, in one unit of time.

    Draws are numbered once a belief; a stretch of time has the difference of two ranks. Only beliefs with a stretch are drawn
    for: where no message is, no draw comes after one.
    """
    of = spans.join(copied.select("belief").distinct(), "belief", "left_semi")
    anyone, alone = heard(mentions.join(of.select("belief"), "belief", "left_semi"), gap, width)
    clip = lambda df: df.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).join(of, "belief").withColumn("a", F.greatest("_lo", F.col("lo") - 1)).withColumn("b", F.least("_hi", "hi")).where("a < b")
    # ranks count (a, b], so a stretch that began before the span starts at lo - 1 for draws, and at lo for its length
    length = (F.col("b") - F.greatest("a", "lo")).alias("length")
    every = written(clip(anyone.withColumn("agent", F.lit(None).cast("string"))).unionByName(clip(alone)).select("belief", "agent", "a", "b", length))
    told = of.join(every.select("belief").distinct(), "belief", "left_semi")
    place = ranks(every.select("belief", F.explode(F.array("a", "b")).alias("at")), draws(told, n, seed), ["belief"], "at", width)
    at = lambda c: place.select("belief", F.col("at").alias(c), F.col("rank").alias(f"_{c}"))
    counted = every.join(at("a"), ["belief", "a"]).join(at("b"), ["belief", "b"])
    sums = counted.groupBy("belief", "agent").agg(F.sum(F.col("_b") - F.col("_a")).alias("near"), F.sum("length").alias("closed"))
    all_, own = sums.where("agent IS NULL").drop("agent"), sums.where("agent IS NOT NULL").withColumnsRenamed({"near": "_near", "closed": "_closed"})
    out = copied.select("belief", "agent").distinct().join(of, "belief").join(all_, "belief", "left").join(own, ["belief", "agent"], "left")
    less = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"_{c}"), F.lit(0))
    return out.select("belief", "agent", less("near").alias("near"), less("closed").alias("closed"), (F.col("hi") - F.col("lo")).alias("span"))


def chance_summary(tests: DataFrame, era: str) -> DataFrame:
    """era, copies, within, expected: observed and expected pickups shortly after a message (gap_ok, p)."""
    return tests.groupBy(era).agg(F.count("*").alias("copies"), F.count_if(F.col("gap_ok")).alias("within"), F.sum("p").alias("expected"))
