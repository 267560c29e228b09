"""Cases: a fact with its bounds, corrections, expectations, and what a reader of it is shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
LEAD, TAIL = 3, 21  # days before a goal starts and after it ends
SHOWN, ITEMS, NEWEST = 20, 14, 10


def scopes(goals: DataFrame, asked: DataFrame, now: int, lead: int = LEAD, tail: int = TAIL) -> DataFrame:
    """pattern, goal, low, high: for each asked pattern the first goal (goal, start, end in microseconds) that holds it, any case.

    The bounds reach `lead` days before its start and `tail` days past its end; a goal without an end lasts until `now`.
    Of goals that start together the smaller name is first, then the earlier end. A pattern that no goal holds has null
    bounds, for the caller to refuse.
    """
    met = asked.join(goals, F.contains(F.lower("goal"), F.lower("pattern")), "left")
    order = F.struct(*[x for c in ("start", "goal", "end") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])  # nulls last
    first = met.groupBy("pattern").agg(F.min_by(F.struct("goal", "start", "end"), order).alias("x"))
    return first.select("pattern", "x.goal", (F.col("x.start") - lead * DAY).alias("low"), F.when(F.col("x.start").isNotNull(), F.coalesce("x.end", F.lit(now)) + tail * DAY).alias("high"))


def held_after_correction(told: DataFrame, human: Column) -> DataFrame:
    """belief, agent, fixed_at, held, last_at: what an agent still affirmed after the first time a human denied the fact."""
    fix = told.where(human & (F.col("label") == "denies")).groupBy("belief").agg(F.min("us").alias("fixed_at"))
    after = told.where(~human & (F.col("label") == "affirms")).join(fix, "belief").where("us > fixed_at")
    return after.groupBy("belief", "agent", "fixed_at").agg(F.count("*").alias("held"), F.max("us").alias("last_at"))


def exposure(told: DataFrame) -> DataFrame:
    """belief, agent, said_first, exposed_by, exposed_at: who first affirmed a fact to an agent, at any time; nobody to the first of all.

    The first two speakers of a fact suffice: the first is everybody's, but its own.
    """
    says = told.where("label = 'affirms'").groupBy("belief", "agent").agg(F.min(F.struct("us", "id")).alias("x")).select("belief", F.struct("x.us", "x.id", "agent").alias("x"))
    two = says.groupBy("belief").agg(F.min("x").alias("one"))
    first = two.select("belief", F.col("one.agent").alias("first_agent"), F.col("one.us").alias("first_at"))
    agents = told.select("belief", "agent").distinct().join(first, "belief", "left")
    own = F.coalesce(F.col("agent") == F.col("first_agent"), F.lit(False))
    return agents.select("belief", "agent", own.alias("said_first"), F.when(~own, F.col("first_agent")).alias("exposed_by"), F.when(~own, F.col("first_at")).alias("exposed_at"))


def known_case_scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """belief, birth_ok, n_found, n_expected, correction_ok: expectations about known cases against what was found.

    found: belief, agent, status, born_here; expected: belief, birth (null: none expected), holders (array), corrected (null).
    """
    held = F.col("status") != "never"
    rolled = found.groupBy("belief").agg(F.collect_set(F.when(held, F.col("agent"))).alias("held"), F.max(F.when(F.col("born_here"), F.col("agent"))).alias("born"), F.bool_or(F.col("status") == "corrected").alias("was_corrected"))
    both = expected.join(rolled, "belief", "left")
    n = F.size(F.array_intersect(F.coalesce("holders", F.array().cast(expected.schema["holders"].dataType)), F.coalesce("held", F.array().cast(expected.schema["holders"].dataType))))
    return both.select("belief", F.when(F.col("birth").isNotNull(), F.coalesce(F.col("birth") == F.col("born"), F.lit(False))).alias("birth_ok"), n.cast("long").alias("n_found"), F.size("holders").cast("long").alias("n_expected"), F.when(F.col("corrected").isNotNull(), F.col("corrected") == F.coalesce("was_corrected", F.lit(False))).alias("correction_ok"))


def coverage(lines: DataFrame, stored: DataFrame, group: list[str], key: str = "h") -> DataFrame:
    """group, lines, labelled: distinct lines, and those that have a stored label."""
    rows = lines.select(*group, key).distinct().join(stored.select(key, F.lit(1).alias("_x")).distinct(), key, "left")
    return rows.groupBy(*group).agg(F.count("*").alias("lines"), F.count("_x").alias("labelled"))


def usage(calls: DataFrame, group: list[str], measures: list[str]) -> DataFrame:
    """group, calls and the sum of each measure over the call log; a missing value counts nothing."""
    return calls.groupBy(*group).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def shown(rows: DataFrame, group: list[str], item: str, n: int = SHOWN) -> DataFrame:
    """group, total, first: how many rows, and the smallest n of them, without gathering the others."""
    w = Window.partitionBy(*group).orderBy(item)
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("first"))
    return rows.groupBy(*group).agg(F.count("*").alias("total")).join(top, group)


def window_view(pairs: DataFrame, rank: Column, n: int = ITEMS) -> DataFrame:
    """line_id, place, id: the n best items of each window by rank and time, shown in order of time."""
    best = Window.partitionBy("line_id").orderBy("_rank", "at", "id")
    kept = pairs.withColumn("_rank", rank).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n)
    return kept.select("line_id", F.row_number().over(Window.partitionBy("line_id").orderBy("at", "id")).cast("long").alias("place"), "id")


def newest_matches(versions: DataFrame, agent: str, order: str, match: Column, n: int = NEWEST) -> DataFrame:
    """agent, read, matching, newest_match: the n newest versions of each agent, and how many of them match."""
    rows = versions.select(agent, order, match.alias("_m"))
    top = rows.withColumn("_r", F.row_number().over(Window.partitionBy(agent).orderBy(F.desc(order)))).where(F.col("_r") <= n)
    return top.groupBy(agent).agg(F.count("*").alias("read"), F.count_if("_m").alias("matching"), F.max(F.when(F.col("_m"), F.col(order))).alias("newest_match"))


def rendered(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """place, line: rows as lines of text for a terminal, numbers to the right, behind a line of names at place 0."""
    numeric = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short")}
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns}
    wide = rows.agg(*[F.max(F.greatest(F.char_length(text[c]), F.lit(len(c)))).alias(c) for c in columns]).first()
    pad = [F.lpad(text[c], wide[c] or len(c), " ") if c in numeric else F.rpad(text[c], wide[c] or len(c), " ") for c in columns]
    head = "  ".join(c.rjust(wide[c] or len(c)) if c in numeric else c.ljust(wide[c] or len(c)) for c in columns).rstrip()
    names = rows.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(head).alias("line"))
    w = Window.orderBy(*order)  # what a terminal shows: few rows
    return names.unionByName(rows.select(F.row_number().over(w).alias("place"), F.rtrim(reduce(lambda a, b: F.concat(a, F.lit("  "), b), pad)).alias("line")))
