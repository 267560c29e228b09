"""Evidence windows, marks, ticks, chance: what views and checkers ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import temporal as T
from ..operators.trails import chance_summary
from .registry import query
from .relational import scaled
from .timeline import DAY, TRAIL, trail_status
from .views import STANCE, stances

HOUR = 3_600_000_000
LINES = f"{STANCE}, l AS (SELECT id AS line_id, agent, us - 43200000000 AS start, us AS written, belief FROM stance WHERE label = 'denies')"
ITEMS = "i AS (SELECT id, agent, us AS seen, CASE event_type WHEN 'view' THEN 'turn' WHEN 'click' THEN 'human' WHEN 'signup' THEN 'session_summary' ELSE 'chat' END AS source, 'u' || (id % 3) AS speaker, belief, 400 + (id * 53) % 1600 AS size FROM stance)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items seen in the twelve hours before each line that denies."""
    s = stances(spark, sf_dir)
    l = s.where("label = 'denies'").select(F.col("id").alias("line_id"), "agent", (F.col("us") - 12 * HOUR).alias("start"), F.col("us").alias("written"), F.col("belief").alias("about"))
    source = F.when(F.col("event_type") == "view", "turn").when(F.col("event_type") == "click", "human").when(F.col("event_type") == "signup", "session_summary").otherwise("chat")
    i = s.select("id", "agent", F.col("us").alias("at"), source.alias("source"), F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("speaker"), "belief")
    # texts are made after the join, so none is shuffled
    return E.in_window(l, i, 12 * HOUR).withColumn("text", F.repeat(F.lit("x"), (400 + (F.col("id") * 53) % 1600).cast("int")))


@query("q62_evidence_ranks", f"WITH {LINES}, {ITEMS}, p AS (SELECT l.line_id, i.*, l.belief AS about FROM l JOIN i ON i.agent = l.agent AND i.seen > l.start AND i.seen <= l.written), r AS (SELECT *, CASE WHEN belief = about AND source IN ('human', 'turn', 'search') THEN 0 WHEN belief = about AND NOT (source = 'chat' AND speaker = 'u0' OR source IN ('session_summary', 'consolidate')) THEN 1 WHEN belief % 5 = about % 5 AND source IN ('human', 'turn', 'search') THEN 2 WHEN source = 'human' THEN 3 WHEN source = 'chat' AND speaker <> 'u0' THEN 4 ELSE 5 END AS rank FROM p) SELECT rank, source, count(*) AS n, sum(least(size, 1200))::BIGINT AS chars FROM r GROUP BY 1, 2")
def evidence_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = E.rank_v2(F.col("belief") == F.col("about"), F.col("belief") % 5 == F.col("about") % 5, F.lit("u0"))
    return windows(spark, sf_dir).groupBy(rank.alias("rank"), "source").agg(F.count("*").alias("n"), F.sum(F.least(F.char_length("text"), F.lit(E.ITEM_CHARS))).alias("chars"))


@query("q63_evidence_picked", f"WITH RECURSIVE {LINES}, {ITEMS}, p AS (SELECT l.line_id, i.id, i.seen, least(size, 1200) AS size, CASE WHEN i.belief = l.belief AND source IN ('human', 'turn', 'search') THEN 0 WHEN i.belief = l.belief THEN 1 WHEN source = 'human' THEN 2 WHEN source = 'chat' AND speaker <> 'u0' THEN 3 ELSE 4 END AS rank FROM l JOIN i ON i.agent = l.agent AND i.seen > l.start AND i.seen <= l.written), o AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY rank, seen, id) AS n FROM p), f AS (SELECT line_id, n, id, CASE WHEN size <= 2000 THEN size ELSE 0 END AS used, size <= 2000 AS ok FROM o WHERE n = 1 UNION ALL SELECT o.line_id, o.n, o.id, CASE WHEN used + o.size <= 2000 THEN used + o.size ELSE used END, used + o.size <= 2000 FROM f JOIN o ON o.line_id = f.line_id AND o.n = f.n + 1) SELECT line_id, id FROM f WHERE ok")
def evidence_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.picked(windows(spark, sf_dir), E.rank_v1(F.col("belief") == F.col("about"), F.lit("u0")), 2000).select("line_id", "id")


@query("q64_marks", f"WITH {STANCE}, n AS ({TRAIL}) SELECT belief, agent, 'held' AS mark, first_held AS us FROM n WHERE first_held IS NOT NULL UNION ALL SELECT belief, agent, 'last', last_held FROM n WHERE last_held IS NOT NULL UNION ALL SELECT belief, agent, 'doubt', first_doubt FROM n WHERE first_doubt IS NOT NULL UNION ALL SELECT belief, agent, 'denial', first_denial FROM n WHERE first_denial IS NOT NULL")
def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trail_status(spark, sf_dir)
    return t.select("belief", "agent", F.expr("stack(4, 'held', first_held, 'last', last_held, 'doubt', first_doubt, 'denial', first_denial) AS (mark, us)")).where("us IS NOT NULL")


STEPS = (HOUR, 6 * HOUR, 24 * HOUR, 7 * 24 * HOUR, 28 * 24 * HOUR)


@query("q65_timeline_ticks", f"WITH {STANCE}, d AS (SELECT belief, min(us) AS low, max(us) AS high FROM stance GROUP BY 1) SELECT belief, low, high, CASE WHEN high - low <= {12 * STEPS[0]} THEN {STEPS[0]} WHEN high - low <= {12 * STEPS[1]} THEN {STEPS[1]} WHEN high - low <= {12 * STEPS[2]} THEN {STEPS[2]} WHEN high - low <= {12 * STEPS[3]} THEN {STEPS[3]} ELSE {STEPS[4]} END::BIGINT AS step FROM d")
def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of a timeline and the smallest step that gives at most twelve ticks."""
    d = stances(spark, sf_dir).groupBy("belief").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    return d.select("belief", "low", "high", F.coalesce(*[F.when(F.col("high") - F.col("low") <= 12 * s, F.lit(s).cast("long")) for s in STEPS[:-1]], F.lit(STEPS[-1]).cast("long")).alias("step"))


@query("q66_chance_summary", f"WITH {STANCE}, o AS (SELECT belief, us, agent FROM stance WHERE label = 'affirms'), e AS (SELECT belief, min(us) AS lo, max(us) AS hi FROM o GROUP BY 1), v AS (SELECT o.belief, sum(greatest(least(o.us + 3600000000, coalesce(o.nx, o.us + 3600000000), hi) - o.us, 0))::BIGINT AS covered FROM (SELECT *, lead(us) OVER (PARTITION BY belief ORDER BY us) AS nx FROM o) o JOIN e ON e.belief = o.belief GROUP BY 1), c AS (SELECT s.belief, s.us - (SELECT max(o.us) FROM o WHERE o.belief = s.belief AND o.us < s.us AND o.agent <> s.agent) AS gap FROM stance s WHERE label = 'denies') SELECT c.belief % 2 AS era, count(*) AS copies, count(*) FILTER (coalesce(gap <= 3600000000, false)) AS within, CAST(floor(sum(covered / (hi - lo)::DOUBLE) * 1000 + 0.5) AS BIGINT) AS expected FROM c JOIN e ON c.belief = e.belief JOIN v ON v.belief = c.belief GROUP BY 1")
def chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pickups within an hour after somebody else's message, against those of uniform times within the fact's span."""
    s = stances(spark, sf_dir).select("id", "agent", "us", "belief", "label")
    told = s.where("label = 'affirms'")
    gaps = T.asof_other(s.where("label = 'denies'"), told, ["belief"], "us", "agent", "id", 24 * HOUR)
    ends = told.groupBy("belief").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    share = T.covered(told.select("belief", "us").join(ends, "belief"), ["belief"], "us", HOUR, "low", "high", DAY).select("belief", (F.col("covered") / (F.col("high") - F.col("low"))).alias("p"))
    tests = gaps.join(share, "belief").select((F.col("belief") % 2).alias("era"), F.coalesce(F.col("us") - F.col("other_at") <= HOUR, F.lit(False)).alias("gap_ok"), "p")
    return chance_summary(tests, "era").withColumn("expected", scaled(F.col("expected"), 3))
