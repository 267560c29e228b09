"""Texts and lineage: normalized lines, headings, diffs, novelty, lives, beliefs, copies, disputes, survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.anchors import anchors_udf, search_terms, strong
from ..functions.fuzzy import token_set_ratio_udf
from ..functions.text import body, digest, has_lines, heading, lines, raw_lines, section
from ..operators import lineage as L
from ..operators import similarity as S
from ..operators import temporal as T
from ..operators.temporal import episodes
from ..sources.scratch import written
from .relational import scaled
from .registry import query
from .views import BASE, LINE, SNAP, final_k, hashed_lines, line_rows, memory, snapshot_keys, texts, table


@query("q00_spread_and_survival", f"WITH {BASE}, f AS (SELECT agent, max(k) AS final_k FROM snap GROUP BY agent) SELECT h, count(*) AS agents, sum(versions)::BIGINT AS versions, sum(last_k - first_k)::BIGINT AS rewrites, count(*) FILTER (last_k = final_k) AS alive, min(first_k) AS first_k FROM lives JOIN f ON lives.agent = f.agent GROUP BY h")
def spread_and_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: which facts spread over agents, how many rewrites they survived, and who still holds them."""
    lived = L.lives(memory(spark, sf_dir), "h").join(final_k(spark, sf_dir), "agent")
    return lived.groupBy("h").agg(F.count("*").alias("agents"), F.sum("versions").alias("versions"), F.sum(F.col("last_k") - F.col("first_k")).alias("rewrites"), F.count_if(F.col("last_k") == F.col("final_k")).alias("alive"), F.min("first_k").alias("first_k"))


@query("q06_prev_and_k", f"WITH {SNAP}, p AS (SELECT agent, id, k, lag(id) OVER (PARTITION BY agent ORDER BY k) AS prev, minute - lag(minute) OVER (PARTITION BY agent ORDER BY k) AS gap, minute FROM snap) SELECT agent, id, k, prev, gap FROM p WHERE minute BETWEEN 100 AND 700")
def prev_and_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered before the range is cut, so k counts the whole history and the first row keeps its predecessor."""
    s = T.previous(snapshot_keys(spark, sf_dir), "agent", prev="id", before="minute")
    return s.where(F.col("minute").between(100, 700)).select("agent", "id", "k", "prev", (F.col("minute") - F.col("before")).alias("gap"))


NORMAL = r"trim(regexp_replace(ltrim(regexp_replace(regexp_replace(regexp_replace(trim(x, chr(32) || chr(9)), '^\s*([*+\->]+|\d{1,3}[.)]|[A-Za-z][.)])\s+', ''), '\*\*|__|`', '', 'g'), '^#+', '')), '\s+', ' ', 'g'))"


@query("q17_normalize_lines", rf"WITH {SNAP}, r AS (SELECT agent, unnest(string_split(content, chr(10))) AS x FROM snap), n AS (SELECT agent, {NORMAL} AS line FROM r WHERE NOT regexp_matches(x, '^[\s\-_=*#~.]*$')) SELECT agent, substr(sha256(line), 1, 24) AS h, length(line) AS chars, count(*) AS n FROM n WHERE length(line) >= 3 GROUP BY 1, 2, 3")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "source", "text").select(F.col("source").alias("agent"), F.explode(lines(F.col("text"))).alias("line"))
    return d.groupBy("agent", digest(F.col("line")).alias("h"), F.char_length("line").cast("long").alias("chars")).agg(F.count("*").alias("n"))


SHOUT = r"length(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 4 AND length(t) <= 80 AND length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) * 100 > length(regexp_replace(t, '[^\p{L}]', '', 'g')) * 85 AND NOT regexp_matches(t, '[.!?]$')"


@query("q18_section_ffill", rf"""WITH {SNAP}, r AS (SELECT id, i, l[i] AS x FROM (SELECT id, string_split(content, chr(10)) AS l FROM snap), unnest(generate_series(1, len(l))) AS u(i) WHERE NOT regexp_matches(l[i], '^[\s\-_=*#~.]*$')),
 n AS (SELECT id, i, {NORMAL} AS line, regexp_replace({NORMAL}, ':+$', '') AS t FROM r), g AS (SELECT *, CASE WHEN {SHOUT} THEN t END AS head FROM n),
 s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY id ORDER BY i) AS sec FROM g) SELECT sec AS section, count(*) AS lines, count(DISTINCT id) AS versions FROM s WHERE head IS NULL AND length(line) >= 3 GROUP BY 1""")
def section_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under the last heading above them, inside one row's array order; the window stays within a document."""
    d = texts(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("id"), F.posexplode(raw_lines(F.col("text"))).alias("pos", "raw"))
    from ..functions.text import normalized

    d = d.withColumn("line", normalized(F.col("raw")))
    d = d.select("id", "pos", heading(F.col("raw"), F.col("line")).alias("head"), (F.char_length("line") >= 3).alias("kept"))  # no text is shuffled
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("section", F.last("head", ignorenulls=True).over(w)).where(F.col("head").isNull() & F.col("kept"))
    return d.groupBy("section").agg(F.count("*").alias("lines"), F.count_distinct("id").alias("versions"))


DIFF = "c AS (SELECT agent, k, h, count(*) AS n FROM line GROUP BY 1, 2, 3), v AS (SELECT agent, k, h, n FROM c UNION ALL SELECT agent, k + 1, h, -n FROM c), d AS (SELECT v.agent, k, h, sum(n)::BIGINT AS n FROM v JOIN (SELECT agent, max(k) AS last FROM snap GROUP BY agent) f ON v.agent = f.agent WHERE k <= last GROUP BY v.agent, k, h HAVING sum(n) <> 0)"


@query("q19_line_multiset_diff", f"WITH {SNAP}, {LINE}, {DIFF} SELECT agent, k, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, count(*) AS lines, sum(abs(n))::BIGINT AS n FROM d GROUP BY 1, 2, 3")
def line_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.multiset_diff(hashed_lines(spark, sf_dir), line="h")
    return d.groupBy("agent", "k", "change").agg(F.count("*").alias("lines"), F.sum("n").alias("n"))


@query("q20_compression", f"WITH {SNAP}, p AS (SELECT agent, k, length(content) AS chars, lag(length(content)) OVER (PARTITION BY agent ORDER BY k) AS old FROM snap) SELECT agent, k, old AS old_chars, chars AS new_chars FROM p WHERE old > 0 AND chars * 10 < old * 7")
def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are taken in the scan, so no text is shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("agent"), F.char_length("text").cast("long").alias("new_chars"))
    d = T.previous(T.versions(d, "agent", ["doc_id"]), "agent", old_chars="new_chars")
    return d.where((F.col("old_chars") > 0) & (F.col("new_chars") * 10 < F.col("old_chars") * 7)).select("agent", "k", "old_chars", "new_chars")


@query("q21_line_novelty", f"WITH {SNAP}, {LINE}, {DIFF}, f AS (SELECT agent, h, min(k) AS first_k FROM line GROUP BY 1, 2) SELECT d.agent, d.k, d.h FROM d JOIN f ON d.agent = f.agent AND d.h = f.h WHERE d.n > 0 AND d.k > 0 AND first_k >= d.k")
def line_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed_lines(spark, sf_dir)
    return L.births(L.multiset_diff(rows, line="h"), L.lives(rows, "h"), "h").select("agent", "k", "h")


@query("q22_line_lives", f"WITH {BASE} SELECT h, agent, first_k, last_k, versions FROM lives")
def line_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lives(memory(spark, sf_dir), "h")


DISPUTE = "(^|[ ,.])(no|not|never|worthless|idiot|clown|loser)([ ,.]|$)"
DISPUTES = rf"disputes AS (SELECT l.h, count(DISTINCT x.h) AS disputes FROM line l JOIN line x ON l.id = x.id AND regexp_matches(lower(x.line), '{DISPUTE}') GROUP BY l.h)"


def disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h, disputes: distinct disputing lines in the versions that hold a line. The pattern meets each distinct line of a version once."""
    d = texts(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    d = d.withColumn("line", F.trim("line")).where(F.char_length("line") >= 3)
    return L.disputes(d.select("id", digest(F.col("line")).alias("h"), F.lower("line").rlike(DISPUTE).alias("against")), "id", "h", "against")


@query("q25_disputes", f"WITH {SNAP}, {LINE}, {DISPUTES} SELECT h, disputes FROM disputes")
def disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disputes(spark, sf_dir)


BELIEFS = f"""{BASE}, {DISPUTES}, f AS (SELECT agent, max(k) AS final_k FROM snap GROUP BY agent),
 b AS (SELECT l.h, count(*) AS agents, sum(last_k - first_k)::BIGINT AS rewrites, sum(versions)::BIGINT AS versions, count(*) FILTER (last_k = final_k) AS alive, count(*) - 1 AS caught FROM lives l JOIN f ON l.agent = f.agent GROUP BY l.h HAVING sum(versions) >= 3),
 s AS (SELECT b.*, coalesce(disputes, 0) AS disputes FROM b LEFT JOIN disputes d ON b.h = d.h)"""


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.beliefs(L.lives(memory(spark, sf_dir), "h"), final_k(spark, sf_dir), disputes(spark, sf_dir), "h")


LEAD = "(1 + caught) * log2(2 + rewrites) * (CASE WHEN alive > 0 THEN 2 ELSE 1 END) * (1 + log2(1 + disputes))"


@query("q23_belief_rollup_lead", f"WITH {BELIEFS} SELECT h, agents, rewrites, versions, alive, caught, disputes, CAST(floor({LEAD} * 1000 + 0.5) AS BIGINT) AS lead, row_number() OVER (ORDER BY CAST(floor({LEAD} * 1000 + 0.5) AS BIGINT) DESC, h) AS place FROM s QUALIFY place <= 300")
def belief_rollup_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("caught", "rewrites", "alive", "disputes")
    b = beliefs(spark, sf_dir).withColumn("lead", scaled(L.lead(*map(F.col, cols)), 3))
    top = b.orderBy(F.desc("lead"), "h").limit(300)
    return top.select("h", "agents", "rewrites", "versions", "alive", "caught", "disputes", "lead", F.row_number().over(Window.orderBy(F.desc("lead"), "h")).cast("long").alias("place"))


@query("q26_alive_trace", f"WITH {BELIEFS} SELECT h, agents, alive, CAST(floor((1 + caught) * log2(2 + rewrites) * (1 + alive) * (1 + log2(1 + disputes)) * 1000 + 0.5) AS BIGINT) AS lead FROM s WHERE alive > 0")
def alive_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced back from the latest holders: only lines of the latest versions are followed."""
    last = final_k(spark, sf_dir)
    held = memory(spark, sf_dir)
    latest = held.join(last, "agent").where("k = final_k").select("h").distinct()
    b = L.beliefs(L.lives(held.join(latest, "h", "left_semi"), "h"), last, disputes(spark, sf_dir), "h")
    return b.where("alive > 0").select("h", "agents", "alive", scaled(L.alive_lead(F.col("caught"), F.col("rewrites"), F.col("alive"), F.col("disputes")), 3).alias("lead"))


FIRST = f"{SNAP}, {LINE}, firsts AS (SELECT h, agent, min(minute) AS first_at, count(DISTINCT k) AS versions FROM line GROUP BY h, agent)"


def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_lines(spark, sf_dir).groupBy("h", "agent").agg(F.min("minute").alias("first_at"), F.count_distinct("k").alias("versions"))


COPY = f"{FIRST}, b AS (SELECT *, first_value(agent) OVER w AS source, first_value(first_at) OVER w AS born FROM firsts WINDOW w AS (PARTITION BY h ORDER BY first_at, agent)), copy AS (SELECT h, source, agent, born, first_at FROM b WHERE agent <> source AND first_at > born)"


@query("q24_copies", f"WITH {COPY} SELECT h, source, agent, born, first_at FROM copy")
def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.copies(firsts(spark, sf_dir), "h")


TREE = f"{COPY}, e AS (SELECT source, agent, count(*) AS n FROM copy GROUP BY 1, 2), roots AS (SELECT DISTINCT source AS root FROM e WHERE source NOT IN (SELECT agent FROM e) UNION SELECT min(source) FROM e)"


@query("q44_spread_tree", f"WITH RECURSIVE {TREE}, t AS (SELECT root AS agent, root, NULL::VARCHAR AS parent, 0 AS depth FROM roots WHERE root IS NOT NULL UNION SELECT agent, root, source AS parent, depth + 1 FROM (SELECT e.agent, t.root, e.source, t.depth FROM t JOIN e ON e.source = t.agent WHERE t.depth < 64) WHERE (root, agent) NOT IN (SELECT root, agent FROM recurring.t)) SELECT agent, root, min(parent) AS parent, depth FROM (SELECT *, min(depth) OVER (PARTITION BY root, agent) AS least FROM t) WHERE depth = least GROUP BY agent, root, depth")
def spread_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who got facts from whom, as trees below every agent that got none from others (and the first source); edges are per agent pair, so few."""
    edges = copies(spark, sf_dir).select("source", "agent").distinct()
    return L.spread_trees(edges)


@query("q28_episodes", f"WITH {BASE}, v AS (SELECT DISTINCT h, agent, k FROM mem), i AS (SELECT *, k - row_number() OVER (PARTITION BY h, agent ORDER BY k) AS g FROM v) SELECT h, agent, min(k) AS first, max(k) AS last, count(*) AS n FROM i GROUP BY h, agent, g")
def line_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive versions that hold a line. Only holding versions are rows, so the version number marks the gaps."""
    held = memory(spark, sf_dir)
    w = Window.partitionBy("h", "agent").orderBy("k")
    return held.withColumn("g", F.col("k") - F.row_number().over(w)).groupBy("h", "agent", "g").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n")).drop("g")


@query("q46_anchors")
def anchor_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Births of strong anchors: extraction runs once over distinct lines, then joins back by digest."""
    d = texts(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("id"), F.explode(lines(F.col("text"))).alias("line"))
    d = d.withColumn("h", digest(F.col("line")))
    dim = d.where(F.col("line").rlike(r"[\d\"“@]|https?:")).groupBy("h").agg(F.min("line").alias("line")).select("h", "line", F.explode(anchors_udf(body(F.col("line")))).alias("anchor"))
    held = d.select("id", "h").join(dim.where(strong(F.col("anchor"))), "h").join(snapshot_keys(spark, sf_dir), "id")
    lived = L.lives(held, "anchor")
    first = held.groupBy("anchor", "agent").agg(F.min_by("line", F.struct("k", "line")).alias("line"))
    return lived.join(first, ["anchor", "agent"]).select("anchor", "agent", "first_k", "last_k", "versions", "line", section(F.col("line")).alias("section"), F.array_join(search_terms(F.col("anchor")), " ").alias("terms"))


@query("q47_line_pairing")
def line_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, changed and vanished lines of consecutive versions, similar ones paired."""
    keys = snapshot_keys(spark, sf_dir).select("id", "agent", "k")
    told = texts(spark, sf_dir, "doc_id", "text").where(has_lines(F.col("text"))).select(F.col("doc_id").alias("id"))
    last = keys.join(told, "id", "left_semi").groupBy("agent").agg(F.max("k").alias("last"))
    held = texts(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("id"), lines(F.col("text")).alias("lines"))
    out = L.paired_versions(held.join(keys.join(last, "agent").hint("shuffle_hash"), "id"))  # ids are hashed, texts are not sorted
    paired = lambda c: F.when(F.col("kind") == "paired", F.col(c))  # only their anchors are asked for
    same = F.array_sort(anchors_udf(paired("old"))) == F.array_sort(anchors_udf(paired("new")))
    return out.withColumn("kind", F.when(F.col("kind") == "paired", F.when(same, "reworded").otherwise("changed")).otherwise(F.col("kind"))).groupBy("agent", "kind").agg(F.count("*").alias("n"))


@query("q56_same_fact")
def same_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against the birth lines of facts: alike if their token sets are, or two anchors are shared.

    Every line and every fact takes part. Candidates are pairs that share an anchor, and those that the set-similarity join
    finds without one; each is scored once, by the whole token set ratio. Texts meet only where the letters of what is left may
    count: see similarity.known().
    """
    from .population import Population, words

    p = Population(spark, sf_dir)
    told = written(p.lines.select(F.unhex("h").alias("h"), S.size("line").alias("size"), F.explode(F.array_distinct(words())).alias("anchor")).distinct())
    own = told.select(F.col("h").alias("fact"), F.col("size").alias("own")).distinct()
    facts = p.facts.select(F.unhex("h").alias("fact"), "anchor").distinct().join(own, "fact")
    met = facts.join(told, "anchor").where("fact <> h").select("fact", "h", F.lit(1).cast("long").alias("shared"), F.least("own", "size").alias("short"), F.greatest("own", "size").alias("long"), (F.col("own") + F.col("size")).isNull().alias("odd"))
    pairs = written(S.known(met, S.overlapping(S.marked(p.lines), S.marks(p.facts))))
    lines = p.lines.groupBy(F.unhex("h").alias("h")).agg(F.min("line").alias("line"))
    both = pairs.where("score IS NULL").drop("score").join(lines, "h").join(lines.select(F.col("h").alias("fact"), F.col("line").alias("first")), "fact")
    scored = both.select("fact", "h", "shared", token_set_ratio_udf("line", "first").alias("score")).where("score >= 60 OR shared >= 2")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return pairs.where("score IS NOT NULL").select("fact", "h", "shared", "score").unionByName(scored).select(text("fact"), text("h"), "shared", scaled(F.col("score"), 3).alias("score"))
