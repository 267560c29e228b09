"""Sources, filters, joins, aggregates, samples and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.masking import lowercase_share
from ..operators.agreement import confusion, hash_sample, kappa, wilson
from ..operators.checks import row_counts
from ..operators.labels import overlay, planned, todo
from ..operators.temporal import latest_ties
from .registry import query
from .views import LINE, SNAP, hashed_lines, snapshot_keys, table

FIXED = {"region": 5, "nation": 25}
COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


def scaled(x, digits: int = 6):
    """A ratio as an integer, for exact comparison."""
    return F.floor(x * 10**digits + 0.5).cast("long")


@query("q01_manifest_counts", f"SELECT c.t AS \"table\", c.n AS rows, m.expected, coalesce(c.n = m.expected, false) AS ok FROM ({' UNION ALL '.join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in COUNTED)}) c FULL JOIN (VALUES ('region', 5::BIGINT), ('nation', 25::BIGINT)) m(t, expected) ON c.t = m.t")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts({t: table(spark, sf_dir, t) for t in COUNTED}, spark.createDataFrame(list(FIXED.items()), "table string, expected long"))


@query("q02_denormalize_orphans", "SELECT o_orderstatus AS status, count(*) AS turns, count(*) FILTER (o_orderkey IS NULL) AS orphans, count(DISTINCT o_custkey) AS owners FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def denormalize_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "lineitem").select("l_orderkey")
    sessions = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return turns.join(sessions, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("turns"), F.count_if(F.col("o_orderkey").isNull()).alias("orphans"), F.count_distinct("o_custkey").alias("owners"))


@query("q03_json_promote", "SELECT CASE WHEN event_type = 'signup' THEN '[person]' ELSE coalesce(event_type, 'none') END AS speaker, CAST(props->>'k' AS BIGINT) % 7 AS room, count(*) AS n, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS total, count(*) FILTER (props->>'absent' IS NULL) AS missing FROM events GROUP BY 1, 2")
def json_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "signup", "[person]").otherwise(F.coalesce("event_type", F.lit("none"))).alias("speaker"), (k % 7).alias("room"), k.alias("k"), F.get_json_object("props", "$.absent").alias("absent"))
    return e.groupBy("speaker", "room").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_if(F.col("absent").isNull()).alias("missing"))


@query("q04_latest_per_agent_ties", "SELECT lang, source, doc_id, n_chars FROM documents WHERE (lang, source, n_chars) IN (SELECT lang, source, max(n_chars) FROM documents GROUP BY 1, 2)")
def latest_per_agent_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_ties(table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], "n_chars")


@query("q05_active_agents_exists", "SELECT c_custkey AS agent, c_nationkey AS nation FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY AND event_type = 'purchase')")
def active_agents_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    latest = e.agg((F.max("ts") - F.expr("INTERVAL 30 DAYS")).alias("since"))
    recent = e.where("event_type = 'purchase'").join(F.broadcast(latest), F.col("ts") >= F.col("since")).select(F.col("user_id").alias("agent"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent"), F.col("c_nationkey").alias("nation")).join(recent, "agent", "left_semi")


@query("q12_temp_id_lookup", "SELECT d.lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(d.doc_id) AS first_id FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) i USING (doc_id) GROUP BY 1")
def temp_id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(ids, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"))


@query("q13_left_anti_todo", f"WITH {SNAP}, {LINE} SELECT h, min(id) AS first_id, count(*) AS places FROM line WHERE h NOT IN (SELECT l2.h FROM line l2 JOIN labels ON l2.id = doc_id) GROUP BY h")
def left_anti_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = hashed_lines(spark, sf_dir).select("h", "id")
    stored = lines.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("h").distinct()
    return todo(lines, stored, ["h"]).groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("places"))


PLAN, DONE = "(?i)the |der |la ", "(?i)tion"


@query("q14_label_overlay", "WITH c AS (SELECT doc_id, CASE quality WHEN 1 THEN 'affirms' ELSE 'doubts' END AS cheap FROM labels), s AS (SELECT doc_id, 'denies' AS strong FROM labels WHERE toxic = 1), j AS (SELECT coalesce(c.doc_id, s.doc_id) AS doc_id, coalesce(strong, cheap) AS label FROM c FULL JOIN s ON c.doc_id = s.doc_id) SELECT CASE WHEN label = 'affirms' AND regexp_matches(text, '(?i)the |der |la ') AND NOT regexp_matches(text, '(?i)tion') THEN 'plan' ELSE label END AS label, lang, count(*) AS n FROM j JOIN documents USING (doc_id) GROUP BY 1, 2")
def label_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    cheap = labels.select("doc_id", F.when(F.col("quality") == 1, "affirms").otherwise("doubts").alias("cheap"))
    strong = labels.where("toxic = 1").select("doc_id", F.lit("denies").alias("strong"))
    both = cheap.join(strong, "doc_id", "full").select("doc_id", overlay(F.col("strong"), F.col("cheap")).alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("head"))
    return both.join(docs, "doc_id").groupBy(planned(F.col("label"), F.col("head"), PLAN, DONE).alias("label"), "lang").agg(F.count("*").alias("n"))


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, model, label: two raters, unpivoted."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("model"), F.col("quality").alias("label")), F.struct(F.lit("toxic").alias("model"), (1 - F.col("toxic")).alias("label")))).alias("x")).select("doc_id", "x.model", "x.label")


RATERS = "r AS (SELECT doc_id, 'quality' AS model, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', 1 - toxic FROM labels)"


@query("q15_self_join_raters", f"WITH {RATERS}, o AS (SELECT doc_id, model, min(label) AS label FROM r GROUP BY 1, 2) SELECT a.model AS a, b.model AS b, count(*) AS n, count(*) FILTER (a.label = b.label) AS same FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.model < b.model GROUP BY 1, 2")
def self_join_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = raters(spark, sf_dir).groupBy("doc_id", "model").agg(F.min("label").alias("label"))
    b = one.select("doc_id", F.col("model").alias("b"), F.col("label").alias("lb"))
    return one.select("doc_id", F.col("model").alias("a"), F.col("label").alias("la")).join(b, "doc_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("la") == F.col("lb")).alias("same"))


KAPPA = """ c AS (SELECT {key}, a, b, count(*) AS n FROM p GROUP BY 1, 2, 3), t AS (SELECT {key}, sum(n)::BIGINT AS n, sum(CASE WHEN a = b THEN n ELSE 0 END)::BIGINT AS agreed FROM c GROUP BY 1),
 l AS (SELECT {key}, a AS x, sum(n)::BIGINT AS l FROM c GROUP BY 1, 2), r AS (SELECT {key}, b AS x, sum(n)::BIGINT AS r FROM c GROUP BY 1, 2),
 e AS (SELECT l.{key}, sum(l * r)::BIGINT AS chance FROM l JOIN r ON l.{key} = r.{key} AND l.x = r.x GROUP BY 1),
 k AS (SELECT t.*, agreed::DOUBLE / n AS po, coalesce(chance, 0)::DOUBLE / (n * n) AS pe FROM t LEFT JOIN e ON t.{key} = e.{key})
 SELECT {key}, n, agreed, CAST(floor((CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END) * 1000 + 0.5) AS BIGINT) AS kappa,
  CAST(floor(greatest(((po + 3.8416 / (2 * n)) - 1.96 * sqrt(po * (1 - po) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0) * 1000 + 0.5) AS BIGINT) AS low,
  CAST(floor(least(((po + 3.8416 / (2 * n)) + 1.96 * sqrt(po * (1 - po) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1) * 1000 + 0.5) AS BIGINT) AS high FROM k"""
BLOCKS = " UNION ALL ".join(f"SELECT '{b}:' || {v} AS block, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id)" for b, v in (("lang", "lang"), ("source", "source"), ("all", "'all'")))


@query("q16_kappa_wilson", f"WITH p AS (SELECT lang, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id)), {KAPPA.format(key='lang')}")
def kappa_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    pairs = table(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    k = kappa(pairs, "a", "b", ["lang"])
    low, high = wilson(F.col("agreed"), F.col("n"))
    return k.select("lang", "n", "agreed", scaled(F.col("kappa"), 3).alias("kappa"), scaled(low, 3).alias("low"), scaled(high, 3).alias("high"))


@query("q101_agreement_blocks", f"WITH p AS ({BLOCKS}), {KAPPA.format(key='block')}")
def agreement_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two raters over all labels, by language, and by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    each = F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.lit("all:all"))).alias("block")
    pairs = table(spark, sf_dir, "labels").join(docs, "doc_id").select(each, F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    low, high = wilson(F.col("agreed"), F.col("n"))
    return kappa(pairs, "a", "b", ["block"]).select("block", "n", "agreed", scaled(F.col("kappa"), 3).alias("kappa"), scaled(low, 3).alias("low"), scaled(high, 3).alias("high"))


@query("q41_lowercase_share", "WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM conversations) SELECT lower(t) AS word, count(*) FILTER (t = lower(t)) AS lower, count(*) AS uses FROM w WHERE lower(t) IN (SELECT lower(r_name) FROM region UNION SELECT unnest(['the', 'of', 'and', 'is', 'that'])) GROUP BY 1")
def lowercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "region").select(F.lower("r_name").alias("word")).unionByName(spark.createDataFrame([(w,) for w in ("the", "of", "and", "is", "that")], "word string"))
    return lowercase_share(table(spark, sf_dir, "conversations"), "text", words)


@query("q42_stratified_sample", "SELECT lang, quality, doc_id, place FROM (SELECT lang, quality, doc_id, row_number() OVER (PARTITION BY lang, quality ORDER BY sha256(doc_id || ':20261003'), doc_id) AS place FROM labels JOIN documents USING (doc_id)) WHERE place <= 15")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", "quality", "doc_id")
    return hash_sample(rows, ["lang", "quality"], "doc_id", 15, 20261003).select("lang", "quality", "doc_id", F.col("place").cast("long").alias("place"))


@query("q43_confusion", "SELECT d.source AS kind, l.quality AS a, l.toxic AS b, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2, 3")
def confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind"))
    return confusion(table(spark, sf_dir, "labels").join(docs, "doc_id").select("kind", F.col("quality").alias("a"), F.col("toxic").alias("b")), "a", "b", ["kind"])


@query("q45_sha_manifest", "WITH now AS (SELECT doc_id, sha256(text) AS s FROM documents), told AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS s FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -1 - item_id, sha256(text) FROM benchmark), j AS (SELECT coalesce(now.doc_id, told.doc_id) AS id, now.s AS a, told.s AS b FROM now FULL JOIN told ON now.doc_id = told.doc_id) SELECT CASE WHEN a IS NULL THEN 'missing' WHEN b IS NULL THEN 'extra' WHEN a = b THEN 'ok' ELSE 'changed' END AS status, count(*) AS n FROM j GROUP BY 1")
def sha_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a manifest that lacks every fifth, has another text for every seventh, and lists others too."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = d.select("doc_id", F.sha2("text", 256).alias("a"))
    told = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")), 256).alias("b"))
    told = told.unionByName(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.sha2("text", 256).alias("b")))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("a") == F.col("b"), "ok").otherwise("changed")
    return now.join(told, "doc_id", "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("q51_first_seen_dedup", f"WITH {SNAP}, {LINE} SELECT h, agent, k, pos FROM (SELECT h, agent, k, pos, row_number() OVER (PARTITION BY h ORDER BY id, pos) AS r FROM line) WHERE r = 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-preserving dedup as a grouped minimum, which combines before the shuffle."""
    return hashed_lines(spark, sf_dir).groupBy("h").agg(F.min(F.struct("id", "pos", "agent", "k")).alias("x")).select("h", "x.agent", "x.k", F.col("x.pos").cast("long").alias("pos"))


@query("q52_agent_lookup", "SELECT q, (SELECT s_name FROM supplier WHERE s_name = q) AS exact, (SELECT count(*) FROM supplier WHERE starts_with(s_name, q)) AS by_prefix, (SELECT count(*) FROM supplier WHERE contains(lower(s_name), lower(q))) AS by_part FROM (VALUES ('Supplier#000000001'), ('Supplier#00000001'), ('lier#000000007')) t(q)")
def agent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact name, prefix, part: how many each way, so that a caller can refuse an ambiguous one."""
    names = table(spark, sf_dir, "supplier").select("s_name")
    asked = F.broadcast(spark.createDataFrame([("Supplier#000000001",), ("Supplier#00000001",), ("lier#000000007",)], "q string"))
    hit = F.contains(F.lower("s_name"), F.lower("q"))
    return asked.join(names, hit, "left").groupBy("q").agg(F.max(F.when(F.col("s_name") == F.col("q"), F.col("s_name"))).alias("exact"), F.count_if(F.coalesce(F.col("s_name").startswith(F.col("q")), F.lit(False))).alias("by_prefix"), F.count("s_name").alias("by_part"))


@query("q53_newest_runs", "SELECT source AS name, max(doc_id) AS newest, count(*) AS runs FROM documents GROUP BY 1")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.runs import STAMPED, newest

    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    paths = d.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("T000000Z-"), "source", F.lit(".json")).alias("path"))
    runs = paths.groupBy(F.regexp_extract("path", STAMPED, 2).alias("name")).agg(F.count("*").alias("runs"))
    return newest(paths).join(runs, "name").select("name", F.regexp_extract("path", r"^(\d{8})T", 1).cast("long").alias("newest"), "runs")


@query("q54_ilike_first", "SELECT nation, region FROM (SELECT n_name AS nation, r_name AS region, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name ILIKE '%a%') WHERE r <= 1")
def ilike_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return goals.where(F.col("r_name").ilike("%a%")).orderBy("n_nationkey").limit(1).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("q55_top_score_rank", "SELECT doc_id, n_chars, rank FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 50")
def top_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return top.select("doc_id", "n_chars", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))
