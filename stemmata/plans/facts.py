"""Facts files and the numbers in documents, checked key by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as X
from ..sources.scratch import shared_folder
from .registry import query
from .views import table


def facts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row, facts: nested JSON of what the tables hold, by source, language and label."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    per = lambda key: d.groupBy(F.coalesce(key, F.lit("none")).alias("key")).agg(F.count("*").alias("documents"), F.max("n_chars").cast("long").alias("longest"), F.min("doc_id").alias("first"))
    entry = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", value))))
    sources = per("source").agg(entry(F.struct("documents", "longest", "first")).alias("sources"))
    langs = per("lang").agg(entry(F.col("documents")).alias("langs"))
    first = d.agg(F.sort_array(F.collect_set("lang")).alias("names"), F.count("*").alias("documents"))
    marks = l.agg(F.array(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)).alias("quality"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    one = first.crossJoin(sources).crossJoin(langs).crossJoin(marks)  # one row each
    return one.select(F.to_json(F.struct("documents", "names", "sources", "langs", F.struct("quality", "toxic").alias("labels"))).alias("facts"))


def recounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts, kind, number, text: the same facts counted one by one."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def rows(df: DataFrame, number: Column | None, *parts: Column, text: Column | None = None) -> DataFrame:
        n = F.lit(None).cast("double") if number is None else number.cast("double")
        shown = text if number is None else number.cast("string")
        return df.select(F.array(*parts).alias("parts"), F.lit("string" if number is None else "number").alias("kind"), n.alias("number"), shown.alias("text"))

    source, lang = (d.withColumn("key", F.coalesce(c, F.lit("none"))).groupBy("key") for c in ("source", "lang"))
    by, key = source.agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.min("doc_id").alias("first")), F.col("key")
    names = d.where("lang IS NOT NULL").select("lang").distinct().agg(F.sort_array(F.collect_list("lang")).alias("x")).select(F.posexplode("x").alias("i", "lang"))  # one row a language
    quality = l.where("quality IN (0, 1)").groupBy("quality").count()
    out = rows(d.agg(F.count("*").alias("n")), F.col("n"), F.lit("documents"))
    for name, column in (("documents", "n"), ("longest", "longest"), ("first", "first")):
        out = out.unionByName(rows(by, F.col(column), F.lit("sources"), key, F.lit(name)))
    out = out.unionByName(rows(lang.count(), F.col("count"), F.lit("langs"), key))
    out = out.unionByName(rows(names, None, F.lit("names"), F.col("i").cast("string"), text=F.col("lang")))
    out = out.unionByName(rows(quality, F.col("count"), F.lit("labels"), F.lit("quality"), F.col("quality").cast("string")))
    return out.unionByName(rows(l.where("toxic = 1").agg(F.count("*").alias("n")), F.col("n"), F.lit("labels"), F.lit("toxic")))


def saved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts, kind, number, text of the facts file, written and read back as text."""
    path = f"{shared_folder(spark)}/facts/{uuid.uuid4().hex}"
    facts_json(spark, sf_dir).select(F.col("facts").alias("value")).write.text(path)
    return X.leaves(spark.read.text(path).select(F.parse_json("value").alias("v")), "v")


PER = "SELECT coalesce(source, 'none') AS key, count(*) AS documents, max(n_chars) AS longest, min(doc_id) AS first FROM documents GROUP BY 1"
FACT_ROWS = f"""per AS ({PER}),
 f AS (SELECT 'documents' AS path, count(*)::VARCHAR AS v FROM documents UNION ALL SELECT 'sources.' || key || '.documents', documents::VARCHAR FROM per UNION ALL SELECT 'sources.' || key || '.longest', longest::VARCHAR FROM per UNION ALL SELECT 'sources.' || key || '.first', first::VARCHAR FROM per
  UNION ALL SELECT 'langs.' || coalesce(lang, 'none'), count(*)::VARCHAR FROM documents GROUP BY lang UNION ALL SELECT 'names.' || (row_number() OVER (ORDER BY lang) - 1), lang FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
  UNION ALL SELECT 'labels.quality.' || quality, count(*)::VARCHAR FROM labels WHERE quality IN (0, 1) GROUP BY quality UNION ALL SELECT 'labels.toxic', count(*)::VARCHAR FROM labels WHERE toxic = 1)"""


@query("q104_facts_current", f"WITH {FACT_ROWS} SELECT path, v AS saved, v AS now, 'ok' AS status FROM f")
def facts_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts file against a recount, key by key, numbers and strings of any depth."""
    out = X.compared(saved_facts(spark, sf_dir), recounted(spark, sf_dir))
    return out.select(X.path(F.col("parts")).alias("path"), "saved", "now", "status")


@query("q105_doc_numbers", f"WITH per AS ({PER}), told AS (SELECT key, 'sources.' || key || '.documents' AS path, documents + (documents % 3 = 0)::INT AS told, documents AS value FROM per UNION ALL SELECT key, 'sources.' || key || '.longest', longest, longest FROM per UNION ALL SELECT key, 'sources.' || key || '.names', first, NULL FROM per) SELECT key, path, told::DOUBLE AS told, value::DOUBLE AS value, coalesce(told = value, false) AS ok FROM told")
def doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each source with marked numbers, some of them planted wrong (counts that three divides) or marked with a path that is no fact."""
    d = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("key")).agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.min("doc_id").alias("first"))
    mark = lambda n, name: F.concat(n, F.lit("<!--f:sources."), F.col("key"), F.lit(f".{name}-->"))
    wrong = F.col("n") + F.when(F.col("n") % 3 == 0, 1).otherwise(0)
    text = F.concat(F.lit("# Report\nThere are "), mark(F.format_number(wrong, 0), "documents"), F.lit(" documents, the longest of "), mark(F.col("longest").cast("string"), "longest"), F.lit(" characters, from "), mark(F.col("first").cast("string"), "names"), F.lit("."))
    return X.marked(d.select("key", text.alias("text")), "key", "text", saved_facts(spark, sf_dir)).select("key", "path", "told", "value", "ok")
