"""What outside services and dictionaries say of the lines: labels asked in batches, names masked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import masked
from ..operators.labelers import ask
from ..functions.anchors import CHECKABLE
from ..operators.labels import STANCES, affirming, chosen_claims, claims
from ..sources.scratch import written
from .population import CHAT, FACTS, Population
from .registry import query
from .views import LINE, SNAP, chat, line_rows, table, texts


def by_length(lines: list[str]) -> list[str | None]:
    """A labeler that SQL can follow: a stance by the length of a line, and every eleventh length skipped."""
    return [STANCES[len(x) % 4] if len(x) % 11 else None for x in lines]


@query("q109_labels_asked", f"WITH {SNAP}, {LINE} SELECT agent AS belief, h AS line_hash, 'by-length' AS model, CASE length(min(line)) % 4 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STANCES))} END AS label, 1 AS tries FROM line GROUP BY 1, 2 HAVING length(min(line)) % 11 <> 0")
def labels_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct line of an agent, labelled by a table function in batches of a partition; skipped lines stay unanswered."""
    lines = line_rows(spark, sf_dir).select(F.col("agent").alias("belief"), F.substring(F.sha2("line", 256), 1, 24).alias("line_hash"), "line")
    return ask(lines, by_length, "by-length")


WORDS = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+"


@query("q110_masked_names", rf"WITH name AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{9,}}'))) AS w FROM conversations), piece AS (SELECT doc_id, regexp_extract_all(text, '{WORDS}|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200c}}\x{{200d}}]+') AS p FROM documents), one AS (SELECT doc_id, i, t, w IS NOT NULL AS hit FROM (SELECT doc_id, unnest(p) AS t, unnest(range(len(p))) AS i FROM piece) LEFT JOIN name ON w = lower(t)) SELECT doc_id, count(*) FILTER (hit) AS masked, sha256(string_agg(CASE WHEN hit THEN '[person]' ELSE t END, '' ORDER BY i)) AS digest FROM one GROUP BY 1")
def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every long word of the chats masked: a dictionary that grows with the data, as automata."""
    said = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{9,})"), F.lit(1))).alias("word"))
    docs = texts(spark, sf_dir, "doc_id", "text").where("text <> ''")
    out = masked(docs, "text", said, "word")
    return out.select("doc_id", "masked", F.sha2("text", 256).alias("digest"))


@query("q112_affirming_chat", f"WITH {FACTS}, {CHAT}, full_text AS (SELECT DISTINCT m.belief, m.agent, m.minute, s.text FROM msg m JOIN said s ON s.agent = m.agent AND s.minute = m.minute) SELECT belief, agent, minute FROM full_text WHERE length(text) % 4 = 0 AND length(text) % 11 <> 0 GROUP BY 1, 2, 3")
def affirming_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that mention a fact and, by the stored stance, affirm it. Each text is asked once for each belief."""
    p = Population(spark, sf_dir)
    said = chat(spark, sf_dir).where("speaker = 'assistant'").select(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("agent"), "minute", F.sha2("text", 256).alias("line_hash"), F.col("text").alias("line"))
    told = written(p.mentions.join(said, ["agent", "minute"]))
    return affirming(told, ask(told.select("belief", "line_hash", "line"), by_length, "by-length"))


KINDS = (*CHECKABLE, "opinion", "plan")


def first_words(lines: list[str]) -> list[list[dict]]:
    """Claims that SQL can follow: the first three words of a line, their kind by their length."""
    import re

    return [[{"text": w, "kind": KINDS[len(w) % 8], "anchors": [w.lower()], "subject": None} for w in re.findall("[A-Za-z]{4,}", x)[:3]] for x in lines]


KIND = f"[{', '.join(repr(k) for k in KINDS)}][length(w) % 8 + 1]"


@query("q113_checkable_claims", f"WITH {FACTS}, head AS (SELECT belief, h, count(*) AS lead, list(anchor) AS terms FROM fact GROUP BY 1, 2), opt AS (SELECT h, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT h, regexp_extract_all(min(line), '[A-Za-z]{{4,}}')[1:3] AS ws FROM line GROUP BY h)), pick AS (SELECT belief, lead, i::INTEGER AS no, w AS text, {KIND} AS kind, row_number() OVER (PARTITION BY belief ORDER BY len(list_filter(terms, lambda t: contains(lower(w), t))) = 0, i) AS r FROM head JOIN opt ON opt.h = head.h) SELECT belief, lead, no, text, kind FROM pick WHERE r = 1 AND kind IN {CHECKABLE} ORDER BY lead DESC, belief LIMIT 50")
def checkable_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim of each fact that can be checked, of the fifty facts with the most anchors: extraction by batches, then the choice."""
    p = Population(spark, sf_dir)
    head = p.facts.groupBy("belief", "h").agg(F.count("*").alias("lead"), F.collect_set("anchor").alias("terms"))  # the anchors of one line
    born = p.lines.join(head.select("h").distinct(), "h", "left_semi").select(F.col("h").alias("line_hash"), "line")
    store = claims(born, spark.createDataFrame([], "line_hash string"), first_words)
    return chosen_claims(head, store, 50)
