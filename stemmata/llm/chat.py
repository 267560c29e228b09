"""Chat formatting: multi-party perspective rotation, in built-in functions only.

Every speaker of a dialogue but `system` gives one rendering of the dialogue, in which that speaker is the assistant,
every other speaker is a named user and system messages stay system messages; loss_spans holds the half-open code
point ranges of the assistant's own words in the rendering.

A rendering holds the whole dialogue. Only on request (`turns_per_segment`) a dialogue is cut into segments by its turn
numbers; each then starts with the system messages said before it. Message order: turn, speaker, text.

Defined results: exactly repeated messages (same dialogue, turn, speaker and text) count once; a null text is empty; a
null speaker is `unknown`; null turns come first; a dialogue without turn numbers is segment -1, any other 0 (on request,
null turns are segment -1); very long texts and dialogues are rendered whole; an empty table gives no rows; extra columns
are not read; rows with a null dialogue id belong to no dialogue and are left out; a dialogue with system messages alone has no participant and gives no row; markup inside a message is
disarmed by a space, so that a message cannot open or close another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
SYSTEM, UNKNOWN = "system", "unknown"


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", turns_per_segment: int | None = None) -> DataFrame:
    """conv_id, segment, assistant, n_messages, n_own, rendered, loss_spans."""
    said = messages.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit(UNKNOWN)).alias("who"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(OPEN), F.lit("< |")).alias("text"),
    )
    # sets, not lists: repeated messages meet before the shuffle
    every = F.sort_array(F.collect_set(F.struct("turn", "who", "text")))
    if turns_per_segment is None:
        segments = said.groupBy("conv_id").agg(every.alias("said"), F.when(F.max("turn").isNull(), -1).otherwise(0).cast("long").alias("segment"))
    else:
        number = F.coalesce(F.floor(F.col("turn") / turns_per_segment), F.lit(-1)).cast("long")
        segments = said.groupBy("conv_id", number.alias("segment")).agg(every.alias("said"))
        orders = said.where(F.col("who") == SYSTEM).groupBy("conv_id").agg(every.alias("orders"))
        before = F.filter("orders", lambda m: m < F.col("said")[0])
        segments = segments.join(orders, "conv_id", "left").select("conv_id", "segment", F.when(F.col("orders").isNull(), F.col("said")).otherwise(F.concat(before, "said")).alias("said"))
    people = said.where(F.col("who") != SYSTEM).select("conv_id", F.col("who").alias("assistant")).distinct()
    views = segments.join(people, "conv_id")
    own = lambda m: m["who"] == F.col("assistant")
    head = lambda m: F.when(own(m), F.lit(f"{OPEN}assistant{CLOSE}\n")).when(m["who"] == SYSTEM, F.lit(f"{OPEN}system{CLOSE}\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), F.replace(m["who"], F.lit(OPEN), F.lit("< |")), F.lit(f"{CLOSE}\n")))
    parts = views.withColumn("parts", F.transform("said", lambda m: F.struct(head(m).alias("head"), m["text"].alias("body"), own(m).alias("own"))))
    tail = len(END) + 2  # the end mark between two line ends

    def step(acc, m):
        start = acc["at"] + F.char_length(m["head"])
        stop = start + F.char_length(m["body"])
        span = F.when(m["own"], F.array(F.concat_ws("-", start.cast("string"), stop.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((stop + tail).cast("long").alias("at"), F.concat(acc["spans"], span).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    return parts.select(
        "conv_id",
        "segment",
        "assistant",
        F.size("parts").cast("long").alias("n_messages"),
        F.size(F.filter("parts", lambda m: m["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda m: F.concat(m["head"], m["body"], F.lit(f"\n{END}\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("parts", zero, step, lambda a: a["spans"]), ",").alias("loss_spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH said AS (SELECT DISTINCT conv_id, CASE WHEN max(turn) OVER (PARTITION BY conv_id) IS NULL THEN -1 ELSE 0 END::BIGINT AS segment, turn,
                     coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS body
              FROM conversations WHERE conv_id IS NOT NULL),
     people AS (SELECT DISTINCT conv_id, who AS assistant FROM said WHERE who <> 'system'),
     parts AS (SELECT s.*, p.assistant, s.who = p.assistant AS own,
                      CASE WHEN s.who = p.assistant THEN '<|assistant|>' || chr(10)
                           WHEN s.who = 'system' THEN '<|system|>' || chr(10)
                           ELSE '<|user name=' || replace(s.who, '<|', '< |') || '|>' || chr(10) END AS head
               FROM said s JOIN people p ON s.conv_id = p.conv_id),
     placed AS (SELECT *, row_number() OVER w AS n,
                       coalesce(sum(length(head) + length(body) + 9) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start
                FROM parts WINDOW w AS (PARTITION BY conv_id, segment, assistant ORDER BY turn NULLS FIRST, who, body))
SELECT conv_id, segment, assistant, count(*)::BIGINT AS n_messages, count(*) FILTER (own)::BIGINT AS n_own,
       string_agg(head || body || chr(10) || '<|end|>' || chr(10), '' ORDER BY n) AS rendered,
       coalesce(string_agg(start || '-' || (start + length(body)), ',' ORDER BY n) FILTER (own), '') AS loss_spans
FROM placed GROUP BY conv_id, segment, assistant
"""
