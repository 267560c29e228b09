"""Labels from outside: a pluggable labeler, a memo of stored labels, overlays and states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.anchors import checkable
from ..functions.masking import scrub_secrets

STANCES = ("affirms", "doubts", "denies", "unrelated")
#: Weights of evidence verdicts in a final score.
WEIGHTS = {"contradicted": 3.0, "hearsay": 1.5, "no_evidence": 1.0, "instruction": 1.2, "supported": 0.3}


def todo(lines: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no stored label answers yet."""
    return lines.join(stored, keys, "left_anti")


def labelled(rows: DataFrame, labeler: Callable[[str], str], text: str, label: str = "label") -> DataFrame:
    """rows with labeler(text); the labeler is any pure function, applied to distinct texts of a batch once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = {t: labeler(t) for t in b[text].dropna().unique()}
            yield b.assign(**{label: b[text].map(known)})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(label, StringType())]))


def memoised(rows: DataFrame, stored: DataFrame, keys: list[str], labeler: Callable[[str], str], text: str) -> DataFrame:
    """All labels of rows: the stored ones, and new ones for the rest. Append the new ones to the store to keep them."""
    new = labelled(todo(rows, stored, keys), labeler, text)
    return rows.join(stored.unionByName(new.select(*stored.columns)), keys, "left")


def batches(lines: DataFrame, extract: Callable[[list[str]], list[list[dict] | None]], size: int, schema: str) -> DataFrame:
    """line_hash, line, no and the columns of schema: what extract finds in batches of `size` distinct lines (line_hash, line).

    A line in which nothing was found gives one row with no = -1, so it is answered and never sent again. A line that
    extract skips (None) gives no row and stays to be asked.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                rows = []
                for h, line, found in zip(part.line_hash, part.line, extract(part.line.tolist())):
                    if found is not None:
                        rows += [(h, line, n, *(x.get(c) for c in names)) for n, x in enumerate(found)] or [(h, line, -1, *[None] * len(names))]
                yield pd.DataFrame(rows, columns=["line_hash", "line", "no", *names])

    return lines.select("line_hash", "line").dropDuplicates(["line_hash"]).mapInPandas(run, f"line_hash string, line string, no int, {schema}")


def claims(lines: DataFrame, stored: DataFrame, extract: Callable[[list[str]], list[list[dict] | None]], size: int = 25) -> DataFrame:
    """New rows of a claim store (line_hash, line, no, text, kind, anchors, subject) for the lines that it doesn't answer yet."""
    return batches(todo(lines, stored, ["line_hash"]), extract, size, "text string, kind string, anchors array<string>, subject string")


def chosen_claims(beliefs: DataFrame, store: DataFrame, n: int) -> DataFrame:
    """belief, lead, no, text, kind: the claim of each belief that can be checked, of the n with the highest lead.

    beliefs: belief, h, lead, terms (what to look for); store: line_hash, no, text, kind, anchors of claims(). A belief's claim
    is the first of its line that has one of the terms, or else the first of all. Ties in lead: the smaller belief.
    """
    options = store.where("no >= 0").select(F.col("line_hash").alias("h"), "no", "text", "kind", F.lower(F.concat_ws(" ", "text", F.array_join("anchors", " "))).alias("_held"))
    met = beliefs.join(options, "h").withColumn("_other", ~F.exists("terms", lambda t: F.contains(F.col("_held"), F.lower(t))))
    one = met.groupBy("belief", "lead").agg(F.min_by(F.struct("no", "text", "kind"), F.struct("_other", "no")).alias("x"))
    return one.select("belief", "lead", "x.*").where(checkable(F.col("kind"))).orderBy(F.desc("lead"), "belief").limit(n)


def affirming(mentions: DataFrame, stored: DataFrame) -> DataFrame:
    """belief, agent, minute: messages about a belief whose stored stance affirms it. mentions: belief, agent, minute, line_hash; stored: belief, line_hash, label."""
    return mentions.join(stored.where("label = 'affirms'").select("belief", "line_hash").distinct(), ["belief", "line_hash"], "left_semi").select("belief", "agent", "minute").distinct()


def requests(rows: DataFrame, prompt: str, text: str, stored: DataFrame, most: int, price: int = 1) -> DataFrame:
    """request, text: what still has to be asked outside, within the cap of `most` units at `price` for each request.

    A request is told by the hash of the prompt and the text without secrets; equal requests are asked once, answered ones
    (stored: request) not again. Which ones fit the cap follows from their hashes alone. The place of a request is taken
    from counts by hash range first, so no task sorts them all.
    """
    asked = rows.select(scrub_secrets(F.col(text)).alias("text")).where("text IS NOT NULL").distinct()
    asked = asked.withColumn("request", F.sha2(F.concat(F.lit(prompt + "\n"), "text"), 256)).join(stored.select("request").distinct(), "request", "left_anti")
    ranged = asked.withColumn("_range", F.conv(F.substring("request", 1, 3), 16, 10).cast("long"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 4096 ranges at most
    carried = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("request"))
    return ranged.withColumn("_own", own).join(carried, "_range").where((F.col("_before") + F.col("_own")) * price <= most).select("request", "text")


def people(texts: DataFrame, text: str, finder: Callable[[list[str]], list[str]], known: DataFrame, size: int = 40) -> DataFrame:
    """word: names that a finder gives for batches of distinct texts, and each part of a full name, but words of known (word, any case)."""
    distinct_texts = texts.select(F.sha2(text, 256).alias("line_hash"), F.col(text).alias("line")).where("line <> ''")
    found = batches(distinct_texts, lambda part: [[{"word": w} for w in finder(part)], *[None] * (len(part) - 1)], size, "word string")
    names = found.where("no >= 0").select(F.trim("word").alias("word")).where(F.char_length("word") >= 2)
    parts = names.where(F.contains("word", F.lit(" "))).select(F.explode(F.regexp_extract_all("word", F.lit(r"([A-Za-z][A-Za-z'-]+)"), F.lit(1))).alias("word")).where(F.char_length("word") >= 3)
    own = known.select(F.lower("word").alias("_own")).distinct()
    return names.unionByName(parts).distinct().join(own, F.lower("word") == F.col("_own"), "left_anti")


def overlay(strong: Column, cheap: Column) -> Column:
    """The strong model's label where there is one."""
    return F.coalesce(strong, cheap)


def planned(label: Column, line: Column, plan: str, done: str) -> Column:
    """A line that affirms by announcing, and not yet by reporting, is a plan."""
    return F.when((label == "affirms") & line.rlike(plan) & ~line.rlike(done), "plan").otherwise(label)


def state(affirms: Column, denies: Column) -> Column:
    """holds, both, denies or absent, from what stances a version has."""
    return F.when(affirms & denies, "both").when(affirms, "holds").when(denies, "denies").otherwise("absent")


def weight(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[label]
