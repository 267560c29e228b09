"""Quotes looked up in texts: which rows hold which of many quotes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squashed
from .dictionary import automaton

ROOM = 8 << 20  # bytes of quotes that may be sent to every task


def holders(docs: DataFrame, key: str, quotes: DataFrame, item: str, text: str, room: int = ROOM) -> DataFrame:
    """key, item: rows of docs whose text holds a quote, case and white space aside; empty quotes are held by none.

    Texts are normalised once and never shuffled: distinct quotes of `room` bytes by measured size are sent to the workers,
    which find them all in one pass by an Aho-Corasick automaton. More quotes are taken round by round. Only the hashes of
    what was found meet the items.
    """
    given = quotes.select(F.col(item).alias("item"), squashed(F.col(text)).alias("q")).where("q <> ''").withColumn("sign", F.xxhash64("q"))
    one = given.select("q", "sign").distinct()
    rounds = max(1, -(-(one.agg(F.sum(F.octet_length("q"))).first()[0] or 0) // room))
    texts = docs.select(F.col(key).alias("key"), squashed(F.col(text)).alias("t"))
    kind = texts.schema["key"].dataType.simpleString()
    found = None
    for nth in range(rounds):  # one bounded part at a time reaches the driver
        part = one.where(F.pmod("sign", F.lit(rounds)) == nth)
        sent = docs.sparkSession.sparkContext.broadcast([(r.q, r.sign) for r in part.toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            a, sign = automaton([q for q, _ in sent.value]), dict(sent.value)
            for b in batches:
                keys, signs = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    if t and len(a):
                        held = {sign[t[last + 1 - n : last + 1]] for last, n in a.iter(t)}
                        keys += [i] * len(held)
                        signs += held
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(signs, pa.int64())], ["key", "sign"])

        step = texts.mapInArrow(run, f"key {kind}, sign long")
        found = step if found is None else found.unionByName(step)
    return found.join(given.select("item", "sign"), "sign").select(F.col("key").alias(key), F.col("item").alias(item)).distinct()
