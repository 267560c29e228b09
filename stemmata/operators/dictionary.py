"""Dictionaries of any size looked up in texts: names masked, and where each was found.

A dictionary is a table of entries. It is cut into shards of bounded size; each is sent to the workers by broadcast, which
build an Aho-Corasick automaton of it and read a block of texts in one pass, whatever the number of entries. A block passes
through the shards in turn, so a worker holds one automaton at a time; texts are never shuffled. An entry is found as a
whole word in any case; of overlapping ones the first counts, of those that start together the longest, as a regular
expression of all entries, longest first, would say.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOM = 4 << 20  # bytes of the entries of one shard
BLOCK = 64 << 20  # bytes of the texts that pass through the shards together


@lru_cache(maxsize=1 << 16)
def _folded(c: str) -> str:
    upper = c.upper()
    upper = upper if len(upper) == 1 else c
    lower = upper.lower()
    return lower if len(lower) == 1 else upper


def folded(text: str) -> str:
    """The text without case, letter by letter, so places stay."""
    return text.lower() if text.isascii() else "".join(map(_folded, text))


@lru_cache(maxsize=1 << 16)
def is_word(c: str) -> bool:
    """Whether a character is part of a word, as Unicode has it."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "‌‍"


def automaton(entries: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for e in entries:
        a.add_word(e, len(e))
    if len(a):
        a.make_automaton()
    return a


def occurrences(a, text: str) -> list[tuple[int, int]]:
    """(start, end) of every entry that stands in the text as a whole word."""
    if not len(a):
        return []
    low, out = folded(text), []
    for last, n in a.iter(low):
        start, end = last + 1 - n, last + 1
        if (not start or not is_word(text[start - 1])) and (end == len(text) or not is_word(text[end])):
            out.append((start, end))
    return out


def first_longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that a reader from left to right takes."""
    out, at = [], 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out.append((start, end))
            at = end
    return out


def shards(words: DataFrame, word: str, room: int = ROOM) -> list:
    """Broadcasts of the distinct entries, without case, of `room` bytes each, by measured size."""
    spark = words.sparkSession
    entries = words.select(F.col(word).alias("w")).where("w <> ''").distinct()
    count = max(1, -(-(entries.agg(F.sum(F.octet_length("w"))).first()[0] or 0) // room))
    out = []
    for i in range(count):  # one bounded shard at a time reaches the driver
        part = entries.where(F.pmod(F.xxhash64("w"), F.lit(count)) == i)
        out.append(spark.sparkContext.broadcast(pickle.dumps(sorted({folded(r[0]) for r in part.toLocalIterator()}))))  # bytes, which a worker keeps smaller than words
    return out


def found(texts: DataFrame, text: str, words: DataFrame, word: str, room: int = ROOM, block: int = BLOCK) -> DataFrame:
    """texts with _spans, an array of struct(start, end) in code points: the entries that a reader from left to right takes."""
    names = texts.columns
    at = names.index(text)
    given = shards(words, word, room)
    shape = texts.withColumn("_spans", F.array().cast("array<struct<start:int,end:int>>")).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the automaton of an only shard is built once

        def read(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kept
            every: list[list[list[tuple[int, int]]]] = [[[] for _ in range(b.num_rows)] for b in part]
            for entries in given:
                a = kept or automaton(pickle.loads(entries.value))
                for b, spans in zip(part, every):
                    for t, s in zip(b.column(at), spans):
                        s += occurrences(a, t.as_py() or "")
                kept = a if len(given) == 1 else None
                del a
            for b, spans in zip(part, every):
                shown = [[{"start": s, "end": e} for s, e in first_longest(x)] for x in spans]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shown, kind)], [*names, "_spans"])

        part, size = [], 0
        for b in batches:
            part.append(b)
            size += b.nbytes
            if size >= block or len(given) == 1:
                yield from read(part)
                part, size = [], 0
        yield from read(part)

    return texts.mapInArrow(run, shape)


def masked(texts: DataFrame, text: str, words: DataFrame, word: str, by: str = "[person]", room: int = ROOM) -> DataFrame:
    """texts with every entry of the dictionary replaced in column `text`, and `masked`, how many there were."""
    spans = found(texts, text, words, word, room)
    shown = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(by)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(text))),
    )
    n = F.size("_spans").cast("long").alias("masked")
    return spans.select(*[(F.when(F.size("_spans") > 0, shown).otherwise(F.col(c)) if c == text else F.col(c)).alias(c) for c in texts.columns], n)
