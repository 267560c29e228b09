"""Lines that share most of their words: a set-similarity join by rare-word prefixes, and the check of given pairs.

The score of two lines is twice the length of their shared words over that plus the length of either line's words, at its
best, of 100: the parts of the token set ratio that rest on shared words. (Its third part compares the letters of what
is left, which at 60 takes pairs of lines that share no word; exact() has it, for pairs that something else ties together.)
So a pair is alike if the shared words make up enough of the shorter line: see enough().

The join finds every such pair without all pairs. A line's words are sorted from rare to frequent; if another line shares
none of the first ones, what is left weighs too little. So the prefix of the shorter line meets all words of the longer
one, and frequent words are met only by lines that have hardly any other. similar() packs lines in blocks of bounded size, as
64-bit hashes of their words, and writes them once. Every block of asked lines meets every block of lines in a task of its
own, which reads both again: what is read grows with the square of the lines, what is shuffled and written with the lines.
candidates() and checked() are the same join in rows: the one makes the pairs that meet, the other checks given pairs, as
alike() does from the lines themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import token_set_ratio_udf
from ..functions.overlap import Block, Sets
from ..sources.scratch import written

LEAST = 60
TILE = 1 << 21  # words of a block
WORD = r"([^\x20\x09-\x0D]+)"
OTHER = r"[\x1C-\x1F\u0085   -     　]"  # white space of Unicode; in ranges, which match several times as fast as a list
MARK = "*"


def words(lines: DataFrame) -> DataFrame:
    """h, token, w: the distinct words of each line (h, line), once a digest, and their length with a separator."""
    rows = lines.groupBy("h").agg(F.min("line").alias("line")).select("h", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(WORD), F.lit(1)))).alias("token"))
    return rows.withColumn("w", F.char_length("token") + 1)


def enough(weight: Column, size: Column, least: int = LEAST) -> Column:
    """Whether shared words of this weight make lines alike of which the shorter one has this size. In whole numbers."""
    return (200 - least) * (weight - 1) >= least * (size - 1)


def ranked(rows: DataFrame) -> DataFrame:
    """h, token, w, size, left: left is what a line's words weigh from this one on, rare ones first; ties by the word."""
    counts = rows.groupBy("token").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("h").orderBy("_n", "token")  # the words of one line
    both = rows.join(counts, "token").withColumn("size", F.sum("w").over(Window.partitionBy("h")))
    return both.withColumn("left", F.col("size") - F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")


def candidates(rows: DataFrame, asked: DataFrame, least: int = LEAST) -> DataFrame:
    """a, b: lines that may be alike, b of asked (h). rows: of ranked()."""
    side = lambda df, c: df.select("token", F.col("h").alias(c), F.col("size").alias(f"_s{c}"), enough(F.col("left"), F.col("size"), least).alias(f"_p{c}"))
    every, some = side(rows, "a"), side(rows.join(asked.select("h").distinct(), "h", "left_semi"), "b")
    # a join for each of the two that may be shorter: with one for both, all words would meet all words before anything is left out
    met = every.where("_pa").join(some, "token").where("_sa <= _sb").unionByName(every.join(some.where("_pb"), "token").where("_sa > _sb"))
    return met.where("a <> b").select("a", "b").distinct()


def checked(pairs: DataFrame, rows: DataFrame, least: int = LEAST) -> DataFrame:
    """a, b, score: those of pairs (a, b) that are alike, and their score. rows: h, token, w."""
    # the words of one line, as one string that is cut again where two lines meet: no word has a space, and an array takes a shuffle twice the bytes
    sets = rows.groupBy("h").agg(F.array_join(F.collect_set("token"), " ").alias("t"), F.sum("w").alias("s"))
    side = lambda c: sets.select(F.col("h").alias(c), F.col("t").alias(f"_t{c}"), F.col("s").alias(f"_s{c}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    shared = F.aggregate(F.array_intersect(F.split("_ta", " "), F.split("_tb", " ")), F.lit(0).cast("long"), lambda x, t: x + F.char_length(t) + 1)
    short = F.least("_sa", "_sb")
    both = both.withColumn("_o", shared).where((F.col("_o") > 0) & enough(F.col("_o"), short, least))
    return both.select("a", "b", (200 * (F.col("_o") - 1) / (F.col("_o") + short - 2)).alias("score"))


def alike(pairs: DataFrame, lines: DataFrame, least: int = LEAST) -> DataFrame:
    """a, b, score: checked() of lines (h, line): each goes through one shuffle as it is, and is cut into words where it is asked for."""
    pairs = pairs.select("a", "b").distinct()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    cut = F.array_join(F.array_distinct(F.regexp_extract_all("line", F.lit(WORD), F.lit(1))), " ")
    sets = lines.select("h", "line").join(asked, "h", "left_semi").dropDuplicates(["h"]).select("h", cut.alias("t"))
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("t").alias("_ta")), "a").join(sets.select(F.col("h").alias("b"), F.col("t").alias("_tb")), "b")
    shared = F.aggregate(F.array_intersect(F.split("_ta", " "), F.split("_tb", " ")), F.lit(0).cast("long"), lambda x, t: x + F.char_length(t) + 1)
    short = F.least(F.char_length("_ta"), F.char_length("_tb")).cast("long") + 1  # every word counts with its separator
    both = both.where((F.col("_ta") != "") & (F.col("_tb") != "")).withColumn("_o", shared).where((F.col("_o") > 0) & enough(F.col("_o"), short, least))
    return both.select("a", "b", (200 * (F.col("_o") - 1) / (F.col("_o") + short - 2)).alias("score"))


def sets(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """h, tokens, weights, asked: the hashes of the distinct words of each line (h, line) and their lengths with a separator; whether asked (h) has it."""
    rows = lines.select("h", F.array_distinct(F.regexp_extract_all("line", F.lit(WORD), F.lit(1))).alias("_t")).where(F.size("_t") > 0).dropDuplicates(["h"])
    rows = rows.join(asked.select("h", F.lit(True).alias("asked")).distinct(), "h", "left")
    return rows.select("h", F.transform("_t", lambda t: F.xxhash64(t)).alias("tokens"), F.transform("_t", lambda t: (F.char_length(t) + 1).cast("int")).alias("weights"), F.coalesce("asked", F.lit(False)).alias("asked"))


def blocks(rows: DataFrame, n: int) -> DataFrame:
    """block, h, words, weights, tokens, lengths: the lines of sets() in n blocks, a row each that holds functions.overlap.Sets as bytes. Written once."""

    def packed(parts: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts)
        part = part.filter(pa.compute.equal(part["block"], block))
        of = lambda c: part[c].combine_chunks().flatten().to_numpy()
        s = Sets.of(of("tokens"), of("weights"), pa.compute.list_value_length(part["tokens"].combine_chunks()).to_numpy())
        whole = [pa.array([x.tobytes()], pa.binary()) for x in (s.words, s.weights, s.tokens, s.lengths)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part["h"].to_pylist()], pa.list_(pa.string())), *whole], ["block", "h", "words", "weights", "tokens", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = list(batches)
        for block in sorted({k for b in have for k in b.column("block").unique().to_pylist()}):
            yield packed(have, block)

    placed = rows.select(F.pmod(F.xxhash64("h"), F.lit(n)).cast("int").alias("block"), "h", "tokens", "weights").repartitionById(n, F.col("block"))
    return written(placed.mapInArrow(run, "block int, h array<string>, words binary, weights binary, tokens binary, lengths binary"))


def cells(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """A row for each block of asked lines and block of lines, as structs `some` and `every`. Blocks have some `tile` words at most.

    They are read again from where they are written for each cell, so nothing is shuffled: what is on disk grows with the lines.
    """
    n = F.size("tokens").cast("long")
    words, some = rows.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asked"), n)), F.lit(0))).first()
    across = max(1, -(-some // tile))
    down = max(1, -(-words // tile), -(-3 * rows.sparkSession.sparkContext.defaultParallelism // across))
    every, asked = blocks(rows, down), blocks(rows.where("asked"), across)
    one = lambda df, c: df.select(F.struct(*df.columns).alias(c))
    return one(asked, "some").hint("shuffle_replicate_nl").crossJoin(one(every, "every"))


def _unpacked(cell: dict) -> Sets:
    kinds = {"words": np.int64, "weights": np.int32, "tokens": np.int32, "lengths": np.int32}
    return Sets(**{c: np.frombuffer(cell[c].as_buffer(), kind) for c, kind in kinds.items()})


def _met(block: Block, every: dict, asked: pa.Array) -> Iterator[pa.RecordBatch]:
    """a, b, weight, short, long: the pairs of one cell."""
    sets, lines = _unpacked(every), every["h"].values
    sizes, out, n = sets.sizes, [], 0

    def batch() -> pa.RecordBatch:
        i, j, weight, short, long = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([lines.take(pa.array(i)), asked.take(pa.array(j)), pa.array(weight), pa.array(short), pa.array(long)], ["a", "b", "weight", "short", "long"])

    for i, j, weight, short, long in block.alike(sets):
        out.append((np.full(len(j), i), j, weight, short, long))
        n += len(j)
        if n >= 1 << 16:
            yield batch()
            out, n = [], 0
    if out:
        yield batch()


def overlapping(lines: DataFrame, asked: DataFrame, least: int = LEAST, tile: int = TILE) -> DataFrame:
    """a, b, weight, short, long: every pair of a line (h, line) and another one of asked (h) that is alike, what they share, and their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for b in batches:
            for row in b.to_struct_array():
                some, every = row["some"], row["every"]
                if at != some["block"].as_py():
                    at, block = some["block"].as_py(), Block(_unpacked(some), least)
                yield from _met(block, every, some["h"].values)

    return cells(written(sets(lines, asked)), tile).mapInArrow(run, "a string, b string, weight long, short long, long long").where("a <> b")


def similar(lines: DataFrame, asked: DataFrame, least: int = LEAST, tile: int = TILE) -> DataFrame:
    """a, b, score: every pair of a line (h, line) and another one of asked (h) that is alike."""
    met = overlapping(lines, asked, least, tile)
    return met.select("a", "b", (200 * (F.col("weight") - 1) / (F.col("weight") + F.col("short") - 2)).alias("score"))


def size(line: str) -> Column:
    """What the distinct words of a line weigh; null if white space that is none of WORD's cuts it, so that token_set_ratio sees other words."""
    cut = F.array_distinct(F.regexp_extract_all(line, F.lit(WORD), F.lit(1)))
    return F.when(~F.col(line).rlike(OTHER), F.aggregate(cut, F.lit(0).cast("long"), lambda x, t: x + F.char_length(t) + 1))


def marked(lines: DataFrame) -> DataFrame:
    """h, line: with a mark behind the digests of lines that have no size()."""
    return lines.select(F.concat("h", F.when(F.col("line").rlike(OTHER), MARK).otherwise("")).alias("h"), "line")


def marks(asked: DataFrame) -> DataFrame:
    """h: what marked() may make of digests."""
    return asked.select(F.explode(F.array(F.col("h"), F.concat("h", F.lit(MARK)))).alias("h"))


def known(met: DataFrame, close: DataFrame, least: int = LEAST) -> DataFrame:
    """fact, h, shared, score: of pairs whose token set ratio may be `least` or of two shared anchors, the ratio, null where it takes the texts.

    met: fact, h as bytes, shared, short, long, odd, a row for each shared anchor; close: of overlapping() over marked() lines,
    every pair whose shared words alone make it alike. Letters of what is left could make a ratio of 200 times the shorter
    length over both at most. If that is no more than the shared words make, the ratio is theirs.
    """
    digest = lambda c: F.unhex(F.rtrim(F.col(c), F.lit(MARK)))
    odd = F.col("a").endswith(MARK) | F.col("b").endswith(MARK)
    close = close.select(digest("b").alias("fact"), digest("a").alias("h"), F.lit(0).cast("long").alias("shared"), "weight", "short", "long", odd.alias("odd"))
    pairs = met.withColumn("weight", F.lit(None).cast("long")).unionByName(close).groupBy("fact", "h").agg(F.sum("shared").alias("shared"), *[F.max(c).alias(c) for c in ("weight", "short", "long", "odd")])
    words, most = 200 * (F.col("weight") - 1) / (F.col("weight") + F.col("short") - 2), 200 * (F.col("short") - 1) / (F.col("short") + F.col("long") - 2)
    pairs = pairs.where(F.col("odd") | F.col("weight").isNotNull() | (F.col("shared") >= 2) | (most >= least))
    return pairs.select("fact", "h", "shared", F.when(~F.col("odd") & (most <= words), words).alias("score"))


def exact(pairs: DataFrame, lines: DataFrame, least: int = LEAST) -> DataFrame:
    """a, b, score: those of pairs (a, b) whose token set ratio is at least `least`, all its parts compared."""
    one = lines.groupBy("h").agg(F.min("line").alias("line"))
    both = pairs.select("a", "b").distinct().join(one.select(F.col("h").alias("a"), F.col("line").alias("_a")), "a").join(one.select(F.col("h").alias("b"), F.col("line").alias("_b")), "b")
    return both.select("a", "b", token_set_ratio_udf("_a", "_b").alias("score")).where(F.col("score") >= least)
