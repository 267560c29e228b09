"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are byte-level BPE tokens plus one end token (token_ids() makes them; any column of lengths does). A text longer
than the largest permitted length is cut into pieces of that length and a rest. Pieces are dealt into shards of about
`shard_rows`, sorted by falling length, and streamed: each piece goes to the open bin that it leaves fullest; if none has
room, a bin of the least-cost permitted length is opened, by price for each token that the bin can still get. Which
lengths may be opened is optimised jointly: every set of them that holds the longest piece is tried, after packing each
bin is downsized to the smallest permitted length that holds its contents, and the trial with the least total price wins
its shard. Only ids and lengths are shuffled. sequences() then fills the bins with the tokens.

A task holds at most `block` pieces: a longer shard is packed block by block.

Defined results: a null or blank text without tokens has length 1 (its end token); of bins with equal room the one opened
or filled last takes a piece, of equal lengths the smaller id goes first; rows with a null id are packed like others;
repeated rows are packed each by itself; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITIES = (256, 512, 1024, 2048, 4096, 8192)


def price(capacity: int) -> float:
    """Cost of one sequence: its tokens, a fixed overhead, and attention that grows with the square of its length."""
    return capacity + 64 + capacity * capacity / 65536


def opening(length: int, rest: int, allowed: tuple[int, ...], cost: Callable[[int], float] = price) -> int:
    """The permitted length to open for a piece: least price per token that it and the rest of the pieces can fill."""
    return min((c for c in allowed if c >= length), key=lambda c: (cost(c) / min(c, length + rest), c))


def best_fit(lengths: list[int], allowed: tuple[int, ...], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = price) -> tuple[float, list[int], list[int], list[int]]:
    """(total price after downsizing, bin of each piece, offset of each piece, final capacity of each bin).

    lengths fall. Open bins are stacked by free space; a bit mask finds the least free space that is enough.
    """
    free: dict[int, list[int]] = {}
    mask, rest = 0, sum(lengths)
    where, offset, room, used = [], [], [], []
    for n in lengths:
        rest -= n
        fit = mask >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask ^= 1 << left
        else:
            b, left = len(used), opening(n, rest, allowed, cost)
            used.append(0)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        if left > n:
            free.setdefault(left - n, []).append(b)
            mask |= 1 << (left - n)
    final = [min(c for c in capacities if c >= u) for u in used]
    return sum(map(cost, final)), where, offset, final


def pack_block(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = price) -> tuple[float, list[int], list[int], list[int]]:
    """The cheapest of the packings that open only the lengths of some set that holds the longest piece."""
    longest = max(lengths)
    trials = [t for n in range(1, len(capacities) + 1) for t in combinations(capacities, n) if t[-1] >= longest]
    return min((best_fit(lengths, t, capacities, cost) for t in trials), key=lambda x: x[0])


@lru_cache(maxsize=1)
def encoding(path: str, pattern: str):
    """The public tokenizer, once a worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", only_lengths: bool = False) -> DataFrame:
    """id, sign, n_tokens and, unless only_lengths, ids: the tokens of each row with an end token (the first free id). sign: a hash of the text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounds the tokens in memory
                part = b.slice(at, 256)
                found = [e.encode_to_numpy(x or "", disallowed_special=()) for x in part.column(2).to_pylist()]
                cols, names = [*part.columns[:2], pa.array([len(x) + 1 for x in found], pa.int64())], ["id", "sign", "n_tokens"]
                if not only_lengths:
                    cols, names = [*cols, pa.array([[*x.tolist(), e.n_vocab] for x in found], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    shape = f"id {kind}, sign long, n_tokens long" + ("" if only_lengths else ", ids array<int>")
    return docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("sign"), F.col(text).alias("t")).mapInArrow(run, shape)


def pieces(rows: DataFrame, largest: int) -> DataFrame:
    """id, sign, n_tokens, piece, start, length."""
    cut = rows.select("id", "sign", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / largest))).alias("piece"))
    return cut.select("id", "sign", "n_tokens", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n_tokens") - F.col("piece") * largest).alias("length"))


def pack(lengths: DataFrame, n: int, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = 100_000, block: int = 500_000) -> DataFrame:
    """doc_id, sign, piece, start, length, bin_id, bin_offset, capacity, bin_used: a row for each piece of each row of lengths.

    lengths: id, sign, n_tokens (at least 1), n rows.
    """
    capacities = tuple(sorted(set(capacities)))
    rows = pieces(lengths, capacities[-1])
    shards = max(1, -(-n // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "n_tokens", "sign"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard", F.desc("length"), "id", "piece", "sign")

    def emit(shard: int, number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lengths = t.column("length").to_pylist()
        _, where, offset, final = pack_block(lengths, capacities)
        used = [0] * len(final)
        for b, n in zip(where, lengths):
            used[b] += n
        ids = pa.array([f"{shard}-{number}-{b}" for b in where])
        cols = [t.column(c).combine_chunks() for c in ("id", "sign", "piece", "start", "length")] + [ids, pa.array(offset, pa.int64()), pa.array([final[b] for b in where], pa.int64()), pa.array([used[b] for b in where], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "sign", "piece", "start", "length", "bin_id", "bin_offset", "capacity", "bin_used"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, held, n = None, 0, [], 0
        for b in batches:
            at = 0
            marks = b.column(5).to_pylist()
            while at < len(marks):
                if marks[at] != shard or n >= block:
                    if held:
                        yield emit(shard, number, held)
                    number = number + 1 if marks[at] == shard else 0
                    shard, held, n = marks[at], [], 0
                end = at
                while end < len(marks) and marks[end] == shard and n + end - at < block:
                    end += 1
                held.append(b.slice(at, end - at))
                n, at = n + end - at, end
        if held:
            yield emit(shard, number, held)

    kind = rows.schema["id"].dataType.simpleString()
    dealt = dealt.select("id", "sign", "piece", "start", "length", "shard")
    return dealt.mapInArrow(run, f"doc_id {kind}, sign long, piece long, start long, length long, bin_id string, bin_offset long, capacity long, bin_used long")


def sequences(packed: DataFrame, tokens: DataFrame) -> DataFrame:
    """bin_id, capacity, ids, doc_ids, starts: the packed sequences, with the place where each piece starts in ids.

    packed: of pack(); tokens: of token_ids(). Rows of one id and text have the same tokens. A bin holds at most its capacity.
    """
    one = tokens.select(F.col("id").alias("_id"), F.col("sign").alias("_sign"), "ids").dropDuplicates(["_id", "_sign"])
    cut = packed.join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sign") == F.col("_sign")))
    part = F.struct("bin_offset", "doc_id", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    bins = cut.groupBy("bin_id", "capacity").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    each = lambda name: F.transform("parts", lambda x: x[name])
    return bins.select("bin_id", "capacity", F.flatten(each("ids")).alias("ids"), each("doc_id").alias("doc_ids"), each("bin_offset").alias("starts"))


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """pack() of the texts of docs by their byte-level BPE tokens."""
    import public_tokenizers

    lengths = token_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, key, text, only_lengths=True)
    return pack(lengths, docs.count(), **how).drop("sign")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
