"""Language-model scoring by Katz backoff over word n-grams of any order.

Tokens are lower-cased (A-Z) words and one end token a text. A history holds the order - 1 tokens before a token, as far
back as the start of the text, which counts as one token of the history.

    p(w | h) = d(c(h w)) c(h w) / c(h)        if h w was seen in training,
               alpha(h) p(w | h')             otherwise; h' is h without its first token, alpha = 1 for an unseen h
    p(w)     = d(c(w)) c(w) / N, and what is left of the mass for one unknown word

d is the Good-Turing discount of Katz for counts up to DISCOUNTED, from the counts of counts of the same order, 1 where
these give no value in (0, 1). alpha(h) = (1 - sum of the seen p(w | h)) / (1 - sum of their p(w | h')), so every
distribution sums to one. A history whose counts are all above DISCOUNTED has nothing left for unseen words; its counts
are divided by c(h) + 1.

Tables. Counts stand in tables in the shared folder: of words by hash range and by chunk, of n-grams by history and chunk,
each with the sums that its backoff weights need. Documents are dealt into chunks, whose words are numbered once and
kept as a compressed row each; texts are not read again. Level by level, a chunk asks the buckets about its n-grams, with its own training counts,
and a bucket, having summed the counts of all chunks, answers with the totals and the sums that alpha needs; words are
partitioned by hash, n-grams by history. A history that occurs in one chunk only is that chunk's own business: its counts
are final there, and nobody is asked. The sum of p(w | h') over the seen w needs no
probabilities, as p(w | h') = d(c) c / c(h') with c = c(h' w): the asker sends these counts, the bucket returns how many
are 1, 2, .. DISCOUNTED and the sum of the others, and alpha is computed from whole numbers alone.

Histories that hold more than half a bucket's share of all tokens are hot: their n-grams are dealt over as many buckets
as their count asks for, and their sums are added up and sent back by a grouped sum and an equality join. A bucket holds
one entry of an n-gram for each chunk that has it. All counts cover all training documents; only the counts of counts
reach the driver.

Words and histories are told apart by 64-bit hashes. Defined results: a null or blank text is its end token alone; rows
with a null id are training rows; repeated rows count each time; very long texts are scored whole; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blobs import chunk_of, hash_bounds, packed, text_bytes, unpacked
from .components import dropped, saved

ORDER, DISCOUNTED, CHUNK, BUCKET, ROUNDS = 3, 5, 8 << 20, 3_000_000, 1
UNKNOWN, START, FIRST = 0, 1, 2  # ids of words
FOLDS, HELD = 5, 1
SUMS = 2 * DISCOUNTED + 1  # of a history: n-grams of count 1 .., suffixes of count 1 .., sum of the higher suffix counts


def discounts(counts: list[int], most: int = DISCOUNTED) -> np.ndarray:
    """d(1) .. d(most) from counts of counts n(1) .. n(most + 1)."""
    n = [0, *counts]
    cut = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    out = np.ones(most + 1)
    for r in range(1, most + 1):
        if n[1] and n[r] and cut < 1:
            d = ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut)
            out[r] = d if 0 < d < 1 else 1.0
    return out


def discounted(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    """d(c) c."""
    return np.where(count <= DISCOUNTED, d[np.minimum(count, DISCOUNTED)], 1.0) * count


@dataclass(frozen=True)
class Unigrams:
    """p(w) by count."""

    tokens: int
    kinds: int
    d: np.ndarray
    divisor: float
    unknown: float

    @classmethod
    def of(cls, tokens: int, kinds: int, counts: list[int]) -> Unigrams:
        d = discounts(counts)
        left = sum((1 - d[r]) * r * counts[r - 1] for r in range(1, DISCOUNTED + 1))
        divisor = tokens if left > 0 else tokens + 1
        return cls(tokens, kinds, d, float(max(divisor, 1)), (left if left > 0 else 1.0) / max(divisor, 1))

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(self.d, count) / self.divisor, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


class Tokens:
    """The tokens of a chunk's texts: `word` indexes `hash`, the sorted distinct hashes."""

    END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds white space

    def __init__(self, texts: list[bytes | None]):
        words = [(t or b"").lower().split() for t in texts]
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        h = xxhash.xxh3_64_intdigest
        n = int(self.size.sum())
        x = np.empty(n, np.uint64)
        last = np.cumsum(self.size) - 1
        own = np.ones(n, bool)
        own[last] = False
        x[own] = np.fromiter((h(w) for ws in words for w in ws), np.uint64, n - len(words))
        x[last] = self.END
        self.hash, self.word = np.unique(x, return_inverse=True)


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(c[(c > 0) & (c <= DISCOUNTED + 1)], minlength=DISCOUNTED + 2)[1:].tolist()


def _first(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return new


ANSWER = "kind int, bucket long, chunk long, a binary, b binary, c binary, stats array<long>"
FORM = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(FORM), FORM.types)], schema=FORM)


def _sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x.view(np.int64), prepend=0))


CELLS = ("size", "train", "word")  # of a chunk: words and whether to learn of each text, and the word of each token


def encoded(dealt: DataFrame, kind: str) -> DataFrame:
    """A row a chunk: ids, the CELLS, and hash of each of its words; the words of tokens count by falling frequency in the chunk."""
    key = to_arrow_type(dealt.schema["_id"].dataType)
    form = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(key)), *[(c, pa.binary()) for c in (*CELLS, "hash", "rank")]])

    def encode(docs: pa.Table) -> pa.Table:
        t = Tokens(docs.column("_text").cast(pa.binary()).to_pylist())
        order = np.argsort(-np.bincount(t.word, minlength=len(t.hash)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        train = docs.column("_train").to_numpy(zero_copy_only=False).astype(np.int64)
        cells = (docs.column("_chunk")[0].as_py(), docs.column("_id").to_pylist(), packed(t.size), packed(train), packed(rank[t.word]), _sorted(t.hash), packed(rank))
        return pa.table([pa.array([x], f) for x, f in zip(cells, form.types)], schema=form)

    return dealt.groupBy("_chunk").applyInArrow(encode, f"chunk long, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in (*CELLS, "hash", "rank")))


def word_table(cells: DataFrame, buckets: int) -> DataFrame:
    """Kind 0: a bucket's words (a: hashes, b: counts; stats: N, V, n1 ..). Kind 1: to a chunk, c: words as the chunk numbers them,
    a: their ids, b: twice their counts in training, 1 more if no other chunk has the word."""
    edge = hash_bounds(buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, train, word = (unpacked(row[c]) for c in CELLS)
                h, rank = np.cumsum(unpacked(row["hash"])).view(np.uint64), unpacked(row["rank"])
                n = np.bincount(word, weights=np.repeat(train, size), minlength=len(h)).astype(np.int64)[rank]
                cut = [0, *np.searchsorted(h, edge).tolist(), len(h)]
                rows = [(0, b, row["chunk"], _sorted(h[p:q]), packed(n[p:q]), packed(rank[p:q]), None) for b, (p, q) in enumerate(zip(cut, cut[1:])) if q > p]
                yield from _table(rows).combine_chunks().to_batches()

    def answer(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        hashes = [np.cumsum(unpacked(x)) for x in table.column("a").to_pylist()]
        h, place = np.unique(np.concatenate(hashes).view(np.uint64), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([unpacked(x) for x in table.column("b").to_pylist()]), minlength=len(h)).astype(np.int64)
        rank = np.empty(len(h), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(h))
        seen = total > 0
        ids = np.where(seen, FIRST + rank * buckets + b, UNKNOWN)
        told = total * 2 + (np.bincount(place) == 1)
        rows = [(0, b, None, _sorted(h[seen]), packed(total[seen]), None, [int(total.sum()), int(seen.sum()), *counts_of_counts(total)])]
        p = 0
        for chunk, x, words in zip(table.column("chunk").to_pylist(), hashes, table.column("c").to_pylist()):
            at = place[p : p + len(x)]
            rows.append((1, b, chunk, packed(ids[at]), packed(told[at]), words, None))
            p += len(x)
        return _table(rows)

    return cells.mapInArrow(ask, ANSWER).groupBy("bucket").applyInArrow(answer, ANSWER)


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of an n-gram, from that of its history and the id of its word."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)  # fixed values: odd multipliers of public mixers
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


@dataclass
class Grams:
    """The distinct n-grams of a chunk at one level. `at`: which ends at each position, -1 for none."""

    at: np.ndarray
    hash: np.ndarray
    own: np.ndarray  # training count in this chunk
    suffix: np.ndarray  # which n-gram of the level below ends it
    count: np.ndarray = field(default=None)  # training count in all chunks
    alone: np.ndarray = field(default=None)  # whether no other chunk has it
    # of the level's histories, by their place among the n-grams of the level below: sums as in SUMS
    sums: np.ndarray = field(default=None)


class Stream:
    """A chunk's tokens with a start before each text, and its n-grams level by level."""

    def __init__(self, row: dict, words: list[tuple[np.ndarray, np.ndarray, np.ndarray]], starts: int):
        """words: (words, ids, counts) by bucket, as word_table() answers."""
        self.ids, self.size, train, word = row["ids"], *(unpacked(row[c]) for c in CELLS)
        place, given_ids, given_counts = (np.concatenate(x) for x in zip(*words))
        wid, count = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        wid[place], count[place] = given_ids, given_counts
        self.train_row, self.kinds = train, len(wid) + 1
        total = self.size + 1
        begin = np.cumsum(total) - total
        self.first = np.zeros(int(total.sum()), bool)
        self.first[begin] = True
        self.word = np.full(len(self.first), len(wid))
        self.word[~self.first] = word
        self.train = np.repeat(train, total)
        self.wid = np.append(wid, START)
        n = np.bincount(self.word, weights=self.train, minlength=self.kinds).astype(np.int64)
        zero = np.zeros(self.kinds, np.uint64)
        self.levels = [Grams(self.word, _mix(zero, self.wid), n, np.zeros(self.kinds, np.int64), np.append(count >> 1, starts), np.append(count & 1, 0) > 0)]

    def histories(self, low: Grams) -> tuple[np.ndarray, np.ndarray]:
        """(positions behind a seen n-gram of level low, which one)."""
        before = np.append([-1], low.at[:-1])
        before[self.first] = -1
        known = np.nonzero(np.append(low.count, 0)[before] > 0)[0]
        return known, before[known]

    def follow(self) -> Next:
        return Next(self)


class Next:
    """The next level of a stream: its n-grams, and what is asked about them, by bucket."""

    def __init__(self, s: Stream):
        low = s.levels[-1]
        self.known, self.history = s.histories(low)
        seen = np.append(low.count, 0)[low.at[self.known]] > 0  # only where the suffix was seen can the whole be
        i = self.known[seen]
        key, place = np.unique(self.history[seen] * s.kinds + s.word[i], return_inverse=True)
        self.head, word = key // s.kinds, key % s.kinds
        at = np.full(len(s.word), -1)
        at[i] = place
        suffix = np.empty(len(key), np.int64)
        suffix[place] = low.at[i]
        own = np.bincount(place, weights=s.train[i], minlength=len(key)).astype(np.int64)
        self.low, self.wid = low, s.wid[word]
        self.grams = Grams(at, _mix(low.hash[self.head], self.wid), own, suffix)
        self.final = low.alone

    def asks(self, tokens: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, n-grams, histories, and of each the number of n-grams * 2 + 1 if its sums are wanted here).

        A place below `buckets` is a bucket by the hash range of histories; the places from there on are the same buckets
        for hot histories, whose n-grams are dealt by word as well.
        """
        low, edge = self.low, hash_bounds(buckets)
        mark = np.zeros(len(low.count), bool)
        mark[self.history] = True
        heads = np.nonzero(mark & ~self.final)[0]
        salts = 1 + low.count * (2 * buckets) // max(tokens, 1)
        gram = np.nonzero(~self.final[self.head])[0]
        hot = salts[self.head[gram]] > 1
        cold = heads[salts[heads] == 1]
        cold = cold[np.argsort(low.hash[cold])]
        rank = np.empty(len(low.count), np.int64)
        rank[cold] = np.arange(len(cold))
        own = np.sort((rank[self.head[gram[~hot]]] << 32) | np.arange(len(hot) - hot.sum()))
        items, n = gram[~hot][own & 0xFFFFFFFF], np.bincount(own >> 32, minlength=len(cold))
        ends = np.append(0, np.cumsum(n))
        cut = [0, *np.searchsorted(low.hash[cold], edge).tolist(), len(cold)]
        for b, (p, q) in enumerate(zip(cut, cut[1:])):
            if q > p:
                yield b, items[ends[p] : ends[q]], cold[p:q], n[p:q] * 2 + 1
        if len(cold) == len(heads):
            return
        items, wanted = gram[hot], heads[salts[heads] > 1]
        head = np.append(self.head[items], wanted)
        salt = np.append(self.wid[items] % salts[self.head[items]], np.zeros(len(wanted), np.int64))
        x = low.hash[head] + salt.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        bucket = ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
        item = np.append(items, np.full(len(wanted), -1))
        order = np.lexsort((item, low.hash[head], bucket))
        bucket, head, item = bucket[order], head[order], item[order]
        new = np.nonzero(_first(bucket, head))[0]
        asked = item[new] < 0
        flags = (np.diff(np.append(new, len(head))) - asked) * 2 + asked
        cut = np.append(np.nonzero(_first(bucket[new]))[0], len(new))
        ends = np.append(new, len(head))
        for p, q in zip(cut, cut[1:]):
            part = item[ends[p] : ends[q]]
            yield int(bucket[new[p]]) + buckets, part[part >= 0], head[new[p:q]], flags[p:q]

    def stats(self) -> list[int]:
        """Counts of counts of the n-grams that nobody is asked about."""
        return counts_of_counts(self.grams.own[self.final[self.head]])

    def answered(self, tokens: int, buckets: int, told: dict[int, tuple[bytes, bytes]], hot: dict[int, list[int]], sums: bool) -> Grams:
        """The level with counts and, if asked, sums. told: cells of counts and sums by place; hot: sums by hash of history."""
        g, low = self.grams, self.low
        g.alone = self.final[self.head]
        g.count = np.where(g.alone, g.own, 0)
        if sums:
            g.sums = np.zeros((SUMS, len(low.count)), np.int64)
            own = np.nonzero(g.alone & (g.own > 0))[0]
            head, count, below = self.head[own], g.own[own], low.count[g.suffix[own]]
            for r in range(1, DISCOUNTED + 1):
                g.sums[r - 1] = np.bincount(head[count == r], minlength=len(low.count))
                g.sums[DISCOUNTED + r - 1] = np.bincount(head[below == r], minlength=len(low.count))
            over = below > DISCOUNTED
            g.sums[-1] = np.bincount(head[over], weights=below[over], minlength=len(low.count))
        for place, grams, heads, flags in self.asks(tokens, buckets):
            counts = unpacked(told[place][0])
            g.count[grams], g.alone[grams] = counts >> 1, counts & 1 > 0
            if not sums:
                continue
            if place < buckets:
                g.sums[:, heads] = unpacked(told[place][1]).reshape(SUMS, -1)
            else:
                for h in heads[flags & 1 > 0].tolist():
                    g.sums[:, h] = hot[int(low.hash[h].view(np.int64))]
        return g


def bucket_answers(table: pa.Table) -> pa.Table:
    """Kind 0: counts of counts of a bucket's n-grams (stats). Kind 2: to a chunk, in the order asked, bucket: the place, a: counts as in
    encoded(), b: sums of histories. Kind 3: a bucket's part of a hot history's sums. Kind 4: a chunk that wants them."""
    bucket = table.column("bucket")[0].as_py()
    asks = list(zip(*(table.column(c).to_pylist() for c in ("kind", "chunk", "a", "b", "c"))))
    halves = lambda x: np.split(unpacked(x), 2)
    heads = [(np.cumsum(x).view(np.uint64), flags) for x, flags in (halves(x[2]) for x in asks)]
    pairs = [halves(x[3]) for x in asks]
    names, name = np.unique(np.concatenate([x for x, _ in heads]), return_inverse=True)
    h = np.repeat(name, np.concatenate([flags >> 1 for _, flags in heads]))
    w, below = (np.concatenate(x) for x in zip(*pairs))
    count = np.concatenate([unpacked(x[4]) for x in asks])
    narrow = len(names) < 1 << 23 and w.max(initial=0) < 1 << 40
    order = np.argsort((h << 40) | w) if narrow else np.lexsort((w, h))
    new = _first(h[order], w[order]) if len(h) else np.empty(0, bool)
    first = np.nonzero(new)[0]
    total = np.add.reduceat(count[order], first) if len(first) else np.empty(0, np.int64)
    back = np.empty(len(h), np.int64)
    back[order] = (total * 2 + (np.diff(np.append(first, len(h))) == 1))[np.cumsum(new) - 1] if len(first) else 0
    seen = total > 0
    at, sb, st = h[order][first][seen], below[order][first][seen], total[seen]
    of = lambda mask, weights=None: np.bincount(at[mask], weights=None if weights is None else weights[mask], minlength=len(names)).astype(np.int64)
    sums = np.array([of(st == r) for r in range(1, DISCOUNTED + 1)] + [of(sb == r) for r in range(1, DISCOUNTED + 1)] + [of(sb > DISCOUNTED, sb)])
    own = np.sum([counts_of_counts(st), *(x for x in table.column("stats").to_pylist() if x)], axis=0)
    rows = [(0, bucket, None, None, None, None, own.tolist())]
    hot: set[int] = set()
    k = i = 0
    for (hotness, chunk, *_), (x, flags), (y, _) in zip(asks, heads, pairs):
        mine = name[i : i + len(x)]
        if len(x):
            plain = mine if not hotness else mine[:0]
            rows.append((2, bucket if not hotness else -1 - bucket, chunk, packed(back[k : k + len(y)]), packed(sums[:, plain].reshape(-1)), None, None))
        if hotness:
            hot.update(mine.tolist())
            rows += [(4, g, chunk, None, None, None, None) for g in x[flags & 1 > 0].view(np.int64).tolist()]
        k, i = k + len(y), i + len(x)
    rows += [(3, int(names[j].view(np.int64)), None, None, None, None, sums[:, j].tolist()) for j in sorted(hot)]
    return _table(rows)


def bound(f, *given):
    """f with its first arguments given, as a function of two."""
    return lambda a, b: f(*given, a, b)


class Model:
    """Evaluates a chunk's tokens by backoff from level to level."""

    def __init__(self, uni: Unigrams, d: list[np.ndarray]):
        self.uni, self.d = uni, [uni.d, *d]

    def log_p(self, s: Stream) -> np.ndarray:
        """log10 p at each position; starts hold nothing."""
        out = self.uni.p(s.levels[0].count)[s.word]
        divisor = np.array([self.uni.divisor])  # of the histories of the level below, by place
        for low, g, d, below in zip(s.levels, s.levels[1:], self.d[1:], self.d):
            r = np.arange(1, DISCOUNTED + 1)
            left = ((1 - d[1:]) * r) @ g.sums[:DISCOUNTED]
            lower = ((below[1:] * r) @ g.sums[DISCOUNTED:-1] + g.sums[-1]) / divisor[low.suffix]
            divisor = np.where(left > 0, low.count, low.count + 1).astype(np.float64)
            alpha = np.where(left > 0, left, 1.0) / divisor / np.maximum(1 - lower, 1e-300)
            known, history = s.histories(low)
            count = np.append(g.count, 0)[g.at[known]]
            out[known] = np.where(count > 0, discounted(d, count) / divisor[history], alpha[history] * out[known])
        return np.log10(out)


_tidy = {"lock": threading.Lock(), "users": 0, "before": None}


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Files of a shuffle go when the table that it made is written. On while any query of this process needs it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _tidy["lock"]:
        if not _tidy["users"]:
            _tidy["before"] = spark.conf.get(name, "false")
            spark.conf.set(name, "true")
        _tidy["users"] += 1
    try:
        yield
    finally:
        with _tidy["lock"]:
            _tidy["users"] -= 1
            if not _tidy["users"]:
                spark.conf.set(name, _tidy["before"])


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK, bucket_words: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a boolean column of the rows not to learn from.

    rounds: beyond pairs, the buckets are asked in so many rounds, which divides what is shuffled at once.
    """
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    chunks, buckets = max(1, -(-size // chunk_bytes)), max(1, -(-size // (6 * bucket_words)))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), (~F.coalesce(held_out, F.lit(False))).alias("_train"))
    dealt = rows.withColumn("_chunk", chunk_of("_id", "_text", chunks))
    starts = rows.where("_train").count()
    kind = docs.schema[key].dataType.simpleString()
    total = lambda df, n: [int(x or 0) for x in df.where("kind = 0").select(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()]

    def stream(docs: pa.Table, answers: pa.Table, tokens: int, levels: int, sums: bool) -> Stream:
        """A chunk with the levels that its answers hold."""
        told: dict[int, dict] = {}
        hot: dict[int, dict] = {}
        words = []
        for level, k, b, x, y, z, t in zip(*(answers.column(c).to_pylist() for c in ("level", "kind", "bucket", "a", "b", "c", "stats"))):
            if k == 1:
                words.append((unpacked(z), unpacked(x), unpacked(y)))
            elif k == 2:
                told.setdefault(level, {})[b if b >= 0 else buckets - 1 - b] = x, y
            else:
                hot.setdefault(level, {})[b] = t
        s = Stream(docs.to_pylist()[0], words, starts)
        for level in range(2, levels + 1):
            s.levels.append(s.follow().answered(tokens, buckets, told.get(level, {}), hot.get(level, {}), sums))
        return s

    def asked(s: Stream, chunk: int, tokens: int, nth: int, of: int) -> pa.Table:
        n = s.follow()
        none = packed(np.empty(0, np.int64))
        out = [(0, chunk % buckets, chunk, none, none, none, n.stats())] if not nth else []
        for place, grams, heads, flags in n.asks(tokens, buckets):
            b = place % buckets
            if b % of != nth:
                continue
            a = np.concatenate((np.diff(n.low.hash[heads].view(np.int64), prepend=0), flags))
            out.append((place // buckets, b, chunk, packed(a), packed(np.concatenate((n.wid[grams], n.low.count[n.grams.suffix[grams]]))), packed(n.grams.own[grams]), None))
        return _table(out)

    def told_to(level: int, table: DataFrame) -> DataFrame:
        """level, kind, bucket, chunk, a, b, c, stats: the answers to chunks, with the sums of hot histories added up."""
        parts = table.where("kind = 3").groupBy("bucket").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(SUMS)])
        sums = parts.select("bucket", F.array(*[f"s{i}" for i in range(SUMS)]).alias("stats"))
        none = F.lit(None).cast("binary")
        hot = table.where("kind = 4").select("bucket", "chunk").join(sums, "bucket").select(F.lit(3).alias("kind"), "bucket", "chunk", none.alias("a"), none.alias("b"), none.alias("c"), "stats")
        plain = table.where("kind = 2").select("kind", "bucket", "chunk", "a", "b", none.alias("c"), F.lit(None).cast("array<bigint>").alias("stats"))
        return plain.unionByName(hot).withColumn("level", F.lit(level))

    with shuffles_removed(spark):
        cells = saved(encoded(dealt, kind))
        words = saved(word_table(cells, buckets))
        own = saved(cells.select("chunk", "ids", *CELLS))
        dropped(cells)
        tokens, kinds, *n = total(words, DISCOUNTED + 3)
        uni, d = Unigrams.of(tokens, kinds, n), []
        answers = words.where("kind = 1").drop("stats").withColumn("stats", F.lit(None).cast("array<bigint>")).withColumn("level", F.lit(1))
        for level in range(2, order + 1):
            parts, of = [], 1 if level == 2 else rounds
            told = answers.withColumn("b", F.when(F.col("kind") == 1, F.col("b"))).where("kind <> 3")  # counts alone
            for nth in range(of):
                ask = bound(lambda tokens, level, nth, of, docs, told: asked(stream(docs, told, tokens, level - 1, False), docs.column("chunk")[0].as_py(), tokens, nth, of), tokens, level, nth, of)
                asks = own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(ask, ANSWER)
                parts.append(saved(asks.groupBy("bucket").applyInArrow(bucket_answers, ANSWER)))
            table = reduce(DataFrame.unionByName, parts)
            d.append(discounts(total(table, DISCOUNTED + 1)))
            answers = answers.unionByName(told_to(level, table))
    model = Model(uni, d)

    def evaluate(docs: pa.Table, told: pa.Table) -> pa.Table:
        s = stream(docs, told, uni.tokens, order, True)
        i = ~s.first
        counts, row = s.levels[0].count[s.word[i]], np.repeat(np.arange(len(s.size)), s.size)
        per = lambda x: np.bincount(row, weights=x, minlength=len(s.size))
        cols = [pa.array(s.ids, docs.schema.field("ids").type.value_type), pa.array(s.train_row == 0), pa.array(s.size), pa.array(per(counts > 0).astype(np.int64)), pa.array(np.full(len(s.size), uni.tokens, np.int64)), pa.array(per(uni.base(counts))), pa.array(per(model.log_p(s)[i]))]
        return pa.table(cols, names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    shape = f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(evaluate, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD)
