"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into floor(k / 2) + 1 segments, so of two fingerprints that differ in at most k bits one
segment differs in at most one (k = 4: three segments of 22, 21 and 21 bits). Every segment is indexed once for each of
its bits with that bit wild, equal variants meet by an equality shuffle, and pairs are verified on all bits.

Copies collapse first: only distinct fingerprints are indexed, each with its smallest document id. A run of equal
variants yields a spanning forest, not its pairs; runs over `tile` rows are cut into tiles that other tasks take pair by
pair, so no task holds more than two tiles, and no link is dropped. Components are found by star contraction.

Defined results: a null or blank text has fingerprint zero, linked like any other; rows with a null id keep their
fingerprint but take no part in links and have a null component; a repeated id stands for itself once; very long texts
count whole; of copies the smallest id stands for all; ids are integers; an empty table gives no rows; extra columns are
not read by the query and kept by one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected, saved

SEED = 42
SLICE = 1 << 16  # shingles hashed at a time: bounds the memory of a very long text
MIX = np.uint64(0x9E3779B97F4A7C15)  # a fixed value: the odd constant of the splitmix64 generator


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes of a further fingerprint word, from those of the first."""
    if not word:
        return h
    z = h + MIX * np.uint64(word)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` lower-cased words; of all words, if fewer; none without a word."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)


def fingerprint(text: bytes | None, shingle: int = 4, words: int = 1, distinct: bool = False) -> list[int]:
    """The fingerprint as `words` unsigned 64-bit numbers: a bit is set if it is set in over half of the hashes."""
    h = shingle_hashes(text, shingle)
    if distinct:
        h = np.unique(h)
    out = []
    for w in range(words):
        total = np.zeros(64, np.int64)
        for i in range(0, len(h), SLICE):
            x = _mixed(h[i : i + SLICE], w)
            total += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * total > len(h), bitorder="little")
        out.append(int(bits.view(np.uint64)[0]) if len(h) else 0)
    return out


def digest(text: bytes | None) -> int:
    """A signed hash of the lower-cased words: texts of equal words have equal shingles."""
    return xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), SEED) - (1 << 63)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, words: int = 1, distinct: bool = False, digests: bool = False) -> DataFrame:
    """id, fp0 .. fp{words-1} (signed 64-bit); with digests, digest and size: a hash and the number of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle, words, distinct) for t in texts], np.uint64).reshape(-1, words).view(np.int64)
            more = [pa.array([digest(t) for t in texts], pa.int64()), pa.array([len((t or b"").split()) for t in texts], pa.int64())] if digests else []
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(fps[:, w]) for w in range(words)], *more], [*[c.split()[0] for c in out.split(", ")]])

    out = "id long, " + ", ".join(f"fp{w} long" for w in range(words)) + (", digest long, size long" if digests else "")
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, out)


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(shift, size) of each segment of a 64-bit word, as even as can be, larger ones first."""
    sizes = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(sum(sizes[:i]), z) for i, z in enumerate(sizes)]


def variants(reps: DataFrame, words: int, segments: int) -> DataFrame:
    """k, rep, fp*: a row for every segment as it is, and for every bit of every word, with that bit wild in its segment.

    Rows of equal segments meet under the whole segment; under a wild bit only rows that differ in it need to meet.
    """
    keys = []
    for w in range(words):
        for n, (shift, size) in enumerate(_cuts(segments)):
            part = F.shiftrightunsigned(F.col(f"fp{w}"), shift).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
            keys.append(part.bitwiseOR(F.lit((words * 64 + w * segments + n) << 32).cast("long")))
            for j in range(size):
                keys.append(part.bitwiseAND(F.lit(((1 << size) - 1) & ~(1 << j)).cast("long")).bitwiseOR(F.lit((w * 64 + shift + j) << 32).cast("long")))
    return reps.select(F.explode(F.array(*keys)).alias("k"), "rep", *[f"fp{w}" for w in range(words)])


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether rows of x and y (broadcast, fingerprint words last) differ in at most `most` bits."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32) <= most


def _spanned(rep: np.ndarray, fp: np.ndarray, most: int, step: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(nodes, rows of the front that reached them) of a spanning tree per component, and the component of each row. Memory: step x rows."""
    left, out_a, out_b, label = np.arange(len(rep)), [], [], np.arange(len(rep))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        root = front[0]
        while len(front) and len(left):
            by = np.full(len(left), -1)
            for i in range(0, len(front), step):
                rest = np.nonzero(by < 0)[0]  # a row that is reached is done
                if not len(rest):
                    break
                f = front[i : i + step]
                far = np.bitwise_count(fp[f][:, None] ^ fp[left[rest]][None]).sum(axis=-1, dtype=np.int32)
                at = far.argmin(axis=0)
                near = far[at, np.arange(len(rest))] <= most
                by[rest[near]] = f[at[near]]
            hit = by >= 0
            label[left[hit]] = root
            out_a.append(rep[left[hit]])
            out_b.append(rep[by[hit]])
            front, left = left[hit], left[~hit]
    return out_a, out_b, label


def forest(rep: np.ndarray, fp: np.ndarray, most: int, side: np.ndarray | None = None, step: int = 256) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect what is near. With sides: only those needed between the components of either side.

    Rows of one side have equal segments, so they meet under the whole segment and are connected there.
    """
    if side is None:
        return _spanned(rep, fp, most, step)[:2]
    sides = [np.nonzero(side == 0)[0], np.nonzero(side != 0)[0]]
    label = np.empty(len(rep), np.int64)
    for own in sides:
        if len(own):
            label[own] = own[_spanned(rep[own], fp[own], most, step)[2]]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    a, b = [], []
    few, many = sorted(sides, key=len)
    for i in range(0, len(few), step):
        f = few[i : i + step]
        x, y = np.nonzero(np.bitwise_count(fp[f][:, None] ^ fp[many][None]).sum(axis=-1, dtype=np.int32) <= most)
        x, y = f[x], many[y]
        _, first = np.unique(label[x] * len(rep) + label[y], return_index=True)
        for p, q in zip(x[first].tolist(), y[first].tolist()):
            m, n = root(int(label[p])), root(int(label[q]))
            if m != n:
                up[max(m, n)] = min(m, n)
                a.append(p)
                b.append(q)
    return [rep[np.array(a, np.int64)]], [rep[np.array(b, np.int64)]]


def _edges_of_runs(k: np.ndarray, rep: np.ndarray, fp: np.ndarray, most: int, small: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal k (sorted): short runs by shifted comparison of the whole array, long ones by forest()."""
    if len(k) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bit = k >> 32
    wild = bit < 64 * fp.shape[1]
    side = np.where(wild, (fp[np.arange(len(k)), np.where(wild, bit // 64, 0)] >> (bit % 64).astype(np.uint64)) & np.uint64(1), np.uint64(0)).astype(np.int8)
    starts = np.concatenate(([0], np.nonzero(k[1:] != k[:-1])[0] + 1))
    sizes = np.diff(np.concatenate((starts, [len(k)])))
    mixed = ~wild[starts] | (np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts))
    a, b = [], []
    short = np.repeat((sizes <= small) & (sizes > 1) & mixed, sizes)
    for s in range(1, small):
        i = np.nonzero(short[:-s] & (k[s:] == k[:-s]))[0]
        if not len(i):
            break
        i = i[~wild[i] | (side[i] != side[i + s])]
        i = i[_near(fp[i], fp[i + s], most)]
        a.append(rep[i])
        b.append(rep[i + s])
    for g in np.nonzero((sizes > small) & mixed)[0]:
        p, q = starts[g], starts[g] + sizes[g]
        x, y = forest(rep[p:q], fp[p:q], most, side[p:q] if wild[p] else None)
        a += x
        b += y
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def links(reps: DataFrame, words: int = 1, segments: int = 3, most: int = 4, tile: int = 4096) -> DataFrame:
    """a, b: edges between rep values that connect whatever fingerprints share a variant and differ in at most `most` bits.

    Complete if segments > most // 2. reps: rep, fp0 .. with distinct fingerprints.
    """
    fps = [f"fp{w}" for w in range(words)]
    dealt = variants(reps, words, segments)
    dealt = dealt.repartition("k").sortWithinPartitions("k", "rep")

    def columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        return c[0], c[1], np.stack(c[2:], axis=1).view(np.uint64)

    def rows(kind: int, k, a, b, fp, part, parts) -> pa.RecordBatch:
        n = len(a)
        full = lambda x: np.full(n, x, np.int64) if np.isscalar(x) else x
        f = fp.view(np.int64) if fp is not None else np.zeros((n, words), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(full(x)) for x in (kind, k, a, b, part, parts, *[f[:, w] for w in range(words)])], ["kind", "k", "a", "b", "part", "parts", *fps])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: an edge. Kind 1: a row of a long run, with its tile. Kind 2: a long run's number of tiles."""
        held: list = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, words), np.uint64)]
        long_k, given = None, 0
        for batch in batches:
            held = [np.concatenate(x) for x in zip(held, columns(batch))]
            if len(held[0]) < 16 * tile:
                continue
            # all but the last run is whole; a last run that fills the buffer is long
            cut = int(np.searchsorted(held[0], held[0][-1]))
            done, held = [x[:cut] for x in held], [x[cut:] for x in held]
            if long_k is not None and len(done[0]):
                n = int(np.searchsorted(done[0], long_k, "right")) if done[0][0] == long_k else 0
                for i in range(0, n, tile):
                    yield rows(1, long_k, done[1][i : min(n, i + tile)], 0, done[2][i : min(n, i + tile)], given, 0)
                    given += 1
                yield rows(2, long_k, np.zeros(1, np.int64), 0, None, 0, given)
                done, long_k, given = [x[n:] for x in done], None, 0
            yield from flush(done)
            while len(held[0]) >= 4 * tile:
                long_k = int(held[0][0])
                yield rows(1, long_k, held[1][:tile], 0, held[2][:tile], given, 0)
                given += 1
                held = [x[tile:] for x in held]
        if long_k is not None:
            n = int(np.searchsorted(held[0], long_k, "right"))
            for i in range(0, n, tile):
                yield rows(1, long_k, held[1][i : min(n, i + tile)], 0, held[2][i : min(n, i + tile)], given, 0)
                given += 1
            yield rows(2, long_k, np.zeros(1, np.int64), 0, None, 0, given)
            held = [x[n:] for x in held]
        yield from flush(held)

    def flush(done) -> Iterator[pa.RecordBatch]:
        k, rep, fp = done
        a, b = _edges_of_runs(k, rep, fp, most)
        if len(a):
            yield rows(0, 0, a, b, None, 0, 0)

    found = saved(dealt.mapInArrow(run, "kind long, k long, a long, b long, part long, parts long, " + ", ".join(f"{f} long" for f in fps)))
    tiles = found.where("kind = 1").join(found.where("kind = 2").select("k", F.col("parts").alias("n")), "k")
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    tiles = tiles.select("k", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("a").alias("rep"), *fps)

    def within(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        fp = np.stack([table.column(f).to_numpy() for f in fps], axis=1).view(np.uint64)
        a, b = forest(rep[order], fp[order], most)
        return pa.table({"a": pa.array(np.concatenate(a or [np.empty(0, np.int64)])), "b": pa.array(np.concatenate(b or [np.empty(0, np.int64)]))})

    hot = tiles.groupBy("k", "i", "j").applyInArrow(within, "a long, b long")
    return found.where("kind = 0").select("a", "b").unionByName(hot)


def verified(rep: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], most: int, similarity: float, side: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the pairs within `most` bits whose sets have a Jaccard similarity of `similarity`.

    Each such pair is tested unless a tree of pairs that passed holds both rows. Rows of one side are no pair.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(size)[:-1])
    mark = np.zeros(len(names), bool)
    left, out_a, out_b = np.arange(len(rep)), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            f = front.pop()
            near = _near(fp[left], fp[f], most) & (size[left] >= similarity * size[f]) & (size[f] >= similarity * size[left])
            if side is not None:
                near &= side[left] != side[f]
            at = np.nonzero(near)[0]
            if not len(at):
                continue
            mark[own[f]] = True
            both = np.fromiter((np.count_nonzero(mark[own[i]]) for i in left[at]), np.int64, len(at))
            mark[own[f]] = False
            at = at[both >= similarity * (size[left[at]] + size[f] - both)]
            out_a.append(rep[left[at]])
            out_b.append(np.full(len(at), rep[f]))
            front += left[at].tolist()
            left = np.delete(left, at)
    return out_a, out_b


def similar(docs: DataFrame, reps: DataFrame, groups: DataFrame, key: str, text: str, words: int, most: int, similarity: float, shingle: int = 5, tile: int = 1024, room: int = 8 << 20, most_ids: int = 4_000_000) -> DataFrame:
    """a, b: edges that connect whatever reps of one group differ in at most `most` bits and are `similarity` alike.

    Alike is the Jaccard similarity of the sets of word shingles. A group of over `tile` rows or `room` bytes of sets is cut
    into tiles that tasks take pair by pair. reps: rep, fp0 .., digest, size; groups: node, component.
    """
    fps = [f"fp{w}" for w in range(words)]
    asked = reps.join(groups, reps["rep"] == groups["node"]).select("component", "rep", *fps, "digest", "size")
    ids = groups.select(F.col("node").alias("id"))
    ids = F.broadcast(ids) if ids.count() <= most_ids else ids  # 32 MB at most; a shuffle beyond

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            out = [np.unique(shingle_hashes(t, shingle).astype(np.uint32)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(t) for t in texts], pa.int64()), pa.array(out, pa.binary())], ["id", "digest", "set"])

    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi")
    own = own.mapInArrow(sets, "id long, digest long, set binary").groupBy("id", "digest").agg(F.min("set").alias("set"))
    own = own.select(F.col("id").alias("rep"), "digest", "set")
    parts = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") * 4 / room))
    cut = asked.groupBy("component").agg(parts.alias("parts")).where("parts > 1")  # one row for each large group
    cut = saved(cut)
    cut = F.broadcast(cut) if cut.count() <= most_ids else cut
    dealt = asked.join(own, ["rep", "digest"]).join(cut, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.expr("pmod(xxhash64(rep, digest), parts)")).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    dealt = dealt.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "set", *fps)
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "part", "rep")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: list[tuple]) -> pa.RecordBatch:
            (_, i, j, *_), col = rows[0], list(zip(*rows))
            side = None if i == j else np.array(col[3], np.int64)
            a, b = verified(np.array(col[4], np.int64), np.array(col[6:], np.int64).T.view(np.uint64), [np.frombuffer(x, np.uint32) for x in col[5]], most, similarity, side)
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    if len(held) > 1:
                        yield edges(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield edges(held)

    return dealt.mapInArrow(alike, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, words: int = 1, segments: int = 3, most: int = 4, distinct: bool = False, similarity: float | None = None) -> DataFrame:
    """id, fp0 .., component: a row for each row of docs. With similarity, only links of at least that Jaccard similarity count."""
    fps = [f"fp{w}" for w in range(words)]
    # with similarity only equal texts collapse: texts of equal fingerprints are verified like any other pair
    same = [*fps, "digest"] if similarity else fps
    every = saved(fingerprints(docs, key, text, shingle, words, distinct, digests=bool(similarity)))
    known = every.where("id IS NOT NULL").groupBy(*same)
    if similarity:
        reps = saved(known.agg(F.min("id").alias("rep"), F.max("size").alias("size")))
        groups = saved(connected(links(reps, words, segments, most)))
        groups = connected(similar(docs, reps, groups, key, text, words, most, similarity))
    else:
        reps = known.agg(F.min("id").alias("rep"))
        groups = connected(links(reps, words, segments, most))
    of = reps.join(groups, reps["rep"] == groups["node"], "left").select(*same, F.coalesce("component", "rep").alias("component"))
    # few fingerprints may hold most rows: the table of fingerprints is the small side, and a skewed join splits
    out = every.join(of, same, "left")
    return out.select("id", *fps, F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2, words: int = 2, segments: int = 3, most: int = 22, similarity: float = 0.8) -> DataFrame:
    """The rows of docs but those near-duplicate to a row with a smaller id; all columns.

    A pair whose five-word shingles have a Jaccard similarity of 0.8 differs in about 10 of 64 bits of a five-word
    SimHash, beyond what deletion variants of three segments find. So this form takes the distinct two-word shingles,
    whose sets change far less by the same edits, and 128 bits: at similarity 0.8 about 12 of 128 bits differ, and in
    95 of 100 pairs one of the six segments by at most one. Candidates in one group are then verified by their exact
    five-word Jaccard similarity, each pair within `most` bits that no verified links connect already. Rows with a null id stay; rows of one id stay or go together.
    """
    groups = near_duplicates(docs, key, text, shingle, words, segments, most, distinct=True, similarity=similarity)
    gone = groups.where("id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{key}`"] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
