"""Nearest neighbours by a block matrix join on int8 tiles, exact in its result.

The queries are dealt into blocks by a hash of their id; the blocks of one round, `room` bytes at most by their measured
size, are broadcast, and beyond that more rounds follow, so neither side is shuffled. A task collects its candidates into
blocks, and every block meets every query block of its length (a stated query set against all rows, in blocks): the
tile's int8 products give each inner product up to |q^| |e_c| + |e_q| |c|, where e is a vector's quantisation error.
Pairs whose upper bound reaches the query's 20th best lower bound in the tile and its 20th best score in the task so far
survive, are recomputed from the original vectors in double precision, and merged into one heap for each query, which
goes on from tile to tile. At the end of its rows a task gives up to 20 pairs for each query, and those are merged by one
heap. Nothing is lost by the bounds, so recall is 1.

int8 products are summed by a float32 matrix product: below 2^24 / 127^2 = 1040 components every partial sum is an
integer that float32 holds exactly; longer vectors use float64.

Defined results: vectors that are null, zero, empty, without an id, or that hold a null or non-finite component take no
part; only vectors of equal length meet; exactly repeated rows (id and vector) count once, and so do two vectors of one
id that score alike; subnormal components count like any other; ties go to the smaller id; a query with no other vector
gives no row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import saved

CANDIDATES, QUERIES, STEP, ROOM = 8192, 2048, 128, 64 << 20
TINY = np.finfo(np.float64).tiny


def usable(vec: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vec.isNotNull() & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0)


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scale, norm of the quantised row, and norm of the error of each row of v (double)."""
    scale = np.maximum(np.abs(v).max(axis=1) / 127, TINY)
    q = np.rint(v / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(q * scale[:, None], axis=1), np.linalg.norm(v - q * scale[:, None], axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    return np.cumsum(a.astype(np.float64) * b.astype(np.float64), axis=1)[:, -1]


class Queries:
    """A block of queries and the k best pairs (score, -id) of each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.bar = np.full(len(ids), -np.inf)  # the k-th best score
        self.int8 = quantised(vectors)

    def meet(self, cid: np.ndarray, c: np.ndarray, int8: tuple, plain: bool) -> None:
        """Merges the pairs with distinct candidates that may be among the k best. plain: no two have one id."""
        (ci, cs, cn, ce), (qi, qs, qn, qe), k = int8, self.int8, self.k
        kind = np.float32 if c.shape[1] < 1040 else np.float64
        ct, cnorm, slack = np.ascontiguousarray(ci.T.astype(kind)), np.linalg.norm(c, axis=1), 1e-9
        for at in range(0, len(self.ids), STEP):
            s = slice(at, at + STEP)
            guess = (qi[s].astype(kind) @ ct).astype(np.float64) * qs[s, None] * cs[None]
            bound = (qn[s, None] * ce[None] + qe[s, None] * cnorm[None]) * (1 + slack) + slack * np.abs(guess) + TINY
            own = self.ids[s, None] == cid[None]
            bar = self.bar[s]
            if plain and len(cid) > k:
                low = np.nan_to_num(np.where(own, -np.inf, guess - bound), nan=-np.inf)
                bar = np.maximum(bar, np.partition(low, len(cid) - k, axis=1)[:, len(cid) - k])
            i, j = np.nonzero(~own & ~(guess + bound < bar[:, None]))
            if not len(i):
                continue
            score = np.concatenate([exact(self.v[s][i[x : x + 65536]], c[j[x : x + 65536]]) for x in range(0, len(i), 65536)])
            rows, first = np.unique(i, return_index=True)
            ids = (-cid[j]).tolist()
            score = score.tolist()
            for r, a, b in zip((at + rows).tolist(), first.tolist(), [*first[1:].tolist(), len(i)]):
                self.best[r] = heapq.nlargest(k, {*self.best[r], *zip(score[a:b], ids[a:b])})
                if len(self.best[r]) == k:
                    self.bar[r] = self.best[r][-1][0]


def distinct(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows without exact repeats."""
    if len(np.unique(ids)) == len(ids):
        return ids, v
    keep = list({(i, x.tobytes()): n for n, (i, x) in enumerate(zip(ids.tolist(), v))}.values())
    return ids[keep], v[keep]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vec: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES, room: int = ROOM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by `every`, by inner product."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    asked = rows.where(F.col("id") % every == 0)
    n, size = asked.agg(F.count("*"), F.sum(F.col("dim").cast("long") * 8 + 8)).first()
    blocks = max(1, -(-n // queries), -(-4 * (size or 0) // room))
    wide = rows.schema["v"].dataType.elementType.simpleString() == "double"
    kind = np.float64 if wide else np.float32

    def packed(table: pa.Table) -> pa.Table:
        """One row for a block: its ids and vectors as bytes."""
        v = np.ascontiguousarray(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind))
        ids, v = distinct(table.column("id").to_numpy().astype(np.int64), v.reshape(table.num_rows, -1))
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([v.tobytes()], pa.binary())})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("dim", "block").applyInArrow(packed, "dim int, block long, ids binary, data binary")
    dealt = saved(dealt)  # one in `every` of the rows
    size = dealt.agg(F.sum(F.octet_length("ids") + F.octet_length("data"))).first()[0] or 0
    rounds = max(1, -(-size // room))
    found = []
    for nth in range(rounds):
        # `room` bytes at a time, by measured size
        shared = vectors.sparkSession.sparkContext.broadcast([tuple(r) for r in dealt.where(F.col("block") % rounds == nth).select("dim", "ids", "data").collect()])

        def products(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked: dict[int, list[Queries]] = {}
            for dim, ids, data in shared.value:
                asked.setdefault(dim, []).append(Queries(np.frombuffer(ids, np.int64), np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64), k))
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def flush(dim: int) -> None:
                ids, v = distinct(*(np.concatenate(x) for x in zip(*held.pop(dim))))
                for at in range(0, len(ids), candidates):
                    c = v[at : at + candidates].astype(np.float64)
                    int8, own = quantised(c), ids[at : at + candidates]
                    plain = len(np.unique(own)) == len(own)
                    for q in asked[dim]:
                        q.meet(own, c, int8, plain)

            for b in batches:
                ids, dims = b.column("id").to_numpy(), b.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim in asked:
                        at = np.nonzero(dims == dim)[0]
                        v = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), dim)
                        held.setdefault(dim, []).append((ids[at], v))
                        if sum(len(x) for x, _ in held[dim]) >= candidates:
                            flush(dim)
            for dim in list(held):
                flush(dim)
            for q in (q for own in asked.values() for q in own):
                flat = [(int(i), -v, s) for i, best in zip(q.ids, q.best) for s, v in best]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        near = rows.mapInArrow(products, "query_id long, vec_id long, score double")
        if rounds > 1:
            near = saved(near)
            shared.destroy()
        found.append(near)
    every_round = found[0]
    for more in found[1:]:
        every_round = every_round.unionByName(more)
    near = every_round.repartition("query_id").sortWithinPartitions("query_id")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One heap of k for the query at hand; rows come sorted by query."""
        query_id, heap = None, []
        for b in batches:
            qs, rs, vs, ss = [], [], [], []
            for q, v, s in zip(*(b.column(x).to_pylist() for x in range(3))):
                if q != query_id:
                    done(query_id, heap, qs, rs, vs, ss)
                    query_id, heap = q, []
                item = (s, -v)
                if item in heap:
                    continue
                heapq.heappush(heap, item) if len(heap) < k else heapq.heappushpop(heap, item)
            yield table(qs, rs, vs, ss)
        qs, rs, vs, ss = [], [], [], []
        done(query_id, heap, qs, rs, vs, ss)
        yield table(qs, rs, vs, ss)

    def done(query_id, heap, qs, rs, vs, ss) -> None:
        for r, (s, v) in enumerate(sorted(heap, reverse=True), 1):
            qs.append(query_id), rs.append(r), vs.append(-v), ss.append(s)

    def table(qs, rs, vs, ss) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(rs, pa.int32()), pa.array(vs, pa.int64()), pa.array(ss, pa.float64())], ["query_id", "rank", "vec_id", "score"])

    return near.mapInArrow(merged, "query_id long, rank int, vec_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.embedding) = len(c.embedding) WHERE q.vec_id % 20 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
