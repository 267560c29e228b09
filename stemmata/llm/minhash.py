r"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A set of shingles is sketched by rounds of hashed bin placement (Dahlgaard, Knudsen and Thorup, 2017): in round i each
element falls into one bin with a value in [i, i + 1), and a bin keeps its least value; a large set is done after its
first round. After `BINS` rounds a bin that is still empty takes the least value of the whole set in a round of its own,
so every coordinate fills, and coordinates agree with the probability of the Jaccard similarity, concentrated as if
drawn without replacement. 512 coordinates make 64 bands of 8: a pair of similarity 0.85 shares no band with probability
(1 - 0.85 ** 8) ** 64 < 2e-9.

Copies (equal sets) collapse to a node first. Candidates are nodes of one band, and none is dropped:
1. Every node of a band's bucket is verified against the smallest one, its hub. Nodes get the label of a hub that verified
   links lead to: buckets of copies of one text close here.
2. Buckets with two labels or more are searched for pairs of different labels whose sketches, a bit
   for each coordinate, differ in at most `MOST` bits (a pair of similarity 0.85 differs in 38 on average; 77 is 6.5
   standard deviations off). They give groups of labels; in a group every such pair is verified until links connect it,
   the largest label against the rest, the rest against itself, tile by tile.
Verified means that the full sets of 64-bit shingle hashes have 100 * intersection >= 85 * union.

No bucket or group is gathered in one task: sizes are grouped counts, and what is over a tile is dealt to tasks by pairs
of tiles. Links are spanning forests, not all pairs.

Defined results: a null or blank text has no shingles and is linked with nothing, its component itself; a row with a null
id has its n_shingles, no component and is kept; rows of one id are judged each by its own text; repeated rows get equal
results; of equal texts the smallest id stands for all; very long texts count whole; an empty table gives no rows; extra
columns are not read by near_duplicates() and kept by one_of_each(). ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected, saved
from .simhash import shingle_hashes

SHINGLE = 5
BINS, ROWS = 512, 8
PERCENT = 85
MOST = 77
WORDS = BINS // 64
TILE = 1024
ROOM = 8 << 20  # bytes of sets in a tile, on average

_BIN_BITS = BINS.bit_length() - 1
_ROUND_BITS = _BIN_BITS + 1
_VALUE_BITS = np.uint64(64 - _BIN_BITS - _ROUND_BITS)
BITS = [f"b{i}" for i in range(WORDS)]


def _hashed(h: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """A hash of each element (columns) in each round (rows): the splitmix64 generator at steps set apart by the round."""
    z = h[None, :] + (rounds.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sketch(h: np.ndarray, work: int = 8 * BINS) -> np.ndarray:
    """The coordinates of a non-empty set of hashes, as one number each: bin, round and value, from high to low bits."""
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    step = max(1, work // len(h))
    for start in range(0, BINS, step):
        rounds = np.arange(start, min(BINS, start + step))
        z = _hashed(h, rounds)
        bins = z >> np.uint64(64 - _BIN_BITS)
        value = z & np.uint64((1 << int(_VALUE_BITS)) - 1)
        x = (bins << np.uint64(64 - _BIN_BITS)) | (rounds.astype(np.uint64)[:, None] << _VALUE_BITS) | value
        x = np.sort(x, axis=None)
        b = (x >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        first = np.concatenate(([True], b[1:] != b[:-1]))
        b, x = b[first], x[first]
        new = ~full[b]  # an earlier round has the lesser value
        out[b[new]] = x[new]
        full[b] = True
        if full.all():
            return out
    rest = np.nonzero(~full)[0]
    for i in range(0, len(rest), step):
        b = rest[i : i + step]
        value = (_hashed(h, b + BINS) & np.uint64((1 << int(_VALUE_BITS)) - 1)).min(axis=1)
        out[b] = (b.astype(np.uint64) << np.uint64(64 - _BIN_BITS)) | ((b + BINS).astype(np.uint64) << _VALUE_BITS) | value
    return out


def bands(s: np.ndarray, rows: int = ROWS) -> list[int]:
    """A signed key for each band of coordinates; the coordinates hold their bins, so bands differ in their keys."""
    raw, n = s.tobytes(), 8 * rows
    return [xxhash.xxh64_intdigest(raw[i : i + n]) - (1 << 63) for i in range(0, len(raw), n)]


def bits(s: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, as signed 64-bit numbers: agreeing coordinates have equal bits, others by chance."""
    return np.packbits((s & np.uint64(1)).astype(bool), bitorder="little").view(np.int64)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def node_of(h: np.ndarray) -> int | None:
    """A signed hash of a whole set, none of the empty one."""
    return xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, node, bands, b0 ..: a row for each row of docs; nothing but n of the empty set."""
    shape = "id long, n long, node long, bands array<long>, " + ", ".join(f"{b} long" for b in BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, keys, words = [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                h = shingles(t.as_py())
                n.append(len(h))
                node.append(node_of(h))
                s = sketch(h) if len(h) else None
                keys.append(bands(s) if len(h) else None)
                words.append(bits(s) if len(h) else np.zeros(WORDS, np.int64))
            w = np.array(words, np.int64).reshape(-1, WORDS)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(w[:, i]) for i in range(WORDS))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "node", "bands", *BITS])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, shape)


def sets_of(docs: DataFrame, nodes: DataFrame, key: str, text: str, most_ids: int = 4_000_000) -> DataFrame:
    """node, set: the sets of nodes, read from the texts of the row that stands for each. nodes: node, id."""
    ids = nodes.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= most_ids else ids  # 32 MB at most; a shuffle beyond

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["node", "set"])

    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")).join(ids, "id", "left_semi")
    found = own.select("t").mapInArrow(run, "node long, set binary")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _close(a: str, b: str, most: int) -> Column:
    """Whether the sketches of two rows, whose columns have the suffixes a and b, differ in at most `most` bits."""
    far = [F.bit_count(F.col(x + a).bitwiseXOR(F.col(x + b))) for x in BITS]
    return sum(far[1:], far[0]) <= most


def _sizes(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets have percent of their union in common."""
    both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified_stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are alike. Both joins are by a key that skewed joins split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


class _Parts:
    """Components of the rows of one tile: merging relabels, so a component is compared at once for all rows."""

    def __init__(self, label: np.ndarray) -> None:
        self.of = np.unique(label, return_inverse=True)[1]

    def merge(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def forest(node: np.ndarray, words: np.ndarray, label: np.ndarray, side: np.ndarray, crossed: bool, most: int = MOST, sets: list[np.ndarray] | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is similar but has different labels: by sketches alone or, with sets, by the sets.

    crossed: only rows of different sides (0 and 1) are pairs.
    """
    parts, a, b = _Parts(label), [], []
    sides = [np.nonzero(side == s)[0] for s in (0, 1)] if crossed else [np.arange(len(node))]
    few, other = min(sides, key=len), max(sides, key=len)
    if not len(few):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if crossed and len(few) == len(other):
        few, other = sides
    if sets is not None:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        own, mark = np.split(ids, np.cumsum(sizes)[:-1]), np.zeros(len(names), bool)
    for i in few.tolist():
        js = other if crossed else np.arange(i + 1, len(node))
        js = js[parts.of[js] != parts.of[i]]
        if sets is not None:
            js = js[100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])]
        js = js[np.bitwise_count(words[js] ^ words[i]).sum(axis=1, dtype=np.int64) <= most]
        if not len(js):
            continue
        if sets is not None:
            mark[own[i]] = True
        for j in js.tolist():
            if parts.of[i] == parts.of[j]:
                continue
            if sets is not None:
                both = int(np.count_nonzero(mark[own[j]]))
                if 100 * both < percent * (sizes[i] + sizes[j] - both):
                    continue
            parts.merge(i, j)
            a.append(node[i])
            b.append(node[j])
        if sets is not None:
            mark[own[i]] = False
    return np.array(a, np.int64), np.array(b, np.int64)


def dealt(rows: DataFrame, tile: int, room: int) -> DataFrame:
    """rows with kind, p, q and side, a copy for each cell in which pairs of the row are sought. rows: grp, label, node, n.

    Only pairs of different labels count. Of a group the largest label stands against the rest (kind 0) and the rest
    against itself (kind 1), so a row of the largest label is copied once for each tile of the rest. Groups of one label
    have no cells.
    """
    size = rows.groupBy("grp", "label").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
    plan = size.groupBy("grp").agg(F.max(F.struct("size", "label", "elements")).alias("top"), F.sum("size").alias("size"), F.sum("elements").alias("elements"), F.count("*").alias("labels"))
    parts = lambda n, elements: F.greatest(F.lit(1).cast("long"), F.ceil(n / tile), F.ceil(elements * 8 / room))
    plan = plan.where("labels > 1").select("grp", F.col("top.label").alias("main"), parts(F.col("top.size"), F.col("top.elements")).alias("m_parts"), parts(F.col("size") - F.col("top.size"), F.col("elements") - F.col("top.elements")).alias("r_parts"))
    cells = F.expr(
        "IF(is_main, transform(sequence(0L, r_parts - 1), q -> struct(0 AS kind, part AS p, q AS q, 0 AS side)),"
        " concat(transform(sequence(0L, m_parts - 1), p -> struct(0 AS kind, p AS p, part AS q, 1 AS side)),"
        " transform(sequence(0L, r_parts - 1), q -> struct(1 AS kind, least(part, q) AS p, greatest(part, q) AS q, IF(part > q, 1, 0) AS side))))"
    )
    out = rows.join(plan, "grp").withColumn("is_main", F.col("label") == F.col("main")).withColumn("part", F.expr("pmod(xxhash64(node), IF(is_main, m_parts, r_parts))"))
    return out.select("grp", "label", "node", F.explode(cells).alias("c")).select("grp", "c.kind", "c.p", "c.q", "c.side", "label", "node")


def by_cells(cells: DataFrame, words: DataFrame, most: int, sets: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """a, b: the forest of each cell of dealt(), by sketches or, with sets, by sets."""
    rows = cells.join(words, "node")
    rows = rows.join(sets, "node") if sets is not None else rows
    rows = rows.select("grp", "kind", "p", "q", "side", "node", "label", *BITS, *(["set"] if sets is not None else []))
    rows = rows.repartition("grp", "kind", "p", "q").sortWithinPartitions("grp", "kind", "p", "q", "node")
    verify = sets is not None

    def edges(held: list[tuple]) -> pa.RecordBatch:
        col = list(zip(*held))
        side, node, label = (np.array(x, np.int64) for x in col[4:7])
        bits_of = np.array(col[7 : 7 + WORDS], np.int64).T.copy().view(np.uint64)
        held_sets = [np.frombuffer(x, np.uint64) for x in col[7 + WORDS]] if verify else None
        a, b = forest(node, bits_of, label, side, held[0][1] == 0 or held[0][2] != held[0][3], most, held_sets, percent)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:4] != row[:4]:
                    if len(held) > 1:
                        yield edges(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield edges(held)

    return rows.mapInArrow(run, "a long, b long")


def of_hubs(stars: DataFrame) -> DataFrame:
    """node, label: the smallest hub that a node is verified with, or what its hub and that one's hub have in turn.

    Nodes of one label are connected; not all that are connected have one label. stars: a (the hub), b, a < b.
    """
    label = saved(stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
    for _ in range(2):
        up = label.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        label = saved(label.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label")))
    return label


def between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: the edges (a, b) of nodes as edges of their labels, without those inside one."""
    one, two = (labels.select(F.col("node").alias(c), F.col("label").alias(f"_l{c}")) for c in "ab")
    named = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b"))
    return named.where("a <> b").distinct()


def links(nodes: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, most: int = MOST, tile: int = TILE, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """(node, label; a, b): labels of nodes that are connected, a node without one has itself, and edges that connect labels.

    Together they connect whatever nodes share a band and are alike. nodes: node, id, n, bands, b0 ..
    """
    words = nodes.select("node", *BITS)
    keys = nodes.select("node", F.explode("bands").alias("key"))
    many = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1")
    met = saved(keys.join(many, "key").select("key", "hub", "node"))
    near = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), *[F.col(x).alias(x + c) for x in BITS])
    stars = met.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = saved(stars.join(near("a"), "a").join(near("b"), "b").where(_sizes(F.col("na"), F.col("nb"), percent) & _close("a", "b", most)).select("a", "b"))
    asked = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = saved(sets_of(docs, nodes.join(asked, "node", "left_semi").select("node", "id"), key, text))
    first = saved(verified_stars(stars, sets, percent))
    labels = of_hubs(first)
    known = met.join(labels, "node", "left").select(F.col("key").alias("grp"), "node", F.coalesce("label", "node").alias("label"), F.lit(0).alias("n"))
    close = saved(between(by_cells(dealt(saved(known), tile, ROOM), words, most), labels))
    groups = connected(close).select(F.col("node").alias("label"), F.col("component").alias("grp"))
    of = nodes.select("node", "id", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    grouped = saved(of.join(groups, "label"))
    more = sets_of(docs, grouped.select("node", "id"), key, text)
    found = by_cells(dealt(grouped.drop("id"), tile, room), words, most, more, percent)
    return labels, between(first.unionByName(found), labels)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """id, n_shingles, component, kept: a row for each row of docs."""
    every = saved(sketched(docs, key, text))
    linked = every.where("id IS NOT NULL AND node IS NOT NULL")
    firsts = linked.groupBy("node").agg(F.min("id").alias("id"))
    nodes = saved(linked.join(firsts, ["node", "id"]).select("node", "id", "n", "bands", *BITS).dropDuplicates(["node"]))
    labels, edges = links(nodes, docs, key, text, **how)
    found = connected(edges).select(F.col("node").alias("label"), "component")
    of = nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = saved(of.join(found, "label", "left").select("node", "id", F.coalesce("component", "label").alias("component")))
    least = of.groupBy("component").agg(F.min("id").alias("least"))
    named = of.join(least, "component").select("node", "least")
    out = every.select("id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs but those near-duplicate to a row with a smaller id; all columns. Rows of one id stay or go together."""
    gone = near_duplicates(docs, key, text, **how).where("NOT kept").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{key}`") == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
