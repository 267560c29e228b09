"""Substring deduplication: suffix automata of reference shards, and passages streamed for matching statistics.

A passage of `window` words is removed where its word sequence also starts in a document with a smaller id.

1. Documents are dealt into chunks of about CHUNK bytes by a hash of their id; one exchange serves all passes.
2. Every window has an anchor: the smallest hash among its runs of ANCHOR words. Equal windows have equal anchors, so
   anchors can route but not decide. Each chunk sends its distinct anchors, sorted and compressed, to buckets by hash
   range; a bucket tells each chunk which of them other chunks have too.
3. Each chunk sends the passages around shared anchors (maximal runs of windows with one anchor, at most RUN windows) to
   the shard of their anchor, each distinct passage once with its smallest and largest document id.
4. A shard takes the passages of an anchor in order of their smallest id, equal ones as one. Each is streamed through
   the suffix automaton of the passages of smaller documents for matching statistics, then added to it as reference.
   Windows that match over `window` words or more are repeats, and so is all of a passage in a document behind its first;
   nothing else decides.
5. Each chunk unites the spans of its passages and removes the maximal ones.

The automata are not broadcast: the references are the corpus, so they have no size bound, and streaming every document
through every shard grows with the square of the corpus. A shard is sent only the passages that can match in it.

An anchor that more than `most` passages have is hot: its windows then go one by one under their own hash, and only the
first document of each matters, so their rows are streamed and not held. Every other anchor has `most` passages at most,
which bounds its automaton. A bucket holds one entry of an anchor for each chunk, a passage sends one row for each chunk
that has it, however many documents share it.

Anchors are hashes of 64 bits and only route; words are told apart by 32 bits, so a window agrees in 32 bits for each word.

Defined results: a null or blank text has no words and stays as it is; rows with a null id are neither references nor
cut; rows with the same id are no references for each other; texts of under `window` words stay; very long texts are cut
like any other; ids are integers; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import chunk_of, hash_bounds, packed, text_bytes, unpacked

WINDOW, ANCHOR, RUN, CHUNK, BUCKET, MOST = 13, 5, 1024, 8 << 20, 3_000_000, 4096
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)  # fixed values: odd multipliers of public mixers
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def in_order(ids: list, texts: list) -> list[int]:
    """The places of rows with an id, in order of (id, text)."""
    return sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (ids[i], texts[i] or b""))


class Chunk:
    """The words of a chunk's rows, in order of (id, text), its windows, and their anchors."""

    def __init__(self, ids: list, texts: list[bytes | None], window: int):
        self.order = in_order(ids, texts)
        words = [(texts[i] or b"").split() for i in self.order]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        h = xxhash.xxh3_64_intdigest
        self.words = np.fromiter((h(w) for ws in words for w in ws), np.uint64, n)
        row = np.repeat(np.arange(len(words)), sizes)
        m = max(0, n - window + 1)
        self.at = np.nonzero(row[:m] == row[window - 1 :])[0] if m else np.empty(0, np.int64)  # first word of each window
        self.row = row[self.at]
        self.doc = np.array([ids[i] for i in self.order], np.int64)[self.row] if len(self.at) else np.empty(0, np.int64)
        size = min(ANCHOR, window)
        x = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size):
            x = x * BASE + self.words[j : j + len(x)]
        x ^= x >> np.uint64(33)
        x *= MIX
        x ^= x >> np.uint64(29)
        low = x[:m].copy()
        for j in range(1, window - size + 1):
            np.minimum(low, x[j : j + m], out=low)
        low = low[self.at]
        self.anchor, self.key = np.unique(low, return_inverse=True)
        # rows are in order of id, so the first and last window of an anchor have its smallest and largest id
        first, last = np.full(len(self.anchor), len(low)), np.full(len(self.anchor), -1)
        np.minimum.at(first, self.key, np.arange(len(low)))
        np.maximum.at(last, self.key, np.arange(len(low)))
        self.many = self.doc[first] != self.doc[last] if len(low) else np.empty(0, bool)

    def runs(self, good: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first window, number of windows) of each run of good windows of one row and anchor; single windows stand alone."""
        i = np.nonzero(good)[0]
        if not len(i):
            return i, i
        cut = (np.diff(i) != 1) | (np.diff(self.at[i]) != 1) | (np.diff(self.key[i]) != 0) | single[i[1:]] | single[i[:-1]]
        first = np.concatenate(([0], np.nonzero(cut)[0] + 1))
        n = np.diff(np.append(first, len(i)))
        parts = -(-n // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(i[first], parts) + nth * RUN, np.minimum(np.repeat(n, parts) - nth * RUN, RUN)


class Automaton:
    """A suffix automaton over numbers."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.last = [-1], [0], 0

    def extend(self, words: list[int]) -> None:
        nxt, link, size, last = self.next, self.link, self.size, self.last
        for c in words:
            p, cur = last, len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[p] + 1)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    size.append(size[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.last = last

    def matches(self, words: list[int], window: int) -> list[int]:
        """Starts of the windows of words that the automaton holds, by matching statistics."""
        nxt, link, size = self.next, self.link, self.size
        v = n = 0
        out = []
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = size[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            if n >= window:
                out.append(i - window + 1)
        return out


def streamed(passages: list[tuple[int, list[int]]], window: int) -> list[list[int]]:
    """For each (low, 32-bit words), in order of low: its windows that start in passages of a smaller low."""
    a, mark, out, held = Automaton(), -1, [], False
    for _, same in groupby(passages, key=lambda p: p[0]):
        same = [w for _, w in same]
        found = [a.matches(w, window) if held else [] for w in same]
        out += found
        if len(out) < len(passages):
            for w, at in zip(same, found):
                if len(at) < len(w) - window + 1:  # what the automaton holds whole isn't added again
                    a.extend([*w, mark])  # no passage goes on into the next
                    mark -= 1
                    held = True
    return out


def spans(at: list[int]) -> list[int]:
    """Sorted window starts as start, number, start, number, .. of runs."""
    out: list[int] = []
    for x in at:
        if out and out[-2] + out[-1] == x:
            out[-1] += 1
        else:
            out += (x, 1)
    return out


def repeated_spans(dealt: DataFrame, key: str, text: str, chunk: str, buckets: int, window: int, most: int) -> DataFrame:
    """chunk, rows, starts, low, before, after: passages of a chunk at word `starts` of `rows` (index in order of id and text), and their spans."""
    edge = hash_bounds(buckets)

    def load(table: pa.Table) -> Chunk:
        return Chunk(table.column(key).to_pylist(), table.column(text).cast(pa.binary()).to_pylist(), window)

    def ask(table: pa.Table) -> pa.Table:
        c = load(table)
        cut = [0, *np.searchsorted(c.anchor, edge).tolist(), len(c.anchor)]
        first, _ = c.runs(np.ones(len(c.at), bool), np.zeros(len(c.at), bool))
        n = np.bincount(c.key[first], minlength=len(c.anchor)).astype(np.int64)
        rows = [(b, packed(np.diff(c.anchor[p:q].view(np.int64), prepend=0)), packed(n[p:q])) for b, (p, q) in enumerate(zip(cut, cut[1:])) if q > p]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([table.column(chunk)[0].as_py()] * len(rows), pa.int64()), "anchors": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        """To each chunk: which of its anchors (by place) others have too, or are hot."""
        anchors = [np.cumsum(unpacked(x)) for x in table.column("anchors").to_pylist()]
        n = np.concatenate([unpacked(x) for x in table.column("n").to_pylist()])
        _, place = np.unique(np.concatenate(anchors), return_inverse=True)
        shared, hot = np.bincount(place) > 1, np.bincount(place, weights=n) > most
        rows, p = [], 0
        for where, own in zip(table.column("chunk").to_pylist(), anchors):
            at = place[p : p + len(own)]
            i = np.nonzero(shared[at] | hot[at])[0]
            if len(i):
                rows.append((where, packed(np.diff(i, prepend=0)), packed(hot[at][i].astype(np.int64))))
            p += len(own)
        b = table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([b] * len(rows), pa.int64()), "places": pa.array([r[1] for r in rows], pa.binary()), "hot": pa.array([r[2] for r in rows], pa.binary())})

    names = {"key": pa.int64(), "hot": pa.bool_(), "low": pa.int64(), "high": pa.int64(), "words": pa.binary(), "chunk": pa.int64(), "rows": pa.list_(pa.int32()), "starts": pa.list_(pa.int32())}
    told = {"chunk": pa.int64(), "low": pa.int64(), "rows": pa.list_(pa.int32()), "starts": pa.list_(pa.int32()), "before": pa.list_(pa.int32()), "after": pa.list_(pa.int32())}

    def passages(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[tuple, list] = {}
        if docs.num_rows:
            c = load(docs)
            shared, hot = c.many.copy(), np.zeros(len(c.anchor), bool)
            cut = np.concatenate(([0], np.searchsorted(c.anchor, edge)))
            for b, places, flags in zip(*(answers.column(x).to_pylist() for x in ("bucket", "places", "hot"))):
                i = np.cumsum(unpacked(places)) + cut[b]
                hot[i] = unpacked(flags) > 0
                shared[i] = True
            words, single = c.words.astype(np.uint32), hot[c.key]
            first, n = c.runs(shared[c.key], single)
            at, row = c.at[first], c.row[first]
            for k, one, a, e, r, s, d in zip(c.anchor[c.key[first]].view(np.int64).tolist(), single[first].tolist(), at.tolist(), (at + n + window - 1).tolist(), row.tolist(), (at - c.starts[row]).tolist(), c.doc[first].tolist()):
                w = words[a:e].tobytes()
                x = out.get(w) if not one else out.get((w,))
                if x is None:
                    out[(w,) if one else w] = [xxhash.xxh64_intdigest(w) - (1 << 63) if one else k, d, d, [r], [s]]
                else:
                    x[2] = d  # rows are in order of id
                    x[3].append(r)
                    x[4].append(s)
        where = docs.column(chunk)[0].as_py() if docs.num_rows else 0
        cols = ([x[0] for x in out.values()], [isinstance(w, tuple) for w in out], [x[1] for x in out.values()], [x[2] for x in out.values()], [w[0] if isinstance(w, tuple) else w for w in out], [where] * len(out), [x[3] for x in out.values()], [x[4] for x in out.values()])
        return pa.table({n: pa.array(x, t) for (n, t), x in zip(names.items(), cols)})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key and low. Those of a hot key hold one window, whose first row has its first document."""

        def met(rows: list[tuple]) -> Iterator[tuple]:
            first: dict[bytes, int] = {}
            for _, _, low, _, words, *_ in rows:
                first.setdefault(words, low)
            if len(first) == 1 and max(r[3] for r in rows) == rows[0][2]:
                return  # one document alone under its anchor has no reference
            found = dict(zip(first, map(spans, streamed([(low, np.frombuffer(w, np.uint32).tolist()) for w, low in first.items()], window))))
            for _, _, _, high, words, *place in rows:
                if high > first[words] or found[words]:
                    yield place[0], first[words], *place[1:], found[words], [0, len(words) // 4 - window + 1]

        held: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    out += [] if held[0][1] else met(held)
                    held = []
                if held and row[1]:  # hot: nothing but the first document matters
                    out.append((row[5], held[0][2], *row[6:], [], [0, 1]))
                else:
                    held.append(row)
                    if row[1] and row[3] > row[2]:
                        out.append((row[5], row[2], *row[6:], [], [0, 1]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, told.values())], list(told))
        if held:
            out = list(met(held)) if not held[0][1] else []
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, told.values())], list(told))

    asked = dealt.groupBy(chunk).applyInArrow(ask, "bucket long, chunk long, anchors binary, n binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, places binary, hot binary")
    sent = dealt.groupBy(chunk).cogroup(answered.groupBy("chunk")).applyInArrow(passages, "key long, hot boolean, low long, high long, words binary, chunk long, rows array<int>, starts array<int>")
    met = sent.repartition("key").sortWithinPartitions("key", "low")
    return met.mapInArrow(match, "chunk long, low long, rows array<int>, starts array<int>, before array<int>, after array<int>")


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """text without the words marked gone, each with the white space after it; the rest is as it was."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for (start, _), (after, _), g in zip(spans, [*spans[1:], (len(text), 0)], gone):
        if g:
            out.append(text[at:start])
            at = after
    return b"".join([*out, text[at:]])


def removed_words(found: pa.Table, ids: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Whether each word of a chunk goes: the union of the spans found. ids, ends: the id and word bounds of its rows in order."""
    change = np.zeros(int(ends[-1]) + 1, np.int64)
    flat = lambda c: found.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
    size = lambda c: pc.list_value_length(found.column(c)).to_numpy().astype(np.int64)
    if found.num_rows:
        n = size("rows")
        at, row = np.repeat(np.arange(len(n)), n), flat("rows")
        start = ends[row] + flat("starts")
        later = ids[row] > found.column("low").to_numpy()[at]
        for name, which in (("before", ~later), ("after", later)):
            pairs, many = flat(name).reshape(-1, 2), size(name) // 2
            first = np.cumsum(many) - many
            own, begin = at[which], start[which]
            each = many[own]
            i = np.repeat(first[own], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            a = np.repeat(begin, each) + pairs[i, 0]
            np.add.at(change, a, 1)
            np.add.at(change, a + pairs[i, 1] + window - 1, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False, chunk_bytes: int = CHUNK, bucket_words: int = BUCKET, most: int = MOST) -> DataFrame:
    """The rows of docs with their texts cut. With digest, instead: key, n_words, n_removed, kept_sha256."""
    total = text_bytes(docs, text)
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // (6 * bucket_words)))
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # any names, clashing ones too, pass through under these
    k, t = inner[names.index(key)], inner[names.index(text)]
    plain = docs.toDF(*inner)
    dealt = plain.withColumn("_chunk", chunk_of(k, t, chunks))
    found = repeated_spans(dealt.select(k, t, "_chunk") if digest else dealt, k, t, "_chunk", buckets, window, most)
    schema = plain.schema
    form = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = table.column(k).to_pylist(), table.column(t).cast(pa.binary()).to_pylist()
        order = in_order(ids, texts)
        words = {i: (texts[i] or b"").split() for i in order}
        ends = np.cumsum([0, *(len(words[i]) for i in order)])
        gone = removed_words(found, np.array([ids[i] for i in order], np.int64), ends, window)
        of = {i: gone[a:b] for i, a, b in zip(order, ends, ends[1:])}
        n_words, n_gone, digests = [], [], []
        for i, x in enumerate(texts):
            own = of.get(i)
            if digest:
                kept = words[i] if own is not None else (x or b"").split()
                n_words.append(len(kept))
                n_gone.append(0 if own is None else int(own.sum()))
                digests.append(hashlib.sha256(b" ".join([w for w, g in zip(kept, own.tolist()) if not g] if n_gone[-1] else kept)).hexdigest())
            elif own is not None and own.any():
                texts[i] = cut(x, own)
        if digest:
            return pa.table([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string())], schema=form)
        at = table.schema.names.index(t)
        table = table.set_column(at, t, pa.array(texts, pa.binary()).cast(pa.string()))
        return table.select(inner)

    left = dealt.select(k, t, "_chunk") if digest else dealt
    out = left.groupBy("_chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, f"{key} long, n_words long, n_removed long, kept_sha256 string" if digest else schema)
    return out if digest else out.toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i, w[i:i+12] AS g FROM t, unnest(generate_series(1, len(w) - 12)) AS u(i)),
     low AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
     gone AS (SELECT DISTINCT doc_id, i + j AS i FROM low, unnest(range(13)) AS v(j)),
     word AS (SELECT doc_id, i, w[i] AS x FROM t, unnest(generate_series(1, len(w))) AS u(i)),
     kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS s, count(*) AS n
              FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
