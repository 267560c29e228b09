"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

A text is split by the public pattern; each distinct match is encoded once a worker and cached. Matches that are a
token themselves are taken whole; the others become token-position rows. A recursive query joins neighbouring rows with
the merge table, contracts each word's leftmost pair of minimum rank, and goes on with the words that changed until
none has a pair left. Ids are decoded by an ordered aggregation over the token bytes.

A word of over `LONG` bytes would take a step for each merge. There a step contracts every pair that is the leftmost
minimum within REACH tokens on both sides: a merge farther away could reach it before its turn only through one token
longer than REACH bytes, and no token is, so the result is the same. Such words recur in rounds of bounded rows.

Memory: texts are taken in blocks of about BLOCK characters (one text at least), DuckDB is held to MEMORY, and the cache
to CACHE words, of which those in use stay.

Defined results: a null text is empty and has no ids; an id outside the vocabulary decodes to U+FFFD; of two pairs with
the minimum rank the left one goes first; rows are independent, so repeated rows repeat their result; very long texts
and words are encoded whole; an empty table gives no rows; extra columns are not read by the query and kept by encode()
and decode(), which replace a column of the name they write.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

LONG, BLOCK, CACHE, MEMORY, ROWS = 512, 3_000_000, 400_000, "256MB", 3_000_000
POSITION = 26  # bits of a byte position within a word
SHORT = (1 << 10) - 1

#: The letters, numbers and white space below U+0180, and all white space, as Unicode has them.
LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = r"\t-\r \x85\xa0"
SPACES = SPACE + r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(pattern: str):
    """text -> its matches. The classes of `pattern` are written out: for texts below U+0180 in `re`, else in `regex`."""
    full = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACES}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]"))
    fast = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{LATIN}{NUMBERS}]").replace(r"\p{L}", f"[{LATIN}]").replace(r"\p{N}", f"[{NUMBERS}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
    other = re.compile(r"[^\x00-\u017f]")
    return lambda text: (full if other.search(text) else fast).findall(text)


FROM_STATE = """
WITH RECURSIVE s(k, t, n, i) AS (
  SELECT k, t, n, 0 FROM start
  UNION ALL
  SELECT s.k, CASE WHEN s.k = b.k THEN b.rank ELSE s.t END, CASE WHEN s.k = b.k THEN b.size ELSE s.n END, s.i + 1
  FROM s JOIN (
    SELECT w, (w << {P}) + ((best >> 20) & {M}) AS k, (w << {P}) + ((best >> 20) & {M}) + ((best >> 10) & 1023) AS eaten,
           best >> (20 + {P}) AS rank, best & 1023 AS size
    FROM (SELECT a.k >> {P} AS w, min((m.rank << (20 + {P})) + ((a.k & {M}) << 20) + (a.n << 10) + a.n + c.n) AS best
          FROM s a JOIN s c ON c.k = a.k + a.n JOIN merges m ON m.pair = (a.t << 20) + c.t GROUP BY 1)
  ) b ON (s.k >> {P}) = b.w AND s.k <> b.eaten
)
SELECT s.k, s.t, s.n, s.i FROM s JOIN (SELECT k >> {P} AS w, max(i) AS i FROM s GROUP BY 1) e ON (s.k >> {P}) = e.w AND s.i = e.i
"""

FROM_STATE_LONG = """
WITH RECURSIVE s(k, t, n, i) AS (
  SELECT k, t, n, 0 FROM start
  UNION ALL
  SELECT s.k, coalesce(x.rank, s.t), coalesce(x.size, s.n), s.i + 1
  FROM s SEMI JOIN {takes} AS words ON (s.k >> {P}) = (words.k >> {P})
         ANTI JOIN {takes} AS gone ON s.k = gone.eaten
         LEFT JOIN {takes} AS x ON s.k = x.k
  WHERE s.i < {depth}
)
SELECT s.k, s.t, s.n, s.i FROM s JOIN (SELECT k >> {P} AS w, max(i) AS i FROM s GROUP BY 1) e ON (s.k >> {P}) = e.w AND s.i = e.i
"""

TAKES = """(SELECT k, k + n AS eaten, own >> {P} AS rank, size FROM (
    SELECT a.k, a.n, a.n + c.n AS size, (m.rank << {P}) + (a.k & {M}) AS own,
           min((m.rank << {P}) + (a.k & {M})) OVER (PARTITION BY a.k >> {P} ORDER BY a.k ROWS BETWEEN {R} PRECEDING AND {R} FOLLOWING) AS least
    FROM s a JOIN s c ON c.k = a.k + a.n LEFT JOIN merges m ON m.pair = (a.t << 20) + c.t) WHERE own = least)"""

DECODE = "SELECT w, string_agg(coalesce(v.hex, 'efbfbd'), '' ORDER BY o.p) AS hex FROM ids o LEFT JOIN vocabulary v ON v.id = o.t GROUP BY w"


class Codec:
    """A vocabulary in an in-memory DuckDB of one thread, with a cache of encoded words."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = splitter(pattern)
        self.whole = {t: r for t, r in self.ranks.items()}
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 20) + b)
                    merged.append(rank)
        self.reach = max(map(len, self.ranks))
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.db = duckdb.connect()
        for setting in ("threads = 1", f"memory_limit = '{MEMORY}'", "enable_progress_bar = false", "preserve_insertion_order = false"):
            self.db.execute(f"SET {setting}")
        self.db.register("given", pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(merged, pa.int64())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "hex": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.ids: dict[str, str] = {}
        self.back: dict[str, str] = {}
        self.used: set[str] = set()

    def _fixpoint(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of each final token, in order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words)), sizes)
        k = (w << POSITION) + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        state = pa.table({"k": k, "t": self.byte[flat], "n": np.ones(len(flat), np.int64)})
        fill = {"P": POSITION, "M": (1 << POSITION) - 1, "R": self.reach}
        if sizes.max() <= LONG:
            self.db.register("start", state)
            out = self.db.sql(FROM_STATE.format(**fill)).to_arrow_table()
        else:
            done = []
            while state.num_rows:
                depth = max(1, ROWS // state.num_rows)
                self.db.register("start", state)
                out = self.db.sql(FROM_STATE_LONG.format(takes=TAKES.format(**fill), depth=depth, **fill)).to_arrow_table()
                more = np.asarray(out["i"]) == depth
                done.append(out.filter(pa.array(~more)))
                state = out.filter(pa.array(more)).select(["k", "t", "n"])
            out = pa.concat_tables(done)
        k, t = np.asarray(out["k"]), np.asarray(out["t"])
        order = np.argsort(k)
        return k[order] >> POSITION, t[order]

    def decoded(self, w: np.ndarray, t: np.ndarray) -> dict[int, bytes]:
        """Bytes of each word's ids, by an ordered aggregation."""
        self.db.register("ids", pa.table({"w": w, "p": np.arange(len(w)), "t": t}))
        out = self.db.sql(DECODE).to_arrow_table()
        return {a: bytes.fromhex(b) for a, b in zip(out["w"].to_pylist(), out["hex"].to_pylist())}

    def learn(self, words: set[str]) -> None:
        """Puts the ids and the decoded text of each word into the cache."""
        known = words & self.ids.keys()
        self.used |= known
        new = sorted(words - known)
        if len(self.ids) + len(new) > CACHE:
            keep = self.used | known
            if len(keep) > CACHE // 2:
                keep = known
            self.ids = {w: self.ids[w] for w in keep}
            self.back = {w: self.back[w] for w in keep}
            self.used = set()
        raw = [w.encode() for w in new]
        groups: dict[bool, list[int]] = {False: [], True: []}
        at, tokens = [], []
        for i, b in enumerate(raw):
            if (r := self.whole.get(b)) is not None:
                at.append(i)
                tokens.append(r)
            else:
                groups[len(b) > LONG].append(i)
        ws, ts = [np.array(at, np.int64)], [np.array(tokens, np.int64)]
        for own in groups.values():
            if own:
                w, t = self._fixpoint([raw[i] for i in own])
                ws.append(np.array(own, np.int64)[w])
                ts.append(t)
        w, t = np.concatenate(ws), np.concatenate(ts)
        order = np.argsort(w, kind="stable")
        w, t = w[order], t[order]
        back = self.decoded(w, t)
        ends = np.searchsorted(w, np.arange(len(new) + 1)).tolist()
        text = list(map(str, t.tolist()))
        for i, word in enumerate(new):
            self.ids[word] = " ".join(text[ends[i] : ends[i + 1]])
            b = back[i]
            self.back[word] = word if b == raw[i] else b.decode("utf-8", "surrogateescape")

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[str, bytes]]:
        """(ids joined by spaces, bytes that they decode to) of each text, block by block."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= BLOCK):
                size += len(texts[end] or "")
                end += 1
            split = [self.split(x or "") for x in texts[at:end]]
            self.learn(set().union(*split))
            ids, back = self.ids.__getitem__, self.back.__getitem__
            for words in split:
                yield " ".join(map(ids, words)), "".join(map(back, words)).encode("utf-8", "surrogateescape")
            at = end


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, kept between tasks."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [list(map(int, x.split())) for x, _ in codec(path, pattern).encoded(b.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, ids])

    base = docs.drop(ids)
    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(ids, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the bytes that their ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(ids).to_pylist()
            w = np.repeat(np.arange(len(given)), [len(x or ()) for x in given])
            back = codec(path, pattern).decoded(w, np.array([t for x in given for t in x or ()], np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else back.get(i, b"") for i, x in enumerate(given)], pa.binary())], [*b.schema.names, text])

    base = rows.drop(text)
    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(text, BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, back = [], [], []
            for x, raw in codec(path, pattern).encoded(b.column(1).to_pylist()):
                n.append(x.count(" ") + 1 if x else 0)
                ids.append(hashlib.sha256(x.encode()).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
