r"""Filter interaction audit: what each of five filters removes in every order, and its Shapley value.

Each text becomes five failure bits. What a set S of filters removes from a part is the polynomial
f(x) = sum over masks of count * (1 - prod over the mask's filters of (1 - x)) at the corner S; its coefficients come
from the counts of at most 32 masks. Differences of corners give what each filter removes and keeps in each order, also
by labels (a polynomial each for good and toxic documents). A filter's Shapley value is the integral of the partial
derivative along the diagonal, in exact rationals, and 120 times it the sum over all orders.

Texts are read once; identical ones are found by a grouped minimum over SHA-256 digests, which combines before the
shuffle, so a text that a third of all rows share is one row for each task. Only (part, mask) counts are gathered, 32
rows a part at most.

Defined results: a null text is empty and identical to other empty ones; a null part is the empty string; a row with a
null id is no copy and makes none; labels count if any label row of the id has them, a null label or id is none; very
long texts count whole; repeated rows of one id and text are no copies of each other; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import saved

#: The filters, their thresholds and the symbols that D looks for.
FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SYMBOLS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

A, B, C, D, E = (1 << i for i in range(5))
Polynomial = dict[int, int]


def own_mask(text: bytes, chars: int) -> int:
    """The failure bits that a text has by itself: A to D."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        A * (len(words) < LEAST_WORDS)
        | B * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
        | C * (100 * upper > UPPER_PERCENT * chars)
        | D * (len(text.translate(None, SYMBOLS)) < len(text))
    )


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id, part, digest, own: the bits A to D of each row and the SHA-256 of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pc.fill_null(b.column(2), "")
            chars = pc.utf8_length(t).to_pylist()
            raw = t.cast(pa.binary()).to_pylist()
            own = [own_mask(x, n) for x, n in zip(raw, chars)]
            yield pa.RecordBatch.from_arrays([b.column(0), pc.fill_null(b.column(1), ""), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array(own, pa.int32())], ["id", "part", "digest", "own"])

    cols = F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{part}`").cast("string").alias("part"), F.col(f"`{text}`").alias("t")
    return docs.select(*cols).mapInArrow(run, "id long, part string, digest binary, own int")


def label(name: str) -> Column:
    return F.max((F.coalesce(F.col(f"`{name}`"), F.lit(0)) == 1).cast("int")).alias(name)


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part by the filters that they fail, with their labels."""
    every = saved(marks(docs, key, text, part))
    firsts = every.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"))
    # a row that is its text's first meets its id there: the join is by ids, so a text that many rows share is no hot key
    firsts = firsts.select(F.col("first").alias("id"), "digest", F.lit(True).alias("is_first"))
    known = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("id")).agg(label("quality"), label("toxic"))
    rows = every.join(firsts, ["id", "digest"], "left").join(known, "id", "left")
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return rows.groupBy("part", F.col("own").bitwiseOR(copy.cast("int") * E).alias("mask")).agg(F.count("*").alias("n"), one("quality").alias("good"), one("toxic").alias("toxic"))


def polynomial(counts: dict[int, int]) -> Polynomial:
    """The removal polynomial as coefficients of products of distinct variables, a bit for each variable."""
    out: Polynomial = {}
    for mask, n in counts.items():
        term = mask
        while term:  # every non-empty subset of the mask
            out[term] = out.get(term, 0) + (n if term.bit_count() % 2 else -n)
            term = (term - 1) & mask
    return out


def corner(f: Polynomial, s: int) -> int:
    """f where the variables of s are one and the others zero: the documents that the filters of s remove."""
    return sum(c for term, c in f.items() if term & ~s == 0)


def derivative(f: Polynomial, i: int) -> dict[int, int]:
    """The partial derivative in variable i along the diagonal, as coefficients of powers of t."""
    out: dict[int, int] = {}
    for term, c in f.items():
        if term & i:
            out[term.bit_count() - 1] = out.get(term.bit_count() - 1, 0) + c
    return out


def integral(p: dict[int, int]) -> Fraction:
    """Of a polynomial in t from zero to one."""
    return sum((Fraction(c, k + 1) for k, c in p.items()), Fraction(0))


def audit(counts: list[tuple[int, int, int, int]], filters: str = FILTERS) -> pd.DataFrame:
    """The rows of one part. counts: (mask, documents, good ones, toxic ones)."""
    total = sum(n for _, n, _, _ in counts)
    every, good, toxic = (polynomial({c[0]: c[k] for c in counts}) for k in (1, 2, 3))
    bits = {name: 1 << i for i, name in enumerate(filters)}
    whole = (1 << len(filters)) - 1
    at = {s: tuple(corner(f, s) for f in (every, good, toxic)) for s in range(whole + 1)}
    orders = list(permutations(filters))
    shapley = {x: integral(derivative(every, b)) * len(orders) for x, b in bits.items()}
    fails = {x: at[b][0] for x, b in bits.items()}
    unique = {x: at[whole][0] - at[whole & ~b][0] for x, b in bits.items()}
    rows = []
    for order in orders:
        s = 0
        for step, x in enumerate(order, 1):
            before, s = at[s], s | bits[x]
            removed, good_lost, toxic_lost = (p - q for p, q in zip(at[s], before))
            assert shapley[x].denominator == 1, "the sum over all orders is whole"
            rows.append(("".join(order), step, total - at[s][0], removed, fails[x] - removed, unique[x], good_lost, toxic_lost, int(shapley[x])))
    return pd.DataFrame(rows, columns="filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split())


def orders(counts: DataFrame) -> DataFrame:
    """The audit of each part, from the counts of its masks."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, counts in zip(frame["part"], frame["counts"]):
                out = audit([(int(c["mask"]), int(c["n"]), int(c["good"]), int(c["toxic"])) for c in counts])
                out.insert(0, "part", part)
                yield out

    return parts.mapInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return orders(masks(docs, labels))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
     f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
                   coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fails
           FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
     m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
     x AS (SELECT unnest(generate_series(1, 5)) AS i),
     o(o) AS (SELECT [i] FROM x UNION ALL SELECT list_append(o, i) FROM o, x WHERE NOT list_contains(o, i)),
     p AS (SELECT o, step, o[step] AS i, o[1:step - 1] AS earlier FROM (SELECT o FROM o WHERE len(o) = 5), (SELECT i AS step FROM x)),
     r AS (SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step, i, n, good, toxic, fails[i] AS failed,
                  len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AS only_one FROM m, p),
     s AS (SELECT part, filter_order, step, i, sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
                  sum(CASE WHEN failed AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed AND only_one THEN n ELSE 0 END)::BIGINT AS unique_fails,
                  sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failed AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
           FROM r GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM s
"""
