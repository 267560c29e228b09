"""Statistics: agreement of raters, intervals, exact tails, medians."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

Z = 1.96


def confusion(pairs: DataFrame, a: str, b: str, group: list[str] = ()) -> DataFrame:
    """group, a, b, n."""
    return pairs.groupBy(*group, a, b).agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame, a: str, b: str, group: list[str] = ()) -> DataFrame:
    """group, n, agreed, kappa: Cohen's kappa from counts and marginals; 1 where chance agreement is full."""
    cells = confusion(pairs, a, b, group)
    total = cells.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agreed"))
    left = cells.groupBy(*group, F.col(a).alias("_x")).agg(F.sum("n").alias("_l"))
    right = cells.groupBy(*group, F.col(b).alias("_x")).agg(F.sum("n").alias("_r"))
    by_chance = left.join(right, [*group, "_x"]).groupBy(*group).agg(F.sum(F.col("_l") * F.col("_r")).alias("_chance"))
    both = total.join(by_chance, list(group), "left") if group else total.crossJoin(by_chance)  # one row each
    chance = F.coalesce("_chance", F.lit(0)) / (F.col("n") * F.col("n"))
    observed = F.col("agreed") / F.col("n")
    return both.select(*group, "n", "agreed", F.when(chance == 1, 1.0).otherwise((observed - chance) / (1 - chance)).alias("kappa"))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n, (0, 0) for n = 0."""
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = (mid - half) / (1 + zz / n), (mid + half) / (1 + zz / n)
    zero = F.lit(0.0)
    return F.when(n == 0, zero).otherwise(F.greatest(low, zero)), F.when(n == 0, zero).otherwise(F.least(high, F.lit(1.0)))


def tail(ps: Column, k: Column | int) -> Column:
    """P(at least k of independent events with probabilities ps happen), by exact convolution in array functions."""
    zero = F.array(F.lit(1.0))
    add = lambda d, p: F.zip_with(F.concat(d, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), d), lambda stay, come: stay * (1 - p) + come * p)
    return F.aggregate(ps, zero, add, lambda d: F.aggregate(F.slice(d, F.lit(k) + 1 if isinstance(k, int) else k + 1, F.size(d)), F.lit(0.0), lambda a, x: a + x))


#: What is left out of a distribution: coefficients that no sum of doubles shows beside the others.
NOTHING = 1e-320
POLYNOMIAL = StructType([StructField("low", LongType()), StructField("c", ArrayType(DoubleType()))])


def trimmed(low: int, c: np.ndarray) -> tuple[int, np.ndarray]:
    """A distribution (low, c), P(low + i) = c[i], without ends that are nothing: so its length grows with the root of the events."""
    some = np.nonzero(c > NOTHING)[0]
    return (low + int(some[0]), c[some[0] : some[-1] + 1]) if len(some) else (low, c[:1])


def product(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """The distribution of a sum, by halves. Terms are never negative, so each coefficient keeps its relative precision: no transform."""
    while len(parts) > 1:
        pairs = [(a[0] + b[0], np.convolve(a[1], b[1])) for a, b in zip(parts[::2], parts[1::2])]
        parts = [trimmed(*x) for x in pairs] + parts[len(parts) - len(parts) % 2 :]
    return parts[0]


@F.pandas_udf(POLYNOMIAL)
def of_events(ps: pd.Series) -> pd.DataFrame:
    """The number of events that happen, of an array of probabilities."""
    out = [product([(0, np.array([1 - p, p])) for p in x] or [(0, np.ones(1))]) for x in ps]
    return pd.DataFrame({"low": [x[0] for x in out], "c": [x[1] for x in out]})


@F.pandas_udf(POLYNOMIAL)
def of_parts(parts: pd.Series) -> pd.DataFrame:
    """The sum of independent numbers, of an array of their distributions."""
    out = [product([(int(p["low"]), np.asarray(p["c"], float)) for p in x]) for x in parts]
    return pd.DataFrame({"low": [x[0] for x in out], "c": [x[1] for x in out]})


def distribution(events: DataFrame, keys: list[str], p: str, order: str, block: int = 512, fan: int = 8) -> DataFrame:
    """keys, n, low, c: how many of each group's events (keys, p, order) happen, exactly: P(low + i) = c[i].

    A tree of products: events are dealt into blocks of about `block` by a hash of `order`, each makes a polynomial, and
    `fan` polynomials at a time are multiplied until one is left. No array holds a group's events; a polynomial holds the
    numbers that are possible at double precision. Only the number of blocks of the largest group reaches the driver.
    """
    events = events.select(*dict.fromkeys([*keys, p, order]))
    counts = events.groupBy(*keys).agg(F.count("*").alias("n"))
    sized = counts.withColumn("_blocks", F.ceil(F.col("n") / block))
    dealt = events.join(sized, keys) if keys else events.crossJoin(sized)  # one row without keys
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(order), F.col("_blocks")))
    # sorted by value, so the result depends on no order of arrival
    parts = dealt.groupBy(*keys, "n", "_part").agg(F.sort_array(F.collect_list(F.col(p).cast("double"))).alias("_ps")).select(*keys, "n", "_part", of_events("_ps").alias("_d"))
    left = sized.agg(F.max("_blocks")).first()[0] or 0
    while left > 1:
        left = -(-left // fan)
        up = parts.groupBy(*keys, "n", F.floor(F.col("_part") / fan).alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_part", "_d"))).alias("_ds"))
        parts = up.select(*keys, "n", "_part", of_parts(F.transform("_ds", lambda x: x["_d"])).alias("_d"))
    return parts.select(*keys, "n", "_d.low", "_d.c")


def at_least(k: Column) -> Column:
    """P(k or more) of the columns low and c of a distribution; the smallest terms first."""
    above = F.filter("c", lambda x, i: F.col("low") + i >= k)
    return F.aggregate(F.reverse(above), F.lit(0.0), lambda a, x: a + x)


def hash_sample(df: DataFrame, stratum: list[str], key: str, per: int, seed: int) -> DataFrame:
    """The first `per` rows of each stratum in order of SHA-256 of key and seed: the same rows on any partitioning."""
    from pyspark.sql import Window

    order = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*stratum).orderBy(order, key))).where(F.col("place") <= per)
