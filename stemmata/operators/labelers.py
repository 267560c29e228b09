"""Outside labelers as a Python table function: partitioned input, batches, retries, and a store that is asked first.

A labeler takes a list of lines and gives a label for each, None for a line that it skipped; it may fail as a whole. An
answer is kept under (belief, line, model), so another model or belief asks anew and nothing else does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..sources.runs import append_labels
from ..sources.scratch import written

KEYS = ["belief", "line_hash", "model"]
BATCH, TRIES = 30, 3
SHAPE = "belief string, line_hash string, model string, label string, tries int"

Labeler = Callable[[list[str]], list[str | None]]


def table_function(labeler: Labeler, model: str, size: int = BATCH, tries: int = TRIES):
    """A UDTF over rows (part, belief, line_hash, line): batches of `size` of a partition; what a batch skips goes into the next.

    A line that was skipped `tries` times has no row: it stays to be asked at another time.
    """

    @udtf(returnType=SHAPE)
    class Labels:
        def __init__(self) -> None:
            self.held: list[tuple[Row, int]] = []

        def ask(self) -> Iterator[tuple]:
            batch, self.held = self.held[:size], self.held[size:]
            try:
                found = labeler([r["line"] for r, _ in batch])
            except Exception:  # noqa: BLE001  the outside failed: the whole batch was skipped
                found = [None] * len(batch)
            if len(found) != len(batch):
                found = [None] * len(batch)
            for (r, n), label in zip(batch, found):
                if label is not None:
                    yield r["belief"], r["line_hash"], model, label, n + 1
                elif n + 1 < tries:
                    self.held.append((r, n + 1))

        def eval(self, row: Row) -> Iterator[tuple]:
            self.held.append((row, 0))
            while len(self.held) >= 2 * size:  # skipped lines wait among them
                yield from self.ask()

        def terminate(self) -> Iterator[tuple]:
            while self.held:
                yield from self.ask()

    return Labels


def ask(lines: DataFrame, labeler: Labeler, model: str, size: int = BATCH, tries: int = TRIES, per_part: int = 20) -> DataFrame:
    """belief, line_hash, model, label, tries of distinct lines (belief, line_hash, line), in partitions of about `per_part` batches."""
    rows = lines.groupBy("belief", "line_hash").agg(F.min("line").alias("line"))
    parts = max(1, -(-rows.count() // (size * per_part)))
    dealt = rows.select(F.pmod(F.xxhash64("belief", "line_hash"), F.lit(parts)).alias("part"), "belief", "line_hash", "line")
    return table_function(labeler, model, size, tries)(dealt.asTable().partitionBy("part").orderBy("belief", "line_hash"))


def stored(lines: DataFrame, store: str, labeler: Labeler, model: str, **how) -> DataFrame:
    """The labels that were asked for now and added to the store; those that it has are not asked for again."""
    spark = lines.sparkSession
    try:
        known = spark.read.parquet(store).where(F.col("model") == model).select("belief", "line_hash")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        lines = lines.join(known, ["belief", "line_hash"], "left_anti")
    new = written(ask(lines, labeler, model, **how))  # each row was a call outside: it is made once
    append_labels(spark, store, new, KEYS)
    return new
