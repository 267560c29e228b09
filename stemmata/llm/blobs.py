"""Number columns as compressed binary cells, and texts dealt into chunks: what operators on whole corpora share."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(a: np.ndarray) -> bytes:
    """Numbers of 64 bits as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(b: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(kind)


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def chunk_of(key: str, text: str, chunks: int) -> Column:
    """The chunk of a row, by its key; of a row without a key, by its text."""
    return F.pmod(F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(chunks))


def hash_bounds(buckets: int) -> np.ndarray:
    """The smallest unsigned 64-bit hash of each bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
