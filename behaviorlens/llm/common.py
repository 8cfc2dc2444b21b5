"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize
from ..session import stored as written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written_by(df: DataFrame, column: str) -> DataFrame:
    """``df`` stored like by ``written``, in a folder for each value of
    ``column``, so that a filter on it reads only its own rows."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(column).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: str | Column) -> Column:
    """Text as bytes; NULL stays NULL."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


#: Powers of an odd base modulo 2**64, and of its inverse.
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: A 64-bit value for each byte, from the finaliser below.
_BYTES: list[np.ndarray] = []
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> list[np.ndarray]:
    """(base**i, base**-i) for i < n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every white-space separated word of ``text``: a
    polynomial over its bytes, for all words at once by prefix sums."""
    if not _BYTES:
        _BYTES.append(mixed(np.arange(1, 257, dtype=np.uint64)))
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[0][raw] * down[: len(raw)], out=prefix[1:])
    return mixed((prefix[end] - prefix[start]) * up[start] + (end - start).astype(np.uint64)), start


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """First index of every run of equal values in a sorted array."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def run_bounds(ordered: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of every run of equal values in a sorted array."""
    first = run_starts(ordered)
    return list(zip(first.tolist(), np.append(first[1:], len(ordered)).tolist(), strict=True)) if len(first) else []


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Root (smallest index) of each of ``n`` nodes under the given links."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every node that has a link to another node;
    component is the smallest id reachable.  Alternating large-star and
    small-star steps: each groups by node with partial aggregation and joins
    the minimum back, so a hub is split by the skew join, and the number of
    rounds grows with the logarithm of the longest path."""

    def folded(pairs: DataFrame) -> DataFrame:
        big, small = F.greatest("x", "y"), F.least("x", "y")
        return pairs.filter("x <> y").select(big.alias("x"), small.alias("y")).distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()

    links = materialize(folded(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()))
    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low")))
        large = materialize(folded(both.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("low").alias("y"))))
        low = materialize(large.groupBy("x").agg(F.min("y").alias("low")))
        small = large.join(low, "x").select("y", "low").filter("y <> low").select(F.col("y").alias("x"), F.col("low").alias("y"))
        links = materialize(folded(small.unionByName(low.select("x", F.col("low").alias("y")))))
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("x").alias("node"), F.col("y").alias("component"))
