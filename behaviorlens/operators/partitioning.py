"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import default_parallelism


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin an input of fewer files than the cluster has cores, before
    CPU-heavy per-row work (tokenising, scoring).

    A large input has far more files than cores and is returned unchanged, so
    no extra shuffle happens at scale; a small file with one row group would
    otherwise run in a single task.  Frames without files are left alone."""
    target = min_partitions or default_parallelism(df.sparkSession)
    return df.repartition(target) if 0 < len(df.inputFiles()) < target else df
