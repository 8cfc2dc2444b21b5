"""Transition statistics and the per-entity model table.

Everything here is partial aggregation over the pair table, so an entity with
a third of all pairs still spreads over every map task; what reaches a reducer
is at most 288 counters per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FEATURE_NAMES, N_STATES
from .trajectories import feature_lookup


def transition_counts(pairs: DataFrame) -> DataFrame:
    """Counts of (state, action, next state) over consecutive pairs of the
    whole sequence, crossing trajectory borders (J8)."""
    return (
        pairs.where(F.col("next_state").isNotNull())
        .groupBy("entity", "state", "action", "next_state")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def transition_probabilities(pairs: DataFrame) -> DataFrame:
    """Count over the (state, action) row total (J9).  Unseen (state, action)
    rows are absent, i.e. all-zero, never uniform."""
    counts = transition_counts(pairs)
    row = Window.partitionBy("entity", "state", "action")
    return counts.withColumn("p", F.col("n") / F.sum("n").over(row))


def start_distribution(pairs: DataFrame) -> DataFrame:
    """Share of complete trajectories starting in each state."""
    return (
        pairs.where(F.col("kept") & (F.col("pos") == 0))
        .groupBy("entity", "state")
        .agg((F.count(F.lit(1)) / F.max("n_traj")).alias("p"))
    )


def state_visitation_frequency(pairs: DataFrame) -> DataFrame:
    """Visits inside complete trajectories per trajectory."""
    return (
        pairs.where(F.col("kept"))
        .groupBy("entity", "state")
        .agg((F.count(F.lit(1)) / F.max("n_traj")).alias("svf"))
    )


def feature_expectations(pairs: DataFrame) -> DataFrame:
    """Mean path feature vector over complete trajectories (J12), long form
    ``(entity, feature, expectation)``."""
    sums = [F.sum(feature_lookup(F.col("state"), i)).alias(f"f{i}") for i in range(len(FEATURE_NAMES))]
    wide = pairs.where(F.col("kept")).groupBy("entity").agg(F.max("n_traj").alias("_t"), *sums)
    stack = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("feature"), (F.col(f"f{i}") / F.col("_t")).alias("expectation"))
                for i, name in enumerate(FEATURE_NAMES)
            ]
        )
    )
    return wide.select("entity", stack.alias("x")).select("entity", "x.feature", "x.expectation")


def model_table(pairs: DataFrame, value_col: str | None = None) -> DataFrame:
    """One row per entity with everything the decision-model kernel needs:
    ``traj_len`` L, ``n_traj`` T and ``cells``, a list of aggregated counts
    ``(k, s, ns, cnt)``: k = 0 transitions s -> ns, k = 1 trajectory starts in
    s, k = 2 visits of s inside complete trajectories.  The kernel turns them
    into P (row-normalised transitions of the only seen action s % 4), the
    start distribution and the feature expectations.

    With ``value_col`` also ``r``, for each state the sum of that column over
    the entity's pairs in it (0 when unseen), from the same pass.

    Built from one aggregated cell table and one bounded group per entity (at
    most 16 * 16 + 16 + 16 + 16 = 304 cells)."""

    def kind(k: int, ns=F.lit(-1)):
        return F.struct(F.lit(k).alias("k"), F.col("state").alias("s"), ns.alias("ns"))

    kinds = [
        F.when(F.col("next_state").isNotNull(), kind(0, F.col("next_state"))),
        F.when(F.col("kept") & (F.col("pos") == 0), kind(1)),
        F.when(F.col("kept"), kind(2)),
    ]
    if value_col:
        kinds.append(kind(3))
    value = F.col(value_col).cast("double") if value_col else F.lit(0.0)
    cells = (
        pairs.select("entity", "traj_len", "n_traj", value.alias("value"), F.explode(F.array(*kinds)).alias("c"))
        .where(F.col("c").isNotNull())
        .groupBy("entity", "c.k", "c.s", "c.ns")
        .agg(F.count(F.lit(1)).alias("cnt"), F.max("traj_len").alias("L"), F.max("n_traj").alias("T"), F.sum("value").alias("value"))
    )
    rewards = [F.coalesce(F.sum(F.when((F.col("k") == 3) & (F.col("s") == s), F.col("value"))), F.lit(0.0)) for s in range(N_STATES)] if value_col else []
    grouped = cells.groupBy("entity").agg(
        F.max("L").alias("traj_len"),
        F.max("T").alias("n_traj"),
        F.collect_list(F.when(F.col("k") < 3, F.struct("k", "s", "ns", "cnt"))).alias("cells"),
        *([F.array(*rewards).alias("r")] if value_col else []),
    )
    return grouped.select("entity", "traj_len", "n_traj", "cells", *(["r"] if value_col else []))
