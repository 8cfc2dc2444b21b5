"""Registered report queries (O-A1..A11) on rewards derived from the events.

The rewards here are deterministic (per state the sum of event ``value``), so
the group statistics are checkable against SQL; the same operators run on the
solver output (``reward_weights``) unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report, rewards
from ..schema import STATE_NAMES
from . import models


def user_type(entity: str = "entity"):
    """Two groups of accounts: even ids 'bots', odd ids 'users'."""
    return F.when(F.col(entity).cast("long") % 2 == 0, F.lit("bots")).otherwise(F.lit("users"))


def results(spark, sf_dir) -> DataFrame:
    """(entity, user_type, r, w) like the solver's result table."""
    r = models.data_rewards(spark, sf_dir)
    return r.select("entity", user_type().alias("user_type"), "r", rewards.weights_from_rewards(F.col("r")).alias("w"))


def _stats(spark, sf_dir) -> DataFrame:
    long = report.rewards_long(results(spark, sf_dir).drop("w"))
    return report.pair_stats(long)


def _r6(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def q_reward_group_counts(spark, sf_dir):
    return report.group_counts(results(spark, sf_dir))


def q_reward_means(spark, sf_dir):
    return _r6(_stats(spark, sf_dir), ["mean", "stderr"])


def q_reward_panels(spark, sf_dir):
    p = report.panels(_stats(spark, sf_dir))
    return _r6(p.select("user_type", "panel", "rank", "pair", "mean", "stderr"), ["mean", "stderr"])


def _exact_stats(spark, sf_dir) -> DataFrame:
    """Group means from decimal rewards: means of values with two decimals
    often sit exactly on a rounding half; decimal sums (ten digits behind the
    point) make them independent of summation order before the 3-digit
    rounding."""
    long = report.rewards_long(results(spark, sf_dir).drop("w"))
    exact = long.withColumn("reward", F.col("reward").cast("decimal(24,10)"))
    return report.pair_stats(exact).withColumn("mean", F.col("mean").cast("double"))


def q_reward_heatmap(spark, sf_dir):
    return report.heatmap(_exact_stats(spark, sf_dir))


def q_reward_pivot(spark, sf_dir):
    return report.pivot(report.heatmap(_exact_stats(spark, sf_dir)))


def q_weight_means(spark, sf_dir):
    w = report.weights_long(results(spark, sf_dir).drop("r"))
    return _r6(report.weight_means(w), ["mean"])


def q_reward_table_reversed(spark, sf_dir):
    wide = report.rewards_wide(results(spark, sf_dir).select("entity", "r"))
    return _r6(report.reverse_columns(wide), STATE_NAMES)


def q_array_text_parse(spark, sf_dir):
    """Rewards written as array text and parsed back, long form."""
    text = results(spark, sf_dir).select("entity", report.format_array_text(F.col("r")).alias("r_text"))
    parsed = text.select("entity", report.parse_array_text(F.col("r_text")).alias("r"))
    return parsed.select("entity", F.posexplode("r").alias("idx", "value")).select(
        "entity", F.col("idx").cast("int").alias("idx"), F.round("value", 6).alias("value")
    )


QUERIES = {
    "reward_group_counts": q_reward_group_counts,
    "reward_means": q_reward_means,
    "reward_panels": q_reward_panels,
    "reward_heatmap": q_reward_heatmap,
    "reward_pivot": q_reward_pivot,
    "weight_means": q_weight_means,
    "reward_table_reversed": q_reward_table_reversed,
    "array_text_parse": q_array_text_parse,
}
