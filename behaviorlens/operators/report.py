"""Group comparison tables over per-entity rewards and weights (O-A1..A11).

Rewards are kept long, ``(entity, pair, reward)``; every statistic is a
partial aggregation (avg, sample stddev, count), so a group holding a third
of all entities still splits across all map tasks.  Dimension tables are
literal and fixed in size (16 pairs), hence safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ACTION_NAMES, FEATURE_NAMES, PANEL_P, PANEL_TN, STATE_NAMES


def parse_array_text(c: Column) -> Column:
    """Array text such as ``[ 0.  1.3e-01\\n -2.]`` to ``array<double>`` (O-A1):
    drop the first and last character, split on whitespace, cast."""
    body = F.substring(c, F.lit(2), F.char_length(c) - 2)
    parts = F.split(F.trim(F.regexp_replace(body, r"\s+", " ")), " ")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast("double"))


def format_array_text(c: Column) -> Column:
    """Space-separated array text in brackets, the reverse of ``parse_array_text``."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), " "), F.lit("]"))


def rewards_long(df: DataFrame, r_col: str = "r", keep: list[str] | None = None) -> DataFrame:
    """16 named rewards per entity in long form (O-A2): ``pair`` is
    ``n_nt, n_rp, ..., t_tw`` in state order."""
    names = F.array(*[F.lit(n) for n in STATE_NAMES])
    keep = keep or [c for c in df.columns if c != r_col]
    return df.select(*keep, F.posexplode(F.col(r_col)).alias("state", "reward")).withColumn(
        "pair", F.element_at(names, F.col("state") + 1)
    )


def weights_long(df: DataFrame, w_col: str = "w", keep: list[str] | None = None) -> DataFrame:
    """6 named weights per entity in long form (O-A3), order t, p+, p-, tw, rt, rp."""
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    keep = keep or [c for c in df.columns if c != w_col]
    return df.select(*keep, F.posexplode(F.col(w_col)).alias("ordinal", "weight")).withColumn(
        "feature", F.element_at(names, F.col("ordinal") + 1)
    )


def group_counts(df: DataFrame, group: str = "user_type") -> DataFrame:
    """Entities per group (O-A4)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def pair_stats(long: DataFrame, group: str = "user_type", value: str = "reward", key: str = "pair") -> DataFrame:
    """Mean and standard error (sample std / sqrt(n), NULL for n = 1) per
    group and key (O-A5, O-A6)."""
    return long.groupBy(group, key).agg(
        F.count(F.col(value)).alias("n"),
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(F.col(value)))).alias("stderr"),
    )


def panel_dimension(spark: SparkSession) -> DataFrame:
    """16-row dimension (pair, panel, rank) of the two report panels (O-A7)."""
    rows = [(p, "tn", i) for i, p in enumerate(PANEL_TN)] + [(p, "p", i) for i, p in enumerate(PANEL_P)]
    return spark.createDataFrame(rows, "pair string, panel string, rank int")


def panels(stats: DataFrame) -> DataFrame:
    """Statistics in panel order; fixed 16-row dimension joined by broadcast."""
    dim = panel_dimension(stats.sparkSession)
    return stats.join(F.broadcast(dim), "pair")


def round_half_even(c: Column, digits: int) -> Column:
    """Array-library rounding: scale, round half to even on the double, unscale.
    (``bround`` rounds the exact decimal value instead and differs on halves
    that binary doubles cannot hold.)"""
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def heatmap(stats: DataFrame, group: str = "user_type", digits: int = 3) -> DataFrame:
    """State, action and mean rounded half-to-even (O-A8); the pair name is
    split on ``_``."""
    parts = F.split(F.col("pair"), "_")
    return stats.select(
        group,
        F.get(parts, 0).alias("State"),
        F.get(parts, 1).alias("Action"),
        round_half_even(F.col("mean"), digits).alias("mean"),
    )


def pivot(heat: DataFrame, group: str = "user_type") -> DataFrame:
    """State x action table of means (O-A9), by conditional aggregates."""
    each = [F.max(F.when(F.col("Action") == a, F.col("mean"))).alias(a) for a in ACTION_NAMES]
    return heat.groupBy(group, "State").agg(*each).orderBy(group, "State")


def weight_means(wlong: DataFrame, group: str = "user_type", closed: bool = True) -> DataFrame:
    """Mean weight per feature and group (O-A10); with ``closed`` the first
    feature is repeated at ordinal 6 to close the polygon."""
    if closed:
        # the first feature's rows count twice, once more at the closing ordinal
        repeat = F.when(F.col("ordinal") == 0, F.array(F.lit(0), F.lit(len(FEATURE_NAMES)))).otherwise(
            F.array(F.col("ordinal"))
        )
        wlong = wlong.withColumn("ordinal", F.explode(repeat))
    return wlong.groupBy(group, "ordinal", "feature").agg(F.avg("weight").alias("mean"))


def reverse_columns(df: DataFrame) -> DataFrame:
    """Columns in reverse order (O-A11)."""
    return df.select(*reversed(df.columns))


def rewards_wide(df: DataFrame, r_col: str = "r") -> DataFrame:
    """16 named reward columns (O-A2 wide form)."""
    keep = [c for c in df.columns if c != r_col]
    return df.select(*keep, *[F.get(F.col(r_col), s).alias(n) for s, n in enumerate(STATE_NAMES)])


def weights_wide(df: DataFrame, w_col: str = "w") -> DataFrame:
    """6 named weight columns (O-A3 wide form)."""
    keep = [c for c in df.columns if c != w_col]
    return df.select(*keep, *[F.get(F.col(w_col), i).alias(n) for i, n in enumerate(FEATURE_NAMES)])

