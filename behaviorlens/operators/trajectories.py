"""Event timeline to (state, action) pairs and trajectories.

For the events e = 0..N-1 of one entity, event e emits one pair for
e <= N-2.  The base situation comes from the event itself, the action from
the event (or, for passive events, from the next event's post counter).  All
of it is row-local once the row index, the first activity and the next two
rows are known, which ``EntitySequence`` provides without a per-entity task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (
    ACTION_NT,
    ACTION_RP,
    ACTION_RT,
    ACTION_TW,
    ACTIVE_THRESHOLD,
    BASE_N,
    BASE_PNEG,
    BASE_PPOS,
    BASE_T,
    DEFAULT_TRAJECTORY_LENGTH,
    FEATURE_MATRIX,
    N_STATES,
    PASSIVE_THRESHOLD,
)
from .sequence import DEFAULT_HOT_ROWS, DEFAULT_ROWS_PER_BUCKET, EntitySequence

ACTION_RULES = ("reference", "per_event")


def base_code(activity: Column) -> Column:
    """Base situation of an event (J1): got reposted -> t, supporting reply or
    mention -> p+, opposing reply -> p-, own activity -> n."""
    return (
        F.when(activity == 5, BASE_T)
        .when(activity.isin(6, 8), BASE_PPOS)
        .when(activity.isin(7, 9), BASE_PNEG)
        .otherwise(BASE_N)
    )


def direct_action(activity: Column, first_activity: Column, rule: str) -> Column:
    """Action read from the event (J2); NULL when the event carries none.

    ``reference``: an original post is tw; any other event repeats the
    repost/reply action of the entity's *first* event.  ``per_event``: the
    event's own activity decides."""
    if rule not in ACTION_RULES:
        raise ValueError(f"action_rule must be one of {ACTION_RULES}")
    decider = first_activity if rule == "reference" else activity
    return (
        F.when(activity == 1, ACTION_TW)
        .when(decider == 2, ACTION_RT)
        .when(decider.isin(3, 4), ACTION_RP)
        .otherwise(F.lit(None).cast("int"))
    )


def action_code(activity: Column, first_activity: Column, statuses: Column, next_statuses: Column, rule: str) -> Column:
    """Direct action, else tw when the post counter grew by the next event,
    else nt (J2 + J3).  Missing counters give nt."""
    inferred = F.when((next_statuses - statuses) > 0, ACTION_TW).otherwise(ACTION_NT)
    return F.coalesce(direct_action(activity, first_activity, rule), inferred)


def feature_lookup(state: Column, feature: int) -> Column:
    """Feature ``feature`` of a state from the constant matrix."""
    values = [FEATURE_MATRIX[s][feature] for s in range(N_STATES)]
    return F.element_at(F.array(*[F.lit(v) for v in values]), state + 1)


def state_action_pairs(
    timeline: DataFrame,
    action_rule: str = "reference",
    t_active: int = ACTIVE_THRESHOLD,
    t_passive: int = PASSIVE_THRESHOLD,
    default_length: int = DEFAULT_TRAJECTORY_LENGTH,
    hot_rows: int | None = DEFAULT_HOT_ROWS,
    rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
    heavy: list[tuple[str, int]] | None = None,
) -> DataFrame:
    """One row per emitted pair of each entity that passes the thresholds.

    Columns added to the timeline row of event e: ``e``, ``n``, ``base``,
    ``action``, ``state`` (= 4*base + action), ``next_state`` (state of pair
    e+1, NULL for the last pair), ``traj_len`` (L), ``n_traj`` (T),
    ``traj_id``, ``pos`` and ``kept`` (pair lies in a complete trajectory).  ``heavy``
    lists (entity, rows) of entities to split; without it a sketch finds them."""
    seq = EntitySequence(timeline, hot_rows=hot_rows, rows_per_bucket=rows_per_bucket, heavy=heavy)
    x = seq.annotate(
        first=["activity"],
        ahead={"activity": 1, "statuses": 2},
        counts={"n_active": F.col("kind") == "a", "n_passive": F.col("kind") == "p"},
    )
    x = x.where((F.col("n_active") > t_active) & (F.col("n_passive") > t_passive))
    x = x.where(F.col("e") <= F.col("n") - 2)
    fa = F.col("first_activity")
    base = base_code(F.col("activity"))
    action = action_code(F.col("activity"), fa, F.col("statuses"), F.col("next1_statuses"), action_rule)
    nxt_base = base_code(F.col("next1_activity"))
    nxt_action = action_code(F.col("next1_activity"), fa, F.col("next1_statuses"), F.col("next2_statuses"), action_rule)
    length = F.when(F.col("n") > default_length, F.lit(default_length)).otherwise(F.col("n") - 1).cast("long")
    x = x.withColumns(
        {
            "base": base.cast("int"),
            "action": action.cast("int"),
            "traj_len": length,
        }
    )
    x = x.withColumns(
        {
            "state": (F.col("base") * 4 + F.col("action")).cast("int"),
            "next_state": F.when(F.col("e") <= F.col("n") - 3, nxt_base * 4 + nxt_action).cast("int"),
            "n_traj": F.floor((F.col("n") - 1) / F.col("traj_len")).cast("long"),
            "traj_id": F.floor(F.col("e") / F.col("traj_len")).cast("long"),
            "pos": (F.col("e") % F.col("traj_len")).cast("long"),
        }
    )
    x = x.withColumn("kept", F.col("traj_id") < F.col("n_traj"))
    return x.drop("first_activity", "next1_activity", "next1_statuses", "next2_statuses")


def state_visits(pairs: DataFrame) -> DataFrame:
    """Visits per state over all pairs, zero-filled to 16 states.

    One partial aggregation into 16 counters per entity, then unpivot: no
    join with a state dimension and no second shuffle."""
    wide = pairs.groupBy("entity").agg(
        *[F.count_if(F.col("state") == s).alias(f"s{s}") for s in range(N_STATES)]
    )
    long = wide.unpivot("entity", [f"s{s}" for s in range(N_STATES)], "state_key", "visits")
    return long.select(
        "entity",
        F.substring("state_key", 2, 3).cast("int").alias("state"),
        F.col("visits").cast("long").alias("visits"),
    )


def trajectory_summary(pairs: DataFrame) -> DataFrame:
    """Per entity: events N, trajectory length L, complete trajectories T,
    pairs inside them and pairs left over (J6)."""
    return pairs.groupBy("entity").agg(
        F.max("n").alias("n_events"),
        F.max("traj_len").alias("traj_len"),
        F.max("n_traj").alias("n_traj"),
        F.count_if(F.col("kept")).alias("kept_pairs"),
        F.count_if(~F.col("kept")).alias("rest_pairs"),
    )
