"""Registered queries over the shared tables: timelines, pairs, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, stance_tables, trajectories, transitions
from ..sources import files, fixtures
from . import text

# thresholds high enough that some entities fail at sf0.01
STRICT_ACTIVE = 33
STRICT_PASSIVE = 33
LONG_MODULO = 5  # entity = user_id % 5 gives sequences longer than 100


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "events")


def timeline(spark: SparkSession, sf_dir: str, modulo: int | None = None, extra=None) -> DataFrame:
    return fixtures.timeline_from_events(events(spark, sf_dir), modulo, extra)


def pairs(spark: SparkSession, sf_dir: str, rule: str = "reference", modulo: int | None = None, extra=None, **kw) -> DataFrame:
    return trajectories.state_action_pairs(timeline(spark, sf_dir, modulo, extra), action_rule=rule, **kw)


NULLABLE_COUNTERS = ["followers", "friends", "favourites", "retweet_count", "tweet_likes", "reply"]


def q_event_timeline(spark, sf_dir):
    tables = fixtures.role_tables_from_events(events(spark, sf_dir))
    t = activity.build_timeline(tables)
    # counters that may be missing are reported as doubles (missing = NaN/NULL)
    return t.withColumns({c: F.col(c).cast("double") for c in NULLABLE_COUNTERS})


def q_routed_timeline(spark, sf_dir):
    """Raw posts routed to the roles of all accounts."""
    e = events(spark, sf_dir)
    accounts = e.select(F.col("user_id").cast("string").alias("name")).distinct()
    t = files.routed_timeline(fixtures.posts_from_events(e), accounts)
    return t.withColumns({c: F.col(c).cast("double") for c in NULLABLE_COUNTERS})


def q_scored_timeline(spark, sf_dir):
    """The same with each reply's stance from the score of its text by the
    exact-vocabulary model, joined by post."""
    e = events(spark, sf_dir)
    accounts = e.select(F.col("user_id").cast("string").alias("name")).distinct()
    posts = fixtures.posts_from_events(e)
    scores = stance_tables.score_posts(text.table_model(spark, sf_dir), fixtures.reply_texts(spark, sf_dir))
    t = files.routed_timeline(files.stance_by_score(posts, scores), accounts)
    return t.withColumns({c: F.col(c).cast("double") for c in NULLABLE_COUNTERS})


def q_parsed_times(spark, sf_dir):
    """Each event's time written in one of the forms and read again."""
    texts = fixtures.time_texts(events(spark, sf_dir))
    return texts.select("event_id", activity.time_format("created_at").alias("format"), activity.parse_time("created_at").alias("time"))


def q_entity_thresholds(spark, sf_dir):
    return activity.entity_thresholds(timeline(spark, sf_dir), STRICT_ACTIVE, STRICT_PASSIVE)


def q_active_entities(spark, sf_dir):
    return activity.active_entities(timeline(spark, sf_dir))


def _pair_columns(df: DataFrame) -> DataFrame:
    # -1 marks the last pair of an entity (no following pair)
    return df.select(
        "entity", "e", "activity", "base", "action", "state",
        F.coalesce(F.col("next_state"), F.lit(-1)).alias("next_state"),
    )


def q_state_action_pairs(spark, sf_dir):
    return _pair_columns(pairs(spark, sf_dir, "reference"))


def q_state_action_pairs_per_event(spark, sf_dir):
    return _pair_columns(pairs(spark, sf_dir, "per_event"))


def q_state_visits(spark, sf_dir):
    return trajectories.state_visits(pairs(spark, sf_dir))


def q_trajectories(spark, sf_dir):
    return trajectories.trajectory_summary(pairs(spark, sf_dir))


def q_trajectories_long(spark, sf_dir, modulo=LONG_MODULO):
    p = pairs(spark, sf_dir, modulo=modulo)
    return p.select(
        "entity", "e", "traj_id", "pos", "state", "action", F.col("kept").cast("int").alias("kept"),
    )


def q_transition_counts(spark, sf_dir):
    return transitions.transition_counts(pairs(spark, sf_dir))


def q_transition_probabilities(spark, sf_dir):
    t = transitions.transition_probabilities(pairs(spark, sf_dir))
    return t.select("entity", "state", "action", "next_state", "n", F.round("p", 9).alias("p"))


def q_start_distribution(spark, sf_dir, modulo=LONG_MODULO):
    return transitions.start_distribution(pairs(spark, sf_dir, modulo=modulo)).select(
        "entity", "state", F.round("p", 9).alias("p")
    )


def q_state_visitation_frequency(spark, sf_dir, modulo=LONG_MODULO):
    return transitions.state_visitation_frequency(pairs(spark, sf_dir, modulo=modulo)).select(
        "entity", "state", F.round("svf", 9).alias("svf")
    )


def q_feature_expectations(spark, sf_dir, modulo=LONG_MODULO):
    return transitions.feature_expectations(pairs(spark, sf_dir, modulo=modulo)).select(
        "entity", "feature", F.round("expectation", 9).alias("expectation")
    )


# Hot-entity splitting forced at test scale: every entity above SPLIT_HOT_ROWS
# events is cut into equi-depth time buckets of about SPLIT_BUCKET_ROWS; the
# result must equal the plain window's (same oracle SQL).
SPLIT_HOT_ROWS = 50
SPLIT_BUCKET_ROWS = 16


def q_trajectories_long_split(spark, sf_dir):
    p = pairs(spark, sf_dir, modulo=LONG_MODULO, hot_rows=SPLIT_HOT_ROWS, rows_per_bucket=SPLIT_BUCKET_ROWS)
    return p.select(
        "entity", "e", "traj_id", "pos", "state", "action", F.col("kept").cast("int").alias("kept"),
    )


def q_transition_counts_split(spark, sf_dir):
    p = pairs(spark, sf_dir, modulo=LONG_MODULO, hot_rows=SPLIT_HOT_ROWS, rows_per_bucket=SPLIT_BUCKET_ROWS)
    return transitions.transition_counts(p)


def per_account(query):
    """A query of the merged accounts over the real ones."""
    return lambda spark, sf_dir: query(spark, sf_dir, modulo=None)


QUERIES = {
    "event_timeline": q_event_timeline,
    "routed_timeline": q_routed_timeline,
    "scored_timeline": q_scored_timeline,
    "parsed_times": q_parsed_times,
    "entity_thresholds": q_entity_thresholds,
    "active_entities": q_active_entities,
    "state_action_pairs": q_state_action_pairs,
    "state_action_pairs_per_event": q_state_action_pairs_per_event,
    "state_visits": q_state_visits,
    "trajectories": q_trajectories,
    "trajectories_long": q_trajectories_long,
    "transition_counts": q_transition_counts,
    "transition_probabilities": q_transition_probabilities,
    "start_distribution": q_start_distribution,
    "state_visitation_frequency": q_state_visitation_frequency,
    "feature_expectations": q_feature_expectations,
    "trajectories_accounts": per_account(q_trajectories_long),
    "start_distribution_accounts": per_account(q_start_distribution),
    "state_visitation_accounts": per_account(q_state_visitation_frequency),
    "feature_expectations_accounts": per_account(q_feature_expectations),
    "trajectories_long_split": q_trajectories_long_split,
    "transition_counts_split": q_transition_counts_split,
}
