"""Registered queries of the decision-model stage (M1-M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rewards, transitions
from ..session import stored
from . import behavior


def model(spark, sf_dir, modulo=None) -> DataFrame:
    return transitions.model_table(behavior.pairs(spark, sf_dir, modulo=modulo))


def model_with_rewards(spark, sf_dir) -> DataFrame:
    """Model table with rewards from the events: per state the sum of
    ``value``; model and rewards come from one pass over the pairs."""
    return transitions.model_table(behavior.pairs(spark, sf_dir, extra=["value"]), value_col="value")


def data_rewards(spark, sf_dir, modulo=None) -> DataFrame:
    """Deterministic rewards from the events: per state the sum of ``value``."""
    return rewards.event_rewards(behavior.pairs(spark, sf_dir, modulo=modulo, extra=["value"]))


def fitted(spark, sf_dir) -> DataFrame:
    r = rewards.fit_rewards(model(spark, sf_dir))
    return r.withColumn("w", rewards.weights_from_rewards(F.col("r")))


def q_reward_weights(spark, sf_dir):
    return fitted(spark, sf_dir)


def q_reward_residual(spark, sf_dir):
    """Largest distance of a recovered reward from F w; NULL without accounts."""
    f = fitted(spark, sf_dir)
    res = f.select(rewards.reward_residual(F.col("r"), F.col("w")).alias("x"))
    return res.agg(F.round(F.max("x"), 6).alias("max_residual"))


def q_optimal_values(spark, sf_dir):
    values = rewards.optimal_value_table(model_with_rewards(spark, sf_dir))
    return values.withColumn("value", F.round("value", 6))


def q_policy(spark, sf_dir):
    return rewards.policy_table(model_with_rewards(spark, sf_dir)).withColumn("p", F.round("p", 6))


def q_greedy_policy(spark, sf_dir):
    return rewards.greedy_policy_table(model_with_rewards(spark, sf_dir))


def q_policy_value(spark, sf_dir):
    return rewards.policy_value_table(model_with_rewards(spark, sf_dir)).withColumn("value", F.round("value", 6))


def q_value_difference(spark, sf_dir):
    m = stored(model_with_rewards(spark, sf_dir).withColumnRenamed("r", "true_r"))
    recovered = rewards.fit_rewards(m, checkpoint=True)  # solver output feeds a second kernel job
    return rewards.value_difference_table(m.join(recovered, "entity"))


def q_value_difference_data(spark, sf_dir):
    """Value lost on the data's rewards by acting greedily on their negative."""
    m = model_with_rewards(spark, sf_dir).withColumnRenamed("r", "true_r")
    opposite = m.withColumn("r", F.transform("true_r", lambda x: -x))
    return rewards.value_difference_table(opposite).withColumn("evd", F.round("evd", 6))


def q_expected_visitation(spark, sf_dir):
    m = model(spark, sf_dir).withColumn("r", F.array_repeat(F.lit(0.0), 16))
    svf = rewards.expected_visitation_table(m, policy_name="uniform")
    return svf.select("entity", "state", F.round("svf", 6).alias("svf"))


def q_expected_visitation_optimal(spark, sf_dir):
    """Under the soft policy of the data's rewards."""
    svf = rewards.expected_visitation_table(model_with_rewards(spark, sf_dir), policy_name="optimal")
    return svf.select("entity", "state", F.round("svf", 6).alias("svf"))


# The solver where SQL can follow it: start weights and step given, two epochs.
STEP_START = [0.6, -0.3, 0.2, 0.5, 0.1, 0.4]
STEP_RATE = 0.5
STEP_EPOCHS = 2


def q_reward_steps(spark, sf_dir):
    m = model(spark, sf_dir).withColumn("alpha0", F.array(*map(F.lit, STEP_START)))
    r = rewards.fit_rewards(m, epochs=STEP_EPOCHS, learning_rate=STEP_RATE)
    return r.select("entity", F.posexplode("r").alias("state", "reward")).withColumn("reward", F.round("reward", 6))


CERTIFIED_EPOCHS = 100


def q_reward_step_errors(spark, sf_dir):
    """The solver's step behind ``CERTIFIED_EPOCHS`` epochs against its
    gradient."""
    out = rewards.step_errors(model(spark, sf_dir), CERTIFIED_EPOCHS)
    return out.withColumn("error", F.round("error", 6))


QUERIES = {
    "reward_weights": q_reward_weights,
    "reward_residual": q_reward_residual,
    "optimal_values": q_optimal_values,
    "policy": q_policy,
    "greedy_policy": q_greedy_policy,
    "policy_value": q_policy_value,
    "value_difference": q_value_difference,
    "value_difference_data": q_value_difference_data,
    "expected_visitation": q_expected_visitation,
    "expected_visitation_optimal": q_expected_visitation_optimal,
    "reward_steps": q_reward_steps,
    "reward_step_errors": q_reward_step_errors,
}
