"""Policies, visitation and gradients of solved accounts (M3, M4, M6) as column
expressions over the bounded model row (at most 304 cells, 16 values).

Only action ``s % 4`` is ever seen in state ``s``, so the transition tensor is a
16 x 16 matrix and the Q values of a state are one number and three zeros.
State values come from the sweeps (``rewards.with_values``); what follows is
arrays of 16 and runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DISCOUNT, FEATURE_MATRIX, N_ACTIONS, N_STATES

STATES = range(N_STATES)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, bound by a transform of one
    element; a column named inside a lambda is computed at each of its turns."""
    return F.get(F.transform(F.array(value), use), 0)


def _counts(cells: Column, kind: int) -> Column:
    """Counts of one kind of cell by state, 0 where there is none."""
    own = F.map_from_entries(F.transform(F.filter(cells, lambda c: c["k"] == kind), lambda c: F.struct(c["s"], c["cnt"].cast("double"))))
    return F.transform(F.array(*map(F.lit, STATES)), lambda s: F.coalesce(F.element_at(own, s), F.lit(0.0)))


def transition_matrix(cells: Column) -> Column:
    """16 rows of 16 probabilities; rows never seen are zero."""
    places = F.transform(F.filter(cells, lambda c: c["k"] == 0), lambda c: F.struct((c["s"] * N_STATES + c["ns"]).alias("at"), c["cnt"].cast("double").alias("cnt")))
    own = F.map_from_entries(places)
    flat = F.transform(F.sequence(F.lit(0), F.lit(N_STATES**2 - 1)), lambda i: F.coalesce(F.element_at(own, i), F.lit(0.0)))
    shares = _once(flat, lambda f: F.transform(F.array(*map(F.lit, STATES)), lambda s: _once(F.slice(f, s * N_STATES + 1, N_STATES), _shares)))
    return shares


def _shares(row: Column) -> Column:
    return _once(_sum(row), lambda total: F.transform(row, lambda x: F.when(total > 0, x / total).otherwise(0.0)))


def model_columns(model: DataFrame) -> DataFrame:
    """A model table with ``p`` (transitions), ``p0`` (start distribution) and
    ``fe`` (feature expectations) in place of its cells."""
    per = F.greatest(F.col("n_traj"), F.lit(1)).cast("double")
    wide = model.withColumns({"_matrix": transition_matrix(F.col("cells")), "_starts": _counts(F.col("cells"), 1), "_visits": _counts(F.col("cells"), 2)})
    return wide.withColumns({"p": F.col("_matrix"), "p0": F.transform("_starts", lambda x: x / per), "fe": F.transform(features(F.col("_visits")), lambda x: x / per)}).drop("cells", "_matrix", "_starts", "_visits")


def features(by_state: Column) -> Column:
    """F^T x: the sum over the states of each feature."""
    return F.array(*[sum((F.get(by_state, s) for s in STATES if FEATURE_MATRIX[s][i]), F.lit(0.0)) for i in range(len(FEATURE_MATRIX[0]))])


def rewards_of(weights: Column) -> Column:
    """F w for every state."""
    return F.array(*[sum((F.get(weights, i) for i, bit in enumerate(FEATURE_MATRIX[s]) if bit), F.lit(0.0)) for s in STATES])


def q_seen(discount: float = DISCOUNT) -> Column:
    """Q of the seen action of each state, from columns p, r and v."""
    gain = F.zip_with("r", "v", lambda r, v: r + discount * v)
    return F.transform(F.array(gain), lambda g: F.transform("p", lambda row: dot(row, g)))[0]


def action_probability(q: Column, seen: Column) -> Column:
    """Soft-max share of an action among the seen one's Q and three zeros."""
    top = F.greatest(q, F.lit(0.0))
    others = (N_ACTIONS - 1) * F.exp(-top)
    return F.when(seen, F.exp(q - top)).otherwise(F.exp(-top)) / (F.exp(q - top) + others)


def _by_state(solved: DataFrame) -> DataFrame:
    q = model_columns(solved).select("entity", q_seen().alias("q"))
    return q.select("entity", F.posexplode("q").alias("state", "q"))


def policy_table(solved: DataFrame) -> DataFrame:
    """(entity, state, action, p) of accounts with values (M3)."""
    own = F.col("state") % N_ACTIONS
    each = _by_state(solved).select("entity", "state", "q", F.explode(F.array(*map(F.lit, range(N_ACTIONS)))).alias("action"))
    return each.select("entity", "state", "action", action_probability(F.col("q"), F.col("action") == own).alias("p"))


def greedy_policy_table(solved: DataFrame) -> DataFrame:
    """(entity, state, action): the action of the largest Q, ties to the lowest
    (M4)."""
    own = F.col("state") % N_ACTIONS
    best = F.when((F.col("q") > 0) | ((F.col("q") == 0) & (own == 0)), own).when(own == 0, 1).otherwise(0)
    return _by_state(solved).select("entity", "state", best.cast("int").alias("action"))


def visitation(share: Column) -> Column:
    """Expected visits of each state in ``traj_len`` steps (M6), from columns
    p and p0 and the share of each state's seen action: D_0 = p0, D_t the
    product of D_(t-1) with the shared transitions.  Only the states that the
    account leaves, enters or starts in take part; the others have 0."""
    steps = F.when(F.col("traj_len") > 1, F.sequence(F.lit(1), F.col("traj_len").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    states = F.array(*map(F.lit, STATES))

    def moved(state: Column, columns: Column) -> Column:
        now = F.transform(columns, lambda column: dot(column, state["d"]))
        return F.get(F.transform(F.array(now), lambda d: F.struct(d.alias("d"), F.zip_with(state["sum"], d, lambda a, b: a + b).alias("sum"))), 0)

    def own(g: Column) -> Column:
        left = lambda s: F.exists(F.get(g["p"], s), lambda x: x != 0)
        entered = lambda s: F.exists(g["p"], lambda row: F.get(row, s) != 0)
        return F.filter(states, lambda s: (F.get(g["p0"], s) != 0) | left(s) | entered(s))

    def into(g: Column, kept: Column) -> Column:
        return F.transform(kept, lambda k: F.transform(kept, lambda i: F.get(g["share"], i) * F.get(F.get(g["p"], i), k)))

    def summed(g: Column, kept: Column) -> Column:
        start = _once(F.transform(kept, lambda s: F.get(g["p0"], s)), lambda d: F.struct(d.alias("d"), d.alias("sum")))
        return _once(into(g, kept), lambda columns: F.aggregate(steps, start, lambda state, _: moved(state, columns)))["sum"]

    def by_state(kept: Column, sums: Column) -> Column:
        return F.transform(states, lambda s: F.coalesce(F.get(sums, F.array_position(kept, s).cast("int") - 1), F.lit(0.0)))

    given = F.struct(share.alias("share"), F.col("p").alias("p"), F.col("p0").alias("p0"))
    return _once(given, lambda g: _once(own(g), lambda kept: _once(summed(g, kept), lambda sums: by_state(kept, sums))))


def _seen_share() -> Column:
    return F.transform(q_seen(), lambda q: action_probability(q, F.lit(True)))


def visitation_table(model: DataFrame, policy: str = "uniform") -> DataFrame:
    """(entity, state, svf) under the uniform policy, or under the soft policy
    of accounts with values (``policy`` = optimal)."""
    wide = model_columns(model)
    uniform = F.array_repeat(F.lit(1.0 / N_ACTIONS), N_STATES)
    shares = wide.withColumn("_share", uniform if policy == "uniform" else _seen_share())
    return shares.select("entity", F.posexplode(visitation(F.col("_share"))).alias("state", "svf"))


def gradient_table(solved: DataFrame) -> DataFrame:
    """(entity, r, gradient): fe - F^T svf under the soft policy of the rewards
    ``r``, the direction in which the solver moves its weights."""
    wide = model_columns(solved).withColumn("_share", _seen_share())
    svf = wide.select("entity", "r", "fe", visitation(F.col("_share")).alias("svf"))
    return svf.select("entity", "r", F.zip_with("fe", features(F.col("svf")), lambda a, b: a - b).alias("gradient"))
