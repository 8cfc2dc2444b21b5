"""Per-entity decision-model operators (M1-M8) as one batched Spark job.

The model table (one bounded row per entity, see ``transitions.model_table``)
is solved with ``mapInArrow``: each Arrow batch of B entities becomes
(B, 16, 16) tensors and every step below is vectorised across entities.  No
entity is looped over in Python and nothing is collected to the driver.

Because only action ``s % 4`` is ever observed in state ``s``, the transition
tensor reduces to one 16-vector per state: ``P[s] = tp[s, s % 4, :]``; the
other three actions have all-zero rows and contribute 0 to every expectation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (
    DISCOUNT,
    EPOCHS,
    FEATURE_MATRIX,
    LEARNING_RATE,
    N_ACTIONS,
    N_STATES,
    PINV28,
    VALUE_THRESHOLD,
)
from ..session import default_parallelism, stored
from . import policy

F_MAT = np.asarray(FEATURE_MATRIX, dtype=float)  # (16, 6)
SEEN_ACTION = np.arange(N_STATES) % N_ACTIONS
KERNEL_CHUNK = 4096  # entities per tensor block inside one Arrow batch
ACCOUNTS_PER_TASK = 2000  # solver rows of one partition: some tens of seconds at the default epochs
GROUP_STATES = 8  # states of one solver group, unless an entity has more
BLOCK = 4  # steps of the expected visitation that are taken at once, a power of two


# --- dense model --------------------------------------------------------------
def dense_model(batch: pa.RecordBatch):
    """(tp (B,16,16), p0 (B,16), fe (B,6), L (B,)) from a model-table batch."""
    n = batch.num_rows
    cells = batch.column(batch.schema.get_field_index("cells"))
    parent = pc.list_parent_indices(cells).to_numpy()
    flat = pc.list_flatten(cells)
    k = flat.field("k").to_numpy(zero_copy_only=False)
    s = flat.field("s").to_numpy(zero_copy_only=False)
    ns = flat.field("ns").to_numpy(zero_copy_only=False)
    cnt = flat.field("cnt").to_numpy(zero_copy_only=False).astype(float)
    t = batch.column(batch.schema.get_field_index("n_traj")).to_numpy(zero_copy_only=False).astype(float)
    length = batch.column(batch.schema.get_field_index("traj_len")).to_numpy(zero_copy_only=False).astype(int)
    tp = np.zeros((n, N_STATES, N_STATES))
    p0 = np.zeros((n, N_STATES))
    visits = np.zeros((n, N_STATES))
    m = k == 0
    np.add.at(tp, (parent[m], s[m], ns[m]), cnt[m])
    m = k == 1
    np.add.at(p0, (parent[m], s[m]), cnt[m])
    m = k == 2
    np.add.at(visits, (parent[m], s[m]), cnt[m])
    tot = tp.sum(axis=2, keepdims=True)
    tp = np.divide(tp, tot, out=np.zeros_like(tp), where=tot > 0)
    t = np.where(t > 0, t, 1.0)
    p0 = p0 / t[:, None]
    fe = visits @ F_MAT / t[:, None]
    return tp, p0, fe, length


# --- value iteration ------------------------------------------------------------
def _coefficients(tp: np.ndarray, r: np.ndarray, discount: float) -> np.ndarray:
    """Rows of the sweeps in state-major layout (S states, S + 1, B): discount * P
    and, as the last one, P . r."""
    b, n, _ = tp.shape
    g = np.empty((n, n + 1, b))
    np.multiply(tp.transpose(1, 2, 0), discount, out=g[:, :n])
    g[:, n] = np.einsum("bsk,bk->sb", tp, r)
    return g


def _sweeps(g: np.ndarray, gate: np.ndarray | None, threshold: float, states=None) -> np.ndarray:
    """In-place (Gauss-Seidel) sweeps over the states in order, vectorised over
    entities; values in layout (S, B).

    ``g`` holds ``_coefficients``.  Each state's new value is
    ``max(0, pr[s] + gpt[s] . v)`` (``gate`` None: optimal value, unseen actions
    contribute 0) or ``gate[s] * (pr[s] + gpt[s] . v)`` (fixed policy).  An
    entity stops after the first sweep whose largest change is <= threshold.

    P . r rides along as a last coefficient row against a constant 1 in the
    value vector, so one contraction per state gives ``pr[s] + gpt[s] . v``.
    ``states`` lists the states with a non-zero row somewhere in the batch;
    the others keep value 0 (max(0, 0)) and are not swept."""
    n, _, b = g.shape
    states = range(n) if states is None else states
    v = np.zeros((n + 1, b))
    v[n] = 1.0
    work = np.arange(b)  # columns being swept; compacted when half have converged
    gs = gate
    vv = v
    live = np.ones(b, dtype=bool)  # within the working set
    buf = np.empty(b)
    while True:
        before = vv[:n].copy()
        for s in states:
            np.einsum("kb,kb->b", g[s], vv, out=buf)
            if gs is None:
                np.maximum(buf, 0.0, out=vv[s])
            else:
                np.multiply(buf, gs[s], out=vv[s])
        diff = np.abs(vv[:n] - before).max(axis=0)
        if not live.all():  # converged earlier: undo this sweep for them
            done = ~live
            vv[:n, done] = before[:, done]
        live &= diff > threshold
        n_live = int(live.sum())
        if n_live == 0:
            break
        if n_live * 2 <= live.size:  # compact the working set
            if vv is not v:
                v[:, work] = vv
            work = work[live]
            g = g[:, :, live]
            gs = None if gs is None else gs[:, live]
            vv = v[:, work]
            live = np.ones(work.size, dtype=bool)
            buf = np.empty(work.size)
    if vv is not v:
        v[:, work] = vv
    return v[:n]


def swept_states(tp: np.ndarray) -> list[int]:
    """States whose transition row is non-zero for some entity of the batch."""
    return np.flatnonzero(tp.any(axis=(0, 2))).tolist()


def optimal_values(tp: np.ndarray, r: np.ndarray, discount: float = DISCOUNT, threshold: float = VALUE_THRESHOLD) -> np.ndarray:
    """Optimal state values by in-place sweeps over states 0..15 (M2).

    v[s] = max over actions of tp[s, a] . (r + discount * v); unseen actions
    give 0, so v[s] = max(0, P[s] . (r + discount * v))."""
    return np.ascontiguousarray(_sweeps(_coefficients(tp, r, discount), None, threshold, swept_states(tp)).T)


def q_values(tp: np.ndarray, r: np.ndarray, v: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """Q (B,16,4): tp[s,a] . (r + discount*v); zero for unseen actions."""
    q_seen = np.einsum("bsk,bk->bs", tp, r + discount * v)
    q = np.zeros(q_seen.shape + (N_ACTIONS,))
    q[:, np.arange(N_STATES), SEEN_ACTION] = q_seen
    return q


def stochastic_policy(tp, r, v, discount: float = DISCOUNT) -> np.ndarray:
    """Softmax over actions of Q, shifted by the row maximum (M3)."""
    q = q_values(tp, r, v, discount)
    q = q - q.max(axis=2, keepdims=True)
    e = np.exp(q)
    return e / e.sum(axis=2, keepdims=True)


def greedy_policy(tp, r, v, discount: float = DISCOUNT) -> np.ndarray:
    """Arg-max action per state, ties to the lowest action (M4)."""
    return np.argmax(q_values(tp, r, v, discount), axis=2)


def policy_values(tp, policy, r, discount: float = DISCOUNT, threshold: float = VALUE_THRESHOLD) -> np.ndarray:
    """Values of a deterministic policy by in-place sweeps (M5); a state whose
    policy action was never seen there has an all-zero row and value 0."""
    follows = np.ascontiguousarray((policy == SEEN_ACTION[None, :]).astype(float).T)  # (16, B)
    return np.ascontiguousarray(_sweeps(_coefficients(tp, r, discount), follows, threshold, swept_states(tp)).T)


def _summed_visits(m: np.ndarray, p0: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum of ``p0 m**t`` over t < length; ``m`` in layout (S, S, B), ``p0`` and
    the sums in (S, B).  The first ``length % BLOCK`` terms go one by one, the
    others by whole blocks: a block's sum moves on by ``m**BLOCK``."""

    def moved(d: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.einsum("ib,ikb->kb", d, by)

    blocks, rest = np.divmod(np.maximum(length, 1), BLOCK)
    total, d = np.zeros_like(p0), p0
    for t in range(BLOCK - 1):
        more = t < rest
        total += d * more
        d = np.where(more, moved(d, m), d)
    block = d
    for _ in range(BLOCK - 1):
        d = moved(d, m)
        block = block + d
    far = m
    for _ in range(BLOCK.bit_length() - 1):
        far = np.einsum("ijb,jkb->ikb", far, far)
    last = int(blocks.max(initial=0))
    for t in range(last):
        total += block * (t < blocks)
        if t + 1 < last:
            block = moved(block, far)
    return total


def expected_svf(tp, policy, p0, length) -> np.ndarray:
    """Expected state visitation summed over L steps (M6): D0 = p0,
    D_t = D_{t-1} M with M[i, k] = sum_a policy[i, a] tp[i, a, k]."""
    seen = policy[:, np.arange(N_STATES), SEEN_ACTION]  # (B, 16)
    m = np.ascontiguousarray((seen[:, :, None] * tp).transpose(1, 2, 0))
    return np.ascontiguousarray(_summed_visits(m, np.ascontiguousarray(p0.T), length).T)


def state_groups(tp: np.ndarray, p0: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Entities that share a small set of states, as (entities, states).  A
    state counts for an entity that leaves, enters or starts in it; in the
    others it has value, start and visits 0.  Under the action rules few of the
    16 states go together.  Sets are united up to ``GROUP_STATES`` states."""
    used = tp.any(axis=2) | tp.any(axis=1) | (p0 != 0)
    codes, of = np.unique(used @ (1 << np.arange(N_STATES)), return_inverse=True)
    unions: list[int] = []
    group = np.zeros(len(codes), dtype=int)
    for i in sorted(range(len(codes)), key=lambda i: (-int(codes[i]).bit_count(), i)):
        code = int(codes[i])
        fits = (g for g, u in enumerate(unions) if (u | code).bit_count() <= max(code.bit_count(), GROUP_STATES))
        if (g := next(fits, None)) is None:
            g = len(unions)
            unions.append(0)
        unions[g] |= code
        group[i] = g
    return [(np.flatnonzero(group[of] == g), np.flatnonzero([u >> s & 1 for s in range(N_STATES)])) for g, u in enumerate(unions)]


def _ascend(tp, p0, fe, length, alpha, states, epochs, learning_rate, discount, threshold) -> np.ndarray:
    """Feature weights of entities whose model has only the given states, in
    state-major layout."""
    features = F_MAT[states]
    swept = swept_states(tp)
    p = np.ascontiguousarray(tp.transpose(1, 2, 0))  # (S, S, B)
    start = np.ascontiguousarray(p0.T)
    g = _coefficients(tp, np.zeros(p0.shape), discount)
    for _ in range(epochs):
        r = np.ascontiguousarray((alpha @ features.T).T)
        np.einsum("skb,kb->sb", p, r, out=g[:, -1])
        v = _sweeps(g, None, threshold, swept)
        q = np.einsum("skb,kb->sb", p, r + discount * v)
        top = np.maximum(q, 0.0)
        e = np.exp(q - top)
        seen = e / (e + (N_ACTIONS - 1) * np.exp(-top))  # unseen actions have Q 0
        svf = _summed_visits(p * seen[:, None, :], start, length)
        alpha = alpha + learning_rate * (fe - svf.T @ features)
    return alpha


def maxent_irl(tp, p0, fe, length, alpha0, epochs=EPOCHS, learning_rate=LEARNING_RATE, discount=DISCOUNT, threshold=VALUE_THRESHOLD):
    """Maximum-entropy IRL by gradient ascent on feature weights (M1).

    Each epoch: r = F alpha, optimal values, stochastic policy, expected
    visitation; grad = fe - F^T svf.  Returns (r, alpha).  Entities are solved
    in the groups of states that they visit."""
    alpha = alpha0.copy()
    for rows, states in state_groups(tp, p0):
        model = np.ascontiguousarray(tp[np.ix_(rows, states, states)])
        alpha[rows] = _ascend(model, p0[np.ix_(rows, states)], fe[rows], length[rows], alpha0[rows], states, epochs, learning_rate, discount, threshold)
    return alpha @ F_MAT.T, alpha


# --- Spark jobs -------------------------------------------------------------------
def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, KERNEL_CHUNK):
        yield batch.slice(start, KERNEL_CHUNK)


def _list_array(mat: np.ndarray) -> pa.Array:
    mat = np.ascontiguousarray(mat, dtype=float)
    return pa.FixedSizeListArray.from_arrays(pa.array(mat.reshape(-1)), mat.shape[1]).cast(pa.list_(pa.float64()))


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix, from its flat buffer."""
    return pc.list_flatten(batch.column(batch.schema.get_field_index(name))).to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def start_weights(entity: Column) -> Column:
    """Start weights of the solver: uniform in [0, 1), from a hash of the
    entity and the feature, so reruns and retried tasks agree."""
    unit = 2**53
    return F.array(*[F.pmod(F.xxhash64(entity, F.lit(i)), F.lit(unit)) / F.lit(float(unit)) for i in range(F_MAT.shape[1])])


def _spread(model: DataFrame) -> DataFrame:
    """Solver rows in partitions of at most ``ACCOUNTS_PER_TASK`` accounts and
    at least one for each core.  The table is small in bytes but heavy in CPU:
    a numbered round-robin exchange is neither dropped nor coalesced, and the
    stored rows give the count and spare a retry the work before."""
    rows = stored(model)
    accounts = rows.count()
    parts = max(min(accounts, default_parallelism(model.sparkSession)), -(-accounts // ACCOUNTS_PER_TASK), 1)
    return rows.repartition(parts)


def fit_rewards(
    model: DataFrame,
    epochs: int = EPOCHS,
    learning_rate: float = LEARNING_RATE,
    discount: float = DISCOUNT,
    checkpoint: bool = False,
) -> DataFrame:
    """Reward vector per entity: ``(entity, r array<double>)`` (M1).

    ``model`` may carry ``alpha0``, start weights of its own.  With
    ``checkpoint`` the result is stored in the shared checkpoint folder before
    it is returned, so later stages that lose an executor re-read it instead
    of re-running the solver."""
    if checkpoint:
        return stored(fit_rewards(model, epochs, learning_rate, discount))

    def run(batches):
        for big in batches:
            for batch in _chunks(big):
                if batch.num_rows == 0:
                    continue
                tp, p0, fe, length = dense_model(batch)
                alpha0 = _matrix(batch, "alpha0", F_MAT.shape[1])
                r, _ = maxent_irl(tp, p0, fe, length, alpha0, epochs, learning_rate, discount)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("entity")), _list_array(r)], names=["entity", "r"]
                )

    given = model if "alpha0" in model.columns else model.withColumn("alpha0", start_weights(F.col("entity")))
    return _spread(given).mapInArrow(run, "entity string, r array<double>")


def weights_from_rewards(r: Column) -> Column:
    """Least-squares feature weights of a reward vector (M7): the constant
    pseudo-inverse of the feature matrix applied as an array expression."""
    ws = []
    for row in PINV28:
        terms = [F.lit(float(c)) * F.get(r, s) for s, c in enumerate(row) if c != 0]
        acc = terms[0]
        for t in terms[1:]:
            acc = acc + t
        ws.append(acc / F.lit(28.0))
    return F.array(*ws)


def reward_residual(r: Column, w: Column) -> Column:
    """Largest |r - F w| of one entity."""
    diffs = []
    for s in range(N_STATES):
        fw = None
        for i, bit in enumerate(FEATURE_MATRIX[s]):
            if bit:
                fw = F.get(w, i) if fw is None else fw + F.get(w, i)
        fw = fw if fw is not None else F.lit(0.0)
        diffs.append(F.abs(F.get(r, s) - fw))
    return F.greatest(*diffs)


def _solve_job(model_with_rewards: DataFrame, kind: str, out_schema: str, discount: float = DISCOUNT) -> DataFrame:
    """Run one of the value/policy operators for every entity.  Input columns:
    model-table columns plus ``r`` (and ``true_r`` for ``evd``)."""

    def run(batches):
        for big in batches:
            for batch in _chunks(big):
                if batch.num_rows == 0:
                    continue
                tp, p0, _, length = dense_model(batch)
                ent = batch.column(batch.schema.get_field_index("entity"))
                r = _matrix(batch, "r", N_STATES)
                yield _emit(kind, ent, tp, p0, length, r, batch, discount)

    return _spread(model_with_rewards).mapInArrow(run, out_schema)


def _long_states(ent: pa.Array, values: np.ndarray, name: str) -> pa.RecordBatch:
    b = values.shape[0]
    idx = np.repeat(np.arange(b), N_STATES)
    return pa.RecordBatch.from_arrays(
        [ent.take(pa.array(idx)), pa.array(np.tile(np.arange(N_STATES, dtype=np.int32), b)), pa.array(values.reshape(-1))],
        names=["entity", "state", name],
    )


def _emit(kind, ent, tp, p0, length, r, batch, discount):
    if kind == "optimal_values":
        return _long_states(ent, optimal_values(tp, r, discount), "value")
    v = optimal_values(tp, r, discount)
    if kind == "policy_value":
        g = greedy_policy(tp, r, v, discount)
        return _long_states(ent, policy_values(tp, g, r, discount), "value")
    if kind == "evd":
        true_r = _matrix(batch, "true_r", N_STATES)
        pol = stochastic_policy(tp, r, v, discount)
        g = np.argmax(pol, axis=2)
        opt_true = optimal_values(tp, true_r, discount)
        val = policy_values(tp, g, true_r, discount)
        evd = np.einsum("bs,bs->b", opt_true, p0) - np.einsum("bs,bs->b", val, p0)
        return pa.RecordBatch.from_arrays([ent, pa.array(evd)], names=["entity", "evd"])
    raise ValueError(kind)


def optimal_value_table(model_r: DataFrame) -> DataFrame:
    return _solve_job(model_r, "optimal_values", "entity string, state int, value double")


def with_values(model_r: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """The model table with rewards and their optimal state values ``v``, which
    the columns of ``policy`` read."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in model_r.schema.fields)

    def run(batches):
        for big in batches:
            for batch in _chunks(big):
                if batch.num_rows == 0:
                    continue
                tp, *_ = dense_model(batch)
                v = optimal_values(tp, _matrix(batch, "r", N_STATES), discount)
                yield pa.RecordBatch.from_arrays([*batch.columns, _list_array(v)], names=[*batch.schema.names, "v"])

    return _spread(model_r).mapInArrow(run, f"{fields}, v array<double>")


def policy_table(model_r: DataFrame) -> DataFrame:
    return policy.policy_table(with_values(model_r))


def greedy_policy_table(model_r: DataFrame) -> DataFrame:
    return policy.greedy_policy_table(with_values(model_r))


def policy_value_table(model_r: DataFrame) -> DataFrame:
    return _solve_job(model_r, "policy_value", "entity string, state int, value double")


def value_difference_table(model_r: DataFrame) -> DataFrame:
    """Expected value difference (M8): optimal value of the true reward minus
    the true-reward value of the greedy policy of the recovered reward ``r``,
    both weighted by the start distribution."""
    return _solve_job(model_r, "evd", "entity string, evd double")


def expected_visitation_table(model_r: DataFrame, policy_name: str = "uniform") -> DataFrame:
    """Under the uniform policy, or the soft one of ``r`` (``optimal``)."""
    return policy.visitation_table(_spread(model_r) if policy_name == "uniform" else with_values(model_r), policy_name)


def step_errors(model: DataFrame, epochs: int, learning_rate: float = LEARNING_RATE) -> DataFrame:
    """(entity, error, moved): whether the solver's step from ``epochs`` to
    ``epochs + 1`` is its gradient, computed anew by columns: the largest
    difference of any reward, and whether one changed at all."""
    given = stored(model if "alpha0" in model.columns else model.withColumn("alpha0", start_weights(F.col("entity"))))
    before = fit_rewards(given, epochs, learning_rate, checkpoint=True)
    after = fit_rewards(given, epochs + 1, learning_rate, checkpoint=True).withColumnRenamed("r", "after")
    solved = with_values(given.drop("alpha0").join(before, "entity"))
    step = policy.gradient_table(solved).withColumn("step", policy.rewards_of(F.transform("gradient", lambda g: g * learning_rate)))
    both = step.join(after, "entity")
    differences = F.zip_with(F.zip_with("r", "step", lambda a, b: a + b), "after", lambda a, b: F.abs(a - b))
    return both.select("entity", F.array_max(differences).alias("error"), (F.col("r") != F.col("after")).alias("moved"))


def event_rewards(pairs: DataFrame, value_col: str = "value") -> DataFrame:
    """Deterministic reward per entity from the data: for each state the sum of
    ``value_col`` over the entity's pairs in it, 0 when unseen.  One partial
    aggregation; ``(entity, r array<double>)``."""
    sums = [F.sum(F.when(F.col("state") == s, F.col(value_col)).otherwise(F.lit(0.0))).alias(f"r{s}") for s in range(N_STATES)]
    wide = pairs.groupBy("entity").agg(*sums)
    return wide.select("entity", F.array(*[F.col(f"r{s}").cast("double") for s in range(N_STATES)]).alias("r"))
