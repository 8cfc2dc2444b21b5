"""Batched decision-model kernel against exact solutions, and its invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import scalar_model as S
from behaviorlens.operators import rewards as R
from behaviorlens.plans import models


def random_models(b, seed=0):
    rng = np.random.default_rng(seed)
    tp = np.zeros((b, 16, 16))
    for i in range(b):
        for s in range(16):
            if rng.random() < 0.8:
                row = rng.random(16) * (rng.random(16) < 0.4)
                if row.sum() > 0:
                    tp[i, s] = row / row.sum()
    p0 = rng.dirichlet(np.ones(16), size=b)
    fe = rng.random((b, 6)) * 10
    length = rng.integers(4, 25, size=b)
    return tp, p0, fe, length, rng


GAP = 0.01  # the solver stops when a sweep changes no value by more


def test_values_near_the_fixed_point():
    tp, _, _, _, rng = random_models(6, seed=3)
    r = rng.normal(size=(6, 16)) * 5
    v = R.optimal_values(tp, r)
    fine = R.optimal_values(tp, r, threshold=1e-12)
    for b in range(6):
        exact = S.fixed_point(tp[b], r[b])
        assert S.bellman_gap(tp[b], r[b], exact) < 1e-9
        assert np.allclose(fine[b], exact, atol=1e-9)
        assert S.bellman_gap(tp[b], r[b], v[b]) <= GAP
        assert np.abs(v[b] - exact).max() <= GAP / (1 - 0.9)


def test_values_by_hand():
    """State 0 leads to 3, 3 to itself: 1 a step, 10 in the limit; state 2
    leads to 5, which pays -4 and ends: better not to go."""
    tp, r = np.zeros((1, 16, 16)), np.zeros((1, 16))
    tp[0, 0, 3] = tp[0, 3, 3] = tp[0, 2, 5] = 1.0
    r[0, 3], r[0, 5] = 1.0, -4.0
    v = R.optimal_values(tp, r, threshold=1e-12)[0]
    assert np.allclose(v[[0, 3]], 10.0) and v[2] == 0.0 and v[5] == 0.0
    follow = np.tile(np.arange(16) % 4, (1, 1))
    own = R.policy_values(tp, follow, r, threshold=1e-12)[0]
    assert np.allclose(own[[0, 3]], 10.0) and own[2] == -4.0
    greedy = R.greedy_policy(tp, r, v[None])[0]
    assert greedy[3] == 3 and greedy[2] == 0 and greedy[0] == 0
    p0 = np.zeros((1, 16))
    p0[0, 0] = 1.0
    sure = np.zeros((1, 16, 4))
    sure[0, np.arange(16), np.arange(16) % 4] = 1.0
    svf = R.expected_svf(tp, sure, p0, np.array([4]))[0]
    assert svf[0] == 1.0 and svf[3] == 3.0 and svf.sum() == 4.0


def test_policies_and_visits_from_definitions():
    tp, p0, _, length, rng = random_models(4, seed=3)
    r = rng.normal(size=(4, 16)) * 5
    v = R.optimal_values(tp, r)
    pol, greedy = R.stochastic_policy(tp, r, v), R.greedy_policy(tp, r, v)
    fine = R.policy_values(tp, greedy, r, threshold=1e-12)
    coarse = R.policy_values(tp, greedy, r)
    svf = R.expected_svf(tp, pol, p0, length)
    for b in range(4):
        q = S.action_values(tp[b], r[b], v[b])
        assert np.allclose(pol[b], S.boltzmann(q), atol=1e-12)
        assert (q[np.arange(16), greedy[b]] == q.max(axis=1)).all()
        exact = S.value_under(tp[b], r[b], greedy[b])
        assert np.allclose(fine[b], exact, atol=1e-9) and np.abs(coarse[b] - exact).max() <= GAP / (1 - 0.9)
        assert np.allclose(svf[b], S.visitation(tp[b], pol[b], p0[b], int(length[b])), atol=1e-12)


def test_ascent_follows_the_gradient():
    """One epoch moves the weights by the rate times observed less expected
    features, the latter from exact values; many epochs shrink that gap."""
    tp, p0, _, length, rng = random_models(5, seed=9)
    fe = rng.random((5, 6))
    a0 = rng.random((5, 6))
    r, alpha = R.maxent_irl(tp, p0, fe, length, a0, epochs=1, threshold=1e-12)
    for b in range(5):
        r0 = R.F_MAT @ a0[b]
        policy = S.boltzmann(S.action_values(tp[b], r0, S.fixed_point(tp[b], r0)))
        gap = fe[b] - S.visitation(tp[b], policy, p0[b], int(length[b])) @ R.F_MAT
        assert np.allclose(alpha[b], a0[b] + 0.01 * gap, atol=1e-9)
        assert np.allclose(r[b], R.F_MAT @ alpha[b], atol=1e-12)


def test_batch_size_does_not_change_results():
    tp, p0, fe, length, rng = random_models(6, seed=7)
    a0 = rng.random((6, 6))
    whole, _ = R.maxent_irl(tp, p0, fe, length, a0, epochs=10)
    parts = [R.maxent_irl(tp[i:i + 1], p0[i:i + 1], fe[i:i + 1], length[i:i + 1], a0[i:i + 1], epochs=10)[0] for i in range(6)]
    assert np.allclose(whole, np.vstack(parts), atol=1e-12)


@pytest.fixture(scope="module")
def fitted(spark):
    m = models.model(spark, "/root/testdata/sf0.001")
    r = R.fit_rewards(m, epochs=30)
    return r.withColumn("w", R.weights_from_rewards(F.col("r"))).cache()


def test_fitted_invariants(fitted):
    rows = fitted.collect()
    assert rows
    for row in rows:
        assert row["r"][0] == 0.0
        assert len(row["r"]) == 16 and len(row["w"]) == 6
    res = fitted.select(R.reward_residual(F.col("r"), F.col("w")).alias("x")).agg(F.max("x")).first()[0]
    assert res < 1e-9


def test_action_groups_do_not_change_results():
    tp, p0, fe, length, rng = random_models(8, seed=11)
    tp[:4, 1::4] = 0.0  # no rp rows for half the entities
    tp[:2, 2::4] = 0.0  # and no rt rows for two of them
    a0 = rng.random((8, 6))
    whole, _ = R.maxent_irl(tp, p0, fe, length, a0, epochs=10)
    key = tp.any(axis=2)[:, R.SEEN_ACTION == 1].any(axis=1).astype(int) + 2 * tp.any(axis=2)[:, R.SEEN_ACTION == 2].any(axis=1)
    groups = [np.flatnonzero(key == k) for k in np.unique(key)]
    assert len(groups) >= 2 and sorted(np.concatenate(groups).tolist()) == list(range(8))
    for idx in groups:
        part, _ = R.maxent_irl(tp[idx], p0[idx], fe[idx], length[idx], a0[idx], epochs=10)
        assert np.allclose(part, whole[idx], atol=1e-12)


def test_solver_rows_spread_over_tasks(spark):
    """As many partitions as accounts or cores allow, whatever the shuffle
    setting, and none folded together by adaptive execution."""
    m = models.model(spark, "/root/testdata/sf0.01")
    n = m.count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for setting in ("4", "2"):
            spark.conf.set("spark.sql.shuffle.partitions", setting)
            out = R.fit_rewards(m, epochs=1).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
            assert len(out) == min(n, 4) and max(x["count"] for x in out) <= -(-n // 4) + 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_start_weights_are_spread(spark):
    w = spark.range(2000).select(R.start_weights(F.col("id").cast("string")).alias("w")).toPandas()["w"].tolist()
    w = np.array(w)
    assert w.shape == (2000, 6) and w.min() >= 0 and w.max() < 1
    assert np.abs(w.mean(axis=0) - 0.5).max() < 0.03 and len(np.unique(w)) == 12000


# --- policies, visits and gradients as columns -----------------------------------


def random_model(spark, n=40, seed=4):
    """Model rows with rewards, odd ones included: no cell, one cell, L of 1."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        states = sorted(r.choice(16, size=r.integers(1, 9), replace=False).tolist())
        cells = [(0, s, k, int(r.integers(1, 9))) for s in states for k in r.choice(states, size=min(3, len(states)), replace=False).tolist()]
        cells += [(1, s, -1, int(r.integers(1, 3))) for s in states[:2]] + [(2, s, -1, int(r.integers(1, 30))) for s in states]
        rows.append((f"u{i}", int(r.integers(1, 60)), int(r.integers(1, 5)), cells, r.normal(size=16).tolist()))
    rows += [("none", 1, 0, [], [0.0] * 16), ("one", 5, 1, [(0, 3, 3, 2), (1, 3, -1, 1), (2, 3, -1, 4)], [-1.0] * 16)]
    return spark.createDataFrame(rows, "entity string, traj_len int, n_traj int, cells array<struct<k:int,s:int,ns:int,cnt:bigint>>, r array<double>")


def test_columns_agree_with_the_kernel(spark):
    from behaviorlens.operators import policy

    solved = R.with_values(random_model(spark)).persist()
    batch = solved.toArrow().combine_chunks().to_batches()[0]
    tp, p0, fe, length = R.dense_model(batch)
    r = np.array(batch.column("r").to_pylist())
    v = np.array(batch.column("v").to_pylist())
    names = batch.column("entity").to_pylist()
    soft, greedy = R.stochastic_policy(tp, r, v), R.greedy_policy(tp, r, v)
    got = {(x["entity"], x["state"], x["action"]): x["p"] for x in policy.policy_table(solved).collect()}
    assert got == pytest.approx({(e, s, a): soft[i, s, a] for i, e in enumerate(names) for s in range(16) for a in range(4)})
    got = {(x["entity"], x["state"]): x["action"] for x in policy.greedy_policy_table(solved).collect()}
    assert got == {(e, s): greedy[i, s] for i, e in enumerate(names) for s in range(16)}
    for name, pol in (("uniform", np.full_like(soft, 0.25)), ("optimal", soft)):
        svf = R.expected_svf(tp, pol, p0, length)
        got = {(x["entity"], x["state"]): x["svf"] for x in policy.visitation_table(solved, name).collect()}
        assert got == pytest.approx({(e, s): svf[i, s] for i, e in enumerate(names) for s in range(16)})
    want = fe - R.expected_svf(tp, soft, p0, length) @ R.F_MAT
    got = {x["entity"]: x["gradient"] for x in policy.gradient_table(solved).collect()}
    assert all(got[e] == pytest.approx(want[i].tolist()) for i, e in enumerate(names))
    plan = policy.policy_table(solved)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.split("InMemoryRelation")[0] and "MapInArrow" not in plan.split("InMemoryRelation")[0]


def test_step_errors_find_a_wrong_step(spark, monkeypatch):
    """The solver's own step passes; weights that moved otherwise do not."""
    model = random_model(spark).where("size(cells) > 0").drop("r")
    good = R.step_errors(model, 5).collect()
    assert all(x["error"] < 1e-9 for x in good) and sum(x["moved"] for x in good) > len(good) / 2
    fit = R.fit_rewards

    def wrong(given, epochs, *rest, **kw):
        out = fit(given, epochs, *rest, **kw)
        return out.withColumn("r", F.transform("r", lambda x: x * 1.01)) if epochs == 6 else out

    monkeypatch.setattr(R, "fit_rewards", wrong)
    assert max(x["error"] for x in R.step_errors(model, 5).collect()) > 1e-4


def test_step_errors_of_no_account(spark):
    assert R.step_errors(random_model(spark).limit(0).drop("r"), 5).count() == 0


def test_solver_groups_hold_the_whole_model():
    """Accounts are solved by the few states they visit: no state, start or
    visit is lost, and blocks of steps sum to what single steps do."""
    rng = np.random.default_rng(5)
    sets = [(3, 2, 6, 10, 14), (3, 1, 5, 9, 13), (0, 3, 4, 7, 8, 11, 12, 15), (0, 3, 4), tuple(range(16)), (7,)]
    b = 60
    tp, p0 = np.zeros((b, 16, 16)), np.zeros((b, 16))
    for i in range(b):
        states = np.array(sets[i % len(sets)])
        tp[i][np.ix_(states, states)] = rng.dirichlet(np.ones(len(states)), size=len(states))
        p0[i, states] = rng.dirichlet(np.ones(len(states)))
        tp[i, states[-1]] = 0  # entered, not left
    length = rng.integers(1, 101, b)
    groups = R.state_groups(tp, p0)
    assert sorted(np.concatenate([rows for rows, _ in groups]).tolist()) == list(range(b))
    for rows, states in groups:
        other = np.setdiff1d(np.arange(16), states)
        assert not tp[rows][:, other].any() and not tp[rows][:, :, other].any() and not p0[rows][:, other].any()
    assert min(len(states) for _, states in groups) <= 8 and len(groups) < len(sets)
    r = rng.random((b, 16))
    pol = R.stochastic_policy(tp, r, R.optimal_values(tp, r))
    seen = pol[:, np.arange(16), np.arange(16) % 4]
    for i in range(b):
        d, total = p0[i], p0[i].copy()
        for _ in range(1, length[i]):
            d = d @ (seen[i][:, None] * tp[i])
            total = total + d
        np.testing.assert_allclose(R.expected_svf(tp, pol, p0, length)[i], total, rtol=1e-12, atol=1e-14)
    fe, alpha0 = rng.random((b, 6)) * 20, rng.random((b, 6))
    rewards, _ = R.maxent_irl(tp, p0, fe, length, alpha0, epochs=3, learning_rate=0.01)
    alpha = alpha0
    for _ in range(3):
        now = alpha @ R.F_MAT.T
        policy = R.stochastic_policy(tp, now, R.optimal_values(tp, now))
        alpha = alpha + 0.01 * (fe - R.expected_svf(tp, policy, p0, length) @ R.F_MAT)
    np.testing.assert_allclose(rewards, alpha @ R.F_MAT.T, rtol=1e-9, atol=1e-9)
