"""Window form of the pair rules against a sequential simulation.

The simulation walks one account's events in order the way the original loop
does: it keeps the previous post counter and a pending action, emits the
(state, action) of event t-1 when it reaches event t, and splits trajectories
of length L.  Random timelines of many lengths, with missing counters, under
both action rules; also through the hot-entity split path.
"""

from datetime import datetime, timedelta

import numpy as np
import pytest

from behaviorlens.operators import trajectories as J

SCHEMA = (
    "entity string, time timestamp_ntz, kind string, activity int, tweet_id bigint, post_id bigint, statuses bigint"
)


def simulate(acts, statuses, rule, default_length=100):
    """Sequential pairs of one account: list of (e, state, action, next_state, traj_id, kept)."""
    n = len(acts)
    base_of = {5: 3, 6: 2, 8: 2, 7: 1, 9: 1}

    def direct(e):
        a, first = acts[e], acts[0]
        decider = first if rule == "reference" else a
        if a == 1:
            return 3
        if decider == 2:
            return 2
        if decider in (3, 4):
            return 1
        return None

    pairs = []
    prev_count = statuses[0]
    pending = direct(0)
    for t in range(1, n):
        count = statuses[t]
        action = pending
        if action is None:
            grew = prev_count is not None and count is not None and count - prev_count > 0
            action = 3 if grew else 0
        state = 4 * base_of.get(acts[t - 1], 0) + action
        pairs.append([t - 1, state, action])
        prev_count = count
        pending = direct(t)
    length = default_length if n > default_length else n - 1
    complete = (n - 1) // length
    out = []
    for i, (e, s, a) in enumerate(pairs):
        nxt = pairs[i + 1][1] if i + 1 < len(pairs) else None
        out.append((e, s, a, nxt, e // length, e // length < complete))
    return out


def random_timelines(seed, users):
    rng = np.random.default_rng(seed)
    t0 = datetime(2024, 1, 1)
    rows, expect = [], {}
    for u in range(users):
        n = int(rng.integers(2, 260))
        acts = [int(a) for a in rng.integers(1, 9, size=n)]
        stat = [None if rng.random() < 0.1 else int(rng.integers(0, 5)) + i // 3 for i in range(n)]
        stat = [s if a <= 5 else 0 for s, a in zip(stat, acts)]
        for i, (a, s) in enumerate(zip(acts, stat)):
            rows.append((f"u{u}", t0 + timedelta(seconds=37 * i + u), "a" if a <= 4 else "p", a, 10 * i + 1, 10 * i + 1, s))
        expect[f"u{u}"] = (acts, stat)
    return rows, expect


@pytest.mark.parametrize("rule,hot", [("reference", None), ("per_event", None), ("reference", 60), ("per_event", 60)])
def test_window_form_matches_sequential_simulation(spark, rule, hot):
    rows, expect = random_timelines(seed=17, users=40)
    df = spark.createDataFrame(rows, SCHEMA)
    kw = {} if hot is None else {"hot_rows": hot, "rows_per_bucket": 20}
    got = J.state_action_pairs(df, action_rule=rule, t_active=-1, t_passive=-1, **kw).select(
        "entity", "e", "state", "action", "next_state", "traj_id", "kept"
    )
    by_entity = {}
    for r in got.collect():
        by_entity.setdefault(r["entity"], []).append(
            (r["e"], r["state"], r["action"], r["next_state"], r["traj_id"], r["kept"])
        )
    assert set(by_entity) == set(expect)
    for ent, (acts, stat) in expect.items():
        assert sorted(by_entity[ent]) == simulate(acts, stat, rule), ent
