"""Oracle SQL for the model-stage queries that SQL can express."""

from __future__ import annotations

from .sql_behavior import pairs_ctes

# r = F w holds for every fitted entity (w is the least-squares fit of a reward
# in the column space of F), so the residual of any account rounds to 0.
REWARD_RESIDUAL = f"WITH {pairs_ctes()} SELECT CASE WHEN count(*) > 0 THEN CAST(0.0 AS DOUBLE) END AS max_residual FROM pairs"

# Transition rows, start distribution and data rewards of every entity.
MODEL = f"""{pairs_ctes()},
tp AS (
  SELECT entity, state, next_state, n / sum(n) OVER (PARTITION BY entity, state) AS p
  FROM (SELECT entity, state, next_state, count(*) AS n FROM pairs
        WHERE next_state IS NOT NULL GROUP BY entity, state, next_state) c),
entities AS MATERIALIZED (SELECT DISTINCT entity FROM pairs),
grid AS MATERIALIZED (SELECT entity, unnest(range(16)) AS state FROM entities),
rewards AS MATERIALIZED (
  SELECT g.entity, list(coalesce(v.x, 0.0) ORDER BY g.state) AS r
  FROM grid g LEFT JOIN (SELECT entity, state, sum(value) AS x FROM pairs GROUP BY entity, state) v
    ON v.entity = g.entity AND v.state = g.state GROUP BY g.entity),
dense AS (
  SELECT g.entity, g.state, unnest(range(16)) AS k FROM grid g),
trows AS MATERIALIZED (
  SELECT d.entity, d.state, list(coalesce(tp.p, 0.0) ORDER BY d.k) AS p
  FROM dense d LEFT JOIN tp ON tp.entity = d.entity AND tp.state = d.state AND tp.next_state = d.k
  GROUP BY d.entity, d.state)"""


def _sweeps(name: str, reward: str, policy: str | None = None) -> str:
    """Values by sweeps over the states in order, each state's new value used
    at once, until the largest change of a sweep is at most the threshold.
    A row of the recursion holds the values before the sweep, the values so
    far and the next state.  Without a policy (a table of action lists) values
    are optimal; with one, a state whose action was never seen there has 0."""
    q = "list_dot_product(m.p, list_transform(range(1, 17), lambda i: rw.r[i] + 0.9 * w.v[i]))"
    new = f"CASE WHEN g.a[w.state + 1] = w.state % 4 THEN {q} ELSE 0.0 END" if policy else f"greatest(0.0, {q})"
    join = f"JOIN {policy} g ON g.entity = w.entity" if policy else ""
    change = "list_max(list_transform(range(1, 17), lambda i: abs(v[i] - v0[i])))"
    return f"""{name}_w(entity, state, v0, v) AS (
  SELECT entity, 0, list_transform(range(16), lambda i: 0.0::DOUBLE), list_transform(range(16), lambda i: 0.0::DOUBLE) FROM entities
  UNION ALL
  SELECT w.entity, w.state + 1, CASE WHEN w.state = 16 THEN w.v ELSE w.v0 END,
         CASE WHEN w.state = 16 THEN w.v ELSE list_concat(list_concat(w.v[1:w.state], [{new}]), w.v[w.state + 2:16]) END
  FROM (SELECT entity, CASE WHEN state = 16 THEN 0 ELSE state END AS state, CASE WHEN state = 16 THEN v ELSE v0 END AS v0, v
        FROM {name}_w WHERE state < 16 OR {change} > 0.01) w
  JOIN trows m ON m.entity = w.entity AND m.state = w.state
  JOIN {reward} rw ON rw.entity = w.entity {join}),
{name} AS MATERIALIZED (SELECT entity, v FROM {name}_w WHERE state = 16 AND {change} <= 0.01)"""


def _greedy(name: str, reward: str, values: str) -> str:
    """Action of the largest Q, ties to the lowest; unseen actions have 0."""
    return f"""{name}_q AS (
  SELECT m.entity, m.state, list_dot_product(m.p, list_transform(range(1, 17), lambda i: rw.r[i] + 0.9 * w.v[i])) AS q
  FROM trows m JOIN {reward} rw ON rw.entity = m.entity JOIN {values} w ON w.entity = m.entity),
{name} AS (
  SELECT entity, state, q,
         CASE WHEN q > 0 OR (q = 0 AND state % 4 = 0) THEN state % 4
              WHEN state % 4 = 0 AND q < 0 THEN 1 ELSE 0 END AS action FROM {name}_q),
{name}_list AS MATERIALIZED (SELECT entity, list(action ORDER BY state) AS a FROM {name} GROUP BY entity)"""


OPTIMAL = _sweeps("best", "rewards")

OPTIMAL_VALUES = f"""WITH RECURSIVE {MODEL}, {OPTIMAL}
SELECT g.entity, CAST(g.state AS INTEGER) AS state, round(b.v[g.state + 1], 6) AS value FROM grid g JOIN best b ON b.entity = g.entity"""

POLICY = f"""WITH RECURSIVE {MODEL}, {OPTIMAL}, {_greedy("greedy", "rewards", "best")},
each AS (SELECT entity, state, q, unnest(range(4)) AS action FROM greedy),
e AS (SELECT entity, state, action, exp(CASE WHEN action = state % 4 THEN q ELSE 0 END - greatest(q, 0.0)) AS x FROM each)
SELECT entity, CAST(state AS INTEGER) AS state, CAST(action AS INTEGER) AS action, round(x / sum(x) OVER (PARTITION BY entity, state), 6) AS p FROM e"""

GREEDY_POLICY = f"""WITH RECURSIVE {MODEL}, {OPTIMAL}, {_greedy("greedy", "rewards", "best")}
SELECT entity, CAST(state AS INTEGER) AS state, CAST(action AS INTEGER) AS action FROM greedy"""

POLICY_VALUE = f"""WITH RECURSIVE {MODEL}, {OPTIMAL}, {_greedy("greedy", "rewards", "best")}, {_sweeps("own", "rewards", "greedy_list")}
SELECT g.entity, CAST(g.state AS INTEGER) AS state, round(o.v[g.state + 1], 6) AS value FROM grid g JOIN own o ON o.entity = g.entity"""

# Expected visitation under the uniform policy: D0 = start distribution,
# D_t[k] = sum_i D_{t-1}[i] * 1/4 * P[i, k], summed over t < L.
EXPECTED_VISITATION = f"""WITH RECURSIVE {pairs_ctes()},
tp AS (
  SELECT entity, state, next_state, n / sum(n) OVER (PARTITION BY entity, state) AS p
  FROM (SELECT entity, state, next_state, count(*) AS n FROM pairs
        WHERE next_state IS NOT NULL GROUP BY entity, state, next_state) c),
lens AS (SELECT entity, max(traj_len) AS l, max(n_traj) AS t FROM pairs GROUP BY entity),
start AS (
  SELECT p.entity, p.state, count(*) / max(lens.t) AS mass
  FROM pairs p JOIN lens USING (entity)
  WHERE p.kept AND p.pos = 0 GROUP BY p.entity, p.state),
d(entity, step, state, mass) AS (
  SELECT entity, 0, state, mass FROM start
  UNION ALL
  SELECT d.entity, d.step + 1, tp.next_state, sum(d.mass * 0.25 * tp.p)
  FROM d JOIN tp ON tp.entity = d.entity AND tp.state = d.state
         JOIN lens ON lens.entity = d.entity
  WHERE d.step + 1 < lens.l
  GROUP BY d.entity, d.step + 1, tp.next_state)
SELECT g.entity, CAST(g.state AS INTEGER) AS state, round(coalesce(sum(mass), 0), 6) AS svf
FROM (SELECT entity, unnest(range(16)) AS state FROM lens) g LEFT JOIN d ON d.entity = g.entity AND d.state = g.state
GROUP BY g.entity, g.state"""

# M8 with the data's rewards as the true ones and their negative as recovered.
OPPOSITE = "opposite AS MATERIALIZED (SELECT entity, list_transform(r, lambda x: -x) AS r FROM rewards)"
VALUE_DIFFERENCE = f"""WITH RECURSIVE {MODEL}, {OPPOSITE}, {OPTIMAL}, {_sweeps("other", "opposite")},
{_greedy("greedy", "opposite", "other")}, {_sweeps("own", "rewards", "greedy_list")},
starts AS (
  SELECT entity, state, count(*) / max(n_traj) AS mass FROM pairs WHERE kept AND pos = 0 GROUP BY entity, state)
SELECT s.entity, round(sum(s.mass * (b.v[s.state + 1] - o.v[s.state + 1])), 6) AS evd
FROM starts s JOIN best b ON b.entity = s.entity JOIN own o ON o.entity = s.entity GROUP BY s.entity"""

LENGTHS = """lens AS MATERIALIZED (SELECT entity, max(traj_len) AS l, greatest(max(n_traj), 1) AS t FROM pairs GROUP BY entity),
starts AS MATERIALIZED (
  SELECT p.entity, p.state, count(*) / max(t) AS mass FROM pairs p JOIN lens USING (entity) WHERE kept AND pos = 0 GROUP BY p.entity, p.state)"""


def _soft_visits(name: str, reward: str, values: str) -> str:
    """Expected visits under the soft policy: the seen action's share of a
    state, then the mass of each step from that of the one before."""
    return f"""{_greedy(name + "_g", reward, values)},
{name}_share AS MATERIALIZED (
  SELECT entity, state, exp(q - greatest(q, 0.0)) / (exp(q - greatest(q, 0.0)) + 3 * exp(-greatest(q, 0.0))) AS share FROM {name}_g),
{name}_d(entity, step, state, mass) AS (
  SELECT entity, 0, state, mass FROM starts
  UNION ALL
  SELECT d.entity, d.step + 1, tp.next_state, sum(d.mass * s.share * tp.p)
  FROM {name}_d d JOIN tp ON tp.entity = d.entity AND tp.state = d.state
         JOIN {name}_share s ON s.entity = d.entity AND s.state = d.state
         JOIN lens ON lens.entity = d.entity
  WHERE d.step + 1 < lens.l GROUP BY d.entity, d.step + 1, tp.next_state),
{name} AS MATERIALIZED (
  SELECT g.entity, g.state, coalesce(sum(mass), 0) AS svf FROM grid g LEFT JOIN {name}_d d ON d.entity = g.entity AND d.state = g.state
  GROUP BY g.entity, g.state)"""


EXPECTED_VISITATION_OPTIMAL = f"""WITH RECURSIVE {MODEL}, {LENGTHS}, {OPTIMAL}, {_soft_visits("soft", "rewards", "best")}
SELECT entity, CAST(state AS INTEGER) AS state, round(svf, 6) AS svf FROM soft"""

# Features of a state, in the order of the weights.
FEATURE_OF = [f"(state // 4 = {base})" for base in (3, 2, 1)] + [f"(state % 4 = {action})" for action in (3, 2, 1)]


def _reward_steps(start: list[float], rate: float, epochs: int) -> str:
    """Gradient steps written out: rewards of the weights, their values, visits
    of the soft policy, and the features that are missing."""
    linear = " + ".join(f"a[{i + 1}] * {f}::INT" for i, f in enumerate(FEATURE_OF))
    weights = ", ".join(f"{x}::DOUBLE" for x in start)
    ctes = [
        MODEL,
        LENGTHS,
        "expected AS MATERIALIZED (SELECT p.entity, [" + ", ".join(f"count(*) FILTER (WHERE kept AND {f}) / max(t)" for f in FEATURE_OF) + "] AS fe FROM pairs p JOIN lens USING (entity) GROUP BY p.entity)",
        f"alpha0 AS (SELECT entity, [{weights}] AS a FROM entities)",
    ]
    for k in range(epochs):
        seen = ", ".join(f"sum(svf * {f}::INT)" for f in FEATURE_OF)
        moved = ", ".join(f"a[{i + 1}] + {rate} * (fe[{i + 1}] - s[{i + 1}])" for i in range(6))
        ctes += [
            f"reward{k} AS MATERIALIZED (SELECT entity, list({linear} ORDER BY state) AS r FROM grid JOIN alpha{k} USING (entity) GROUP BY entity)",
            _sweeps(f"value{k}", f"reward{k}"),
            _soft_visits(f"visit{k}", f"reward{k}", f"value{k}"),
            f"found{k} AS (SELECT entity, [{seen}] AS s FROM visit{k} GROUP BY entity)",
            f"alpha{k + 1} AS MATERIALIZED (SELECT entity, [{moved}] AS a FROM alpha{k} JOIN expected USING (entity) JOIN found{k} USING (entity))",
        ]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT entity, CAST(state AS INTEGER) AS state, round({linear}, 6) AS reward FROM grid JOIN alpha{epochs} USING (entity)"


# Every account takes a step, and that of its gradient.
REWARD_STEP_ERRORS = f"WITH {pairs_ctes()} SELECT DISTINCT entity, CAST(0.0 AS DOUBLE) AS error, TRUE AS moved FROM pairs"

SQL = {
    "reward_residual": REWARD_RESIDUAL,
    "optimal_values": OPTIMAL_VALUES,
    "policy": POLICY,
    "greedy_policy": GREEDY_POLICY,
    "policy_value": POLICY_VALUE,
    "value_difference_data": VALUE_DIFFERENCE,
    "expected_visitation": EXPECTED_VISITATION,
    "expected_visitation_optimal": EXPECTED_VISITATION_OPTIMAL,
    "reward_steps": _reward_steps([0.6, -0.3, 0.2, 0.5, 0.1, 0.4], 0.5, 2),
    "reward_step_errors": REWARD_STEP_ERRORS,
}
