"""Oracle SQL (DuckDB dialect) for the timeline, pair and transition queries.

Each string runs on the shared parquet tables registered as views and must
return the same rows, column names and values as the matching Spark query.
"""

from __future__ import annotations

from .sql_text import scored as scored_sql

ACT = "CAST(event_id % 8 + 1 AS INTEGER)"
ORDER = (
    "time ASC NULLS LAST, kind ASC NULLS FIRST, activity ASC NULLS FIRST, "
    "tweet_id ASC NULLS FIRST, post_id ASC NULLS FIRST"
)


def ev_cte(modulo: int | None = None) -> str:
    uid = "user_id" if modulo is None else f"user_id % {modulo}"
    return f"""ev AS (
  SELECT CAST({uid} AS VARCHAR) AS entity,
         ts AS time,
         CASE WHEN {ACT} <= 4 THEN 'a' ELSE 'p' END AS kind,
         {ACT} AS activity,
         CAST(CASE WHEN {ACT} = 8 THEN 0 ELSE event_id + 1 END AS BIGINT) AS tweet_id,
         CAST(CASE WHEN {ACT} <= 4 THEN event_id + 1 ELSE event_id END AS BIGINT) AS post_id,
         CAST(CASE WHEN {ACT} <= 5 THEN floor(value) ELSE 0 END AS BIGINT) AS statuses,
         value
  FROM events WHERE user_id IS NOT NULL)"""


def _base(a: str) -> str:
    return f"(CASE WHEN {a} = 5 THEN 3 WHEN {a} IN (6, 8) THEN 2 WHEN {a} IN (7, 9) THEN 1 ELSE 0 END)"


def _action(a: str, first: str, st: str, nst: str, rule: str) -> str:
    decider = first if rule == "reference" else a
    return (
        f"COALESCE(CASE WHEN {a} = 1 THEN 3 WHEN {decider} = 2 THEN 2 WHEN {decider} IN (3, 4) THEN 1 END, "
        f"CASE WHEN {nst} - {st} > 0 THEN 3 ELSE 0 END)"
    )


def pairs_ctes(rule: str = "reference", modulo: int | None = None, t_a: int = 5, t_p: int = 5, length: int = 100) -> str:
    base = _base("activity")
    act = _action("activity", "first_activity", "statuses", "next1_statuses", rule)
    nbase = _base("next1_activity")
    nact = _action("next1_activity", "first_activity", "next1_statuses", "next2_statuses", rule)
    return f"""{ev_cte(modulo)},
seq AS (
  SELECT *,
         CAST(row_number() OVER w - 1 AS BIGINT) AS e,
         count(*) OVER (PARTITION BY entity) AS n,
         count(*) FILTER (WHERE kind = 'a') OVER (PARTITION BY entity) AS n_active,
         count(*) FILTER (WHERE kind = 'p') OVER (PARTITION BY entity) AS n_passive,
         first_value(activity) OVER w AS first_activity,
         lead(activity, 1) OVER w AS next1_activity,
         lead(statuses, 1) OVER w AS next1_statuses,
         lead(statuses, 2) OVER w AS next2_statuses
  FROM ev
  WINDOW w AS (PARTITION BY entity ORDER BY {ORDER})),
p0 AS (
  SELECT *,
         CAST({base} AS INTEGER) AS base,
         CAST({act} AS INTEGER) AS action,
         CAST(CASE WHEN n > {length} THEN {length} ELSE n - 1 END AS BIGINT) AS traj_len,
         CAST(CASE WHEN e <= n - 3 THEN 4 * {nbase} + {nact} END AS INTEGER) AS next_state
  FROM seq
  WHERE n_active > {t_a} AND n_passive > {t_p} AND e <= n - 2),
pairs AS (
  SELECT *,
         CAST(4 * base + action AS INTEGER) AS state,
         CAST(floor((n - 1) / traj_len) AS BIGINT) AS n_traj,
         CAST(floor(e / traj_len) AS BIGINT) AS traj_id,
         CAST(e % traj_len AS BIGINT) AS pos,
         floor(e / traj_len) < floor((n - 1) / traj_len) AS kept
  FROM p0)"""


def _role_select(code: int) -> str:
    """One role table's events; counters that may be missing are DOUBLE."""
    kind = "'a'" if code <= 4 else "'p'"
    post = "event_id + 1" if code <= 4 else "event_id"
    tweet = "0" if code == 8 else "event_id + 1"
    statuses = "CAST(floor(value) AS BIGINT)" if code <= 5 else "0"
    if code <= 4:
        counters = ["NULL", "NULL", "NULL", "0", "0", "0"]
    elif code == 5:
        counters = ["NULL", "NULL", "NULL", "json_extract_string(props, '$.k')", "NULL", "NULL"]
    else:
        counters = ["0"] * 6
    counters_sql = ", ".join(f"CAST({c} AS DOUBLE)" for c in counters)
    return f"""SELECT CAST(user_id AS VARCHAR), ts, {kind}, CAST({code} AS INTEGER),
       CAST({tweet} AS BIGINT), CAST({post} AS BIGINT), {statuses}, {counters_sql}
FROM events WHERE user_id IS NOT NULL AND {ACT} = {code}"""


EVENT_TIMELINE = (
    "SELECT * FROM (\n"
    + "\nUNION ALL\n".join(_role_select(c) for c in range(1, 9))
    + "\n) t(entity, time, kind, activity, tweet_id, post_id, statuses, followers, friends, favourites, "
    "retweet_count, tweet_likes, reply)"
)

# The rows of both reply tables with the table by score.
SCORED_TIMELINE = f"""WITH {scored_sql("SELECT event_id AS post, d.text FROM events JOIN documents d ON d.doc_id = event_id % (SELECT max(doc_id) + 1 FROM documents) WHERE " + ACT + " IN (6, 7)")}
SELECT t.* REPLACE (CASE WHEN t.activity IN (6, 7) THEN CASE WHEN s.score > 0.5 THEN 6 ELSE 7 END ELSE t.activity END::INTEGER AS activity)
FROM ({EVENT_TIMELINE}) t LEFT JOIN scored s ON t.activity IN (6, 7) AND s.post = t.post_id"""

TIME_FORM = "['iso', 'classic', 'mail', 'slashed', 'slashed', 'epoch', 'epoch', 'iso'][event_id % 8 + 1]"
PARSED_TIMES = f"SELECT event_id, {TIME_FORM} AS format, CASE WHEN event_id % 8 = 0 THEN ts ELSE date_trunc('second', ts) END AS time FROM events"

ENTITY_THRESHOLDS = f"""WITH {ev_cte()}
SELECT entity, count(*) FILTER (WHERE kind = 'a') AS n_active, count(*) FILTER (WHERE kind = 'p') AS n_passive
FROM ev GROUP BY entity
HAVING count(*) FILTER (WHERE kind = 'a') > 33 AND count(*) FILTER (WHERE kind = 'p') > 33"""

ACTIVE_ENTITIES = f"WITH {ev_cte()} SELECT DISTINCT entity FROM ev WHERE kind = 'a'"

PAIR_COLS = "entity, e, activity, base, action, state, coalesce(next_state, -1) AS next_state"

STATE_ACTION_PAIRS = f"WITH {pairs_ctes('reference')} SELECT {PAIR_COLS} FROM pairs"
STATE_ACTION_PAIRS_PER_EVENT = f"WITH {pairs_ctes('per_event')} SELECT {PAIR_COLS} FROM pairs"

STATE_VISITS = f"""WITH {pairs_ctes()},
grid AS (SELECT entity, CAST(unnest(range(16)) AS INTEGER) AS state FROM (SELECT DISTINCT entity FROM pairs) e),
cnt AS (SELECT entity, state, count(*) AS visits FROM pairs GROUP BY entity, state)
SELECT grid.entity, grid.state, CAST(coalesce(cnt.visits, 0) AS BIGINT) AS visits
FROM grid LEFT JOIN cnt ON cnt.entity = grid.entity AND cnt.state = grid.state"""

TRAJECTORIES = f"""WITH {pairs_ctes()}
SELECT entity, max(n) AS n_events, max(traj_len) AS traj_len, max(n_traj) AS n_traj,
       count(*) FILTER (WHERE kept) AS kept_pairs, count(*) FILTER (WHERE NOT kept) AS rest_pairs
FROM pairs GROUP BY entity"""

TRAJECTORIES_LONG, TRAJECTORIES_LONG_ACCOUNTS = (f"""WITH {pairs_ctes(modulo=modulo)}
SELECT entity, e, traj_id, pos, state, action, CAST(kept AS INTEGER) AS kept FROM pairs""" for modulo in (5, None))

TRANSITION_COUNTS = f"""WITH {pairs_ctes()}
SELECT entity, state, action, next_state, count(*) AS n
FROM pairs WHERE next_state IS NOT NULL GROUP BY entity, state, action, next_state"""

TRANSITION_PROBABILITIES = f"""WITH {pairs_ctes()},
c AS (SELECT entity, state, action, next_state, count(*) AS n
      FROM pairs WHERE next_state IS NOT NULL GROUP BY entity, state, action, next_state)
SELECT entity, state, action, next_state, n,
       round(n / sum(n) OVER (PARTITION BY entity, state, action), 9) AS p
FROM c"""

START_DISTRIBUTION, START_DISTRIBUTION_ACCOUNTS = (f"""WITH {pairs_ctes(modulo=modulo)}
SELECT entity, state, round(count(*) / max(n_traj), 9) AS p
FROM pairs WHERE kept AND pos = 0 GROUP BY entity, state""" for modulo in (5, None))

STATE_VISITATION_FREQUENCY, STATE_VISITATION_FREQUENCY_ACCOUNTS = (f"""WITH {pairs_ctes(modulo=modulo)}
SELECT entity, state, round(count(*) / max(n_traj), 9) AS svf
FROM pairs WHERE kept GROUP BY entity, state""" for modulo in (5, None))


def _feature_expr(i: int) -> str:
    from ..schema import FEATURE_MATRIX

    vals = ", ".join(str(FEATURE_MATRIX[s][i]) for s in range(16))
    return f"[{vals}][state + 1]"


def _feature_expectations(modulo: int | None) -> str:
    from ..schema import FEATURE_NAMES

    sums = ",\n       ".join(f"sum({_feature_expr(i)}) AS f{i}" for i in range(6))
    parts = "\nUNION ALL ".join(
        f"SELECT entity, '{name}' AS feature, round(f{i} / t, 9) AS expectation FROM w" for i, name in enumerate(FEATURE_NAMES)
    )
    return f"""WITH {pairs_ctes(modulo=modulo)},
w AS (SELECT entity, max(n_traj) AS t,
       {sums}
      FROM pairs WHERE kept GROUP BY entity)
{parts}"""


FEATURE_EXPECTATIONS = _feature_expectations(5)

TRANSITION_COUNTS_LONG = f"""WITH {pairs_ctes(modulo=5)}
SELECT entity, state, action, next_state, count(*) AS n
FROM pairs WHERE next_state IS NOT NULL GROUP BY entity, state, action, next_state"""

SQL = {
    "event_timeline": EVENT_TIMELINE,
    "routed_timeline": EVENT_TIMELINE,
    "scored_timeline": SCORED_TIMELINE,
    "parsed_times": PARSED_TIMES,
    "entity_thresholds": ENTITY_THRESHOLDS,
    "active_entities": ACTIVE_ENTITIES,
    "state_action_pairs": STATE_ACTION_PAIRS,
    "state_action_pairs_per_event": STATE_ACTION_PAIRS_PER_EVENT,
    "state_visits": STATE_VISITS,
    "trajectories": TRAJECTORIES,
    "trajectories_long": TRAJECTORIES_LONG,
    "trajectories_accounts": TRAJECTORIES_LONG_ACCOUNTS,
    "start_distribution_accounts": START_DISTRIBUTION_ACCOUNTS,
    "state_visitation_accounts": STATE_VISITATION_FREQUENCY_ACCOUNTS,
    "feature_expectations_accounts": _feature_expectations(None),
    "transition_counts": TRANSITION_COUNTS,
    "transition_probabilities": TRANSITION_PROBABILITIES,
    "start_distribution": START_DISTRIBUTION,
    "state_visitation_frequency": STATE_VISITATION_FREQUENCY,
    "feature_expectations": FEATURE_EXPECTATIONS,
    # hot-entity splitting must not change results: same SQL as the plain queries
    "trajectories_long_split": TRAJECTORIES_LONG,
    "transition_counts_split": TRANSITION_COUNTS_LONG,
}
