"""Oracle SQL for the report queries."""

from __future__ import annotations

from ..schema import FEATURE_NAMES, PANEL_P, PANEL_TN, PINV28, STATE_NAMES
from .sql_behavior import pairs_ctes


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v + "'" for v in row) + ")" for row in rows)


NAMES = f"names AS (SELECT * FROM (VALUES {_values([(s, n) for s, n in enumerate(STATE_NAMES)])}) t(state, pair))"
PANELS = "panel_dim AS (SELECT * FROM (VALUES {}) t(pair, panel, rank))".format(
    _values([(p, "tn", i) for i, p in enumerate(PANEL_TN)] + [(p, "p", i) for i, p in enumerate(PANEL_P)])
)
COEF = "coef AS (SELECT * FROM (VALUES {}) t(ordinal, feature, state, c))".format(
    _values([(i, f, s, float(PINV28[i][s])) for i, f in enumerate(FEATURE_NAMES) for s in range(16)])
)

REWARDS = f"""{pairs_ctes()},
rw AS (SELECT entity, state, sum(value) AS s FROM pairs GROUP BY entity, state),
{NAMES},
grid AS (SELECT entity, CAST(unnest(range(16)) AS INTEGER) AS state FROM (SELECT DISTINCT entity FROM pairs) e),
rl AS (
  SELECT grid.entity, grid.state, names.pair, coalesce(rw.s, 0.0) AS reward,
         CASE WHEN CAST(grid.entity AS BIGINT) % 2 = 0 THEN 'bots' ELSE 'users' END AS user_type
  FROM grid JOIN names ON names.state = grid.state
  LEFT JOIN rw ON rw.entity = grid.entity AND rw.state = grid.state),
stats AS (
  SELECT user_type, pair, count(reward) AS n, avg(reward) AS mean,
         stddev_samp(reward) / sqrt(count(reward)) AS stderr
  FROM rl GROUP BY user_type, pair)"""

REWARD_GROUP_COUNTS = f"WITH {REWARDS} SELECT user_type, count(DISTINCT entity) AS n FROM rl GROUP BY user_type"
REWARD_MEANS = f"WITH {REWARDS} SELECT user_type, pair, n, round(mean, 6) AS mean, round(stderr, 6) AS stderr FROM stats"
REWARD_PANELS = f"""WITH {REWARDS}, {PANELS}
SELECT user_type, panel, CAST(rank AS INTEGER) AS rank, stats.pair, round(mean, 6) AS mean, round(stderr, 6) AS stderr
FROM stats JOIN panel_dim ON panel_dim.pair = stats.pair"""
HEAT = """SELECT user_type, split_part(pair, '_', 1) AS State, split_part(pair, '_', 2) AS Action,
       round_even(mean * 1000.0, 0) / 1000.0 AS mean
FROM (SELECT user_type, pair, avg(CAST(round(reward * 100) AS BIGINT)) / 100.0 AS mean FROM rl GROUP BY user_type, pair) s"""
REWARD_HEATMAP = f"WITH {REWARDS} {HEAT}"
REWARD_PIVOT = f"""WITH {REWARDS}, heat AS ({HEAT})
SELECT user_type, State,
       first(mean) FILTER (WHERE Action = 'nt') AS nt, first(mean) FILTER (WHERE Action = 'rp') AS rp,
       first(mean) FILTER (WHERE Action = 'rt') AS rt, first(mean) FILTER (WHERE Action = 'tw') AS tw
FROM heat GROUP BY user_type, State"""
WEIGHT_MEANS = f"""WITH {REWARDS}, {COEF},
w AS (SELECT rl.entity, rl.user_type, coef.ordinal, coef.feature, sum(coef.c * rl.reward) / 28.0 AS weight
      FROM rl JOIN coef ON coef.state = rl.state GROUP BY rl.entity, rl.user_type, coef.ordinal, coef.feature),
w2 AS (SELECT user_type, ordinal, feature, weight FROM w
       UNION ALL SELECT user_type, 6, feature, weight FROM w WHERE ordinal = 0)
SELECT user_type, CAST(ordinal AS INTEGER) AS ordinal, feature, round(avg(weight), 6) AS mean
FROM w2 GROUP BY user_type, ordinal, feature"""
_WIDE = ", ".join(f"round(max(reward) FILTER (WHERE state = {s}), 6) AS \"{n}\"" for s, n in reversed(list(enumerate(STATE_NAMES))))
REWARD_TABLE_REVERSED = f"WITH {REWARDS} SELECT {_WIDE}, entity FROM rl GROUP BY entity"
ARRAY_TEXT_PARSE = f"WITH {REWARDS} SELECT entity, state AS idx, round(reward, 6) AS value FROM rl"

SQL = {
    "reward_group_counts": REWARD_GROUP_COUNTS,
    "reward_means": REWARD_MEANS,
    "reward_panels": REWARD_PANELS,
    "reward_heatmap": REWARD_HEATMAP,
    "reward_pivot": REWARD_PIVOT,
    "weight_means": WEIGHT_MEANS,
    "reward_table_reversed": REWARD_TABLE_REVERSED,
    "array_text_parse": ARRAY_TEXT_PARSE,
}
