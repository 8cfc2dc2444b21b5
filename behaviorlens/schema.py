"""Schemas and the fixed constants of the behaviour model.

The decision model has 16 states and 4 actions.  A state is a pair
(base situation, action just taken): ``state = 4 * base + action``, so
``state % 4 == action`` always holds.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Raw activity table: one post, as exported per role (8 role tables).
ACTIVITY_RAW = T.StructType(
    [
        T.StructField("screen_name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("id_str", T.LongType()),
        T.StructField("user_statuses_count", T.LongType()),
        T.StructField("user_followers_count", T.LongType()),
        T.StructField("user_friends_count", T.LongType()),
        T.StructField("user_favourites_count", T.LongType()),
        T.StructField("user_retweeted", T.StringType()),
        T.StructField("retweet_id_str", T.LongType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("retweet_favorite_count", T.LongType()),
        T.StructField("retweet_reply_count", T.LongType()),
        T.StructField("user_retweeted_statuses_count", T.LongType()),
        T.StructField("user_retweeted_followers", T.LongType()),
        T.StructField("user_retweeted_friends", T.LongType()),
        T.StructField("user_retweeted_favourites_count", T.LongType()),
        T.StructField("mention", T.StringType()),
        T.StructField("in_reply_to_screen_name", T.StringType()),
        T.StructField("in_reply_to_status_id_str", T.LongType()),
    ]
)

# Normalised event: the common projection of all eight role tables.
EVENT_COLUMNS = [
    "entity",
    "time",
    "kind",
    "activity",
    "tweet_id",
    "post_id",
    "statuses",
    "followers",
    "friends",
    "favourites",
    "retweet_count",
    "tweet_likes",
    "reply",
]

# Total order of one entity's events.  Time first (missing times last),
# then active before passive, activity code, referenced tweet, own post id.
ORDER_COLUMNS = ["time", "kind", "activity", "tweet_id", "post_id"]
# Counters, the last keys where a table has them: rows that still tie are equal.
TIE_COLUMNS = ["statuses", "followers", "friends", "favourites", "retweet_count", "tweet_likes", "reply"]

# --- fixed values: activity codes per role table -------------------------
# role name, owner column, activity code, kind
ROLES = [
    ("tw_a", "screen_name", 1, "a"),  # original post by the account
    ("rt_a", "screen_name", 2, "a"),  # repost by the account
    ("rp_a", "screen_name", 3, "a"),  # reply by the account
    ("m_a", "screen_name", 4, "a"),  # mention written by the account
    ("rt_s", "user_retweeted", 5, "p"),  # the account got reposted
    ("rp_pro_s", "in_reply_to_screen_name", 6, "p"),  # got a supporting reply
    ("rp_con_s", "in_reply_to_screen_name", 7, "p"),  # got an opposing reply
    ("m_s", "mention", 8, "p"),  # the account was mentioned
]

# --- fixed values: state and action coding --------------------------------
BASE_NAMES = ["n", "p-", "p+", "t"]  # base codes 0..3
ACTION_NAMES = ["nt", "rp", "rt", "tw"]  # action codes 0..3
ACTION_NT, ACTION_RP, ACTION_RT, ACTION_TW = 0, 1, 2, 3
BASE_N, BASE_PNEG, BASE_PPOS, BASE_T = 0, 1, 2, 3
N_STATES = 16
N_ACTIONS = 4
STATE_NAMES = [f"{b}_{a}" for b in BASE_NAMES for a in ACTION_NAMES]

# Feature order of a state vector.
FEATURE_NAMES = ["t", "p+", "p-", "tw", "rt", "rp"]


def feature_row(state: int) -> list[int]:
    """6-bit feature vector of a state, order t, p+, p-, tw, rt, rp."""
    base, action = divmod(state, 4)
    return [
        int(base == BASE_T),
        int(base == BASE_PPOS),
        int(base == BASE_PNEG),
        int(action == ACTION_TW),
        int(action == ACTION_RT),
        int(action == ACTION_RP),
    ]


FEATURE_MATRIX = [feature_row(s) for s in range(N_STATES)]

# --- fixed values: 28 * pseudo-inverse of FEATURE_MATRIX ---------------------
# rows t, p+, p-, tw, rt, rp; columns states 0..15.  w = PINV28 @ r / 28.
PINV28 = [
    [0, -4, -4, -4, 3, -1, -1, -1, 3, -1, -1, -1, 10, 6, 6, 6],
    [0, -4, -4, -4, 3, -1, -1, -1, 10, 6, 6, 6, 3, -1, -1, -1],
    [0, -4, -4, -4, 10, 6, 6, 6, 3, -1, -1, -1, 3, -1, -1, -1],
    [0, 3, 3, 10, -4, -1, -1, 6, -4, -1, -1, 6, -4, -1, -1, 6],
    [0, 3, 10, 3, -4, -1, 6, -1, -4, -1, 6, -1, -4, -1, 6, -1],
    [0, 10, 3, 3, -4, 6, -1, -1, -4, 6, -1, -1, -4, 6, -1, -1],
]

# --- fixed values: model parameters ----------------------------------------
DISCOUNT = 0.9
EPOCHS = 1000
LEARNING_RATE = 0.01
VALUE_THRESHOLD = 1e-2
DEFAULT_TRAJECTORY_LENGTH = 100
ACTIVE_THRESHOLD = 5  # strict: n_active > 5
PASSIVE_THRESHOLD = 5  # strict: n_passive > 5

# --- fixed values: report panels ---------------------------------------------
PANEL_TN = ["t_tw", "n_tw", "t_rt", "n_rt", "t_rp", "n_rp", "t_nt", "n_nt"]
PANEL_P = ["p+_tw", "p-_tw", "p+_rt", "p-_rt", "p+_rp", "p-_rp", "p+_nt", "p-_nt"]

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("r", T.ArrayType(T.DoubleType())),
        T.StructField("w", T.ArrayType(T.DoubleType())),
    ]
)
