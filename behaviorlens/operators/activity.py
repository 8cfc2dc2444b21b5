"""Activity tables to one normalised event timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import literal_map
from ..schema import ACTIVE_THRESHOLD, EVENT_COLUMNS, PASSIVE_THRESHOLD, ROLES


#: An offset or zone at the end of an ISO time.
OFFSET = r"[0-9:]\s*(?:Z|UTC|GMT|[+-]\d{1,2}(?::?\d{2})?)\s*$"


def utc(instant: Column) -> Column:
    """Zone-free UTC time of an instant, whatever the session's zone."""
    seconds = (F.unix_micros(instant).cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


# --- fixed values: offsets of the zone names that mail dates may carry
MAIL_ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def _shifted(local: Column, zone: str) -> Column:
    return local if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def _iso(c: Column, zone: str) -> Column:
    return F.when(c.rlike(OFFSET) & c.contains(":"), utc(F.try_to_timestamp(c))).otherwise(_shifted(c.try_cast("timestamp_ntz"), zone))


def _classic(c: Column, zone: str) -> Column:
    """``EEE MMM dd HH:mm:ss Z yyyy`` with the weekday cut off."""
    return utc(F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")))


def _mail(c: Column, zone: str) -> Column:
    """``EEE, d MMM yyyy HH:mm[:ss] Z`` of mail headers, weekday and seconds
    optional, offset or zone name."""
    text = F.trim(F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", ""))
    zones = r" ([A-Z]{2,3})$"
    offset = F.element_at(literal_map(MAIL_ZONES), F.regexp_extract(text, zones, 1))
    text = F.coalesce(F.concat(F.regexp_replace(text, zones, " "), offset), text)
    return utc(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm[:ss] Z")))


def _slashed(c: Column, zone: str) -> Column:
    """``M/d/yyyy``, with or without a time of 24 or of 12 hours."""
    text = F.concat(F.trim(c), F.lit(" +0000"))
    forms = ["M/d/yyyy H:mm[:ss][.SSSSSS] Z", "M/d/yyyy h:mm[:ss] a Z", "M/d/yyyy Z"]
    return _shifted(F.when(c.contains("/"), F.coalesce(*[utc(F.try_to_timestamp(text, F.lit(f))) for f in forms])), zone)


def _epoch(c: Column, zone: str) -> Column:
    """Seconds, milli- or microseconds since 1970, told apart by their digits."""
    text = F.trim(c)
    number = F.when(text.rlike(r"^-?[0-9]{9,17}$"), text.try_cast("long"))
    digits = F.length(F.ltrim(text, F.lit("-")))
    micros = F.when(digits <= 11, number * 1_000_000).when(digits <= 14, number * 1000).otherwise(number)
    return utc(F.timestamp_micros(micros))


#: Forms of time texts in the order in which they are tried.
TIME_FORMATS = {"iso": _iso, "classic": _classic, "mail": _mail, "slashed": _slashed, "epoch": _epoch}


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def parse_time(c: Column | str, zone: str = "UTC") -> Column:
    """Event time in UTC from text (P2), by the first of ``TIME_FORMATS`` that
    gives one.  Text without an offset is a time of ``zone``.  The result is
    zone-free and does not depend on the session's zone; text of another form
    gives NULL."""
    return F.coalesce(*[parse(_text(c), zone) for parse in TIME_FORMATS.values()])


def time_format(c: Column | str, zone: str = "UTC") -> Column:
    """Name of the form that ``parse_time`` reads a text by; NULL if none."""
    return F.coalesce(*[F.when(parse(_text(c), zone).isNotNull(), F.lit(name)) for name, parse in TIME_FORMATS.items()])


def time_formats(df: DataFrame, column: str = "created_at") -> DataFrame:
    """(format, n) of the texts of a column; format is NULL for unread ones."""
    return df.where(F.col(column).isNotNull()).groupBy(time_format(column).alias("format")).agg(F.count("*").alias("n"))


def unparsed_times(df: DataFrame, column: str = "created_at") -> DataFrame:
    """(n_unparsed, n): texts that give no time, and all texts."""
    text = F.col(column).isNotNull()
    return df.agg(F.count_if(text & parse_time(column).isNull()).alias("n_unparsed"), F.count_if(text).alias("n"))


def utc_time(df: DataFrame, column: str) -> Column:
    """A time column in zone-free UTC: instants converted, text parsed."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return utc(F.col(column))
    return F.col(column) if isinstance(kind, T.TimestampNTZType) else parse_time(column)


def _zero() -> Column:
    return F.lit(0).cast("long")


def role_events(df: DataFrame, activity: int) -> DataFrame:
    """Rows of one role table as events of its owner (P1 + P3-P6, P8)."""
    role = next(r for r in ROLES if r[2] == activity)
    _, owner, act, kind = role
    time = utc_time(df, "created_at" if "created_at" in df.columns else "time")
    base = {
        "entity": F.col(owner).cast("string"),
        "time": time,
        "kind": F.lit(kind),
        "activity": F.lit(act).cast("int"),
        "post_id": F.col("id_str").cast("long"),
    }
    if act <= 4:  # own post: own counters, no engagement counts
        extra = {
            "tweet_id": F.col("id_str").cast("long"),
            "statuses": F.col("user_statuses_count").cast("long"),
            "followers": F.col("user_followers_count").cast("long"),
            "friends": F.col("user_friends_count").cast("long"),
            "favourites": F.col("user_favourites_count").cast("long"),
            "retweet_count": _zero(),
            "tweet_likes": _zero(),
            "reply": _zero(),
        }
    elif act == 5:  # reposted: the reposted post and its author's counters
        extra = {
            "tweet_id": F.col("retweet_id_str").cast("long"),
            "statuses": F.col("user_retweeted_statuses_count").cast("long"),
            "followers": F.col("user_retweeted_followers").cast("long"),
            "friends": F.col("user_retweeted_friends").cast("long"),
            "favourites": F.col("user_retweeted_favourites_count").cast("long"),
            "retweet_count": F.col("retweet_count").cast("long"),
            "tweet_likes": F.col("retweet_favorite_count").cast("long"),
            "reply": F.col("retweet_reply_count").cast("long"),
        }
    else:  # replies (6, 7) keep the replied post id; mentions (8) have none
        extra = {
            "tweet_id": F.col("in_reply_to_status_id_str").cast("long") if act in (6, 7) else _zero(),
            "statuses": _zero(),
            "followers": _zero(),
            "friends": _zero(),
            "favourites": _zero(),
            "retweet_count": _zero(),
            "tweet_likes": _zero(),
            "reply": _zero(),
        }
    cols = {**base, **extra}
    return df.where(F.col(owner).isNotNull()).select(*[cols[c].alias(c) for c in EVENT_COLUMNS])


def routed_events(routed: DataFrame) -> DataFrame:
    """Events of posts with their ``owner`` and ``activity`` code, in one
    projection: the same columns as ``role_events`` of each role."""
    act = F.col("activity")
    own = act <= 4

    def pick(of_own: str, of_repost: str) -> Column:
        return F.when(own, F.col(of_own)).when(act == 5, F.col(of_repost)).otherwise(_zero()).cast("long")

    def engagement(c: str) -> Column:
        return F.when(act == 5, F.col(c)).otherwise(_zero()).cast("long")

    reply = F.when(act.isin(6, 7), F.col("in_reply_to_status_id_str")).otherwise(_zero())
    cols = {
        "entity": F.col("owner").cast("string"),
        "time": utc_time(routed, "created_at"),
        "kind": F.when(own, F.lit("a")).otherwise(F.lit("p")),
        "activity": act.cast("int"),
        "tweet_id": F.when(own, F.col("id_str")).when(act == 5, F.col("retweet_id_str")).otherwise(reply).cast("long"),
        "post_id": F.col("id_str").cast("long"),
        "statuses": pick("user_statuses_count", "user_retweeted_statuses_count"),
        "followers": pick("user_followers_count", "user_retweeted_followers"),
        "friends": pick("user_friends_count", "user_retweeted_friends"),
        "favourites": pick("user_favourites_count", "user_retweeted_favourites_count"),
        "retweet_count": engagement("retweet_count"),
        "tweet_likes": engagement("retweet_favorite_count"),
        "reply": engagement("retweet_reply_count"),
    }
    return routed.select(*[cols[c].alias(c) for c in EVENT_COLUMNS])


def build_timeline(tables: dict[str, DataFrame]) -> DataFrame:
    """Union all (no dedup) of the role tables as events.

    ``tables`` maps role names (``tw_a`` ... ``m_s``) to raw tables; missing
    roles contribute nothing.  Ordering is not global: consumers order per
    entity through a window."""
    parts = [role_events(tables[name], act) for name, _, act, _ in ROLES if name in tables]
    if not parts:
        raise ValueError("no role tables given")
    return reduce(DataFrame.unionByName, parts)


def active_entities(timeline: DataFrame) -> DataFrame:
    """Distinct accounts with at least one own activity."""
    return timeline.where(F.col("kind") == "a").select("entity").distinct()


def activity_counts(timeline: DataFrame) -> DataFrame:
    """Per-entity active and passive event counts (partial aggregation)."""
    return timeline.groupBy("entity").agg(
        F.count_if(F.col("kind") == "a").alias("n_active"),
        F.count_if(F.col("kind") == "p").alias("n_passive"),
    )


def entity_thresholds(
    timeline: DataFrame, t_active: int = ACTIVE_THRESHOLD, t_passive: int = PASSIVE_THRESHOLD
) -> DataFrame:
    """Entities passing the activity threshold (P12): strictly more than
    ``t_active`` own activities and strictly more than ``t_passive`` received."""
    return activity_counts(timeline).where(
        (F.col("n_active") > t_active) & (F.col("n_passive") > t_passive)
    )
