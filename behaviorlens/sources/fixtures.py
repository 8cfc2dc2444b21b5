"""Mapping of the shared test tables onto the behaviour model.

``events`` stands in for the eight activity tables:

* entity = ``user_id`` (or ``user_id % m`` for longer sequences)
* activity = ``event_id % 8 + 1``; kind ``a`` for 1..4, ``p`` otherwise
* statuses = ``floor(value)`` for activities 1..5, else 0
* referenced post = ``event_id + 1``, none (0) for mentions
* reposted post counter = ``props.k``

``documents`` + ``labels`` stand in for the corpora and the labelled posts;
``conversations`` for the posts to score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.activity import utc_time
from ..schema import ACTIVITY_RAW, EVENT_COLUMNS, ROLES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _activity() -> Column:
    return (F.col("event_id") % 8 + 1).cast("int")


def _entity(modulo: int | None) -> Column:
    uid = F.col("user_id") if modulo is None else F.col("user_id") % modulo
    return uid.cast("string")


def role_tables_from_events(events: DataFrame, modulo: int | None = None) -> dict[str, DataFrame]:
    """The eight raw role tables (``ACTIVITY_RAW`` layout) made from ``events``."""
    act = _activity()
    ent = _entity(modulo)
    created = F.date_format(utc_time(events, "ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    statuses = F.floor(F.col("value")).cast("long")
    post = (F.col("event_id") + 1).cast("long")
    k = F.get_json_object(F.col("props"), "$.k").cast("long")
    out = {}
    for name, owner, code, _ in ROLES:
        cols = {f.name: F.lit(None).cast(f.dataType) for f in ACTIVITY_RAW.fields}
        cols["created_at"] = created
        # own post id: event_id + 1 for own posts, the event id otherwise
        cols["id_str"] = post if code <= 4 else F.col("event_id").cast("long")
        cols[owner] = ent
        if code <= 4:
            cols["user_statuses_count"] = statuses
        elif code == 5:
            cols["retweet_id_str"] = post
            cols["user_retweeted_statuses_count"] = statuses
            cols["retweet_count"] = k
        elif code in (6, 7):
            cols["in_reply_to_status_id_str"] = post
        sel = [cols[f.name].alias(f.name) for f in ACTIVITY_RAW.fields]
        out[name] = events.where(act == code).select(*sel)
    return out


def posts_from_events(events: DataFrame) -> DataFrame:
    """The same rows as the role tables in one raw post table, with the reply
    stance that routes replies (1 supports, 2 opposes).  A post by an account
    carries the mark of its kind with an owner outside of any account set."""
    act = _activity()
    ent, other = _entity(None), F.lit("someone else")
    post = (F.col("event_id") + 1).cast("long")
    statuses = F.floor(F.col("value")).cast("long")
    cols = {f.name: F.lit(None).cast(f.dataType) for f in ACTIVITY_RAW.fields}
    cols |= {
        "created_at": F.date_format(utc_time(events, "ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "id_str": F.when(act <= 4, post).otherwise(F.col("event_id").cast("long")),
        "screen_name": F.when(act <= 4, ent),
        "user_retweeted": F.when(act == 2, other).when(act == 5, ent),
        "in_reply_to_screen_name": F.when(act == 3, other).when(act.isin(6, 7), ent),
        "mention": F.when(act == 4, other).when(act == 8, ent),
        "user_statuses_count": F.when(act <= 4, statuses),
        "retweet_id_str": F.when(act == 5, post),
        "user_retweeted_statuses_count": F.when(act == 5, statuses),
        "retweet_count": F.when(act == 5, F.get_json_object(F.col("props"), "$.k").cast("long")),
        "in_reply_to_status_id_str": F.when(act.isin(6, 7), post),
    }
    return events.select(*[cols[f.name].alias(f.name) for f in ACTIVITY_RAW.fields], F.when(act == 6, 1).when(act == 7, 2).alias("stance"))


def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_str, body) of the replies among the events' posts; a reply's text is
    that of the document whose id is the event's, counted round."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.max("doc_id") + 1).first()[0] or 1
    replies = table(spark, sf_dir, "events").where(_activity().isin(6, 7))
    bodies = docs.select((F.col("doc_id")).alias("_doc"), F.col("text").alias("body"))
    return replies.select(F.col("event_id").cast("long").alias("id_str"), (F.col("event_id") % n).alias("_doc")).join(bodies, "_doc").drop("_doc")


def time_texts(events: DataFrame) -> DataFrame:
    """(event_id, created_at): the events' times as text, the form changing
    from one event to the next."""
    ts = utc_time(events, "ts")
    whole = F.date_trunc("second", ts).cast("timestamp_ntz")
    seconds = F.unix_seconds(F.to_timestamp(F.concat(whole.cast("string"), F.lit("Z"))))
    forms = [
        ts.cast("string"),
        F.date_format(whole, "EEE MMM dd HH:mm:ss '+0000' yyyy"),
        F.date_format(whole, "EEE, d MMM yyyy HH:mm:ss 'GMT'"),
        F.date_format(whole, "M/d/yyyy H:mm:ss"),
        F.date_format(whole, "M/d/yyyy h:mm:ss a"),
        seconds.cast("string"),
        (seconds * 1000).cast("string"),
        F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
    ]
    return events.select("event_id", F.get(F.array(*forms), (F.col("event_id") % len(forms)).cast("int")).alias("created_at"))


def timeline_from_events(events: DataFrame, modulo: int | None = None, extra: list[str] | None = None) -> DataFrame:
    """The event timeline in one projection of ``events`` (same rows as the
    role-table route, one scan).  ``extra`` columns of ``events`` are kept."""
    act = _activity()
    active = act <= 4
    statuses = F.when(act <= 5, F.floor(F.col("value"))).otherwise(F.lit(0)).cast("long")
    cols = {
        "entity": _entity(modulo),
        "time": utc_time(events, "ts"),
        "kind": F.when(active, F.lit("a")).otherwise(F.lit("p")),
        "activity": act,
        "tweet_id": F.when(act == 8, F.lit(0)).otherwise(F.col("event_id") + 1).cast("long"),
        "post_id": F.when(active, F.col("event_id") + 1).otherwise(F.col("event_id")).cast("long"),
        "statuses": statuses,
        "followers": F.when(act <= 5, F.lit(None)).otherwise(F.lit(0)).cast("long"),
        "friends": F.when(act <= 5, F.lit(None)).otherwise(F.lit(0)).cast("long"),
        "favourites": F.when(act <= 5, F.lit(None)).otherwise(F.lit(0)).cast("long"),
        "retweet_count": F.when(act == 5, F.get_json_object(F.col("props"), "$.k").cast("long")).otherwise(F.lit(0)).cast("long"),
        "tweet_likes": F.when(act == 5, F.lit(None)).otherwise(F.lit(0)).cast("long"),
        "reply": F.when(act == 5, F.lit(None)).otherwise(F.lit(0)).cast("long"),
    }
    sel = [cols[c].alias(c) for c in EVENT_COLUMNS] + [F.col(c) for c in (extra or [])]
    return events.where(F.col("user_id").isNotNull()).select(*sel)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels (left join: unlabelled rows keep NULLs)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


def stance_label(quality: Column, toxic: Column) -> Column:
    """Stance code 0..3 of a labelled document: quality + 2 * toxic
    (1 support, 2 oppose, 3 neither)."""
    return (quality + 2 * toxic).cast("int")
