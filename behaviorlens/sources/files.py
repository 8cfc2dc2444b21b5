"""File sources and sinks (S1-S8, K1-K6) and role routing.

CSV columns are read as text and selected by header name; numbers are
converted explicitly, so a cell that does not convert is an error (or counted)
and never a silent NULL.  Writers are plain DataFrame writers, so output is
written in parallel by the executors.  A CSV file with quoted line breaks
cannot be split and is read by one task: deliver large tables as many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_text
from ..operators.activity import routed_events
from ..operators.report import parse_array_text
from ..schema import ACTIVITY_RAW, ROLES

# --- S1: activity tables --------------------------------------------------------


#: Texts that stand for a missing number.
MISSING = ["", "nan", "none", "null", "<na>"]


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV file with a header, as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def integer_text(c: Column) -> Column:
    """Integer of its text: plain digits exactly, else a decimal form whose
    value is whole (``77.0``, ``1.53e+18``); NULL for other text."""
    plain = F.trim(c)
    decimal = plain.try_cast("decimal(38,6)")
    whole = F.when(decimal == F.floor(decimal), decimal.try_cast("long"))
    return F.coalesce(F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("long")), whole)


def missing_text(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(MISSING)


def named_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in order; fails on one that is not there."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def typed_activity(text: DataFrame) -> DataFrame:
    """Raw activity columns from text columns, by name.  A cell that is no
    integer where one is due fails the job with the column and the text."""
    text = named_columns(text, ACTIVITY_RAW.fieldNames())

    def typed(f: T.StructField) -> Column:
        c = F.col(f.name)
        if not isinstance(f.dataType, T.LongType):
            return c.alias(f.name)
        bad = F.raise_error(F.concat(F.lit(f"{f.name}: not an integer: "), c)).cast("long")
        return F.when(missing_text(c), F.lit(None).cast("long")).otherwise(F.coalesce(integer_text(c), bad)).alias(f.name)

    return text.select(*[typed(f) for f in ACTIVITY_RAW.fields])


def bad_cells(text: DataFrame) -> DataFrame:
    """(column, n) of integer cells of an activity table that do not convert."""
    integers = [f.name for f in ACTIVITY_RAW.fields if isinstance(f.dataType, T.LongType)]
    text = named_columns(text, integers)
    counts = text.agg(*[F.count_if(~missing_text(F.col(n)) & integer_text(F.col(n)).isNull()).alias(n) for n in integers])
    return counts.unpivot([], integers, "column", "n")


def read_activity_csv(spark: SparkSession, path: str) -> DataFrame:
    """One role table from CSV, columns by name."""
    return typed_activity(read_text_csv(spark, path))


def read_activity_tables(spark: SparkSession, base: str, user_type: str = "users", fmt: str = "csv") -> dict[str, DataFrame]:
    """The eight role tables ``{base}/{user_type}/df_{role}_{user_type}.{fmt}``
    (``user_type`` is ``bots``, ``users`` or ``all``)."""
    out = {}
    for name, *_ in ROLES:
        path = f"{base.rstrip('/')}/{user_type}/df_{name}_{user_type}.{fmt}"
        out[name] = read_activity_csv(spark, path) if fmt == "csv" else spark.read.schema(ACTIVITY_RAW).parquet(path)
    return out


def routed_posts(posts: DataFrame, accounts: DataFrame, stance_col: str = "stance") -> DataFrame:
    """Raw posts once for each role they play for an account of the set (S2):
    ``role`` and ``owner`` are added.

    Own posts (``screen_name`` in the set) are reposts, replies, mentions or
    original posts; posts of others that repost, reply to (by reply stance: 1
    supports, 2 opposes) or mention an account play the passive roles.  One
    scan, one row for each (role, owner), one left-semi join on the owner."""
    acc = accounts.select(F.col(accounts.columns[0]).cast("string").alias("_acc")).distinct()
    is_rt = F.col("user_retweeted").isNotNull()
    is_rp = F.col("in_reply_to_screen_name").isNotNull()
    is_m = F.col("mention").isNotNull()
    applies = {
        "tw_a": ~is_rt & ~is_rp & ~is_m,
        "rt_a": is_rt,
        "rp_a": is_rp,
        "m_a": is_m,
        "rt_s": is_rt,
        "rp_pro_s": is_rp & (F.col(stance_col) == 1),
        "rp_con_s": is_rp & (F.col(stance_col) == 2),
        "m_s": is_m,
    }
    roles = [F.when(applies[name], F.struct(F.lit(name).alias("role"), F.col(owner).alias("owner"))) for name, owner, *_ in ROLES]
    each = posts.withColumn("_r", F.explode(F.filter(F.array(*roles), lambda r: r.isNotNull() & r["owner"].isNotNull())))
    each = each.withColumns({"role": F.col("_r.role"), "owner": F.col("_r.owner")}).drop("_r")
    return each.join(acc, F.col("owner") == F.col("_acc"), "left_semi")


def stance_by_score(posts: DataFrame, scores: DataFrame, id_col: str = "id_str", score_col: str = "stance_propaganda", stance_col: str = "stance", cut: float = 0.5) -> DataFrame:
    """Posts with the stance of replies from a table of scored posts (S2): 1
    (supports) for a score above ``cut``, 2 (opposes) for others, NULL without a
    score.  Scores of one post are averaged; only replies take part in the
    join."""
    each = scores.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(score_col).alias("_score"))
    plain = posts.drop(stance_col)
    is_reply = F.col("in_reply_to_screen_name").isNotNull() & F.col(id_col).isNotNull()
    stance = F.when(F.col("_score") > cut, 1).when(F.col("_score").isNotNull(), 2)
    replies = plain.where(is_reply).join(each, F.col(id_col) == F.col("_id"), "left").withColumn(stance_col, stance).drop("_id", "_score")
    return replies.unionByName(plain.where(~is_reply).withColumn(stance_col, F.lit(None).cast("int")))


def route_posts(posts: DataFrame, accounts: DataFrame, stance_col: str = "stance") -> dict[str, DataFrame]:
    """The eight role tables of an account set (S2), as filters of one routed
    table; ``routed_timeline`` reads it once for all of them."""
    routed = routed_posts(posts, accounts, stance_col)
    return {name: routed.where(F.col("role") == name).select(*posts.columns) for name, *_ in ROLES}


def routed_timeline(posts: DataFrame, accounts: DataFrame, stance_col: str = "stance") -> DataFrame:
    """The event timeline of an account set from raw posts, in one pass."""
    routed = routed_posts(posts, accounts, stance_col)
    return routed_events(routed.withColumn("activity", F.create_map(*[F.lit(x) for name, _, code, _ in ROLES for x in (name, code)])[F.col("role")]))


# --- S3-S8: other inputs -------------------------------------------------------


def read_corpus(spark: SparkSession, path: str, column: str = "text_normalized") -> DataFrame:
    """Corpus CSV, one document per row, whitespace-stripped; rows without
    text are dropped (S3): ``corpus_rows`` counts them."""
    df = named_columns(read_text_csv(spark, path), [column])
    return df.select(strip_text(F.col(column)).alias("text")).where(F.col("text").isNotNull())


def corpus_rows(spark: SparkSession, path: str, column: str = "text_normalized") -> DataFrame:
    """(n, n_dropped): rows of a corpus file, and those without text."""
    df = named_columns(read_text_csv(spark, path), [column])
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("n_dropped"))


def read_labelled_posts(spark: SparkSession, path: str) -> DataFrame:
    """Labelled posts with the two used columns (S4); a label that is no
    integer fails the job."""
    df = named_columns(read_text_csv(spark, path), ["labels", "text"])
    bad = F.raise_error(F.concat(F.lit("labels: not an integer: "), F.col("labels"))).cast("long")
    label = F.when(missing_text(F.col("labels")), F.lit(None).cast("long")).otherwise(F.coalesce(integer_text(F.col("labels")), bad))
    return df.select(label.cast("int").alias("labels"), F.col("text"))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts to score, Parquet."""
    return spark.read.parquet(path)


def read_word_lists(spark: SparkSession, pattern: str) -> DataFrame:
    """All word-list files matching a glob, one word per line."""
    return spark.read.text(pattern).select(F.col("value").alias("word"))


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Result CSV with quoted multi-line array text (S7), parsed to arrays."""
    df = (
        spark.read.schema("screen_name string, r string, w string")
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return df.select(
        F.col("screen_name").alias("entity"),
        parse_array_text(F.col("r")).alias("r"),
        parse_array_text(F.col("w")).alias("w"),
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of integer ids, exact as bigint."""
    raw = spark.read.text(path, wholetext=True)
    ids = F.from_json(F.col("value"), T.ArrayType(T.LongType()))
    return raw.select(F.explode(ids).alias("id"))


# --- K1-K6: sinks -----------------------------------------------------------------


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Per-entity results (K1); CSV joins arrays with spaces in brackets."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    text = {c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), " "), F.lit("]")) for c in ("r", "w") if c in df.columns}
    df.withColumns(text).write.mode("overwrite").option("header", True).csv(path)


def write_counts(counts: DataFrame, path: str, value: str = "n") -> None:
    """Vocabulary ``token,count`` sorted by count descending (K2, K3)."""
    counts.select("token", value).orderBy(F.col(value).desc(), "token").write.mode("overwrite").csv(path)


def write_words(words: DataFrame, path: str, column: str = "token", single_file: bool = False) -> None:
    """One word per line, e.g. a top-k list (K4) or the stance tokens (K5).
    ``single_file`` is meant for bounded lists such as a top-k."""
    out = words.select(F.col(column).cast("string"))
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").text(path)


def top_words_name(corpus_path: str) -> str:
    """Output name of a corpus file: base name without extension and without
    the ``data_odds_`` prefix (K4)."""
    base = corpus_path.replace("\\", "/").split("/")[-1].split(".")[0]
    return base.replace("data_odds_", "")


def write_scores(df: DataFrame, path: str) -> None:
    """Raw or per-author scores (K6)."""
    df.write.mode("overwrite").parquet(path)
