"""Registered round trips of the file sources and sinks: what is written and
read back must be what was computed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity
from ..session import checkpoint_dir
from ..sources import files, fixtures
from . import behavior, report, text


def _folder(spark: SparkSession) -> str:
    """A new folder beside the shared checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def q_activity_csv_roundtrip(spark, sf_dir) -> DataFrame:
    """Role tables written as CSV with the columns in another order."""
    base = _folder(spark)
    tables = fixtures.role_tables_from_events(behavior.events(spark, sf_dir))
    for name, df in tables.items():
        df.select(*reversed(df.columns)).write.option("header", True).option("escape", '"').csv(f"{base}/users/df_{name}_users.csv")
    t = activity.build_timeline(files.read_activity_tables(spark, base, "users"))
    return t.withColumns({c: F.col(c).cast("double") for c in behavior.NULLABLE_COUNTERS})


def q_results_roundtrip(spark, sf_dir) -> DataFrame:
    """Result table as CSV with array text."""
    path = _folder(spark)
    files.write_results(report.results(spark, sf_dir).select(F.col("entity").alias("screen_name"), "r", "w"), path, fmt="csv")
    back = files.read_results_csv(spark, path)
    return back.select("entity", F.posexplode("r").alias("idx", "value")).select(
        "entity", F.col("idx").cast("int").alias("idx"), F.round("value", 6).alias("value")
    )


def q_vocabulary_roundtrip(spark, sf_dir) -> DataFrame:
    """K2, K3: vocabulary with counts."""
    path = _folder(spark)
    files.write_counts(text.q_token_counts(spark, sf_dir).where(F.col("y_bg") > 0), path, "y_bg")
    return spark.read.schema("token string, y_bg long").csv(path)


def q_top_words_roundtrip(spark, sf_dir) -> DataFrame:
    """A top-word list."""
    path = _folder(spark)
    files.write_words(text.q_log_odds_top(spark, sf_dir), path, single_file=True)
    return files.read_word_lists(spark, path)


def q_scores_roundtrip(spark, sf_dir) -> DataFrame:
    """Per-author scores."""
    path = _folder(spark)
    files.write_scores(text.q_stance_author_mean(spark, sf_dir), path)
    return files.read_posts(spark, path)


def q_corpus_roundtrip(spark, sf_dir) -> DataFrame:
    """S3: the documents as a corpus file, with blanks around the texts."""
    path = _folder(spark)
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("text_normalized"))
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_corpus(spark, path).select(F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


def q_labelled_roundtrip(spark, sf_dir) -> DataFrame:
    """Labelled posts, labels as a data-frame library writes them beside
    missing values."""
    path = _folder(spark)
    lab = text.labelled(spark, sf_dir).select(F.md5("text").alias("text"), F.col("labels").cast("double").alias("labels"), "doc_id")
    lab.write.option("header", True).option("escape", '"').csv(path)
    return files.read_labelled_posts(spark, path)


def q_id_list_roundtrip(spark, sf_dir) -> DataFrame:
    """Ids as JSON arrays, one file for each hundred thousand."""
    path = _folder(spark)
    ids = fixtures.table(spark, sf_dir, "events").select((F.col("event_id") + 1_530_101_424_356_347_904).alias("id"))
    arrays = ids.groupBy(F.floor(F.col("id") / 100_000)).agg(F.to_json(F.collect_list("id")).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return files.read_id_list(spark, path)


def q_scores_file_roundtrip(spark, sf_dir) -> DataFrame:
    """K3: z-scores as a file."""
    path = _folder(spark)
    files.write_counts(text.q_log_odds(spark, sf_dir), path, "z")
    return spark.read.schema("token string, z double").csv(path)


def q_stance_tokens_roundtrip(spark, sf_dir) -> DataFrame:
    """K5: the stance tokens as a word list."""
    path = _folder(spark)
    files.write_words(text.q_stance_tokens(spark, sf_dir), path)
    return files.read_word_lists(spark, path)


QUERIES = {
    "activity_csv_roundtrip": q_activity_csv_roundtrip,
    "results_roundtrip": q_results_roundtrip,
    "vocabulary_roundtrip": q_vocabulary_roundtrip,
    "top_words_roundtrip": q_top_words_roundtrip,
    "scores_roundtrip": q_scores_roundtrip,
    "corpus_roundtrip": q_corpus_roundtrip,
    "labelled_roundtrip": q_labelled_roundtrip,
    "id_list_roundtrip": q_id_list_roundtrip,
    "scores_file_roundtrip": q_scores_file_roundtrip,
    "stance_tokens_roundtrip": q_stance_tokens_roundtrip,
}
