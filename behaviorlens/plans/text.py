"""Registered queries of the text stages: preparation, log-odds, stance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_post, preprocess, tokenize_words
from ..operators import logodds, stance, stance_tables
from ..operators.partitioning import spread
from ..session import materialize
from ..sources import fixtures

TOP_K = 10


def docs(spark, sf_dir) -> DataFrame:
    return fixtures.labelled_documents(spark, sf_dir)


def toxic_flags(spark, sf_dir, background: bool) -> DataFrame:
    """Corpus i = toxic documents, j = labelled non-toxic ones, background =
    every document (when asked for)."""
    d = docs(spark, sf_dir)
    return d.select(
        "text",
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("in_i"),
        F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("in_j"),
        F.lit(background).alias("in_bg"),
    )


def stance_flags(spark, sf_dir, side: int) -> DataFrame:
    """Stance corpora: i = documents of stance ``side``, j = the other two."""
    d = docs(spark, sf_dir).withColumn("stance", fixtures.stance_label(F.col("quality"), F.col("toxic")))
    others = [s for s in (stance.SUPPORT, stance.OPPOSE, stance.NEITHER) if s != side]
    return d.select(
        "text",
        F.coalesce(F.col("stance") == side, F.lit(False)).alias("in_i"),
        F.coalesce(F.col("stance").isin(*others), F.lit(False)).alias("in_j"),
        F.lit(False).alias("in_bg"),
    )


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select(
        "token", "y_i", "y_j", "alpha",
        *[F.round(c, 6).alias(c) for c in ("delta", "sigma_2", "z")],
    )


def q_decontract_tokens(spark, sf_dir):
    toks = preprocess(F.col("text"))
    return spread(docs(spark, sf_dir)).select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, " ").alias("tokens")
    )


def q_word_tokens(spark, sf_dir):
    """The preparation with the default word tokenizer."""
    toks = preprocess(F.col("text"), tokenizer=tokenize_words)
    d = spread(fixtures.table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


def q_post_tokens(spark, sf_dir):
    """Posts without their text, with the tokens that the models read."""
    posts = spread(fixtures.table(spark, sf_dir, "conversations"))
    return posts.select("conv_id", "turn", F.array_join(stance.post_tokens(F.col("text")), " ").alias("tokens"))


def q_token_counts(spark, sf_dir):
    return logodds.token_counts(toxic_flags(spark, sf_dir, background=True))


def q_normalized_posts(spark, sf_dir):
    conv = spread(fixtures.table(spark, sf_dir, "conversations"))
    return conv.select("conv_id", "turn", normalize_post(F.col("text")).alias("text_normalized"))


def q_log_odds(spark, sf_dir):
    return _rounded(logodds.log_odds(toxic_flags(spark, sf_dir, False)))


def q_log_odds_background(spark, sf_dir):
    return _rounded(logodds.log_odds(toxic_flags(spark, sf_dir, True), background=True))


def q_log_odds_undefined(spark, sf_dir):
    """Prior from the documents of one source: tokens that lack in it and in
    one of the corpora have no score (L8)."""
    d = docs(spark, sf_dir).withColumn("in_bg", F.coalesce(F.col("source") == "src1", F.lit(False)))
    flags = d.select("text", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("in_i"), F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("in_j"), "in_bg")
    return _rounded(logodds.log_odds(flags, background=True, on_undefined="null"))


def _top(spark, sf_dir, bottom):
    t = logodds.top_tokens(logodds.log_odds(toxic_flags(spark, sf_dir, False)), TOP_K, bottom=bottom)
    return t.select("rank", "token", F.round("z", 6).alias("z"))


def q_log_odds_top(spark, sf_dir):
    return _top(spark, sf_dir, False)


def q_log_odds_bottom(spark, sf_dir):
    return _top(spark, sf_dir, True)


def stance_word_lists(spark, sf_dir) -> DataFrame:
    """The four top-word lists: support vs rest and oppose vs rest, top and
    bottom k of each, from one shared per-stance count table."""
    d = docs(spark, sf_dir).withColumn("stance", fixtures.stance_label(F.col("quality"), F.col("toxic")))
    sides = [stance.SUPPORT, stance.OPPOSE, stance.NEITHER]
    counts = materialize(logodds.label_token_counts(d, "stance", sides))  # shared by both runs
    parts = []
    for side in (stance.SUPPORT, stance.OPPOSE):
        rest = [F.col(f"y_{s}") for s in sides if s != side]
        scores = logodds.score_counts(counts, F.col(f"y_{side}"), rest[0] + rest[1])
        for bottom in (False, True):
            parts.append(logodds.top_tokens(scores, TOP_K, bottom=bottom).select(F.col("token").alias("word")))
    return reduce(DataFrame.unionByName, parts)


def q_stance_tokens(spark, sf_dir):
    return stance.stance_tokens(stance_word_lists(spark, sf_dir))


def labelled(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir).where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    code = fixtures.stance_label(F.col("quality"), F.col("toxic"))
    return d.withColumns({"labels": code, "label": stance.remap_labels(code)})


def q_stance_label_remap(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", F.col("labels").cast("long").alias("labels"), "label")


def q_stance_split(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "label", stance.hash_split(F.col("doc_id")).alias("split"))


def q_stance_author_mean(spark, sf_dir):
    posts = labelled(spark, sf_dir).select(
        F.col("source").alias("author_id"), F.col("quality").cast("double").alias("stance_propaganda")
    )
    return stance.author_mean(posts)


def q_stance_accuracy(spark, sf_dir):
    d = labelled(spark, sf_dir).select(
        stance.hash_split(F.col("doc_id")).alias("split"),
        "label",
        stance.predictions_from_scores(F.col("quality").cast("double")).alias("prediction"),
    )
    return stance.accuracy(d, by=["split"]).select("split", "n", F.round("accuracy", 9).alias("accuracy"))


def _model(spark, sf_dir):
    vocab = [r["token"] for r in q_stance_tokens(spark, sf_dir).collect()]  # at most 4k + 2 words
    lab = labelled(spark, sf_dir).withColumn("split", stance.hash_split(F.col("doc_id")))
    model = stance.train_classifier(lab.where(F.col("split") == "train"), sorted(vocab))
    return model, lab


def q_stance_model_scores(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    conv = fixtures.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("author_id"), "turn", F.col("text").alias("body")
    )
    return stance.author_mean(stance.score_posts(model, conv))


def q_stance_model_accuracy(spark, sf_dir):
    model, lab = _model(spark, sf_dir)
    test = lab.where(F.col("split") == "test").select("doc_id", "label", F.col("text").alias("body"))
    scored = stance.score_posts(model, test)
    pred = scored.withColumn("prediction", stance.predictions_from_scores(F.col("stance_propaganda")))
    return stance.accuracy(pred)


def split_documents(spark, sf_dir) -> DataFrame:
    return labelled(spark, sf_dir).withColumn("split", stance.hash_split(F.col("doc_id")))


def table_model(spark, sf_dir) -> stance_tables.TableModel:
    words = materialize(q_stance_tokens(spark, sf_dir))
    return stance_tables.fit_counts(split_documents(spark, sf_dir).where(F.col("split") == "train"), words)


def q_stance_table_scores(spark, sf_dir):
    """Score of every turn of the conversations by the exact-vocabulary model."""
    model = table_model(spark, sf_dir)
    conv = fixtures.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("body"))
    return stance_tables.score_posts(model, conv).withColumn("stance_propaganda", F.round("stance_propaganda", 6))


def q_stance_table_authors(spark, sf_dir):
    """Mean score of every source over all documents."""
    model = table_model(spark, sf_dir)
    posts = fixtures.table(spark, sf_dir, "documents").select(F.col("source").alias("author_id"), F.col("text").alias("body"))
    out = stance.author_mean(stance_tables.score_posts(model, posts))
    return out.withColumn("stance_propaganda", F.round("stance_propaganda", 6))


def q_stance_table_accuracy(spark, sf_dir):
    model = table_model(spark, sf_dir)
    test = split_documents(spark, sf_dir).where(F.col("split") == "test").select("label", F.col("text").alias("body"))
    out = stance_tables.evaluate(stance_tables.score_posts(model, test, score_col="score"), score_col="score")
    return out.withColumn("accuracy", F.round("accuracy", 9))


EPOCHS = 3


def log_loss(label, prediction, score):
    return -F.avg(F.log(F.when(label == 1, score).otherwise(1 - score)))


def q_stance_epochs(spark, sf_dir):
    """Held-out accuracy and mean log loss after each epoch."""
    lab = split_documents(spark, sf_dir)
    words = materialize(q_stance_tokens(spark, sf_dir))
    metrics = {"accuracy": stance_tables.accuracy_metric, "log_loss": log_loss}
    run = stance_tables.fit_epochs(lab.where(F.col("split") == "train"), words, epochs=EPOCHS, held_out=lab.where(F.col("split") == "test"), metrics=metrics)
    return run.evaluation.select("epoch", "n", F.round("accuracy", 9).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"))


QUERIES = {
    "decontract_tokens": q_decontract_tokens,
    "word_tokens": q_word_tokens,
    "post_tokens": q_post_tokens,
    "token_counts": q_token_counts,
    "normalized_posts": q_normalized_posts,
    "log_odds": q_log_odds,
    "log_odds_background": q_log_odds_background,
    "log_odds_undefined": q_log_odds_undefined,
    "log_odds_top": q_log_odds_top,
    "log_odds_bottom": q_log_odds_bottom,
    "stance_tokens": q_stance_tokens,
    "stance_label_remap": q_stance_label_remap,
    "stance_split": q_stance_split,
    "stance_author_mean": q_stance_author_mean,
    "stance_accuracy": q_stance_accuracy,
    "stance_model_scores": q_stance_model_scores,
    "stance_model_accuracy": q_stance_model_accuracy,
    "stance_table_scores": q_stance_table_scores,
    "stance_table_authors": q_stance_table_authors,
    "stance_table_accuracy": q_stance_table_accuracy,
    "stance_epochs": q_stance_epochs,
}
