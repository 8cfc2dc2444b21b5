"""A stance model with an exact vocabulary, as tables.

Features are a post's tokens and, for tokens of the stance vocabulary, a
second feature of the same count: the stance block of B1 is a column
``copies`` of the token table (1, or 2 for a stance token that occurs in the
training posts), not a wider vector.  Nothing is hashed: each token has its own
row, and a model is a table (token, weight) with an intercept.

Two fits share that layout: ``fit_counts`` is multinomial naive Bayes, one
aggregation; ``fit_epochs`` is logistic regression by full-batch gradient
steps, whose table after each epoch is stored and, given held-out posts,
measured by aggregate columns that the caller passes.

Scoring joins post tokens to weights and sums by post.  Tokens that make up
one in ``FREQUENT`` of all training tokens or more, at most ``FREQUENT`` by
that, are broadcast; the others are joined by a shuffle in which no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .partitioning import spread
from .stance import post_tokens, predictions_from_scores

#: Tokens with at least this share (one in so many) of all training tokens.
FREQUENT = 10_000

Metric = Callable[[Column, Column, Column], Column]


def accuracy_metric(label: Column, prediction: Column, score: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


@dataclass
class TableModel:
    """``weights``: (token, weight, frequent), stored; a post's margin is
    ``intercept`` plus the sum of weight times value over its tokens.  Values are
    token counts, or counts over the post's length."""

    weights: DataFrame
    intercept: float
    relative: bool


@dataclass
class EpochRun:
    """``models`` after each epoch; ``evaluation``: (epoch, n, metrics...)."""

    models: list[TableModel]
    evaluation: DataFrame | None


def numbered(posts: DataFrame, text_col: str) -> DataFrame:
    """The posts, stored with a number and without their text, which has become
    an array of tokens.  Names of the helper columns begin with two
    underscores."""
    keep = [F.col(f"`{c}`") for c in posts.columns if c != text_col]
    tokens = F.coalesce(post_tokens(F.col(text_col)), F.array().cast("array<string>"))
    return stored(spread(posts).select(*keep, F.monotonically_increasing_id().alias("__post"), tokens.alias("__tokens")))


def post_counts(posts: DataFrame, relative: bool) -> DataFrame:
    """(__post, token, x) of numbered posts."""
    each = posts.select("__post", F.size("__tokens").alias("size"), F.explode("__tokens").alias("token"))
    counts = each.groupBy("__post", "size", "token").agg(F.count("*").cast("double").alias("x"))
    return counts.select("__post", "token", (F.col("x") / F.col("size") if relative else F.col("x")).alias("x"))


def occurrences(posts: DataFrame, relative: bool) -> DataFrame:
    """(__post, token, x) with a row for each occurrence, x adding up to that of
    ``post_counts``: for sums by post, which need no counts before."""
    each = posts.select("__post", F.size("__tokens").alias("size"), F.explode("__tokens").alias("token"))
    return each.select("__post", "token", (1.0 / F.col("size") if relative else F.lit(1.0)).alias("x"))


def vocabulary_table(posts: DataFrame, label_col: str, stance_words: DataFrame) -> DataFrame:
    """(token, n_1, n_0, copies, frequent) of the training posts' tokens and the
    stance words (a column ``token``)."""
    each = posts.select((F.col(label_col) == 1).alias("one"), F.explode("__tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count_if("one").alias("n_1"), F.count_if(~F.col("one")).alias("n_0"))
    both = counts.join(stance_words.select("token").distinct().withColumn("stance", F.lit(1)), "token", "full")
    both = stored(both.fillna({"n_1": 0, "n_0": 0, "stance": 0}))
    total = both.agg(F.sum(F.col("n_1") + F.col("n_0"))).first()[0] or 0
    n = F.col("n_1") + F.col("n_0")
    return both.select("token", "n_1", "n_0", ((n > 0).cast("int") + F.col("stance")).alias("copies"), ((n > 0) & (n * FREQUENT >= total)).alias("frequent"))


def fit_counts(posts: DataFrame, stance_words: DataFrame, text_col: str = "text", label_col: str = "label", smoothing: float = 1.0) -> TableModel:
    """Multinomial naive Bayes of class 1 against the rest; posts and classes
    are smoothed alike.  Without posts every score is one half."""
    held = numbered(posts.filter(F.col(label_col).isNotNull()), text_col)
    table = stored(vocabulary_table(held, label_col, stance_words))
    t = table.agg(*[F.coalesce(F.sum(F.col(c) * F.col("copies")), F.lit(0)).alias(c) for c in ("n_1", "n_0")], F.coalesce(F.sum("copies"), F.lit(0)).alias("features")).first()
    c = held.agg(F.count_if(F.col(label_col) == 1).alias("n_1"), F.count_if(F.col(label_col) != 1).alias("n_0")).first()
    all_1, all_0 = (t[k] + smoothing * t["features"] for k in ("n_1", "n_0"))

    def log_ratio(one: Column, zero: Column) -> Column:
        return F.log(one) - F.log(zero)

    weight = log_ratio((F.col("n_1") + smoothing) / F.lit(float(all_1)), (F.col("n_0") + smoothing) / F.lit(float(all_0))) * F.col("copies")
    intercept = held.sparkSession.range(1).select(log_ratio(F.lit(c["n_1"] + smoothing), F.lit(c["n_0"] + smoothing))).first()[0]
    return TableModel(stored(table.select("token", weight.alias("weight"), "frequent")), intercept, False)


def _by_token(features: DataFrame, table: DataFrame) -> DataFrame:
    """Features with the columns of a token table (token, ..., frequent), the
    frequent tokens' by broadcast, the others' by shuffle."""
    often = F.broadcast(table.filter("frequent"))
    rest = features.join(F.broadcast(table.filter("frequent").select("token")), "token", "left_anti")
    return features.join(often, "token").unionByName(rest.join(table.filter("not frequent"), "token"))


def _margins(posts: DataFrame, features: DataFrame, model: TableModel) -> DataFrame:
    """Numbered posts with their ``__margin``."""
    parts = _by_token(features, model.weights)
    sums = parts.groupBy("__post").agg(F.sum(F.col("x") * F.col("weight")).alias("__margin"))
    return posts.join(sums, "__post", "left").withColumn("__margin", F.coalesce("__margin", F.lit(0.0)) + F.lit(model.intercept))


def _probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def score_posts(model: TableModel, posts: DataFrame, text_col: str = "body", score_col: str = "stance_propaganda") -> DataFrame:
    """Every row of ``posts`` without its text, with the probability of class 1
    (B5, B6).  Tokens that training has not seen count nothing; a NULL or empty
    text has the intercept's probability."""
    held = numbered(posts, text_col)
    out = _margins(held, occurrences(held, model.relative), model)
    keep = [F.col(f"`{c}`") for c in posts.columns if c not in (text_col, score_col)]
    return out.select(*keep, _probability(F.col("__margin")).alias(score_col))


def evaluate(scored: DataFrame, label_col: str = "label", score_col: str = "__score", metrics: dict[str, Metric] | None = None) -> DataFrame:
    """(n, one column for each metric): each metric is an aggregate column of
    label, prediction and score."""
    score, label = F.col(score_col), F.col(label_col)
    given = metrics or {"accuracy": accuracy_metric}
    return scored.agg(F.count("*").alias("n"), *[f(label, predictions_from_scores(score), score).alias(name) for name, f in given.items()])


def fit_epochs(
    posts: DataFrame,
    stance_words: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    epochs: int = 3,
    rate: float = 50.0,
    held_out: DataFrame | None = None,
    metrics: dict[str, Metric] | None = None,
) -> EpochRun:
    """Logistic regression from zero weights, one full-batch step an epoch on
    the mean log-likelihood; a token's value is its share of the post's tokens,
    once for each of its copies.  Each epoch reads stored features twice (by
    token, by post) and stores its weights.  ``held_out`` posts (same columns)
    are measured after each epoch."""
    held = numbered(posts.filter(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text")), "text")
    n = held.count()
    features = stored(post_counts(held, True))
    weights = stored(vocabulary_table(held, "label", stance_words).select("token", F.lit(0.0).alias("weight"), "copies", "frequent"))
    if held_out is not None:
        test = numbered(held_out.filter(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text")), "text")
        test_features = stored(post_counts(test, True))
    models, measured = [TableModel(weights, 0.0, True)], []
    for epoch in range(1, epochs + 1) if n else ():
        now = models[-1]
        error = F.when(F.col("label") == 1, 1.0).otherwise(0.0) - _probability(F.col("__margin"))
        errors = stored(_margins(held, features, now).select("__post", error.alias("error")))
        steps = features.join(errors, "__post").groupBy("token").agg((F.sum(F.col("x") * F.col("error")) * F.lit(rate / n)).alias("step"))
        moved = now.weights.join(steps, "token", "left")
        # a weight is that of all copies, which move alike
        weight = F.col("weight") + F.coalesce("step", F.lit(0.0)) * F.col("copies") * F.col("copies")
        intercept = now.intercept + rate / n * errors.agg(F.sum("error")).first()[0]
        models.append(TableModel(stored(moved.select("token", weight.alias("weight"), "copies", "frequent")), intercept, True))
        if held_out is not None:
            scored = _margins(test, test_features, models[-1]).withColumn("__score", _probability(F.col("__margin")))
            measured.append(evaluate(scored, metrics=metrics).select(F.lit(epoch).alias("epoch"), "*"))
    evaluation = None
    for part in measured:
        evaluation = part if evaluation is None else evaluation.unionByName(part)
    return EpochRun(models[1:] or models, evaluation)
