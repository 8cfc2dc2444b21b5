"""Log-odds ratio with an informative Dirichlet prior.

Input is one document table with membership flags ``in_i``, ``in_j`` and
``in_bg`` so a document that belongs to several corpora (the background
usually holds both others) is tokenised once.  Counting is one exploded
partial aggregation on token.  The count table is read twice (totals and
scores), so its lineage is cut with a checkpoint in the shared checkpoint
folder: the corpus is tokenised once, and the four corpus totals are read as
one row and inlined as literals (no join, no repeated subquery).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preprocess
from ..session import materialize
from .partitioning import spread

UNDEFINED_MODES = ("error", "null")


def corpus_table(corpus_i: DataFrame, corpus_j: DataFrame, background: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Flagged document table from separate corpora (each with ``text_col``)."""

    def flagged(df, i, j, bg):
        return df.select(
            F.col(text_col).alias("text"), F.lit(i).alias("in_i"), F.lit(j).alias("in_j"), F.lit(bg).alias("in_bg")
        )

    out = flagged(corpus_i, True, False, False).unionByName(flagged(corpus_j, False, True, False))
    if background is not None:
        out = out.unionByName(flagged(background, False, False, True))
    return out


def token_counts(
    docs: DataFrame,
    lower_case: bool = True,
    rm_stopwords: bool = True,
    rm_punctuations: bool = True,
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Per-token counts ``y_i``, ``y_j``, ``y_bg`` (L1, T6): the full outer
    combination of the per-corpus word counts in one aggregation."""
    member = F.col("in_i") | F.col("in_j") | F.col("in_bg")
    toks = spread(docs.where(member)).select(
        "in_i", "in_j", "in_bg",
        F.explode(preprocess(F.col("text"), lower_case, rm_stopwords, rm_punctuations, tokenizer)).alias("token"),
    )
    return toks.groupBy("token").agg(
        F.count_if(F.col("in_i")).alias("y_i"),
        F.count_if(F.col("in_j")).alias("y_j"),
        F.count_if(F.col("in_bg")).alias("y_bg"),
    )


def log_odds(
    docs: DataFrame,
    background: bool = False,
    lower_case: bool = True,
    rm_stopwords: bool = True,
    rm_punctuations: bool = True,
    tokenizer: Callable[[Column], Column] | None = None,
    on_undefined: str = "error",
) -> DataFrame:
    """Per-token ``y_i, y_j, alpha, delta, sigma_2, z`` over the vocabulary of
    corpora i and j (L1-L8).

    alpha is the background count when ``background`` is set and the
    background has documents, else y_i + y_j."""
    counts = token_counts(docs, lower_case, rm_stopwords, rm_punctuations, tokenizer)
    alpha = None
    if background and not docs.where(F.col("in_bg")).isEmpty():  # stops at the first one
        alpha = F.col("y_bg")
    return score_counts(counts, F.col("y_i"), F.col("y_j"), alpha, on_undefined)


def score_counts(
    counts: DataFrame, y_i: Column, y_j: Column, alpha: Column | None = None, on_undefined: str = "error"
) -> DataFrame:
    """Scores from a per-token count table (L2-L8), so several corpus pairs can
    share one tokenising pass.  ``alpha`` defaults to y_i + y_j.

    delta uses base-10 logs.  A token whose smoothed count or complement is
    not positive is undefined: ``on_undefined='error'`` fails the job,
    ``'null'`` leaves NULL scores."""
    if on_undefined not in UNDEFINED_MODES:
        raise ValueError(f"on_undefined must be one of {UNDEFINED_MODES}")
    alpha = alpha if alpha is not None else y_i + y_j
    counts = materialize(counts.select("token", y_i.alias("y_i"), y_j.alias("y_j"), alpha.alias("alpha")))
    in_vocab = (F.col("y_i") > 0) | (F.col("y_j") > 0)
    totals = counts.agg(
        F.coalesce(F.sum("y_i"), F.lit(0)).alias("n_i"),
        F.coalesce(F.sum("y_j"), F.lit(0)).alias("n_j"),
        F.coalesce(F.sum("alpha"), F.lit(0)).alias("alpha_0"),
        F.count_if(in_vocab).alias("vocab_size"),
    ).first()
    vocab = counts.where(in_vocab).withColumns(
        {name: F.lit(int(totals[name])).cast("long") for name in ("n_i", "n_j", "alpha_0", "vocab_size")}
    )
    yi, yj, a = F.col("y_i"), F.col("y_j"), F.col("alpha")
    num_i, num_j = yi + a, yj + a
    den_i = F.col("n_i") + F.col("alpha_0") - yi - a
    den_j = F.col("n_j") + F.col("alpha_0") - yj - a
    undefined = (num_i <= 0) | (num_j <= 0) | (den_i <= 0) | (den_j <= 0)
    delta = F.log10(F.try_divide(num_i, den_i)) - F.log10(F.try_divide(num_j, den_j))
    sigma_2 = F.try_divide(F.lit(1.0), num_i) + F.try_divide(F.lit(1.0), num_j)
    fail = F.raise_error(F.concat(F.lit("log-odds undefined for token "), F.col("token")))

    def guard(c: Column) -> Column:
        bad = fail.cast("double") if on_undefined == "error" else F.lit(None).cast("double")
        return F.when(undefined, bad).otherwise(c)

    scored = vocab.withColumns({"delta": guard(delta), "sigma_2": guard(sigma_2)})
    scored = scored.withColumn("z", F.col("delta") / F.sqrt("sigma_2"))
    return scored.select("token", "y_i", "y_j", "alpha", "delta", "sigma_2", "z", "vocab_size")


def label_token_counts(docs: DataFrame, label_col: str, labels: list[int], **prep) -> DataFrame:
    """Per-token counts ``y_<label>`` for several labels in one tokenising
    pass and one aggregation."""
    toks = spread(docs.where(F.col(label_col).isin(labels))).select(
        label_col, F.explode(preprocess(F.col("text"), **prep)).alias("token")
    )
    return toks.groupBy("token").agg(*[F.count_if(F.col(label_col) == v).alias(f"y_{v}") for v in labels])


def top_tokens(scores: DataFrame, k: int = 10, bottom: bool = False) -> DataFrame:
    """Top-k (or bottom-k) tokens by z, ties broken by token (L9); undefined
    scores are not ranked.  Fails when k exceeds the vocabulary, an empty one
    included.  Plans as a bounded per-partition top-k."""
    order = [F.col("z").asc(), F.col("token").asc()] if bottom else [F.col("z").desc(), F.col("token").asc()]
    if "vocab_size" in scores.columns:  # carried from the one-row totals
        row = scores.select("vocab_size").first()
        vocab = row[0] if row else 0
    else:
        vocab = scores.count()
    if vocab < k:
        raise ValueError(f"top-k size {k} exceeds the vocabulary of {vocab} tokens")
    picked = scores.where(F.col("z").isNotNull()).orderBy(*order).limit(k)
    rank = F.row_number().over(Window.orderBy(*order))
    return picked.select(rank.cast("long").alias("rank"), "token", "z")
