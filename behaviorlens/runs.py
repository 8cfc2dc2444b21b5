"""End-to-end runs of the three study entry points.

* ``infer_rewards``: eight role tables -> per-account rewards and weights (K1)
* ``distinctive_words``: two corpora (+ background) -> counts, scores, top-k
  word files (K2-K4)
* ``stance_scores``: word lists + labelled posts + posts -> stance tokens,
  classifier, per-post and per-author scores (K5, K6)

Each returns DataFrames and optionally writes the files; nothing is collected
to the driver except the bounded stance-token list.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import PLACEHOLDERS
from .operators import activity, logodds, rewards, stance, trajectories, transitions
from .schema import ACTIVE_THRESHOLD, EPOCHS, PASSIVE_THRESHOLD
from .session import stored
from .sources import files

#: Stance tokens that a model takes, a few lists of top words.
MAX_VOCABULARY = 100_000


def infer_rewards(
    tables: dict[str, DataFrame],
    out_path: str | None = None,
    fmt: str = "parquet",
    t_active: int = ACTIVE_THRESHOLD,
    t_passive: int = PASSIVE_THRESHOLD,
    action_rule: str = "reference",
    epochs: int = EPOCHS,
    checkpoint: bool = True,
    **sequence_kw,
) -> DataFrame:
    """Role tables to ``(screen_name, r, w)`` for every account passing the
    activity thresholds; written to ``out_path`` when given."""
    timeline = activity.build_timeline(tables)
    pairs = trajectories.state_action_pairs(
        timeline, action_rule=action_rule, t_active=t_active, t_passive=t_passive, **sequence_kw
    )
    fitted = rewards.fit_rewards(transitions.model_table(pairs), epochs=epochs, checkpoint=checkpoint)
    result = fitted.select(
        F.col("entity").alias("screen_name"), "r", rewards.weights_from_rewards(F.col("r")).alias("w")
    )
    if out_path:
        files.write_results(result, out_path, fmt=fmt)
    return result


def distinctive_words(
    corpus_i: DataFrame,
    corpus_j: DataFrame,
    background: DataFrame | None = None,
    out_dir: str | None = None,
    name_i: str = "i",
    name_j: str = "j",
    top_k: int = 10,
    **prep,
) -> dict[str, DataFrame]:
    """Log-odds scores of two corpora (each with a ``text`` column), with the
    vocabulary, score and top-k files of the original run when ``out_dir``
    is given: ``vocabs_{i,j,alpha}_<name_i>``, ``delta_/sigma_2_/z_scores_<name_i>``,
    ``top_words_<name_i>`` (top k) and ``top_words_<name_j>`` (bottom k)."""
    docs = logodds.corpus_table(corpus_i, corpus_j, background)
    on_undefined = prep.pop("on_undefined", "error")
    counted = stored(logodds.token_counts(docs, **prep))
    use_background = background is not None and not background.isEmpty()
    alpha = F.col("y_bg") if use_background else F.col("y_i") + F.col("y_j")
    scores = logodds.score_counts(counted, F.col("y_i"), F.col("y_j"), alpha, on_undefined)
    top = logodds.top_tokens(scores, top_k)
    bottom = logodds.top_tokens(scores, top_k, bottom=True)
    out = {"scores": scores, "top": top, "bottom": bottom}
    if out_dir:
        counts = scores.select("token", "y_i", "y_j", "alpha")
        files.write_counts(counts.where(F.col("y_i") > 0), os.path.join(out_dir, f"vocabs_i_{name_i}"), "y_i")
        files.write_counts(counts.where(F.col("y_j") > 0), os.path.join(out_dir, f"vocabs_j_{name_i}"), "y_j")
        # the whole prior, background-only tokens included
        prior = counted.select("token", alpha.alias("alpha")).where(F.col("alpha") > 0)
        files.write_counts(prior, os.path.join(out_dir, f"vocabs_alpha_{name_i}"), "alpha")
        for col, prefix in (("delta", "delta_"), ("sigma_2", "sigma_2_"), ("z", "z_scores_")):
            files.write_counts(scores, os.path.join(out_dir, f"{prefix}{name_i}"), col)
        files.write_words(top, os.path.join(out_dir, f"top_words_{name_i}"), single_file=True)
        files.write_words(bottom, os.path.join(out_dir, f"top_words_{name_j}"), single_file=True)
    return out


def stance_scores(
    word_lists: DataFrame,
    labelled: DataFrame,
    posts: DataFrame,
    out_dir: str | None = None,
    test_share: float = 0.3,
    classifier: str = "naive_bayes",
) -> dict[str, DataFrame]:
    """Stance tokens from word lists (column ``word``), a classifier trained on
    labelled posts (``labels`` 1/2/3, ``text``; remapped to 1 vs rest, hash
    split by text), scores for ``posts`` (``author_id``, ``body``).  The tokens
    travel through the driver: more than ``MAX_VOCABULARY`` are an error."""
    tokens = stance.stance_tokens(word_lists)
    # the token file holds the lists' own words; placeholders are added for the model
    own_placeholders = [r["word"] for r in word_lists.where(F.col("word").isin(PLACEHOLDERS)).select("word").distinct().collect()]
    listed = tokens.limit(MAX_VOCABULARY + 1).collect()
    if len(listed) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} stance tokens: pass the top words of the lists")
    vocabulary = sorted(r["token"] for r in listed)
    lab = labelled.select(
        "text", stance.remap_labels(F.col("labels")).alias("label"), stance.hash_split(F.col("text")).alias("split")
    )
    model = stance.train_classifier(lab.where(F.col("split") == "train"), vocabulary, classifier=classifier)
    test = stance.score_posts(model, lab.where(F.col("split") == "test").withColumnRenamed("text", "body"))
    acc = stance.accuracy(test.withColumn("prediction", stance.predictions_from_scores(F.col("stance_propaganda"))))
    raw = stance.score_posts(model, posts)
    by_author = stance.author_mean(raw)
    if out_dir:
        own = tokens.where(~F.col("token").isin(PLACEHOLDERS) | F.col("token").isin(own_placeholders))
        files.write_words(own, os.path.join(out_dir, "stance_tokens"))
        files.write_scores(raw, os.path.join(out_dir, "raw_predicted_stance"))
        files.write_scores(by_author, os.path.join(out_dir, "by_user_predicted_stance"))
    return {"tokens": tokens, "accuracy": acc, "scores": raw, "by_author": by_author}
