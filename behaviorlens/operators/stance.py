"""Stance labels, splits, stance tokens and a distributed stance classifier
(P13-P16, B1-B7).

The classifier is a Spark ML pipeline (hashed term frequencies, IDF, a fixed
stance-token vocabulary block, naive Bayes or logistic regression): training
and scoring are distributed; only the short stance-token list (top-k words)
reaches the driver.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDERS, strip_text, tokenize
from ..session import stored
from .partitioning import spread

SUPPORT, OPPOSE, NEITHER = 1, 2, 3


def remap_labels(labels: Column) -> Column:
    """Oppose (2) and neither (3) become 0; support stays 1."""
    return F.when(labels.isin(OPPOSE, NEITHER), F.lit(0)).otherwise(labels).cast("long")


SPLIT_BUCKETS = 10_000


def split_bucket(key: Column) -> Column:
    """Deterministic bucket below ``SPLIT_BUCKETS`` of a key from its MD5
    digest: the first 16 bits give the tenth, the next 16 the place in it.  A
    NULL key has the bucket of an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))

    def part(start: int, size: int) -> Column:
        return F.conv(F.substring(digest, start, 4), 16, 10).cast("int") % size

    return part(1, 10) * (SPLIT_BUCKETS // 10) + part(5, SPLIT_BUCKETS // 10)


def hash_split(key: Column, test_share: float = 0.3) -> Column:
    """'test' for about ``test_share`` of the keys, else 'train' (P16)."""
    cut = round(test_share * SPLIT_BUCKETS)
    return F.when(split_bucket(key) < cut, F.lit("test")).otherwise(F.lit("train"))


def random_split(df: DataFrame, test_share: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Seeded random split, the unseeded original's distributed analogue."""
    train, test = df.randomSplit([1.0 - test_share, test_share], seed=seed)
    return train, test


def stance_tokens(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Distinct words of the top-word lists, newline-stripped, plus the two
    placeholders (P15)."""
    spark = words.sparkSession
    listed = words.select(F.regexp_replace(F.col(word_col), "[\r\n]", "").alias("token"))
    extra = spark.createDataFrame([(w,) for w in PLACEHOLDERS], "token string")
    return listed.unionByName(extra).distinct()


def post_tokens(text: Column) -> Column:
    return tokenize(F.lower(strip_text(text)))


CLASSIFIERS = ("naive_bayes", "logistic")


def train_classifier(
    labelled: DataFrame,
    vocabulary: list[str],
    text_col: str = "text",
    label_col: str = "label",
    num_features: int = 1 << 18,
    classifier: str = "naive_bayes",
    max_iter: int = 30,
    reg_param: float = 0.01,
) -> PipelineModel:
    """Fit the stance pipeline (B1-B3): hashed TF-IDF plus a count block over
    the stance-token vocabulary, then a binary classifier (1 vs rest).  Tokens
    that hash to one of ``num_features`` buckets share its weight: take several
    times the corpus's distinct tokens.

    The posts are tokenised once, into a stored table that the document
    frequencies and the training read.  ``naive_bayes`` (multinomial) trains in
    one aggregation pass over the features; ``logistic`` runs one distributed
    pass per optimiser step, with the feature table persisted for those passes
    and released afterwards."""
    if classifier not in CLASSIFIERS:
        raise ValueError(f"classifier must be one of {CLASSIFIERS}")
    data = stored(
        spread(labelled).select(
            post_tokens(F.col(text_col)).alias("tokens"), F.col(label_col).cast("double").alias("label")
        )
    )
    featurizer = Pipeline(
        stages=[
            HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
            IDF(inputCol="tf", outputCol="tfidf"),
            CountVectorizerModel.from_vocabulary(vocabulary, inputCol="tokens", outputCol="stance_tf"),
            VectorAssembler(inputCols=["tfidf", "stance_tf"], outputCol="features"),
        ]
    ).fit(data)
    features = featurizer.transform(data).select("features", "label")
    if classifier == "naive_bayes":
        model = NaiveBayes(featuresCol="features", labelCol="label", modelType="multinomial", smoothing=1.0).fit(features)
        return PipelineModel(stages=featurizer.stages + [model])
    features = features.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg_param).fit(features)
    finally:
        features.unpersist()
    return PipelineModel(stages=featurizer.stages + [model])


def score_posts(model: PipelineModel, posts: DataFrame, text_col: str = "body") -> DataFrame:
    """Probability of class 1 for every post as ``stance_propaganda`` (B5, B6):
    the score is a column of the same row; the text column is dropped."""
    tokens = spread(posts).withColumn("tokens", post_tokens(F.col(text_col)))
    out = model.transform(tokens)
    keep = [c for c in posts.columns if c != text_col]
    return out.select(*keep, vector_to_array(F.col("probability")).getItem(1).alias("stance_propaganda"))


def score_with_predictor(
    posts: DataFrame,
    make_predict_fn,
    text_col: str = "body",
    batch_size: int = 256,
) -> DataFrame:
    """Score posts with a user-supplied model (B5): ``make_predict_fn()``
    returns a function from a NumPy array of texts to a NumPy array of class-1
    probabilities.  Runs in Arrow batches on the executors; the model is built
    once per Python worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    score = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size)
    keep = [c for c in posts.columns if c != text_col]
    return spread(posts).select(*keep, score(F.col(text_col)).alias("stance_propaganda"))


def author_mean(scores: DataFrame, author_col: str = "author_id", score_col: str = "stance_propaganda") -> DataFrame:
    """Mean score per author (B7); rows without an author are dropped."""
    return (
        scores.where(F.col(author_col).isNotNull())
        .groupBy(author_col)
        .agg(F.avg(score_col).alias(score_col))
    )


def predictions_from_scores(score: Column) -> Column:
    """Arg-max over (1 - score, score): class 1 only when score > 0.5."""
    return F.when(score > 0.5, F.lit(1)).otherwise(F.lit(0)).cast("long")


def accuracy(df: DataFrame, prediction_col: str = "prediction", label_col: str = "label", by: list[str] | None = None) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = (F.col(prediction_col).cast("double") == F.col(label_col).cast("double")).cast("double")
    grouped = df.groupBy(*(by or []))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
