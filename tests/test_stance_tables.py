"""The exact-vocabulary stance model against its definition."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import stance_tables as S

TRAIN = [("war tanks war", 1), ("tanks roll now", 1), ("peace talks now", 0), ("peace peace", 0), ("now", 0), (None, 1), ("", 0), ("lost", None)]
POSTS = [(1, "war now"), (2, "peace unseen"), (3, None), (4, ""), (4, "war now"), (None, "tanks tanks"), (5, "hawk")]
WORDS = ["war", "hawk", "@user"]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "text string, label int").repartition(3)


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in [*WORDS, "war"]], "token string")


@pytest.fixture(scope="module")
def posts(spark):
    df = spark.createDataFrame(POSTS, "author_id int, body string")
    return df.withColumns({"a.b": F.lit("kept"), "token": F.lit("t"), "weight": F.lit(9), "x": F.lit("x")})


def tokens(text):
    return (text or "").split()


def copies():
    seen = {t for text, label in TRAIN if label is not None for t in tokens(text)}
    return {t: (t in seen) + (t in WORDS) for t in seen | set(WORDS)}


def bayes():
    rows = [(tokens(t), y) for t, y in TRAIN if y is not None]
    n = {y: Counter(t for ts, label in rows if label == y for t in ts) for y in (0, 1)}
    c = copies()
    all_ = {y: sum(n[y][t] * k for t, k in c.items()) + sum(c.values()) for y in (0, 1)}
    w = {t: k * (math.log((n[1][t] + 1) / all_[1]) - math.log((n[0][t] + 1) / all_[0])) for t, k in c.items()}
    prior = math.log(sum(y == 1 for _, y in rows) + 1) - math.log(sum(y == 0 for _, y in rows) + 1)
    return lambda text: 1 / (1 + math.exp(-(prior + sum(w.get(t, 0) for t in tokens(text)))))


def test_counts_model_scores_by_definition(spark, train, words, posts):
    model = S.fit_counts(train, words)
    out = S.score_posts(model, posts)
    assert out.columns == ["author_id", "a.b", "token", "weight", "x", "stance_propaganda"]
    got = sorted((r["author_id"] or 0, round(r["stance_propaganda"], 9)) for r in out.collect())
    score = bayes()
    assert got == sorted((a or 0, round(score(t), 9)) for a, t in POSTS)


@pytest.mark.parametrize("frequent", [1, 3])
def test_joined_tokens_score_as_broadcast_ones(monkeypatch, train, words, posts, frequent):
    monkeypatch.setattr(S, "FREQUENT", frequent)
    got = sorted(round(r[0], 9) for r in S.score_posts(S.fit_counts(train, words), posts).select("stance_propaganda").collect())
    assert got == sorted(round(bayes()(t), 9) for _, t in POSTS)


def epochs_by_hand(n, rate):
    rows = [(tokens(t), y) for t, y in TRAIN if y is not None]
    c = copies()
    w, b = dict.fromkeys(c, 0.0), 0.0
    for _ in range(n):
        p = [1 / (1 + math.exp(-(b + sum(w[t] for t in ts) / max(1, len(ts))))) for ts, _ in rows]
        step = Counter()
        for (ts, y), q in zip(rows, p):
            for t in ts:
                step[t] += (y - q) / len(ts)
        w = {t: v + rate / len(rows) * step[t] * c[t] ** 2 for t, v in w.items()}
        b += rate / len(rows) * sum(y - q for (_, y), q in zip(rows, p))
    return w, b


def test_epochs_follow_the_gradient_and_end_at_the_plain_fit(spark, train, words):
    metrics = {"accuracy": S.accuracy_metric, "positives": lambda label, prediction, score: F.sum(prediction)}
    run = S.fit_epochs(train, words, epochs=3, rate=4.0, held_out=train, metrics=metrics)
    plain = S.fit_epochs(train, words, epochs=3, rate=4.0)
    assert plain.evaluation is None and len(run.models) == len(plain.models) == 3
    for k, model in enumerate(run.models, 1):
        w, b = epochs_by_hand(k, 4.0)
        got = {r["token"]: r["weight"] for r in model.weights.collect()}
        assert got == pytest.approx(w) and model.intercept == pytest.approx(b)
    assert {r["token"]: r["weight"] for r in plain.models[-1].weights.collect()} == pytest.approx({r["token"]: r["weight"] for r in run.models[-1].weights.collect()})
    rows = [r.asDict() for r in run.evaluation.orderBy("epoch").collect()]
    assert [r["epoch"] for r in rows] == [1, 2, 3] and all(r["n"] == 7 for r in rows)
    w, b = epochs_by_hand(3, 4.0)
    right = [((b + sum(w.get(t, 0) for t in tokens(text)) / max(1, len(tokens(text)))) > 0) == (y == 1) for text, y in TRAIN if y is not None]
    assert rows[-1]["accuracy"] == pytest.approx(sum(right) / 7)


def test_models_without_posts(spark, train, words, posts):
    none = train.limit(0)
    assert {r[0] for r in S.score_posts(S.fit_counts(none, words), posts).select("stance_propaganda").collect()} == {0.5}
    assert S.fit_epochs(none, words, held_out=train).evaluation is None
    assert S.score_posts(S.fit_counts(train, words), posts.limit(0)).count() == 0
    assert S.score_posts(S.fit_counts(train, words.limit(0)), posts).count() == len(POSTS)


def test_scoring_sums_occurrences(spark):
    """Sums by post are those of the counts, and take no exchange by post and token."""
    from behaviorlens.operators import stance_tables as T

    posts = spark.createDataFrame([(1, "war war peace"), (2, "peace"), (3, ""), (4, None), (5, "war unseen war war")], "i int, body string")
    held = T.numbered(posts, "body")
    for relative in (False, True):
        sums = [f(held, relative).groupBy("__post", "token").sum("x").collect() for f in (T.occurrences, T.post_counts)]
        a, b = ({(r[0], r[1]): round(r[2], 12) for r in rows} for rows in sums)
        assert a == b and a
    plan = T.occurrences(held, True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
