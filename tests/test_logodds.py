"""Log-odds scores: symmetry, undefined tokens, top-k guard."""

import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import logodds as L

I_DOCS = ["war peace peace tanks", "tanks tanks border", "peace talks now"]
J_DOCS = ["peace peace peace", "talks talks border", "sanctions now now"]


def corpora(spark, swap=False, background=None):
    i = spark.createDataFrame([(t,) for t in (J_DOCS if swap else I_DOCS)], "text string")
    j = spark.createDataFrame([(t,) for t in (I_DOCS if swap else J_DOCS)], "text string")
    bg = None if background is None else spark.createDataFrame([(t,) for t in background], "text string")
    return L.corpus_table(i, j, bg)


def scores(df):
    return {r["token"]: r for r in df.collect()}


def test_z_antisymmetric(spark):
    a = scores(L.log_odds(corpora(spark)))
    b = scores(L.log_odds(corpora(spark, swap=True)))
    assert a.keys() == b.keys()
    for t in a:
        assert a[t]["z"] == pytest.approx(-b[t]["z"], abs=1e-12)


def test_counts_and_prior(spark):
    s = scores(L.log_odds(corpora(spark)))
    assert (s["peace"]["y_i"], s["peace"]["y_j"], s["peace"]["alpha"]) == (3, 3, 6)
    assert (s["tanks"]["y_i"], s["tanks"]["y_j"]) == (3, 0)


def test_background_prior_undefined(spark):
    df = L.log_odds(corpora(spark, background=["war only"]), background=True, on_undefined="null")
    s = scores(df)
    assert s["war"]["z"] is not None and s["tanks"]["z"] is None
    with pytest.raises(Exception):
        L.log_odds(corpora(spark, background=["war only"]), background=True).collect()


def test_top_k_guard_and_order(spark):
    sc = L.log_odds(corpora(spark))
    top = L.top_tokens(sc, 3).collect()
    zs = [r["z"] for r in top]
    assert zs == sorted(zs, reverse=True) and [r["rank"] for r in top] == [1, 2, 3]
    bottom = L.top_tokens(sc, 3, bottom=True).collect()
    assert [r["z"] for r in bottom] == sorted(r["z"] for r in bottom)
    with pytest.raises(Exception):
        L.top_tokens(sc, 1000).collect()


def test_undefined_scores_are_not_ranked(spark):
    scores = spark.createDataFrame([("zz", None), ("a", 1.0), ("b", -1.0)], "token string, z double")
    assert [r["token"] for r in L.top_tokens(scores, 2, bottom=True).collect()] == ["b", "a"]
    assert [r["token"] for r in L.top_tokens(scores, 3).collect()] == ["a", "b"]


def test_empty_vocabulary_fails(spark):
    none = spark.createDataFrame([], "token string, z double, vocab_size long")
    with pytest.raises(ValueError):
        L.top_tokens(none, 5)


@pytest.mark.parametrize("share", [0.0, 0.04, 0.25, 0.3, 1.0])
def test_split_share(spark, share):
    from behaviorlens.operators.stance import hash_split

    keys = spark.range(20000).select(hash_split(F.col("id"), share).alias("split"))
    n = keys.where("split = 'test'").count()
    assert abs(n / 20000 - share) < 0.012
    lost = spark.range(1).select(hash_split(F.lit(None).cast("string"), 1.0).alias("split"))
    assert lost.first()["split"] == "test"
