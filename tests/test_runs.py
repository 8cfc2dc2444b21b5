"""End-to-end runs of the three entry points on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from behaviorlens import runs
from behaviorlens.sources import files, fixtures


def test_infer_rewards_writes_results(spark, tmpdir_path):
    events = fixtures.table(spark, "/root/testdata/sf0.001", "events")
    tables = fixtures.role_tables_from_events(events)
    out = os.path.join(tmpdir_path, "results")
    res = runs.infer_rewards(tables, out_path=out, fmt="csv", epochs=5)
    n = res.count()
    back = files.read_results_csv(spark, out)
    assert n > 0 and back.count() == n
    row = back.first()
    assert len(row["r"]) == 16 and len(row["w"]) == 6 and row["r"][0] == 0.0


def test_distinctive_words_files(spark, tmpdir_path):
    i = spark.createDataFrame([("war tanks tanks border",), ("tanks now",)], "text string")
    j = spark.createDataFrame([("peace talks",), ("peace peace now",)], "text string")
    out = runs.distinctive_words(i, j, out_dir=tmpdir_path, name_i="support", name_j="oppose", top_k=2)
    top = [r["value"] for r in spark.read.text(os.path.join(tmpdir_path, "top_words_support")).collect()]
    bottom = [r["value"] for r in spark.read.text(os.path.join(tmpdir_path, "top_words_oppose")).collect()]
    assert top[0] == "tanks" and bottom[0] == "peace"
    vocab = spark.read.csv(os.path.join(tmpdir_path, "vocabs_i_support")).collect()
    assert sorted((r[0], int(r[1])) for r in vocab)[-1] == ("war", 1)
    assert out["scores"].count() == 5  # "now" is a stop word


def test_stance_scores(spark, tmpdir_path):
    words = spark.createDataFrame([("war",), ("peace",)], "word string")
    labelled = spark.createDataFrame(
        [(1 if k % 2 else 2, ("war tanks" if k % 2 else "peace talks") + f" n{k}") for k in range(40)], "labels int, text string"
    )
    posts = spark.createDataFrame([("a", "war war"), ("b", "peace now")], "author_id string, body string")
    out = runs.stance_scores(words, labelled, posts, out_dir=tmpdir_path)
    by = {r["author_id"]: r["stance_propaganda"] for r in out["by_author"].collect()}
    assert by["a"] > 0.5 > by["b"]
    assert out["accuracy"].first()["accuracy"] == 1.0
    assert spark.read.parquet(os.path.join(tmpdir_path, "by_user_predicted_stance")).count() == 2


def test_prior_file_has_background_only_tokens(spark, tmpdir_path):
    i = spark.createDataFrame([("war tanks",)], "text string")
    j = spark.createDataFrame([("peace tanks",)], "text string")
    bg = spark.createDataFrame([("war tanks peace border border",)], "text string")
    runs.distinctive_words(i, j, bg, out_dir=tmpdir_path, name_i="a", name_j="b", top_k=1)
    prior = {r[0]: int(r[1]) for r in spark.read.csv(os.path.join(tmpdir_path, "vocabs_alpha_a")).collect()}
    assert prior == {"war": 1, "tanks": 1, "peace": 1, "border": 2}


def test_token_file_has_the_lists_words_only(spark, tmpdir_path):
    words = spark.createDataFrame([("war",), ("peace",)], "word string")
    labelled = spark.createDataFrame([(1 if k % 2 else 2, ("war" if k % 2 else "peace") + f" n{k}") for k in range(40)], "labels int, text string")
    posts = spark.createDataFrame([("a", "war")], "author_id string, body string")
    runs.stance_scores(words, labelled, posts, out_dir=tmpdir_path)
    assert sorted(r[0] for r in spark.read.text(os.path.join(tmpdir_path, "stance_tokens")).collect()) == ["peace", "war"]


def test_too_many_tokens_are_an_error(spark):
    words = spark.range(runs.MAX_VOCABULARY).select(F.concat(F.lit("w"), "id").alias("word"))
    none = spark.createDataFrame([], "labels int, text string, author_id string, body string")
    with pytest.raises(ValueError, match="stance tokens"):
        runs.stance_scores(words, none, none)
