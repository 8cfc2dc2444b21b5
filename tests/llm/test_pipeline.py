"""The corpus pipeline, stage by stage, against brute force on what the stage
before kept."""

import re
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_groups, brute_lines
from test_text_models import plain_grades

import corpus_pipeline
from behaviorlens.llm import decontaminate, ordinal, unigram
from behaviorlens.llm.common import table, written
from behaviorlens.llm.queries import GRADES, SENTENCEPIECE_MODEL, rated_documents
from behaviorlens.llm.url_filter import among

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Outputs of all stages, the input first."""
    out = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_and_whole_run(spark, stages):
    columns = stages[0].columns
    assert all(s.columns == columns for s in stages[:-1])
    assert stages[-1].columns == [*columns, "ids", "n_tokens"]
    assert corpus_pipeline.run(spark, SF).exceptAll(stages[-1]).count() == 0
    sizes = [s.count() for s in stages]
    assert sizes[0] > sizes[1] and sizes[1] == sizes[2] and sizes[2] > sizes[3] > sizes[4] == sizes[5] > 0


def test_quality_stage(spark, stages):
    """The fitted model's selection, computed by the definitions."""
    model = ordinal.train(stages[0], rated_documents(spark, SF), GRADES)
    top = {d: plain_grades(t, model)[1][-1] for d, t in rows(stages[0])}
    sure = {d for d, p in top.items() if abs(p - 0.6) > 1e-4}
    want = {d for d, p in top.items() if p >= 0.6}
    assert {d for d, _ in rows(stages[1])} & sure == want & sure and len(sure) > 0.99 * len(top)
    rated = {r.doc_id: r.grade for r in rated_documents(spark, SF).collect()}
    good = [d for d, g in rated.items() if g == 2]
    assert sum(d in want for d in good) > 0.95 * len(good)


def test_line_stage(stages):
    want = {d: text for d, (_, _, text) in brute_lines(rows(stages[1]), corpus_pipeline.LINE_DOCS, True).items()}
    assert dict(rows(stages[2])) == want
    assert stages[2].filter("n_chars <> length(text)").count() == 0


def test_near_duplicate_stage(stages):
    groups = brute_groups(rows(stages[2]), 5, 8, 10)
    assert {d for d, _ in rows(stages[3])} == {d for d, (_, c) in groups.items() if c == d}


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    matcher = decontaminate.Matcher(items, decontaminate.RATE, decontaminate.MIN_CHARS)
    before = dict(rows(stages[3]))
    assert {d for d, _ in rows(stages[4])} == {d for d, t in before.items() if not list(matcher.search(t))}
    exact = {d for d, t in before.items() if any(decontaminate.folded(i) in decontaminate.folded(t) for _, i in items)}
    assert exact and not exact & {d for d, _ in rows(stages[4])}


def test_decontamination_stage_by_full_tables(spark):
    """Against the whole edit table of every item and every document."""
    sf = "/root/testdata/sf0.001"
    items = [re.sub(r"[\W_]+", " ", r.text.lower()).strip() for r in table(spark, sf, "benchmark").collect()]
    docs = table(spark, sf, "documents").unionByName(table(spark, SF, "documents").filter("n_chars < 2500").orderBy("doc_id").limit(150), allowMissingColumns=True)
    width = max(map(len, items))
    pattern = np.full((len(items), width), -1, np.int32)
    for i, item in enumerate(items):
        pattern[i, : len(item)] = [ord(c) for c in item]
    last = np.array([len(x) for x in items])
    allowed = (0.08 * last).astype(int)
    steps = np.arange(width + 1, dtype=np.int32)

    def holds(text):
        column = np.tile(steps, (len(items), 1))
        for c in re.sub(r"[\W_]+", " ", text.lower()).strip():
            new = np.empty_like(column)
            new[:, 0] = 0
            new[:, 1:] = np.minimum(column[:, 1:] + 1, column[:, :-1] + (pattern != ord(c)))
            column = np.minimum.accumulate(new - steps, axis=1) + steps
            if (column[np.arange(len(items)), last] <= allowed).any():
                return True
        return False

    given = [(r.doc_id, r.text) for r in docs.collect()]
    leaky = {d for d, t in given if holds(t)}
    kept = {d for d, _ in rows(corpus_pipeline.drop_benchmark_copies(spark, docs, sf))}
    assert kept == {d for d, _ in given} - leaky and leaky and kept


def test_encoding_stage(spark, stages):
    model = unigram.read_model(spark, SENTENCEPIECE_MODEL)
    out = unigram.decode(stages[5], model)
    assert out.filter("decoded <> text or n_tokens <> size(ids)").count() == 0


def test_stages_on_odd_and_empty_inputs(spark):
    schema = table(spark, SF, "documents").schema
    odd = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "same\ntext", "en", "s", 9), (3, "same\ntext", "en", "s", 9), (None, "no id", "en", "s", 5)]
    for given in ([], odd):
        docs = spark.createDataFrame(given, schema).selectExpr("*", "'x' AS rep", "1 AS score")
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF))
        assert docs.columns == [*schema.fieldNames(), "rep", "score", "ids", "n_tokens"]
        assert (docs.count() > 0) == bool(given)


CLASHING = ["selected", "expected_grade", "p_top", "ids", "n_tokens", "__n_dropped", "__kept", "a.b", "column_0", "component_id", "item_id", "IDS_"]


def test_columns_of_any_name_pass_unchanged(spark):
    docs = table(spark, SF, "documents").select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in CLASHING])
    given = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
    assert docs.columns == [*given, "ids__", "n_tokens_"]
    wrong = [F.col(f"`{c}`") != F.concat(F.lit(f"{c} "), "doc_id") for c in CLASHING]
    assert docs.count() > 100 and docs.filter(reduce(lambda a, b: a | b, wrong)).count() == 0


def test_rows_without_given_ids(spark):
    """NULL and repeated ids as by an anti-join, which few kept rows reach."""
    rows = [(i, f"t{i}") for i in range(2000)] + [(5, "again"), (None, "none"), (-1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for ids in ([], [5], list(range(0, 2000, 50)) + [7_000_000]):
        gone = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        out = corpus_pipeline.without(docs, gone)
        assert out.columns == docs.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.join(gone, "doc_id", "left_anti").collect()))
    reached = docs.filter(among(written(gone), F.col("doc_id"))).count()
    assert 41 <= reached < 200
