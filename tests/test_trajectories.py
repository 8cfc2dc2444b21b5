"""Hand-written timelines for the pair, action and trajectory rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import trajectories as J
from behaviorlens.operators import transitions as TR
from behaviorlens.plans import behavior

SCHEMA = (
    "entity string, time timestamp_ntz, kind string, activity int, tweet_id bigint, post_id bigint, statuses bigint"
)


def timeline(spark, acts, statuses=None, entity="u"):
    t0 = datetime(2024, 1, 1)
    statuses = statuses or [None] * len(acts)
    rows = [
        (entity, t0 + timedelta(minutes=i), "a" if a <= 4 else "p", a, 1000 + i, 1000 + i, s)
        for i, (a, s) in enumerate(zip(acts, statuses))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def states(spark, acts, rule="reference", statuses=None, **kw):
    p = J.state_action_pairs(timeline(spark, acts, statuses), action_rule=rule, t_active=-1, t_passive=-1, **kw)
    return [r["state"] for r in p.orderBy("e").collect()]


def test_original_first(spark):
    s = states(spark, [1, 5, 6, 7, 8, 1])
    assert [x // 4 for x in s] == [0, 3, 2, 1, 2]  # bases n, t, p+, p-, p+
    assert s[0] % 4 == 3  # original post -> tw


def test_retweet_first_reference_rule(spark):
    # every later non-original event repeats the first event's repost action
    assert states(spark, [2, 5, 3, 6, 1]) == [2, 14, 2, 10]


def test_retweet_first_per_event_rule(spark):
    assert states(spark, [2, 5, 3, 6, 1], rule="per_event") == [2, 12, 1, 8]


def test_reply_first_gives_rp(spark):
    assert [x % 4 for x in states(spark, [4, 5, 2, 1])] == [1, 1, 1]


def test_state_first_only_tw_or_nt(spark):
    s = states(spark, [5, 2, 6, 2, 1], statuses=[1, 3, 0, 0, 0])
    assert all(x % 4 in (0, 3) for x in s)


@pytest.mark.parametrize("counts,action", [((10, 12), 3), ((10, 10), 0), ((None, 12), 0)])
def test_statuses_jump_equal_null(spark, counts, action):
    assert states(spark, [5, 1], statuses=list(counts)) == [12 + action]


@pytest.mark.parametrize("n,length,kept_traj", [(100, 99, 1), (101, 100, 1), (102, 100, 1), (201, 100, 2)])
def test_trajectory_split(spark, n, length, kept_traj):
    acts = [1 if i % 2 else 5 for i in range(n)]
    p = J.state_action_pairs(timeline(spark, acts), t_active=-1, t_passive=-1)
    row = J.trajectory_summary(p).first()
    assert row["traj_len"] == length and row["n_traj"] == kept_traj
    assert row["kept_pairs"] == length * kept_traj
    assert row["kept_pairs"] + row["rest_pairs"] == n - 1


@pytest.mark.parametrize("n_a,n_p,passes", [(5, 6, False), (6, 5, False), (6, 6, True)])
def test_thresholds_strict(spark, n_a, n_p, passes):
    acts = [1] * n_a + [5] * n_p
    p = J.state_action_pairs(timeline(spark, acts))
    assert (p.count() > 0) == passes


def test_properties(spark):
    p = behavior.pairs(spark, "/root/testdata/sf0.01")
    assert p.where(F.col("state") % 4 != F.col("action")).count() == 0
    tp = TR.transition_probabilities(p)
    sums = tp.groupBy("entity", "state", "action").agg(F.sum("p").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    visits = J.state_visits(p).groupBy("entity").agg(F.sum("visits").alias("v"))
    sizes = p.groupBy("entity").agg((F.max("n") - 1).alias("m"))
    assert visits.join(sizes, "entity").where(F.col("v") != F.col("m")).count() == 0


@pytest.mark.parametrize("modulo", [None, 5])
def test_hot_entities_split_same_result(spark, modulo):
    """Splitting hot entities into time buckets changes nothing in the output."""
    sf = "/root/testdata/sf0.01"
    cols = ["entity", "e", "n", "state", "action", "next_state", "traj_id", "pos", "kept"]
    plain = behavior.pairs(spark, sf, modulo=modulo).select(*cols)
    split = behavior.pairs(spark, sf, modulo=modulo, hot_rows=20, rows_per_bucket=7).select(*cols)
    assert plain.count() == split.count()
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


T0 = datetime(2024, 1, 1)
SPANS = {
    "burst at the end": [T0 + timedelta(minutes=i) for i in range(500)] + [T0 + timedelta(minutes=495, seconds=i // 2) for i in range(500)],
    "one second": [T0 + timedelta(microseconds=900 * i) for i in range(1000)],
    "no times": [None] * 600 + [T0 + timedelta(minutes=i) for i in range(400)],
    "burst in a long span": [T0 + timedelta(days=i) for i in range(300)] + [T0 + timedelta(days=150, milliseconds=i) for i in range(700)],
    "one time": [T0] * 1000,
}


@pytest.mark.parametrize("name", SPANS)
@pytest.mark.parametrize("copies", [1, 2])
def test_buckets_balance_and_change_nothing(spark, name, copies):
    """Repeated rows included: the next row of an equal one is its copy."""
    from behaviorlens.operators.sequence import EntitySequence

    rows = [("u", t, "a" if i % 2 else "p", 1 if i % 2 else 5, i // 3, 3000 - i, i) for i, t in enumerate(SPANS[name])] * copies
    rows += [("small", T0, "a", 1, 1, 1, 1), (None, T0, "a", 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    seq = EntitySequence(df, hot_rows=100, rows_per_bucket=100)
    sizes = [r["count"] for r in seq.buckets.groupBy("_b").count().collect()]
    assert sum(sizes) == 1000 * copies and max(sizes) <= 200
    ask = {"first": ["activity"], "ahead": {"statuses": 2, "activity": 1}, "counts": {"n_active": F.col("kind") == "a"}}
    split = seq.annotate(**ask)
    plain = EntitySequence(df, hot_rows=None).annotate(**ask).select(*split.columns)
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_heavy_entities_by_sketch_or_by_list(spark):
    from behaviorlens.operators.sequence import EntitySequence, heavy_entities

    df = timeline(spark, [1, 5] * 40).unionByName(timeline(spark, [1, 5, 6], entity="v"))
    assert heavy_entities(df, hot_rows=50) == [("u", 80)]
    assert heavy_entities(df, hot_rows=80) == [] and heavy_entities(df.limit(0), hot_rows=0) == []
    assert EntitySequence(df).buckets is None
    assert EntitySequence(df, heavy=[("v", 3)], rows_per_bucket=1).buckets.count() == 3


def test_many_heavy_entities_are_split_too(spark, monkeypatch):
    """More heavy entities than a list of literals holds."""
    from behaviorlens.operators import sequence

    monkeypatch.setattr(sequence, "LISTED_ENTITIES", 3)
    rows = [(f"u{i}", t, "a", 1, t) for i in range(12) for t in range(40 if i < 8 else 5)] + [(None, 1, "a", 1, 1)] * 30
    df = spark.createDataFrame(rows, "entity string, time int, kind string, activity int, tweet_id int")
    kw = {"order": ["time"], "rows_per_bucket": 10}
    split = sequence.EntitySequence(df, hot_rows=20, **kw)
    assert split.buckets is not None and split.buckets.select("entity").distinct().count() == 8
    assert split.buckets.groupBy("_b").count().agg({"count": "max"}).first()[0] <= 40
    plain = sequence.EntitySequence(df, hot_rows=None, **kw)
    args = {"first": ["time"], "ahead": {"time": 2}}
    a, b = (sorted(map(tuple, s.annotate(**args).where("entity IS NOT NULL").collect())) for s in (split, plain))
    assert a == b or sorted(map(repr, a)) == sorted(map(repr, b))


def test_small_buckets_take_few_tasks(spark):
    """Buckets far smaller than a task's rows stay that small, but share files."""
    from behaviorlens.operators.sequence import EntitySequence
    from behaviorlens.session import default_parallelism

    df = spark.range(2400).selectExpr(
        "CAST(id % 3 AS string) AS entity", "CAST(id DIV 2 AS int) AS time", "IF(id % 2 = 0, 'a', 'p') AS kind",
        "CAST(id % 8 + 1 AS int) AS activity", "id AS tweet_id", "id AS post_id", "id AS statuses",
    )
    seq = EntitySequence(df, hot_rows=50, rows_per_bucket=4)
    sizes = [r["count"] for r in seq.buckets.groupBy("entity", "_b").count().collect()]
    assert sum(sizes) == 2400 and max(sizes) <= 4
    assert len(seq.buckets.inputFiles()) <= 2 * default_parallelism(spark) + 4
    ask = {"first": ["activity"], "ahead": {"statuses": 2, "activity": 1}, "counts": {"n_active": F.col("kind") == "a"}}
    split = seq.annotate(**ask)
    plain = EntitySequence(df, hot_rows=None).annotate(**ask).select(*split.columns)
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0
