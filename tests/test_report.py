"""Group statistics on the published per-account result file."""

import os

import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import report as O
from behaviorlens.sources import files

DATA = os.path.join(os.path.dirname(__file__), "data", "bots_results.csv")

# mean and standard error of the weights of the 72 published accounts
WEIGHTS = {
    "t": (2.878825, 4.532469), "p+": (0.248481, 0.367671), "p-": (-0.633432, 1.479986),
    "tw": (3.850945, 1.176170), "rt": (4.873573, 2.236584), "rp": (0.794891, 0.106037),
}
REWARDS = {
    "n_nt": (0.0, 0.0), "n_rp": (0.794891, 0.106037), "n_rt": (4.873573, 2.236584), "n_tw": (3.850945, 1.176170),
    "p-_nt": (-0.633432, 1.479986), "p-_rp": (0.161459, 1.490199), "p-_rt": (4.240141, 1.893419),
    "p-_tw": (3.217513, 2.002999), "p+_nt": (0.248481, 0.367671), "p+_rp": (1.043372, 0.379511),
    "p+_rt": (5.122054, 2.234120), "p+_tw": (4.099426, 1.256412), "t_nt": (2.878825, 4.532469),
    "t_rp": (3.673717, 4.532183), "t_rt": (7.752399, 4.134683), "t_tw": (6.729771, 5.174359),
}


@pytest.fixture(scope="module")
def results(spark):
    return files.read_results_csv(spark, DATA).withColumn("user_type", F.lit("bots")).cache()


def test_parse_counts(results):
    rows = results.collect()
    assert len(rows) == 72
    assert all(len(r["r"]) == 16 and len(r["w"]) == 6 and r["r"][0] == 0.0 for r in rows)


def test_reward_means_and_errors(results):
    stats = {r["pair"]: r for r in O.pair_stats(O.rewards_long(results.drop("w"))).collect()}
    for pair, (mean, se) in REWARDS.items():
        assert stats[pair]["mean"] == pytest.approx(mean, abs=1e-6)
        assert stats[pair]["stderr"] == pytest.approx(se, abs=1e-6)


def test_weight_means_closed(results):
    w = O.weight_means(O.weights_long(results.drop("r"))).collect()
    by = {(r["ordinal"], r["feature"]): r["mean"] for r in w}
    assert len(by) == 7 and by[(6, "t")] == by[(0, "t")]
    for i, (f, (mean, _)) in enumerate(WEIGHTS.items()):
        assert by[(i, f)] == pytest.approx(mean, abs=1e-6)


def test_heatmap_pivot(results):
    heat = O.heatmap(O.pair_stats(O.rewards_long(results.drop("w"))))
    piv = O.pivot(heat).collect()
    assert [r["State"] for r in piv] == ["n", "p+", "p-", "t"]
    assert piv[3]["tw"] == pytest.approx(6.730, abs=1e-9)


def test_reverse_and_wide(results):
    wide = O.reverse_columns(O.rewards_wide(results.select("entity", "r")))
    assert wide.columns[0] == "t_tw" and wide.columns[-1] == "entity"
