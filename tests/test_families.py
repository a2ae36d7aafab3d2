"""Families, picks and blocks on small fixtures; queries with SQL are compared in test_census."""

import numpy as np
import pytest

from persistra.operators import blocks, families


def greedy(rows, quota):
    """(key, y) rows picked one by one, over all rows every time."""
    rows = sorted(rows)
    mid = float(np.median([y for _, y in rows]))
    picked = []
    while rows and len(picked) < quota:
        score = (lambda y: -abs(y - mid)) if not picked else (lambda y: min(abs(y - p) for _, p in picked))
        best = max(rows, key=lambda r: (score(r[1]), -r[0]))
        picked.append(best)
        rows.remove(best)
    return picked


def test_farthest_pick_is_greedy(spark):
    rng = np.random.default_rng(5)
    groups = {g: [(int(i), float(y)) for i, y in enumerate(rng.integers(0, most, n) / 4)] for g, (n, most) in enumerate([(40, 30), (6, 3), (1, 1), (9, 1)])}
    rows = [(g, k, y) for g, r in groups.items() for k, y in r] + [(0, 99, None)]
    got = families.farthest_pick(spark.createDataFrame(rows, "g long, k long, y double"), ["g"], "k", "y", 8).collect()
    for g, r in groups.items():
        assert [(x.k, x.y) for x in sorted((x for x in got if x.g == g), key=lambda x: x.pick)] == greedy(r, 8)


def test_bursty_times_do_not_depend_on_the_blocks(spark, monkeypatch):
    whole = [r.t for r in families.times(spark, 500, "bursty", seed=3).orderBy("i").collect()]
    monkeypatch.setattr(families, "BLOCK", 7)
    assert [r.t for r in families.times(spark, 500, "bursty", seed=3).orderBy("i").collect()] == pytest.approx(whole, abs=1e-12)
    assert whole == sorted(whole) and whole[0] == 0 and 0.99 < whole[-1] < 1
    assert families.times(spark, 1, "bursty").first().t == 0.5 and families.times(spark, 0, "bursty").count() == 0
    with pytest.raises(ValueError, match="uniform or bursty"):
        families.times(spark, 3, "regular")


def test_event_counts_keep_the_share_of_single_dyads(spark):
    m = np.array([r.m for r in families.event_counts(spark.range(20000), "id", 1).collect()])
    assert abs((m == 1).mean() - families.P_SINGLE) < 0.02 and m.min() == 1 and 2.5 < np.median(m[m > 1]) < 3.5


def test_candidates_fall_back_to_nearest_pairs(spark):
    pairs = spark.createDataFrame([("a", "b", 0.01, 0.1), ("a", "c", 0.02, 0.3), ("b", "c", 0.5, 0.9)], "a string, b string, delta double, gap double")
    pick = lambda least: [(r.a, r.b) for r in families.near_profile_candidates(pairs, "delta", "gap", ["a", "b"], least=least).collect()]
    assert pick(2) == [("a", "c"), ("a", "b")] and pick(3) == [("a", "b"), ("a", "c"), ("b", "c")]


LOG = "g long, pos int, kind int, node string, u string, v string, t double, dt double, w int"


def test_walk_summary_of_a_walk_with_a_restart(spark):
    rows = [
        (0, 1, 0, "a", None, None, None, None, None), (0, 2, 1, "b", "a", "b", 0.1, None, 0), (0, 3, 1, "a", "a", "b", 0.9, 0.8, 4),
        (0, 4, 1, "c", "a", "c", 0.5, -0.4, 2), (0, 5, 1, "a", "a", "c", 0.5, 0.0, 2), (1, 1, 0, "z", None, None, None, None, None),
    ]
    got = {(r.g, r.budget): r for r in blocks.walk_checkpoints(spark.createDataFrame(rows, LOG), ["g"], [1, 3, 5, 6]).collect()}
    assert set(got) == {(0, 1), (0, 3), (0, 5), (1, 1)}
    r = got[0, 5]
    assert (r.n_observed_events, r.n_restarts, r.unique_nodes, r.unique_edges, r.observed_deg_max) == (4, 1, 3, 2, 2)
    assert (r.edge_revisit_rate, r.discovery_rate_first_half, r.discovery_rate_second_half, r.return_time_steps_mean) == (0.5, 0.5, 0.5, 1.0)
    assert (r.walk_rho_plugin, r.walk_rho_conditional, r.mean_window_gap_revisits, r.windows_covered_frac) == (0.5, 0.5, 4.0, 0.6)
    assert got[1, 1].n_restarts == 1 and got[1, 1].unique_edges is None


def test_blocks_of_an_empty_log(spark):
    none = spark.createDataFrame([], LOG)
    for f in (blocks.window_count_block, blocks.occupancy_block, blocks.pattern_block, blocks.walk_summary):
        assert f(none, ["g"]).count() == 0
    assert blocks.crawl_block(none, ["g"], 10).count() == 0


def test_collision_counts_both_ends_of_events(spark):
    rows = [(0, 1, 1, None, "a", "b", 0.1, None, 0), (0, 2, 1, None, "c", "d", 0.2, None, 1), (0, 3, 1, None, "a", "e", 0.3, None, 1)]
    got = {r.feature: r.value for r in blocks.crawl_block(spark.createDataFrame(rows, LOG), ["g"], 10, None).collect()}
    assert got["crawl__first_node_collision_frac"] == pytest.approx(4 / 6) and got["crawl__log_unique_nodes"] == pytest.approx(np.log(6))
    assert got["crawl__step_fraction"] == pytest.approx(0.3) and got["crawl__discovery_100"] == 1 and got["crawl__return_gap_q50"] is None
