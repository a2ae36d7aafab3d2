"""Hand-computed micro graphs and every query with SQL against DuckDB."""

import math

import duckdb
import pytest

from persistra.operators import answers, census, estimators, evaluate, features, samplers, surrogates, walks
from persistra.plans import blocks, families, oracles, panels, queries, reports
from persistra.sources import streams

MICRO = [("0", "1", 0.0), ("0", "1", 0.25), ("0", "1", 0.85), ("1", "2", 0.1), ("1", "2", 0.12), ("2", "3", 0.65), ("2", "3", 1.0), ("0", "3", 0.5), ("1", "3", 0.95)]
EVENTS = "u string, v string, t double"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def micro(spark):
    return spark.createDataFrame(MICRO, EVENTS)


def test_micro_graph(micro):
    d = census.dyads(micro)
    h = census.headline(d).first()
    assert (h.n_pairs, h.n_events) == (5, 9)
    assert [h[f"rho_{k}"] for k in range(1, 6)] == pytest.approx([1, 0.4, 0.2, 0, 0])
    assert h.mean_occupancy == pytest.approx(0.32) and h.rho_event_weighted == pytest.approx(5 / 9) and h.c_one_step == pytest.approx(0.4)
    life = census.lifetimes(d).first()
    assert (life.horizon_t, life.events_per_pair_median, life.share_single_event_pairs) == (1.0, 2.0, 0.4)
    assert life.lifetime_mean == pytest.approx(1.22 / 5) and life.lifetime_median == pytest.approx(0.02)
    assert d.agg(census.at_least("ms", 2)).first()[0] == pytest.approx(0.4)
    assert census.censoring_share(d).first()[0] == pytest.approx(0.2)
    assert census.equal_event_rho(micro).first().rho_equal_event == pytest.approx(0.6)
    g = census.gap_statistics(census.gaps(micro)).first()
    assert g.median_iet == pytest.approx(0.30) and g.burstiness_pooled == pytest.approx(-0.18874, abs=1e-5)


def test_boundary_times_fall_in_the_later_window(spark):
    e = spark.createDataFrame([("a", "b", t) for t in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)] + [("c", "d", 0.5)], EVENTS)
    d = census.dyads(e)
    h = census.headline(d).first()
    assert (h.rho_2, h.rho_5) == (0.5, 0.5) and census.censoring_share(d).first()[0] == 0


def test_self_loops_and_direction(spark):
    e = spark.createDataFrame([("b", "a", 0.0), ("a", "b", 1.0), ("a", "a", 0.5)], EVENTS)
    assert census.headline(census.dyads(e)).first().n_pairs == 1
    assert census.node_count(e).first().n_nodes == 2


def test_edge_lists(spark):
    lines = spark.createDataFrame([(x,) for x in ["% note", "", "1 2 3.5", "1 2", "x y z", " 4\t5  6 "]], "value string")
    got = streams.parse_edges(lines, {"u": 0, "v": 1, "t": 2}, bipartite=True).collect()
    assert [tuple(r) for r in got] == [("u:1", "i:2", 3.5), ("u:4", "i:5", 6.0)]
    comma = spark.createDataFrame([("1,2,0,7",), ("3,4,0,8",)], "value string")
    assert streams.robust_parse(comma, {"u": 0, "v": 1, "t": 3}, None).count() == 2


def test_samples_nest(micro):
    small, large = (samplers.reservoir(micro, b).select("eid").collect() for b in (3, 6))
    assert [r.eid for r in large][:3] == [r.eid for r in small]
    prefix = samplers.time_prefix(micro, 4).orderBy("pos").collect()
    assert [r.t for r in prefix] == [0.0, 0.1, 0.12, 0.25]


def test_panel_size(spark):
    rows = spark.createDataFrame([(10, 1000, 200)], "nodes long, events long, budget long")
    assert samplers.node_panel_size(rows).first().size == 5


def test_surrogates_keep_what_they_promise(spark):
    e = streams.user_type(spark, DATA)
    k = samplers.keyed(e)
    whole, inside, life = surrogates.timestamp_shuffle(e), surrogates.within_window_shuffle(e), surrogates.lifetime_resample(e)
    assert surrogates.invariants(k, whole, ["t"]).count() == 0 and surrogates.invariants(k, whole, ["u", "v"]).count() == 0
    assert surrogates.invariants(k, inside, ["t"]).count() == 0
    a, b = (x.groupBy("u", "v").agg({"t": "min"}).union(x.groupBy("u", "v").agg({"t": "max"})) for x in (k, life))
    assert surrogates.invariants(a, b, a.columns).count() == 0


def test_estimators_at_full_observation(spark):
    h = spark.createDataFrame([(80, m, 1) for m in (1, 3, 7, 15)], "n long, mask long, c long")
    r = estimators.mask_mle(h).first()
    assert r.rho_2 == pytest.approx(0.75, abs=0.01) and r.rho_3 == pytest.approx(0.5, abs=0.01)
    hh = estimators.hansen_hurwitz(spark.createDataFrame([(100, 1, 3), (100, 31, 1)], "n long, mask long, c long")).first()
    assert hh.rho_2 == pytest.approx(0.25, abs=1e-3) and hh.rho_5 == pytest.approx(0.25, abs=1e-3)
    # the fit is on dyads, the readout on traversals: unequal n tell them apart
    rows = [(1, 1, 4), (5, 31, 2)]
    hh = estimators.hansen_hurwitz(spark.createDataFrame(rows, "n long, mask long, c long")).first()
    assert hh.rho_1 == pytest.approx(1.0) and hh.rho_2 == pytest.approx(0.751, abs=2e-3)
    fits = {r.beta: r for r in estimators.rank_beta_mle(spark.createDataFrame([(60, 1, 1), (60, 2, 1)], "n long, w int, c long")).collect()}
    assert len(fits) == 7 and all(r.rho_2 == pytest.approx(0.5) for r in fits.values()) and fits[0.0].likeliest
    by_weight = {n: estimators.ranked_rows(n, 0.0) for n in (1, 2, 3, 7)}
    for n, rows in by_weight.items():
        for w in range(5):
            assert list(rows[w]) == pytest.approx(list(estimators.occupancy_row(n)[w]), abs=1e-12)
    # two active windows of weights 1 and e: both are seen by two events unless both fall in one
    p = 1 / (1 + math.e)
    assert estimators.ranked_rows(2, 1.0)[1][1] == pytest.approx(2 * p * (1 - p))
    assert sum(estimators.ranked_rows(200, 3.0, certain=None)[w][4] for w in range(5)) == pytest.approx(1.0)
    fit = spark.createDataFrame([("a", 0.0, 0.5), ("a", 1.0, 0.7), ("b", 0.0, 0.1), ("b", 1.0, 0.4)], "g string, beta double, rho_2 double")
    truth = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "g string, true_2 double")
    assert tuple(estimators.calibrate_beta(fit, truth, ["g"]).first()) == pytest.approx((1.0, 0.05))
    chao = estimators.chao1(spark.createDataFrame([(1,)] * 4 + [(2,)] * 2, "n long")).first()
    assert chao.chao1 == 8.0
    p = estimators.decreasing(spark.createDataFrame([(0.2, 0.6, 0.1, 0.0)], "a double, b double, c double, d double"), ["a", "b", "c", "d"]).first()
    assert tuple(p) == pytest.approx((0.4, 0.4, 0.1, 0.0))
    occ = estimators.occupancy_mle(spark.createDataFrame([(60, 1, 1), (60, 2, 1)], "n long, w int, c long")).first()
    assert occ.rho_2 == pytest.approx(0.5)


def test_reservoir_mixture_limits(spark):
    cols = "c0 long, c1 long, c2 long, c3 long, c4 long, c long"
    full = estimators.reservoir_eb(spark.createDataFrame([(3, 2, 0, 0, 0, 300)], cols), 1.0).first()
    assert full.rho_2 > 0.999 and full.rho_3 < 1e-6
    single = estimators.reservoir_eb(spark.createDataFrame([(1, 0, 0, 0, 0, 200), (2, 0, 0, 0, 0, 30)], cols), 0.05).first()
    assert 0 <= single.rho_5 <= single.rho_2 <= 1


def test_floors_use_other_groups_only(spark):
    rows = spark.createDataFrame([("g0", 0.0)] * 2 + [("g1", 0.4)] * 2 + [("g2", 1.0)] * 2, "group_id string, y_true double")
    folds = spark.createDataFrame([("g0", 0), ("g1", 1), ("g2", 2)], "group_id string, fold int")
    got = {r.fold: r.median_floor for r in evaluate.fold_floors(rows, folds).collect()}
    assert got == {0: pytest.approx(0.7), 1: pytest.approx(0.5), 2: pytest.approx(0.2)}
    assert sorted(r.fold for r in evaluate.group_folds(rows, folds=3).collect()) == [0, 1, 2]


def test_frozen_scoring(spark):
    cols = "p2 double, p3 double, p4 double, p5 double, t2 double, t3 double, t4 double, t5 double, answered boolean, m string"
    truth = (0.5, 0.4, 0.3, 0.2)
    rows = [(*truth, *truth, True, "a"), (None, 0.4, 0.3, 0.2, *truth, True, "b"), (None,) * 4 + (*truth, False, "c")]
    got = {r.m: r for r in answers.frozen_score(spark.createDataFrame(rows, cols), ["m"]).collect()}
    assert (got["a"].penalized_pmae, got["a"].validity) == (0.0, 1.0)
    assert (got["b"].penalized_pmae, got["b"].failed) == (0.25, 1)
    assert got["c"].missing == 1 and got["c"].penalized_pmae is None


def test_answer_text(spark):
    from pyspark.sql import functions as F

    texts = ['<think>{"rho_k2": 0.1}</think>{"rho_k2": 0.5, "x": NaN}', '{"rho_k2": "0.5"}', '{"rho_k2": true}', '{"rho_k2": 1.5}', "no json", '{"rho_k2": NaN}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(answers.valid_unit(answers.last_object(F.col("t")), "rho_k2")).collect()]
    assert got == [0.5, None, None, None, None, None]


def test_walks_obey_time():
    import numpy as np

    index = walks.Index(np.array(["0", "1", "0"], object), np.array(["1", "2", "1"], object), np.array([0.1, 0.3, 0.7]))
    for name in walks.STRATEGIES:
        log = walk_of(index, name)
        assert len(log) == 200 and log == walk_of(index, name)
        last = None
        for kind, node, u, v, t, _ in log:
            if kind == 0:
                last = None
                continue
            assert node in (u, v)
            if name in ("time_respecting", "recency_biased"):
                assert last is None or t > last
            if name == "recent_history":
                assert last is None or t < last
            last = t
    assert walks.parse_strategy("recent_history_k5_multistart3") == ("recent_history", {"starts": 3, "k": 5})
    assert walks.parse_strategy("ego_recent_kall") == ("ego_recent", {"k": None})
    assert len({e[2:5] for e in walks.ego_snowball(index, 10, 0, None)}) == 3


def test_walk_times_do_not_change_the_walk_and_depth_not_the_queries(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    u, v = rng.integers(0, 12, 300).astype(str).astype(object), rng.integers(12, 20, 300).astype(str).astype(object)
    t = np.round(rng.random(300), 2)
    index = walks.Index(u, v, t)
    plain, timed = walk_of(index, "time_agnostic"), walk_of(index, "time_agnostic_t")
    assert [r[:4] for r in plain] == [r[:4] for r in timed] and all(r[4] is None for r in plain)
    events = set(zip(u, v, t)) | set(zip(v, u, t))
    assert all((a, b, x) in events for kind, _, a, b, x, _ in timed if kind)

    def order(k, queries):
        out = []
        for r in walks.ego_snowball(index, 10**6, 4, k):
            if r[6] < queries:
                out.append((r[6], r[1]))
        return dict(out)

    deep, shallow, whole = order(5, 12), order(1, 12), order(None, 12)
    assert all(whole.get(q, n) == n for q, n in deep.items()) and all(deep.get(q, n) == n for q, n in shallow.items())
    everything = walks.ego_snowball(index, 10**6, 4, None)
    assert len(everything) == 300 and not any(r[7] for r in everything)
    assert sorted((*sorted(r[2:4]), r[4]) for r in everything) == sorted((*sorted(e), x) for *e, x in zip(u, v, t))
    # the newest k are cut first, events seen before are dropped then
    for q in range(12):
        assert sum(r[6] == q for r in walks.ego_snowball(index, 10**6, 4, 5)) <= 5
    assert walks.ego_snowball(index, 7, 4, None)[-1][7] and len(walks.ego_snowball(index, 7, 4, None)) == 7
    rows = spark.createDataFrame([("x", a, b, float(c)) for a, b, c in zip(u, v, t)], "instance_id string, u string, v string, t double")
    got = walks.run_walks(rows, ["time_agnostic", "time_agnostic_t", "ego_recent_k5", "time_respecting_multistart3"], 50, (0, 1))
    assert got.count() == 2 * (50 + 50 + 50 + 50) and got.filter("strategy = 'ego_recent_k5' and query_id is null").count() == 0


def test_baselines_must_not_be_missing(spark):
    from persistra.operators import tables

    cases = spark.createDataFrame([(i,) for i in range(10)], "case_id long")
    p = spark.createDataFrame([(i, "m", 0.5) for i in range(10)], "case_id long, model string, prediction double")
    assert tables.with_baselines(cases, p, "case_id", ["m"]).count() == 10
    with pytest.raises(ValueError, match="missing"):
        tables.with_baselines(cases, p.filter("case_id > 0"), "case_id", ["m"])


def walk_of(index, name):
    return walks.walk(index, name, 200, 3)


def test_streaming_state(spark, tmp_path, micro):
    from persistra.streaming.profile import start_profile

    micro.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = start_profile(source, 0.0, 1.0, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out").orderBy("batch", ascending=False).first()
    assert last.rho_2 == pytest.approx(0.4) and last.c_one_step == pytest.approx(0.4)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def values(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


SQL = {**oracles.ORACLES, **panels.ORACLES, **reports.ORACLES, **blocks.ORACLES, **families.ORACLES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    got = values(tuple(r[c] for c in columns) for r in df.collect())
    want = values(tuple(r[i] for i in order) for r in rel.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first().n_pairs > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_walks_over_streamed_runs_are_those_over_events_in_memory(spark, monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows = sorted({(float(t), f"n{a}", f"n{b}") for t, a, b in zip(np.round(rng.random(150), 1), rng.integers(0, 7, 150), rng.integers(0, 7, 150))})
    times = rng.integers(1, 5, len(rows)).tolist()
    t, u, v = (np.array(x, object) for x in zip(*(r for r, n in zip(rows, times) for _ in range(n))))
    events = walks.Index(u, v, t)
    ends = sorted((e, *r, n, side) for r, n in zip(rows, times) for side, e in enumerate(r[1:]))
    names = ("node", "t", "u", "v", "c", "side")
    table = pa.table([pa.array(x, pa.int8() if c == "side" else None) for c, x in zip(names, zip(*ends))], names)
    table = table.append_column("other", pa.array([r[3 - r[5]] for r in ends]))
    monkeypatch.setattr(walks, "PIECE", 3)
    runs = walks.Index.of(table.to_batches(max_chunksize=7))
    for seed in range(3):
        for name in walks.STRATEGIES:
            assert walks.walk(events, name, 200, seed, 5) == walks.walk(runs, name, 200, seed, 5)
        for k in (1, 5, None):
            assert walks.ego_snowball(events, 400, seed, k) == walks.ego_snowball(runs, 400, seed, k)
    with pytest.raises(ValueError, match="sorted"):
        walks.Index.of(table.take(rng.permutation(len(ends))).to_batches())
    df = spark.createDataFrame([("x", a, b, c) for a, b, c in zip(u, v, t)], "instance_id string, u string, v string, t double").repartition(3)
    got = walks.run_walks(df.union(df.selectExpr("'y'", "u", "v", "t + 1")), ["time_respecting", "ego_recent_k5"], 100)
    for log, name in ((walks.walk(events, "time_respecting", 100, 0), "time_respecting"), (walks.ego_snowball(events, 100, 0, 5), "ego_recent_k5")):
        assert [tuple(r) for r in got.filter(f"instance_id = 'x' and strategy = '{name}'").orderBy("pos").select("kind", "node", "u", "v", "t").collect()] == [r[:5] for r in log]
    assert got.filter("instance_id = 'y'").count() == got.filter("instance_id = 'x'").count() == 100 + len(walks.ego_snowball(events, 100, 0, 5))
    # a network of 10^9 equal events, then one of 2 million events: 42 MB of index, not held
    monkeypatch.undo()
    billion = pa.RecordBatch.from_pydict({"node": ["a", "b"], "other": ["b", "a"], "t": [1.0, 1.0], "c": [10**9] * 2, "side": pa.array([0, 1], pa.int8())})
    assert len(walks.ego_snowball(walks.Index.of([billion]), 50, 0, None)) == 50 and len(walk_of(walks.Index.of([billion]), "recency_biased")) == 200

    def long(n=10_000):
        for x in "ab":
            for i in range(100):
                yield pa.RecordBatch.from_pydict({"node": [x] * n, "other": ["ab".replace(x, "")] * n, "t": np.arange(i * n, i * n + n, dtype=float), "c": np.ones(n, np.int64), "side": np.full(n, "ab".index(x), np.int8)})

    tracemalloc.start()
    log = walk_of(walks.Index.of(long()), "time_agnostic_t")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(log) == 200 and peak < 24e6
