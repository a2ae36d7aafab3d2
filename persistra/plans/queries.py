"""Named queries over the driver tables; ``oracles`` holds each as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from persistra.functions.exprs import r6, ratio, u01, window_index
from persistra.operators import answers, census, estimators, evaluate, features, samplers, surrogates, walks
from persistra.plans.cases import cases, nation_events, predictions, truth
from persistra.sources.streams import all_streams, cust_supp, nation_pair, parse_edges, part_supp, table, user_type

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BUDGET = 2000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, up: float = 0.0) -> DataFrame:
    """Doubles to six places, counts to long: what comparisons of engines need.

    ``up`` is added first, so that halves of the last place, which means of rounded numbers hold, go one way."""
    return df.select(*(r6(F.col(c) + up if up else c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "tinyint", "smallint") else F.col(c) for c, t in df.dtypes))


# census --------------------------------------------------------------------


@query
def census_profile_w5(spark, d):
    return rounded(census.headline(census.dyads(cust_supp(spark, d), (5,))))


@query
def census_profile_grid(spark, d):
    return rounded(census.profile(census.dyads(cust_supp(spark, d))))


@query
def census_w_sweep(spark, d):
    return rounded(census.profile(census.dyads(part_supp(spark, d), census.SWEEP), census.SWEEP))


@query
def census_scalars(spark, d):
    e = cust_supp(spark, d)
    s = census.headline(census.dyads(e, (5,)))
    return rounded(s.select("n_pairs", "n_events", F.col("rho_2").alias("rho_headline"), F.col("mean_occupancy").alias("mean_span_frac")).crossJoin(F.broadcast(census.node_count(e))))


@query
def lifetime_stats(spark, d):
    return rounded(census.lifetimes(census.dyads(cust_supp(spark, d), (5,))))


@query
def burstiness_pooled(spark, d):
    return rounded(census.gap_statistics(census.gaps(user_type(spark, d))))


@query
def burstiness_pair_median(spark, d):
    return rounded(census.pair_burstiness(census.gaps(user_type(spark, d))))


@query
def event_weighted_rho(spark, d):
    return rounded(census.dyads(user_type(spark, d), (5,)).agg(census.event_weighted("m5").alias("rho_event_weighted")))


@query
def one_step_retention(spark, d):
    m = census.dyads(user_type(spark, d))
    return rounded(m.agg(*(census.retention(f"m{w}", w).alias(f"c_w{w}") for w in census.GRID)))


@query
def shifted_grid_rho(spark, d):
    return rounded(census.dyads(cust_supp(spark, d), (5,)).agg(census.at_least("ms", 2).alias("rho_shifted")))


@query
def equal_event_rho(spark, d):
    return rounded(census.equal_event_rho(cust_supp(spark, d)))


@query
def censoring_share(spark, d):
    return rounded(census.censoring_share(census.dyads(cust_supp(spark, d), (5,))))


@query
def winlen_over_iet(spark, d):
    e = user_type(spark, d)
    iet = census.gap_statistics(census.gaps(e)).select("median_iet")
    span = census.canonical(e).agg(((F.max("t") - F.min("t")) / 5).alias("winlen"))
    return rounded(span.crossJoin(F.broadcast(iet)).select("winlen", "median_iet", ratio(F.col("winlen"), F.col("median_iet")).alias("winlen_over_median_iet")))


@query
def node_count(spark, d):
    return rounded(census.node_count(all_streams(spark, d), ["instance_id"]))


@query
def multi_instance_census(spark, d):
    return rounded(census.headline(census.dyads(all_streams(spark, d), (5,), ["instance_id"]), ["instance_id"]))


@query
def tercile_classify(spark, d):
    return rounded(census.terciles(truth(nation_events(spark, d)), "true_2", "instance_id"))


@query
def window_robustness(spark, d):
    p = census.profile(census.dyads(all_streams(spark, d), (4, 5, 8), ["instance_id"]), (4, 5, 8), ["instance_id"]).filter("k = 2")
    five = p.filter("w = 5").select("instance_id", F.col("rho").alias("rho5"))
    j = p.filter("w <> 5").join(five, "instance_id").withColumn("change", F.abs(F.expr("rho - rho5")))
    j.createOrReplaceTempView("_robust")
    return rounded(spark.sql("select coalesce(instance_id, 'all') as category, w, avg(change) as mean_change, max(change) as max_change from _robust group by grouping sets ((instance_id, w), (w))"))


@query
def temporal_chunks(spark, d):
    c = census.temporal_chunks(cust_supp(spark, d), 6, 100)
    return rounded(c.groupBy("chunk").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.avg("t").alias("mean_t")))


@query
def rescaled_events(spark, d):
    return rounded(census.rescaled(user_type(spark, d)))


@query
def dense_event_stream(spark, d):
    return rounded(census.dense_ids(nation_pair(spark, d)))


@query
def edge_list_parse(spark, d):
    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("# "), "event_id")).when(F.col("event_id") % 10 == 1, F.lit("1 2")).otherwise(F.concat_ws(" ", "user_id", "event_type", F.when(F.col("event_id") % 10 == 2, "bad").otherwise(F.col("event_id").cast("string")))).alias("value"))
    return rounded(parse_edges(lines, {"u": 0, "v": 1, "t": 2}, bipartite=True).groupBy("v").agg(F.count("*").alias("n"), F.sum("t").alias("sum_t"), F.countDistinct("u").alias("users")))


# access models -------------------------------------------------------------


@query
def reservoir_sample(spark, d):
    return rounded(samplers.reservoir(cust_supp(spark, d), BUDGET))


@query
def time_prefix_sample(spark, d):
    return rounded(samplers.time_prefix(cust_supp(spark, d), BUDGET))


@query
def random_block_sample(spark, d):
    e = nation_events(spark, d).select("instance_id", "u", "v", "t")
    p = samplers.positions(samplers.ranked(e, ["instance_id"]), ["instance_id"], 100, (0,)).filter("strategy = 'block'")
    return rounded(samplers.block_window(p, ["instance_id"]))


@query
def node_panel_size(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), (F.col("n_nationkey") * 37 + 10).cast("long").alias("nodes"), (F.col("n_nationkey") * 911 + 1000).cast("long").alias("events"), F.lit(200).cast("long").alias("budget"))
    return rounded(samplers.node_panel_size(rows))


@query
def node_panel_sample(spark, d):
    p = samplers.node_panel(nation_pair(spark, d), 8)
    return rounded(p.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")))


@query
def sentinel_filter(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority")
    return rounded(samplers.sentinel(rows, "id", 0.1).groupBy("o_orderpriority").agg(F.count("*").alias("n")))


# features of one sample ----------------------------------------------------


def sample_log(spark, d):
    """A reservoir of the customer-supplier stream with windows of the whole horizon; t on [0, 1]."""
    e = cust_supp(spark, d)
    ends = census.canonical(e).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    log = samplers.reservoir(e, BUDGET).crossJoin(F.broadcast(ends)).withColumn("w", window_index("t", "t0", "t1", 5))
    return log.withColumn("t", F.expr("(t - t0) / (t1 - t0)")).select("pos", "u", "v", "t", "w")


def dense_log(spark, d):
    """As ``sample_log`` for the dense user-type stream, where dyads are seen often."""
    e = user_type(spark, d)
    ends = census.canonical(e).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    log = samplers.reservoir(e, BUDGET).crossJoin(F.broadcast(ends)).withColumn("w", window_index("t", "t0", "t1", 5))
    return log.withColumn("t", F.expr("(t - t0) / (t1 - t0)")).select("pos", "u", "v", "t", "w")


def dense_seen(spark, d):
    return features.edge_observations(dense_log(spark, d))


@query
def edge_observations(spark, d):
    return rounded(dense_seen(spark, d))


@query
def nw_histogram(spark, d):
    return rounded(features.nw_histogram(dense_seen(spark, d)))


@query
def nmask_histogram(spark, d):
    return rounded(features.nmask_histogram(dense_seen(spark, d)))


@query
def window_count_histogram(spark, d):
    return rounded(features.window_count_histogram(dense_log(spark, d)))


@query
def window_count_features(spark, d):
    return rounded(features.window_count_features(dense_log(spark, d)))


@query
def occupancy_features(spark, d):
    return rounded(features.occupancy_features(dense_seen(spark, d)))


@query
def pattern_features(spark, d):
    return rounded(features.pattern_features(dense_seen(spark, d)))


@query
def mask_shares(spark, d):
    return rounded(features.mask_shares(dense_seen(spark, d)))


@query
def crawl_features(spark, d):
    return rounded(features.crawl_features(dense_log(spark, d), BUDGET))


@query
def recent_events(spark, d):
    return rounded(features.recent_events(dense_log(spark, d)))


@query
def nonstationarity(spark, d):
    return rounded(features.nonstationarity(dense_log(spark, d)))


@query
def degree_selection_ks(spark, d):
    e = census.canonical(nation_pair(spark, d)).select("u", "v").distinct()
    ends = e.select(F.col("u").alias("n"), F.col("v").alias("o")).union(e.select(F.col("v").alias("n"), F.col("u").alias("o")))
    degree = ends.groupBy("n").agg(F.count("*").alias("x"))
    return rounded(features.degree_ks(degree.select("x"), degree.filter("n < 'n2'").select("x")))


@query
def detection_by_window(spark, d):
    e = user_type(spark, d)
    full = census.with_horizon(census.canonical(e)).withColumn("w", window_index("t", "t0", "t1", 5)).select("u", "v", "w").distinct()
    seen = dense_log(spark, d).select("u", "v", "w").distinct().withColumn("hit", F.lit(1.0))
    return rounded(full.join(seen, ["u", "v", "w"], "left").groupBy("w").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("detection"), F.count("*").alias("active")))


# estimators ----------------------------------------------------------------


@query
def plugin_estimators(spark, d):
    return rounded(estimators.plugin(dense_seen(spark, d)))


@query
def conditional_estimators(spark, d):
    return rounded(estimators.conditional(dense_seen(spark, d)))


@query
def chao1_good_turing(spark, d):
    return rounded(estimators.chao1(features.edge_observations(sample_log(spark, d))))


@query
def seen_label_oracle(spark, d):
    return rounded(estimators.seen_labels(dense_seen(spark, d), census.dyads(user_type(spark, d), (5,))))


@query
def hajek_ht_oracle(spark, d):
    return rounded(estimators.hajek(features.edge_observations(sample_log(spark, d)), census.dyads(cust_supp(spark, d), (5,)), BUDGET))


@query
def edgebank_auc(spark, d):
    t = census.dyads(cust_supp(spark, d), (5,)).select("u", "v", F.expr("bit_count(m5) >= 2").alias("y"))
    seen = features.edge_observations(sample_log(spark, d)).join(t, ["u", "v"])
    last = sample_log(spark, d).groupBy("u", "v").agg(F.max("t").alias("recent"))
    freq = estimators.rank_auc(seen, "n", "y").withColumn("score", F.lit("frequency"))
    return rounded(freq.unionByName(estimators.rank_auc(seen.join(last, ["u", "v"]), "recent", "y").withColumn("score", F.lit("recency"))))


@query
def pava_projection(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", *(F.expr(f"pmod(s_suppkey * {37 + 11 * i} + {i * i * 13}, 131) / 100D - 0.1D").alias(f"y{i}") for i in range(4)))
    return rounded(estimators.decreasing(rows, ["y0", "y1", "y2", "y3"]))


# evaluation ----------------------------------------------------------------


@query
def case_table(spark, d):
    return rounded(cases(spark, d))


@query
def coverage_bands(spark, d):
    c = cases(spark, d).withColumn("band", evaluate.band(F.col("coverage"), (0.05, 0.1, 0.2), ("to 5%", "to 10%", "to 20%", "over 20%")))
    return rounded(c.groupBy("band").agg(F.count("*").alias("n"), F.avg(F.abs(F.expr("pred_2 - true_2"))).alias("mae")))


@query
def group_folds(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.lit("g"), "c_nationkey").alias("group_id"))
    return rounded(evaluate.group_folds(rows, folds=5))


def _folds(spark, d):
    return table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("group_id"), (F.col("r_regionkey") % 3).cast("int").alias("fold"))


@query
def mean_median_floor(spark, d):
    rows = cases(spark, d).select("group_id", F.col("true_2").alias("y_true"))
    return rounded(evaluate.fold_floors(rows, _folds(spark, d)))


@query
def logo_floor(spark, d):
    rows = cases(spark, d).select("strategy", "group_id", F.col("true_2").alias("y_true"))
    return rounded(evaluate.logo_floor(rows, ["strategy"]), 1e-9)


@query
def metric_table(spark, d):
    return rounded(evaluate.metrics(predictions(cases(spark, d)), ["model", "strategy"]), 1e-9)


@query
def metric_slices(spark, d):
    return rounded(evaluate.metric_slices(predictions(cases(spark, d)), ["model"], ["strategy", "budget", "seed"]))


@query
def model_rankings(spark, d):
    m = evaluate.metrics(predictions(cases(spark, d)), ["model", "strategy"]).withColumn("macro_mae", F.round("macro_mae", 9))
    return rounded(evaluate.rankings(m, ["strategy"]).select("strategy", "model", "macro_mae", "rank"))


@query
def spearman_by_group(spark, d):
    return rounded(evaluate.spearman(cases(spark, d), "pred_2", "true_2", ["strategy", "budget"]))


@query
def beta_selection(spark, d):
    return rounded(evaluate.select_parameter(predictions(cases(spark, d)), _folds(spark, d), ["strategy"]))


@query
def profile_mae(spark, d):
    p = evaluate.profile_mae(cases(spark, d), ["strategy", "budget", "group_id"])
    return rounded(p.groupBy("strategy", "budget", "group_id").agg(F.avg("pmae").alias("pmae"), F.count("pmae").alias("n")))


@query
def variance_components(spark, d):
    rows = evaluate.profile_mae(cases(spark, d).filter("strategy <> 'time_prefix'"), ["strategy", "budget", "group_id", "instance_id"])
    return rounded(evaluate.variance_components(rows, "pmae", ["strategy", "budget"]))


@query
def target_distribution(spark, d):
    return rounded(evaluate.distribution(truth(nation_events(spark, d)), "true_2", ["group_id"]))


@query
def seed_noise_floor(spark, d):
    return rounded(evaluate.seed_noise(cases(spark, d).filter("strategy <> 'time_prefix'"), "pred_2", ["strategy", "budget"]))


@query
def even_spaced_pick(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return rounded(evaluate.even_pick(rows, ["c_acctbal", "c_custkey"], 6, ["c_mktsegment"]))


@query
def round_robin_strata(spark, d):
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    return rounded(evaluate.round_robin(rows, "s_nationkey", "s_suppkey", 40))


@query
def hash_block_pick(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("string").alias("id"))
    return rounded(evaluate.hash_pick(rows, ["p_brand"], "id", 2))


@query
def nearest_profile_pairs(spark, d):
    return rounded(evaluate.nearest_profiles(truth(nation_events(spark, d)), "instance_id", ["true_2", "true_c"]))


# answers -------------------------------------------------------------------


def answer_records(spark, d):
    """Records from the events table: the value becomes an answer in JSON, some truncated, some malformed."""
    e = table(spark, d, "events").select("event_id", "user_id", (F.floor("value") / 100).alias("x"))
    body = F.concat(F.lit('<think>{"rho_k2": 1}</think> so {"rho_k2": '), F.when(F.col("event_id") % 11 == 0, F.lit("NaN")).when(F.col("event_id") % 13 == 0, F.lit('"0.5"')).otherwise(F.format_string("%.3f", "x")), F.lit(', "rho_k3": 0.25}'))
    done = F.when(F.col("event_id") % 7 == 0, "length").otherwise("stop")
    return e.select((F.col("user_id") % 50).alias("prompt_id"), "event_id", F.col("user_id").alias("model_id"), done.alias("finish_reason"), (done == "stop").alias("complete"), body.alias("answer"), "x")


@query
def answer_parse(spark, d):
    r = answer_records(spark, d).withColumn("obj", answers.last_object(F.col("answer")))
    return rounded(r.select("event_id", answers.valid_unit(F.col("obj"), "rho_k2").alias("rho_k2"), answers.valid_unit(F.col("obj"), "rho_k3").alias("rho_k3"), answers.valid_unit(F.col("obj"), "rho_k4").alias("rho_k4")))


@query
def latest_answer_wins(spark, d):
    return rounded(answers.latest(answer_records(spark, d), ["prompt_id"], "complete", ["event_id"]).select("prompt_id", "event_id", "finish_reason"))


@query
def legacy_last_values(spark, d):
    r = answer_records(spark, d).withColumn("v", F.when(F.col("complete"), F.col("x")))
    return rounded(answers.last_values(r, ["prompt_id"], ["v", "finish_reason"], "event_id"))


@query
def frozen_score(spark, d):
    c = cases(spark, d).withColumn("h", u01("miss", F.col("case_id")))
    rows = c.select(
        "strategy", "budget", (F.col("h") >= 0.1).alias("answered"), F.when(F.col("h") >= 0.2, F.col("pred_2")).alias("p2"),
        F.when(F.col("h") >= 0.1, F.col("pred_3")).alias("p3"), F.when(F.col("h") >= 0.1, F.col("pred_4")).alias("p4"), F.when(F.col("h") >= 0.1, F.col("pred_5")).alias("p5"),
        *(F.col(f"true_{k}").alias(f"t{k}") for k in range(2, 6)),
    )
    return rounded(answers.frozen_score(rows, ["strategy", "budget"]))


@query
def interval_coverage(spark, d):
    rows = cases(spark, d).select("strategy", (F.col("pred_2") - 0.05).alias("lo"), (F.col("pred_2") + 0.1).alias("hi"), "true_2")
    return rounded(answers.interval_cover(rows, ["strategy"], "lo", "hi", "true_2"))


@query
def paired_delta(spark, d):
    rows = cases(spark, d).select(F.concat_ws("|", "instance_id", F.col("budget").cast("string")).alias("case"), "strategy", F.abs(F.expr("pred_2 - true_2")).alias("err"))
    return rounded(answers.paired_delta(rows, "case", "strategy", "err", "reservoir"))


@query
def cost_rollup(spark, d):
    rows = table(spark, d, "conversations").select("role", (F.octet_length("text") % 1000).cast("long").alias("n_hit"), F.octet_length("text").cast("long").alias("n_miss"), F.length("text").cast("long").alias("n_out"))
    return rounded(answers.cost(rows, ["role"], 0.028, 0.28, 0.42))


@query
def attempt_stats(spark, d):
    return rounded(answers.attempts(answer_records(spark, d), "prompt_id", "finish_reason"))


@query
def paired_cell_select(spark, d):
    prompts = table(spark, d, "nation").select((F.col("n_nationkey") * 3).cast("bigint").alias("prompt_id"))
    return rounded(answers.paired_cases(answer_records(spark, d), prompts, "prompt_id"))


# surrogates ----------------------------------------------------------------


@query
def timestamp_shuffle(spark, d):
    return rounded(surrogates.timestamp_shuffle(user_type(spark, d)))


@query
def within_window_shuffle(spark, d):
    return rounded(surrogates.within_window_shuffle(user_type(spark, d)).drop("w"))


@query
def lifetime_resample(spark, d):
    return rounded(surrogates.lifetime_resample(census.rescaled(user_type(spark, d))))


@query
def time_respecting_paths(spark, d):
    return rounded(walks.time_respecting_paths(nation_pair(spark, d), "n0", 4))


# rows only: sequential or iterative ------------------------------------------


@query
def walk_logs(spark, d):
    e = nation_pair(spark, d).filter("u <> v").withColumn("instance_id", F.lit("nation_pair"))
    return walks.run_walks(e, [*walks.STRATEGIES, "recent_history_k5", "time_respecting_multistart3"], 400)


@query
def ego_snowball(spark, d):
    e = user_type(spark, d).withColumn("instance_id", F.lit("user_type"))
    return walks.run_walks(e, ["ego_recent_k5", "ego_recent_kall"], 400)


@query
def occ_mle(spark, d):
    return estimators.occupancy_mle(features.nw_histogram(dense_seen(spark, d)))


def _masks(spark, d):
    return dense_seen(spark, d).groupBy("n", "mask").agg(F.count("*").alias("c"))


@query
def mask_mle(spark, d):
    return estimators.mask_mle(_masks(spark, d))


@query
def window_beta_mle(spark, d):
    return estimators.window_beta_mle(_masks(spark, d))


@query
def rank_beta_mle(spark, d):
    return estimators.rank_beta_mle(features.nw_histogram(dense_seen(spark, d)))


@query
def hh_mask(spark, d):
    return estimators.hansen_hurwitz(_masks(spark, d))


@query
def reservoir_eb(spark, d):
    return estimators.reservoir_eb(features.window_count_histogram(dense_log(spark, d)), 0.2)


@query
def dar_stream(spark, d):
    return surrogates.dar_stream(spark, 2000, 0.2, 0.4)


@query
def renewal_stream(spark, d):
    return surrogates.renewal_stream(spark, 1000)


@query
def activity_stream(spark, d):
    return surrogates.activity_stream(spark, 4, 60, 50)


@query
def rewired_surrogate(spark, d):
    return surrogates.rewire(nation_pair(spark, d))


@query
def block_graph(spark, d):
    return surrogates.block_graph(spark, 300, 4, 6.0)


@query
def ml_group_kfold(spark, d):
    from persistra.operators.learning import group_kfold

    return group_kfold(cases(spark, d), "ridge", ["pred_2", "pred_3", "coverage"], "true_2", 3)
