"""Each query of ``queries`` as SQL over the driver tables."""

from __future__ import annotations

CUST_SUPP = "SELECT 'c' || o_custkey AS u, 's' || l_suppkey AS v, epoch_us(o_orderdate) / 1e6 AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
PART_SUPP = "SELECT 'p' || l_partkey AS u, 's' || l_suppkey AS v, epoch_us(l_shipdate) / 1e6 AS t FROM lineitem"
USER_TYPE = "SELECT 'u' || user_id AS u, 'i' || event_type AS v, epoch_us(ts) / 1e6 AS t FROM events"
NATION_PAIR = (
    "SELECT 'n' || c_nationkey AS u, 'n' || s_nationkey AS v, epoch_us(o_orderdate) / 1e6 AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
)
ALL = " UNION ALL ".join(f"SELECT '{n}' AS instance_id, * FROM ({q})" for n, q in (("cust_supp", CUST_SUPP), ("part_supp", PART_SUPP), ("user_type", USER_TYPE), ("nation_pair", NATION_PAIR)))
RHO = "avg(CASE WHEN bit_count({m}) >= {k} THEN 1.0::DOUBLE ELSE 0 END)"


def window(w: int, off: str = "0", bins: int | None = None) -> str:
    return f"greatest(0, least({(bins or w) - 1}, floor((t - t0 + {off}) / ((t1 - t0) / {w}::DOUBLE) + 1e-9)))::INT"


def dyads(ev: str, grid=(4, 5, 8), by: str = "") -> str:
    """CTEs ev, e (canonical with horizon) and d (one row for each dyad)."""
    k = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    masks = ", ".join(f"bit_or(1::BIGINT << {window(w)}) AS m{w}" for w in grid)
    return f"""ev AS ({ev}), e AS (
  SELECT {k}least(u, v) AS u, greatest(u, v) AS v, t, min(t) {over} AS t0, max(t) {over} AS t1 FROM ev WHERE u <> v
), d AS (
  SELECT {k}u, v, count(*) AS n, min(t) AS first, max(t) AS last, any_value(t0) AS t0, any_value(t1) AS t1, {masks},
         bit_or(1::BIGINT << {window(5, "(t1 - t0) / 10::DOUBLE", 6)}) AS ms
  FROM e GROUP BY {k}u, v
)"""


def retention(m: str, w: int) -> str:
    return f"round(sum(bit_count({m} & ({m} >> 1)))::DOUBLE / nullif(sum(bit_count({m} & {(1 << (w - 1)) - 1})), 0), 6)"


def headline(by: str = "") -> str:
    rho = ", ".join(f"round({RHO.format(m='m5', k=k)}, 6) AS rho_{k}" for k in range(1, 6))
    return f"""SELECT {by + ", " if by else ""}count(*) AS n_pairs, sum(n)::BIGINT AS n_events, {rho}, round(avg(bit_count(m5) / 5::DOUBLE), 6) AS mean_occupancy,
 round(sum(CASE WHEN bit_count(m5) >= 2 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS rho_event_weighted, {retention("m5", 5)} AS c_one_step
 FROM d {"GROUP BY " + by if by else ""}"""


def profile(grid, by: str = "") -> str:
    k = f"{by}, " if by else ""
    long = " UNION ALL ".join(f"SELECT {k}{w}::BIGINT AS w, bit_count(m{w}) AS a FROM d" for w in grid)
    return f"""SELECT {k}w, k, round(avg(CASE WHEN a >= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS rho FROM ({long}) s, range(1, 17) r(k) WHERE k <= w GROUP BY {k}w, k"""


GAPS = "g AS (SELECT u, v, t - lag(t) OVER (PARTITION BY u, v ORDER BY t) AS gap FROM e QUALIFY gap IS NOT NULL)"
KEYED = "keyed AS (SELECT *, u || '|' || v || '|' || row_number() OVER (PARTITION BY {by}u, v ORDER BY t) AS eid FROM e)"


def sample(ev: str, budget: int = 2000) -> str:
    """CTEs up to lg: the reservoir's log with t on [0, 1] and windows."""
    return f"""{dyads(ev, (5,))}, {KEYED.format(by="")}, picked AS (
  SELECT *, row_number() OVER (ORDER BY md5('0|' || eid), eid) AS pos FROM keyed QUALIFY pos <= {budget}
), lg AS (SELECT pos, u, v, (t - t0) / (t1 - t0) AS t, {window(5)} AS w FROM picked), seen AS (
  SELECT *, bit_count(mask) AS w FROM (SELECT u, v, count(*) AS n, bit_or(1::BIGINT << w) AS mask FROM lg GROUP BY u, v)
)"""


DENSE, SPARSE = sample(USER_TYPE), sample(CUST_SUPP)


def u01(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


PLUGIN = ", ".join(f"round(avg(CASE WHEN w >= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS rho_{k}" for k in range(2, 6))
NATION = f"""ev AS (SELECT 'n' || c_nationkey AS instance_id, 'r' || n_regionkey AS group_id, 'c' || o_custkey AS u, 's' || l_suppkey AS v, epoch_us(o_orderdate) / 1e6 AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), e AS (SELECT *, min(t) OVER () AS t0, max(t) OVER () AS t1 FROM ev), td AS (
  SELECT *, bit_count(mask) AS w FROM (SELECT instance_id, group_id, u, v, count(*) AS n, bit_or(1::BIGINT << {window(5)}) AS mask FROM e GROUP BY ALL)
), truth AS (
  SELECT instance_id, group_id, count(*) AS n_pairs, {", ".join(f"round(avg(CASE WHEN w >= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS true_{k}" for k in range(2, 6))}, {retention("mask", 5)} AS true_c
  FROM td GROUP BY instance_id, group_id
)"""
POSITIONS = f"""{KEYED.format(by="instance_id, ").replace("FROM e)", "FROM (SELECT * REPLACE (least(u, v) AS u, greatest(u, v) AS v) FROM e WHERE u <> v))")}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY t, eid) - 1 AS r, count(*) OVER (PARTITION BY instance_id) AS size FROM keyed
), many AS (SELECT * FROM ranked, (VALUES (0), (1)) s(seed)), pos AS (
  SELECT * EXCLUDE (r, size), 'time_prefix' AS strategy, 0 AS seed, r + 1 AS pos FROM ranked
  UNION ALL SELECT * EXCLUDE (r, size, seed), 'reservoir', seed, row_number() OVER (PARTITION BY instance_id, seed ORDER BY md5(seed || '|' || eid), eid) FROM many
  UNION ALL SELECT * EXCLUDE (r, size, seed, anchor), 'block', seed, row_number() OVER (PARTITION BY instance_id, seed ORDER BY abs(r - anchor), r)
    FROM (SELECT *, {{anchor}} AS anchor FROM many)
)"""
ANCHOR_ONE = f"floor({u01("'anchor|' || seed || '|' || instance_id")} * size)"


def case_sql() -> str:
    # the anchor of a case's block is keyed by the instance, its group and the horizon, as text
    anchor = f"floor({u01("'anchor|' || seed || '|' || instance_id || '|' || group_id")} * size)"
    return f"""{NATION}, {POSITIONS.replace("{anchor}", anchor)}, lg AS (
  SELECT pos.*, budget, {window(5)} AS w FROM pos, (VALUES (100), (400)) b(budget) WHERE pos <= budget
), seen AS (
  SELECT *, bit_count(mask) AS w FROM (SELECT instance_id, strategy, seed, budget, u, v, count(*) AS n, bit_or(1::BIGINT << w) AS mask FROM lg GROUP BY ALL)
), own AS (
  SELECT instance_id, strategy, seed, budget, count(*) AS n_seen, {PLUGIN.replace("rho_", "pred_")}, {retention("mask", 5)} AS pred_c FROM seen GROUP BY ALL
), cases AS (
  SELECT instance_id || '|' || strategy || '|s' || seed || '|b' || budget AS case_id, instance_id, group_id, strategy, seed, budget, n_seen::DOUBLE / n_pairs AS coverage,
         pred_2, pred_3, pred_4, pred_5, true_2, true_3, true_4, true_5, pred_c, true_c
  FROM own JOIN truth USING (instance_id)
)"""


CASES = case_sql()
PREDICTIONS = f"""{CASES}, pred AS (
  SELECT case_id, instance_id, group_id, strategy, seed, budget, coverage, 'shrink_' || i AS model, i AS parameter,
         (1 - i / 4::DOUBLE) * pred_2 + (1 - (1 - i / 4::DOUBLE)) * 0.2::DOUBLE AS prediction, true_2 AS y_true
  FROM cases, range(4) r(i)
), ok AS (SELECT *, prediction - y_true AS err FROM pred WHERE prediction IS NOT NULL AND y_true IS NOT NULL)"""
METRICS = """SELECT model, strategy, sum(n)::BIGINT AS n, round(round(sum(a) / sum(n), 9) + 1e-9::DOUBLE, 6) AS mae, round(avg(g) + 1e-9::DOUBLE, 6) AS macro_mae, round(max(g) + 1e-9::DOUBLE, 6) AS worst_group_mae,
  round(quantile_cont(g, 0.9) + 1e-9::DOUBLE, 6) AS p90_group_mae, round(sqrt(sum(q) / sum(n)) + 1e-9::DOUBLE, 6) AS rmse, round(sum(s) / sum(n) + 1e-9::DOUBLE, 6) AS bias
 FROM (SELECT model, strategy, group_id, count(*) AS n, sum(abs(err)) AS a, sum(err * err) AS q, sum(err) AS s, avg(abs(err)) AS g FROM ok GROUP BY ALL) GROUP BY model, strategy"""
FOLDS = "folds AS (SELECT 'r' || r_regionkey AS group_id, (r_regionkey % 3)::INT AS fold FROM region)"
PMAE = "(abs(pred_2 - true_2) + abs(pred_3 - true_3) + abs(pred_4 - true_4) + abs(pred_5 - true_5)) / 4"
LOW, HIGH = "floor(log2((mask & -mask)::DOUBLE))", "floor(log2(mask::DOUBLE) + 1e-9)"
RECORDS = """rec AS (
  SELECT user_id % 50 AS prompt_id, event_id, user_id, CASE WHEN event_id % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, event_id % 7 <> 0 AS complete,
         floor(value) / 100 AS x FROM events)"""
CORR = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def auc(score: str) -> str:
    return f"""SELECT round((sum(rank * p) - sum(p) * (sum(p) + 1) / 2.0) / nullif(sum(p) * (sum(c) - sum(p)), 0)::DOUBLE, 6) AS auc FROM (
      SELECT *, coalesce(sum(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS rank
      FROM (SELECT {score} AS s, count(*) AS c, sum(y::BIGINT) AS p FROM lab GROUP BY 1))"""


ORACLES: dict[str, str] = {
    "census_profile_w5": f"WITH {dyads(CUST_SUPP, (5,))} {headline()}",
    "census_profile_grid": f"WITH {dyads(CUST_SUPP)} {profile((4, 5, 8))}",
    "census_w_sweep": f"WITH {dyads(PART_SUPP, (2, 3, 4, 5, 6, 8, 10, 12, 16, 20))} {profile((2, 3, 4, 5, 6, 8, 10, 12, 16, 20)).replace('range(1, 17)', 'range(1, 21)')}",
    "census_scalars": f"""WITH {dyads(CUST_SUPP, (5,))} SELECT count(*) AS n_pairs, sum(n)::BIGINT AS n_events, round({RHO.format(m="m5", k=2)}, 6) AS rho_headline,
      round(avg(bit_count(m5) / 5::DOUBLE), 6) AS mean_span_frac, (SELECT count(*) FROM (SELECT u FROM ev UNION SELECT v FROM ev)) AS n_nodes FROM d""",
    "lifetime_stats": f"""WITH {dyads(CUST_SUPP, (5,))} SELECT round(avg(last - first), 6) AS lifetime_mean, round(quantile_cont(last - first, 0.5), 6) AS lifetime_median,
      round(avg(last - first) / any_value(t1 - t0), 6) AS lifetime_mean_over_t, round(quantile_cont(n::DOUBLE, 0.5), 6) AS events_per_pair_median,
      round(avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_single_event_pairs, round(avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS repeat_rate,
      round(any_value(t1 - t0), 6) AS horizon_t FROM d""",
    "burstiness_pooled": f"WITH {dyads(USER_TYPE, (5,))}, {GAPS} SELECT round(quantile_cont(gap, 0.5), 6) AS median_iet, round((stddev_pop(gap) - avg(gap)) / nullif(stddev_pop(gap) + avg(gap), 0), 6) AS burstiness_pooled FROM g",
    "burstiness_pair_median": f"""WITH {dyads(USER_TYPE, (5,))}, {GAPS}, s AS (SELECT count(*) AS c, sum(gap) AS s, sum(gap * gap) AS q FROM g GROUP BY u, v HAVING count(*) >= 2),
      b AS (SELECT s / c AS m, sqrt(greatest(0, q / c - (s / c) * (s / c))) AS sd FROM s) SELECT round(quantile_cont((sd - m) / nullif(sd + m, 0), 0.5), 6) AS burstiness_pair_median FROM b""",
    "event_weighted_rho": f"WITH {dyads(USER_TYPE, (5,))} SELECT round(sum(CASE WHEN bit_count(m5) >= 2 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS rho_event_weighted FROM d",
    "one_step_retention": f"WITH {dyads(USER_TYPE)} SELECT {', '.join(f'{retention(f"m{w}", w)} AS c_w{w}' for w in (4, 5, 8))} FROM d",
    "shifted_grid_rho": f"WITH {dyads(CUST_SUPP, (5,))} SELECT round({RHO.format(m='ms', k=2)}, 6) AS rho_shifted FROM d",
    "equal_event_rho": f"""WITH {dyads(CUST_SUPP, (5,))}, r AS (SELECT u, v, floor((row_number() OVER (ORDER BY t, u, v) - 1) * 5 / (count(*) OVER ())::DOUBLE)::INT AS w FROM e),
      m AS (SELECT bit_or(1::BIGINT << w) AS m FROM r GROUP BY u, v) SELECT round({RHO.format(m="m", k=2)}, 6) AS rho_equal_event, round(avg(bit_count(m) / 5::DOUBLE), 6) AS mean_occupancy FROM m""",
    "censoring_share": f"WITH {dyads(CUST_SUPP, (5,))} SELECT round(avg(CASE WHEN {window(5).replace('(t - t0', '(first - t0')} = 4 THEN 1.0::DOUBLE ELSE 0 END), 6) AS censoring_share_lastwin FROM d",
    "winlen_over_iet": f"""WITH {dyads(USER_TYPE, (5,))}, {GAPS}, x AS (SELECT (max(t) - min(t)) / 5 AS winlen, (SELECT quantile_cont(gap, 0.5) FROM g) AS m FROM e)
      SELECT round(winlen, 6) AS winlen, round(m, 6) AS median_iet, round(winlen / m, 6) AS winlen_over_median_iet FROM x""",
    "node_count": f"WITH ev AS ({ALL}) SELECT instance_id, count(*) AS n_nodes FROM (SELECT instance_id, u FROM ev UNION SELECT instance_id, v FROM ev) GROUP BY 1",
    "multi_instance_census": f"WITH {dyads(ALL, (5,), 'instance_id')} {headline('instance_id')}",
    "tercile_classify": f"""WITH {NATION}, q AS (SELECT quantile_cont(true_2, 1 / 3::DOUBLE) AS a, quantile_cont(true_2, 2 / 3::DOUBLE) AS b FROM truth)
      SELECT instance_id, true_2, CASE WHEN true_2 <= a THEN 'hard' WHEN true_2 > b THEN 'easy' ELSE 'medium' END AS tercile FROM truth, q""",
    "window_robustness": f"""WITH {dyads(ALL, (4, 5, 8), "instance_id")}, p AS ({profile((4, 5, 8), "instance_id").replace("round(avg(", "(avg(").replace(", 6) AS rho", ") AS rho")}),
      j AS (SELECT a.instance_id, a.w, abs(a.rho - b.rho) AS c FROM p a JOIN p b USING (instance_id) WHERE a.k = 2 AND b.k = 2 AND a.w <> 5 AND b.w = 5)
      SELECT coalesce(instance_id, 'all') AS category, w, round(avg(c), 6) AS mean_change, round(max(c), 6) AS max_change FROM j GROUP BY GROUPING SETS ((instance_id, w), (w))""",
    "temporal_chunks": f"""WITH {dyads(CUST_SUPP, (5,))}, c AS (SELECT {window(6)} AS chunk, t FROM e), x AS (SELECT chunk, min(t) AS a, max(t) AS b FROM c GROUP BY 1 HAVING count(*) >= 100 AND max(t) > min(t))
      SELECT chunk::BIGINT AS chunk, count(*) AS n, round(min((t - a) / (b - a)), 6) AS lo, round(max((t - a) / (b - a)), 6) AS hi, round(avg((t - a) / (b - a)), 6) AS mean_t FROM c JOIN x USING (chunk) GROUP BY 1""",
    "rescaled_events": f"WITH ev AS ({USER_TYPE}) SELECT u, v, round(coalesce((t - min(t) OVER ()) / nullif(max(t) OVER () - min(t) OVER (), 0), 0), 6) AS t FROM ev",
    "dense_event_stream": f"""WITH {dyads(NATION_PAIR, (5,))}, i AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT u AS x FROM e UNION SELECT v FROM e))
      SELECT least(a.i, b.i) AS u, greatest(a.i, b.i) AS v, round((t - t0) / (t1 - t0), 6) AS t FROM e JOIN i a ON a.x = u JOIN i b ON b.x = v""",
    "edge_list_parse": """SELECT 'i:' || event_type AS v, count(*) AS n, round(sum(event_id)::DOUBLE, 6) AS sum_t, count(DISTINCT user_id) AS users FROM events WHERE event_id % 10 NOT IN (0, 1, 2) GROUP BY 1""",
    "reservoir_sample": f"WITH {dyads(CUST_SUPP, (5,))}, {KEYED.format(by='')} SELECT row_number() OVER (ORDER BY md5('0|' || eid), eid) AS pos, u, v, round(t, 6) AS t, eid FROM keyed QUALIFY pos <= 2000",
    "time_prefix_sample": f"WITH {dyads(CUST_SUPP, (5,))}, {KEYED.format(by='')} SELECT row_number() OVER (ORDER BY t, eid) AS pos, u, v, round(t, 6) AS t, eid FROM keyed QUALIFY pos <= 2000",
    "random_block_sample": f"""WITH {NATION}, {POSITIONS.replace("{anchor}", ANCHOR_ONE)} SELECT instance_id, round(min(t), 6) AS start, round(max(t), 6) AS "end", count(*) AS n, round(max(t) - min(t), 6) AS width
      FROM pos WHERE strategy = 'block' AND seed = 0 AND pos <= 100 GROUP BY 1""",
    "node_panel_size": """WITH x AS (SELECT n_nationkey::VARCHAR AS key, (n_nationkey * 37 + 10)::BIGINT AS nodes, (n_nationkey * 911 + 1000)::BIGINT AS events, 200::BIGINT AS budget FROM nation)
      SELECT key, nodes, events, budget, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(abs(events::DOUBLE * size * (size - 1) / (nodes::DOUBLE * (nodes - 1)) - budget), 9), size) AS r
      FROM x, range(2, 2000) s(size) WHERE size <= nodes) WHERE r = 1""",
    "node_panel_sample": f"""WITH {dyads(NATION_PAIR, (5,))}, p AS (SELECT x FROM (SELECT u AS x FROM e UNION SELECT v FROM e) ORDER BY md5('0|' || x), x LIMIT 8)
      SELECT u, v, count(*) AS n, round(min(t), 6) AS first, round(max(t), 6) AS last FROM e WHERE u IN (FROM p) AND v IN (FROM p) GROUP BY u, v""",
    "sentinel_filter": f"SELECT o_orderpriority, count(*) AS n FROM orders WHERE {u01("'0|sentinel|' || o_orderkey")} < 0.1 GROUP BY 1",
    "edge_observations": f"WITH {DENSE} SELECT u, v, n, mask, w::BIGINT AS w FROM seen",
    "nw_histogram": f"WITH {DENSE} SELECT n, w::BIGINT AS w, count(*) AS c FROM seen GROUP BY ALL",
    "nmask_histogram": f"WITH {DENSE} SELECT n, lpad(lower(to_hex(mask)), 2, '0') AS mask_hex, count(*) AS c FROM seen GROUP BY ALL",
    "window_count_histogram": f"WITH {DENSE}, k AS (SELECT {', '.join(f'sum((w = {i})::INT)::BIGINT AS c{i}' for i in range(5))} FROM lg GROUP BY u, v) SELECT c0, c1, c2, c3, c4, count(*) AS c FROM k GROUP BY ALL",
    "window_count_features": f"""WITH {DENSE}, k AS (SELECT {", ".join(f"sum((w = {i})::INT)::BIGINT AS c{i}" for i in range(5))} FROM lg GROUP BY u, v),
      p AS ({" UNION ALL ".join(f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, c{i} AS x, c{j} AS y FROM k" for i in range(5) for j in range(i, 5))})
      SELECT i, j, round(avg(x), 6) AS mean_x, round(avg(ln(1 + x)), 6) AS mean_log1p, round(avg(CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS both_share,
      round({CORR.format(x="x", y="y")}, 6) AS corr FROM p GROUP BY i, j""",
    "occupancy_features": f"""WITH {DENSE}, a AS (SELECT count(*) AS total, {", ".join(f"round(quantile_cont(n::DOUBLE, {q}), 6) AS n_q{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9))} FROM seen),
      b AS (SELECT least(n, 20) AS n_bin, w::BIGINT AS w, count(*) AS c FROM seen GROUP BY ALL) SELECT n_bin, w, c, total, n_q25, n_q50, n_q75, n_q90, round(c::DOUBLE / total, 6) AS share FROM b, a""",
    "pattern_features": f"""WITH {DENSE} SELECT round(avg({LOW}), 6) AS first_window_mean, round(avg({HIGH}), 6) AS last_window_mean, round(avg({HIGH} - {LOW} + 1), 6) AS mask_width_mean,
      round(avg(CASE WHEN {HIGH} - {LOW} + 1 > w THEN 1.0::DOUBLE ELSE 0 END), 6) AS noncontiguous_share, {retention("mask", 5)} AS adjacent_c,
      {", ".join(f"round(avg(CASE WHEN (mask & {1 << i}) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS active_w{i}" for i in range(5))} FROM seen""",
    "mask_shares": f"WITH {DENSE} SELECT mask, round(count(*)::DOUBLE / (SELECT count(*) FROM seen), 6) AS share FROM seen GROUP BY mask",
    "crawl_features": f"""WITH {DENSE}, s AS (SELECT *, pos - lag(pos) OVER w AS gap, row_number() OVER w = 1 AS fresh FROM lg WINDOW w AS (PARTITION BY u, v ORDER BY pos)),
      n AS (SELECT u AS x, pos FROM lg UNION ALL SELECT v, pos FROM lg), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY pos) AS k FROM n)
      SELECT count(*) AS steps, sum(fresh::INT)::BIGINT AS unique_edges, round(avg((NOT fresh)::INT), 6) AS revisit_rate, round(quantile_cont(gap::DOUBLE, 0.5), 6) AS return_gap_median,
      round(quantile_cont(gap::DOUBLE, 0.9), 6) AS return_gap_q90, {", ".join(f"round(sum((fresh AND pos <= {-(-2000 * q // 100)})::INT)::DOUBLE / sum((pos <= {-(-2000 * q // 100)})::INT), 6) AS discovery_{q}" for q in (10, 25, 50, 75, 100))},
      (SELECT count(DISTINCT x) FROM n) AS unique_nodes, (SELECT round(avg(d), 6) FROM (SELECT count(*) AS d FROM n GROUP BY x)) AS node_hits_mean,
      (SELECT max(d) FROM (SELECT count(*) AS d FROM n GROUP BY x)) AS node_hits_max, (SELECT min(pos) FROM k WHERE k = 2) AS first_node_collision FROM s""",
    "recent_events": f"""WITH {DENSE}, l AS (FROM lg ORDER BY pos DESC LIMIT 100), n AS (SELECT u AS x, pos * 2 AS place FROM l UNION ALL SELECT v, pos * 2 + 1 FROM l),
      i AS (SELECT x, row_number() OVER (ORDER BY min(place)) - 1 AS i FROM n GROUP BY x) SELECT pos, a.i AS a, b.i AS b, round(round_even(t, 8), 6) AS t FROM l JOIN i a ON a.x = u JOIN i b ON b.x = v""",
    "nonstationarity": f"""WITH {DENSE}, b AS (SELECT i AS b, (SELECT count(*) FROM lg WHERE least(9, floor(t * 10)::INT) = i)::DOUBLE AS c FROM range(10) r(i))
      SELECT round(stddev_pop(c) / avg(c), 6) AS rate_cv, round(regr_slope(c, b::DOUBLE) / avg(c), 6) AS slope_over_mean,
      round(sum(CASE WHEN b >= 5 THEN c ELSE 0 END) / nullif(sum(CASE WHEN b < 5 THEN c ELSE 0 END), 0), 6) AS late_early_ratio FROM b""",
    "degree_selection_ks": f"""WITH {dyads(NATION_PAIR, (5,))}, g AS (SELECT n, count(*) AS x FROM (SELECT u AS n, v AS o FROM d UNION ALL SELECT v, u FROM d) GROUP BY n),
      s AS (SELECT x FROM g WHERE n < 'n2'), k AS (SELECT abs((SELECT count(*) FROM g WHERE g.x <= a.x)::DOUBLE / (SELECT count(*) FROM g) - (SELECT count(*) FROM s WHERE s.x <= a.x)::DOUBLE / (SELECT count(*) FROM s)) AS k FROM g a)
      SELECT (SELECT count(*) FROM s) AS n_sampled, round((SELECT avg(x) FROM s) / (SELECT avg(x) FROM g), 6) AS mean_ratio, round(max(k), 6) AS ks FROM k""",
    "detection_by_window": f"""WITH {DENSE}, f AS (SELECT DISTINCT u, v, {window(5)} AS w FROM e), o AS (SELECT DISTINCT u, v, w FROM lg)
      SELECT w::BIGINT AS w, round(avg(CASE WHEN o.u IS NULL THEN 0 ELSE 1.0::DOUBLE END), 6) AS detection, count(*) AS active FROM f LEFT JOIN o USING (u, v, w) GROUP BY 1""",
    "plugin_estimators": f"WITH {DENSE} SELECT {PLUGIN}, round(avg(w / 5::DOUBLE), 6) AS mean_occupancy, round(sum(CASE WHEN w >= 2 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS rho_event_weighted, {retention('mask', 5)} AS c_one_step FROM seen",
    "conditional_estimators": f"WITH {DENSE} SELECT {', '.join(f'round(avg(CASE WHEN n >= {k} THEN CASE WHEN w >= {k} THEN 1.0::DOUBLE ELSE 0 END END), 6) AS rho_{k}_conditional' for k in range(2, 6))} FROM seen",
    "chao1_good_turing": f"""WITH {SPARSE}, x AS (SELECT count(*) AS o, sum((n = 1)::INT) AS a, sum((n = 2)::INT) AS b, sum(n) AS s FROM seen)
      SELECT o AS observed, round(o + a * (a - 1) / (2.0::DOUBLE * (b + 1)), 6) AS chao1, round(greatest(0, least(1, 1 - a::DOUBLE / s)), 6) AS good_turing_coverage FROM x""",
    "seen_label_oracle": f"""WITH {DENSE} SELECT round(avg(CASE WHEN bit_count(m5) >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rho_2_seen,
      round(sum(CASE WHEN bit_count(m5) >= 2 THEN seen.n ELSE 0 END)::DOUBLE / sum(seen.n), 6) AS rho_2_seen_weighted FROM seen JOIN d USING (u, v)""",
    "hajek_ht_oracle": f"""WITH {SPARSE}, m AS (SELECT *, row_number() OVER () AS id FROM (SELECT d.n AS m, m5, (SELECT sum(n) FROM d) AS total FROM seen JOIN d USING (u, v))),
      p AS (SELECT id, any_value(m5) AS m5, sum(ln((total - 2000 - i)::DOUBLE / (total - i))) AS l FROM m, range(0, 1000) r(i) WHERE i < m GROUP BY id)
      SELECT round(sum(1 / (1 - exp(l))), 6) AS dyads_ht, round(sum(CASE WHEN bit_count(m5) >= 2 THEN 1 / (1 - exp(l)) ELSE 0 END) / sum(1 / (1 - exp(l))), 6) AS rho_2_hajek FROM p""",
    "edgebank_auc": f"""WITH {SPARSE}, lab AS (SELECT seen.*, bit_count(m5) >= 2 AS y, (SELECT max(t) FROM lg WHERE lg.u = seen.u AND lg.v = seen.v) AS recent FROM seen JOIN d USING (u, v))
      SELECT *, 'frequency' AS score FROM ({auc("n")}) UNION ALL SELECT *, 'recency' FROM ({auc("recent")})""",
    "pava_projection": f"""WITH x AS (SELECT s_suppkey, {", ".join(f"greatest(0, least(1, (((s_suppkey * {37 + 11 * i} + {i * i * 13}) % 131) / 100::DOUBLE - 0.1::DOUBLE))) AS y{i}" for i in range(4))} FROM supplier)
      SELECT s_suppkey, {", ".join("round(greatest(" + ", ".join("least(" + ", ".join("(" + " + ".join(f"y{q}" for q in range(a, j + 1)) + f") / {j - a + 1}" for a in range(i + 1)) + ")" for j in range(i, 4)) + f"), 6) AS y{i}" for i in range(4))} FROM x""",
    "case_table": f"WITH {CASES} SELECT * REPLACE (seed::BIGINT AS seed, budget::BIGINT AS budget, round(coverage, 6) AS coverage) FROM cases",
    "coverage_bands": f"""WITH {CASES} SELECT CASE WHEN coverage <= 0.05 THEN 'to 5%' WHEN coverage <= 0.1 THEN 'to 10%' WHEN coverage <= 0.2 THEN 'to 20%' ELSE 'over 20%' END AS band, count(*) AS n,
      round(avg(abs(pred_2 - true_2)), 6) AS mae FROM cases GROUP BY 1""",
    "mean_median_floor": f"""WITH {CASES}, {FOLDS}, h AS (SELECT DISTINCT fold AS held FROM folds) SELECT held::BIGINT AS fold, round(avg(true_2), 6) AS mean_floor, round(quantile_cont(true_2, 0.5), 6) AS median_floor
      FROM cases JOIN folds USING (group_id), h WHERE fold <> held GROUP BY 1""",
    "logo_floor": f"""WITH {CASES}, g AS (SELECT strategy, group_id, sum(true_2) AS s, count(*) AS c FROM cases GROUP BY ALL)
      SELECT strategy, group_id, round((sum(s) OVER w - s) / nullif(sum(c) OVER w - c, 0) + 1e-9::DOUBLE, 6) AS floor FROM g WINDOW w AS (PARTITION BY strategy)""",
    "metric_table": f"WITH {PREDICTIONS} {METRICS}",
    "metric_slices": f"""WITH {PREDICTIONS} SELECT model, CASE WHEN grouping(strategy) = 0 THEN 'strategy' WHEN grouping(budget) = 0 THEN 'budget' WHEN grouping(seed) = 0 THEN 'seed' ELSE 'overall' END AS slice,
      coalesce(strategy, budget::VARCHAR, seed::VARCHAR, 'all') AS slice_value, count(*) AS n, round(avg(abs(err)), 6) AS mae, round(avg(err), 6) AS bias
      FROM ok GROUP BY GROUPING SETS ((model), (model, strategy), (model, budget), (model, seed))""",
    "model_rankings": f"""WITH {PREDICTIONS}, m AS (SELECT model, strategy, round(avg(g), 9) AS macro FROM (SELECT model, strategy, group_id, avg(abs(err)) AS g FROM ok GROUP BY ALL) GROUP BY ALL)
      SELECT strategy, model, round(macro, 6) AS macro_mae, rank() OVER (PARTITION BY strategy ORDER BY macro) + (count(*) OVER (PARTITION BY strategy, macro) - 1) / 2::DOUBLE AS rank FROM m""",
    "spearman_by_group": f"""WITH {CASES}, r AS (SELECT strategy, budget, rank() OVER (PARTITION BY strategy, budget ORDER BY pred_2) + (count(*) OVER (PARTITION BY strategy, budget, pred_2) - 1) / 2::DOUBLE AS x,
      rank() OVER (PARTITION BY strategy, budget ORDER BY true_2) + (count(*) OVER (PARTITION BY strategy, budget, true_2) - 1) / 2::DOUBLE AS y FROM cases)
      SELECT strategy, budget::BIGINT AS budget, round({CORR.format(x="x", y="y")}, 6) AS spearman, count(*) AS n FROM r GROUP BY 1, 2""",
    "beta_selection": f"""WITH {PREDICTIONS}, {FOLDS}, s AS (SELECT strategy, fold, parameter, sum(abs(err)) AS s, count(*) AS c FROM ok JOIN folds USING (group_id) GROUP BY ALL),
      o AS (SELECT strategy, fold, parameter, (sum(s) OVER w - s) / (sum(c) OVER w - c) AS mae FROM s WINDOW w AS (PARTITION BY strategy, parameter))
      SELECT strategy, fold::BIGINT AS fold, parameter, round(mae, 6) AS train_mae FROM o QUALIFY row_number() OVER (PARTITION BY strategy, fold ORDER BY round(mae, 9), parameter) = 1""",
    "profile_mae": f"WITH {CASES} SELECT strategy, budget::BIGINT AS budget, group_id, round(avg({PMAE}), 6) AS pmae, count(*) AS n FROM cases GROUP BY ALL",
    "variance_components": f"""WITH {CASES}, p AS (SELECT strategy, budget, group_id, instance_id, {PMAE} AS x FROM cases WHERE strategy <> 'time_prefix'),
      a AS (SELECT strategy, budget, group_id, instance_id, avg(x) AS m, var_samp(x) AS v, count(*) AS s FROM p GROUP BY ALL),
      b AS (SELECT strategy, budget, group_id, avg(m) AS m, var_samp(m) AS v, count(*) AS i, avg(v) AS vs, avg(s) AS s FROM a GROUP BY ALL),
      c AS (SELECT strategy, budget, count(*) AS groups, var_samp(m) AS vg, avg(v) AS vi, avg(vs) AS vs, avg(i) AS i, avg(s) AS s, avg(m) AS macro FROM b GROUP BY ALL),
      x AS (SELECT *, coalesce(vs, 0) AS seed_var, greatest(0, coalesce(vi, 0) - coalesce(vs, 0) / s) AS instance_var FROM c)
      SELECT strategy, budget::BIGINT AS budget, groups, round(macro, 6) AS macro, round(seed_var, 6) AS seed_var, round(instance_var, 6) AS instance_var,
      round(greatest(0, coalesce(vg, 0) - instance_var / i - seed_var / (i * s)), 6) AS group_var, round(sqrt(coalesce(vg, 0) / groups), 6) AS se, round(2.8::DOUBLE * sqrt(coalesce(vg, 0) / groups), 6) AS mdd FROM x""",
    "target_distribution": f"""WITH {NATION} SELECT group_id, count(true_2) AS n, round(avg(true_2), 6) AS mean, round(stddev_samp(true_2), 6) AS std, min(true_2) AS min, round(quantile_cont(true_2, 0.5), 6) AS median, max(true_2) AS max FROM truth GROUP BY 1""",
    "seed_noise_floor": f"""WITH {CASES}, s AS (SELECT strategy, budget, instance_id, stddev_pop(pred_2) AS sd FROM cases WHERE strategy <> 'time_prefix' GROUP BY ALL)
      SELECT strategy, budget::BIGINT AS budget, round(avg(sd), 6) AS mean_sd, round(quantile_cont(sd, 0.5), 6) AS median_sd, round(max(sd), 6) AS max_sd FROM s GROUP BY 1, 2""",
    "even_spaced_pick": """WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
      SELECT c_mktsegment, c_custkey, round(c_acctbal, 6) AS c_acctbal FROM r WHERE r IN (SELECT round_even(i::DOUBLE * (n - 1) / 5, 0)::BIGINT FROM range(6) s(i))""",
    "round_robin_strata": """SELECT s_nationkey::BIGINT AS s_nationkey, s_suppkey, turn FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier) ORDER BY turn, s_nationkey, s_suppkey LIMIT 40""",
    "hash_block_pick": """SELECT p_brand, id, pick FROM (SELECT p_brand, p_partkey::VARCHAR AS id, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('0|' || p_partkey), p_partkey::VARCHAR) AS pick FROM part) WHERE pick <= 2""",
    "nearest_profile_pairs": f"""WITH {NATION}, s AS (SELECT avg(true_2) AS a, stddev_pop(true_2) AS b, avg(true_c) AS c, stddev_pop(true_c) AS f FROM truth),
      z AS (SELECT instance_id, coalesce((true_2 - a) / nullif(b, 0), 0) AS x, coalesce((true_c - c) / nullif(f, 0), 0) AS y FROM truth, s),
      p AS (SELECT i.instance_id, j.instance_id AS other, round(sqrt((i.x - j.x) ** 2 + (i.y - j.y) ** 2), 9) AS distance FROM z i JOIN z j ON i.instance_id <> j.instance_id)
      SELECT DISTINCT least(instance_id, other) AS a, greatest(instance_id, other) AS b, round(distance, 6) AS distance FROM (FROM p QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY distance, other) = 1)""",
    "answer_parse": f"""WITH {RECORDS} SELECT event_id, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND x BETWEEN 0 AND 1 THEN round(x, 6) END AS rho_k2, 0.25::DOUBLE AS rho_k3, NULL::DOUBLE AS rho_k4 FROM rec""",
    "latest_answer_wins": f"WITH {RECORDS} SELECT prompt_id, event_id, finish_reason FROM rec QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY complete DESC, event_id DESC) = 1",
    "legacy_last_values": f"""WITH {RECORDS} SELECT prompt_id, round(arg_max(CASE WHEN complete THEN x END, CASE WHEN complete THEN event_id END), 6) AS v, arg_max(finish_reason, event_id) AS finish_reason FROM rec GROUP BY 1""",
    "frozen_score": f"""WITH {CASES}, h AS (SELECT *, {u01("'miss|' || case_id")} AS h FROM cases), r AS (SELECT strategy, budget, h >= 0.1 AS answered, CASE WHEN h >= 0.2 THEN pred_2 END AS p2,
      CASE WHEN h >= 0.1 THEN pred_3 END AS p3, CASE WHEN h >= 0.1 THEN pred_4 END AS p4, CASE WHEN h >= 0.1 THEN pred_5 END AS p5, true_2, true_3, true_4, true_5 FROM h),
      s AS (SELECT *, (coalesce(abs(p2 - true_2), 1) + coalesce(abs(p3 - true_3), 1) + coalesce(abs(p4 - true_4), 1) + coalesce(abs(p5 - true_5), 1)) / 4 AS loss,
      (p2 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT + (p4 IS NOT NULL)::INT + (p5 IS NOT NULL)::INT AS good FROM r)
      SELECT strategy, budget::BIGINT AS budget, count(*) AS cases, sum((NOT answered)::INT)::BIGINT AS missing, sum((answered AND good < 4)::INT)::BIGINT AS failed,
      round(avg(CASE WHEN answered THEN loss END), 6) AS penalized_pmae, round(avg(CASE WHEN answered AND good = 4 THEN loss END), 6) AS complete_pmae,
      round(avg(CASE WHEN answered THEN good / 4::DOUBLE END), 6) AS validity, round(avg(abs(p2 - true_2)), 6) AS rho2_mae, round(avg(p2 - true_2), 6) AS rho2_bias,
      round(avg(CASE WHEN answered THEN coalesce(p2 < p3 OR p3 < p4 OR p4 < p5, false)::INT::DOUBLE END), 6) AS violation_rate FROM s GROUP BY 1, 2""",
    "interval_coverage": f"""WITH {CASES} SELECT strategy, count(*) AS n, round(avg((true_2 BETWEEN pred_2 - 0.05::DOUBLE AND pred_2 + 0.1::DOUBLE)::INT), 6) AS cover,
      round(avg((pred_2 + 0.1::DOUBLE) - (pred_2 - 0.05::DOUBLE)), 6) AS width FROM cases GROUP BY 1""",
    "paired_delta": f"""WITH {CASES}, r AS (SELECT instance_id || '|' || budget AS c, strategy, avg(abs(pred_2 - true_2)) AS x FROM cases GROUP BY ALL),
      j AS (SELECT a.strategy, a.x - b.x AS d FROM r a JOIN r b USING (c) WHERE a.strategy <> 'reservoir' AND b.strategy = 'reservoir')
      SELECT strategy, count(*) AS n, round(avg(d), 6) AS delta, round(stddev_samp(d) / sqrt(count(*)), 6) AS se FROM j GROUP BY 1""",
    "cost_rollup": """WITH r AS (SELECT role, strlen(text) % 1000 AS h, strlen(text) AS m, length(text) AS o FROM conversations)
      SELECT role, count(*) AS calls, sum(h)::BIGINT AS hit_tokens, sum(m)::BIGINT AS miss_tokens, sum(o)::BIGINT AS out_tokens,
      round((sum(h) * 0.028::DOUBLE + sum(m) * 0.28::DOUBLE + sum(o) * 0.42::DOUBLE) / 1e6, 6) AS usd FROM r GROUP BY 1""",
    "attempt_stats": f"WITH {RECORDS} SELECT prompt_id, count(*) AS attempts, sum(complete::INT)::BIGINT AS complete, sum(complete::INT) = 0 AS todo FROM rec GROUP BY 1",
    "paired_cell_select": f"WITH {RECORDS} SELECT DISTINCT prompt_id FROM rec WHERE complete AND prompt_id IN (SELECT n_nationkey * 3 FROM nation)",
    "timestamp_shuffle": f"""WITH {dyads(USER_TYPE, (5,))}, {KEYED.format(by="")}, a AS (SELECT u, v, eid, row_number() OVER (ORDER BY t, eid) AS i FROM keyed),
      b AS (SELECT t, row_number() OVER (ORDER BY md5('0|' || eid), eid) AS i FROM keyed) SELECT u, v, eid, round(t, 6) AS t FROM a JOIN b USING (i)""",
    "within_window_shuffle": f"""WITH {dyads(USER_TYPE, (5,))}, {KEYED.format(by="")}, k AS (SELECT *, {window(5)} AS w FROM keyed), a AS (SELECT u, v, eid, w, row_number() OVER (PARTITION BY w ORDER BY t, eid) AS i FROM k),
      b AS (SELECT t, w, row_number() OVER (PARTITION BY w ORDER BY md5('0|' || eid), eid) AS i FROM k) SELECT u, v, eid, round(t, 6) AS t FROM a JOIN b USING (w, i)""",
    "lifetime_resample": f"""WITH {dyads(USER_TYPE, (5,))}, {KEYED.format(by="")}, x AS (SELECT keyed.* REPLACE ((t - keyed.t0) / (keyed.t1 - keyed.t0) AS t), (d.first - d.t0) / (d.t1 - d.t0) AS a, (d.last - d.t0) / (d.t1 - d.t0) AS b, d.n AS c, split_part(eid, '|', 3)::BIGINT AS k FROM keyed JOIN d USING (u, v))
      SELECT u, v, eid, round(CASE WHEN k = 1 THEN a WHEN k = c THEN b ELSE a + (b - a) * {u01("'0|life|' || eid")} END, 6) AS t FROM x""",
    "time_respecting_paths": f"""WITH RECURSIVE ev AS ({NATION_PAIR}), both_ways AS (SELECT u AS a, v AS b, t FROM ev UNION ALL SELECT v, u, t FROM ev),
      r1 AS (SELECT b AS node, min(t) AS arrival FROM both_ways WHERE a = 'n0' GROUP BY 1),
      r2 AS (SELECT b AS node, min(t) AS arrival FROM r1 JOIN both_ways ON node = a AND t > arrival GROUP BY 1),
      r3 AS (SELECT b AS node, min(t) AS arrival FROM r2 JOIN both_ways ON node = a AND t > arrival GROUP BY 1),
      r4 AS (SELECT b AS node, min(t) AS arrival FROM r3 JOIN both_ways ON node = a AND t > arrival GROUP BY 1)
      SELECT hop, node, round(arrival, 6) AS arrival FROM (SELECT 1::BIGINT AS hop, * FROM r1 UNION ALL SELECT 2, * FROM r2 UNION ALL SELECT 3, * FROM r3 UNION ALL SELECT 4, * FROM r4)""",
}
