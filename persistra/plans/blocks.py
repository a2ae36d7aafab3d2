"""Queries over whole feature blocks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.operators import blocks
from persistra.plans.oracles import CORR, DENSE, HIGH, LOW
from persistra.plans.panels import UP
from persistra.plans.queries import QUERIES, dense_log, query, rounded

ORACLES: dict[str, str] = {}
BUDGET = 600
CHECKPOINTS = (50, 200, 500, 5000)
WS = range(5)


def block(sql: str):
    def register(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return register


#: three logs with restarts, cut from the reservoir
LOGS = f"""{DENSE}, logs AS (SELECT *, t - lag(t) OVER (PARTITION BY part ORDER BY pos) AS dt, v AS node, CASE WHEN pos % 16 = 1 THEN 0 ELSE 1 END AS kind
  FROM (SELECT pos % 3 AS part, (pos - 1) // 3 + 1 AS pos, u, v, t, w FROM lg))"""


def logs(spark, d):
    log = dense_log(spark, d).withColumn("part", F.col("pos") % 3).withColumn("pos", F.expr("cast((pos - 1) div 3 + 1 as int)"))
    order = W.partitionBy("part").orderBy("pos")
    return log.withColumn("dt", F.col("t") - F.lag("t").over(order)).withColumn("node", F.col("v")).withColumn("kind", F.expr("if(pos % 16 = 1, 0, 1)"))


def long(wide: dict[str, str], source: str, by: str = "part") -> str:
    """SELECT of (by, feature, value) from one grouped aggregate."""
    columns = ", ".join(f"({x})::DOUBLE AS {name}" for name, x in wide.items())
    return f"SELECT {by}, feature, value FROM (SELECT {by}, {columns} FROM {source} GROUP BY {by}) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(wide)}))"


def share(x: str) -> str:
    return f"avg(CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0 END)"


def given(cond: str, x: str) -> str:
    return f"avg(CASE WHEN {cond} THEN CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0 END END)"


def quantiles(x: str, stem: str) -> dict[str, str]:
    return {f"{stem}_q{q}": f"quantile_cont(({x})::DOUBLE, {q / 100})" for q in blocks.QUANTILES}


def block_sql(ctes: str, *parts: str) -> str:
    return f"WITH {LOGS}, {STEPS}{ctes} SELECT part::BIGINT AS part, feature, round(value + {UP}::DOUBLE, 6) AS value FROM ({' UNION ALL '.join(parts)})"


STEPS = f"""st AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY pos) AS i, count(*) OVER (PARTITION BY part) AS steps FROM logs WHERE kind = 1 AND pos <= {BUDGET}),
num AS (SELECT *, i - lag(i) OVER (PARTITION BY part, u, v ORDER BY i) AS gap, row_number() OVER (PARTITION BY part, u, v ORDER BY i) = 1 AS fresh FROM st),
obs AS (SELECT *, bit_count(mask) AS w, {LOW} AS lo, {HIGH} AS hi FROM (
  SELECT part, u, v, count(*) AS n, bit_or(1::BIGINT << w) AS mask, CASE WHEN count(*) > 1 THEN max(t) - min(t) END AS life, {", ".join(f"count(*) FILTER (w = {w}) AS c{w}" for w in WS)} FROM logs WHERE kind = 1 GROUP BY part, u, v))"""

WCNT = {f"wcnt__w{w}_n{k}{'p' if k == 5 else ''}": share(f"least(c{w}, 5) = {k}") for w in WS for k in range(6)}
WCNT |= {f"wcnt__w{w}_mean": f"avg(c{w})" for w in WS}
for a in WS:
    for b in range(a + 1, 5):
        WCNT[f"wcnt__corr_w{a}_w{b}"] = CORR.format(x=f"c{a}", y=f"c{b}")
        WCNT[f"wcnt__both_positive_w{a}_w{b}"] = share(f"c{a} > 0 AND c{b} > 0")
WCNT |= {"wcnt__log_observed_dyads": "ln(1 + count(*))", "wcnt__normalization_denom": "count(*)"}


def cells(cap: int) -> list[tuple[str, str]]:
    return [(n, f"n >= {cap}" if n.endswith("p") else f"n = {n}") for n in blocks.labels(cap)]


OCC = {f"occ__n{n}_w{w}": share(f"{x} AND w = {w}") for n, x in cells(20) for w in range(1, 6)}
OCC |= {"occ__log_unique_edges": "ln(1 + count(*))", "occ__observations_per_edge": "avg(n)", **quantiles("n", "occ__n")}
PAT = {f"pat__mask_{m:02x}": share(f"mask = {m}") for m in range(1, 32)} | {f"pat__n{n}_mask{m:02x}": share(f"{x} AND mask = {m}") for n, x in cells(10) for m in range(1, 32)}
PAT |= {f"pat__first_w{w}": share(f"lo = {w}") for w in WS} | {f"pat__last_w{w}": share(f"hi = {w}") for w in WS}
PAT |= {"pat__adjacent_observed_C": "sum(bit_count(mask & (mask >> 1)))::DOUBLE / nullif(sum(bit_count(mask & 15)), 0)"}
PAT |= {"pat__noncontiguous_edge_share": share("hi - lo + 1 > w"), "pat__mean_mask_width": "avg(hi - lo)"}
PAT |= {**quantiles("life", "pat__lifetime"), "pat__lifetime_mean": "avg(life)"}
EVENT_SHARES = {f"pat__event_share_w{w}": share(f"w = {w}") for w in WS}
IET = {**quantiles("gap", "pat__iet"), "pat__iet_mean": "avg(gap)"}
GAPS = "(SELECT part, t - lag(t) OVER (PARTITION BY part, u, v ORDER BY t) AS gap FROM logs WHERE kind = 1)"
SIZE = {"crawl__log_budget": f"ln(1 + {BUDGET})", "crawl__step_fraction": f"sum(kind) / {BUDGET}::DOUBLE", "crawl__restart_fraction": f"sum(1 - kind) / {BUDGET}::DOUBLE"}
FOUND = {"crawl__log_unique_edges": "ln(1 + count(*) FILTER (fresh))", "crawl__edge_revisit_rate": share("NOT fresh")}
FOUND |= {f"crawl__discovery_{q:03d}": given(f"i <= greatest(1, ceil({q / 100}::DOUBLE * steps))", "fresh") for q in blocks.PARTS}
FOUND |= {**quantiles("gap", "crawl__return_gap"), **quantiles("dt", "crawl__dt"), "crawl__observed_time_span": "max(t) - min(t)"}
ENDS = "(SELECT {by}, x, count(*) AS d FROM (SELECT {by}, u AS x FROM {num} WHERE fresh UNION ALL SELECT {by}, v FROM {num} WHERE fresh) GROUP BY ALL)"
DEGREE = {"crawl__observed_degree_mean": "avg(d)", "crawl__observed_degree_max": "max(d)"}
VISITS = f", visit AS (SELECT part, node AS x, row_number() OVER (PARTITION BY part ORDER BY pos) - 1 AS i FROM logs WHERE pos <= {BUDGET})"


@block(block_sql("", long(WCNT, "obs")))
def window_count_block(spark, d):
    return rounded(blocks.window_count_block(logs(spark, d), ["part"]), UP)


@block(block_sql("", long(OCC, "obs")))
def occupancy_block(spark, d):
    return rounded(blocks.occupancy_block(logs(spark, d), ["part"]), UP)


@block(block_sql("", long(PAT, "obs"), long(EVENT_SHARES, "(SELECT * FROM logs WHERE kind = 1)"), long(IET, GAPS)))
def pattern_block(spark, d):
    return rounded(blocks.pattern_block(logs(spark, d), ["part"]), UP)


@block(block_sql(VISITS, long(SIZE, f"(SELECT * FROM logs WHERE pos <= {BUDGET})"), long(FOUND, "num"), long(quantiles("n", "crawl__edge_hits"), "(SELECT part, u, v, count(*) AS n FROM num GROUP BY ALL)"),
    long({"crawl__log_unique_nodes": "ln(1 + count(*))", **quantiles("n", "crawl__node_hits")}, "(SELECT part, x, count(*) AS n FROM visit GROUP BY ALL)"), long(DEGREE, ENDS.format(by="part", num="num")),
    long({"crawl__first_node_collision_frac": "coalesce(min(CASE WHEN k = 2 THEN i END) / count(*)::DOUBLE, 1)"}, "(SELECT *, row_number() OVER (PARTITION BY part, x ORDER BY i) AS k FROM visit)")))
def crawl_block(spark, d):
    return rounded(blocks.crawl_block(logs(spark, d), ["part"], BUDGET), UP)


def summary_sql() -> str:
    key = "part, budget"
    r = f"round({{}} + {UP}::DOUBLE, 6) AS {{}}"
    found = {"unique_edges": "count(*) FILTER (fresh)"}
    rates = {
        "edge_revisit_rate": share("NOT fresh"), "discovery_rate_first_half": given("i <= steps // 2", "fresh"), "discovery_rate_second_half": given("steps > 1 AND i > steps // 2", "fresh"),
        "return_time_steps_mean": "avg(gap)", "windows_covered_frac": "count(DISTINCT w) / 5::DOUBLE", "step_dt_mean": "avg(dt)", "step_dt_median": "quantile_cont(dt, 0.5)",
    }
    seen = {
        "walk_rho_plugin": share("w >= 2"), "share_edges_multi_observed": share("n >= 2"), "walk_rho_conditional": given("n >= 2", "w >= 2"),
        "mean_windows_per_observed_edge": "avg(w)", "mean_window_gap_revisits": "avg(CASE WHEN w >= 2 THEN hi - lo END)",
    }
    return f"""WITH {LOGS}, cut AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY part) AS size FROM logs), (VALUES {", ".join(f"({b})" for b in CHECKPOINTS)}) b(budget) WHERE pos <= budget AND budget <= size
), st AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS i, count(*) OVER (PARTITION BY {key}) AS steps FROM cut WHERE kind = 1
), num AS (SELECT *, i - lag(i) OVER (PARTITION BY {key}, u, v ORDER BY i) AS gap, row_number() OVER (PARTITION BY {key}, u, v ORDER BY i) = 1 AS fresh FROM st
), ob AS (SELECT *, bit_count(mask) AS w, {LOW} AS lo, {HIGH} AS hi FROM (SELECT {key}, u, v, count(*) AS n, bit_or(1::BIGINT << w) AS mask FROM st GROUP BY ALL)
), sa AS (SELECT {key}, sum(kind)::BIGINT AS n_observed_events, sum(1 - kind)::BIGINT AS n_restarts, count(DISTINCT node) AS unique_nodes FROM cut GROUP BY ALL
), sb AS (SELECT {key}, {", ".join(f"{x} AS {n}" for n, x in found.items())}, {", ".join(r.format(x, n) for n, x in rates.items())} FROM num GROUP BY {key}
), sc AS (SELECT {key}, {r.format("avg(d)", "observed_deg_mean")}, max(d) AS observed_deg_max FROM {ENDS.format(by=key, num="num")} GROUP BY {key}
), se AS (SELECT {key}, {", ".join(r.format(x, n) for n, x in seen.items())} FROM ob GROUP BY {key}
) SELECT * REPLACE (part::BIGINT AS part, budget::BIGINT AS budget) FROM sa LEFT JOIN sb USING ({key}) LEFT JOIN sc USING ({key}) LEFT JOIN se USING ({key})"""


@block(summary_sql())
def walk_checkpoints(spark, d):
    return rounded(blocks.walk_checkpoints(logs(spark, d), ["part"], CHECKPOINTS), UP)


assert all(n in QUERIES for n in ORACLES)
