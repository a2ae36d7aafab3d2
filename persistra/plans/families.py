"""Queries over families, designs and picks, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from persistra.operators import evaluate, families, reports
from persistra.plans.cases import cases, nation_events, truth
from persistra.plans.oracles import CASES, CUST_SUPP, DENSE, FOLDS, NATION, RECORDS, u01
from persistra.plans.panels import UP, _r
from persistra.plans.queries import QUERIES, answer_records, dense_seen, query, rounded
from persistra.sources.streams import cust_supp, table

ORACLES: dict[str, str] = {}
QUOTA = 6
TIMES = 2000
SIZES, SUBSTRATES, TARGETS = (100, 300, 1000), ("er", "dcsbm"), (0.1, 0.3, 0.5)


def family(sql: str):
    def register(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return register


def normal_sql(what: str, key: str) -> str:
    a, b = (u01(f"'0|{what}{x}|' || {key}") for x in "ab")
    return f"(sqrt(-2 * ln(1 - {a})) * cos(2 * pi() * {b}))"


@family(f"""SELECT m, count(*) AS n FROM (
  SELECT CASE WHEN {u01("'0|single|' || p_partkey")} < 0.35 THEN 1 ELSE 1 + greatest(1, round_even(2 * exp(0.9::DOUBLE * {normal_sql("extra", "p_partkey")}), 0)) END::BIGINT AS m FROM part) GROUP BY m""")
def drawn_event_counts(spark, d):
    return families.event_counts(table(spark, d, "part").select("p_partkey"), "p_partkey").groupBy("m").agg(F.count("*").alias("n"))


@family(f"SELECT i, round({u01("'0|time|' || i")} + {UP}::DOUBLE, 6) AS t FROM range({TIMES}) r(i)")
def uniform_times(spark, d):
    return rounded(families.times(spark, TIMES), UP)


@family(f"""SELECT i, {_r("(run - start) / (end_ - start) * (1 - 1e-9::DOUBLE)", "t")} FROM (
  SELECT i, sum(gap) OVER (ORDER BY i) AS run, first_value(gap) OVER (ORDER BY i) AS start, sum(gap) OVER () AS end_ FROM (
    SELECT i, exp(1.6::DOUBLE * {normal_sql("gap", "i")}) AS gap FROM range({TIMES}) r(i)))""")
def bursty_times(spark, d):
    return rounded(families.times(spark, TIMES, "bursty"), UP)


@family(f"""WITH e AS (SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS m FROM ({CUST_SUPP}) WHERE u <> v GROUP BY ALL),
  g AS (SELECT x, count(*) AS deg FROM (SELECT u AS x FROM e UNION ALL SELECT v FROM e) GROUP BY x)
  SELECT e.u, e.v, m, a.deg AS deg_u, b.deg AS deg_v FROM e JOIN g a ON a.x = e.u JOIN g b ON b.x = e.v""")
def stream_family(spark, d):
    return families.family_from_events(cust_supp(spark, d))


@family(f"""SELECT n, substrate, target, 'f' || n || substrate AS family, {u01("'0|' || n || substrate || target")} < 0.5 AS hub_bias FROM
  (VALUES {", ".join(f"({x}::BIGINT)" for x in SIZES)}) a(n), (VALUES {", ".join(f"('{x}')" for x in SUBSTRATES)}) b(substrate), (VALUES {", ".join(f"({x}::DOUBLE)" for x in TARGETS)}) c(target)""")
def pilot_grid(spark, d):
    from persistra.functions.exprs import u01 as uniform

    g = families.grid(spark, n=SIZES, substrate=SUBSTRATES, target=TARGETS)
    return g.withColumn("family", F.concat(F.lit("f"), "n", "substrate")).withColumn("hub_bias", uniform("0", F.concat("n", "substrate", F.col("target").cast("string"))) < 0.5)


@family(f"""WITH {CASES} SELECT strategy, budget::BIGINT AS budget, count(pred_2) AS n_inst, {_r("avg(pred_2)", "achieved_mean")}, {_r("stddev_samp(pred_2)", "achieved_sd")},
  {_r("avg(abs(pred_2 - true_2))", "abs_dev_mean")}, {_r("max(abs(pred_2 - true_2))", "abs_dev_max")} FROM cases GROUP BY strategy, budget""")
def calibration_report(spark, d):
    return rounded(families.calibration(cases(spark, d), ["strategy", "budget"], "true_2", "pred_2"), UP)


def _pairs(spark, d):
    t = truth(nation_events(spark, d))
    near = evaluate.nearest_profiles(t, "instance_id", ["true_2", "true_3", "true_4", "true_5"])
    of = lambda s: t.select(F.col("instance_id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("true_2", "true_3", "true_4", "true_5", "true_c")))
    both = near.join(F.broadcast(of("a")), "a").join(F.broadcast(of("b")), "b")
    delta = F.greatest(*(F.abs(F.col(f"a_true_{k}") - F.col(f"b_true_{k}")) for k in range(2, 6)))
    return both.select("a", "b", F.round(delta, 6).alias("delta"), F.round(F.abs(F.col("a_true_c") - F.col("b_true_c")), 6).alias("gap"))


KS = range(2, 6)
PAIRS = f"""{NATION}, s AS (SELECT {", ".join(f"avg(true_{k}) AS m{k}, stddev_pop(true_{k}) AS s{k}" for k in KS)} FROM truth),
  z AS (SELECT instance_id, {", ".join(f"true_{k}, coalesce((true_{k} - m{k}) / nullif(s{k}, 0), 0) AS z{k}" for k in KS)}, true_c FROM truth, s),
  p AS (SELECT i.instance_id AS i, j.instance_id AS j, round(sqrt({" + ".join(f"(i.z{k} - j.z{k}) ** 2" for k in KS)}), 9) AS distance,
    round(greatest({", ".join(f"abs(i.true_{k} - j.true_{k})" for k in KS)}), 6) AS delta, round(abs(i.true_c - j.true_c), 6) AS gap FROM z i JOIN z j ON i.instance_id <> j.instance_id),
  pairs AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b, delta, gap FROM (FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY distance, j) = 1)),
  many AS (SELECT *, count(*) FILTER (delta <= 0.03) OVER () AS close FROM pairs)"""


@family(f"WITH {PAIRS} SELECT a, b, delta, gap FROM many WHERE close < 20 OR delta <= 0.03 ORDER BY CASE WHEN close >= 20 THEN 0 ELSE delta END, gap DESC, a, b LIMIT 100")
def matched_profiles(spark, d):
    return families.near_profile_candidates(_pairs(spark, d), "delta", "gap", ["a", "b"])


LINES = " || chr(10) || ".join(f"'n = {b} | ' || " + " || ' ' || ".join(f"count(*) FILTER (b = '{b}' AND w = {w})" for w in range(1, 6)) for b in families.BINS)


@family(f"""WITH {DENSE} SELECT 'events | w=1 w=2 w=3 w=4 w=5' || chr(10) || {LINES} AS "table"
  FROM (SELECT w, CASE WHEN n <= 5 THEN n::VARCHAR WHEN n <= 10 THEN '6-10' ELSE '11+' END AS b FROM seen)""")
def prompt_table(spark, d):
    return families.prompt_table(dense_seen(spark, d))


@query
def farthest_pick(spark, d):
    return families.farthest_pick(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").cast("double").alias("s_acctbal")), ["s_nationkey"], "s_suppkey", "s_acctbal", QUOTA)


@family(f"""WITH {NATION}, {FOLDS}, f AS (SELECT instance_id, fold, true_2, true_3, true_c FROM truth JOIN folds USING (group_id)),
  long AS (SELECT instance_id, fold, 'rho_2' AS feature, true_2 AS x, true_c AS y FROM f UNION ALL SELECT instance_id, fold, 'rho_3', true_3, true_c FROM f),
  p AS (SELECT a.feature, a.y, (SELECT regr_intercept(b.y, b.x) + regr_slope(b.y, b.x) * a.x FROM long b WHERE b.feature = a.feature AND b.fold <> a.fold) AS p FROM long a WHERE a.x IS NOT NULL AND a.y IS NOT NULL)
  SELECT feature, count(*) AS n, {_r("1 - avg((y - p) ** 2) / var_pop(y)", "r2_oof")}, {_r("avg(abs(y - p))", "mae_oof")}, {_r("var_pop(y - p)", "residual_variance")}, {_r("var_pop(y)", "target_variance")}
  FROM p WHERE p IS NOT NULL GROUP BY feature""")
def retention_from_profile(spark, d):
    t = truth(nation_events(spark, d)).withColumn("fold", F.expr("int(substr(group_id, 2)) % 3"))
    fit = lambda x: evaluate.fit_quality(evaluate.oof_line(t, "instance_id", "fold", x, "true_c")).withColumn("feature", F.lit(x.replace("true", "rho")))
    return rounded(fit("true_2").unionByName(fit("true_3")), UP)


@family(f"""WITH {RECORDS}, m AS (SELECT *, user_id % 4 AS model, complete AND x BETWEEN 0 AND 1 AS ok FROM rec),
  a AS (SELECT model, count(*) AS records, count(DISTINCT prompt_id) AS prompts, {_r("avg(complete::INT::DOUBLE)", "complete_share")}, {_r("avg(coalesce(ok, false)::INT::DOUBLE)", "valid_share")},
    {_r("avg(CASE WHEN ok THEN (abs(x - 0.25) <= 1e-6)::INT::DOUBLE END)", "anchor_share")} FROM m GROUP BY model),
  b AS (SELECT model, {_r("sum(CASE WHEN c > 1 THEN c ELSE 0 END)::DOUBLE / sum(c)", "repeated_share")} FROM (SELECT model, x, count(*) AS c FROM m WHERE ok GROUP BY ALL) GROUP BY model)
  SELECT model::BIGINT AS model, records, prompts, complete_share, valid_share, anchor_share, repeated_share FROM a LEFT JOIN b USING (model)""")
def answer_inventory(spark, d):
    records = answer_records(spark, d).withColumn("model", F.col("model_id") % 4)
    return rounded(reports.inventory(records, ["model"], "x", "complete", 0.25), UP)


assert all(n in QUERIES for n in ORACLES)
