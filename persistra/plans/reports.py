"""Queries over the reports, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from persistra.operators import answers, evaluate, reports
from persistra.plans.cases import cases
from persistra.plans.oracles import CASES, DENSE, RECORDS
from persistra.plans.panels import UP, _r, _u01
from persistra.plans.queries import QUERIES, answer_records, dense_log, query, rounded
from persistra.sources.streams import table

ORACLES: dict[str, str] = {}
SEGMENTS = {"BUILDING": "site", "MACHINERY": "plant", "AUTOMOBILE": "plant"}
DRAWS = 200
#: rows of a rendered table of counts, five windows each
TABLE_ROW = r"n [=>]+ ?[\d\-]+ +\|((?: +\d+){5})"


def report(sql: str):
    def register(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return register


@report("SELECT c_acctbal, c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer")
def numeric_columns(spark, d):
    c = table(spark, d, "customer")
    return rounded(c.select(*reports.columns_by(c, ["c_"], ["c_mktsegment"])).select("c_acctbal", "c_custkey", "c_nationkey"))


@report(f"SELECT block, count(*) AS n FROM (SELECT CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())} END AS block FROM customer) WHERE block IS NOT NULL GROUP BY block")
def block_groups(spark, d):
    return reports.mapped(table(spark, d, "customer"), "c_mktsegment", SEGMENTS, "block").groupBy("block").agg(F.count("*").alias("n"))


@report("SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 <> 0 AND NOT (event_id % 2 = 0 AND user_id % 3 > 0) GROUP BY event_type")
def usable_answers(spark, d):
    e = table(spark, d, "events")
    arm = F.when(F.col("event_id") % 2 == 0, "notools").otherwise("tools")
    return e.filter(reports.usable(F.col("event_id") % 7 != 0, arm, F.col("user_id") % 3, "notools")).groupBy("event_type").agg(F.count("*").alias("n"))


@query
def stable_seeds(spark, d):
    """crc32, which the SQL engine lacks; tested against the library's."""
    return table(spark, d, "nation").select("n_nationkey", reports.stable_seed(F.col("n_name"), F.col("n_regionkey")).alias("seed"))


@report(f"""WITH {CASES}, c AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS k FROM cases)
  SELECT count(*) AS n, sum((NOT (true_2 BETWEEN 0 AND 1))::INT + (NOT (coverage BETWEEN 0 AND 1))::INT)::BIGINT AS out_of_range, (count(*) - count(true_2) + count(*) - count(coverage))::BIGINT AS nulls,
    (count(*) - count(DISTINCT case_id))::BIGINT AS repeated, (SELECT count(*) FROM (SELECT instance_id FROM cases GROUP BY instance_id HAVING count(DISTINCT group_id) > 1)) AS split FROM c""")
def case_integrity(spark, d):
    return rounded(reports.integrity(cases(spark, d), "case_id", ["true_2", "coverage"], "instance_id", "group_id"))


@report(f"""WITH {RECORDS} SELECT event_id, n_name, x AS answer, round(n_nationkey % 10 / 10::DOUBLE, 6) AS truth FROM rec JOIN nation ON prompt_id = n_nationkey WHERE n_regionkey <> 2 AND complete AND x IS NOT NULL""")
def answer_truth_frame(spark, d):
    r = answer_records(spark, d).filter("complete").select("event_id", F.col("prompt_id").cast("long").alias("prompt_id"), F.col("x").alias("answer")).filter("answer is not null")
    nation = table(spark, d, "nation").withColumn("prompt_id", F.col("n_nationkey").cast("long"))
    truth = nation.filter("n_regionkey <> 2").select("prompt_id", (F.col("prompt_id") % 10 / 10).alias("truth"))
    return rounded(reports.answer_frame(r, nation.select("prompt_id", "n_name"), truth, "prompt_id").drop("prompt_id"))


_WHOLE = " AND ".join(f"p{k} IS NOT NULL" for k in (2, 3))


@report(f"""WITH {CASES}, x AS (SELECT case_id, CASE WHEN seed = 1 THEN pred_2 END AS p2, pred_3 AS p3, true_2 AS t2, CASE WHEN budget = 100 THEN true_3 END AS t3 FROM cases)
  SELECT case_id, round(p2, 6) AS p2, round(p3, 6) AS p3, round(t2, 6) AS t2, round(t3, 6) AS t3 FROM x WHERE {_WHOLE} AND t2 IS NOT NULL AND t3 IS NOT NULL""")
def pivot_intersection(spark, d):
    c = cases(spark, d)
    p = c.select("case_id", F.when(F.col("seed") == 1, F.col("pred_2")).alias("p2"), F.col("pred_3").alias("p3"))
    t = c.select("case_id", F.col("true_2").alias("t2"), F.when(F.col("budget") == 100, F.col("true_3")).alias("t3"))
    return rounded(reports.intersected(p, t, "case_id"))


@report(f"""WITH {CASES}, a AS (SELECT *, 0.2::DOUBLE AS base FROM cases WHERE seed = 1), l AS (SELECT true_2 AS y, 'pred_2' AS method, pred_2 AS p FROM a UNION ALL SELECT true_2, 'base', base FROM a)
  SELECT method, count(p) AS n, {_r("avg(abs(p - y))", "mae")}, {_r("avg(p - y)", "bias")} FROM l GROUP BY method""")
def baselines_on_answered(spark, d):
    c = cases(spark, d).withColumn("base", F.lit(0.2))
    return rounded(reports.rescored(c, c.filter("seed = 1").select("case_id"), "case_id", "true_2", ["pred_2", "base"]), UP)


_SCOPES = "UNION ALL SELECT * REPLACE ('ALL' AS strategy) FROM"


@report(f"""WITH {CASES}, b AS (SELECT budget, strategy, pred_2 AS m, 0.2::DOUBLE AS b, true_2 AS y FROM cases WHERE pred_2 IS NOT NULL AND true_2 IS NOT NULL), x AS (SELECT * FROM b {_SCOPES} b)
  SELECT budget::BIGINT AS budget, strategy, count(*) AS n, {_r("avg(abs(m - y))", "model_mae")}, {_r("avg(abs(b - y))", "baseline_mae")}, {_r("avg(abs(m - y)) - avg(abs(b - y))", "delta")},
    {_r("avg((abs(m - y) < abs(b - y))::INT)", "win_share")} FROM x GROUP BY budget, strategy""")
def model_vs_baseline(spark, d):
    c = cases(spark, d).withColumn("base", F.lit(0.2))
    return rounded(reports.against_baseline(c, ["budget"], "strategy", "pred_2", "base", "true_2"), UP)


@report(f"""WITH {CASES}, b AS (SELECT strategy, 0.5::DOUBLE * pred_2 + 0.1::DOUBLE AS m, pred_2 AS p, true_2 AS y FROM cases WHERE pred_2 IS NOT NULL), x AS (SELECT * FROM b {_SCOPES} b)
  SELECT strategy, count(*) AS n, {_r("avg(abs(m - y))", "mae")}, {_r("avg((abs(m - 0.2::DOUBLE) <= 0.0512345::DOUBLE)::INT)", "anchor_share")}, {_r("avg(abs(m - p))", "plugin_gap")} FROM x GROUP BY strategy""")
def model_comparison(spark, d):
    c = cases(spark, d).withColumn("half", F.expr("0.5D * pred_2 + 0.1D"))
    return rounded(reports.anchored(c, "strategy", "half", "pred_2", "true_2", 0.2, 0.0512345), UP)


def _ranks(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2::DOUBLE)"


_BAND = "CASE WHEN coverage <= 0.02 THEN 'low' WHEN coverage <= 0.15 THEN 'middle' ELSE 'high' END"


@report(f"""WITH {CASES}, x AS (SELECT strategy, {_BAND} AS band, pred_2 AS p, true_2 AS y FROM cases WHERE pred_2 IS NOT NULL AND true_2 IS NOT NULL),
  k AS (SELECT *, {_ranks("p", "strategy, band")} AS a, {_ranks("y", "strategy, band")} AS b FROM x)
  SELECT strategy, band, count(*) AS n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS spearman, {_r("avg(abs(p - y))", "mae")} FROM k GROUP BY ALL HAVING count(*) >= 10""")
def rank_dissociation(spark, d):
    c = cases(spark, d).withColumn("band", evaluate.band(F.col("coverage"), (0.02, 0.15), ("low", "middle", "high")))
    out = reports.dissociation(c, ["strategy", "band"], "pred_2", "true_2")
    return rounded(out.withColumn("mae", F.col("mae") + UP))


@report(f"""WITH {CASES}, x AS (SELECT strategy, true_2 AS p, true_c AS y FROM cases WHERE true_2 IS NOT NULL AND true_c IS NOT NULL), k AS (SELECT *, {_ranks("p", "strategy")} AS a, {_ranks("y", "strategy")} AS b FROM x)
  SELECT strategy, count(*) AS n, round(corr(p, y), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM k GROUP BY strategy""")
def target_redundancy(spark, d):
    return rounded(reports.redundancy(cases(spark, d), ["strategy"], "true_2", "true_c"))


@report(f"""WITH {CASES}, eachi AS (SELECT group_id, instance_id, avg(pred_2) AS m, var_samp(pred_2) AS v, count(*) AS n FROM cases WHERE pred_2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
  g AS (SELECT group_id, avg(m) AS m, var_samp(m) AS v, count(*) AS k FROM eachi GROUP BY group_id),
  t AS (SELECT (SELECT avg(v) FROM eachi) AS w, (SELECT avg(n) FROM eachi) AS r, avg(k) AS i, count(*) AS c, coalesce(avg(v), 0) AS a, var_samp(m) AS b FROM g), s AS (SELECT *, greatest(a - w / greatest(r, 1), 0) AS x FROM t)
  SELECT {_r("w", "within")}, {_r("x", "inst")}, {_r("greatest(b - x / greatest(i, 1) - w / greatest(i * r, 1), 0)", '"group"')}, {_r("r", "n_rep")}, {_r("i", "n_inst")}, c AS n_group FROM s""")
def noise_components(spark, d):
    return rounded(reports.noise_components(cases(spark, d), "pred_2"), UP)


@report(f"""WITH {CASES}, f AS (SELECT strategy, true_2 FROM cases QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY md5(case_id), case_id) <= 5)
  SELECT strategy, {_r("avg(true_2)", "anchor")}, count(*) AS n FROM f GROUP BY strategy""")
def example_anchor(spark, d):
    return rounded(reports.example_anchor(cases(spark, d), "strategy", "case_id", "true_2", 5), UP)


@report(f"""WITH {DENSE}, s AS (SELECT u, v, count(*) AS n, max(t) - min(t) AS life FROM lg GROUP BY u, v), o AS (SELECT avg(CASE WHEN n >= 2 THEN life END) AS c, avg((n >= 2)::INT) AS s FROM s)
  SELECT round(c, 6) AS conditional, round(s, 6) AS share, round(coalesce(c, CASE WHEN s = 0 THEN 0 END) * s, 6) AS zero_inclusive FROM o""")
def lifetime_plugin(spark, d):
    return rounded(reports.lifetime_plugin(dense_log(spark, d)))


@report(f"""WITH {DENSE}, p AS (SELECT u, v, t - lag(t) OVER (PARTITION BY u, v ORDER BY t) AS gap FROM lg) SELECT u, v, count(*) AS gaps, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap FROM p WHERE gap IS NOT NULL GROUP BY u, v""")
def sample_gaps(spark, d):
    return rounded(reports.sample_gaps(dense_log(spark, d)))


@report("""WITH m AS (SELECT c_custkey, c_custkey % 9 AS a, c_custkey % 4 AS b, c_custkey % 3 AS c FROM customer)
  SELECT c_custkey, round((b + c + a) / nullif(a + b + c + a, 0)::DOUBLE, 6) AS plugin FROM m""")
def prompt_table_plugin(spark, d):
    key = F.col("c_custkey")
    text = F.format_string("seen pairs\nn = 1 | %d %d 0 0 0\nn >= 11 |  0 0 %d 0 %d\nn = x | 9 9\n", key % 9, key % 4, key % 3, key % 9)
    return rounded(table(spark, d, "customer").select("c_custkey", reports.table_plugin(text, TABLE_ROW).alias("plugin")))


@report("""SELECT n_nationkey::BIGINT AS n_nationkey, rep, n_nationkey || '__r' || rep AS plan_id, ((row_number() OVER (ORDER BY rep, n_nationkey) - 1) % 4)::BIGINT AS shard FROM nation, range(1, 4) r(rep)""")
def plan_expansion(spark, d):
    return rounded(reports.expanded(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 3, 4))


@report("""SELECT n_nationkey::BIGINT AS n_nationkey, 'response' AS arm, 1::BIGINT AS seed, rep FROM nation, range(1, 4) r(rep) UNION ALL SELECT n_nationkey, 'input', seed, 1 FROM nation, range(1, 5) r(seed)""")
def noise_design(spark, d):
    return rounded(reports.noise_design(table(spark, d, "nation").select("n_nationkey"), 3, 4))


_COUNT = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in answers.POISSON)


@report(f"""WITH {CASES}, dl AS (SELECT case_id, abs(pred_2 - true_2) - abs(0.2::DOUBLE - true_2) AS d FROM cases WHERE pred_2 IS NOT NULL),
  dw AS (SELECT draw, d, {_u01("0", "case_id", "draw")} AS u FROM dl, range(1, {DRAWS + 1}) r(draw)), m AS (SELECT draw, sum(({_COUNT}) * d) / sum({_COUNT}) AS m FROM dw GROUP BY draw HAVING sum({_COUNT}) > 0)
  SELECT {_r("(SELECT avg(d) FROM dl)", "delta")}, (SELECT count(*) FROM dl) AS n, {_r("quantile_cont(m, 0.025)", "low")}, {_r("quantile_cont(m, 0.975)", "high")} FROM m""")
def paired_bootstrap(spark, d):
    c = cases(spark, d).filter("pred_2 is not null")
    deltas = c.select(F.col("case_id").alias("case"), F.expr("abs(pred_2 - true_2) - abs(0.2D - true_2)").alias("d"))
    return rounded(answers.bootstrap_delta(deltas, DRAWS), UP)


NAMES = [*ORACLES, "stable_seeds"]
assert math.isclose(answers.POISSON[0], math.exp(-1)) and all(n in QUERIES for n in NAMES)
