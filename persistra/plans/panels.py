"""Queries over panels, pivots, sets and answers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from persistra.operators import evaluate, tables
from persistra.plans.cases import cases, predictions
from persistra.plans.oracles import CASES, CUST_SUPP, PREDICTIONS, RECORDS, USER_TYPE, dyads, window
from persistra.plans.queries import QUERIES, answer_records, query, rounded
from persistra.sources.streams import cust_supp, table, user_type

ORACLES: dict[str, str] = {}
MODELS = [f"shrink_{i}" for i in range(4)]
STRATEGIES = ["reservoir", "time_prefix", "block"]
#: halves of the last place go up, in both engines
UP = 1e-9


def _r(expr: str, name: str) -> str:
    return f"round({expr} + {UP}::DOUBLE, 6) AS {name}"


def panel(sql: str):
    def register(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return register


@panel(f"""WITH {PREDICTIONS} SELECT case_id, {", ".join(_r(f"max(CASE WHEN model = '{m}' THEN prediction END)", m) for m in MODELS)}
  FROM ok GROUP BY case_id HAVING count(DISTINCT model) = 4""")
def wide_predictions(spark, d):
    p = predictions(cases(spark, d)).filter("prediction is not null and y_true is not null")
    return rounded(tables.wide(p, ["case_id"], "model", MODELS, "prediction"), UP)


@panel(f"""WITH {CASES} SELECT budget::BIGINT AS budget, {", ".join(_r(f"avg(CASE WHEN strategy = '{s}' THEN coverage END)", s) for s in STRATEGIES)}, {_r("avg(coverage)", "every")} FROM cases GROUP BY budget""")
def coverage_pivot(spark, d):
    return rounded(tables.mean_pivot(cases(spark, d), ["budget"], "strategy", STRATEGIES, "coverage", "every"), UP)


@panel(f"""WITH {PREDICTIONS} SELECT model, {", ".join(_r(f"avg(CASE WHEN strategy = '{s}' THEN abs(err) END)", f"mae_{s}") for s in STRATEGIES)}, {_r("avg(abs(err))", "mae_all")} FROM ok GROUP BY model
  UNION ALL SELECT 'all', {", ".join(_r(f"avg(CASE WHEN strategy = '{s}' THEN abs(err) END)", f"mae_{s}") for s in STRATEGIES)}, {_r("avg(abs(err))", "mae_all")} FROM ok""")
def mae_pivot_total(spark, d):
    e = predictions(cases(spark, d)).withColumn("e", F.abs(F.expr("prediction - y_true"))).filter("e is not null")
    both = e.withColumn("model", F.explode(F.array("model", F.lit("all"))))
    return rounded(tables.mean_pivot(both, ["model"], "strategy", STRATEGIES, "e", "mae_all", "mae_"), UP)


@panel(f"""WITH {CASES} SELECT group_id, {", ".join(f"count(CASE WHEN strategy = '{s}' THEN 1 END) AS {s}" for s in STRATEGIES)} FROM cases GROUP BY group_id""")
def case_crosstab(spark, d):
    return tables.cross_tab(cases(spark, d), ["group_id"], "strategy", STRATEGIES)


@panel("""WITH edges AS (
    SELECT unnest([quantile_cont(c_acctbal::DOUBLE, 0), quantile_cont(c_acctbal::DOUBLE, 0.25), quantile_cont(c_acctbal::DOUBLE, 0.5), quantile_cont(c_acctbal::DOUBLE, 0.75), quantile_cont(c_acctbal::DOUBLE, 1)]) AS x FROM customer
  ), d AS (SELECT DISTINCT x FROM edges), b AS (
    SELECT c_acctbal::DOUBLE AS v, greatest(0, (SELECT count(*) FROM d WHERE d.x < c_acctbal::DOUBLE) - 1) AS bin FROM customer WHERE c_acctbal IS NOT NULL
  ) SELECT bin::BIGINT AS bin, count(*) AS n, round(avg(v), 6) AS mean FROM b GROUP BY bin""")
def quantile_bins(spark, d):
    v = table(spark, d, "customer").select(F.col("c_acctbal").cast("double").alias("v"))
    return rounded(tables.quantile_bins(v, "v", 4).filter("v is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean")))


@panel("""SELECT o_custkey, last.f::BIGINT AS part, last.k AS o_orderkey FROM (
    SELECT o_custkey, max({'f': CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END, 'k': o_orderkey}) AS last FROM orders GROUP BY o_custkey)""")
def keep_last_union(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    frames = [o.filter(F.col("o_orderkey") % 2 == i).withColumn("part", F.lit(i)) for i in (0, 1)]
    return rounded(tables.keep_last(frames, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "part", "o_orderkey"))


@panel("SELECT user_id FROM events WHERE event_type IS NOT NULL GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_ids(spark, d):
    return tables.common(table(spark, d, "events"), "user_id", "event_type")


@panel("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000 AND o_custkey IS NOT NULL)")
def missing_ids(spark, d):
    return tables.missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@panel("SELECT (o_orderkey % 4)::BIGINT AS shard, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def shard_filter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    parts = [tables.shard(o, "o_orderkey", 4, i).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(i).cast("long").alias("shard"), "n", "keys") for i in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@panel("""WITH t AS (SELECT s_nationkey, quantile_cont(s_acctbal::DOUBLE, 0.75) AS target FROM supplier GROUP BY 1)
  SELECT s_nationkey::BIGINT AS s_nationkey, s_suppkey, round(s_acctbal::DOUBLE, 6) AS acctbal, round(target, 6) AS target FROM supplier JOIN t USING (s_nationkey)
  QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY round(abs(s_acctbal::DOUBLE - target), 9), s_suppkey) = 1""")
def nearest_to_quantile(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("s_nationkey"), "s_suppkey", F.col("s_acctbal").cast("double").alias("acctbal"))
    return rounded(tables.nearest_to_quantile(s, ["s_nationkey"], "acctbal", 0.75, "s_suppkey"))


@panel(f"""WITH {CASES} SELECT case_id, n_name, n_regionkey::BIGINT AS n_regionkey FROM cases LEFT JOIN nation ON instance_id = 'n' || n_nationkey""")
def case_metadata(spark, d):
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("instance_id"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    return tables.with_metadata(cases(spark, d).select("case_id", "instance_id"), nation, "instance_id").select("case_id", "n_name", "n_regionkey")


@panel(f"""WITH {PREDICTIONS}, w AS (SELECT case_id, {", ".join(f"max(CASE WHEN model = '{m}' THEN prediction END) AS {m}" for m in MODELS)} FROM pred GROUP BY case_id)
  SELECT cases.case_id, {_r("true_2", "true_2")}, {", ".join(_r(m, m) for m in MODELS)} FROM cases LEFT JOIN w USING (case_id)""")
def case_baselines(spark, d):
    c = cases(spark, d)
    return rounded(tables.with_baselines(c.select("case_id", "true_2"), predictions(c), "case_id", MODELS), UP)


_PANEL = "abs(pred_2 - true_2) + abs(pred_3 - true_3) + abs(pred_4 - true_4) + abs(pred_5 - true_5)"


@panel(f"""WITH {CASES}, scored AS (SELECT *, ({_PANEL}) / 4 AS e FROM (SELECT * REPLACE (CASE WHEN budget = 100 AND seed = 1 THEN NULL ELSE pred_5 END AS pred_5) FROM cases)),
  g AS (SELECT strategy, group_id, count(*) AS n, count(e) AS ok, sum(e) AS e, avg(e) AS g, sum(CASE WHEN e IS NOT NULL THEN abs(pred_2 - true_2) END) AS a, sum(CASE WHEN e IS NOT NULL THEN pred_2 - true_2 END) AS s FROM scored GROUP BY ALL)
  SELECT strategy, sum(n)::BIGINT AS n, {_r("sum(ok) / sum(n)", "valid_share")}, {_r("sum(e) / nullif(sum(ok), 0)", "pmae")}, {_r("avg(g)", "macro_pmae")}, {_r("max(g)", "worst_pmae")},
    {_r("sum(a) / nullif(sum(ok), 0)", "rho2_mae")}, {_r("sum(s) / nullif(sum(ok), 0)", "rho2_bias")} FROM g GROUP BY strategy""")
def panel_metrics(spark, d):
    c = cases(spark, d).withColumn("pred_5", F.when(~((F.col("budget") == 100) & (F.col("seed") == 1)), F.col("pred_5")))
    return rounded(tables.panel_metrics(c, ["strategy"]), UP)


_BAND = "CASE WHEN coverage <= 0.02 THEN 'low' WHEN coverage <= 0.15 THEN 'middle' ELSE 'high' END"


@panel(f"""WITH {CASES}, x AS (SELECT {_BAND} AS band, true_2, 0.2::DOUBLE AS base, pred_2 AS plug, true_2 AS best, 0.5::DOUBLE * pred_2 + 0.1::DOUBLE AS half FROM cases),
  m AS (SELECT band, count(*) AS n, avg(abs(base - true_2)) AS b, avg(abs(best - true_2)) AS o, avg(abs(plug - true_2)) AS p, avg(abs(half - true_2)) AS h FROM x GROUP BY band)
  SELECT band, n, {_r("b", "mae_base")}, {_r("o", "mae_best")}, {_r("p", "mae_plug")}, {_r("h", "mae_half")}, {_r("CASE WHEN b - o > 0 THEN (b - p) / (b - o) END", "captured_plug")}, {_r("CASE WHEN b - o > 0 THEN (b - h) / (b - o) END", "captured_half")} FROM m""")
def captured_fraction(spark, d):
    c = cases(spark, d).select(
        evaluate.band(F.col("coverage"), (0.02, 0.15), ("low", "middle", "high")).alias("band"), "true_2", F.lit(0.2).alias("base"), F.col("pred_2").alias("plug"), F.col("true_2").alias("best"), F.expr("0.5D * pred_2 + 0.1D").alias("half")
    )
    return rounded(tables.captured(c, ["band"], "true_2", "base", "best", ["plug", "half"]), UP)


_BANDS = {"b1": (0.02, 0.15), "b2": (0.01, 0.1), "b3": (0.01, 0.05, 0.2)}


@panel(f"""WITH {CASES}, q AS (SELECT quantile_cont(coverage, 1 / 3::DOUBLE) AS q1, quantile_cont(coverage, 2 / 3::DOUBLE) AS q2 FROM cases)
  SELECT {", ".join("CASE " + " ".join(f"WHEN coverage <= {e} THEN 'band{i}'" for i, e in enumerate(edges)) + f" ELSE 'band{len(edges)}' END AS {n}" for n, edges in _BANDS.items())},
    CASE WHEN round(coverage - q1, 12) <= 0 THEN 'band0' WHEN round(coverage - q2, 12) <= 0 THEN 'band1' ELSE 'band2' END AS b4, count(*) AS n FROM cases, q GROUP BY ALL""")
def band_definitions(spark, d):
    c = cases(spark, d).select("coverage")
    q = c.agg(F.percentile("coverage", F.lit(1 / 3)).alias("q1"), F.percentile("coverage", F.lit(2 / 3)).alias("q2"))
    third = F.when(F.round(F.expr("coverage - q1"), 12) <= 0, "band0").when(F.round(F.expr("coverage - q2"), 12) <= 0, "band1").otherwise("band2")
    fixed = [evaluate.band(F.col("coverage"), e, [f"band{i}" for i in range(len(e) + 1)]).alias(n) for n, e in _BANDS.items()]
    return c.join(F.broadcast(q)).select(*fixed, third.alias("b4")).groupBy(*_BANDS, "b4").agg(F.count("*").alias("n"))


@panel("""SELECT event_type, count(*) AS n, round(avg((value < 5)::INT), 6) AS share_low, round(avg((value = 0)::INT), 6) AS share_zero, round(quantile_cont(value, 0.5), 6) AS median
  FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def floor_effects(spark, d):
    return rounded(tables.floor_effects(table(spark, d, "events"), "value", ["event_type"], 5.0))


@panel(f"""WITH {CASES} SELECT strategy, budget::BIGINT AS budget, count(coverage) AS n, {_r("quantile_cont(coverage, 0.5)", "median")}, {_r("quantile_cont(coverage, 0.1)", "q10")}, {_r("quantile_cont(coverage, 0.9)", "q90")},
  {_r("avg((coverage >= 1)::INT)", "saturated")} FROM cases GROUP BY ALL""")
def coverage_spread(spark, d):
    return rounded(tables.spread_summary(cases(spark, d), "coverage", ["strategy", "budget"]), UP)


_NBIN = "CASE WHEN n <= 5 THEN n WHEN n <= 10 THEN 6 ELSE 7 END"


@panel(f"""WITH {dyads(USER_TYPE, (5,))}, h AS (SELECT {_NBIN} AS b, bit_count(m5) AS w FROM d)
  SELECT {", ".join(f"count(CASE WHEN b = {i} AND w = {w} THEN 1 END) AS n{i}_w{w}" for i in range(1, 8) for w in range(1, 6))}, count(*) AS n_seen FROM h""")
def nw_binned_histogram(spark, d):
    from persistra.operators import census

    seen = census.dyads(user_type(spark, d), (5,)).select("n", F.expr("bit_count(m5)").alias("w"))
    return tables.binned_histogram(seen)


@panel(f"""WITH {dyads(CUST_SUPP, (5,))} SELECT w::BIGINT AS w, sum(c)::BIGINT AS events, count(*) AS active FROM (SELECT {window(5)} AS w, u, v, count(*) AS c FROM e GROUP BY ALL) GROUP BY w""")
def window_activity(spark, d):
    from persistra.functions.exprs import window_index
    from persistra.operators import census

    e = census.with_horizon(cust_supp(spark, d).filter("u <> v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), window_index("t", "t0", "t1", 5).alias("w"))
    return rounded(tables.window_activity(e))


@panel("SELECT (3 * 2 * 25 + round(25 * 0.2)::BIGINT * 3 * 2 * 1)::BIGINT AS expected, count(*) AS nations FROM nation")
def expected_cases(spark, d):
    return table(spark, d, "nation").agg(F.lit(tables.expected_cases(3, 2, 2, 25, 0.2)).cast("long").alias("expected"), F.count("*").alias("nations"))


@panel("""SELECT event_id, round(greatest(0, least(1, value / 100)), 6) AS a, round(greatest(0, least(1, value / 50 - 0.5::DOUBLE)), 6) AS b,
  greatest(0, least(1, value / 50 - 0.5::DOUBLE)) > greatest(0, least(1, value / 100)) AS not_monotone FROM events""")
def answer_coercion(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("value / 100").alias("a"), F.expr("value / 50 - 0.5D").alias("b"))
    return rounded(e.select("event_id", *tables.coerced(["a", "b"])))


@panel(f"""WITH {RECORDS}, s AS (SELECT prompt_id, complete, CASE WHEN complete AND x BETWEEN 0 AND 1 THEN abs(x - (prompt_id % 10) / 10::DOUBLE) ELSE 1 END AS loss FROM rec)
  SELECT prompt_id, count(*) AS n, round(avg(loss) + {UP}::DOUBLE, 6) AS mean_loss FROM s GROUP BY prompt_id""")
def record_losses(spark, d):
    r = answer_records(spark, d).select("prompt_id", F.when(F.col("complete"), F.col("x")).alias("x"), F.expr("(prompt_id % 10) / 10D").alias("y"))
    return rounded(tables.losses(r, "x", "y").groupBy("prompt_id").agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss")), UP)


@panel(f"""WITH {RECORDS}, s AS (SELECT user_id % 4 AS cell, prompt_id, event_id % 3 AS rep, CASE WHEN complete AND x BETWEEN 0 AND 1 THEN abs(x - (prompt_id % 10) / 10::DOUBLE) ELSE 1 END AS loss FROM rec),
  r AS (SELECT cell, prompt_id, rep, avg(loss) AS x FROM s GROUP BY ALL), c AS (SELECT cell, prompt_id, avg(x) AS m, stddev_pop(x) AS sd, count(*) AS r FROM r GROUP BY ALL)
  SELECT cell, count(*) AS n_cases, round(avg(m) + {UP}::DOUBLE, 6) AS mean_loss, round(avg(CASE WHEN r > 1 THEN sd END) + {UP}::DOUBLE, 6) AS stability_sd FROM c GROUP BY cell""")
def cell_metrics(spark, d):
    r = answer_records(spark, d).select(
        (F.col("model_id") % 4).alias("cell"), "prompt_id", (F.col("event_id") % 3).alias("rep"), F.when(F.col("complete"), F.col("x")).alias("x"), F.expr("(prompt_id % 10) / 10D").alias("y")
    )
    return rounded(tables.cell_metrics(tables.losses(r, "x", "y"), "cell", "prompt_id", "rep"), UP)


@panel(f"""WITH {RECORDS}, t AS (SELECT user_id, count(*) AS attempts, max(complete) AS done FROM rec GROUP BY user_id)
  SELECT c_custkey AS user_id, coalesce(attempts, 0) AS attempts FROM customer LEFT JOIN t ON c_custkey = user_id WHERE length(c_name) <= 18 AND NOT coalesce(done, false)""")
def todo_order(spark, d):
    prompts = table(spark, d, "customer").select(F.col("c_custkey").alias("model_id"), F.length("c_name").alias("n"))
    return tables.todo(prompts, answer_records(spark, d), "model_id", 18, "n").withColumnRenamed("model_id", "user_id")


ORACLES["group_folds"] = """WITH RECURSIVE s AS (
    SELECT row_number() OVER (ORDER BY count(*) DESC, 'g' || c_nationkey) AS i, 'g' || c_nationkey AS group_id, count(*) AS size FROM customer GROUP BY c_nationkey
  ), f(i, group_id, fold, load) AS (
    SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, list_transform(range(least(5, (SELECT count(*) FROM s))), lambda x: 0::BIGINT)
    UNION ALL
    SELECT s.i, s.group_id, list_position(load, list_min(load)) - 1,
           list_transform(load, lambda l, j: CASE WHEN j = list_position(load, list_min(load)) THEN l + size ELSE l END)
    FROM f JOIN s ON s.i = f.i + 1
  ) SELECT group_id, fold::BIGINT AS fold FROM f WHERE i > 0"""


def _u01(*parts: str) -> str:
    """The uniform number of ``exprs.u01``: leading 32 bits of the md5 of the parts joined by '|'."""
    key = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_DAR = " ".join(
    f", a{w} AS (SELECT *, CASE WHEN {_u01('0', repr('k'), 'id', str(w))} < 0.4::DOUBLE THEN x{w - 1} ELSE {_u01('0', repr('d'), 'id', str(w))} < 0.2::DOUBLE END AS x{w} FROM a{w - 1})"
    for w in range(1, 5)
)
ORACLES["dar_stream"] = f"""WITH a0 AS (SELECT range AS id, {_u01("0", "'d'", "range", "0")} < 0.2::DOUBLE AS x0 FROM range(2000)) {_DAR},
  l AS (SELECT id, unnest(range(5)) AS w, unnest([x0, x1, x2, x3, x4]) AS active FROM a4),
  c AS (SELECT id, w, {_u01("0", "'n'", "id", "w")} AS many FROM l WHERE active),
  r AS (SELECT id, w, unnest(range(1, 2 + (many > 0.6065)::INT + (many > 0.9098)::INT + (many > 0.9856)::INT)) AS j FROM c)
  SELECT 'a' || id AS u, 'b' || id AS v, round((w + {_u01("0", "'t'", "id", "w", "j")}) / 5::DOUBLE, 6) AS t FROM r"""

QUERIES["dar_stream"] = lambda spark, d, f=QUERIES["dar_stream"]: rounded(f(spark, d))
