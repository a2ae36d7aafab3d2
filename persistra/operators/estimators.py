"""Estimators of a network's profile from what a sample shows of it.

Closed forms are column expressions.  Iterative ones (expectation
maximisation over a few hundred aggregated patterns) are grouped Arrow or
pandas kernels that get counts, never rows of the log.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.functions.exprs import ratio
from persistra.operators.census import event_weighted, retention

WINDOWS = 5


def plugin(seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profile, occupancy, event-weighted rho and retention read off the dyads seen (n, mask, w)."""
    return seen.groupBy(*by).agg(
        *(F.avg(F.expr(f"double(w >= {k})")).alias(f"rho_{k}") for k in range(2, 6)),
        F.avg(F.expr("w / 5D")).alias("mean_occupancy"),
        event_weighted("mask").alias("rho_event_weighted"),
        retention("mask", WINDOWS).alias("c_one_step"),
    )


def conditional(seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rho_k among dyads seen k times at least."""
    return seen.groupBy(*by).agg(*(F.avg(F.expr(f"if(n >= {k}, double(w >= {k}), null)")).alias(f"rho_{k}_conditional") for k in range(2, 6)))


def chao1(seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    once, twice = F.sum(F.expr("bigint(n = 1)")), F.sum(F.expr("bigint(n = 2)"))
    return seen.groupBy(*by).agg(
        F.count("*").alias("observed"),
        (F.count("*") + once * (once - 1) / (2.0 * (twice + 1))).alias("chao1"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - once / F.sum("n"))).alias("good_turing_coverage"),
    )


def seen_labels(seen: DataFrame, truth: DataFrame) -> DataFrame:
    """True rho_2 of the dyads seen, plain and weighted by how often they were seen.  truth: u, v, m5."""
    j = seen.join(truth.select("u", "v", "m5"), ["u", "v"])
    return j.agg(F.avg(F.expr("double(bit_count(m5) >= 2)")).alias("rho_2_seen"), ratio(F.sum(F.expr("if(bit_count(m5) >= 2, n, 0L)")), F.sum("n")).alias("rho_2_seen_weighted"))


def hajek(seen: DataFrame, truth: DataFrame, budget: int) -> DataFrame:
    """Weights 1 / (1 - P(dyad of m events is missed by ``budget`` of M events)); truth: u, v, n, m5."""
    total = truth.agg(F.sum("n").alias("total"))
    missed = (
        f"if(m > total - {budget}, 0D, exp(aggregate(sequence(0L, m - 1), 0D, (s, i) -> s + ln((total - {budget} - i) / double(total - i)))))"
    )
    j = seen.select("u", "v").join(truth.select("u", "v", F.col("n").alias("m"), "m5"), ["u", "v"]).crossJoin(F.broadcast(total))
    w = j.withColumn("wt", F.expr(f"1 / (1 - {missed})")).withColumn("hit", F.expr("double(bit_count(m5) >= 2)"))
    return w.agg(F.sum("wt").alias("dyads_ht"), ratio(F.sum(F.expr("wt * hit")), F.sum("wt")).alias("rho_2_hajek"))


def rank_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney: how likely a positive scores over a negative, ties half."""
    by = rows.groupBy(score).agg(F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("p"))
    below = F.coalesce(F.sum("c").over(W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("rank", below + (F.col("c") + 1) / 2.0)
    pos, neg = F.sum("p"), F.sum("c") - F.sum("p")
    return ranked.agg(ratio(F.sum(F.expr("rank * p")) - pos * (pos + 1) / 2.0, pos * neg).alias("auc"))


def decreasing(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least-squares non-increasing sequence: max over j >= i of min over l <= i of mean(y_l .. y_j)."""
    clipped = rows.withColumns({c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) for c in columns})
    n = len(columns)

    def mean(a: int, b: int):
        return sum((F.col(columns[i]) for i in range(a + 1, b + 1)), F.col(columns[a])) / (b - a + 1)

    def fit(i: int):
        lows = []
        for j in range(i, n):
            terms = [mean(a, j) for a in range(i + 1)]
            lows.append(F.least(*terms) if len(terms) > 1 else terms[0])
        return F.greatest(*lows) if len(lows) > 1 else lows[0]

    return clipped.withColumns({c: fit(i) for i, c in enumerate(columns)})


# iterative estimators ------------------------------------------------------


@lru_cache(maxsize=4096)
def surjection(n: int, k: int) -> float:
    """Probability that n draws from k windows hit every one of them."""
    if n < k:
        return 0.0
    return min(1.0, max(0.0, sum((-1) ** i * math.comb(k, i) * ((k - i) / k) ** n for i in range(k + 1))))


@lru_cache(maxsize=4096)
def occupancy_row(n: int, windows: int = WINDOWS) -> tuple[tuple[float, ...], ...]:
    """P(w distinct windows | n events, k active), w and k from 1; w = k for sixty events or more."""
    if n >= 60:
        return tuple(tuple(float(w == k) for k in range(1, windows + 1)) for w in range(1, windows + 1))
    return tuple(tuple(math.comb(k, w) * (w / k) ** n * surjection(n, w) if w <= k else 0.0 for k in range(1, windows + 1)) for w in range(1, windows + 1))


def em_mixture(likelihood: np.ndarray, count: np.ndarray, prior: float = 0.0, tol: float = 0.0, rounds: int = 300) -> np.ndarray:
    """Mixture weights of the columns of ``likelihood`` (patterns x states) for pattern counts."""
    pi = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(rounds):
        joint = likelihood * pi
        total = joint.sum(1, keepdims=True)
        post = np.divide(joint, total, out=np.zeros_like(joint), where=total > 0)
        new = (post * count[:, None]).sum(0) + prior
        new /= new.sum()
        done = np.abs(new - pi).max() < tol
        pi = new
        if done:
            break
    return pi


def _profile(pi: np.ndarray, spans: np.ndarray) -> list[float]:
    return [float(pi[spans >= k].sum()) for k in range(2, WINDOWS + 1)]


_PROFILE = "rho_2 double, rho_3 double, rho_4 double, rho_5 double"


def _grouped(hist: DataFrame, by: Sequence[str], kernel, out: str) -> DataFrame:
    """Runs ``kernel(pdf) -> tuple`` on each group's histogram."""
    keys = list(by) or ["_all"]
    h = hist if by else hist.withColumn("_all", F.lit(0))
    schema = ", ".join(f"{k} {h.schema[k].dataType.simpleString()}" for k in keys) + f", {out}"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, *(c.split()[0] for c in out.split(", "))]
        return pd.DataFrame([[*key, *kernel(pdf)]], columns=names)

    done = h.groupBy(*keys).applyInPandas(run, schema)
    return done if by else done.drop("_all")


def occupancy_mle(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(n, w, c) counts -> maximum-likelihood profile of the number of active windows."""

    def kernel(p: pd.DataFrame):
        like = np.array([occupancy_row(int(n))[int(w) - 1] for n, w in zip(p["n"], p["w"])])
        return _profile(em_mixture(like, p["c"].to_numpy(float)), np.arange(1, WINDOWS + 1))

    return _grouped(hist, by, kernel, _PROFILE)


def _mask_likelihood(n: np.ndarray, mask: np.ndarray) -> np.ndarray:
    states = np.arange(1, 1 << WINDOWS)
    size = np.array([bin(s).count("1") for s in states])
    out = np.zeros((len(n), len(states)))
    for i, (k, m) in enumerate(zip(n.tolist(), mask.tolist())):
        w = bin(m).count("1")
        out[i] = np.where((m & states) == m, surjection(k, w) * (w / size) ** k, 0.0)
    return out


def mask_mle(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(n, mask, c) counts -> profile, occupancy and retention from 31 latent activity masks."""

    def kernel(p: pd.DataFrame):
        states = np.arange(1, 1 << WINDOWS)
        spans = np.array([bin(s).count("1") for s in states])
        pi = em_mixture(_mask_likelihood(p["n"].to_numpy(), p["mask"].to_numpy()), p["c"].to_numpy(float), 1e-3, 1e-10)
        both = np.array([bin(s & (s >> 1)).count("1") for s in states])
        base = np.array([bin(s & 15).count("1") for s in states])
        return [*_profile(pi, spans), float(pi @ spans) / WINDOWS, float(pi @ both) / float(pi @ base) if pi @ base else None]

    return _grouped(hist, by, kernel, _PROFILE + ", mean_occupancy double, c_one_step double")


def hansen_hurwitz(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Posterior activity of each (n, mask, c) pattern, read out over traversals.

    The latent masks are fitted on counts of dyads; a stationary traversal
    meets a dyad in proportion to how often it is walked, so the readout weighs
    every dyad with its n."""

    def kernel(p: pd.DataFrame):
        like = _mask_likelihood(p["n"].to_numpy(), p["mask"].to_numpy())
        count, n = p["c"].to_numpy(float), p["n"].to_numpy(float)
        post = like * em_mixture(like, count, 1e-3, 1e-10)
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        weight = count * n / (count * n).sum()
        states = np.arange(1, 1 << WINDOWS)
        spans, both, base = (np.array([bin(x).count("1") for x in v]) for v in (states, states & (states >> 1), states & 15))
        rho = [float(weight @ post[:, spans >= k].sum(1)) for k in range(1, WINDOWS + 1)]
        start = float(weight @ (post @ base))
        return [*rho, float(weight @ (post @ spans)) / WINDOWS, float(weight @ (post @ both)) / start if start else None]

    return _grouped(hist, by, kernel, "rho_1 double, " + _PROFILE + ", mean_occupancy double, c_one_step double")


#: from so many events on, every active window counts as seen
CERTAIN = 60


@lru_cache(maxsize=8192)
def ranked_rows(n: int, beta: float, windows: int = WINDOWS, certain: int | None = CERTAIN) -> tuple[tuple[float, ...], ...]:
    """P(w distinct windows | n events, k active), w and k from 1, where an event falls in the r-th active window with weight exp(beta * r).

    A set R of j windows lies in comb(k - j, w - j) sets of w, so inclusion and exclusion needs the subsets of the
    active windows alone."""
    if certain is not None and n >= certain:
        return tuple(tuple(float(w == k) for k in range(1, windows + 1)) for w in range(1, windows + 1))
    out = np.zeros((windows, windows))
    for k in range(1, windows + 1):
        weight = np.exp(beta * np.arange(1, k + 1))
        weight /= weight.sum()
        size = np.array([bin(r).count("1") for r in range(1, 1 << k)])
        mass = np.array([sum(weight[i] for i in range(k) if r >> i & 1) for r in range(1, 1 << k)]) ** n
        for w in range(1, k + 1):
            terms = [(-1) ** (w - j) * math.comb(k - j, w - j) * x for j, x in zip(size.tolist(), mass.tolist()) if j <= w]
            out[w - 1, k - 1] = min(1.0, max(0.0, math.fsum(terms)))
    return tuple(map(tuple, out.tolist()))


def rank_beta_mle(hist: DataFrame, betas: Sequence[float] = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0), by: Sequence[str] = (), certain: int | None = CERTAIN) -> DataFrame:
    """(n, w, c) counts -> for each beta the log likelihood and the profile of the occupancy model whose windows weigh
    exp(beta * rank) within a dyad's active set, and whether beta is the likeliest (the smallest on a tie)."""
    out = "beta double, loglik double, likeliest boolean, rho_2 double, rho_3 double, rho_4 double, rho_5 double"
    keys = list(by) or ["_all"]
    h = hist if by else hist.withColumn("_all", F.lit(0))
    schema = ", ".join(f"{k} {h.schema[k].dataType.simpleString()}" for k in keys) + f", {out}"

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        count, fits = p["c"].to_numpy(float), []
        for beta in betas:
            like = np.array([ranked_rows(int(n), float(beta), WINDOWS, certain)[int(w) - 1] for n, w in zip(p["n"], p["w"])])
            pi = em_mixture(like, count, 0.0, 1e-10, 150)
            fits.append((float((count * np.log(np.maximum(like @ pi, 1e-300))).sum()), _profile(pi, np.arange(1, WINDOWS + 1))))
        best = max(range(len(fits)), key=lambda i: (round(fits[i][0], 9), -betas[i]))
        rows = [[*key, float(b), score, i == best, *rho] for i, (b, (score, rho)) in enumerate(zip(betas, fits))]
        return pd.DataFrame(rows, columns=[*keys, *(c.split()[0] for c in out.split(", "))])

    done = h.groupBy(*keys).applyInPandas(run, schema)
    return done if by else done.drop("_all")


def calibrate_beta(fits: DataFrame, truth: DataFrame, by: Sequence[str], target: str = "true_2") -> DataFrame:
    """The beta whose rho_2 is nearest to the truth on the mean over all groups, the smaller on a tie; one row."""
    error = fits.join(truth, list(by)).groupBy("beta").agg(F.avg(F.abs(F.col("rho_2") - F.col(target))).alias("mae"))
    return error.agg(F.min_by(F.struct("beta", "mae"), F.struct(F.round("mae", 9), "beta")).alias("r")).select("r.*")


def biased_rows(n: int, beta: float, windows: int = WINDOWS) -> np.ndarray:
    """P(mask | n events, active set) with window weights exp(beta * rank): patterns x states by inclusion-exclusion."""
    weight = np.exp(beta * np.arange(windows))
    states = np.arange(1, 1 << windows)
    mass = np.array([sum(weight[i] for i in range(windows) if s >> i & 1) for s in states])
    out = np.zeros((len(states), len(states)))
    for j, s in enumerate(states):
        for i, m in enumerate(states):
            if m & s == m:
                sub, total = m, 0.0
                while sub:
                    total += (-1) ** (bin(m ^ sub).count("1")) * (mass[sub - 1] / mass[j]) ** n
                    sub = (sub - 1) & m
                out[i, j] = max(0.0, total)
    return out


def window_beta_mle(hist: DataFrame, betas: Sequence[float] = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0), by: Sequence[str] = ()) -> DataFrame:
    """(n, mask, c) counts -> the beta of greatest likelihood and the profile there, with weights by window of the whole
    period rather than by rank among a dyad's active ones; every n is taken as it is."""

    def kernel(p: pd.DataFrame):
        n, mask, count = p["n"].to_numpy(), p["mask"].to_numpy(), p["c"].to_numpy(float)
        spans = np.array([bin(s).count("1") for s in range(1, 1 << WINDOWS)])
        best = None
        for beta in betas:
            tables = {int(k): biased_rows(int(k), beta) for k in np.unique(n)}
            like = np.array([tables[int(k)][int(m) - 1] for k, m in zip(n, mask)])
            pi = em_mixture(like, count, 0.0, 1e-10, 120)
            score = float((count * np.log(np.maximum(like @ pi, 1e-300))).sum())
            if best is None or score > best[0] + 1e-9:
                best = (score, beta, _profile(pi, spans))
        return [float(best[1]), best[0], *best[2]]

    return _grouped(hist, by, kernel, "beta double, loglik double, " + _PROFILE)


def reservoir_eb(hist: DataFrame, p: float, rates: int = 24, by: Sequence[str] = ()) -> DataFrame:
    """(c0..c4, c) counts under uniform thinning p -> profile of the unthinned dyads.

    Mixture over activity masks and per-window rates; counts are Poisson, zero
    truncated, and only dyads with an event kept are seen."""

    def kernel(f: pd.DataFrame):
        x = f[[f"c{i}" for i in range(WINDOWS)]].to_numpy(float)
        count = f["c"].to_numpy(float)
        top = max(2.0, x.max() / p * 1.5)
        rate = np.geomspace(0.05, top, rates)
        states = np.arange(1, 1 << WINDOWS)
        on = (states[:, None] >> np.arange(WINDOWS)) & 1
        lgam = np.array([[math.lgamma(v + 1) for v in row] for row in x])
        logs = np.zeros((len(x), len(states), rates))
        for r, mu in enumerate(rate):
            # events of an active window: Poisson(mu) not zero, each kept with probability p
            zero = np.log(np.maximum((np.exp(-mu * p) - np.exp(-mu)) / -np.expm1(-mu), 1e-300))
            some = x * np.log(mu * p) - mu * p - lgam - np.log(-np.expm1(-mu))
            per = np.where(x > 0, some, zero)
            logs[:, :, r] = np.where(((x[:, None] > 0) & (on == 0)).any(2), -np.inf, (per[:, None] * on).sum(2))
            gone = zero * on.sum(1)
            logs[:, :, r] -= np.log(np.maximum(-np.expm1(np.minimum(gone, -1e-12)), 1e-300))
        flat = logs.reshape(len(x), -1)
        flat = np.exp(flat - flat.max(1, keepdims=True))
        pi = em_mixture(flat, count, 0.0, 1e-9, 300)
        seen = np.array([[-math.expm1(min(-1e-12, len_on * math.log(max((math.exp(-m * p) - math.exp(-m)) / -math.expm1(-m), 1e-300)))) for m in rate] for len_on in on.sum(1)])
        pi = pi / seen.reshape(-1)
        pi /= pi.sum()
        return _profile(pi.reshape(len(states), rates).sum(1), on.sum(1))

    return _grouped(hist, by, kernel, _PROFILE)
