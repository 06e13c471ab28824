"""Logistic regression by one Spark aggregate a Newton step, clustered errors, time-ordered scoring, and bootstrap intervals over borrowers."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.lineage import cut
from quillon.functions.ranking import percent_ranks
from quillon.functions.semantics import clip

from .evaluation import average_precision, quarter_ranks, roc_auc

# Caps of predictors, units of reported coefficients, the direction of risk, and predictors that are 0 where they cannot exist.
CAPS = {"price": (0.70, None), "d_price": (-0.20, 0.20), "max_drawdown": (None, 0.20), "crowding": (None, 5.0)}
UNITS = {
    "price": 0.10,
    "price_rel": 0.10,
    "d_price": 0.05,
    "d_price_adj": 0.05,
    "max_drawdown": 0.05,
    "dispersion": 0.01,
    "dispersion_std": 0.01,
    "d_pik_pp": 10.0,
    "junior_share": 0.5,
}
RISK = {"price": -1, "d_price": -1, "max_drawdown": 1, "pik_switch": 1, "dispersion": 1, "crowding": 1}
ZERO_IF_MISSING = ("dispersion", "dispersion_std")
HORIZON, LEAST_QUARTERS, RESAMPLES = 2, 3, 500
# A last step that moves a row's log odds by more than this has found no maximum; a condition beyond this is a singular curvature.
SEPARATED_MOVE, DEPENDENT = 0.01, 1e14


def model_frame(panel: DataFrame, columns: list[str], outcome: str = "y_event", only_shared: bool = False, labelled: bool = True) -> DataFrame:
    """Accruing borrowers of the sample with all ``columns`` known (but for those that are 0 if missing), and the outcome as ``y``."""
    out = panel.where("na_risk_set")
    if labelled:
        out = out.where(F.col(outcome).isNotNull())
    if only_shared:
        out = out.where("has_dispersion = 1")
    out = out.dropna(subset=[c for c in columns if c not in ZERO_IF_MISSING])
    keep = dict.fromkeys(["borrower", "cal_q", "qsort", *columns, "has_dispersion"])
    return out.select(*keep, F.col(outcome).alias("y"))


def design(column: str, caps: dict | None = None) -> Column:
    """A predictor as the fit sees it: capped, and 0 where it cannot exist."""
    low, high = (CAPS if caps is None else caps).get(column, (None, None))
    x = F.col(column).cast("double")
    x = clip(x, low, high) if low is not None or high is not None else x
    return F.coalesce(x, F.lit(0.0)) if column in ZERO_IF_MISSING else x


@dataclass
class Logit:
    """P(y = 1) = 1 / (1 + exp(-(beta[0] + beta[1:] . x))); ``cov`` is clustered, ``fit`` is McFadden's pseudo R2.

    Where predictors separate the outcomes (``separated``) the likelihood has no
    maximum: chances and ``fit`` are those it tends to, ``beta`` is but a point
    on the way, and ``cov`` is not known.
    """

    columns: list[str]
    beta: np.ndarray
    cov: np.ndarray
    fit: float
    rows: int
    clusters: int
    events: int
    separated: bool = False


class NoLogit(ValueError):
    """These rows determine no logit; ``status`` names the cause in a word or two."""

    def __init__(self, message: str, status: str, rows: int, clusters: int, events: int):
        super().__init__(message)
        self.status, self.rows, self.clusters, self.events = status, rows, clusters, events


def _eta(x: list[Column], beta: np.ndarray) -> Column:
    return sum((c * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0))


def _chance(eta: Column) -> Column:
    return F.when(eta >= 0, 1 / (1 + F.exp(-eta))).otherwise(F.exp(eta) / (1 + F.exp(eta)))


def _loglik(eta: Column, y: Column) -> Column:
    return y * eta - (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))))


def _dependent(hessian: np.ndarray) -> bool:
    """Whether the columns of a curvature, each brought to length 1, are one too few in double precision."""
    lengths = np.sqrt(np.diag(hessian))
    return not (lengths > 0).all() or np.linalg.cond(hessian / np.outer(lengths, lengths)) > DEPENDENT


def _newton(hessian: np.ndarray, slope: np.ndarray) -> np.ndarray | None:
    try:
        return np.linalg.solve(hessian, slope)
    except np.linalg.LinAlgError:
        return None


def _odds(x: float) -> float:
    """exp(x), infinite beyond the doubles."""
    try:
        return math.exp(x)
    except OverflowError:
        return math.inf


def fit_logit(frame: DataFrame, columns: list[str], group: str = "borrower", caps: dict | None = None, units: dict[str, float] | None = None, steps: int = 200) -> Logit:
    """Maximum likelihood without a penalty, by Newton steps that are halved while they lose; standard errors clustered by ``group``.

    A step is one aggregate of p sums and p (p + 1) / 2 products (p predictors and
    the constant): what reaches the driver does not grow with the rows.
    """
    units = units or {}
    names = [f"x{i}" for i in range(len(columns))]
    rows = cut(frame.select(F.col(group).alias("g"), F.col("y").cast("double").alias("y"), *[(design(c, caps) / units.get(c, 1.0)).alias(n) for c, n in zip(columns, names, strict=True)]))
    x = [F.lit(1.0), *[F.col(n) for n in names]]
    y, p = F.col("y"), len(names) + 1
    first = rows.agg(F.count("*").alias("n"), F.sum("y").alias("events"), F.countDistinct("g").alias("groups")).first()
    n, events = first.n, first.events or 0.0
    if not 0 < events < n:
        raise NoLogit("a logit needs rows of both outcomes", "one outcome", n, first.groups, int(events))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def moments(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = _eta(x, beta)
        q = _chance(eta)
        found = rows.agg(
            F.sum(_loglik(eta, y)), *[F.sum(c * (y - q)) for c in x], *[F.sum(x[i] * x[j] * q * (1 - q)) for i, j in pairs]
        ).first()
        hessian = np.zeros((p, p))
        for (i, j), v in zip(pairs, found[1 + p :], strict=True):
            hessian[i, j] = hessian[j, i] = v
        return found[0], np.array(found[1 : 1 + p]), hessian

    beta = np.zeros(p)
    beta[0] = math.log(events / (n - events))
    value, slope, hessian = moments(beta)
    if _dependent(hessian):
        raise NoLogit("a logit needs predictors that vary, none a combination of others", "collinear", n, first.groups, int(events))
    for _ in range(steps):
        step = _newton(hessian, slope)
        if step is None:
            break
        size = 1.0
        while True:
            new = moments(beta + size * step)
            if new[0] >= value - 1e-12 or size <= 1e-10:
                break
            size /= 2
        beta = beta + size * step
        done = np.abs(size * step).max() < 1e-10 or abs(new[0] - value) < 1e-12
        value, slope, hessian = new
        if done:
            break
    # At a maximum the next step is next to none; without one each step moves the log odds of some row by about 1, however far it has come.
    step = _newton(hessian, slope)
    share = events / n
    fit = 1 - value / (n * (share * math.log(share) + (1 - share) * math.log(1 - share)))
    if step is None or rows.agg(F.max(F.abs(_eta(x, step)))).first()[0] > SEPARATED_MOVE:
        return Logit(list(columns), beta, np.full((p, p), np.nan), fit, n, first.groups, int(events), True)
    bread = np.linalg.inv(hessian)
    q = _chance(_eta(x, beta))
    scores = rows.groupBy("g").agg(*[F.sum(c * (y - q)).alias(f"s{i}") for i, c in enumerate(x)])
    found = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs]).first()
    meat = np.zeros((p, p))
    for (i, j), v in zip(pairs, found, strict=True):
        meat[i, j] = meat[j, i] = v
    cov = first.groups / (first.groups - 1) * bread @ meat @ bread if first.groups > 1 else np.full((p, p), np.nan)
    return Logit(list(columns), beta, cov, fit, n, first.groups, int(events))


def score(frame: DataFrame, model: Logit, caps: dict | None = None, name: str = "pred") -> DataFrame:
    """``frame`` with the probability that ``model`` (fitted without units) gives each row."""
    return frame.withColumn(name, _chance(_eta([F.lit(1.0), *[design(c, caps) for c in model.columns]], model.beta)))


def coefficient_table(frame: DataFrame, columns: list[str], caps: dict | None = None, units: dict[str, float] | None = None) -> DataFrame:
    """A row per term: coefficient per unit, clustered error, z, p, interval and odds ratio, and what the fit rests on.

    ``status`` is ``fitted``, or why the likelihood has no single maximum: ``one outcome``, ``separated`` or
    ``collinear``.  Coefficients are unknown then (null), rows, borrowers and events are counted all the same.
    """
    units = UNITS if units is None else units
    try:
        model = fit_logit(frame, columns, caps=caps, units=units)
        found = (model.rows, model.clusters, model.events, model.fit, "separated" if model.separated else "fitted")
    except NoLogit as e:
        found = (e.rows, e.clusters, e.events, None, e.status)
    rows = []
    for i, term in enumerate(["const", *columns]):
        known = [None] * 9
        if found[-1] == "fitted":
            b, se = float(model.beta[i]), math.sqrt(max(float(model.cov[i, i]), 0.0))
            z = b / se if se else None
            low, high = b - 1.96 * se, b + 1.96 * se
            known = [b, se, z, None if z is None else math.erfc(abs(z) / math.sqrt(2)), low, high, _odds(b), _odds(low), _odds(high)]
        rows.append((term, float(units.get(term, 1.0)) if i else None, *known, *found))
    fields = "term string, per double, coef double, se_cluster double, z double, p_value double, ci_low double, ci_high double, odds_ratio double, or_ci_low double, or_ci_high double"
    return frame.sparkSession.createDataFrame(rows, fields + ", n_obs long, n_borrowers long, n_events long, pseudo_r2 double, status string")


def split_predictions(frame: DataFrame, columns: list[str], train_end: int, tests: list[int], caps: dict | None = None) -> DataFrame:
    """One fit on labelled quarters up to ``train_end``, scored on ``tests``, which begin after the last training window has closed."""
    if min(tests) < train_end + HORIZON:
        raise ValueError("training windows must close by the first test quarter")
    model = fit_logit(frame.where((F.col("qsort") <= train_end) & F.col("y").isNotNull()), columns, caps=caps)
    return score(frame.where(F.col("qsort").isin(*tests)), model, caps)


def rolling_predictions(frame: DataFrame, columns: list[str], least_quarters: int = LEAST_QUARTERS, caps: dict | None = None) -> DataFrame:
    """Every labelled quarter scored by a fit on the quarters whose windows closed by then; those with too few are left out.

    The quarters, at most a few dozen, are listed on the driver: one fit each.
    """
    frame = cut(frame.where("y is not null"))
    quarters = [r.qsort for r in frame.select("qsort").distinct().orderBy("qsort").collect()]
    out = frame.limit(0).withColumns({"pred": F.lit(0.0), "train_last_q": F.lit(0)})
    for q in quarters:
        seen = [k for k in quarters if k <= q - HORIZON]
        if len(seen) >= least_quarters:
            model = fit_logit(frame.where(F.col("qsort") <= seen[-1]), columns, caps=caps)
            out = out.unionByName(score(frame.where(F.col("qsort") == q), model, caps).withColumn("train_last_q", F.lit(seen[-1])))
    return out


def equal_weight_score(frame: DataFrame, columns: list[str], name: str = "pred") -> DataFrame:
    """The mean of the predictors' percent ranks within the quarter, each turned so that more is riskier."""
    turned = frame.withColumns({f"_r_{c}": design(c, {}) * RISK.get(c, 1) for c in columns})
    ranked = percent_ranks(turned, {f"_p_{c}": f"_r_{c}" for c in columns}, "qsort")
    return ranked.withColumn(name, sum((F.col(f"_p_{c}") for c in columns), F.lit(0.0)) / (100 * len(columns))).select(*frame.columns, name)


def _draws(group: Column, resample: Column, seed: int) -> Column:
    """How often a group is drawn in a resample: Poisson of mean 1 from a hash, so that every task draws alike."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), resample, group), 11) / F.lit(float(2**53))
    edges, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        edges.append(total)
    return sum(((u >= e).cast("int") for e in edges), F.lit(0))


def _resampled(frame: DataFrame, group: str, resamples: int, seed: int) -> DataFrame:
    out = frame.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    return out.withColumn("_w", _draws(F.col(group), F.col("_b"), seed)).where("_w > 0")


def _interval(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.percentile(column, F.lit(0.025)).alias("ci_low"), F.percentile(column, F.lit(0.975)).alias("ci_high"))


def ratio_interval(frame: DataFrame, num: Column, den: Column, group: str = "borrower", resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """One row: sum of ``num`` over sum of ``den``, and its 95 % interval when groups, not rows, are drawn again.  Sums by group come first."""
    sums = cut(frame.groupBy(group).agg(F.sum(num.cast("double")).alias("_n"), F.sum(den.cast("double")).alias("_d")))
    value = sums.agg(F.try_divide(F.sum("_n"), F.sum("_d")).alias("value"))
    each = _resampled(sums, group, resamples, seed).groupBy("_b").agg(F.try_divide(F.sum(F.col("_w") * F.col("_n")), F.sum(F.col("_w") * F.col("_d"))).alias("v"))
    return value.crossJoin(_interval(each, "v"))  # one row each


def score_interval(frame: DataFrame, measure: str = "auc", group: str = "borrower", resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """One row: ROC-AUC (``auc``) or average precision (``average_precision``) of ``pred``, and its 95 % interval when groups are drawn again."""
    compute = {"auc": roc_auc, "average_precision": average_precision}[measure]
    frame = cut(frame.select(group, "y", "pred"))
    value = compute(frame.withColumn("_b", F.lit(0)), ("_b",)).select(F.col(measure).alias("value"))
    each = compute(_resampled(frame, group, resamples, seed), ("_b",), "_w")
    return value.crossJoin(_interval(each, measure))  # one row each


def auc_gain(frame: DataFrame, base: DataFrame, group: str = "borrower", resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """One row: how much more ROC-AUC ``frame`` has than ``base`` on the rows they share, on the same resamples."""
    both = frame.join(base.select(group, "qsort", F.col("pred").alias("_base")), [group, "qsort"])
    both = cut(both.select(group, "y", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("pred").alias("pred")), F.struct(F.lit(0).alias("k"), F.col("_base").alias("pred")))).alias("s")).select(group, "y", "s.*"))

    def gain(found: DataFrame, *by: str) -> DataFrame:
        signed = F.when(F.col("k") == 1, F.col("auc")).otherwise(-F.col("auc"))
        return found.groupBy(*by).agg(F.sum(signed).alias("v"))

    value = gain(roc_auc(both, ("k",))).select(F.col("v").alias("value"))
    each = gain(roc_auc(_resampled(both, group, resamples, seed), ("_b", "k"), "_w"), "_b")
    return value.crossJoin(_interval(each, "v"))  # one row each


def recall_interval(frame: DataFrame, share: float, group: str = "borrower", resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """One row: the share of events among the riskiest ``share`` of each quarter, with its interval (the review list held fixed)."""
    placed = quarter_ranks(frame, tie=group)
    return ratio_interval(placed, F.when(F.col("rank") <= share, F.col("y")).otherwise(0), F.col("y"), group, resamples, seed)


def regression_scores(frame: DataFrame, y: str, pred: str, benchmark: float) -> DataFrame:
    """One row: R2 against always predicting ``benchmark``, and both root mean squared errors."""
    error, plain = F.pow(F.col(y) - F.col(pred), F.lit(2.0)), F.pow(F.col(y) - F.lit(float(benchmark)), F.lit(2.0))
    return frame.agg(
        (1 - F.sum(error) / F.sum(plain)).alias("r2"), F.sqrt(F.avg(error)).alias("rmse"), F.sqrt(F.avg(plain)).alias("rmse_benchmark")
    )
