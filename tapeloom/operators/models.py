"""Small linear models, fitted by spark.ml and scored as column expressions.

Features are standardised by population deviations first, so that penalties mean what they do for
1 / (n C) and alpha / n objectives. A fitted model is a few numbers; scoring is a dot product that stays
in generated code, with no UDF.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.metrics import softmax

CLASSES = (-1, 0, 1)
C_GRID, ALPHA_GRID = (0.01, 0.1, 1.0, 10.0), (0.1, 1.0, 10.0, 100.0)
CLIP = 1e-12


@dataclass
class Scaler:
    names: list[str]
    mean: list[float]
    std: list[float]

    def columns(self) -> list[Column]:
        return [(F.col(n) - m) / (s or 1.0) for n, m, s in zip(self.names, self.mean, self.std)]


def fit_scaler(df: DataFrame, names: list[str]) -> Scaler:
    row = df.agg(*(F.avg(n).alias(f"m{k}") for k, n in enumerate(names)), *(F.stddev_pop(n).alias(f"s{k}") for k, n in enumerate(names))).first()
    return Scaler(list(names), [row[f"m{k}"] for k in range(len(names))], [row[f"s{k}"] for k in range(len(names))])


def counted(df: DataFrame, names: list[str], label: str, *by: str) -> DataFrame:
    """(by, names, label, weight): the distinct rows of ``df`` that have a label, and how many there are of each. A fit
    over these by weight is the fit over all rows, and has no more of them as rows repeat."""
    return df.filter(F.col(label).isNotNull()).groupBy(*by, *names, label).agg(F.count("*").cast("double").alias("weight"))


def fit_weighted_scaler(df: DataFrame, names: list[str]) -> Scaler:
    """That of the rows which ``df`` (names, weight) counts."""
    w = F.col("weight")
    total = lambda v: F.sum(w * v) / F.sum(F.when(v.isNotNull(), w))
    mean = df.agg(*(total(F.col(n)).alias(f"m{k}") for k, n in enumerate(names))).first()
    # A mean of equal values may be off them by rounding, which is no deviation.
    spread = df.agg(*(F.when(F.min(n) == F.max(n), 0.0).otherwise(F.sqrt(total(F.pow(F.col(n) - F.lit(mean[f"m{k}"]), 2)))).alias(f"s{k}") for k, n in enumerate(names))).first()
    return Scaler(list(names), [mean[f"m{k}"] for k in range(len(names))], [spread[f"s{k}"] for k in range(len(names))])


def _assembled(df: DataFrame, scaler: Scaler, label: Column, *more: str) -> DataFrame:
    z = df.select(*(c.alias(f"z{k}") for k, c in enumerate(scaler.columns())), label.cast("double").alias("label"), *more)
    return VectorAssembler(inputCols=[f"z{k}" for k in range(len(scaler.names))], outputCol="features", handleInvalid="error").transform(z)


def _dot(scaler: Scaler, coef: list[float], bias: float) -> Column:
    out = F.lit(float(bias))
    for c, z in zip(coef, scaler.columns()):
        out = out + F.lit(float(c)) * z
    return out


@dataclass
class PriceModel:
    """Probabilities of a fall, no move and a rise. Classes that training lacked have probability 0."""

    scaler: Scaler
    present: list[int]
    coef: list[list[float]] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    c: float = 1.0

    def probabilities(self) -> list[Column]:
        if len(self.present) == 1:
            return [F.lit(float(k == self.present[0])) for k in CLASSES]
        p = softmax(*(_dot(self.scaler, w, b) for w, b in zip(self.coef, self.bias)))
        own = dict(zip(self.present, p))
        return [own.get(k, F.lit(0.0)) for k in CLASSES]

    def signal(self) -> Column:
        """P(rise) - P(fall)."""
        down, _, up = self.probabilities()
        return up - down

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def loads(text: str) -> PriceModel:
        d = json.loads(text)
        return PriceModel(**{**d, "scaler": Scaler(**d["scaler"])})


def fit_price(df: DataFrame, names: list[str], label: str, c: float = 1.0) -> PriceModel:
    """Multinomial regression with penalty 1 / (n C); of two classes, a binomial one."""
    return fit_price_counted(counted(df, names, label), names, label, c)


def fit_price_counted(rows: DataFrame, names: list[str], label: str, c: float = 1.0) -> PriceModel:
    """``fit_price`` of the rows that ``counted`` tells of."""
    counts = {int(r[0]): r[1] for r in rows.groupBy(label).agg(F.sum("weight")).collect()}
    present, n, scaler = sorted(counts), sum(counts.values()), fit_weighted_scaler(rows, names)
    if len(present) < 2:
        return PriceModel(scaler, present or [0], c=c)
    index = F.element_at(F.create_map(*(x for k, v in enumerate(present) for x in (F.lit(v), F.lit(k)))), F.col(label).cast("int"))
    fit = LogisticRegression(regParam=1 / (n * c), standardization=False, maxIter=200, tol=1e-9, family="multinomial" if len(present) > 2 else "binomial", weightCol="weight").fit(_assembled(rows, scaler, index, "weight"))
    if len(present) == 2:
        return PriceModel(scaler, present, [[0.0] * len(names), fit.coefficients.toArray().tolist()], [0.0, fit.intercept], c)
    return PriceModel(scaler, present, fit.coefficientMatrix.toArray().tolist(), fit.interceptVector.toArray().tolist(), c)


def log_loss(rows: DataFrame, model: PriceModel, label: str) -> float | None:
    """The mean over the rows that ``counted`` tells of."""
    p = model.probabilities()
    chosen = F.when(F.col(label) == -1, p[0]).when(F.col(label) == 0, p[1]).otherwise(p[2])
    loss = -F.ln(F.greatest(chosen, F.lit(CLIP)))
    return rows.agg(F.sum(F.col("weight") * loss) / F.sum(F.when(loss.isNotNull(), F.col("weight")))).first()[0]


def select_price(train: DataFrame, validation: DataFrame, names: list[str], label: str, grid=C_GRID, keep=lambda df: df) -> PriceModel:
    """The grid's first model of least validation loss. ``keep`` may write what the fits read."""
    train, validation = (keep(counted(d, names, label)) for d in (train, validation))
    fits = [fit_price_counted(train, names, label, c) for c in grid]
    losses = [log_loss(validation, m, label) for m in fits]
    return fits[min(range(len(fits)), key=lambda k: math.inf if losses[k] is None else losses[k])]


@dataclass
class ActionModel:
    """A miss probability and a cost of one action. A single-class miss is its constant rate."""

    scaler: Scaler
    miss_rate: float | None
    miss_coef: list[float]
    miss_bias: float
    cost_coef: list[float]
    cost_bias: float
    alpha: float

    def miss(self) -> Column:
        from tapeloom.functions.metrics import sigmoid

        return F.lit(self.miss_rate) if self.miss_rate is not None else sigmoid(_dot(self.scaler, self.miss_coef, self.miss_bias))

    def cost(self) -> Column:
        return _dot(self.scaler, self.cost_coef, self.cost_bias)


def fit_action(df: DataFrame, names: list[str], miss: str, cost: str, alpha: float = 1.0) -> ActionModel:
    """The miss model learns from all rows, the cost model from those with a cost."""
    model = fit_miss(df, names, miss)
    model.cost_coef, model.cost_bias = fit_ridge(df.filter(F.col(cost).isNotNull()), model.scaler, cost, alpha)
    model.alpha = alpha
    return model


def fit_miss(df: DataFrame, names: list[str], miss: str) -> ActionModel:
    """A model of the miss alone; of a single class it is the constant rate."""
    scaler = fit_scaler(df, names)
    rate, n = df.agg(F.avg(F.col(miss).cast("double")), F.count("*")).first()
    coef, bias, constant = [0.0] * len(names), 0.0, rate
    if rate is not None and 0 < rate < 1:
        fit = LogisticRegression(regParam=1 / n, standardization=False, maxIter=200, tol=1e-9).fit(_assembled(df, scaler, F.col(miss)))
        coef, bias, constant = fit.coefficients.toArray().tolist(), fit.intercept, None
    return ActionModel(scaler, constant, coef, bias, [0.0] * len(names), 0.0, 0.0)


@dataclass
class Moments:
    """Counts and sums of features x and a target y, of which every ridge fit and squared error follows; those
    of two sets of rows add up."""

    n: float
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __add__(self, other: Moments) -> Moments:
        return Moments(*(a + b for a, b in zip(vars(self).values(), vars(other).values())))

    def scale(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and population deviations; 1 for a constant."""
        mean = self.x / self.n
        var = np.diag(self.xx) / self.n - mean**2
        return mean, np.where(var > 1e-12 * (1 + mean**2), np.sqrt(np.maximum(var, 0)), 1.0)

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        """Coefficients of raw features and bias of least squares on standardised features with penalty
        alpha |w|^2; the bias is free."""
        mean, std = self.scale()
        centred = (self.xx - self.n * np.outer(mean, mean)) / np.outer(std, std)
        w = np.linalg.solve(centred + alpha * np.eye(len(mean)), (self.xy - self.n * mean * (self.y / self.n)) / std) / std
        return w, self.y / self.n - float(w @ mean)

    def mse(self, w: np.ndarray, bias: float) -> float:
        """The mean squared error of w.x + bias over these rows."""
        square = self.yy + w @ self.xx @ w + self.n * bias**2 - 2 * w @ self.xy - 2 * bias * self.y + 2 * bias * (w @ self.x)
        return float(square) / self.n


def moments(df: DataFrame, names: list[str], target: str, by: list[str]) -> dict[tuple, Moments]:
    """The moments of each group of ``by``, from one pass; rows with a null feature or target are left out. What
    comes to the driver is a matrix of features x features for each group, such as a session."""
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = df.select(*by, *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)), F.col(target).cast("double").alias("y")).dropna(subset=[f"x{k}" for k in range(p)] + ["y"])
    of = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = [F.count("*").alias("n"), F.sum("y").alias("y"), of("y", "y").alias("yy"), F.array(*(F.sum(f"x{k}") for k in range(p))).alias("x"), F.array(*(of(f"x{k}", "y") for k in range(p))).alias("xy"), F.array(*(of(f"x{i}", f"x{j}") for i, j in pairs)).alias("xx")]
    out = {}
    for r in rows.groupBy(*by).agg(*sums).orderBy(*by).collect():
        xx = np.zeros((p, p))
        for (i, j), v in zip(pairs, r.xx):
            xx[i, j] = xx[j, i] = v
        out[tuple(r[c] for c in by)] = Moments(float(r.n), np.array(r.x), r.y, xx, np.array(r.xy), r.yy)
    return out


def ridge_trials(by_session: list[tuple[str, Moments]], grid=ALPHA_GRID) -> list[tuple[str, float, float, int]]:
    """(session, alpha, mse, n_train) of each session but the first under fits on all sessions before it, for
    each alpha of the grid. Prefixes are running sums of moments, so rows are read once however many fits there
    are."""
    out, before = [], None
    for name, own in by_session:
        if before is not None:
            out += [(name, alpha, own.mse(*before.ridge(alpha)), int(before.n)) for alpha in grid]
        before = own if before is None else before + own
    return out


def choose_alpha(by_session: list[tuple[str, Moments]], grid=ALPHA_GRID) -> float:
    """The grid's first alpha of least error on the last session, of fits on those before it; with one session
    there is nothing to choose by, and the grid's first counts."""
    last = [(mse, k) for k, (name, _, mse, _) in enumerate(ridge_trials(by_session, grid)) if name == by_session[-1][0]]
    return grid[min(last)[1] % len(grid)] if last else grid[0]


def fit_action_by_moments(df: DataFrame, names: list[str], miss: str, cost: str, grid=ALPHA_GRID) -> ActionModel:
    """An action's models: the miss model learns from all rows of ``df`` (session_id, names, miss, cost), the cost
    model from those with a cost, with the alpha that its last session chooses, refitted on all. Without such rows
    nothing is known: both predictions are NaN, which the choice takes for a fallback."""
    found = sorted((k[0], v) for k, v in moments(df, names, cost, ["session_id"]).items())
    if not found:
        zeros = [0.0] * len(names)
        return ActionModel(Scaler(list(names), zeros, zeros), math.nan, zeros, 0.0, zeros, math.nan, grid[0])
    alpha, total = choose_alpha(found, grid), found[0][1]
    for _, own in found[1:]:
        total = total + own
    model = fit_miss(df, names, miss)
    w, bias = total.ridge(alpha)
    # Scoring goes by the scaler of the miss model.
    std = np.array([s or 1.0 for s in model.scaler.std])
    model.cost_coef, model.cost_bias, model.alpha = (w * std).tolist(), bias + float(w @ np.array(model.scaler.mean)), alpha
    return model


def support_rule(df: DataFrame, names: list[str], min_rows: int, margin: float) -> Column:
    """Whether a row lies within the features' ranges in ``df``, each widened by ``margin`` of its width."""
    r = df.agg(F.count("*").alias("n"), *(f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    if not r.n:
        return F.lit(False)
    wide = [(r[f"hi{i}"] - r[f"lo{i}"]) * margin for i in range(len(names))]
    return supported(names, [r[f"lo{i}"] - w for i, w in enumerate(wide)], [r[f"hi{i}"] + w for i, w in enumerate(wide)], r.n, min_rows)


def fit_ridge(df: DataFrame, scaler: Scaler, target: str, alpha: float) -> tuple[list[float], float]:
    """Least squares with penalty alpha |w|^2 (the bias is free). The library scales its penalty by the
    target's deviation, which is undone here; a constant target has no slope."""
    spread, mean, n = df.agg(F.stddev_pop(target), F.avg(target), F.count("*")).first()
    if not n or not spread:
        return [0.0] * len(scaler.names), mean or 0.0
    fit = LinearRegression(regParam=alpha * spread / n, solver="normal", standardization=False).fit(_assembled(df, scaler, F.col(target)))
    return fit.coefficients.toArray().tolist(), fit.intercept


def forward_chained(df: DataFrame, sessions: list[str], names: list[str], label: str, min_train: int = 1, keep=lambda df: df) -> DataFrame:
    """Rows of each session scored by a model of the sessions before it: (df.*, signal). The first
    ``min_train`` sessions have no signal and are left out. Sessions are few; each fit reads the counts of
    their distinct rows, which ``keep`` may write."""
    out, rows = None, keep(counted(df, names, label, "session_id"))
    for k in range(min_train, len(sessions)):
        model = fit_price_counted(rows.filter(F.col("session_id").isin(sessions[:k])), names, label)
        part = df.filter(F.col("session_id") == sessions[k]).withColumn("signal", model.signal())
        out = part if out is None else out.unionByName(part)
    return out


def supported(names: list[str], low: list[float], high: list[float], n_rows: int, min_rows: int) -> Column:
    """Enough training rows, and every feature finite and within its bounds, ends included."""
    ok = F.lit(n_rows >= min_rows)
    for n, lo, hi in zip(names, low, high):
        ok = ok & F.coalesce(~F.isnan(n) & F.col(n).between(lo, hi), F.lit(False))
    return ok


def check_schema(df: DataFrame, names: list[str]) -> None:
    """The feature columns must be there in the frozen order."""
    found = [c for c in df.columns if c in set(names)]
    if found != list(names):
        raise ValueError(f"feature columns {found} differ from the frozen {list(names)}")
