"""Sparse regression of model accuracy on chunk perplexities, with every chunk a feature.

There are few models (rows) and very many chunks (features), so the fit is an exact active-set
method: folds are fitted on a small set of features, one distributed pass looks through all
features for those that would still improve some fit, these join the set, and so on until the
pass finds none. Only the residuals of the fits (models × fits numbers) are sent to the pass.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from pplscope.bounded import small_side
from pplscope.operators.perplexity import common_models, ppl_wide

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["text_id", "chunk_id"]
# The fold that holds nothing out.
ALL = -1
VIOLATION = 1e-6


def design_matrix(ppl: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Long design: `model, text_id, chunk_id, value, label` for the models with an accuracy."""
    rated = small_side(accuracy.where(F.col("accuracy").isNotNull()).select("model", F.col("accuracy").alias("label")))
    return ppl.join(rated, "model").select("model", *KEYS, F.col("ppl").alias("value"), "label")


def screen_features(gamma: DataFrame, k: int) -> DataFrame:
    """The `k` chunks with the largest score in absolute value: a start set, not a limit."""
    return gamma.orderBy(F.desc_nulls_last(F.abs("gamma")), *KEYS).limit(k)


def feature_rows(ppl: DataFrame, models: list[str]) -> DataFrame:
    """One row per chunk: its perplexity under each model, as an array in the order of `models`;
    chunks that lack one are left out."""
    values = F.array(*[F.col(f"`{m}`") for m in models])
    return ppl_wide(ppl, models).select(*KEYS, values.alias("values")).where(~F.exists("values", lambda v: v.isNull()))


def loo_folds(models: DataFrame) -> DataFrame:
    """`fold, model, is_test`: each model held out once, folds numbered by model name."""
    names = models.agg(F.sort_array(F.collect_set("model")).alias("names"))
    folds = names.select("names", F.posexplode("names").alias("fold", "held_out"))
    return folds.select("fold", "held_out", F.explode("names").alias("model")).select(
        "fold", "model", (F.col("model") == F.col("held_out")).alias("is_test")
    )


def scale_features(features: DataFrame, models: list[str]) -> DataFrame:
    """`fold, text_id, chunk_id, model, scaled, is_test`: each fold's values divided by the
    population deviation of its training models (by 1 for a constant feature); not centred.

    Row-local on `feature_rows`.
    """
    n = len(models)

    def others(fold):
        return F.filter("values", lambda _, i: i != fold)

    def mean(xs):
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / (n - 1)

    fold = F.col("fold")
    folds = features.select(*KEYS, "values", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold"))
    centred = folds.withColumn("_mean", mean(others(fold)))
    variance = F.aggregate(
        others(fold), F.lit(0.0), lambda acc, x: acc + (x - F.col("_mean")) * (x - F.col("_mean"))
    ) / (n - 1)
    # A variance within rounding of zero counts as constant.
    eps = float(np.finfo(np.float64).eps)
    rounding = (n - 1) * eps * F.col("_var") + F.pow((n - 1) * eps * F.col("_mean"), F.lit(2))
    scale = F.when(F.col("_var") <= rounding, F.lit(1.0)).otherwise(F.sqrt("_var"))
    scaled = centred.withColumn("_var", variance).withColumn("_scale", scale)
    names = F.array(*[F.lit(m) for m in models])
    return scaled.select(fold, *KEYS, "_scale", F.posexplode("values").alias("_i", "_x")).select(
        "fold", *KEYS, F.element_at(names, F.col("_i") + 1).alias("model"),
        (F.col("_x") / F.col("_scale")).alias("scaled"), (F.col("_i") == F.col("fold")).alias("is_test"),
    )


def _scales(x: np.ndarray) -> np.ndarray:
    """Population deviation per column of models × features; 1 where constant up to rounding."""
    n, mean, var = len(x), x.mean(0), x.var(0)
    eps = np.finfo(np.float64).eps
    return np.where(var <= n * eps * var + (n * mean * eps) ** 2, 1.0, np.sqrt(var))


def _descend(x: np.ndarray, y: np.ndarray, alpha: float, w: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """Coordinate descent for centred x, y from start w, on the features that can move."""
    n = len(y)
    w, square = w.copy(), (x * x).sum(0) / n
    for _ in range(rounds):
        r = y - x @ w
        moving = np.flatnonzero((np.abs(x.T @ r / n) > alpha * (1 + 1e-9)) | (w != 0))
        biggest = 0.0
        for j in moving:
            if square[j] == 0.0:
                continue
            rho = x[:, j] @ r / n + square[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / square[j]
            if new != w[j]:
                r += x[:, j] * (w[j] - new)
                biggest = max(biggest, abs(new - w[j]) * np.sqrt(square[j]))
                w[j] = new
        if biggest <= 1e-12 * max(1.0, np.abs(y).max()):
            break
    return w


def path_coefficients(x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Minimisers of |y - b - xw|²/2n + alpha·|w|₁ for each of the falling `alphas`.

    The solution is piecewise linear in alpha, so it is followed from knot to knot: between two
    knots the set of nonzero coefficients is fixed. A point that then fails the optimality
    check (ties, collinear features) is finished by coordinate descent.
    """
    n, p = x.shape
    x, y = x - x.mean(0), y - y.mean()
    c = x.T @ y / n
    w = np.zeros(p)
    knots, points = [np.inf], [w.copy()]
    alpha = float(np.abs(c).max()) if p else 0.0
    active: list[int] = []
    entering, left = (int(np.abs(c).argmax()) if p else -1), -1
    last = float(alphas.min())
    for _ in range(20 * n + 50):
        knots.append(alpha)
        points.append(w.copy())
        if alpha <= last:
            break
        if entering >= 0:
            active.append(entering)
        sign = np.sign(c[active])
        gram = x[:, active].T @ x[:, active] / n
        step = np.linalg.lstsq(gram, sign, rcond=None)[0]
        slope = x.T @ (x[:, active] @ step) / n
        free = np.ones(p, bool)
        free[active] = False
        if left >= 0:
            free[left] = False
        if len(active) >= n - 1:
            free[:] = False
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(free & (1 - slope > 1e-10), (alpha - c) / (1 - slope), np.inf)
            down = np.where(free & (1 + slope > 1e-10), (alpha + c) / (1 + slope), np.inf)
            zero = np.where(step * w[active] < 0, -w[active] / step, np.inf)
        join = np.minimum(np.maximum(up, 0), np.maximum(down, 0))
        entering, left = -1, -1
        t = alpha - last
        if p and join.min() < t:
            entering, t = int(join.argmin()), float(join.min())
        if active and zero.min() < t:
            entering, t = -1, float(zero.min())
            left = active[int(zero.argmin())]
        w[active] += t * step
        c = c - t * slope
        alpha -= t
        if left >= 0:
            w[left] = 0.0
            active.remove(left)
            if not active:
                break
        elif entering < 0:
            knots.append(alpha)
            points.append(w.copy())
            break
    out = np.zeros((len(alphas), p))
    start = np.zeros(p)
    for i, a in enumerate(alphas):
        at = int(np.searchsorted(-np.asarray(knots), -a))
        if at >= len(knots):
            guess = points[-1]
        elif at <= 1:
            guess = points[1]
        else:
            hi, lo = knots[at - 1], knots[at]
            part = 0.0 if hi == lo else (hi - a) / (hi - lo)
            guess = points[at - 1] + part * (points[at] - points[at - 1])
        rest = x.T @ (y - x @ guess) / n if p else np.zeros(0)
        held = guess != 0
        gap = max(np.max(np.abs(rest) - a, initial=0.0), np.max(np.abs(rest[held] - a * np.sign(guess[held])), initial=0.0))
        out[i] = guess if gap <= 1e-9 * max(a, 1e-12) + 1e-14 else _descend(x, y, a, start if i else guess)
        start = out[i]
    return out


class LassoFit(NamedTuple):
    """`predictions` (model, label, prediction), the alpha of the final fit, its nonzero
    `coefficients` (text_id, chunk_id, beta), and the number of passes over the features."""

    predictions: DataFrame
    alpha: float
    coefficients: DataFrame
    passes: int


def _fold_rows(n: int, outer: int, inner: int) -> np.ndarray:
    return np.array([i for i in range(n) if i not in (outer, inner)])


def lasso_path(folds: DataFrame, active: np.ndarray, labels: np.ndarray, alphas: np.ndarray) -> DataFrame:
    """Fit every (outer, inner) fold of `folds` on the `active` features (models × features).

    One row per fold and alpha: residuals per model (0 where held out), the squared error on the
    inner held-out model, the prediction for the outer one, and the nonzero coefficients.
    """
    n = len(labels)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        outer, inner = int(group["outer"].iloc[0]), int(group["inner"].iloc[0])
        train = _fold_rows(n, outer, ALL)
        x = active / _scales(active[train])
        rows = _fold_rows(n, outer, inner)
        coefficients = path_coefficients(x[rows], labels[rows], alphas)
        out = []
        for i, w in enumerate(coefficients):
            used = np.flatnonzero(w)
            fitted = x[:, used] @ w[used]
            fitted = fitted + (labels[rows] - fitted[rows]).mean()
            residuals = np.zeros(n)
            residuals[rows] = labels[rows] - fitted[rows]
            out.append({
                "outer": outer, "inner": inner, "alpha_index": i, "residuals": residuals,
                "inner_error": float((labels[inner] - fitted[inner]) ** 2) if inner != ALL else None,
                "prediction": float(fitted[outer]) if outer != ALL else None,
                "used": used, "beta": w[used],
            })
        return pd.DataFrame(out)

    schema = (
        "outer int, inner int, alpha_index int, residuals array<double>, inner_error double, "
        "prediction double, used array<long>, beta array<double>"
    )
    return folds.groupBy("outer", "inner").applyInPandas(fit, schema)


# Numbers of a table of features by fits that a task works on at a time.
CELLS = 1 << 19


def _worst_features(
    batches: Iterator[pd.DataFrame], residuals: np.ndarray, bound: np.ndarray, trains: list[np.ndarray], fold_of: np.ndarray
) -> pd.DataFrame:
    """The feature that breaks each fit's optimality most. What is kept of a feature is copied, so that a
    batch is let go when it has been looked through, and the working tables are of one size for any number of fits."""
    best = np.full(len(bound), 1 + VIOLATION)
    rows: list[tuple | None] = [None] * len(bound)
    step = max(1, CELLS // max(1, len(bound)))
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack(batch["values"].to_numpy())
        scales = np.stack([_scales(values[:, t].T) for t in trains], axis=1)
        for at in range(0, len(batch), step):
            ratio = np.abs(values[at:at + step] @ residuals)
            scale = scales[at:at + step, fold_of]
            scale *= bound
            ratio /= scale
            top = ratio.argmax(0)
            found = ratio[top, np.arange(len(bound))]
            for f in np.flatnonzero(found > best):
                i = at + int(top[f])
                best[f], rows[f] = found[f], (*[batch[k].iloc[i] for k in KEYS], values[i].copy())
    kept = [(f, best[f], *r) for f, r in enumerate(rows) if r is not None]
    return pd.DataFrame(kept, columns=["fit", "ratio", *KEYS, "values"])


def violating_features(features: DataFrame, fits: pd.DataFrame, alphas: np.ndarray, n: int) -> DataFrame:
    """For each fit and alpha, the feature that breaks its optimality most, if any does.

    Streams the features once; a task keeps one candidate per fit, whatever it reads.
    """
    residuals = np.stack(fits["residuals"].to_numpy()).T
    outer = fits["outer"].to_numpy()
    size = np.array([len(_fold_rows(n, o, i)) for o, i in zip(fits["outer"], fits["inner"])])
    bound = alphas[fits["alpha_index"].to_numpy()] * size
    folds = np.unique(outer)
    fold_of = np.searchsorted(folds, outer)
    trains = [_fold_rows(n, int(o), ALL) for o in folds]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _worst_features(batches, residuals, bound, trains, fold_of)

    schema = StructType().add("fit", IntegerType()).add("ratio", DoubleType())
    for field in features.select(*KEYS, "values").schema.fields:
        schema = schema.add(field)
    found = features.select(*KEYS, "values").mapInPandas(look, schema)
    return found.groupBy("fit").agg(F.max(F.struct("ratio", *KEYS, "values")).alias("worst")).select("worst.*")


def lasso_loo(
    features: DataFrame,
    labels: dict[str, float],
    alphas: np.ndarray | None = None,
    start: DataFrame | None = None,
    max_passes: int = 100,
) -> LassoFit:
    """Leave-one-out predictions and the final fit, alpha by inner leave-one-out.

    `features` are `feature_rows` in the order of the sorted model names of `labels`; give a
    written table, as every pass reads it. `start` (e.g. from `screen_features`) names the
    features to begin with; the result does not depend on it.
    """
    spark = features.sparkSession
    models = sorted(labels)
    n, y = len(models), np.array([labels[m] for m in models], float)
    grid = np.sort(np.logspace(-4, 2, 50) if alphas is None else np.asarray(alphas, float))[::-1]
    pairs = [(o, i) for o in range(ALL, n) for i in range(ALL, n) if i == ALL or i != o]
    folds = spark.createDataFrame(pairs, "outer int, inner int").repartition(len(pairs), "outer", "inner")
    keys: list[tuple] = []
    columns: list[np.ndarray] = []
    seen: set[tuple] = set()

    def add(rows) -> int:
        fresh = 0
        for r in rows:
            key = (r.text_id, r.chunk_id)
            if key not in seen:
                seen.add(key)
                keys.append(key)
                columns.append(np.array(r["values"], float))
                fresh += 1
        return fresh

    if start is not None:
        add(features.join(small_side(start.select(*KEYS)), KEYS).orderBy(*KEYS).collect())
    for passes in range(1, max_passes + 1):
        active = np.stack(columns, axis=1) if columns else np.zeros((n, 0))
        fits = lasso_path(folds, active, y, grid).toPandas()
        if not add(violating_features(features, fits, grid, n).orderBy(*KEYS).collect()):
            break
    else:
        raise RuntimeError(f"some fit still gains features after {max_passes} passes")

    errors = fits[fits["inner"] != ALL].groupby(["outer", "alpha_index"])["inner_error"].mean().unstack()
    chosen = {int(o): int(np.argmin(row)) for o, row in zip(errors.index, errors.to_numpy())}
    refits = fits[fits["inner"] == ALL].set_index(["outer", "alpha_index"])
    predicted = [(m, float(y[j]), float(refits.loc[(j, chosen[j]), "prediction"])) for j, m in enumerate(models)]
    final = refits.loc[(ALL, chosen[ALL])]
    nonzero = [(*keys[int(u)], float(b)) for u, b in zip(final["used"], final["beta"])]
    key_types = features.select(*KEYS).schema
    coefficient_schema = StructType([*key_types.fields]).add("beta", DoubleType())
    return LassoFit(
        spark.createDataFrame(predicted, "model string, label double, prediction double"),
        float(grid[chosen[ALL]]),
        spark.createDataFrame(nonzero, coefficient_schema),
        passes,
    )


def loo_predictions(ppl: DataFrame, accuracy: DataFrame, features: DataFrame | None = None, **options) -> LassoFit:
    """`lasso_loo` from perplexities and accuracies; the models' accuracies come to the driver."""
    labels = {r.model: r.accuracy for r in common_models(ppl, accuracy).collect()}
    if features is None:
        from pplscope.scratch import materialize

        features = materialize(feature_rows(ppl, sorted(labels)), "features")
    return lasso_loo(features, labels, **options)


def loo_metrics(predictions: DataFrame) -> DataFrame:
    """`r2, mse` of held-out predictions, in one aggregate."""
    error = F.pow(F.col("label") - F.col("prediction"), F.lit(2))
    return predictions.agg(
        F.sum(error).alias("_res"), (F.var_pop("label") * F.count("label")).alias("_tot"), F.avg(error).alias("mse")
    ).select((1 - F.try_divide(F.col("_res"), F.col("_tot"))).alias("r2"), "mse")


def nonzero_coefficients(fit: LassoFit) -> DataFrame:
    """`text_id, chunk_id, beta, alpha` of the final fit."""
    return fit.coefficients.withColumn("alpha", F.lit(fit.alpha))
