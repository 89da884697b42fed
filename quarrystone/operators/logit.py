"""Logistic regression by iterated normal equations: each step is one aggregate over the cluster, and the driver solves a matrix of the terms alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "intercept"


def irls(df: DataFrame, features: list[str], label: str, weight: str | None = None, ridge: float = 1e-8, steps: int = 30, tolerance: float = 1e-10) -> DataFrame:
    """term, coefficient, error, odds_ratio of each feature and the intercept.

    A step sums the upper half of X'WX, and X'Wz, over the rows; ``ridge`` is added to the diagonal, the intercept's included. It ends after ``steps``, or
    when no coefficient moves by ``tolerance``. Rows that lack a value, and those of no weight, are left out; without any, coefficients are 0 and errors those of the ridge.
    Rows alike count as one of their summed weight, so a fit on few distinct values costs as many cells a step.
    """
    names = [*features, INTERCEPT]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w")).dropna().where("__w > 0")
    cells = rows.groupBy(*features, "__y").agg(F.sum("__w").alias("__w")).persist()
    x: dict[str, Column] = {c: F.col(c) for c in features} | {INTERCEPT: F.lit(1.0)}
    n = len(names)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    beta, matrix = np.zeros(n), np.zeros((n, n))
    try:
        for _ in range(steps):
            eta = sum((F.lit(float(b)) * x[c] for b, c in zip(beta, names)), F.lit(0.0))
            mu = 1 / (1 + F.exp(-F.col("__eta")))
            each = cells.withColumn("__eta", eta).withColumn("__mu", mu).withColumn("__v", F.greatest(F.col("__mu") * (1 - F.col("__mu")), F.lit(1e-9)))
            v = F.col("__w") * F.col("__v")
            z = F.col("__eta") + (F.col("__y") - F.col("__mu")) / F.col("__v")
            sums = each.agg(*(F.sum(v * x[names[i]] * x[names[j]]) for i, j in pairs), *(F.sum(v * z * x[c]) for c in names)).first()
            found = [s or 0.0 for s in sums]
            matrix = np.zeros((n, n))
            for (i, j), s in zip(pairs, found):
                matrix[i, j] = matrix[j, i] = s
            matrix += ridge * np.eye(n)
            new = np.linalg.solve(matrix, np.asarray(found[len(pairs) :]))
            moved, beta = float(np.abs(new - beta).max()), new
            if moved < tolerance:
                break
    finally:
        cells.unpersist()
    errors = np.sqrt(np.maximum(np.diag(np.linalg.inv(matrix)), 0))
    out = [(c, float(b), float(e), float(np.exp(min(b, 700.0)))) for c, b, e in zip(names, beta, errors)]
    return df.sparkSession.createDataFrame(out, "term string, coefficient double, error double, odds_ratio double")


def predicted(df: DataFrame, fit: DataFrame, name: str = "score") -> DataFrame:
    """df with the fitted probability; null where a feature is. fit: the rows of irls, one a term."""
    terms = {r.term: r.coefficient for r in fit.collect()}
    eta = sum((F.lit(b) * F.col(c) for c, b in terms.items() if c != INTERCEPT), F.lit(terms[INTERCEPT]))
    return df.withColumn(name, 1 / (1 + F.exp(-eta)))
