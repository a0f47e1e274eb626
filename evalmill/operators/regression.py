"""Logistic regressions by Newton steps, with cluster-robust errors.

Several models over the same rows are fitted together: each step is one aggregation of all gradients and curvatures, a few
numbers; the rows are kept by the executors while the steps go on, and stay where they are.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE = 30, 1e-10


class Fit:
    def __init__(self, name: str, y: str, terms: list[str]):
        self.name, self.y, self.terms = name, F.col(y), ["const", *terms]
        self.x = [F.lit(1.0), *(F.col(t) for t in terms)]
        self.k = len(self.x)
        self.upper = [(i, j) for i in range(self.k) for j in range(i, self.k)]
        self.beta, self.curve, self.done = np.zeros(self.k), np.eye(self.k), False

    @property
    def p(self) -> Column:
        return 1 / (1 + F.exp(-sum((float(b) * x for b, x in zip(self.beta, self.x, strict=True)), F.lit(0.0))))

    def sums(self) -> list[Column]:
        e, v = self.y - self.p, self.p * (1 - self.p)
        return [*(F.sum(e * a) for a in self.x), *(F.sum(v * self.x[i] * self.x[j]) for i, j in self.upper)]

    def symmetric(self, values: list[float]) -> np.ndarray:
        out = np.zeros((self.k, self.k))
        for (i, j), value in zip(self.upper, values, strict=True):
            out[i, j] = out[j, i] = value
        return out

    def step(self, got: list[float]) -> None:
        self.curve = self.symmetric(got[self.k :])
        change = np.linalg.lstsq(self.curve, np.array(got[: self.k]), rcond=None)[0]
        self.beta = self.beta + change
        self.done = bool(np.abs(change).max() < TOLERANCE)

    def rows(self, n: int, loglik: float, groups: int, meat: np.ndarray) -> list[tuple]:
        bread = np.linalg.pinv(self.curve)
        cover = bread @ meat @ bread * (groups / max(1, groups - 1)) * ((n - 1) / max(1, n - self.k))
        aic = 2 * self.k - 2 * loglik
        rounded = lambda *v: tuple(round(float(x), 6) for x in v)
        return [
            (self.name, t, *rounded(b, s, b / s if s else float("nan"), aic, loglik), int(n))
            for t, b, s in zip(self.terms, self.beta, np.sqrt(np.diag(cover)), strict=True)
        ]


def logits(rows: DataFrame, y: str, models: dict[str, list[str]], cluster: str) -> list[tuple]:
    """(model, term, coefficient, clustered error, z, AIC, log-likelihood, n) of the constant and each term of each model."""
    fits = [Fit(name, y, terms) for name, terms in models.items()]
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(STEPS):
            going = [f for f in fits if not f.done]
            if not going:
                break
            got = list(kept.agg(*(c for f in going for c in f.sums())).first())
            for f in going:
                f.step([got.pop(0) or 0.0 for _ in f.sums()])
        likely = [F.sum(f.y * F.log(f.p) + (1 - f.y) * F.log(1 - f.p)) for f in fits]
        n, *loglik = kept.agg(F.count("*"), *likely).first()
        scores = {f"s{m}_{i}": F.sum((f.y - f.p) * a) for m, f in enumerate(fits) for i, a in enumerate(f.x)}
        each = kept.groupBy(cluster).agg(*(c.alias(name) for name, c in scores.items()))
        crossed = [F.sum(F.col(f"s{m}_{i}") * F.col(f"s{m}_{j}")) for m, f in enumerate(fits) for i, j in f.upper]
        groups, *meat = each.agg(F.count("*"), *crossed).first()
        out = []
        for f, value in zip(fits, loglik, strict=True):
            out += f.rows(n, value or 0.0, groups, f.symmetric([meat.pop(0) or 0.0 for _ in f.upper]))
        return out
    finally:
        kept.unpersist()
