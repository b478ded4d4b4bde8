"""Beta-Bernoulli statistics: numpy forms for grouped work and Column builders for plans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import PRIOR

#: Coefficients of digamma's asymptotic series in 1 / x**2.
_SERIES = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)


def digamma(x):
    """By recurrence to x + 6 and the asymptotic series; for numbers, arrays and Columns of positive values."""
    y = x + 6.0
    shift = sum(1.0 / (x + float(i)) for i in range(6))
    if isinstance(y, Column):
        return F.log(y) - 0.5 / y - sum(F.lit(c) / F.pow(y, F.lit(2.0 * i + 2)) for i, c in enumerate(_SERIES)) - shift
    return np.log(y) - 0.5 / y - sum(c / y ** (2 * i + 2) for i, c in enumerate(_SERIES)) - shift


def digamma_sql(x: str) -> str:
    """The same formula as SQL text."""
    y = f"({x} + 6e0)"
    shift = " + ".join(f"1e0/({x} + {i}e0)" for i in range(6))
    series = " + ".join(f"({c!r}e0)/power({y}, {2 * i + 2})" if "e" not in repr(c) else f"({c!r})/power({y}, {2 * i + 2})" for i, c in enumerate(_SERIES))
    return f"(ln({y}) - 0.5e0/{y} - ({series}) - ({shift}))"


def mean(alpha, beta):
    return alpha / (alpha + beta)


def variance(alpha, beta):
    return alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1.0))


def expected_log_likelihood(alpha: float, beta: float, positives: float, negatives: float) -> float:
    """Expected log likelihood of the observations under the posterior."""
    total = digamma(alpha + beta)
    return positives * (digamma(alpha) - total) + negatives * (digamma(beta) - total)


def per_observation(alpha: float, beta: float, positives: float, negatives: float) -> float:
    n = positives + negatives
    return expected_log_likelihood(alpha, beta, positives, negatives) / n if n > 0 else 0.0


def predictive_score(next_alpha: float, next_beta: float, alpha: float, beta: float) -> float:
    """How much better the narrower model predicts itself than it predicts what the wider one has besides, scaled by the ratio of means."""
    own = per_observation(next_alpha, next_beta, next_alpha, next_beta)
    rest = per_observation(next_alpha, next_beta, alpha - next_alpha, beta - next_beta)
    return mean(next_alpha, next_beta) / mean(alpha, beta) * (own - rest)


def with_predictive_score(df: DataFrame, next_alpha: str, next_beta: str, alpha: str, beta: str, out: str = "score") -> DataFrame:
    """``df`` with the same score as column ``out``; the digammas are columns of their own, so that each is computed once."""
    n = df.withColumns({"_a": F.col(next_alpha).cast("double"), "_b": F.col(next_beta).cast("double")})
    n = n.withColumns({"_ea": F.col(alpha) - F.col("_a"), "_eb": F.col(beta) - F.col("_b"), "_n": F.col("_a") + F.col("_b")})
    n = n.withColumns({"_up": digamma(F.col("_a")), "_down": digamma(F.col("_b")), "_all": digamma(F.col("_n"))})
    likelihood = lambda p, q: p * (F.col("_up") - F.col("_all")) + q * (F.col("_down") - F.col("_all"))
    a, b, ea, eb = (F.col(c) for c in ("_a", "_b", "_ea", "_eb"))
    rest = F.when(ea + eb > 0, likelihood(ea, eb) / (ea + eb)).otherwise(0.0)
    score = mean(a, b) / mean(F.col(alpha), F.col(beta)) * (likelihood(a, b) / F.col("_n") - rest)
    return n.withColumn(out, score).drop("_a", "_b", "_ea", "_eb", "_n", "_up", "_down", "_all")


def predictive_score_sql(na: str, nb: str, a: str, b: str) -> str:
    """The same score as SQL text over column names."""
    total = digamma_sql(f"({na} + {nb})")
    up, down = f"({digamma_sql(na)} - {total})", f"({digamma_sql(nb)} - {total})"
    own = f"({na} * {up} + {nb} * {down}) / ({na} + {nb})"
    ea, eb = f"({a} - {na})", f"({b} - {nb})"
    rest = f"(case when {ea} + {eb} > 0 then ({ea} * {up} + {eb} * {down}) / ({ea} + {eb}) else 0e0 end)"
    return f"(({na} / ({na} + {nb})) / ({a} / ({a} + {b})) * ({own} - {rest}))"


def priority(alpha: float, beta: float, root_alpha: float, root_beta: float, isolated: int = 0) -> float:
    """Search order, least first; isolated bases put a motif off."""
    return (1 - alpha / root_alpha) * (beta / root_beta) * 10.0**isolated


@dataclass(frozen=True)
class Model:
    alpha: float = PRIOR[0]
    beta: float = PRIOR[1]
    prior: tuple[float, float] = PRIOR

    def update(self, positives: float, negatives: float) -> Model:
        return Model(self.alpha + positives, self.beta + negatives, self.prior)

    @property
    def counts(self) -> tuple[float, float]:
        return self.alpha - self.prior[0], self.beta - self.prior[1]

    def mean(self) -> float:
        return mean(self.alpha, self.beta)

    def variance(self) -> float:
        return variance(self.alpha, self.beta)

    def standard_deviation(self) -> float:
        return self.variance() ** 0.5

    def log_likelihood(self) -> float:
        """Of alpha and beta, the prior's share among them, at the mean."""
        p = self.mean()
        return self.alpha * float(np.log(p)) + self.beta * float(np.log(1 - p))

    def log_likelihood_ratio(self, other: Model) -> float:
        return self.log_likelihood() - other.log_likelihood()

    def log_likelihood_per_observation(self) -> float:
        n = self.alpha + self.beta
        return self.log_likelihood() / n if n else 0.0

    def log_likelihood_ratio_per_observation(self, other: Model) -> float:
        """By the observations that the other model lacks."""
        n = self.alpha + self.beta - other.alpha - other.beta
        return self.log_likelihood_ratio(other) / n if n else 0.0

    def sample(self, n: int = 1, seed: int = 42) -> np.ndarray:
        return np.random.default_rng(seed).beta(self.alpha, self.beta, n)

    def predictive_check(self, positives: int, negatives: int, draws: int = 1000, seed: int = 42) -> float:
        """Share of simulated data sets that are no likelier than the observed one: each from a drawn rate, the observed at the mean."""
        rng, tiny = np.random.default_rng(seed), 1e-12
        p = rng.beta(self.alpha, self.beta, draws)
        k = rng.binomial(positives + negatives, p)
        likelihood = lambda k, n, p: k * np.log(p + tiny) + n * np.log(1 - p + tiny)
        return float((likelihood(k, positives + negatives - k, p) <= likelihood(positives, negatives, self.mean())).mean())

    def cdf(self, x: float, steps: int = 4096) -> float:
        """By Simpson's rule over the density."""
        t = np.linspace(0, 1, 2 * steps + 1)[1:-1]
        log = (self.alpha - 1) * np.log(t) + (self.beta - 1) * np.log1p(-t)
        d = np.exp(log - log.max())
        area = np.concatenate([[0], np.cumsum((d[1:] + d[:-1]) / 2)])
        return float(np.interp(x, t, area / area[-1]))

    def score_against(self, wider: Model) -> float:
        return predictive_score(self.alpha, self.beta, wider.alpha, wider.beta)


def kl_divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Per column of two (base, place) matrices, columns made to sum to 1; infinite where q lacks what p has."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = p / p.sum(0, keepdims=True)
        q = q / q.sum(0, keepdims=True)
        terms = np.where(p > 0, p * np.log(p / q), 0.0)
    return np.nan_to_num(terms, nan=0.0, posinf=np.inf).sum(0)
