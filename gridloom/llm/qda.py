"""Regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .stats import FEATURES

#: These are counts or ratios without a bound; the others are shares.
_UNBOUNDED = [FEATURES.index(x) for x in ("words", "word_length", "lines_per_word")]


def transform(x: np.ndarray) -> np.ndarray:
    """Logarithms, so that statistics with long tails come near the normal distribution."""
    out = np.log(x + 0.003)
    out[:, _UNBOUNDED] = np.log1p(x[:, _UNBOUNDED])
    return out


def steadied(x: np.ndarray, centre: np.ndarray, words: float = 10.0) -> np.ndarray:
    """Transformed statistics, those of short texts drawn towards the centre as if they had `words` more usual words;
    the number of words itself stays."""
    t = transform(x)
    out = centre + x[:, :1] / (x[:, :1] + words) * (t - centre)
    out[:, 0] = t[:, 0]
    return out


@dataclass(frozen=True)
class Discriminant:
    """centre: medians of the transformed statistics. means, and the inverses of the covariances' Cholesky factors, of classes 0 and 1; constant: the log odds apart
    from the Mahalanobis distances. A discriminant without classes gives `constant` alone."""

    centre: np.ndarray | None
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    constant: float

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.full(len(features), self.constant)
        if self.means:
            x = steadied(features, self.centre)
            distance = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
            z += 0.5 * (distance[0] - distance[1])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(features: np.ndarray, label: np.ndarray, shrinkage: float = 0.05, floor: float = 0.02) -> Discriminant:
    """Each class covariance is shrunk towards its own diagonal, and no variance is below `floor`. With fewer than two
    rows of a class the share of label 1, smoothed, is the score of every text."""
    n = [int((label == k).sum()) for k in (0, 1)]
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < 2:
        return Discriminant(None, (), (), odds)
    centre = np.median(transform(features), axis=0)
    x = steadied(features, centre)
    means, factors, constant = [], [], odds
    for k in (0, 1):
        own = x[label == k]
        cov = np.cov(own, rowvar=False)
        spread = np.diag(np.maximum(np.diag(cov), floor))
        cov = (1 - shrinkage) * cov + shrinkage * spread + np.diag(np.maximum(0, floor - np.diag(cov)))
        chol = np.linalg.cholesky(cov)
        means.append(own.mean(axis=0))
        factors.append(np.linalg.inv(chol))
        constant += (1 if k == 0 else -1) * float(np.log(np.diag(chol)).sum())
    return Discriminant(centre, tuple(means), tuple(factors), constant)
