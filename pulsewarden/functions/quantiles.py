"""Quantiles of Poisson and negative binomial counts by distribution functions, at a cost that does not grow with the mean.

The distribution functions are regularised incomplete gamma and beta functions, by series and continued fractions; the
quantile is the least count whose function value reaches p, found between bounds that are widened and then halved.
"""

from __future__ import annotations

import numpy as np

_TINY = 1e-300
#: Terms at most; the fractions need some multiple of the root of their largest argument near its middle.
_TERMS = 20_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series after shifting small x up."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        small = y < 10
        if not small.any():
            break
        low = np.where(small, low + np.log(np.where(small, y, 1.0)), low)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - low


def _fraction(first: np.ndarray, term) -> np.ndarray:
    """A continued fraction first + a1 / (b1 + a2 / (b2 + ...)) by Lentz's method; term(k) gives (ak, bk)."""
    f = np.where(first == 0, _TINY, first)
    c, d = f.copy(), np.zeros_like(f)
    for k in range(1, _TERMS):
        a, b = term(k)
        d = b + a * d
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + a / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = c * d
        f = f * step
        if np.abs(step - 1).max(initial=0.0) < 1e-15:
            break
    return f


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): the chance of fewer than a Poisson counts with mean x, for whole a."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.empty(a.shape)
    front = np.exp(-x + a * np.log(x) - log_gamma(a))
    low = x < a + 1
    if low.any():
        s, t = a[low].copy(), x[low]
        term = 1 / s
        total = term.copy()
        for _ in range(_TERMS):
            s = s + 1
            term = term * t / s
            total = total + term
            if (term < total * 1e-16).all():
                break
        out[low] = 1 - front[low] * total
    if (~low).any():
        s, t = a[~low], x[~low]
        out[~low] = front[~low] / _fraction(t + 1 - s, lambda k: (-k * (k - s), t + 2 * k + 1 - s))
    return np.clip(out, 0.0, 1.0)


def beta_share(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_p(a, b), with q = 1 - p given apart to keep its digits."""
    a, b, p, q = (x.copy() for x in np.broadcast_arrays(*(np.asarray(x, float) for x in (a, b, p, q))))
    turned = p > (a + 1) / (a + b + 2)
    a, b, p, q = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, q, p), np.where(turned, p, q)
    front = np.exp(a * np.log(p) + b * np.log(q) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a

    def term(k):
        m = k // 2
        if k % 2 == 0:
            return m * (b - m) * p / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * p / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    value = front / _fraction(np.ones_like(a), term)
    return np.clip(np.where(turned, 1 - value, value), 0.0, 1.0)


def distribution(k: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Chance of at most k counts with mean mu and variance mu * phi: Poisson where phi is 1, else negative binomial."""
    k, mu, phi = np.broadcast_arrays(np.asarray(k, float), np.asarray(mu, float), np.asarray(phi, float))
    out = np.zeros(k.shape)
    some, plain = k >= 0, phi - 1 < 1e-9
    if (some & plain).any():
        at = some & plain
        out[at] = upper_gamma(k[at] + 1, mu[at])
    if (some & ~plain).any():
        at = some & ~plain
        out[at] = beta_share(mu[at] / (phi[at] - 1), k[at] + 1, 1 / phi[at], (phi[at] - 1) / phi[at])
    return out


def quantile(mu: np.ndarray, phi: np.ndarray, p: float) -> np.ndarray:
    """Least counts whose distribution function reaches p (less 1e-12)."""
    mu, phi = np.maximum(np.atleast_1d(mu).astype(float), 1e-12), np.maximum(np.atleast_1d(phi).astype(float), 1.0)
    reached = lambda k: distribution(k, mu, phi) >= p - 1e-12
    spread = np.sqrt(mu * phi) + phi + 1
    low, high = np.maximum(np.floor(mu - 2 * spread), -1.0), np.ceil(mu + 4 * spread)
    for _ in range(60):
        short = ~reached(high)
        if not short.any():
            break
        low, high = np.where(short, high, low), np.where(short, high + 2 * (high - low), high)
    below = reached(low)
    low = np.where(below, -1.0, low)
    while (high - low > 1).any():
        middle = np.floor((low + high) / 2)
        up = reached(middle)
        low, high = np.where(up, low, middle), np.where(up, middle, high)
    return high.astype(np.int64)
