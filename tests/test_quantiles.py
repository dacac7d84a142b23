import math

import numpy as np

from pulsewarden.functions import farrington, quantiles


def summed(mu, phi, p):
    """The same by adding probabilities up, in logs, from some way below the mean on."""
    r = mu / (phi - 1) if phi > 1 else None
    log = lambda k: -mu + k * math.log(mu) - math.lgamma(k + 1) if r is None else math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) - r * math.log(phi) + k * math.log((phi - 1) / phi)
    k = max(0, int(mu - 40 * math.sqrt(mu * phi)))
    total = 0.0
    while True:
        total += math.exp(log(k))
        if total >= p - 1e-12:
            return k
        k += 1


def test_log_gamma():
    x = np.concatenate([np.linspace(0.01, 30, 500), 10.0 ** np.arange(2, 9)])
    assert np.allclose(quantiles.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-12)


def test_quantiles_are_those_of_sums():
    rng = np.random.default_rng(4)
    mu, phi = 10 ** rng.uniform(-4, 3.5, 400), np.where(rng.random(400) < 0.3, 1.0, 1 + 10 ** rng.uniform(-3, 2, 400))
    for p in (0.5, 0.95, 0.99):
        assert quantiles.quantile(mu, phi, p).tolist() == [summed(m, f, p) for m, f in zip(mu, phi)]


def test_means_of_ten_million():
    got = quantiles.quantile(np.array([1e7, 1e7, 3e7]), np.array([1.0, 4.0, 1.5]), 0.99)
    assert got.tolist() == [summed(1e7, 1.0, 0.99), summed(1e7, 4.0, 0.99), summed(3e7, 1.5, 0.99)]


def test_the_detector_uses_them():
    mu, phi = np.array([0.3, 5.0, 80.0]), np.array([1.0, 2.0, 1.0])
    assert farrington.quantile(mu, phi, 0.99).tolist() == quantiles.quantile(mu, phi, 0.99).tolist()
