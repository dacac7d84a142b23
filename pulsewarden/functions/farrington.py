"""Seasonal quasi-Poisson exceedance detector over weekly sums anchored at each evaluated day.

For a day k the weeks are sums of seven days counted back from k; lag 0 is the current week. Weeks near the
same time of earlier years share a seasonal group with lag 0, and the weeks between are cut into nine more
groups; the group depends on the lag alone. A log-linear quasi-Poisson model with one effect per group and a
slope over lags is fitted to the weeks at lags 28 to 265, refitted with outbreaks weighed down, and the current
week is compared with an upper quantile. For a given slope the group effects have a closed form, so a fit is a
Newton search in one number, done for all days of a series at once. Whether a fit counts as one is judged apart from that,
by iterated least squares and their deviance, as fitting routines for such models commonly do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.functions.quantiles import quantile

FREQUENCY, YEARS, HALF_WINDOW, GROUPS = 52.18, 5, 3, 10
RECENT, ALPHA, ENOUGH, DAYS = 28, 0.01, 5, 343
# Fixed values of the rule by which a fit settles: steps, relative change of the deviance, least mean.
STEPS, REST, LEAST = 25, 1e-8, 2.220446049250313e-16
SCHEMA = "signal int, sim string, t int, mu double, upper double, exceedance double, alarm double, alarmall double, trend double, slope double, status string"


def lag_groups(last: int = 330) -> np.ndarray:
    """Group 1..10 of each lag 0..last: 1 around whole years, 2 to 10 in steps of five weeks back from there.

    Where a year is a week longer, the week left over belongs to group 1.
    """
    centres = [int(np.round(FREQUENCY * i)) for i in range(YEARS + 2)]
    out = np.zeros(last + 1, int)
    for this, following in zip(centres, centres[1:]):
        end = following - HALF_WINDOW
        for lag in range(max(0, this - HALF_WINDOW), min(end, last + 1)):
            past = lag - this - HALF_WINDOW
            out[lag] = 2 + (past - 1) // 5 if 0 < past <= 5 * (GROUPS - 1) else 1
    return out


def group_table() -> list[tuple[int, int]]:
    """(lag, group) of the weeks a full history is fitted to."""
    groups = lag_groups()
    return [(lag, int(groups[lag])) for lag in range(RECENT, 266)]


def fit(y: np.ndarray, groups: np.ndarray, x: np.ndarray, used: np.ndarray, weights: np.ndarray, trend: np.ndarray | None = None):
    """Quasi-Poisson fits of each row of y (days by weeks): mean, dispersion, leverage, slope, log effect of group 1.

    Weighted likelihood equations for log mu = a_g + b * x with weights w: a_g = log(sum w y / sum w e^(b x)) over
    the group, b by Newton on the profile score. Rows where trend is False, and those whose Newton search does not
    settle, are fitted without slope; their slope is NaN.
    """
    w = np.where(used, weights, 0.0)
    member = (groups[:, None] == np.arange(1, GROUPS + 1)[None, :]).astype(float)
    total = (w * y) @ member
    centred = x - x.mean()
    sloped = np.ones(len(y), bool) if trend is None else trend.copy()
    b = np.zeros(len(y))
    sum_xy = (w * y * centred).sum(axis=1)
    for _ in range(40):
        e = w * np.exp(np.clip(b[:, None] * centred, -30, 30))
        s0, s1, s2 = e @ member, (e * centred) @ member, (e * centred**2) @ member
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(s0 > 0, s1 / s0, 0.0)
            var = np.where(s0 > 0, s2 / s0 - mean**2, 0.0)
        score = sum_xy - (total * mean).sum(axis=1)
        info = (total * var).sum(axis=1)
        move = np.where(sloped & (info > 1e-12), score / np.maximum(info, 1e-12), 0.0)
        b = b + np.clip(move, -0.2, 0.2)
        if np.abs(move).max(initial=0.0) < 1e-10:
            break
    sloped &= np.isfinite(b) & (np.abs(move) < 1e-6)
    b = np.where(sloped, b, 0.0)
    e = w * np.exp(np.clip(b[:, None] * centred, -30, 30))
    s0 = e @ member
    with np.errstate(divide="ignore", invalid="ignore"):
        effect = np.where((s0 > 0) & (total > 0), np.log(total / s0), -30.0)
    mu = np.exp(np.clip(effect @ member.T + b[:, None] * centred, -60, 60))
    wm = w * mu
    mass = wm @ member
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(mass > 0, (wm * centred) @ member / mass, 0.0)
    off = centred - mean @ member.T
    info = (wm * off**2).sum(axis=1)
    within = np.where(mass > 0, 1 / np.where(mass > 0, mass, 1.0), 0.0) @ member.T
    along = np.where(sloped[:, None], off**2 / np.maximum(info, 1e-12)[:, None], 0.0)
    leverage = np.clip(wm * (within + along), 0, 0.999)
    n = used.sum(axis=1) - (mass > 0).sum(axis=1) - sloped
    phi = np.maximum((np.where(used, w * (y - mu) ** 2 / np.maximum(mu, 1e-12), 0.0)).sum(axis=1) / np.maximum(n, 1), 1.0)
    return mu, phi, leverage, np.where(sloped, b, np.nan), effect[:, 0] - b * x.mean()


def settles(y: np.ndarray, groups: np.ndarray, x: np.ndarray, used: np.ndarray, weights: np.ndarray, sloped: np.ndarray) -> np.ndarray:
    """Whether iterated least squares for each row of y settle: their deviance changes by less than REST within STEPS steps.

    They start at y + 0.1. A step is a regression of the working response on groups and, where sloped, the slope.
    """
    w = np.where(used, weights, 0.0)
    member = (groups[:, None] == np.arange(1, GROUPS + 1)[None, :]).astype(float)
    centred = x - x.mean()
    mu = np.where(used, y + 0.1, 1.0)
    eta, out, left = np.log(mu), np.zeros(len(y), bool), np.arange(len(y))

    def deviance(mu):
        return 2 * (w * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0) - y + mu)).sum(axis=1)

    old = deviance(mu)
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            v, z = w * mu, eta + (y - mu) / mu
            s0 = v @ member
            mean_x, mean_z = (np.where(s0 > 0, (v * a) @ member / s0, 0.0) for a in (centred, z))
            off = centred - mean_x @ member.T
            info = (v * off**2).sum(axis=1)
            b = np.where(sloped & (info > 0), (v * off * z).sum(axis=1) / info, 0.0)
            eta = (mean_z - b[:, None] * mean_x) @ member.T + b[:, None] * centred
            mu = np.maximum(np.exp(eta), LEAST)
            new = deviance(mu)
            rest = np.abs(new - old) / (np.abs(new) + 0.1) < REST
            out[left[rest]] = True
            more = ~rest & np.isfinite(new)
            if not more.any():
                break
            y, w, mu, eta, sloped, old, left = y[more], w[more], mu[more], eta[more], sloped[more], new[more], left[more]
    return out


def _slopes(y, groups, x, used, weights, wanted, judged) -> tuple[np.ndarray, np.ndarray]:
    """(rows fitted with a slope, rows with a fit); where a wanted slope does not settle, a fit without one may. Rows not judged pass."""
    sloped, fitted = wanted.copy(), np.ones(len(y), bool)

    def judge(rows: np.ndarray, slope: np.ndarray) -> None:
        fitted[rows] = settles(y[rows], groups, x, used[rows], weights[rows], slope)

    judge(np.flatnonzero(judged), wanted[judged])
    again = np.flatnonzero(wanted & ~fitted)
    if len(again):
        sloped[again] = False
        judge(again, sloped[again])
    return sloped, fitted


def down_weights(y: np.ndarray, mu: np.ndarray, phi: np.ndarray, leverage: np.ndarray, used: np.ndarray, cut: float = 2.58) -> np.ndarray:
    """Weights from Anscombe residuals: those above the cut weigh by their inverse square; all add up to the weeks used."""
    mu = np.maximum(mu, 1e-12)
    s = 1.5 * (np.maximum(y, 0) ** (2 / 3) * mu ** (-1 / 6) - np.sqrt(mu)) / np.sqrt(phi[:, None] * (1 - leverage))
    raw = np.where(used, np.where(s > cut, 1 / np.maximum(s, cut) ** 2, 1.0), 0.0)
    return raw * (used.sum(axis=1) / np.maximum(raw.sum(axis=1), 1e-12))[:, None]


class Trace:
    """Table function over the days of one series, in order: the rows of detect for it."""

    def __init__(self):
        self.key, self.counts = None, []

    def eval(self, row):
        self.key = row["signal"], row["sim"]
        self.counts.append(row["x"] or 0.0)

    def terminate(self):
        if self.key is None:
            return
        got = one_series(np.array(self.counts, float))
        names = [f.split()[0] for f in SCHEMA.split(", ")][2:]
        for k in range(len(got["t"])):
            row = [got[n][k].item() for n in names]
            yield (int(self.key[0]), self.key[1], *(None if isinstance(v, float) and np.isnan(v) else v for v in row))


def register(spark) -> None:
    """Make `farrington_trace(TABLE(rows) PARTITION BY (signal, sim) ORDER BY t)` known to SQL; rows have signal, sim, t and x."""
    spark.udtf.register("farrington_trace", F.udtf(Trace, returnType=SCHEMA))


def one_series(x: np.ndarray, days: int = DAYS, alpha: float = ALPHA, trend: bool = True, variant: str = "a") -> dict[str, np.ndarray]:
    """Results of the last `days` days of one series of daily counts; options as in detect."""
    if variant not in ("a", "b"):
        raise ValueError(f"unknown variant {variant!r}")
    n = len(x)
    ends = np.arange(max(n - days, 0), n)
    lags = np.arange(266)
    groups = lag_groups(265)
    cumulated = np.concatenate([[0.0], np.cumsum(x)])
    last = ends[:, None] - 7 * lags[None, :]
    whole = last - 6 >= 0
    y = np.where(whole, cumulated[np.clip(last + 1, 0, n)] - cumulated[np.clip(last - 6, 0, n)], 0.0)
    # weeks count back to the oldest whole one with cases; the days before the first whole week of an end are not looked at
    nonzero = np.flatnonzero(x > 0)
    first_days = np.append(nonzero, n)[np.searchsorted(nonzero, np.arange(7))]
    first_day = first_days[(ends + 1) % 7]
    history = np.maximum(ends - first_day, 0) // 7
    if variant == "b":  # without cases, all weeks count as history
        history = np.where(first_day > ends, np.round((ends + 1) / 7).astype(int) - 1, history)
    short = history < 2 * round(FREQUENCY) + HALF_WINDOW + 1
    used = whole & (lags[None, :] >= 27) & (lags[None, :] <= history[:, None])
    full = history >= FREQUENCY * YEARS + HALF_WINDOW + 1
    used &= ~(full[:, None] & (lags[None, :] < RECENT))
    cases = used & (y > 0)
    few = cases.sum(axis=1) < 2
    newest, oldest = cases.argmax(axis=1), len(lags) - 1 - cases[:, ::-1].argmax(axis=1)
    spread_out = oldest - newest >= 52
    ones = np.ones_like(y)
    slope_at = -lags.astype(float)
    missing = short | few
    wanted = spread_out & ~missing & (trend or variant == "b")
    sloped, fitted = _slopes(y, groups, slope_at, used, ones, wanted, ~missing)
    mu, phi, leverage, first, _ = fit(y, groups, slope_at, used, ones, sloped)
    weights = down_weights(y, mu, phi, leverage, used)
    sloped, refitted = _slopes(y, groups, slope_at, used, weights, sloped & ~np.isnan(first), ~missing & fitted)
    _, phi, _, b, base = fit(y, groups, slope_at, used, weights, sloped)
    unfit = ~(fitted & refitted)
    # weeks of a full history are counted from a fractional one, so the current week lies further by its fraction
    fraction = np.where(full, np.ceil(FREQUENCY * YEARS) - FREQUENCY * YEARS, 0.0)
    predicted = np.exp(np.clip(base - np.nan_to_num(b) * fraction, -60, 60))
    recent = cumulated[ends + 1] - cumulated[np.maximum(ends - 27, 0)]
    upper = np.maximum(quantile(predicted, phi, 1 - alpha), 1).astype(float)
    spread = upper - predicted
    exceedance = (y[:, 0] - predicted) / np.where(np.abs(spread) < 1e-12, 1e-12, spread)
    status = np.where(short, "short", np.where(few, "few", np.where(unfit, "unfit", np.where(recent < ENOUGH, "low", "ok"))))
    marked = lambda value: np.where(short, 1e300, np.where(few, np.inf, np.where(unfit, np.nan, value)))
    alarmall = marked((exceedance > 1).astype(float))
    alarm = np.where(status == "low", 1e-300, alarmall)
    missing |= unfit
    return {"t": ends, "mu": np.where(missing, np.nan, predicted), "upper": marked(upper), "exceedance": np.where(missing, np.nan, exceedance), "alarm": alarm,
            "alarmall": alarmall, "trend": marked((~np.isnan(b) & trend).astype(float)), "slope": np.where(missing, np.nan, b), "status": status}


def detect(series: DataFrame, days: int = DAYS, alpha: float = ALPHA, trend: bool = True, variant: str = "a") -> DataFrame:
    """Alarms of the last `days` days of each series; a series, some thousand days long, is one group.

    alarm is 1 or 0, or a sentinel: 1e300 for too short a history, infinity for too few weeks with cases, 1e-300
    for too few recent cases (alarmall keeps 1 or 0 there). status names them; upper and trend have the first two as
    well. trend is 1 where a slope was fitted, 0 where all weeks with cases lie within a year or the fit with a slope did
    not settle; slope is its value a week, null without one. Where the fit without a slope does not settle either, status
    is 'unfit' and all results are null. Missing counts are 0.

    With trend=False no slope is fitted. Variant 'b' differs in two cases: a series without any cases counts all its weeks
    as history, so its days are 'few' and not 'short', and trend=False leaves the fit as it is and only sets `trend` to 0.
    """
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        got = one_series(part["x"].fillna(0.0).to_numpy(), days, alpha, trend, variant)
        out = pd.DataFrame({k: got[k] for k in ("t", "mu", "upper", "exceedance", "alarm", "alarmall", "trend", "slope", "status")})
        out.insert(0, "sim", part["sim"].iloc[0])
        out.insert(0, "signal", part["signal"].iloc[0])
        return out

    return series.select(F.col("signal").cast("int"), "sim", F.col("t").cast("int"), F.col("x").cast("double")).groupBy("signal", "sim").applyInPandas(run, SCHEMA)
