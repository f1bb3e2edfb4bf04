"""Tails of distributions for numpy arrays, to machine precision at any size of their parameters.

Sums and continued fractions go on for the rows that still change, so none is as long as its parameters are large.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 2.0**-54
#: Terms of a sum that are worked out at once.
STEP = 64
#: Degrees of freedom from which Student's t is normal but for terms of the order of 1 / df^2.
NORMAL = 1e7

_ERRORS = np.array([0.0] + [math.log(math.factorial(n)) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) for n in range(1, 16)])


def stirling_error(n: np.ndarray) -> np.ndarray:
    """ln n! less Stirling's formula, for whole n >= 0."""
    x = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * x * x)) / (x * x)) / (x * x)) / (x * x)) / x
    return np.where(n < 16, _ERRORS[np.minimum(n, 15).astype(int)], series)


def deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x without cancellation where both are close."""
    v = (x - mean) / np.maximum(x + mean, 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    near, term = (x - mean) * v, 2 * x * v
    for k in range(1, 12):
        term = term * v * v
        near = near + term / (2 * k + 1)
    return np.where(np.abs(v) < 0.1, near, far)


def binomial_log_pmf(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The binomial log density by saddle points: its error doesn't grow with n."""
    rest = n - x
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = stirling_error(n) - stirling_error(x) - stirling_error(rest) - deviance(x, n * p) - deviance(rest, n * (1 - p)) + 0.5 * np.log(n / (2 * math.pi * x * rest))
        none, every = np.where(n > 0, n * np.log1p(-p), 0.0), np.where(n > 0, n * np.log(p), 0.0)
    return np.where(x <= 0, none, np.where(rest <= 0, every, inner))


def hypergeom_tail(k: np.ndarray, draws: np.ndarray, marked: np.ndarray, total: np.ndarray) -> np.ndarray:
    """P(at least k marked among `draws` of `total`): from k away from the middle, each term from the one before."""
    low, high = np.maximum(0, draws + marked - total), np.minimum(draws, marked)
    out = np.where(k <= low, 1.0, 0.0)
    out[np.isnan(k + draws + marked + total)] = np.nan
    inside = (k > low) & (k <= high)
    if not inside.any():
        return out
    k, n, m, t, low, high = (x[inside] for x in (k, draws, marked, total, low, high))
    up = k > n * (m / t)  # the far side of the middle; on the near side the lower sum is taken from one
    first = np.where(up, k, k - 1)
    p = n / t
    with np.errstate(divide="ignore"):
        start = np.exp(binomial_log_pmf(first, m, p) + binomial_log_pmf(n - first, t - m, p) - binomial_log_pmf(n, t, p))
    # As many draws as there are: the outcome is certain, and no k is left between its bounds.
    sums, term, at, going = start.copy(), start.copy(), first.copy(), np.arange(len(first))
    steps = np.arange(STEP)
    while len(going):
        i = at[going, None] + np.where(up[going, None], steps, -steps)
        a, b, c = m[going, None], n[going, None], t[going, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(up[going, None], (a - i) * (b - i) / ((i + 1) * (c - a - b + i + 1)), i * (c - a - b + i) / ((a - i + 1) * (b - i + 1)))
        ended = np.where(up[going, None], i >= high[going, None], i <= low[going, None])
        terms = term[going, None] * np.cumprod(np.where(ended, 0.0, ratio), axis=1)
        sums[going] += terms.sum(1)
        term[going], at[going] = terms[:, -1], i[:, -1] + np.where(up[going], 1, -1)
        going = going[terms[:, -1] > EPS * sums[going]]
    out[inside] = np.clip(np.where(up, sums, 1 - sums), 0.0, 1.0)
    return out


def _log_beta_half(a: np.ndarray) -> np.ndarray:
    """ln B(a, 1/2), without the difference of two large logarithms."""
    x = np.maximum(a, 12.0)
    y = 1 / (x * x)
    rise = 0.5 * np.log(x) - (1 / 8 - (1 / 192 - (1 / 640 - (17 / 14336 - 31 / 18432 * y) * y) * y) * y) / x
    small = np.array([math.lgamma(v + 0.5) - math.lgamma(v) if v < 12 else 0.0 for v in a.tolist()])
    return 0.5 * math.log(math.pi) - np.where(a < 12, small, rise)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    out, going = d.copy(), np.arange(len(x))
    k = 0
    while len(going):
        k += 1
        aa, bb, xx, change = a[going], b[going], x[going], np.ones(len(going))
        for step in (k * (bb - k) * xx / ((aa + 2 * k - 1) * (aa + 2 * k)), -(aa + k) * (aa + bb + k) * xx / ((aa + 2 * k) * (aa + 2 * k + 1))):
            d[going] = 1 / away(1 + step * d[going])
            c[going] = away(1 + step / c[going])
            change = c[going] * d[going]
            out[going] *= change
        going = going[np.abs(change - 1) > 4 * EPS]
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t; none for missing values or degrees of freedom of 0 or less."""
    out = np.full(len(t), np.nan)
    usable = ~np.isnan(t) & (df > 0)
    out[usable & np.isinf(t)] = 0.0
    usable &= ~np.isinf(t)
    # Where x would differ from one by rounding: the normal limit with its terms of 1 / df.
    many = usable & (df > NORMAL)
    z = np.abs(t[many]) * (1 - 1 / (4 * df[many])) / np.sqrt(1 + np.square(t[many]) / (2 * df[many]))
    out[many] = [math.erfc(v / math.sqrt(2)) for v in z.tolist()]
    usable &= ~many
    a, square = df[usable] / 2, np.square(t[usable]) / df[usable]
    half = np.full_like(a, 0.5)
    x, rest = 1 / (1 + square), square / (1 + square)
    with np.errstate(divide="ignore"):
        front = np.exp(-a * np.log1p(square) + 0.5 * np.log(rest) - _log_beta_half(a))
    far = x < (a + 1) / (a + 2.5)
    value = np.ones_like(a)
    value[far] = (front / a)[far] * _fraction(a[far], half[far], x[far])
    value[~far] = 1 - (front / 0.5)[~far] * _fraction(half[~far], a[~far], rest[~far])
    out[usable] = np.clip(value, 0.0, 1.0)
    return out


#: Cody's rational approximations of the error function: up to 0.46875, and from there.
_ERF = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
_ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to some 1e-15; 1 in absolute value beyond 5.95, where it rounds to it."""
    a = np.abs(x)
    near, mid = np.minimum(a, 0.46875) ** 2, np.clip(a, 0.46875, 6.0)
    low = a * (np.polyval(_ERF[0], near) / np.polyval(_ERF[1], near))
    high = 1 - np.exp(-mid * mid) * (np.polyval(_ERFC[0], mid) / np.polyval(_ERFC[1], mid))
    return np.copysign(np.where(a <= 0.46875, low, np.where(a > 5.95, 1.0, high)), x)
