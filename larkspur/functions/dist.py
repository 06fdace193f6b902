"""Distribution functions and test p-values in plain Python, for the few numbers that aggregation leaves."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x), by the finite sums for whole degrees of freedom."""
    if not x > 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return min(1.0, math.exp(-half) * total)
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) / math.sqrt(math.pi * half)
    for k in range(1, (df + 1) // 2):
        term *= half / (k - 0.5)
        total += term
    return min(1.0, total)


def kolmogorov_tail(d: float, n: int) -> float:
    """P(D >= d) of the two-sided one-sample statistic: the matrix form up to 140 observations, else the limit series with Stephens' correction."""
    if n <= 140:
        k = math.ceil(n * d)
        h, m = k - n * d, 2 * k - 1
        if m <= 0:
            return 1.0
        a = np.tril(np.ones((m, m)), 1) * 1.0
        a[np.triu_indices(m, 2)] = 0
        for i in range(m):
            a[i, 0] -= h ** (i + 1)
            a[m - 1, i] -= h ** (m - i)
        a[m - 1, 0] += max(0.0, 2 * h - 1) ** m
        i, j = np.indices((m, m))
        a /= np.vectorize(lambda g: math.factorial(g) if g > 0 else 1.0)(np.maximum(i - j + 1, 0)).astype(float)
        q, shift = np.eye(m), 0
        power, base, base_shift = n, a, 0
        while power:
            if power % 2:
                q, shift = q @ base, shift + base_shift
            base, base_shift, power = base @ base, 2 * base_shift, power // 2
            for x in (q, base):
                if x[m // 2, m // 2] > 1e140:
                    x *= 1e-140
                    if x is q:
                        shift += 140
                    else:
                        base_shift += 140
        value = q[k - 1, k - 1]
        for i in range(1, n + 1):
            value *= i / n
            if value < 1e-140:
                value, shift = value * 1e140, shift - 140
        return float(min(1.0, max(0.0, 1 - value * 10.0**shift)))
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def lilliefors_tail(d: float, n: int) -> float:
    """Dallal and Wilkinson's approximation; beyond p = 0.1, where it does not hold, Stephens' scaled statistic between the table's points."""
    if n > 100:
        d, n = d * (n / 100) ** 0.49, 100
    p = math.exp(-7.01256 * d * d * (n + 2.78019) + 2.99587 * d * math.sqrt(n + 2.78019) - 0.122119 + 0.974598 / math.sqrt(n) + 1.67997 / n)
    if p <= 0.1:
        return p
    x = d * (math.sqrt(n) - 0.01 + 0.85 / math.sqrt(n))
    return float(np.interp(x, [0.302, 0.4, 0.5, 0.6, 0.7, 0.775, 0.819], [1.0, 0.95, 0.8, 0.6, 0.35, 0.15, 0.1]))


# Stephens' points for the Anderson-Darling statistic, both parameters estimated.
ANDERSON_LEVELS = (0.15, 0.10, 0.05, 0.025, 0.01)
ANDERSON_POINTS = (0.561, 0.631, 0.752, 0.873, 1.035)


def anderson_tail(a2: float, n: int) -> float:
    """Between the points, and no further than their ends; the points are divided by 1 + 0.75/n + 2.25/n**2."""
    points = np.array(ANDERSON_POINTS) / (1 + 0.75 / n + 2.25 / n**2)
    return float(np.interp(a2, points, ANDERSON_LEVELS))


def skew_z(skew: float, n: int) -> float:
    """D'Agostino's normal score of a population skewness; n of 8 or more."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    alpha = math.sqrt(2 / (w2 - 1))
    return math.asinh(y / alpha) / math.sqrt(0.5 * math.log(w2))


def kurtosis_z(excess: float, n: int) -> float:
    """Anscombe and Glynn's normal score of a population excess kurtosis."""
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (excess + 3 - mean) / math.sqrt(var)
    skewness = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skewness * (2 / skewness + math.sqrt(1 + 4 / skewness**2))
    inner = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    return (1 - 2 / (9 * a) - math.copysign(abs(inner) ** (1 / 3), inner)) / math.sqrt(2 / (9 * a))


def shapiro_wilk(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """W and p, after Royston (1995), for sorted values that occur ``counts`` times each."""
    x = np.repeat(values, counts) if counts is not None else np.asarray(values, float)
    n = len(x)
    m = np.array([NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = float(m @ m), 1 / math.sqrt(n)
    a = np.empty(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(ss)], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ss)], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = last, second, -last, -second
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
            a[-1], a[0] = last, -last
    spread = float(((x - x.mean()) ** 2).sum())
    if spread == 0:
        return 1.0, 1.0
    w = min(1.0, float(a @ x) ** 2 / spread)
    return w, shapiro_p(w, n)


def shapiro_wilk_of_sums(n: int, squares: float, cross: float, ends: tuple[float, float, float, float], spread: float) -> tuple[float, float]:
    """W and p of more than 5 values from sums over all ranks: of the squared normal scores and of score times value. ends: the two least and the two largest values; spread: the sum of squares. Values are deviations from their mean."""
    if spread == 0:
        return 1.0, 1.0
    m1, m2, u = NORMAL.inv_cdf((n - 0.375) / (n + 0.25)), NORMAL.inv_cdf((n - 1.375) / (n + 0.25)), 1 / math.sqrt(n)
    last = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m1 / math.sqrt(squares)], u))
    second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m2 / math.sqrt(squares)], u))
    phi = (squares - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * second**2)
    outer, inner = ends[3] - ends[0], ends[2] - ends[1]
    w = min(1.0, (last * outer + second * inner + (cross - m1 * outer - m2 * inner) / math.sqrt(phi)) ** 2 / spread)
    return w, shapiro_p(w, n)


def shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if g <= math.log1p(-w) if w < 1 else False:
            return 0.0
        y = -math.log(g - math.log1p(-w)) if w < 1 else math.inf
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, log_n = math.log1p(-w) if w < 1 else -math.inf, math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))
