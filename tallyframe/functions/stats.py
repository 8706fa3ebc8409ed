"""Tail probabilities of the rule tests, computed from a handful of aggregates."""

from __future__ import annotations

import math

import numpy as np

# Critical values of the Anderson-Darling normality test (unknown
# mean and variance) at 15, 10, 5, 2.5 and 1 percent.
ANDERSON_NORMAL = {0.15: 0.576, 0.10: 0.656, 0.05: 0.787, 0.025: 0.918, 0.01: 1.092}


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def anderson_critical(n: int, alpha: float) -> float:
    base = ANDERSON_NORMAL.get(alpha, ANDERSON_NORMAL[0.05])
    return round(base / (1.0 + 4.0 / n - 25.0 / n / n), 3)


def chi_square_tail(x: float, dof: int) -> float:
    """Upper tail of chi-square: the regularised incomplete gamma Q(dof/2, x/2)."""
    a, half = dof / 2.0, x / 2.0
    if half <= 0:
        return 1.0
    scale = math.exp(-half + a * math.log(half) - math.lgamma(a))
    if half < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= half / k
            total += term
        return 1.0 - total * scale
    return scale * _fraction(
        lambda i: (half + 2 * i + 1 - a, -i * (i - a)) if i else (half + 1 - a, 1.0)
    )


def _fraction(term, limit: int = 100_000) -> float:
    """A continued fraction a0/(b0 + a1/(b1 + ...)) by the modified Lentz rule."""
    tiny = 1e-300
    f, c, d = tiny, tiny, 0.0
    for i in range(limit):
        b, a = term(i)
        d = 1.0 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return f


def beta_ratio(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_ratio(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a

    def term(i: int) -> tuple[float, float]:
        if i == 0:
            return 1.0, 1.0
        m = i // 2
        if i % 2:
            return 1.0, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1.0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    return front * _fraction(term)


def student_tail(t: float, dof: float) -> float:
    return 0.5 * beta_ratio(dof / (dof + t * t), dof / 2.0, 0.5)


def student_upper_point(tail: float, dof: float) -> float:
    """The t value with the given probability above it."""
    low, high = 0.0, 1.0
    while student_tail(high, dof) > tail:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if student_tail(mid, dof) > tail:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def grubbs_critical(n: int, alpha: float) -> float:
    t2 = student_upper_point(alpha / (2 * n), n - 2) ** 2
    return (n - 1) / math.sqrt(n) * math.sqrt(t2 / (n - 2 + t2))


EXACT_KOLMOGOROV_UP_TO = 10_000  # beyond, the expansion in 1 / sqrt(n) differs from the exact law by less than 1e-7


def kolmogorov_tail(d: float, n: int) -> float:
    """P(D_n > d) two-sided: one law for all n, computed exactly, by its expansion or, far out, by its tail."""
    s = d * d * n
    if s <= 0:
        return 1.0
    if s > 7.24 or (s > 3.76 and n > 99):
        return min(1.0, 2.0 * math.exp(-(2.000071 + 0.331 / math.sqrt(n) + 1.409 / n) * s))
    below = _kolmogorov_exact(d, n) if n <= EXACT_KOLMOGOROV_UP_TO else _kolmogorov_expansion(math.sqrt(s), n)
    return min(1.0, max(0.0, 1.0 - below))


def _kolmogorov_expansion(z: float, n: int) -> float:
    """Pelz and Good (1976): P(sqrt(n) D_n < z) to the order n**-1.5."""
    if z < 0.05:
        return 0.0
    pi2 = math.pi**2
    terms = math.ceil(6 * z) + 8
    odd = (np.arange(terms) + 0.5) ** 2  # (k + 1/2)^2
    whole = np.arange(1, terms + 1) ** 2.0  # k^2
    odd_power = np.exp(-odd * pi2 / (2 * z * z))
    whole_power = np.exp(-whole * pi2 / (2 * z * z))
    root = math.sqrt(math.pi / 2)
    order0 = 2 * root / z * odd_power.sum()
    order1 = root / (3 * z**4) * ((pi2 * odd - z**2) * odd_power).sum()
    order2 = root / (36 * z**7) * (
        (6 * z**6 + 2 * z**4 + pi2 * (2 * z**4 - 5 * z**2) * odd + pi2**2 * (1 - 2 * z**2) * odd**2) * odd_power
    ).sum() - root * pi2 / (18 * z**3) * (whole * whole_power).sum()
    order3 = root / (3240 * z**10) * (
        (
            pi2**3 * odd**3 * (5 - 30 * z**2) + pi2**2 * odd**2 * (-60 * z**2 + 212 * z**4)
            + pi2 * odd * (135 * z**4 - 96 * z**6) - 30 * z**6 - 90 * z**8
        ) * odd_power
    ).sum() + root * pi2 / (108 * z**6) * ((3 * z**2 - pi2 * whole) * whole * whole_power).sum()
    return float(order0 + order1 / math.sqrt(n) + order2 / n + order3 / n**1.5)


def _kolmogorov_exact(d: float, n: int) -> float:
    """Marsaglia, Tsang and Wang (2003): P(D_n < d) from the n-th power of a banded matrix."""
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    grid = np.subtract.outer(np.arange(m), np.arange(m))
    base = (grid >= -1).astype(float)
    powers = h ** np.arange(1, m + 1)
    base[:, 0] -= powers
    base[-1, :] -= powers[::-1]
    base[-1, 0] += max(2 * h - 1, 0.0) ** m
    factorial = np.cumprod(np.concatenate([[1.0], np.arange(1, m + 1, dtype=float)])) if m < 150 else None
    for offset in range(1, m + 1):
        on = grid + 1 == offset
        base[on] /= factorial[offset] if factorial is not None else math.exp(min(math.lgamma(offset + 1), 700.0))
    result, exponent = np.eye(m), 0
    square, square_exp = base, 0
    power = n
    while power:
        if power & 1:
            result, exponent = result @ square, exponent + square_exp
            result, exponent = _rescaled(result, exponent)
        power >>= 1
        if power:
            square, square_exp = square @ square, 2 * square_exp
            square, square_exp = _rescaled(square, square_exp)
    value = math.log(result[k - 1, k - 1]) + exponent * math.log(10.0) if result[k - 1, k - 1] > 0 else -math.inf
    return math.exp(min(0.0, value + math.lgamma(n + 1) - n * math.log(n)))


def _rescaled(matrix: np.ndarray, exponent: int) -> tuple[np.ndarray, int]:
    top = np.abs(matrix).max()
    if top > 1e100:
        return matrix * 1e-100, exponent + 100
    return matrix, exponent
