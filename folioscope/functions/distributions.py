"""Distribution functions in plain numpy and math: p-values of the statistics."""

from __future__ import annotations

import math


def _gamma_series(a: float, x: float) -> float:
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    b = x + 1 - a
    c, d = 1e300, 1 / b if b else 1e300
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b or 1e-300
        c = b + an / c or 1e-300
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    return 1 - _gamma_series(a, x) if x < a + 1 else _gamma_fraction(a, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of Fisher's F."""
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def normal_sf2(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: tables no likelier than the observed one."""
    n, r, k = a + b + c + d, a + b, a + c
    log = lambda x: math.lgamma(x + 1)
    p = lambda x: math.exp(log(r) - log(x) - log(r - x) + log(n - r) - log(k - x) - log(n - r - k + x) - log(n) + log(k) + log(n - k))
    seen = p(a)
    return min(1.0, sum(q for x in range(max(0, r + k - n), min(r, k) + 1) if (q := p(x)) <= seen * (1 + 1e-7)))


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and its p-value for 4 to 5000 values, by Royston's approximation (AS R94, whose coefficients these are)."""
    from statistics import NormalDist

    x = sorted(values)
    n = len(x)
    if not 4 <= n <= 5000 or x[0] == x[-1]:
        raise ValueError("needs 4 to 5000 values that aren't all equal")
    poly = lambda c, v: sum(k * v**i for i, k in enumerate(c))
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    total, u = sum(v * v for v in m), n**-0.5
    last = m[-1] / total**0.5 + poly((0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
    if n > 5:
        second = m[-2] / total**0.5 + poly((0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
        phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = [-last, -second, *(v / phi**0.5 for v in m[2:-2]), second, last]
    else:
        phi = (total - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = [-last, *(v / phi**0.5 for v in m[1:-1]), last]
    mean = math.fsum(x) / n
    w = min(1.0, math.fsum(p * q for p, q in zip(a, x, strict=True)) ** 2 / math.fsum((v - mean) ** 2 for v in x))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        y, mu, sigma = -math.log(0.459 * n - 2.273 - y), poly((0.5440, -0.39978, 0.025054, -0.0006714), n), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        mu, sigma = poly((-1.5861, -0.31082, -0.083751, 0.0038915), math.log(n)), math.exp(poly((-0.4803, -0.082676, 0.0030302), math.log(n)))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))
