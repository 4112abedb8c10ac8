"""Special functions by published algorithms, vectorised over numpy arrays."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
EULER = 0.5772156649015329


def lgamma(x):
    return _lgamma(x) if np.ndim(x) else math.lgamma(x)


def normal_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def normal_pdf(z):
    return np.exp(-0.5 * np.asarray(z, float) ** 2) / math.sqrt(2 * math.pi)


def normal_icdf(p):
    """Acklam's rational start and Newton steps on the better-conditioned tail."""
    p = np.asarray(p, float)
    q = np.minimum(p, 1 - p)
    with np.errstate(all="ignore"):
        t = np.sqrt(-2 * np.log(q))
        z = -(t - ((0.010328 * t + 0.802853) * t + 2.515517) / (((0.001308 * t + 0.189269) * t + 1.432788) * t + 1))
        for _ in range(4):
            e = normal_cdf(z) - q
            z = z - e / np.maximum(normal_pdf(z), 1e-300)
        z = np.where(p > 0.5, -z, z)
    z = np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, z))
    return np.where((p < 0) | (p > 1) | np.isnan(p), np.nan, np.where(p == 0.5, 0.0, z))


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: its series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - scale * h)


gamma_p = np.vectorize(_gamma_p, otypes=[float])


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + num / c
        c = c if abs(c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-16:
            break
    return front * (f - 1)


beta_i = np.vectorize(_beta_i, otypes=[float])


def bisect(f, lo: float, hi: float, rounds: int = 200) -> float:
    """A root of f in [lo, hi], at whose ends f has opposite signs."""
    a = f(lo)
    if a == 0:
        return lo
    if f(hi) * a > 0:
        raise RuntimeError("no change of sign between the ends")
    for _ in range(rounds):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        v = f(mid)
        if v == 0:
            return mid
        lo, hi = (mid, hi) if v * a > 0 else (lo, mid)
    return 0.5 * (lo + hi)


def minimize(f, start: list[float], scale: list[float] | None = None, rounds: int = 4000, close: float = 1e-12) -> np.ndarray:
    """Nelder and Mead's simplex search, restarted once from what it found."""
    x = np.array(start, float)
    for _ in range(3):
        n = len(x)
        step = np.array(scale if scale is not None else np.where(x != 0, 0.05 * np.abs(x), 0.00025))
        points = np.vstack([x] + [x + step * (np.arange(n) == i) for i in range(n)])
        values = np.array([f(p) for p in points])
        for _ in range(rounds):
            order = np.argsort(values)
            points, values = points[order], values[order]
            if values[-1] - values[0] <= close * (abs(values[0]) + close):
                break
            centre = points[:-1].mean(axis=0)
            reflected = 2 * centre - points[-1]
            v = f(reflected)
            if v < values[0]:
                further = 3 * centre - 2 * points[-1]
                w = f(further)
                points[-1], values[-1] = (further, w) if w < v else (reflected, v)
            elif v < values[-2]:
                points[-1], values[-1] = reflected, v
            else:
                inner = 0.5 * (centre + (reflected if v < values[-1] else points[-1]))
                w = f(inner)
                if w < min(v, values[-1]):
                    points[-1], values[-1] = inner, w
                else:
                    points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                    values[1:] = [f(p) for p in points[1:]]
        x, scale = points[0], None
    return x
