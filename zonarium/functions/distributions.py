"""Parametric distributions made from parameters (PAR), moments (MOM) or samples (DATA), and fits as aggregates.

A family is a class with its parameters' names, the three ways to make it, and its functions. Families with a closed
quantile function say so; the others search for it by bisection on their cdf.
"""

from __future__ import annotations

import gzip
import json
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonarium.functions import special as S
from zonarium.functions.empirical import EmpDigest, EmpDist, from_row

_TINY = 1e-300


def _need(ok: bool, text: str) -> None:
    if not ok:
        raise RuntimeError(text)


def _sample(val) -> np.ndarray:
    x = np.asarray(val, float).ravel()
    x = x[~np.isnan(x)]
    _need(len(x) > 0, "no samples")
    return x


class Family:
    parameters: tuple[str, ...] = ()
    discrete = False
    #: Where the density is positive.
    support = (-math.inf, math.inf)

    def __init__(self, *values: float) -> None:
        for n, v in zip(self.parameters, values, strict=True):
            setattr(self, n, float(v))
        self.check()

    def check(self) -> None:
        pass

    def par(self) -> dict[str, float]:
        return {n: getattr(self, n) for n in self.parameters}

    @classmethod
    def of_parameters(cls, val):
        return cls(*np.atleast_1d(val)[: len(cls.parameters)])

    @classmethod
    def of_moments(cls, val):
        raise RuntimeError(f"{cls.__name__.lower()} is not made from moments")

    @classmethod
    def of_data(cls, val):
        raise RuntimeError(f"{cls.__name__.lower()} is not fitted to data")

    def limits(self) -> tuple[float, float]:
        return self.support

    def icdf(self, y):
        lo, hi = self.limits()
        m, s = self.mean(), self.std()
        m, s = (m, s) if math.isfinite(m) and math.isfinite(s) and s > 0 else (0.0, 1.0)

        p = np.asarray(y, float)
        flat = p.ravel()
        x = np.full(len(flat), math.nan)
        x[flat == 0], x[flat == 1] = lo, hi
        at = np.flatnonzero((flat > 0) & (flat < 1))
        a, b, now = np.full(len(at), lo), np.full(len(at), hi), np.full(len(at), min(max(m, lo), hi))
        step = s
        # Newton's steps, held within what is known to lie below and above; open ends are searched by doubling.
        for _ in range(400):
            if not len(at):
                break
            gap = self.cdf(now) - flat[at]
            a, b = np.where(gap < 0, now, a), np.where(gap >= 0, now, b)
            with np.errstate(all="ignore"):
                new = now - gap / self.pdf(now)
                middle = np.where(np.isfinite(a) & np.isfinite(b), 0.5 * (a + b), np.where(np.isfinite(a), a + step, b - step))
                new = np.where((new > a) & (new < b) & (np.abs(new - now) < np.where(np.isfinite(b - a), 0.5 * (b - a), step)), new, middle)
            step *= 2
            x[at] = now
            done = (np.abs(gap) < 1e-15) | (new == now) | (b - a <= 4e-16 * np.abs(now))
            x[at[~done]] = new[~done]
            at, a, b, now = at[~done], a[~done], b[~done], new[~done]
        return x.reshape(p.shape)

    def logpdf_sum(self, x: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            return float(np.log(np.maximum(self.pdf(x), _TINY)).sum())


class Discrete(Family):
    discrete = True
    first = 0

    def pmf(self, k):
        raise NotImplementedError

    def pdf(self, x):
        x = np.asarray(x, float)
        k = np.floor(x)
        with np.errstate(all="ignore"):
            return np.where((k == x) & (x >= self.first), self.pmf(np.maximum(k, self.first)), 0.0)

    def icdf(self, y):
        """The least whole number whose cdf reaches y; one below the first at 0."""
        p = np.asarray(y, float)
        inner = p[(p > 0) & (p < 1)]
        first, top = int(self.first), self.limits()[1]
        hi = first
        while inner.size and float(self.cdf(hi)) < inner.max() and hi < top:
            hi = int(min(2 * hi + 1 - first, top))
        lo, up = np.full(p.shape, first - 1), np.full(p.shape, hi)
        while (up - lo > 1).any():
            middle = (lo + up) // 2
            reached = self.cdf(middle) >= p
            lo, up = np.where(reached, lo, np.maximum(middle, lo)), np.where(reached, middle, up)
            up = np.maximum(up, lo + 1)
        out = np.where(p == 0, first - 1, np.where(p == 1, top, up.astype(float)))
        return np.where((p < 0) | (p > 1) | np.isnan(p), math.nan, out)


class Normal(Family):
    parameters = ("mu", "sigma")

    def check(self):
        _need(self.sigma > 0, "normal: sigma must be positive")

    @classmethod
    def of_moments(cls, val):
        return cls(val[0], val[1])

    @classmethod
    def of_data(cls, val):
        x = _sample(val)
        return cls(x.mean(), x.std())

    def mean(self):
        return self.mu

    def std(self):
        return self.sigma

    def pdf(self, x):
        return S.normal_pdf((np.asarray(x, float) - self.mu) / self.sigma) / self.sigma

    def cdf(self, x):
        return S.normal_cdf((np.asarray(x, float) - self.mu) / self.sigma)

    def icdf(self, y):
        return self.mu + self.sigma * S.normal_icdf(y)


class StandardNormal(Normal):
    @classmethod
    def of_parameters(cls, val):
        return cls(0, 1)

    @classmethod
    def of_moments(cls, val):
        return cls(0, 1)

    @classmethod
    def of_data(cls, val):
        raise RuntimeError("standardnormal is not fitted to data")


class Lognormal(Family):
    parameters = ("mu_lnx", "sig_lnx")
    support = (0.0, math.inf)

    def check(self):
        _need(self.sig_lnx > 0, "lognormal: sigma must be positive")

    @classmethod
    def of_moments(cls, val):
        _need(val[0] > 0, "lognormal: the mean must be positive")
        s2 = math.log1p((val[1] / val[0]) ** 2)
        return cls(math.log(val[0]) - s2 / 2, math.sqrt(s2))

    @classmethod
    def of_data(cls, val):
        x = np.log(_sample(val))
        return cls(x.mean(), x.std())

    def mean(self):
        return math.exp(self.mu_lnx + self.sig_lnx**2 / 2)

    def std(self):
        return self.mean() * math.sqrt(math.expm1(self.sig_lnx**2))

    def _z(self, x):
        with np.errstate(all="ignore"):
            return (np.log(np.maximum(x, 0)) - self.mu_lnx) / self.sig_lnx

    def pdf(self, x):
        x = np.asarray(x, float)
        return np.where(x > 0, S.normal_pdf(self._z(x)) / (self.sig_lnx * np.where(x > 0, x, 1)), 0.0)

    def cdf(self, x):
        x = np.asarray(x, float)
        return np.where(x > 0, S.normal_cdf(np.where(x > 0, self._z(x), 0)), 0.0)

    def icdf(self, y):
        return np.exp(self.mu_lnx + self.sig_lnx * S.normal_icdf(y))


class Exponential(Family):
    parameters = ("lambda",)
    support = (0.0, math.inf)

    def check(self):
        self.rate = getattr(self, "lambda")
        _need(self.rate > 0, "exponential: lambda must be positive")

    @classmethod
    def of_moments(cls, val):
        m = np.atleast_1d(val)[0]
        _need(m > 0, "exponential: the mean must be positive")
        return cls(1 / m)

    @classmethod
    def of_data(cls, val):
        return cls(1 / _sample(val).mean())

    def mean(self):
        return 1 / self.rate

    std = mean

    def pdf(self, x):
        x = np.asarray(x, float)
        return np.where(x >= 0, self.rate * np.exp(-self.rate * np.maximum(x, 0)), 0.0)

    def cdf(self, x):
        return -np.expm1(-self.rate * np.maximum(np.asarray(x, float), 0))

    def icdf(self, y):
        return -np.log1p(-np.asarray(y, float)) / self.rate


class Uniform(Family):
    parameters = ("lower", "upper")

    def check(self):
        _need(self.upper > self.lower, "uniform: upper must exceed lower")

    @classmethod
    def of_moments(cls, val):
        h = math.sqrt(3) * val[1]
        return cls(val[0] - h, val[0] + h)

    @classmethod
    def of_data(cls, val):
        x = _sample(val)
        return cls(x.min(), x.max())

    def limits(self):
        return self.lower, self.upper

    def mean(self):
        return (self.lower + self.upper) / 2

    def std(self):
        return (self.upper - self.lower) / math.sqrt(12)

    def pdf(self, x):
        x = np.asarray(x, float)
        return np.where((x >= self.lower) & (x <= self.upper), 1 / (self.upper - self.lower), 0.0)

    def cdf(self, x):
        return np.clip((np.asarray(x, float) - self.lower) / (self.upper - self.lower), 0, 1)

    def icdf(self, y):
        return self.lower + np.asarray(y, float) * (self.upper - self.lower)


class Gamma(Family):
    parameters = ("lambda", "k")
    support = (0.0, math.inf)

    def check(self):
        self.rate = getattr(self, "lambda")
        _need(self.rate > 0 and self.k > 0, "gamma: lambda and k must be positive")

    @classmethod
    def of_moments(cls, val):
        return cls(val[0] / val[1] ** 2, val[0] ** 2 / val[1] ** 2)

    @classmethod
    def of_data(cls, val):
        x = _sample(val)
        return cls.of_sums(x.mean(), np.log(x).mean())

    @classmethod
    def of_sums(cls, mean: float, mean_log: float):
        """The likelihood's maximum needs only the mean and the mean logarithm."""
        s = math.log(mean) - mean_log
        k = S.bisect(lambda t: math.log(math.exp(t)) - S.digamma(math.exp(t)) - s, -20.0, 30.0)
        return cls(math.exp(k) / mean, math.exp(k))

    def mean(self):
        return self.k / self.rate

    def std(self):
        return math.sqrt(self.k) / self.rate

    def pdf(self, x):
        x = np.asarray(x, float)
        z = np.where(x > 0, x, 1.0)
        return np.where(x > 0, np.exp(self.k * math.log(self.rate) + (self.k - 1) * np.log(z) - self.rate * z - math.lgamma(self.k)), 0.0)

    def cdf(self, x):
        return S.gamma_p(self.k, self.rate * np.maximum(np.asarray(x, float), 0))


class ChiSquare(Gamma):
    parameters = ("k",)

    def check(self):
        self.degrees = self.k
        _need(self.k > 0, "chisquare: k must be positive")

    def par(self):
        return {"k": self.degrees}

    @classmethod
    def of_parameters(cls, val):
        k = float(np.atleast_1d(val)[0])
        _need(k > 0 and k == round(k), "chisquare: k must be a positive integer")
        return cls(k)

    @classmethod
    def of_moments(cls, val):
        return cls(max(1, round(float(np.atleast_1d(val)[0]))))

    @classmethod
    def of_data(cls, val):
        m = np.log(_sample(val)).mean()
        return cls(max(1, round(2 * math.exp(S.bisect(lambda t: S.digamma(math.exp(t)) + math.log(2) - m, -10.0, 20.0)))))

    def mean(self):
        return self.degrees

    def std(self):
        return math.sqrt(2 * self.degrees)

    def pdf(self, x):
        return Gamma(0.5, self.degrees / 2).pdf(x)

    def cdf(self, x):
        return Gamma(0.5, self.degrees / 2).cdf(x)


class Beta(Family):
    parameters = ("r", "s", "a", "b")

    def check(self):
        _need(self.r > 0 and self.s > 0 and self.b > self.a, "beta: r and s must be positive and b exceed a")

    @classmethod
    def of_moments(cls, val):
        m, sd, a, b = (*val, 0, 1)[:4] if len(val) < 4 else val[:4]
        r = ((b - m) * (m - a) / sd**2 - 1) * (m - a) / (b - a)
        s = r * (b - m) / (m - a)
        _need(r > 0 and s > 0, "beta: no parameters have these moments")
        return cls(r, s, a, b)

    @classmethod
    def of_data(cls, val):
        x, a, b = val
        z = (_sample(x) - a) / (b - a)
        _need(((z > 0) & (z < 1)).all(), "beta: samples must lie within its support")
        g, h = np.log(z).mean(), np.log1p(-z).mean()
        m, v = z.mean(), z.var()
        t = max(m * (1 - m) / v - 1, 0.1) if v > 0 else 1.0
        best = S.minimize(lambda p: math.lgamma(math.exp(p[0])) + math.lgamma(math.exp(p[1])) - math.lgamma(math.exp(p[0]) + math.exp(p[1])) - (math.exp(p[0]) - 1) * g - (math.exp(p[1]) - 1) * h if max(abs(p)) < 50 else math.inf, [math.log(m * t), math.log((1 - m) * t)], [0.1, 0.1])
        return cls(math.exp(best[0]), math.exp(best[1]), a, b)

    def limits(self):
        return self.a, self.b

    def mean(self):
        return self.a + (self.b - self.a) * self.r / (self.r + self.s)

    def std(self):
        t = self.r + self.s
        return (self.b - self.a) / t * math.sqrt(self.r * self.s / (t + 1))

    def pdf(self, x):
        z = (np.asarray(x, float) - self.a) / (self.b - self.a)
        inside = (z > 0) & (z < 1)
        y = np.where(inside, z, 0.5)
        c = math.lgamma(self.r + self.s) - math.lgamma(self.r) - math.lgamma(self.s)
        return np.where(inside, np.exp(c + (self.r - 1) * np.log(y) + (self.s - 1) * np.log1p(-y)) / (self.b - self.a), 0.0)

    def cdf(self, x):
        return S.beta_i(self.r, self.s, np.clip((np.asarray(x, float) - self.a) / (self.b - self.a), 0, 1))


class GEV(Family):
    """Largest extremes: beta is the shape, alpha the scale, epsilon the location."""

    parameters = ("beta", "alpha", "epsilon")

    def check(self):
        _need(self.alpha > 0, "gev: alpha must be positive")

    @classmethod
    def of_moments(cls, val):
        m, sd, beta = float(val[0]), float(val[1]), float(val[2])
        if beta == 0:
            alpha = sd * math.sqrt(6) / math.pi
            return cls(0, alpha, m - S.EULER * alpha)
        _need(beta < 0.5, "gev: the shape must be below 0.5 for the moments to exist")
        g1, g2 = math.gamma(1 - beta), math.gamma(1 - 2 * beta)
        alpha = sd * abs(beta) / math.sqrt(g2 - g1 * g1)
        return cls(beta, alpha, m - alpha / beta * (g1 - 1))

    @classmethod
    def of_data(cls, val):
        x = np.sort(_sample(val))
        n = len(x)
        _need(n > 3 and x[-1] > x[0], "gev: too few different samples")
        return cls._of_pwm(x, *(float((x * w).mean()) for w in (np.ones(n), np.arange(n) / (n - 1), np.arange(n) * (np.arange(n) - 1) / ((n - 1) * (n - 2)))))

    @classmethod
    def _of_pwm(cls, x, b0, b1, b2):
        """Probability-weighted moments (Hosking et al., 1985) as the start of the likelihood's search."""
        c = (2 * b1 - b0) / (3 * b2 - b0) - math.log(2) / math.log(3)
        k = 7.859 * c + 2.9554 * c * c
        k = k if abs(k) > 1e-6 else 1e-6
        alpha = (2 * b1 - b0) * k / (math.gamma(1 + k) * (1 - 2**-k))
        start = [-k, alpha, b0 + alpha * (math.gamma(1 + k) - 1) / k]

        def loss(p):
            if p[1] <= 0:
                return math.inf
            z = (x - p[2]) / p[1]
            if abs(p[0]) < 1e-9:
                return len(x) * math.log(p[1]) + float((z + np.exp(-np.clip(z, -700, None))).sum())
            t = 1 + p[0] * z
            if (t <= 0).any():
                return math.inf
            lt = np.log(t)
            return len(x) * math.log(p[1]) + float(((1 + 1 / p[0]) * lt + np.exp(np.clip(-lt / p[0], None, 700))).sum())

        if not math.isfinite(loss(start)):
            start = [0.05, float(x.std()) * 0.78, float(x.mean()) - 0.45 * float(x.std())]
            start = start if math.isfinite(loss(start)) else [1e-10, *start[1:]]
        best = S.minimize(loss, start, [0.05, 0.1 * abs(start[1]), 0.1 * abs(start[1])])
        _need(math.isfinite(loss(best)), "gev: the fit did not settle")
        return cls(*best)

    def limits(self):
        edge = self.epsilon - self.alpha / self.beta if self.beta else 0.0
        return (edge, math.inf) if self.beta > 0 else (-math.inf, edge) if self.beta < 0 else (-math.inf, math.inf)

    def mean(self):
        if not self.beta:
            return self.epsilon + S.EULER * self.alpha
        return self.epsilon + self.alpha * (math.gamma(1 - self.beta) - 1) / self.beta if self.beta < 1 else math.inf

    def std(self):
        if not self.beta:
            return self.alpha * math.pi / math.sqrt(6)
        if self.beta >= 0.5:
            return math.inf
        return self.alpha / abs(self.beta) * math.sqrt(math.gamma(1 - 2 * self.beta) - math.gamma(1 - self.beta) ** 2)

    def _t(self, x):
        z = (np.asarray(x, float) - self.epsilon) / self.alpha
        with np.errstate(all="ignore"):
            if not self.beta:
                return np.exp(-z)
            base = 1 + self.beta * z
            return np.where(base > 0, np.where(base > 0, base, 1.0) ** (-1 / self.beta), math.inf if self.beta > 0 else 0.0)

    def pdf(self, x):
        t = self._t(x)
        with np.errstate(all="ignore"):
            return np.where(np.isfinite(t) & (t > 0), np.where(np.isfinite(t), t, 0) ** (self.beta + 1) * np.exp(-t) / self.alpha, 0.0)

    def cdf(self, x):
        return np.exp(-self._t(x))

    def icdf(self, y):
        with np.errstate(all="ignore"):
            t = -np.log(np.asarray(y, float))
            return self.epsilon + self.alpha * ((t**-self.beta - 1) / self.beta if self.beta else -np.log(t))


class Gumbel(GEV):
    parameters = ("a_n", "b_n")

    def check(self):
        _need(self.a_n > 0, "gumbel: a_n must be positive")
        self.beta, self.alpha, self.epsilon = 0.0, self.a_n, self.b_n

    @classmethod
    def of_moments(cls, val):
        a = val[1] * math.sqrt(6) / math.pi
        return cls(a, val[0] - S.EULER * a)

    @classmethod
    def of_data(cls, val):
        x = _sample(val)
        low, m, s = x.min(), x.mean(), x.std()
        _need(s > 0, "gumbel: the samples are equal")

        def equation(a):
            w = np.exp(-(x - low) / a)
            return a - m + float((x * w).sum() / w.sum())

        a = S.bisect(equation, s * 1e-3, s * 100)
        return cls(a, low - a * math.log(float(np.exp(-(x - low) / a).mean())))


class _Mirrored(Family):
    """The distribution of minus a variable of another family."""

    inner_class: type = GEV

    @property
    def inner(self):
        return self.inner_class(*self._inner_values())

    def _inner_values(self):
        *rest, location = (getattr(self, n) for n in self.parameters)
        return (*rest, -location)

    @classmethod
    def _mirror(cls, inner):
        *rest, location = inner.par().values()
        return cls(*rest, -location)

    @classmethod
    def of_moments(cls, val):
        return cls._mirror(cls.inner_class.of_moments([-val[0], *val[1:]]))

    @classmethod
    def of_data(cls, val):
        return cls._mirror(cls.inner_class.of_data(-_sample(val)))

    def check(self):
        self._inner = self.inner

    def limits(self):
        lo, hi = self._inner.limits()
        return -hi, -lo

    def mean(self):
        return -self._inner.mean()

    def std(self):
        return self._inner.std()

    def pdf(self, x):
        return self._inner.pdf(-np.asarray(x, float))

    def cdf(self, x):
        return 1 - self._inner.cdf(-np.asarray(x, float))

    def icdf(self, y):
        return -self._inner.icdf(1 - np.asarray(y, float))


class GEVMin(_Mirrored):
    parameters = GEV.parameters


class GumbelMin(_Mirrored):
    parameters, inner_class = Gumbel.parameters, Gumbel


class Weibull(Family):
    parameters = ("a_n", "k")
    support = (0.0, math.inf)

    def check(self):
        _need(self.a_n > 0 and self.k > 0, "weibull: a_n and k must be positive")

    @classmethod
    def _ratio(cls, k):
        return math.exp(math.lgamma(1 + 2 / k) - 2 * math.lgamma(1 + 1 / k)) - 1

    @classmethod
    def of_moments(cls, val):
        k = S.bisect(lambda t: cls._ratio(math.exp(t)) - (val[1] / val[0]) ** 2, math.log(0.05), math.log(1e4))
        k = math.exp(k)
        return cls(val[0] / math.gamma(1 + 1 / k), k)

    @classmethod
    def of_data(cls, val):
        x = _sample(val)
        top = x.max()
        z = x / top
        lg = np.log(z)

        def equation(t):
            w = z ** math.exp(t)
            return float((w * lg).sum() / w.sum()) - math.exp(-t) - lg.mean()

        k = math.exp(S.bisect(equation, -7.0, 9.0))
        return cls(top * float((z**k).mean()) ** (1 / k), k)

    def mean(self):
        return self.a_n * math.gamma(1 + 1 / self.k)

    def std(self):
        return self.mean() * math.sqrt(self._ratio(self.k))

    def pdf(self, x):
        x = np.asarray(x, float)
        z = np.where(x > 0, x, 1.0) / self.a_n
        return np.where(x > 0, self.k / self.a_n * z ** (self.k - 1) * np.exp(-(z**self.k)), 0.0)

    def cdf(self, x):
        return -np.expm1(-((np.maximum(np.asarray(x, float), 0) / self.a_n) ** self.k))

    def icdf(self, y):
        return self.a_n * (-np.log1p(-np.asarray(y, float))) ** (1 / self.k)


class Frechet(Family):
    parameters = ("a_n", "k")
    support = (0.0, math.inf)

    def check(self):
        _need(self.a_n > 0 and self.k > 0, "frechet: a_n and k must be positive")

    @classmethod
    def of_moments(cls, val):
        r = (val[1] / val[0]) ** 2
        k = S.bisect(lambda k: math.exp(math.lgamma(1 - 2 / k) - 2 * math.lgamma(1 - 1 / k)) - 1 - r, 2 + 1e-9, 1e4)
        return cls(val[0] / math.gamma(1 - 1 / k), k)

    @classmethod
    def of_data(cls, val):
        w = Weibull.of_data(1 / _sample(val))
        return cls(1 / w.a_n, w.k)

    def mean(self):
        return self.a_n * math.gamma(1 - 1 / self.k) if self.k > 1 else math.inf

    def std(self):
        return self.a_n * math.sqrt(math.gamma(1 - 2 / self.k) - math.gamma(1 - 1 / self.k) ** 2) if self.k > 2 else math.inf

    def pdf(self, x):
        x = np.asarray(x, float)
        z = np.where(x > 0, x, 1.0) / self.a_n
        with np.errstate(all="ignore"):
            return np.where(x > 0, self.k / self.a_n * z ** (-self.k - 1) * np.exp(-(z**-self.k)), 0.0)

    def cdf(self, x):
        x = np.asarray(x, float)
        with np.errstate(all="ignore"):
            return np.where(x > 0, np.exp(-((np.where(x > 0, x, 1.0) / self.a_n) ** -self.k)), 0.0)

    def icdf(self, y):
        with np.errstate(all="ignore"):
            return self.a_n * (-np.log(np.asarray(y, float))) ** (-1 / self.k)


class Pareto(Family):
    parameters = ("x_m", "alpha")

    def check(self):
        _need(self.x_m > 0 and self.alpha > 0, "pareto: x_m and alpha must be positive")

    @classmethod
    def of_moments(cls, val):
        a = 1 + math.sqrt(1 + (val[0] / val[1]) ** 2)
        return cls(val[0] * (a - 1) / a, a)

    @classmethod
    def of_data(cls, val):
        x = _sample(val)
        _need(x.min() > 0, "pareto: samples must be positive")
        return cls(x.min(), len(x) / np.log(x / x.min()).sum())

    def limits(self):
        return self.x_m, math.inf

    def mean(self):
        return self.alpha * self.x_m / (self.alpha - 1) if self.alpha > 1 else math.inf

    def std(self):
        return self.x_m / (self.alpha - 1) * math.sqrt(self.alpha / (self.alpha - 2)) if self.alpha > 2 else math.inf

    def pdf(self, x):
        x = np.asarray(x, float)
        return np.where(x >= self.x_m, self.alpha / self.x_m * (np.maximum(x, self.x_m) / self.x_m) ** (-self.alpha - 1), 0.0)

    def cdf(self, x):
        return 1 - (np.maximum(np.asarray(x, float), self.x_m) / self.x_m) ** -self.alpha

    def icdf(self, y):
        with np.errstate(all="ignore"):
            return self.x_m * (1 - np.asarray(y, float)) ** (-1 / self.alpha)


class Rayleigh(Family):
    parameters = ("alpha",)
    support = (0.0, math.inf)

    def check(self):
        _need(self.alpha > 0, "rayleigh: alpha must be positive")

    @classmethod
    def of_moments(cls, val):
        return cls(np.atleast_1d(val)[0] / math.sqrt(math.pi / 2))

    @classmethod
    def of_data(cls, val):
        x = _sample(val)
        return cls(math.sqrt((x * x).mean() / 2))

    def mean(self):
        return self.alpha * math.sqrt(math.pi / 2)

    def std(self):
        return self.alpha * math.sqrt(2 - math.pi / 2)

    def pdf(self, x):
        x = np.maximum(np.asarray(x, float), 0)
        return x / self.alpha**2 * np.exp(-0.5 * (x / self.alpha) ** 2)

    def cdf(self, x):
        return -np.expm1(-0.5 * (np.maximum(np.asarray(x, float), 0) / self.alpha) ** 2)

    def icdf(self, y):
        return self.alpha * np.sqrt(-2 * np.log1p(-np.asarray(y, float)))


class TruncatedNormal(Family):
    parameters = ("mu_n", "sig_n", "a", "b")

    def check(self):
        _need(self.sig_n > 0 and self.b > self.a, "truncatednormal: sigma must be positive and b exceed a")
        self._n = Normal(self.mu_n, self.sig_n)
        self._lo, self._hi = float(self._n.cdf(self.a)), float(self._n.cdf(self.b))
        _need(self._hi > self._lo, "truncatednormal: nothing lies between a and b")

    @classmethod
    def _matched(cls, m, sd, a, b, loss):
        def f(p):
            try:
                return loss(cls(p[0], math.exp(p[1]), a, b))
            except (RuntimeError, OverflowError, ValueError):
                return math.inf

        best = S.minimize(f, [m, math.log(sd)], [0.2 * sd, 0.2])
        return cls(best[0], math.exp(best[1]), a, b)

    @classmethod
    def of_moments(cls, val):
        m, sd, a, b = val
        out = cls._matched(m, sd, a, b, lambda d: ((d.mean() - m) / sd) ** 2 + (d.std() / sd - 1) ** 2)
        _need(abs(out.mean() - m) < 1e-4 * sd and abs(out.std() / sd - 1) < 1e-4, "truncatednormal: no parameters have these moments")
        return out

    @classmethod
    def of_data(cls, val):
        x, a, b = val
        x = _sample(x)
        _need(x.min() >= a and x.max() <= b, "truncatednormal: samples must lie between a and b")
        return cls._matched(x.mean(), max(x.std(), 1e-12), a, b, lambda d: -d.logpdf_sum(x) / len(x))

    def limits(self):
        return self.a, self.b

    def _edges(self):
        z = (np.array([self.a, self.b]) - self.mu_n) / self.sig_n
        return z, S.normal_pdf(z), self._hi - self._lo

    def mean(self):
        _, p, mass = self._edges()
        return self.mu_n + self.sig_n * (p[0] - p[1]) / mass

    def std(self):
        z, p, mass = self._edges()
        zp = np.where(np.isfinite(z), z, 0) * p
        return self.sig_n * math.sqrt(max(0.0, 1 + (zp[0] - zp[1]) / mass - ((p[0] - p[1]) / mass) ** 2))

    def pdf(self, x):
        x = np.asarray(x, float)
        return np.where((x >= self.a) & (x <= self.b), self._n.pdf(x) / (self._hi - self._lo), 0.0)

    def cdf(self, x):
        return np.clip((self._n.cdf(np.clip(x, self.a, self.b)) - self._lo) / (self._hi - self._lo), 0, 1)

    def icdf(self, y):
        return np.clip(self._n.icdf(self._lo + np.asarray(y, float) * (self._hi - self._lo)), self.a, self.b)


class Binomial(Discrete):
    parameters = ("n", "p")

    def check(self):
        _need(self.n == round(self.n) and self.n > 0 and 0 <= self.p <= 1, "binomial: n must be a positive integer and p a share")

    @classmethod
    def of_moments(cls, val):
        p = 1 - val[1] ** 2 / val[0]
        n = round(val[0] / p) if p > 0 else 0
        _need(n > 0, "binomial: no parameters have these moments")
        return cls(n, val[0] / n)

    @classmethod
    def of_data(cls, val):
        x, n = val
        return cls(n, _sample(x).mean() / n)

    def limits(self):
        return 0, self.n

    def mean(self):
        return self.n * self.p

    def std(self):
        return math.sqrt(self.n * self.p * (1 - self.p))

    def pmf(self, k):
        inside = k <= self.n
        k = np.minimum(k, self.n)
        if self.p in (0.0, 1.0):
            return np.where(k == self.n * self.p, 1.0, 0.0)
        return np.where(inside, np.exp(math.lgamma(self.n + 1) - S._lgamma(k + 1) - S._lgamma(self.n - k + 1) + k * math.log(self.p) + (self.n - k) * math.log1p(-self.p)), 0.0)

    def cdf(self, x):
        k = np.floor(np.asarray(x, float))
        inner = np.clip(k, 0, self.n - 1)
        return np.where(k < 0, 0.0, np.where(k >= self.n, 1.0, S.beta_i(self.n - inner, inner + 1, 1 - self.p)))


class Geometric(Discrete):
    parameters = ("p",)
    first = 1

    def check(self):
        _need(0 < self.p <= 1, "geometric: p must be in (0, 1]")

    @classmethod
    def of_moments(cls, val):
        return cls(1 / np.atleast_1d(val)[0])

    of_data = classmethod(lambda cls, val: cls(1 / _sample(val).mean()))

    def limits(self):
        return 1, math.inf

    def mean(self):
        return 1 / self.p

    def std(self):
        return math.sqrt(1 - self.p) / self.p

    def pmf(self, k):
        return self.p * (1 - self.p) ** (k - 1)

    def cdf(self, x):
        return 1 - (1 - self.p) ** np.maximum(np.floor(np.asarray(x, float)), 0)


class NegativeBinomial(Discrete):
    """The number of trials up to the k-th success."""

    parameters = ("k", "p")

    def check(self):
        _need(self.k == round(self.k) and self.k > 0 and 0 < self.p <= 1, "negativebinomial: k must be a positive integer and p in (0, 1]")
        self.first = int(self.k)

    @classmethod
    def of_moments(cls, val):
        p = val[0] / (val[0] + val[1] ** 2)
        k = round(val[0] * p)
        _need(k > 0, "negativebinomial: no parameters have these moments")
        return cls(k, k / val[0])

    @classmethod
    def of_data(cls, val):
        x = _sample(val)
        return cls.of_moments([x.mean(), x.std()])

    def limits(self):
        return self.k, math.inf

    def mean(self):
        return self.k / self.p

    def std(self):
        return math.sqrt(self.k * (1 - self.p)) / self.p

    def pmf(self, x):
        if self.p == 1:
            return np.where(x == self.k, 1.0, 0.0)
        return np.exp(S._lgamma(x) - math.lgamma(self.k) - S._lgamma(x - self.k + 1) + self.k * math.log(self.p) + (x - self.k) * math.log1p(-self.p))

    def cdf(self, x):
        n = np.floor(np.asarray(x, float)) - self.k
        return np.where(n < 0, 0.0, S.beta_i(self.k, np.maximum(n, 0) + 1, self.p))


class Poisson(Discrete):
    parameters = ("lambda",)

    def check(self):
        self.rate = getattr(self, "lambda")
        _need(self.rate > 0, "poisson: lambda must be positive")

    def par(self):
        return {"v": self.v, "t": self.t} if hasattr(self, "t") else {"lambda": self.rate}

    @classmethod
    def _timed(cls, v, t):
        _need(t > 0, "poisson: t must be positive")
        out = cls(v * t)
        out.v, out.t = float(v), float(t)
        return out

    @classmethod
    def of_parameters(cls, val):
        val = np.atleast_1d(val)
        return cls._timed(*val) if len(val) == 2 else cls(val[0])

    @classmethod
    def of_moments(cls, val):
        val = np.atleast_1d(val)
        return cls._timed(val[0] / val[1], val[1]) if len(val) == 2 else cls(val[0])

    @classmethod
    def of_data(cls, val):
        if isinstance(val, (list, tuple)) and len(val) == 2 and np.ndim(val[0]) == 1:
            return cls._timed(_sample(val[0]).mean() / val[1], val[1])
        return cls(_sample(val).mean())

    def limits(self):
        return 0, math.inf

    def mean(self):
        return self.rate

    def std(self):
        return math.sqrt(self.rate)

    def pmf(self, k):
        return np.exp(k * math.log(self.rate) - self.rate - S._lgamma(k + 1))

    def cdf(self, x):
        k = np.floor(np.asarray(x, float))
        return np.where(k < 0, 0.0, 1 - S.gamma_p(np.maximum(k, 0) + 1, self.rate))


FAMILIES: dict[str, type[Family]] = {c.__name__.lower(): c for c in (Beta, Binomial, ChiSquare, Exponential, Frechet, Gamma, Geometric, GEV, GEVMin, Gumbel, GumbelMin, Lognormal, NegativeBinomial, Normal, Pareto, Poisson, Rayleigh, StandardNormal, TruncatedNormal, Uniform, Weibull)}
ALIASES = {"gaussian": "normal", "standardgaussian": "standardnormal"}


class Distribution:
    """name: a family or `empirical` / `empiricaldigest`; opt: PAR, MOM or DATA; val: what opt needs."""

    def __init__(self, name: str, opt: str, val, ID=False) -> None:
        self.name, self.ID = ALIASES.get(name.lower(), name.lower()), ID
        opt = opt.upper()
        if opt not in ("PAR", "MOM", "DATA"):
            raise RuntimeError(f"unknown way {opt!r} to make a distribution")
        if self.name in ("empirical", "empiricaldigest"):
            _need(opt == "DATA", f"{name} is made from data")
            if self.name == "empirical":
                x, w, method, points, kw = (*val, *[None, "kde", None, {}][len(val) - 1 :])
                self.dist = EmpDist(x, w, method or "kde", points, **(kw or {}))
            else:
                x, w, n, mode, eps, method, points, kw = (*val, *[None, 1000, "densityFocused", None, "kde", None, {}][len(val) - 1 :])
                self.dist = EmpDigest(x, w, n, mode or "densityFocused", eps, method or "kde", points, **(kw or {}))
            return
        if self.name not in FAMILIES:
            raise RuntimeError(f"unknown distribution {name!r}")
        if opt == "MOM" and np.size(val) > 1 and self.name not in ("poisson",) and float(val[1]) < 0:
            raise RuntimeError("the standard deviation must not be negative")
        make = {"PAR": "of_parameters", "MOM": "of_moments", "DATA": "of_data"}[opt]
        try:
            self.dist = getattr(FAMILIES[self.name], make)(val)
        except (ZeroDivisionError, IndexError, TypeError, ValueError, OverflowError) as e:
            raise RuntimeError(f"{self.name} cannot be made from this: {e}") from e

    @property
    def par(self) -> dict[str, float]:
        return self.dist.par() if isinstance(self.dist, Family) else {}

    @property
    def discrete(self) -> bool:
        return isinstance(self.dist, Discrete)

    def mean(self) -> float:
        return float(self.dist.mean())

    def std(self) -> float:
        return float(self.dist.std())

    def pdf(self, x):
        return self.dist.pdf(x)

    def cdf(self, x):
        return self.dist.cdf(x)

    def icdf(self, y):
        return self.dist.icdf(y)

    def random(self, size=None, seed=None):
        return self.icdf(np.random.default_rng(seed).random(size))

    def __add__(self, other: Distribution) -> Distribution:
        if not isinstance(self.dist, EmpDist) or not isinstance(getattr(other, "dist", None), EmpDist):
            raise NotImplementedError("only empirical distributions can be added")
        out = object.__new__(Distribution)
        out.name, out.ID, out.dist = self.name, self.ID, self.dist + other.dist
        return out

    def __radd__(self, other):
        return self if other == 0 else NotImplemented

    def to_row(self) -> dict:
        return {"name": self.name, "par": self.par, "empirical": self.dist.to_row() if isinstance(self.dist, EmpDist) else None}

    @classmethod
    def from_row(cls, row) -> Distribution:
        """The distribution of what to_row gives (a Row or a dict)."""
        r = row if isinstance(row, dict) else row.asDict(recursive=True)
        if r.get("empirical") is None:
            return cls(r["name"], "PAR", list(r["par"].values()))
        out = object.__new__(cls)
        out.name, out.ID, out.dist = r["name"], False, from_row(r["empirical"])
        return out

    def save(self, path: str, compressed: bool = True) -> None:
        """Writes the distribution as JSON, gzipped if compressed; any family."""
        text = json.dumps({"format": "distribution-1", "id": bool(self.ID), **self.to_row()}).encode()
        with open(f"{path}.part", "wb") as f:
            f.write(gzip.compress(text, mtime=0) if compressed else text)
        os.replace(f"{path}.part", path)

    @classmethod
    def load(cls, path: str) -> Distribution:
        with open(path, "rb") as f:
            raw = f.read()
        try:
            row = json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
        except ValueError as e:
            raise ValueError(f"{path} holds no distribution") from e
        if not isinstance(row, dict) or row.get("format") != "distribution-1":
            raise ValueError(f"{path} holds no distribution")
        out = cls.from_row(row)
        out.ID = row["id"]
        return out


# Fits that are closed formulas of sums run as aggregates, one shuffle for any number of groups.


CLOSED_FITS = frozenset("normal lognormal exponential uniform rayleigh poisson geometric binomial negativebinomial pareto".split())


def fit_columns(name: str, x: Column, n: float | None = None) -> dict[str, Column]:
    """The parameters of the closed-form fit of a family as aggregate expressions over x."""
    name = ALIASES.get(name.lower(), name.lower())
    x = x.cast("double")
    if name == "normal":
        return {"mu": F.avg(x), "sigma": F.stddev_pop(x)}
    if name == "lognormal":
        return {"mu_lnx": F.avg(F.ln(x)), "sig_lnx": F.stddev_pop(F.ln(x))}
    if name == "exponential":
        return {"lambda": 1 / F.avg(x)}
    if name == "uniform":
        return {"lower": F.min(x), "upper": F.max(x)}
    if name == "rayleigh":
        return {"alpha": F.sqrt(F.sum(x * x) / (2 * F.count(x)))}
    if name == "poisson":
        return {"lambda": F.avg(x)} if n is None else {"v": F.avg(x) / n, "t": F.lit(float(n))}
    if name == "geometric":
        return {"p": 1 / F.avg(x)}
    if name == "binomial":
        return {"n": F.lit(float(n)), "p": F.avg(x) / n}
    if name == "negativebinomial":
        m = F.avg(x)
        k = F.round(m * (m / (m + F.var_pop(x))))
        return {"k": k, "p": k / m}
    if name == "pareto":
        return {"x_m": F.min(x), "alpha": F.count(x) / (F.sum(F.ln(x)) - F.count(x) * F.ln(F.min(x)))}
    raise ValueError(f"{name} has no closed-form fit; use fit_groups")


def fit_groups(df: DataFrame, keys: list[str], x: str, name: str, extra: tuple = ()) -> DataFrame:
    """keys, name and par (a map) of each group's fit to its values of x: closed forms as aggregates, others by search.

    Gamma needs two sums only; the families searched for over all samples gather each group, as the likelihood does.
    """
    family = FAMILIES[ALIASES.get(name.lower(), name.lower())]
    if family.__name__.lower() in CLOSED_FITS:
        made = fit_columns(name, F.col(x), *extra)
        pairs = [y for k, v in made.items() for y in (F.lit(k), v)]
        return df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.create_map(*pairs).alias("par"))
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", par map<string,double>"
    if family is Gamma:
        sums = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.avg(x).alias("_m"), F.avg(F.ln(x)).alias("_l"))

        def solve(batches):
            for b in batches:
                b["par"] = [list(Gamma.of_sums(m, g).par().items()) for m, g in zip(b.pop("_m"), b.pop("_l"), strict=True)]
                b["par"] = b["par"].map(dict)
                yield b

        return sums.mapInPandas(solve, schema)

    def fit(group):
        val = [group[x].to_numpy(float), *extra] if extra else group[x].to_numpy(float)
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "par": [family.of_data(val).par()]})

    return df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias(x)).groupBy(*keys).applyInPandas(fit, schema)


def cdf_column(name: str, par: dict[str, Column | float], x: Column) -> Column:
    """Closed cdfs as expressions, within whole-stage code."""
    p = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in par.items()}
    if name == "exponential":
        return 1 - F.exp(-p["lambda"] * F.greatest(x, F.lit(0.0)))
    if name == "uniform":
        return F.least(F.greatest((x - p["lower"]) / (p["upper"] - p["lower"]), F.lit(0.0)), F.lit(1.0))
    if name == "rayleigh":
        return 1 - F.exp(-0.5 * F.pow(F.greatest(x, F.lit(0.0)) / p["alpha"], F.lit(2.0)))
    if name == "weibull":
        return 1 - F.exp(-F.pow(F.greatest(x, F.lit(0.0)) / p["a_n"], p["k"]))
    if name == "gumbel":
        return F.exp(-F.exp(-(x - p["b_n"]) / p["a_n"]))
    if name == "gumbelmin":
        return 1 - F.exp(-F.exp((x - p["b_n"]) / p["a_n"]))
    if name == "frechet":
        return F.when(x > 0, F.exp(-F.pow(F.when(x > 0, x) / p["a_n"], -p["k"]))).otherwise(0.0)
    if name == "pareto":
        return 1 - F.pow(F.greatest(x, p["x_m"]) / p["x_m"], -p["alpha"])
    if name == "geometric":
        return 1 - F.pow(1 - p["p"], F.greatest(F.floor(x), F.lit(0)).cast("double"))
    if name == "gev":
        base = 1 + p["beta"] * (x - p["epsilon"]) / p["alpha"]
        return F.when(base > 0, F.exp(-F.pow(F.when(base > 0, base), -1 / p["beta"]))).otherwise(F.when(p["beta"] > 0, 0.0).otherwise(1.0))
    raise ValueError(f"{name} has no closed cdf here")


def icdf_column(name: str, par: dict[str, Column | float], y: Column) -> Column:
    p = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in par.items()}
    if name == "exponential":
        return -F.ln(1 - y) / p["lambda"]
    if name == "uniform":
        return p["lower"] + y * (p["upper"] - p["lower"])
    if name == "rayleigh":
        return p["alpha"] * F.sqrt(-2 * F.ln(1 - y))
    if name == "weibull":
        return p["a_n"] * F.pow(-F.ln(1 - y), 1 / p["k"])
    if name == "gumbel":
        return p["b_n"] - p["a_n"] * F.ln(-F.ln(y))
    if name == "gumbelmin":
        return p["b_n"] + p["a_n"] * F.ln(-F.ln(1 - y))
    if name == "frechet":
        return p["a_n"] * F.pow(-F.ln(y), -1 / p["k"])
    if name == "pareto":
        return p["x_m"] * F.pow(1 - y, -1 / p["alpha"])
    if name == "gev":
        return p["epsilon"] + p["alpha"] * (F.pow(-F.ln(y), -p["beta"]) - 1) / p["beta"]
    raise ValueError(f"{name} has no closed quantile function here")


def evaluated(dist: Distribution, function: str, x: Column) -> Column:
    """pdf, cdf or icdf of one distribution over a column, in Arrow batches."""
    @F.pandas_udf("double")
    def call(v: pd.Series) -> pd.Series:
        return pd.Series(getattr(dist, function)(v.to_numpy(float)))

    return call(x)


def random_rows(spark, dist: Distribution, n: int, seed: int = 0) -> DataFrame:
    """n draws by inverse transform of a seeded uniform column."""
    return spark.range(n).select("id", evaluated(dist, "icdf", F.rand(seed)).alias("x"))
