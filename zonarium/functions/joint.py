"""Joint distributions of given marginals and correlation under a Gaussian copula (Nataf's model)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.functions import special as S
from zonarium.functions.distributions import Distribution


def bivariate_normal_pdf(x, y, rho: float):
    """Density of two standard normals of correlation rho."""
    r = 1 - rho * rho
    return np.exp(-(x * x - 2 * rho * x * y + y * y) / (2 * r)) / (2 * math.pi * math.sqrt(r))


class JointDistribution:
    """marginals and rho_x make rho_z, the correlation of the normals behind them, and its Cholesky factor a."""

    def __init__(self, marginals: list[Distribution], correlation, nodes: int = 1024) -> None:
        self.marginals = list(marginals)
        self.rho_x = np.asarray(correlation, float)
        n = len(self.marginals)
        if not all(math.isfinite(m.mean()) and math.isfinite(m.std()) for m in marginals):
            raise RuntimeError("the marginals need finite means and standard deviations")
        if self.rho_x.shape != (n, n) or not np.allclose(self.rho_x, self.rho_x.T) or not np.allclose(np.diag(self.rho_x), 1):
            raise RuntimeError("the correlation matrix must be symmetric with a unit diagonal")
        try:
            np.linalg.cholesky(self.rho_x)
        except np.linalg.LinAlgError:
            raise RuntimeError("the correlation matrix must be positive definite") from None
        self._z, weights = np.polynomial.legendre.leggauss(nodes)
        self._z, self._w = self._z * 8, weights * 8
        self.rho_z = np.eye(n)
        for i in range(n):
            for j in range(i + 1, n):
                self.rho_z[i, j] = self.rho_z[j, i] = self._solve(i, j)
        try:
            self.a = np.linalg.cholesky(self.rho_z)
        except np.linalg.LinAlgError:
            raise RuntimeError("no Gaussian copula has this correlation with these marginals") from None

    def _standardized(self, i: int) -> np.ndarray:
        m = self.marginals[i]
        with np.errstate(all="ignore"):
            x = m.icdf(S.normal_cdf(self._z))
        x = np.where(np.isfinite(x), x, 0.0)
        return (x - m.mean()) / m.std()

    def _solve(self, i: int, j: int) -> float:
        rho = float(self.rho_x[i, j])
        if rho == 0:
            return 0.0
        a, b = self.marginals[i], self.marginals[j]
        names = {a.name, b.name}
        if names <= {"normal", "standardnormal"}:
            return rho
        if names <= {"normal", "standardnormal", "lognormal"}:
            logs = [m for m in (a, b) if m.name == "lognormal"]
            if len(logs) == 1:
                v = logs[0].std() / logs[0].mean()
                out = rho * v / math.sqrt(math.log1p(v * v))
            else:
                u, v = a.std() / a.mean(), b.std() / b.mean()
                inner = 1 + rho * u * v
                out = math.log(inner) / math.sqrt(math.log1p(u * u) * math.log1p(v * v)) if inner > 0 else math.nan
            if not abs(out) < 1:
                raise RuntimeError(f"marginals {i} and {j} cannot have the correlation {rho}")
            return out
        x, y = self._standardized(i), self._standardized(j)
        outer = self._w[:, None] * self._w[None, :] * x[:, None] * y[None, :]
        zx, zy = self._z[:, None], self._z[None, :]
        gap = lambda r: float((outer * bivariate_normal_pdf(zx, zy, r)).sum()) - rho
        try:
            return S.bisect(gap, -0.9999, 0.9999, 60)
        except RuntimeError:
            raise RuntimeError(f"marginals {i} and {j} cannot have the correlation {rho}") from None

    def _continuous(self) -> None:
        if any(m.discrete for m in self.marginals):
            raise RuntimeError("discrete marginals have no transformation")

    def x_to_u(self, x, jacobian: bool = False):
        """Independent standard normals of points (rows); with jacobian, also du/dx of each."""
        self._continuous()
        x = np.atleast_2d(np.asarray(x, float))
        z = np.stack([S.normal_icdf(m.cdf(x[:, k])) for k, m in enumerate(self.marginals)], axis=1)
        u = np.linalg.solve(self.a, z.T).T
        if not jacobian:
            return u
        diagonal = np.stack([m.pdf(x[:, k]) / S.normal_pdf(z[:, k]) for k, m in enumerate(self.marginals)], axis=1)
        return u, np.linalg.inv(self.a)[None] * diagonal[:, None, :]

    def u_to_x(self, u, jacobian: bool = False):
        u = np.atleast_2d(np.asarray(u, float))
        z = u @ self.a.T
        x = np.stack([m.icdf(S.normal_cdf(z[:, k])) for k, m in enumerate(self.marginals)], axis=1)
        if not jacobian:
            return x
        self._continuous()
        diagonal = np.stack([S.normal_pdf(z[:, k]) / m.pdf(x[:, k]) for k, m in enumerate(self.marginals)], axis=1)
        return x, diagonal[:, :, None] * self.a[None]

    def random(self, n: int = 1, seed=None) -> np.ndarray:
        return self.u_to_x(np.random.default_rng(seed).standard_normal((n, len(self.marginals))))

    def pdf(self, x) -> np.ndarray:
        self._continuous()
        x = np.atleast_2d(np.asarray(x, float))
        f = np.stack([m.pdf(x[:, k]) for k, m in enumerate(self.marginals)], axis=1)
        z = np.stack([S.normal_icdf(m.cdf(x[:, k])) for k, m in enumerate(self.marginals)], axis=1)
        u = np.linalg.solve(self.a, z.T).T
        with np.errstate(all="ignore"):
            log = -0.5 * (u * u).sum(1) + 0.5 * (z * z).sum(1) - np.log(np.diag(self.a)).sum()
            out = f.prod(1) * np.exp(log)
        return np.where((f > 0).all(1) & np.isfinite(out), out, 0.0)

    def cdf(self, x, points: int = 4096, seed: int = 0) -> np.ndarray:
        """Genz's transformation with a randomised lattice of `points` nodes and eight shifts; a stochastic estimate."""
        x = np.atleast_2d(np.asarray(x, float))
        b = np.stack([S.normal_icdf(np.clip(m.cdf(x[:, k]), 0, 1)) for k, m in enumerate(self.marginals)], axis=1)
        n = b.shape[1]
        primes = [p for p in range(2, 1000) if all(p % q for q in range(2, int(p**0.5) + 1))][: max(1, n - 1)]
        base = np.outer(np.arange(1, points + 1), np.sqrt(primes))
        rng = np.random.default_rng(seed)
        out = np.zeros(len(b))
        for _ in range(8):
            w = np.abs(2 * ((base + rng.random(len(primes))) % 1) - 1)
            for row in range(len(b)):
                e = np.full(points, float(S.normal_cdf(b[row, 0] / self.a[0, 0])))
                f, y = e.copy(), []
                for k in range(1, n):
                    y.append(S.normal_icdf(np.clip(w[:, k - 1] * e, 1e-300, 1 - 1e-16)))
                    e = S.normal_cdf((b[row, k] - np.stack(y, 1) @ self.a[k, :k]) / self.a[k, k])
                    f = f * e
                out[row] += f.mean() / 8
        return out

    def transform(self, df: DataFrame, columns: list[str], function: str) -> DataFrame:
        """df with u1.. (x_to_u), x1.. (u_to_x), or density / probability (pdf / cdf) of its columns, in Arrow batches."""
        names = {"x_to_u": [f"u{k + 1}" for k in range(len(columns))], "u_to_x": [f"x{k + 1}" for k in range(len(columns))], "pdf": ["density"], "cdf": ["probability"]}[function]
        joint = self

        def run(batches):
            for batch in batches:
                out = getattr(joint, function)(batch[columns].to_numpy(float)) if len(batch) else np.zeros((0, len(names)))
                yield batch.assign(**dict(zip(names, np.reshape(out, (len(batch), len(names))).T, strict=True)))

        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n not in names) + "".join(f", {n} double" for n in names)
        return df.drop(*names).mapInPandas(run, schema) if not set(names) & set(columns) else df.mapInPandas(lambda it: run(it), ", ".join(f"`{n}` {t}" for n, t in df.dtypes))

    def random_rows(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """n rows of correlated draws, from seeded normal columns."""
        d = len(self.marginals)
        normal = spark.range(n).select("id", *(F.randn(seed + k).alias(f"u{k + 1}") for k in range(d)))
        return self.transform(normal, [f"u{k + 1}" for k in range(d)], "u_to_x")


