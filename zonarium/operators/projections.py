"""Closed-form map projections: geographic WGS84, web Mercator and UTM (Krueger's series); pyproj where it is installed."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _utm(zone: int, south: bool) -> tuple[Callable, Callable]:
    centre, north0 = zone * 6 - 183, 1e7 if south else 0.0
    e = 2 * math.sqrt(_N) / (1 + _N)

    def forward(lon, lat):
        lam, s = np.radians(np.asarray(lon, float) - centre), np.sin(np.radians(lat))
        t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
        x, y = eta + 0, xi + 0
        for j, a in enumerate(_ALPHA, 1):
            x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return 5e5 + 0.9996 * _RADIUS * x, north0 + 0.9996 * _RADIUS * y

    def back(x, y):
        xi, eta = (np.asarray(y, float) - north0) / (0.9996 * _RADIUS), (np.asarray(x, float) - 5e5) / (0.9996 * _RADIUS)
        p, q = xi + 0, eta + 0
        for j, b in enumerate(_BETA, 1):
            p = p - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            q = q - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        chi = np.arcsin(np.sin(p) / np.cosh(q))
        lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
        return np.degrees(np.arctan2(np.sinh(q), np.cos(p))) + centre, np.degrees(lat)

    return forward, back


def _mercator() -> tuple[Callable, Callable]:
    def forward(lon, lat):
        return _A * np.radians(lon), _A * np.arctanh(np.sin(np.radians(lat)))

    def back(x, y):
        return np.degrees(np.asarray(x, float) / _A), np.degrees(np.arctan(np.sinh(np.asarray(y, float) / _A)))

    return forward, back


def projection(crs: str) -> tuple[Callable | None, Callable | None]:
    """(from degrees, to degrees) of a CRS; (None, None) for geographic WGS84."""
    code = crs.upper().removeprefix("EPSG:").strip()
    if code in ("4326", "OGC:CRS84", "CRS84"):
        return None, None
    if code == "3857":
        return _mercator()
    if code.isdigit() and 32601 <= int(code) <= 32660:
        return _utm(int(code) - 32600, False)
    if code.isdigit() and 32701 <= int(code) <= 32760:
        return _utm(int(code) - 32700, True)
    try:
        from pyproj import Transformer
    except ImportError:
        raise ValueError(f"{crs}: only EPSG:4326, EPSG:3857 and UTM on WGS84 are built in; others need pyproj") from None
    return Transformer.from_crs("EPSG:4326", crs, always_xy=True).transform, Transformer.from_crs(crs, "EPSG:4326", always_xy=True).transform


def between(source: str, target: str) -> Callable:
    """(x, y) -> (x, y) from one CRS to another."""
    back, forward = projection(source)[1], projection(target)[0]
    if source == target:
        return lambda x, y: (x, y)

    def run(x, y):
        x, y = back(x, y) if back else (x, y)
        return forward(x, y) if forward else (x, y)

    return run
