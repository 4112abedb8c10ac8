"""True ground area of pixels: closed form on the ellipsoid for geographic grids, local equal-area projection for any.

The local projection is Lambert's azimuthal equal-area on the WGS84 ellipsoid (Snyder, USGS Professional Paper 1395),
centred on each block; a pixel's edges get points between their corners, and the shoelace formula gives the area.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.operators.grid import Affine

A = 6378137.0
E = 0.0818191908426214957
E2 = E * E
AREA_MODES = ("trueAreaForFirst", "trueAreaForEach")


def authalic_area(south: Column, north: Column, width: Column) -> Column:
    """Square metres between two parallels along `width` degrees of longitude."""

    def q(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return s / (1 - E2 * s * s) + F.ln((1 + E * s) / (1 - E * s)) / (2 * E)

    return F.lit(A * A * (1 - E2) / 2) * F.radians(width) * (q(north) - q(south))


def _q(sin):
    return (1 - E2) * (sin / (1 - E2 * sin * sin) + np.arctanh(E * sin) / E)


def laea(lon, lat, lon0: float, lat0: float):
    """Metres east and north of the centre in the equal-area projection centred there."""
    lam, phi = np.radians(np.asarray(lon, float) - lon0), np.radians(lat)
    qp = _q(1.0)
    rq = A * math.sqrt(qp / 2)
    beta = np.arcsin(np.clip(_q(np.sin(phi)) / qp, -1, 1))
    s0 = math.sin(math.radians(lat0))
    beta0 = math.asin(max(-1.0, min(1.0, float(_q(s0)) / float(qp))))
    if abs(abs(lat0) - 90) < 1e-9:
        sign = 1.0 if lat0 > 0 else -1.0
        rho = A * np.sqrt(np.maximum(qp - sign * _q(np.sin(phi)), 0))
        return rho * np.sin(lam), -sign * rho * np.cos(lam)
    d = A * math.cos(math.radians(lat0)) / math.sqrt(1 - E2 * s0 * s0) / (rq * math.cos(beta0))
    b = rq * np.sqrt(2 / (1 + math.sin(beta0) * np.sin(beta) + math.cos(beta0) * np.cos(beta) * np.cos(lam)))
    return b * d * np.cos(beta) * np.sin(lam), b / d * (math.cos(beta0) * np.sin(beta) - math.sin(beta0) * np.cos(beta) * np.cos(lam))


def pixel_areas(transform: Affine, row_off: int, col_off: int, nrows: int, ncols: int, points_per_edge: int = 1, to_lonlat: Callable | None = None) -> np.ndarray:
    """Areas of a block's pixels; to_lonlat takes the grid's coordinates to degrees (none: they are degrees).

    An edge has points_per_edge segments: with 1, a pixel is its four corners.
    """
    if points_per_edge < 1:
        raise ValueError("an edge has at least one segment")
    rows, cols = np.meshgrid(np.arange(row_off, row_off + nrows, dtype=float), np.arange(col_off, col_off + ncols, dtype=float), indexing="ij")
    return areas_at(transform, rows, cols, (col_off + ncols / 2, row_off + nrows / 2), points_per_edge, to_lonlat)


def areas_at(transform: Affine, rows: np.ndarray, cols: np.ndarray, centre: tuple[float, float], points_per_edge: int = 1, to_lonlat: Callable | None = None) -> np.ndarray:
    """Areas of the pixels at rows and cols, in the projection centred at a column and row of the grid."""
    n = points_per_edge
    step = np.linspace(0, 1, n + 1)[:-1]
    zero, one = np.zeros(n), np.ones(n)
    # Around the pixel: along the top, down the right side, back along the bottom, up the left side.
    dc, dr = np.concatenate([step, one, 1 - step, zero]), np.concatenate([zero, step, one, 1 - step])
    x, y = transform.point(cols[..., None] + dc, rows[..., None] + dr)
    cx, cy = transform.point(*centre)
    if to_lonlat:
        x, y = to_lonlat(x, y)
        cx, cy = (float(v) for v in to_lonlat(np.float64(cx), np.float64(cy)))
    px, py = laea(x, y, cx, cy)
    return 0.5 * np.abs((px * np.roll(py, -1, -1) - np.roll(px, -1, -1) * py).sum(-1))


def block_shape(block_h: int, block_w: int, fallback: int = 512) -> tuple[int, int]:
    """The file's own blocks, where both edges are multiples of 16; square ones of the fallback size otherwise."""
    return (block_h, block_w) if block_h > 0 and block_w > 0 and block_h % 16 == 0 and block_w % 16 == 0 else (fallback, fallback)


def area_table(spark: SparkSession, width: int, height: int, transform: Affine, crs: str = "EPSG:4326", block: tuple[int, int] = (512, 512), points_per_edge: int = 1) -> DataFrame:
    """row, col, weight: each pixel's area in square metres; one task row for each block, so any raster size spreads out."""
    from zonarium.operators.projections import projection

    bh, bw = block
    to_lonlat = projection(crs)[1]
    blocks = spark.range(-(-height // bh)).select((F.col("id") * bh).alias("r")).select("r", F.explode(F.sequence(F.lit(0), F.lit(-(-width // bw) - 1))).alias("b")).select("r", (F.col("b") * bw).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, c in zip(batch["r"].tolist(), batch["c"].tolist(), strict=True):
                h, w = min(bh, height - r), min(bw, width - c)
                area = pixel_areas(transform, r, c, h, w, points_per_edge, to_lonlat).astype(np.float32).astype(float)
                yield pd.DataFrame({"row": np.repeat(np.arange(r, r + h), w), "col": np.tile(np.arange(c, c + w), h), "weight": area.ravel()})

    n = max(1, (-(-height // bh)) * (-(-width // bw)))
    return blocks.repartition(min(n, 2000)).mapInPandas(run, "row long, col long, weight double")


def with_true_area(pixels: DataFrame, width: int, height: int, transform: Affine, crs: str = "EPSG:4326", block: tuple[int, int] = (512, 512), points_per_edge: int = 1) -> DataFrame:
    """pixels (row, col, ...) with weight, the area that area_table has for each; only these pixels are computed."""
    from zonarium.operators.projections import projection

    if points_per_edge < 1:
        raise ValueError("an edge has at least one segment")
    bh, bw = block
    to_lonlat = projection(crs)[1]
    names = pixels.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = (batch.column(c).to_numpy().astype(float) for c in ("row", "col"))
            area, down, across = np.zeros(len(rows)), rows // bh, cols // bw
            for r, c in set(zip(down.tolist(), across.tolist(), strict=True)):
                own = (down == r) & (across == c)
                centre = (c * bw + min(bw, width - c * bw) / 2, r * bh + min(bh, height - r * bh) / 2)
                area[own] = areas_at(transform, rows[own], cols[own], centre, points_per_edge, to_lonlat)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(area.astype(np.float32).astype(float))], names=[*names, "weight"])

    return pixels.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in pixels.dtypes) + ", weight double")
