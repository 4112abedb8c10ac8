"""Rectangle zones on a regular grid, all in expressions: bounding boxes explode to pixels, pixels join by position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt_out(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in at least as many parts as there are cores, by keys: a small file of zones is else the work of one task."""
    session = rows.sparkSession
    return rows.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), *keys)


@dataclass(frozen=True)
class Affine:
    """x = c + col * a + row * b, y = f + col * d + row * e."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    def point(self, col, row):
        return self.c + col * self.a + row * self.b, self.f + col * self.d + row * self.e

    def cell(self, x, y):
        """col and row, with fractions, of a point."""
        det = self.a * self.e - self.b * self.d
        u, v = x - self.c, y - self.f
        return (u * self.e - v * self.b) / det, (v * self.a - u * self.d) / det

    @property
    def straight(self) -> bool:
        return self.b == 0 and self.d == 0


def _overlap(lo: Column, hi: Column, cell: Column, size: int) -> Column:
    return F.least(hi, (cell + 1) * size) - F.greatest(lo, cell * size)


def rectangle_pixels(zones: DataFrame, pixels: DataFrame, size: int = 1000) -> DataFrame:
    """The pixels of each rectangle with coverage in size * size units and whether the centre is strictly inside.

    zones: zone_id and integers x0, y0, x1, y1 in units of which a pixel's edge has `size`; pixels: col, row and
    whatever else. A zone explodes to the pixels of its bounding box, so the join is an equi-join on (col, row). The
    planner knows zones by the size of their table only, so they are kept from being sent to the driver; a grid that is
    known to be small may come as F.broadcast(pixels).
    """
    col, row = F.col("col"), F.col("row")
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("long"), (F.ceil(F.col(hi) / size) - 1).cast("long"))
    boxes = dealt_out(zones.where("x1 > x0 and y1 > y0"), "zone_id").select("zone_id", "x0", "y0", "x1", "y1", F.explode(span("x0", "x1")).alias("col"))
    boxes = boxes.select("*", F.explode(span("y0", "y1")).alias("row"))
    w, h = _overlap(F.col("x0"), F.col("x1"), col, size), _overlap(F.col("y0"), F.col("y1"), row, size)
    boxes = boxes.select("zone_id", "col", "row", (w * h).cast("long").alias("coverage"), *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    strict = (2 * F.col("x0") < (2 * col + 1) * size) & ((2 * col + 1) * size < 2 * F.col("x1")) & (2 * F.col("y0") < (2 * row + 1) * size) & ((2 * row + 1) * size < 2 * F.col("y1"))
    boxes = boxes.withColumn("centroid_in", (F.col("coverage") == size * size) | strict).drop("x0", "y0", "x1", "y1")
    return boxes.hint("merge").join(pixels, ["col", "row"])


def stack_bands(bands: dict[str, DataFrame]) -> DataFrame:
    """Bands of one grid (row, col, value each) as one long table with band_name."""
    out = None
    for name, df in bands.items():
        part = df.withColumn("band_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def with_weights(pixels: DataFrame, weights: DataFrame | None) -> DataFrame:
    """pixels with weight joined by (row, col), or 1 where there are no weights; pixels without one have null."""
    if weights is None:
        return pixels.withColumn("weight", F.lit(1.0))
    return pixels.join(weights.select("row", "col", "weight"), ["row", "col"], "left")
