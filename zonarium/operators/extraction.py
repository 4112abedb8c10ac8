"""From files to statistics in one call: rasters, polygons and weights by path, a row for each polygon out.

The plan has one scan of the rasters' blocks, one clip of the polygons, one join of both by pixel, and the aggregates of
zonal_statistics. True pixel areas are computed for the pixels that polygons touch, after the clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.operators.area import AREA_MODES, area_table, block_shape, with_true_area
from zonarium.operators.polygons import zone_pixels
from zonarium.operators.statistics import zonal_statistics
from zonarium.sources import raster
from zonarium.sources.tables import read_vector, write_raw

_GRID = ("width", "height", "transform", "crs")
#: Rasters of at most so many cells in all bands are sent to the tasks whole, and meet the pixels of zones there.
_SMALL_CELLS = 250_000


def _metas(paths: list[str], options: dict | None) -> list[raster.RasterMeta]:
    metas = [raster.read_meta(p, options) for p in paths]
    other = [m.path for m in metas if any(getattr(m, g) != getattr(metas[0], g) for g in _GRID)]
    if other:
        raise ValueError(f"these are not on the grid of {metas[0].path}: {other}")
    return metas


def bands_of(metas: list[raster.RasterMeta]) -> list[str]:
    """The band names of rasters, in their order; two rasters of one name cannot be told apart."""
    stems = [raster.stem_of(m.path) for m in metas]
    if len(set(stems)) < len(stems):
        raise ValueError(f"rasters need different names: {stems}")
    return [f"{s}_band_{b}" for s, m in zip(stems, metas, strict=True) for b in range(1, m.n_bands + 1)]


def extract_pixels(
    spark: SparkSession,
    rasters: list[str],
    zones: DataFrame,
    weights: str | list[str] | None = None,
    zone_crs: str = "EPSG:4326",
    block_size: tuple[int, int] | None = None,
    points_per_edge: int = 1,
    options: dict[str, str] | None = None,
    fail_on_error: bool = True,
) -> DataFrame:
    """zone_id, band_name, row, col, value, coverage, weight, center_x, center_y, centroid_in of all pixels that zones touch.

    zones: zone_id and geometry in zone_crs. weights: None for 1; one raster for all, or one for each raster, of one
    band each; trueAreaForFirst or trueAreaForEach for square metres by the first raster's grid or by each one's own.
    """
    metas = _metas(rasters, options)
    first = metas[0]
    crs = first.crs or "EPSG:4326"
    touched = zone_pixels(zones, first.transform, first.width, first.height, zone_crs, crs)
    if weights == AREA_MODES[0]:
        touched = with_true_area(touched, first.width, first.height, first.transform, crs, block_size or block_shape(first.block_h, first.block_w), points_per_edge)
    elif isinstance(weights, str) and weights != AREA_MODES[1]:
        weights = [weights]
    values = raster.read_raster(spark, rasters, fail_on_error, options).select("band_name", "row", "col", "value")
    # The planner knows zones by the size of their table and not by their pixels, which it must never send to the driver.
    small = first.width * first.height * sum(m.n_bands for m in metas) <= _SMALL_CELLS
    pixels = touched.hint("merge").join(F.broadcast(values) if small else values, ["row", "col"])
    if weights is None:
        return pixels.withColumn("weight", F.lit(1.0))
    if weights == AREA_MODES[0]:
        return pixels
    stem = F.regexp_extract("band_name", r"^(.*)_band_\d+$", 1)
    if weights == AREA_MODES[1]:
        # The grids are one, but the blocks, on which the projections are centred, may differ from file to file.
        shapes = {raster.stem_of(m.path): block_size or block_shape(m.block_h, m.block_w) for m in metas}
        parts = [with_true_area(pixels.where(stem.isin(*(s for s, x in shapes.items() if x == b))), first.width, first.height, first.transform, crs, b, points_per_edge) for b in dict.fromkeys(shapes.values())]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    if len(weights) not in (1, len(rasters)):
        raise ValueError("weights are one raster for all, or one for each raster")
    _metas([rasters[0], *weights], options)
    found = raster.read_raster(spark, list(dict.fromkeys(weights)), fail_on_error, options).where("band = 1")
    of = {raster.stem_of(r): raster.stem_of(w) for r, w in zip(rasters, weights * (len(rasters) // len(weights)), strict=True)}
    found = found.select("row", "col", F.regexp_replace("band_name", r"_band_1$", "").alias("_weight_of"), F.col("value").alias("weight"))
    named = F.create_map(*(F.lit(x) for pair in of.items() for x in pair))[stem]
    return pixels.withColumn("_weight_of", named).join(found, ["row", "col", "_weight_of"], "left").drop("_weight_of")


def extract_quantity(
    spark: SparkSession,
    rasters: str | list[str],
    polygons: str | DataFrame,
    weights: str | list[str] | None = None,
    quantities: list[str | dict] = ("median",),
    centroid_quantities: list[str | dict] = (),
    ignore_values: tuple = (),
    keep_columns: list[str] | None = None,
    id_column: str | None = None,
    id_name: str = "id",
    zone_crs: str | None = None,
    layer: str | None = None,
    save_raw: str | None = None,
    save_raw_as: str = "GPKG",
    save_area: str | None = None,
    block_size: tuple[int, int] | None = None,
    points_per_edge: int = 1,
    keep_raw: bool = False,
    keep_non_intersecting: bool = False,
    non_intersecting_mode: str = "allBandsNotIntersecting",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """One row for each polygon: id, kept columns, geometry, and {stem}_band_{b}_{quantity} for each band and quantity.

    polygons: a GeoJSON or GeoPackage file, or a DataFrame with geometry in zone_crs (WKB, WKT or GeoJSON). The id is
    id_column, or else a number, in the file's order, under id_name. save_raw writes the raw pixels of each polygon as
    arrays, save_area the first raster's pixel areas as Parquet. options: those of s3_options for rasters in object
    stores.
    """
    if not quantities and not centroid_quantities and not keep_raw:
        raise ValueError("choose a quantity, or keep_raw")
    rasters = [rasters] if isinstance(rasters, str) else list(rasters)
    if isinstance(polygons, str):
        zones, found = read_vector(spark, polygons, layer, id_column)
        zone_crs = zone_crs or found
    else:
        zone_crs = zone_crs or "EPSG:4326"
        zones = polygons.withColumn("zone_id", F.col(f"`{id_column}`") if id_column else F.monotonically_increasing_id())
    if "properties" in zones.columns and isinstance(polygons, str):
        zones = zones.select("zone_id", "geometry", *(F.col("properties")[c].alias(c) for c in keep_columns or [] if c != id_column))
    kept = [c for c in keep_columns or [] if c not in ("geometry", "zone_id", id_column)]
    zones = zones.select("zone_id", *(F.col(f"`{c}`") for c in kept), "geometry")
    metas = _metas(rasters, options)
    bands = bands_of(metas)
    if save_area:
        m = metas[0]
        area_table(spark, m.width, m.height, m.transform, m.crs or "EPSG:4326", block_size or block_shape(m.block_h, m.block_w), points_per_edge).write.parquet(save_area)
    pixels = extract_pixels(spark, rasters, zones.select("zone_id", "geometry"), weights, zone_crs, block_size, points_per_edge, options)
    if save_raw:
        raw = zonal_statistics(pixels, bands=bands, zones=zones, keep_raw=True, keep_non_intersecting=True)
        write_raw(raw.withColumnRenamed("zone_id", id_column or id_name), save_raw, save_raw_as, zone_crs)
    out = zonal_statistics(pixels, list(quantities), list(centroid_quantities), bands, zones, tuple(ignore_values), keep_non_intersecting=keep_non_intersecting, non_intersecting_mode=non_intersecting_mode, keep_raw=keep_raw)
    return out.withColumnRenamed("zone_id", id_column or id_name)
