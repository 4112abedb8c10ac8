import json
import math
import struct

import numpy as np
import pytest

from zonarium.operators import area, polygons, projections
from zonarium.operators.grid import Affine
from zonarium.sources import raster, tables

HOLED = "MULTIPOLYGON(((1.3 1.2, 15.7 2.1, 9 9, 14.2 17.9, 2.2 16.1, 1.3 1.2),(4 4, 6.5 4.2, 5.1 8, 4 4)),((16.5 12, 19.2 12.1, 18 18, 16.5 12)))"


def ring_area(r):
    x, y = np.asarray(r).T
    return 0.5 * abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y))


def test_coverage_sums_to_area():
    p = polygons.parse_geometry(HOLED)
    want = ring_area(p[0][0]) - ring_area(p[0][1]) + ring_area(p[1][0])
    rows = list(polygons.coverage_rows(p, 0, 19))
    cover = np.concatenate([c for _, _, c in rows])
    assert cover.sum() == pytest.approx(want, rel=1e-12) and cover.max() == 1.0 and cover.min() > 0
    inner = {(r, int(c)): v for r, cols, cs in rows for c, v in zip(cols, cs)}
    assert inner[(10, 5)] == 1.0


def test_aligned_rectangle_is_exact():
    rows = list(polygons.coverage_rows(polygons.parse_geometry("POLYGON((1 1, 4 1, 4 3, 1 3, 1 1))"), 0, 5))
    assert {(r, int(c)): float(v) for r, cols, cs in rows for c, v in zip(cols, cs)} == {(r, c): 1.0 for r in (1, 2) for c in (1, 2, 3)}


def test_points_on_edges_are_outside():
    p = polygons.parse_geometry("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))")
    x, y = np.array([2.0, 0, 4, 2, 0, 5]), np.array([2.0, 2, 2, 0, 0, 2])
    assert polygons.strictly_inside(p, x, y).tolist() == [True, False, False, False, False, False]


def test_formats_agree():
    p = polygons.parse_geometry(HOLED)
    shape = {"type": "MultiPolygon", "coordinates": [[r.tolist() for r in q] for q in p]}
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + np.array([[0, 0], [1, 0], [0, 1], [0, 0]], ">f8").tobytes()
    assert polygons.parse_geometry(big)[0][0].tolist() == [[0, 0], [1, 0], [0, 1], [0, 0]]
    for other in (polygons.to_wkb(p), json.dumps(shape), json.dumps({"type": "Feature", "geometry": shape}), "SRID=4326;" + HOLED):
        q = polygons.parse_geometry(other)
        assert all(np.allclose(a, b) for x, y in zip(p, q, strict=True) for a, b in zip(x, y, strict=True))
    assert polygons.parse_geometry(None) == polygons.parse_geometry("POLYGON EMPTY") == []
    with pytest.raises(ValueError):
        polygons.parse_geometry("POINT(1 2)")


def test_zone_pixels(spark):
    rows = [(1, HOLED), (2, None), (3, "POLYGON((-2 -2, 2 -2, 2 300, -2 300, -2 -2))")]
    zones = spark.createDataFrame(rows, "zone_id int, geometry string")
    t = Affine(2.0, 0.0, 0.0, 0.0, -2.0, 40.0)
    got = polygons.zone_pixels(zones, t, 10, 20).collect()
    assert sum(r.coverage for r in got if r.zone_id == 3) == pytest.approx(20)
    p = polygons.parse_geometry(HOLED)
    want = (ring_area(p[0][0]) - ring_area(p[0][1]) + ring_area(p[1][0])) / 4
    assert sum(r.coverage for r in got if r.zone_id == 1) == pytest.approx(want)
    assert all(r.center_x == 2 * r.col + 1 and r.center_y == 39 - 2 * r.row for r in got)
    raw = spark.createDataFrame([r for r in got if r.zone_id == 1]).drop("centroid_in")
    again = polygons.centroid_coverage(raw, zones).collect()
    assert {(r.col, r.row): r.centroid_in for r in again} == {(r.col, r.row): r.centroid_in for r in got if r.zone_id == 1}


def test_areas():
    south = area.pixel_areas(Affine(1, 0, 11, 0, -1, 49), 0, 0, 1, 1, 20)[0, 0]
    assert south == pytest.approx(8217732076.1, rel=2e-6)
    fine = area.pixel_areas(Affine(0.01, 0, 11, 0, -0.01, 49), 0, 0, 8, 8).sum()
    r = 0.08
    s = lambda d: math.sin(math.radians(d))
    q = lambda d: s(d) / (1 - area.E2 * s(d) ** 2) + math.log((1 + area.E * s(d)) / (1 - area.E * s(d))) / (2 * area.E)
    exact = area.A**2 * (1 - area.E2) / 2 * math.radians(r) * (q(49) - q(49 - r))
    assert fine == pytest.approx(exact, rel=1e-7)
    assert area.block_shape(256, 256) == (256, 256) and area.block_shape(1, 100) == (512, 512)


def test_area_table(spark):
    t = Affine(30, 0, 500000, 0, -30, 5400000)
    rows = area.area_table(spark, 40, 20, t, "EPSG:32632", (16, 16)).collect()
    assert len(rows) == 800 and len({(r.row, r.col) for r in rows}) == 800
    assert all(r.weight == pytest.approx(900 / 0.9996**2, rel=1e-4) for r in rows)


def test_projections():
    for crs, lon, lat in (("EPSG:32632", 11.2, 48.3), ("EPSG:32733", 13.1, -33.0), ("EPSG:3857", -70.0, 20.0)):
        forward, back = projections.projection(crs)
        x, y = forward(lon, lat)
        assert np.allclose(back(x, y), (lon, lat), atol=1e-9)
    x, y = projections.projection("EPSG:32632")[0](9.0, 0.0)
    assert (float(x), float(y)) == pytest.approx((500000, 0), abs=1e-6)
    with pytest.raises(ValueError):
        projections.projection("EPSG:2154")


def test_geotiff_round_trip(spark, tmp_path):
    values = np.arange(2 * 37 * 50, dtype=float).reshape(2, 37, 50)
    values[0, 3, 4] = -9999
    path = str(tmp_path / "dem.tif")
    raster.write_geotiff(path, values, Affine(0.5, 0, 7, 0, -0.5, 50), 4326, tile=16, nodata=-9999)
    meta = raster.read_meta(path)
    assert (meta.width, meta.height, meta.n_bands, meta.crs, meta.nodata, meta.transform) == (50, 37, 2, "EPSG:4326", -9999.0, Affine(0.5, 0, 7, 0, -0.5, 50))
    got = raster.read_raster(spark, [path]).collect()
    assert len(got) == values.size and {r.band_name for r in got} == {"dem_band_1", "dem_band_2"}
    for r in got:
        want = values[r.band - 1, r.row, r.col]
        assert math.isnan(r.value) if want == -9999 else r.value == want
    assert raster.read_raster(spark, [path, str(tmp_path / "none.tif")], fail_on_error=False).count() == values.size
    assert raster._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.5], json.dumps({"type": "Polygon", "coordinates": []}))], "zone_id int, values array<double>, geometry string")
    text = tables.stringify(df, ["values"])
    assert text.first()["values"] == "[1.0,2.5]"
    assert tables.destringify(text, {"values": "array<double>"}).first()["values"] == [1.0, 2.5]
    tables.write_raw(df, str(tmp_path / "z"), "geojson")
    back = tables.read_geojson(spark, str(tmp_path / "z"), "zone_id").first()
    assert back.zone_id == "1" and json.loads(back.geometry)["type"] == "Polygon" and json.loads(back.properties["values"]) == [1.0, 2.5]
    assert tables.normalize_path("/vsis3/b/k.tif") == tables.normalize_path("s3://b/k.tif") == "s3a://b/k.tif"
    assert tables.is_s3("s3://x/y") and not tables.is_s3("/tmp/x")
    assert tables.s3_options("k", "s", requester_pays=True)["fs.s3a.requester.pays.enabled"] == "true"


def test_edges_have_as_many_segments_as_points():
    """With one point an edge a pixel is its four corners; each more adds a segment to every edge."""
    t = Affine(1.0, 0.0, 10.0, 0.0, -1.0, 50.0)
    for n in (1, 2, 3):
        got = area.pixel_areas(t, 0, 0, 1, 1, n)[0, 0]
        s = np.arange(n) / n
        x = np.concatenate([10 + s, np.full(n, 11.0), 11 - s, np.full(n, 10.0)])
        y = np.concatenate([np.full(n, 50.0), 50 - s, np.full(n, 49.0), 49 + s])
        px, py = area.laea(x, y, 10.5, 49.5)
        assert got == pytest.approx(ring_area(np.stack([px, py], 1)), rel=1e-12)
    assert area.pixel_areas(t, 0, 0, 1, 1, 1)[0, 0] != area.pixel_areas(t, 0, 0, 1, 1, 2)[0, 0]
    with pytest.raises(ValueError):
        area.pixel_areas(t, 0, 0, 1, 1, 0)


def test_one_call_extraction(spark, tmp_path):
    from pyspark.sql import functions as F

    from zonarium.operators.extraction import extract_quantity

    t = Affine(1.0, 0.0, 0.0, 0.0, -1.0, 40.0)
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 9, (2, 30, 20)).astype(np.float32), rng.uniform(0, 9, (1, 30, 20)).astype(np.float32)
    a[0, 3, 3] = np.nan
    w = rng.uniform(1, 2, (1, 30, 20)).astype(np.float32)
    for name, v, tile in (("a", a, 16), ("b", b, 32), ("w", w, 16)):
        raster.write_geotiff(f"{tmp_path}/{name}.tif", v, t, tile=tile)
    feature = lambda i, x0, y0, x1, y1: {"type": "Feature", "properties": {"code": f"z{i}", "kind": i}, "geometry": {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}}
    boxes = [(2, 30, 6, 38), (0.5, 12.25, 4, 20), (100, 0, 110, 5)]
    path = f"{tmp_path}/zones.geojson"
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": [feature(i, *x) for i, x in enumerate(boxes)]}, f)
    rasters = [f"{tmp_path}/a.tif", f"file://{tmp_path}/b.tif"]

    def covers(x0, y0, x1, y1):
        c, r = np.arange(20), np.arange(30)
        return np.outer(np.clip(np.minimum(40 - y0, r + 1) - np.maximum(40 - y1, r), 0, None), np.clip(np.minimum(x1, c + 1) - np.maximum(x0, c), 0, None))

    for weights, weight in ((None, np.ones((30, 20))), (f"{tmp_path}/w.tif", w[0].astype(float)), ("trueAreaForFirst", None), ("trueAreaForEach", None)):
        got = {r["code"]: r for r in extract_quantity(spark, rasters, path, weights, ["mean", "weight"], ["centroidBasedWeight"], keep_columns=["kind"], id_column="code", keep_non_intersecting=True).collect()}
        assert set(got) == {"z0", "z1", "z2"} and got["z2"]["a_band_1_mean"] is None and got["z1"]["kind"] == "1"
        for i, box in enumerate(boxes[:2]):
            cover = covers(*box)
            for band, v, block in (("a_band_1", a[0], (16, 16)), ("a_band_2", a[1], (16, 16)), ("b_band_1", b[0], (32, 32))):
                u = weight
                if u is None:
                    bh, bw = (16, 16) if weights == "trueAreaForFirst" else block
                    u = np.block([[area.pixel_areas(t, r, c, min(bh, 30 - r), min(bw, 20 - c)).astype(np.float32) for c in range(0, 20, bw)] for r in range(0, 30, bh)]).astype(float)
                ok = ~np.isnan(v)
                total = (cover * u)[ok].sum()
                assert got[f"z{i}"][f"{band}_weight"] == pytest.approx(total, rel=1e-9)
                assert got[f"z{i}"][f"{band}_mean"] == pytest.approx((cover * u * v)[ok].sum() / total, rel=1e-9)
    with pytest.raises(ValueError):
        extract_quantity(spark, [rasters[0], rasters[0]], path)
    # The raw pixels as a GeoPackage, and zones from one.
    extract_quantity(spark, rasters, path, None, ["mean"], id_column="code", save_raw=f"{tmp_path}/raw.gpkg")
    zones, crs = tables.read_vector(spark, f"{tmp_path}/raw.gpkg", None, "code")
    assert crs == "EPSG:4326" and zones.count() == 3
    again = {r["code"]: r for r in extract_quantity(spark, rasters, f"{tmp_path}/raw.gpkg", None, ["mean"], id_column="code").collect()}
    plain = {r["code"]: r for r in extract_quantity(spark, rasters, path, None, ["mean"], id_column="code").collect()}
    assert {k: r["a_band_1_mean"] for k, r in again.items()} == {k: r["a_band_1_mean"] for k, r in plain.items()}
    numbered = extract_quantity(spark, rasters[0], f"{tmp_path}/raw.gpkg", None, ["weight"]).orderBy("id").collect()
    assert len(numbered) == 2 and "id" in numbered[0].asDict()
    assert zones.select(F.get_json_object("a_band_1_pixels", "$[0].coverage")).where("zone_id = 'z0'").first()[0] is not None


def test_many_polygons_at_once():
    rng = np.random.default_rng(5)
    jobs = []
    for k in range(300):
        a = np.sort(rng.uniform(0, 2 * np.pi, 7))
        ring = rng.uniform(2, 30, 2) + rng.choice([0.2, 3, 9]) * np.stack([np.cos(a), np.sin(a)], axis=1)
        ring = np.round(ring) if k % 3 == 0 else ring
        jobs.append(([[ring]], math.floor(ring[:, 1].min()), math.ceil(ring[:, 1].max()) - 1))
    jobs.append((polygons.parse_geometry(HOLED), 0, 19))
    job, row, col, cover, inside = polygons.covered_cells(jobs)
    for j, (p, r0, r1) in enumerate(jobs):
        own = job == j
        assert cover[own].sum() == pytest.approx(sum(ring_area(r) * (-1) ** (i > 0) for q in p for i, r in enumerate(q)), rel=1e-9, abs=1e-7)
        one = polygons.covered_cells([(p, r0, r1)])
        assert all(np.array_equal(a[own], b) for a, b in zip((row, col, inside), (one[1], one[2], one[4]), strict=True)) and np.allclose(cover[own], one[3], atol=1e-12)
        assert np.array_equal(inside[own], (cover[own] == 1) | polygons.strictly_inside(p, col[own] + 0.5, row[own] + 0.5))
    narrow = polygons.covered_cells(jobs, 12)
    use = (col >= 0) & (col < 12)
    assert np.array_equal(narrow[2], col[use]) and np.allclose(narrow[3], cover[use], atol=1e-12)


def test_zones_of_one_file_are_clipped_by_many_tasks(spark):
    zones = spark.range(0, 400, 1, 1).selectExpr("id AS zone_id", "concat('POLYGON((', id, ' 0, ', id + 2, ' 0, ', id, ' 300, ', id, ' 0))') AS geometry")
    tasks = polygons.zone_pixels(zones, Affine()).groupBy(area.F.spark_partition_id().alias("p")).agg(area.F.sum("coverage").alias("s")).collect()
    assert len(tasks) > 2 and sum(t.s for t in tasks) == pytest.approx(400 * 300)


def test_pixels_of_zones_are_not_broadcast(spark, tmp_path):
    from zonarium.operators.extraction import extract_pixels

    raster.write_geotiff(str(tmp_path / "a.tif"), np.ones((1, 100, 100)), Affine(1, 0, 0, 0, 1, 0))
    raster.write_geotiff(str(tmp_path / "b.tif"), np.ones((1, 600, 600)), Affine(1, 0, 0, 0, 1, 0))
    zones = spark.createDataFrame([(1, "POLYGON((0 0, 9 0, 0 9, 0 0))")], "zone_id int, geometry string")
    for name, side in (("a", "BuildRight"), ("b", "SortMergeJoin")):
        pixels = extract_pixels(spark, [str(tmp_path / f"{name}.tif")], zones)
        plan = pixels._jdf.queryExecution().executedPlan().toString()
        assert side in plan and "BuildLeft" not in plan
        assert pixels.agg(area.F.sum("coverage")).first()[0] == pytest.approx(40.5)


def test_rectangles_are_not_broadcast(spark):
    from zonarium.operators.grid import rectangle_pixels

    zones = spark.range(0, 200, 1, 1).selectExpr("id AS zone_id", "id % 50 AS x0", "0L AS y0", "id % 50 + 15 AS x1", "25L AS y1")
    pixels = spark.range(10000).selectExpr("id % 100 AS col", "id div 100 AS row", "id AS value")
    for given, join in ((area.F.broadcast(pixels), "BuildRight"), (pixels, "SortMergeJoin")):
        out = rectangle_pixels(zones, given, 10)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert join in plan and "BuildLeft" not in plan and "REPARTITION_BY_NUM" in plan
        assert out.agg(area.F.sum("coverage")).first()[0] == 200 * 15 * 25
