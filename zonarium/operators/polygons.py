"""Polygon zones over a grid: exact coverage by clipping, and the strict centre test.

Geometries are WKB, WKT or GeoJSON (polygons and multipolygons). A zone explodes to row bands of the grid, so that a
large one is cut over many tasks; each band is clipped in a worker and yields its touched pixels.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.operators.grid import Affine, dealt_out

#: Grid rows of a zone that one task row clips.
BAND_ROWS = 64
#: Cells of polygons' bounding boxes that are clipped at once.
_CELLS = 200_000
_SNAP = 1e-9


def _wkb(data: bytes) -> list[list[np.ndarray]]:
    at = 0

    def geometry() -> list[list[np.ndarray]]:
        nonlocal at
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if kind & 0x20000000:
            at += 4
        extra = bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind &= 0x1FFFFFFF
        extra += {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
        kind %= 1000
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if kind == 3:
            rings = []
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", data, at)
                ring = np.frombuffer(data, order + "f8", m * (2 + extra), at + 4).reshape(m, 2 + extra)[:, :2].astype(float)
                at += 4 + m * 8 * (2 + extra)
                rings.append(ring)
            return [rings] if rings else []
        if kind in (6, 7):
            return [p for _ in range(n) for p in geometry()]
        raise ValueError(f"only polygons and multipolygons are zones, not WKB kind {kind}")

    return geometry()


def _wkt(text: str) -> list[list[np.ndarray]]:
    text = re.sub(r"^\s*SRID=\d+;", "", text, flags=re.I)
    kind = re.match(r"\s*(MULTIPOLYGON|POLYGON)\s*(?:ZM|Z|M)?\s*(.*)$", text, re.I | re.S)
    if not kind:
        raise ValueError(f"only polygons and multipolygons are zones, not {text[:30]!r}")
    if kind[2].strip().upper() == "EMPTY":
        return []
    body = re.sub(r"([-+0-9.eE]+(?:\s+[-+0-9.eE]+)+)", lambda m: "[" + ",".join(m[1].split()) + "]", kind[2])
    nested = json.loads(body.replace("(", "[").replace(")", "]"))
    return [[np.array(r, float)[:, :2] for r in p] for p in (nested if kind[1].upper().startswith("M") else [nested])]


def parse_geometry(value: bytes | bytearray | str | None) -> list[list[np.ndarray]]:
    """Polygons, each a list of rings (the outer one first) of points."""
    if value is None:
        return []
    if isinstance(value, (bytes, bytearray)):
        return _wkb(bytes(value))
    if value.lstrip().startswith("{"):
        g = json.loads(value)
        g = g.get("geometry", g) or {}
        if g.get("type") not in ("Polygon", "MultiPolygon"):
            raise ValueError(f"only polygons and multipolygons are zones, not {g.get('type')!r}")
        parts = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
        return [[np.array(r, float)[:, :2] for r in p] for p in parts if p]
    return _wkt(value)


def to_wkb(polygons: list[list[np.ndarray]]) -> bytes:
    parts = [struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in p) for p in polygons]
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(parts)


def transformed(polygons: list[list[np.ndarray]], f) -> list[list[np.ndarray]]:
    return [[np.stack(f(r[:, 0], r[:, 1]), axis=1) for r in p] for p in polygons]


def strictly_inside(polygons: list[list[np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd test; points on an edge are outside."""
    inside, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for rings in polygons:
        for ring in rings:
            ax, ay = ring.T
            bx, by = np.roll(ax, -1), np.roll(ay, -1)
            for x0, y0, x1, y1 in zip(ax, ay, bx, by, strict=True):
                if x0 == x1 and y0 == y1:
                    continue
                cross = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
                edge |= (cross == 0) & (x >= min(x0, x1)) & (x <= max(x0, x1)) & (y >= min(y0, y1)) & (y <= max(y0, y1))
                if y0 != y1:
                    crosses = (y0 > y) != (y1 > y)
                    inside ^= crosses & ((cross > 0) == (y1 > y0))
    return inside & ~edge


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place its number as often as its count, and which of its repetitions each is."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def covered_cells(jobs: list[tuple[list[list[np.ndarray]], int, int]], width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place in jobs, row, column, coverage and whether the centre is strictly inside, of all touched cells of all jobs.

    A job is polygons in cell coordinates and its first and last row; width bounds the columns. Each edge is cut at the
    rows and gives each cell right of it, within its row, the height it passes there: a ring's sum is its signed area in
    the cell. Cells that no boundary passes are inside or outside as a whole, so their coverage is exactly 1 or 0.
    Holes count against their outer ring, parts of a multipolygon add up.
    """
    rings = [(r, i == 0, j) for j, (p, _, _) in enumerate(jobs) for q in p for i, r in enumerate(q) if len(r)]
    none = np.zeros(0, np.int64)
    if not rings:
        return none, none, none, np.zeros(0), np.zeros(0, bool)
    sizes, owner = np.array([len(r) for r, _, _ in rings]), np.array([j for _, _, j in rings])
    sign = np.where([outer for _, outer, _ in rings], 1.0, -1.0)
    first, last = (np.array([job[k] for job in jobs], np.int64) for k in (1, 2))
    x0, y0 = np.concatenate([r for r, _, _ in rings]).T
    ends = np.cumsum(sizes)
    after = np.arange(1, len(x0) + 1)
    after[ends - 1] = ends - sizes
    x1, y1, ring = x0[after], y0[after], np.repeat(np.arange(len(rings)), sizes)
    whole = lambda v: v.astype(np.int64)
    west, east, south, north = (f.reduceat(v, ends - sizes) for f, v in ((np.minimum, x0), (np.maximum, x0), (np.minimum, y0), (np.maximum, y0)))

    # Columns of each job, and rows and columns of each ring with one place more for what passes beyond its last cell.
    c0, c1 = np.full(len(jobs), np.inf), np.full(len(jobs), -np.inf)
    np.minimum.at(c0, owner, west)
    np.maximum.at(c1, owner, east)
    some = np.isfinite(c0)
    c0, c1 = whole(np.floor(np.where(some, c0, 0))), whole(np.ceil(np.where(some, c1, 0))) - 1
    if width is not None:
        c0, c1 = np.maximum(c0, 0), np.minimum(c1, width - 1)
    wide, high = np.where(some, np.maximum(c1 - c0 + 1, 0), 0), np.maximum(last - first + 1, 0)
    base = np.cumsum(wide * high) - wide * high
    r0, r1 = np.maximum(first[owner], whole(np.floor(south))), np.minimum(last[owner], whole(np.ceil(north)) - 1)
    k0, k1 = np.maximum(c0[owner], whole(np.floor(west - _SNAP))), np.minimum(c1[owner], whole(np.floor(east + _SNAP)))
    rows, columns = np.maximum(r1 - r0 + 1, 0), np.maximum(k1 - k0 + 1, 0)
    rows = np.where(columns > 0, rows, 0)
    start = np.cumsum(rows * (columns + 1)) - rows * (columns + 1)
    places = int((rows * (columns + 1)).sum())

    # Edges by row, then by column.
    low, high_y = np.minimum(y0, y1), np.maximum(y0, y1)
    ra, rb = np.maximum(r0[ring], whole(np.ceil(low)) - 1), np.minimum(r1[ring], whole(np.floor(high_y)))
    e, step = _spread(np.where((rows[ring] > 0) & (rb >= ra), rb - ra + 1, 0))
    row = ra[e] + step
    dy = y1[e] - y0[e]
    flat = dy == 0
    slope = np.where(flat, 1.0, dy)
    t, u = (row - y0[e]) / slope, (row + 1 - y0[e]) / slope
    t, u = np.where(flat, 0.0, np.maximum(np.minimum(t, u), 0.0)), np.where(flat, 1.0, np.minimum(np.maximum(t, u), 1.0))
    use = t <= u
    e, row, t, u = e[use], row[use], t[use], u[use]
    dx, g = x1[e] - x0[e], ring[e]
    xa, xb = x0[e] + dx * t, x0[e] + dx * u
    lo, hi = np.minimum(xa, xb), np.maximum(xa, xb)
    dy = np.clip(y1[e], row, row + 1) - np.clip(y0[e], row, row + 1)
    at = start[g] + (row - r0[g]) * (columns[g] + 1)
    ca, cb = whole(np.floor(lo - _SNAP)), whole(np.floor(hi + _SNAP))
    carry = np.bincount(at + np.clip(cb + 1 - k0[g], 0, columns[g]), dy, places)
    ca, cb = np.maximum(ca, k0[g]), np.minimum(cb, k1[g])
    s, step = _spread(np.maximum(cb - ca + 1, 0))
    c, lo, hi = ca[s] + step, lo[s], hi[s]
    span = hi - lo
    wide_enough = np.where(span > 0, span, 1.0)
    left = np.where(span > 0, (np.clip(c, lo, hi) - lo) / wide_enough, lo < c)
    within = np.where(span > 0, np.maximum(np.minimum(hi, c + 1) - np.maximum(lo, c), 0) / wide_enough, (lo >= c) & (lo < c + 1))
    share = left + within * (c + 1 - (np.maximum(lo, c) + np.minimum(hi, c + 1)) / 2)
    place = at[s] + c - k0[g[s]]
    own = np.bincount(place, share * dy[s], places)
    passed = np.zeros(places, bool)
    passed[place] = True

    # Areas of each ring, summed up along its rows, then by cell.
    total = np.cumsum(carry)
    line, step = _spread(rows)
    begins = start[line] + step * (columns[line] + 1)
    before = total[begins] - carry[begins]
    q, step2 = _spread(columns[line])
    where = begins[q] + step2
    area = np.abs(own[where] + total[where] - before[q])
    o = owner[line[q]]
    cell = base[o] + (r0[line[q]] + step[q] - first[o]) * wide[o] + k0[line[q]] + step2 - c0[o]
    cells = int((wide * high).sum())
    summed = np.bincount(cell, sign[line[q]] * area, cells)
    odd = np.bincount(cell, np.rint(area), cells) % 2 == 1
    boundary = np.zeros(cells, bool)
    boundary[cell[passed[where]]] = True
    cover = np.where(boundary, np.where(summed > 1 - _SNAP, 1.0, np.where(summed < _SNAP, 0.0, summed)), odd.astype(float))
    keep = np.flatnonzero(cover > 0)
    job = np.searchsorted(base + wide * high, keep, side="right")
    down, across = np.divmod(keep - base[job], wide[job])
    cover, row_of, col_of = cover[keep], first[job] + down, c0[job] + across

    # The centres of cells that are covered in part, against the edges that pass their height.
    inside = cover == 1.0
    part = np.flatnonzero(~inside)
    lines = np.cumsum(high) - high
    key = lines[job[part]] + down[part]
    real = (x0 != x1) | (y0 != y1)
    of = owner[ring]
    ra, rb = np.maximum(first[of], whole(np.ceil(low - 0.5))), np.minimum(last[of], whole(np.floor(high_y - 0.5)))
    e, step = _spread(np.where(real & (rb >= ra), rb - ra + 1, 0))
    mine = lines[of[e]] + ra[e] + step - first[of[e]]
    begin, end = np.searchsorted(key, mine), np.searchsorted(key, mine, side="right")
    e, begin, n = e[end > begin], begin[end > begin], (end - begin)[end > begin]
    turns, edge = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
    slices = [*np.flatnonzero(np.diff(np.cumsum(n) // _CELLS, prepend=-1)), len(n)] if len(n) else []
    for a, b in zip(slices, slices[1:]):
        s, step = _spread(n[a:b])
        k, p = e[a:b][s], begin[a:b][s] + step
        x, y = col_of[part[p]] + 0.5, row_of[part[p]] + 0.5
        cross = (x1[k] - x0[k]) * (y - y0[k]) - (y1[k] - y0[k]) * (x - x0[k])
        on = (cross == 0) & (x >= np.minimum(x0[k], x1[k])) & (x <= np.maximum(x0[k], x1[k])) & (y >= low[k]) & (y <= high_y[k])
        edge[p[on]] = True
        turns += np.bincount(p[((y0[k] > y) != (y1[k] > y)) & ((cross > 0) == (y1[k] > y0[k]))], minlength=len(part))
    inside[part] = (turns % 2 == 1) & ~edge
    return job, row_of, col_of, cover, inside


def _pieces(polygons: list[list[np.ndarray]], first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of rows with about _CELLS cells at most, one row at least: first row, last row, cells."""
    x = [r[:, 0] for p in polygons for r in p if len(r)]
    if not x:
        return
    across = max(1, math.ceil(max(float(v.max()) for v in x)) - math.floor(min(float(v.min()) for v in x)))
    step = max(1, _CELLS // across)
    for r in range(first, last + 1, step):
        end = min(last, r + step - 1)
        yield r, end, (end - r + 1) * across


def coverage_rows(polygons: list[list[np.ndarray]], first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, columns, coverage) of the grid rows first..last, in cell coordinates."""
    for r0, r1, _ in _pieces(polygons, first, last):
        _, row, col, cover, _ = covered_cells([(polygons, r0, r1)])
        for r in np.unique(row):
            yield int(r), col[row == r], cover[row == r]


_OUT = "coverage double, col long, row long, center_x double, center_y double, centroid_in boolean"


def zone_pixels(zones: DataFrame, transform: Affine, width: int | None = None, height: int | None = None, zone_crs: str = "EPSG:4326", raster_crs: str | None = None) -> DataFrame:
    """zone_id, coverage, col, row, center_x, center_y, centroid_in of each pixel that a zone touches.

    zones: zone_id and geometry in zone_crs; the centre test is made in the raster's CRS. Width and height bound the
    grid, where given. Null and empty geometries touch nothing.
    """
    from zonarium.operators.projections import between

    move = between(zone_crs, raster_crs) if raster_crs and raster_crs != zone_crs else None
    kind = dict(zones.dtypes)["zone_id"]

    def cells(values: list) -> list[list[list[np.ndarray]]]:
        """The polygons of each value in cell coordinates, all points moved at once."""
        parsed = [parse_geometry(v) for v in values]
        rings = [r for p in parsed for q in p for r in q]
        if not rings:
            return parsed
        x, y = np.concatenate(rings).T
        x, y = move(x, y) if move else (x, y)
        points, ends = np.stack(transform.cell(x, y), axis=1), np.cumsum([len(r) for r in rings]).tolist()
        moved = iter([points[a:b] for a, b in zip([0, *ends], ends)])
        return [[[next(moved) for _ in q] for q in p] for p in parsed]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, moved = [], [], []
            for p in cells(batch.column("geometry").to_pylist()):
                y = [r[:, 1] for q in p for r in q if len(r)]
                lo, hi = (math.floor(min(float(v.min()) for v in y)), math.ceil(max(float(v.max()) for v in y)) - 1) if y else (0, -1)
                first.append(max(0, lo) if height is not None else lo)
                last.append(min(height - 1, hi) if height is not None else hi)
                moved.append(to_wkb(p))
            yield pa.RecordBatch.from_arrays([batch.column("zone_id"), pa.array(moved, pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["zone_id", "cells", "first", "last"])

    def clipped(ids: list, jobs: list, zone_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        job, row, col, cover, inside = covered_cells(jobs, width)
        zone = pa.array(ids, zone_type).take(pa.array(job))
        x, y = (np.broadcast_to(np.asarray(v, float), len(job)) for v in transform.point(col + 0.5, row + 0.5))
        whole = pa.RecordBatch.from_arrays([zone, *(pa.array(v) for v in (cover, col, row, x, y, inside))], names=["zone_id", "coverage", "col", "row", "center_x", "center_y", "centroid_in"])
        for at in range(0, len(job), 20_000):
            yield whole.slice(at, 20_000)

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone_type, ids, jobs, held = None, [], [], 0
        for batch in batches:
            zone_type = batch.schema.field("zone_id").type
            values = batch.column("cells")
            for i, (zone, (row0, row1)) in enumerate(zip(batch.column("zone_id").to_pylist(), batch.column("band").to_pylist(), strict=True)):
                p = _wkb(values[i].as_py())
                for first, last, n in _pieces(p, row0, min(row1, row0 + BAND_ROWS - 1)):
                    if jobs and held + n > _CELLS:
                        yield from clipped(ids, jobs, zone_type)
                        ids, jobs, held = [], [], 0
                    ids.append(zone)
                    jobs.append((p, first, last))
                    held += n
        if jobs:
            yield from clipped(ids, jobs, zone_type)

    # Zones often come from one small file: they are dealt out to all cores before they are read, and their bands again
    # before they are clipped.
    spans = dealt_out(zones.select("zone_id", "geometry"), "zone_id").mapInArrow(bounds, f"zone_id {kind}, cells binary, first long, last long").where("last >= first")
    bands = spans.select("zone_id", "cells", F.explode(F.sequence("first", "last", F.lit(BAND_ROWS).cast("long"))).alias("r"), "last").select("zone_id", "cells", F.array("r", "last").alias("band"))
    return dealt_out(bands, "zone_id", "band").mapInArrow(clip, f"zone_id {kind}, {_OUT}")


def reproject(zones: DataFrame, source: str, target: str) -> DataFrame:
    """zones with geometry as WKB in the target CRS."""
    from zonarium.operators.projections import between

    f = between(source, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = [None if v is None else to_wkb(transformed(parse_geometry(v), f)) for v in batch.column("geometry").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("geometry"), "geometry", pa.array(moved, pa.binary()))

    schema = ", ".join(f"`{n}` {'binary' if n == 'geometry' else t}" for n, t in zones.dtypes)
    return zones.mapInArrow(run, schema)


def centroid_coverage(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """pixels (zone_id, coverage, center_x, center_y, ...) with centroid_in: fully covered, or the centre strictly inside."""

    names = pixels.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            values = batch.column("_geometry").to_pylist()
            cover, x, y = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("coverage", "center_x", "center_y"))
            out, at = np.asarray(cover == 1.0), 0
            while at < len(values):
                # The pixels of a zone come together: one test for each stretch of one geometry.
                end = at + 1
                while end < len(values) and (values[end] is values[at] or values[end] == values[at]):
                    end += 1
                if known[0] != values[at]:
                    known = (values[at], parse_geometry(values[at]))
                out[at:end] |= strictly_inside(known[1], x[at:end], y[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(out, pa.bool_())], names=[*names, "centroid_in"])

    joined = pixels.join(zones.select("zone_id", F.col("geometry").alias("_geometry")), "zone_id")
    return joined.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in pixels.dtypes) + ", centroid_in boolean")
