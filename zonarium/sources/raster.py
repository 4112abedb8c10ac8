"""GeoTIFF as a Spark data source: long pixels, one input partition for each tile or strip, read by range.

    spark.dataSource.register(RasterDataSource)
    spark.read.format("raster").option("path", "a.tif").load()   # band_name, band, row, col, value

Baseline and BigTIFF files, tiled or striped, any band count, chunky or planar, integers and floats, uncompressed,
deflate or LZW, with predictors 1 to 3. Other compressions are refused by name.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from zonarium.operators.grid import Affine

_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
SCHEMA = "band_name string, band int, row long, col long, value double"


@dataclass
class RasterMeta:
    path: str
    width: int
    height: int
    n_bands: int
    transform: Affine
    crs: str | None
    nodata: float | None
    block_h: int
    block_w: int
    dtype: str
    order: str
    compression: int
    predictor: int
    planar: bool
    offsets: list[int] = field(repr=False, default_factory=list)
    counts: list[int] = field(repr=False, default_factory=list)


def _lzw(data: bytes) -> bytes:
    out, table, bits, width, at = [], [], 0, 9, 0
    n, last = len(data) * 8, None
    value = int.from_bytes(data, "big")
    while at + width <= n:
        code = value >> (n - at - width) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        bits = len(table) + 1
        width = 9 if bits < 512 else 10 if bits < 1024 else 11 if bits < 2048 else 12
    return b"".join(out)


def stem_of(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def open_file(path: str, options: dict | None = None):
    """A file to seek and read in: of the mounted file system, or of an object store by range requests."""
    from zonarium.sources.tables import is_s3, normalize_path

    if not is_s3(path) and "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    if not is_s3(path):
        store, inner = fs.FileSystem.from_uri(path)
    else:
        o = options or {}
        given = {"access_key": o.get("fs.s3a.access.key"), "secret_key": o.get("fs.s3a.secret.key"), "endpoint_override": o.get("fs.s3a.endpoint"), "region": o.get("fs.s3a.endpoint.region")}
        store, inner = fs.S3FileSystem(**{k: v for k, v in given.items() if v}), normalize_path(path)[6:]
    return store.open_input_file(inner)


def read_meta(path: str, options: dict | None = None) -> RasterMeta:
    with open_file(path, options) as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None:
            raise ValueError(f"{path} is no TIFF file")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size = 20 if big else 12
        entries = f.read(n * size)
        tags = {}
        for i in range(n):
            tag, kind = struct.unpack_from(order + "HH", entries, i * size)
            count = struct.unpack_from(order + ("Q" if big else "I"), entries, i * size + 4)[0]
            code = _SIZES.get(kind)
            if code is None:
                continue
            length = struct.calcsize(order + code) * count
            inline = 8 if big else 4
            raw = entries[i * size + size - inline : (i + 1) * size]
            if length > inline:
                f.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
                raw = f.read(length)
            tags[tag] = raw[:length].rstrip(b"\0").decode("latin-1") if kind == 2 else list(struct.unpack(order + code * count, raw[:length]))
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, bands = one(256), one(257), one(277, 1)
    bits, sample = one(258, 1), one(339, 1)
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{path}: {bits} bits a sample are not read")
    dtype = {1: "u", 2: "i", 3: "f"}.get(sample, "u") + str(bits // 8)
    compression = one(259, 1)
    if compression not in (1, 5, 8, 32946):
        raise ValueError(f"{path}: compression {compression} is not read (uncompressed, LZW and deflate are)")
    tiled = 322 in tags
    block_w, block_h = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    if 34264 in tags:
        m = tags[34264]
        transform = Affine(m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in tags and 33922 in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
        transform = Affine(sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = Affine()
    crs, keys = None, tags.get(34735, [])
    for k in range(4, len(keys), 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0 and keys[k + 3] != 32767:
            crs = f"EPSG:{keys[k + 3]}"
    nodata = float(tags[42113]) if 42113 in tags and tags[42113].strip() else None
    return RasterMeta(path, width, height, bands, transform, crs, nodata, block_h, block_w, dtype, order, compression, one(317, 1), one(284, 1) == 2, tags.get(324) or tags[273], tags.get(325) or tags[279])


def read_block(meta: RasterMeta, index: int, file) -> tuple[int, int, list[int], np.ndarray]:
    """First row and column, bands, and values (rows x columns x bands) of one tile or strip."""
    file.seek(meta.offsets[index])
    return decode_block(meta, index, file.read(meta.counts[index]), len(meta.offsets))


def decode_block(meta: RasterMeta, index: int, data: bytes, n_blocks: int) -> tuple[int, int, list[int], np.ndarray]:
    across, down = -(-meta.width // meta.block_w), -(-meta.height // meta.block_h)
    plane, place = divmod(index, across * down) if meta.planar else (0, index)
    row, col = place // across * meta.block_h, place % across * meta.block_w
    bands = [plane + 1] if meta.planar else list(range(1, meta.n_bands + 1))
    data = data if meta.compression == 1 else _lzw(data) if meta.compression == 5 else zlib.decompress(data)
    size, k = int(meta.dtype[1:]), len(bands)
    tiled = meta.block_w != meta.width or n_blocks != down * (meta.n_bands if meta.planar else 1)
    rows = meta.block_h if tiled or len(data) >= meta.block_h * meta.block_w * k * size else min(meta.block_h, meta.height - row)
    if meta.predictor == 3:
        b = np.frombuffer(data, np.uint8).reshape(rows, size, meta.block_w * k)
        b = np.cumsum(b.reshape(rows, -1).reshape(rows, -1, k), axis=1, dtype=np.uint8).reshape(rows, size, meta.block_w * k)
        values = np.ascontiguousarray(b.transpose(0, 2, 1)).view(">" + meta.dtype).reshape(rows, meta.block_w, k)
    else:
        values = np.frombuffer(data, meta.order + meta.dtype, rows * meta.block_w * k).reshape(rows, meta.block_w, k)
        if meta.predictor == 2:
            values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
    return row, col, bands, values[: meta.height - row, : meta.width - col].astype(float)


class _Block(InputPartition):
    """One tile or strip, with its own place in the file and not the others'."""

    def __init__(self, meta: RasterMeta, index: int, offset: int, count: int, n_blocks: int, stem: str) -> None:
        self.meta, self.index, self.offset, self.count, self.n_blocks, self.stem = meta, index, offset, count, n_blocks, stem


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for part in options["path"].split(",") for p in (sorted(glob.glob(part)) or [part])]
        self.options = {k: v for k, v in options.items() if k.startswith("fs.s3a.")}
        self.lenient = str(options.get("failOnError", "true")).lower() == "false"

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            try:
                meta = read_meta(path, self.options)
            except (OSError, ValueError):
                if self.lenient:
                    continue
                raise
            stem = stem_of(path)
            bare = replace(meta, offsets=[], counts=[])
            out += [_Block(bare, i, at, n, len(meta.offsets), stem) for i, (at, n) in enumerate(zip(meta.offsets, meta.counts, strict=True))]
        return out

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        meta = partition.meta
        with open_file(meta.path, self.options) as f:
            f.seek(partition.offset)
            row, col, bands, values = decode_block(meta, partition.index, f.read(partition.count), partition.n_blocks)
        h, w, _ = values.shape
        for k, b in enumerate(bands):
            v = values[:, :, k].ravel()
            v = np.where(v == meta.nodata, np.nan, v) if meta.nodata is not None else v
            n = h * w
            yield pa.RecordBatch.from_arrays([pa.array([f"{partition.stem}_band_{b}"] * n), pa.array(np.full(n, b, np.int32)), pa.array(np.repeat(np.arange(row, row + h), w)), pa.array(np.tile(np.arange(col, col + w), h)), pa.array(v)], names=["band_name", "band", "row", "col", "value"])


class RasterDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_raster(spark: SparkSession, paths: str | list[str], fail_on_error: bool = True, options: dict[str, str] | None = None) -> DataFrame:
    """band_name ({stem}_band_{b}), band, row, col, value of GeoTIFF files of one grid; nodata is NaN.

    options: those of s3_options for paths in object stores; they hold for this read alone.
    """
    spark.dataSource.register(RasterDataSource)
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("raster").option("path", ",".join(paths)).option("failOnError", str(fail_on_error).lower()).options(**(options or {})).load()


def write_geotiff(path: str, values: np.ndarray, transform: Affine, epsg: int = 4326, tile: int = 256, nodata: float | None = None) -> None:
    """A small tiled deflate float32 GeoTIFF from an array (bands x rows x columns), written whole and then named."""
    bands, height, width = values.shape
    blocks = []
    for b in range(bands):
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                block = np.zeros((tile, tile), "<f4")
                part = values[b, r : r + tile, c : c + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(zlib.compress(block.tobytes()))
    key = 2048 if epsg == 4326 else 3072
    tags: list[tuple[int, int, list | bytes]] = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [32] * bands), (259, 3, [8]), (262, 3, [1]), (277, 3, [bands]), (284, 3, [2]), (322, 4, [tile]), (323, 4, [tile]),
        (324, 4, []), (325, 4, [len(b) for b in blocks]), (339, 3, [3] * bands), (34264, 12, [transform.a, transform.b, 0, transform.c, transform.d, transform.e, 0, transform.f, 0, 0, 0, 0, 0, 0, 0, 1]),
        (34735, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, key, 0, 1, epsg]),
    ]
    if nodata is not None:
        tags.append((42113, 2, f"{nodata}\0".encode()))
    start = 8
    offsets = []
    for b in blocks:
        offsets.append(start)
        start += len(b)
    tags = [(t, k, offsets if t == 324 else v) for t, k, v in tags]
    extra_at = start + 2 + 12 * len(tags) + 4
    ifd, extra = struct.pack("<H", len(tags)), b""
    for t, k, v in tags:
        raw = v if isinstance(v, bytes) else struct.pack("<" + {3: "H", 4: "I", 12: "d"}[k] * len(v), *v)
        count = len(raw) if isinstance(v, bytes) else len(v)
        if len(raw) > 4:
            ifd += struct.pack("<HHII", t, k, count, extra_at + len(extra))
            extra += raw
        else:
            ifd += struct.pack("<HHI", t, k, count) + raw.ljust(4, b"\0")
    with open(path + ".part", "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", start) + b"".join(blocks) + ifd + struct.pack("<I", 0) + extra)
    os.replace(path + ".part", path)
