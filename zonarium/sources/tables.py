"""Zones, stored extractions and object-store options: what goes between files and tables."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stringify(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Array, map and struct columns as JSON text, for formats without them."""
    nested = columns or [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}) if nested else df


def destringify(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """The JSON text columns of stringify as what they were; schemas names their types."""
    return df.withColumns({c: F.from_json(F.col(f"`{c}`"), t) for c, t in schemas.items()}) if schemas else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, as the operating system names it; only local runs may do without that setting."""
    import atexit
    import os
    import shutil
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="zonarium-")
        atexit.register(shutil.rmtree, path, True)
        return path
    root = root[7:] if root.startswith("file://") else root[5:] if root.startswith("file:") else root
    os.makedirs(path := f"{root.rstrip('/')}/zonarium/{uuid.uuid4().hex}")
    return path


def normalize_path(path: str) -> str:
    """/vsis3/bucket/key and s3://bucket/key as s3a://bucket/key; other paths as they are."""
    if "/vsis3/" in path:
        return "s3a://" + path.split("/vsis3/", 1)[1]
    return "s3a://" + path[5:] if path.startswith("s3://") else path


def is_s3(path: str) -> bool:
    return normalize_path(path).startswith("s3a://")


def s3_options(key: str | None = None, secret: str | None = None, endpoint: str | None = None, requester_pays: bool = False, region: str | None = None) -> dict[str, str]:
    """Reader options of one read; nothing global changes."""
    given = {"fs.s3a.access.key": key, "fs.s3a.secret.key": secret, "fs.s3a.endpoint": endpoint, "fs.s3a.endpoint.region": region}
    return {k: v for k, v in given.items() if v} | ({"fs.s3a.requester.pays.enabled": "true"} if requester_pays else {})


def read_geojson(spark: SparkSession, path: str, id_property: str | None = None) -> DataFrame:
    """zone_id, geometry (GeoJSON text) and properties (a map of text) of a FeatureCollection or of one feature a line."""
    docs = spark.read.option("wholetext", "true").text(normalize_path(path))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for text in batch["value"]:
                try:
                    whole = json.loads(text)
                    features = whole["features"] if whole.get("type") == "FeatureCollection" else [whole]
                except json.JSONDecodeError:
                    features = [json.loads(line) for line in text.splitlines() if line.strip()]
                for i, f in enumerate(features):
                    p = f.get("properties") or {}
                    own = p.get(id_property) if id_property else f.get("id", i)
                    rows.append((str(own), json.dumps(f.get("geometry")) if f.get("geometry") else None, {k: v if isinstance(v, str) else json.dumps(v) for k, v in p.items()}))
            yield pd.DataFrame(rows, columns=["zone_id", "geometry", "properties"])

    return docs.mapInPandas(run, "zone_id string, geometry string, properties map<string,string>")


def write_geojson(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """One feature a line; the geometry column holds GeoJSON text, all others become properties."""
    rest = [c for c in df.columns if c != geometry]
    props = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest)), {"ignoreNullFields": "false"})
    line = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))
    df.select(line.alias("value")).write.mode("error").text(path)


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None, number: str | None = None) -> DataFrame:
    """A GeoPackage layer: its attribute columns and geometry as WKB; number names a column of row numbers.

    The file is read where the driver runs.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        layers = db.execute("select table_name, column_name from gpkg_geometry_columns").fetchall()
        name, geometry = next((x for x in layers if layer in (None, x[0])), (None, None))
        if name is None:
            raise ValueError(f"{path} has no layer {layer!r}")
        cursor = db.execute(f'select * from "{name.replace(chr(34), chr(34) * 2)}"')
        columns = [c[0] for c in cursor.description]
        rows = []
        for r in cursor:
            r = dict(zip(columns, r, strict=True))
            blob = r.pop(geometry)
            if blob is not None:
                size = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
                blob = bytearray(blob[8 + size :])
            rows.append(tuple(r.values()) + ((len(rows),) if number else ()) + (blob,))
    kinds = {int: "bigint", float: "double", str: "string", bytes: "binary"}
    rest = [c for c in columns if c != geometry]
    schema = ", ".join(f"`{c}` {next((kinds[type(r[i])] for r in rows if r[i] is not None), 'string')}" for i, c in enumerate(rest))
    return spark.createDataFrame(rows, (schema + ", " if schema else "") + (f"`{number}` bigint, " if number else "") + "geometry binary")


def gpkg_crs(path: str, layer: str | None = None) -> str | None:
    """The CRS of a GeoPackage layer as authority and code; None where it is undefined."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = db.execute("select g.table_name, s.organization, s.organization_coordsys_id from gpkg_geometry_columns g join gpkg_spatial_ref_sys s on g.srs_id = s.srs_id").fetchall()
    return next((f"{org.upper()}:{code}" for name, org, code in found if layer in (None, name) and org.upper() != "NONE"), None)


def read_vector(spark: SparkSession, path: str, layer: str | None = None, id_column: str | None = None) -> tuple[DataFrame, str]:
    """Zones of a GeoJSON or GeoPackage file, told apart by its ending: zone_id, geometry and the other columns; and their CRS.

    zone_id is id_column, or else the number of the feature in the file.
    """
    if path.lower().endswith(".gpkg"):
        df = read_gpkg(spark, path, layer, None if id_column else "zone_id")
        return df.withColumn("zone_id", F.col(f"`{id_column}`")) if id_column else df, gpkg_crs(path, layer) or "EPSG:4326"
    if path.lower().endswith((".geojson", ".json", ".geojsonl", ".ndjson")):
        return read_geojson(spark, path, id_column), "EPSG:4326"
    raise ValueError(f"{path}: zones are read from GeoJSON and GeoPackage files")


def write_gpkg(df: DataFrame, path: str, layer: str = "extraction", geometry: str = "geometry", crs: str = "EPSG:4326") -> None:
    """One layer of a new GeoPackage: a file of one writer by its format, so rows pass the driver, partition by partition."""
    import os
    import struct

    from zonarium.operators.polygons import parse_geometry, to_wkb

    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    code = int(crs.rpartition(":")[2])
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    rest = [(c, kinds.get(t, "TEXT")) for c, t in df.dtypes if c != geometry]
    fid = next(x for x in ("fid", "fid_1", "fid_2", "fid_3") if x not in {c.lower() for c, _ in rest})
    if os.path.exists(path):
        raise FileExistsError(path)
    part = f"{path}.part"
    if os.path.exists(part):
        os.remove(part)
    db = sqlite3.connect(part)
    try:
        db.execute("PRAGMA application_id = 0x47504B47")
        db.execute("PRAGMA user_version = 10300")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", [("undefined cartesian", -1, "NONE", -1, "undefined"), ("undefined geographic", 0, "NONE", 0, "undefined"), (crs, code, "EPSG", code, "undefined")])
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, code))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 0, 0)", (layer, geometry, code))
        db.execute(f"CREATE TABLE {quoted(layer)} ({', '.join([f'{fid} INTEGER PRIMARY KEY AUTOINCREMENT', f'{quoted(geometry)} GEOMETRY', *(f'{quoted(c)} {t}' for c, t in rest)])})")
        insert = f"INSERT INTO {quoted(layer)} ({', '.join(quoted(c) for c in (geometry, *(c for c, _ in rest)))}) VALUES ({', '.join('?' * (len(rest) + 1))})"
        for row in df.select(geometry, *(F.col(f"`{c}`") for c, _ in rest)).toLocalIterator():
            shape = parse_geometry(row[0]) if row[0] is not None else []
            blob = b"GP\0\1" + struct.pack("<i", code) + to_wkb(shape) if shape else None
            db.execute(insert, (blob, *(bytes(x) if isinstance(x, bytearray) else x if x is None or isinstance(x, (int, float, str, bytes)) else str(x) for x in row[1:])))
        db.commit()
    finally:
        db.close()
    os.replace(part, path)


def write_raw(df: DataFrame, path: str, kind: str = "parquet", crs: str = "EPSG:4326") -> None:
    """A raw extraction: parquet as it is; GeoJSON, GeoPackage and CSV with nested columns as JSON text; any other Spark format."""
    if kind.lower() == "geojson":
        write_geojson(stringify(df), path)
    elif kind.lower() == "gpkg":
        write_gpkg(stringify(df), path, crs=crs)
    elif kind.lower() == "csv":
        stringify(df).write.option("header", "true").csv(path)
    else:
        df.write.format(kind).save(path)
