"""Vector files: GeoPackage (an SQLite file with well-known binary geometries) and shapefiles, as row iterators and a data source.

Points become x, y; lines become an array of vertices. Files are small next to what is computed from them: one task reads one file.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Fixed numbers of the formats.
WKB_POINT, WKB_LINE, WKB_MULTI_LINE = 1, 2, 5
SHP_NULL, SHP_POINT, SHP_LINE = 0, 1, 3
_ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def wkb(data: bytes, at: int = 0) -> tuple[str, list[tuple[float, float]], int]:
    """Kind, vertices and end of a point, line or line collection; further coordinates of a vertex are passed over."""
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    kind, extra = code % 1000, {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000 % 10]
    at += 5
    width = 8 * (2 + extra)
    if kind == WKB_POINT:
        return "POINT", [struct.unpack_from(order + "dd", data, at)], at + width
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    if kind == WKB_LINE:
        return "LINESTRING", [struct.unpack_from(order + "dd", data, at + width * i) for i in range(n)], at + width * n
    if kind == WKB_MULTI_LINE and n == 1:
        return wkb(data, at)
    raise ValueError(f"geometries of kind {kind} are not read")


def geopackage_geometry(blob: bytes) -> tuple[str, list[tuple[float, float]]]:
    """A blob is a header (magic, version, flags, reference system, envelope) and a well-known binary geometry."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return wkb(blob, 8 + _ENVELOPES[blob[3] >> 1 & 7])[:2]


def geopackage_rows(path: str, layer: str | None = None) -> Iterator[dict[str, Any]]:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        layer = layer or con.execute("select table_name from gpkg_contents where data_type = 'features'").fetchone()[0]
        (column,) = con.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
        cursor = con.execute(f'select * from "{layer}"')
        names = [d[0] for d in cursor.description]
        for row in cursor:
            values = dict(zip(names, row, strict=True))
            kind, points = geopackage_geometry(values.pop(column))
            yield values | {"geometry_kind": kind, "points": points}
    finally:
        con.close()


def shapefile_rows(path: str) -> Iterator[dict[str, Any]]:
    """Geometries from the .shp, attributes from the .dbf beside it."""
    with open(path, "rb") as f:
        data = f.read()
    table = dbase_rows(path[:-4] + ".dbf")
    at = 100
    while at < len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind % 10 == SHP_POINT:
            geometry = "POINT", [struct.unpack_from("<dd", data, at + 12)]
        elif kind % 10 == SHP_LINE:
            parts, n = struct.unpack_from("<ii", data, at + 44)
            start = at + 52 + 4 * parts
            geometry = "LINESTRING", [struct.unpack_from("<dd", data, start + 16 * i) for i in range(n)]
        elif kind == SHP_NULL:
            geometry = None, []
        else:
            raise ValueError(f"shapes of kind {kind} are not read")
        yield next(table) | {"geometry_kind": geometry[0], "points": geometry[1]}
        at += 8 + size


def dbase_rows(path: str) -> Iterator[dict[str, Any]]:
    with open(path, "rb") as f:
        data = f.read()
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields = []
    at = 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    for i in range(n):
        start = head + size * i + 1
        row = {}
        for name, kind, width, decimals in fields:
            text = data[start : start + width].decode("utf-8", "replace").strip()
            start += width
            if kind in "NF":
                row[name] = None if not text or set(text) == {"*"} else (float(text) if decimals or kind == "F" else int(text))
            else:
                row[name] = {"T": True, "F": False, "Y": True, "N": False}.get(text.upper()) if kind == "L" else text
        yield row


def find(folder: str, name: str) -> str:
    """The file of a layer in a folder: a GeoPackage or a shapefile, and not both."""
    base = name.removesuffix(".shp").removesuffix(".gpkg")
    found = [p for p in (f"{folder}/{base}.gpkg", f"{folder}/{base}.shp") if os.path.exists(p)]
    if len(found) != 1:
        raise ValueError(f"{base}: {'both formats are' if found else 'no vector file is'} in {folder}")
    return found[0]


def read(path: str) -> Iterator[dict[str, Any]]:
    return geopackage_rows(path) if path.endswith(".gpkg") else shapefile_rows(path)


class VectorSource(DataSource):
    """spark.read.format("network_vector").load(path): attributes, geometry_kind, x and y of points, points of lines."""

    @classmethod
    def name(cls) -> str:
        return "network_vector"

    def schema(self) -> StructType:
        kinds: dict[str, Any] = {}
        for row in read(self.options["path"]):
            for k, v in row.items():
                if k not in ("geometry_kind", "points") and v is not None:
                    kind = BooleanType() if isinstance(v, bool) else LongType() if isinstance(v, int) else DoubleType() if isinstance(v, float) else BinaryType() if isinstance(v, bytes) else StringType()
                    kinds[k] = DoubleType() if {type(kind), type(kinds.get(k, kind))} == {LongType, DoubleType} else kind
                kinds.setdefault(k, StringType()) if k not in ("geometry_kind", "points") else None
        point = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
        return StructType([*[StructField(k, v) for k, v in kinds.items()], StructField("geometry_kind", StringType()), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("points", ArrayType(point))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return VectorReader(self.options["path"], schema)


class VectorReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.fieldNames()
        self.doubles = {f.name for f in schema.fields if isinstance(f.dataType, DoubleType)}

    def read(self, partition) -> Iterator[tuple]:
        for row in read(self.path):
            point = row["points"][0] if row["geometry_kind"] == "POINT" else (None, None)
            full = row | {"x": point[0], "y": point[1]}
            yield tuple(float(full[k]) if k in self.doubles and full.get(k) is not None else full.get(k) for k in self.names)
