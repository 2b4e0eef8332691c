"""Well-known binary of geometries, by Arrow batches: a small fixed frame around numpy's own bytes of the coordinates."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tilework.functions.clip import _geometries
from tilework.functions.geom import GEOM_TYPE, _c

#: The format's numbers of the kinds.
CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
NAMES = {v: k for k, v in CODES.items()}


def encoded(kind: str, parts) -> bytes:
    """Little-endian bytes of a geometry."""

    def points(ring) -> bytes:
        return np.array([(p["x"], p["y"]) for p in ring], "<f8").tobytes()

    def counted(ring) -> bytes:
        return struct.pack("<I", len(ring)) + points(ring)

    def one(name: str, part) -> bytes:
        head = struct.pack("<BI", 1, CODES[name])
        if name == "Polygon":
            return head + struct.pack("<I", len(part)) + b"".join(map(counted, part))
        return head + (points(part[0]) if name == "Point" else counted(part[0]))

    if not kind.startswith("Multi"):
        return one(kind, parts[0])
    return struct.pack("<BII", 1, CODES[kind], len(parts)) + b"".join(one(kind[5:], p) for p in parts)


def decoded(data: bytes) -> tuple[str, list]:
    """(kind, parts) of a geometry's bytes in either byte order; an error for kinds that aren't known and for bytes too few or too many."""

    def number(at: int, order: str) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    def points(n: int, at: int, order: str) -> tuple[list, int]:
        xy = np.frombuffer(data, order + "f8", 2 * n, at).reshape(-1, 2)
        return [{"x": float(x), "y": float(y)} for x, y in xy], at + 16 * n

    def counted(at: int, order: str) -> tuple[list, int]:
        n, at = number(at, order)
        return points(n, at, order)

    def one(at: int) -> tuple[str, list, int]:
        order = "<" if data[at] else ">"
        code, at = number(at + 1, order)
        name = NAMES[code]
        if name == "Point":
            ring, at = points(1, at, order)
            return name, [[ring]], at
        if name == "LineString":
            ring, at = counted(at, order)
            return name, [[ring]], at
        n, at = number(at, order)
        parts = []
        for _ in range(n):
            if name == "Polygon":
                ring, at = counted(at, order)
                parts.append(ring)
            else:
                _, part, at = one(at)
                parts += part
        return name, [parts] if name == "Polygon" else parts, at

    kind, parts, end = one(0)
    if end != len(data):
        raise ValueError(f"{len(data) - end} bytes follow the geometry")
    return kind, parts


@F.arrow_udf(BinaryType())
def _encode(kind: pa.Array, parts: pa.Array) -> pa.Array:
    rows = zip(kind.to_pylist(), parts.to_pylist(), strict=True)
    return pa.array([None if k is None or not a else encoded(k, a) for k, a in rows], pa.binary())


@F.arrow_udf(GEOM_TYPE)
def _decode(data: pa.Array) -> pa.Array:
    found = [None if d is None else decoded(d) for d in data.to_pylist()]
    return _geometries([f and f[0] for f in found], [f and f[1] for f in found])


def to_wkb(geom) -> Column:
    """The little-endian binary form of a geometry; null for one without parts."""
    g = _c(geom)
    return _encode(g["kind"], g["parts"])


def from_wkb(data) -> Column:
    """The geometry of a binary form; a null's kind is null."""
    return _decode(_c(data))


def feature_id(geom, given=None) -> Column:
    """The given id, else the first ten hex digits of the MD5 of the geometry's binary form."""
    own = F.substring(F.md5(to_wkb(geom)), 1, 10)
    return own if given is None else F.coalesce(_c(given).cast("string"), own)
