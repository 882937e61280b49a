"""Vector files: the shapes of .shp files as points and rings, the attributes of the .dbf files beside them."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.operators.vector import RINGS

# Fixed values of the format: a shape's kind, to which 10 (with heights) or 20 (with measures) may be added.
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
SHAPES = f"file string, rec long, kind int, x double, y double, rings {RINGS}"
ARROW_RINGS = pa.list_(pa.struct([("part", pa.int32()), ("hole", pa.bool_()), ("pts", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))
ARROW_SHAPES = pa.schema([("file", pa.string()), ("rec", pa.int64()), ("kind", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("rings", ARROW_RINGS)])
#: Shapes or attribute rows that leave a task together.
BATCH = 4096


def _twice_area(pts: np.ndarray) -> float:
    x, y = (pts - pts[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    p, q = ring[:-1], ring[1:]
    over = (p[:, 1] > y) != (q[:, 1] > y)
    p, q = p[over], q[over]
    return int((x < p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])).sum()) % 2 == 1


def polygon_rings(parts: list[np.ndarray]) -> list[dict]:
    """Rings with their parts: clockwise ones are a part each, the others holes of the part around them.

    A hole that no part holds goes to the part before it; a shape without any clockwise ring has only parts.
    """
    parts = [p for p in parts if len(p)]
    outer = [k for k, p in enumerate(parts) if _twice_area(p) <= 0] or list(range(len(parts)))
    number = {k: n for n, k in enumerate(outer)}
    rings = []
    for k, pts in enumerate(parts):
        home = k
        if k not in number:
            home = next((o for o in outer if _holds(parts[o], *pts[0])), max((o for o in outer if o < k), default=outer[0]))
        rings.append({"part": number[home], "hole": k not in number, "pts": [{"x": x, "y": y} for x, y in pts.tolist()]})
    return rings


def shapes_of(content: bytes) -> Iterator[dict]:
    """Record number, kind, point and rings of each shape; an empty shape has neither."""
    at = 100
    while at + 12 <= len(content):
        rec, words = struct.unpack_from(">ii", content, at)
        kind = struct.unpack_from("<i", content, at + 8)[0]
        flat, shape = kind % 10, {"rec": rec, "kind": kind, "x": None, "y": None, "rings": None}
        if flat == POINT:
            shape["x"], shape["y"] = struct.unpack_from("<2d", content, at + 12)
        elif flat in (LINE, POLYGON):
            n_parts, n = struct.unpack_from("<2i", content, at + 44)
            starts = np.frombuffer(content, "<i4", n_parts, at + 52)
            pts = np.frombuffer(content, "<f8", 2 * n, at + 52 + 4 * n_parts).reshape(-1, 2)
            parts = np.split(pts, starts[1:])
            lines = [{"part": k, "hole": False, "pts": [{"x": x, "y": y} for x, y in p.tolist()]} for k, p in enumerate(parts)]
            shape["rings"] = polygon_rings(parts) if flat == POLYGON else lines
        elif flat == MULTIPOINT:
            pts = np.frombuffer(content, "<f8", 2 * struct.unpack_from("<i", content, at + 44)[0], at + 48).reshape(-1, 2)
            shape["rings"] = [{"part": k, "hole": False, "pts": [{"x": x, "y": y}]} for k, (x, y) in enumerate(pts.tolist())]
        yield shape
        at += 8 + 2 * words


def attributes_of(content: bytes, encoding: str) -> Iterator[dict]:
    """Record number and {name: text} of each row; blank fields are null, rows marked as deleted keep their number but are left out."""
    n, head, width = struct.unpack_from("<IHH", content, 4)
    fields = [content[p : p + 32] for p in range(32, head - 32, 32) if content[p] != 0x0D]
    names, sizes = [f[:11].split(b"\0")[0].decode(encoding) for f in fields], [f[16] for f in fields]
    for k in range(n):
        row, place = content[head + k * width : head + (k + 1) * width], 1
        values = []
        for size in sizes:
            values.append(row[place : place + size].decode(encoding, "replace").strip(" \0") or None)
            place += size
        if row[:1] != b"*":
            yield {"rec": k + 1, "attributes": list(zip(names, values, strict=True))}




def _scan(spark: SparkSession, path: str, suffix: str, rows, arrow: pa.Schema, schema: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                some = []
                for row in rows(content):
                    some.append({"file": re.sub(r"\.[A-Za-z]+$", "", name), **row})
                    if len(some) == BATCH:
                        yield pa.RecordBatch.from_pylist(some, arrow)
                        some = []
                yield pa.RecordBatch.from_pylist(some, arrow)

    both = "{" + suffix + "," + suffix.upper() + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{both}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(read, schema)


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, kind, x, y, rings) of every shape in the .shp files below ``path``.

    Points have x and y, the others rings: polygons with parts and holes, lines and point sets with one ring a part. Files
    spread over tasks; the format's own limit keeps one file below 2 GB.
    """
    return _scan(spark, path, "shp", shapes_of, ARROW_SHAPES, SHAPES)


def read_vectors(spark: SparkSession, path: str, columns: dict[str, str] | None = None, encoding: str = "latin-1") -> DataFrame:
    """Shapes with the attributes of their .dbf files: those of ``columns`` {name: type} as columns, else all as a map of texts.

    Shapes without an attribute row have nulls; a text that is no value of its type is null.
    """
    arrow = pa.schema([("file", pa.string()), ("rec", pa.int64()), ("attributes", pa.map_(pa.string(), pa.string()))])
    table = _scan(spark, path, "dbf", lambda content: attributes_of(content, encoding), arrow, "file string, rec long, attributes map<string,string>")
    both = read_shapes(spark, path).join(table, ["file", "rec"], "left")
    if columns is None:
        return both
    return both.withColumns({c: F.expr(f"try_cast(attributes['{c}'] AS {kind})") for c, kind in columns.items()}).drop("attributes")
