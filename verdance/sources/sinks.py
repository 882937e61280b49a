"""TIFF images and shapefiles as sinks: tasks write the files, and a commit moves those of finished tasks to their place."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from verdance.sources.vectors import POINT, POLYGON, _twice_area

#: Bytes of shapes after which a task begins another file; the format's own bound is 2 GB.
FILE_BYTES = 64 << 20
#: Fixed values of the .dbf format: kind and width of a field by the column's type.
FIELDS = {"bigint": ("N", 20), "int": ("N", 11), "double": ("F", 24), "string": ("C", 254)}


def filesystem_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the folder's path in it."""
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").strip("/")
    return fs.FileSystem.from_uri(uri.rstrip("/"))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def write_binaries(files: DataFrame, folder: str) -> int:
    """Files (name, content), names with folders allowed, written below ``folder`` by the tasks that hold them; their bytes in all."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem_of(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                place = f"{root}/{name}"
                store.create_dir(place.rsplit("/", 1)[0])
                with store.open_output_stream(place) as out:
                    out.write(content.as_buffer())
                yield pa.record_batch([pa.array([content.as_buffer().size], pa.int64())], ["size"])

    return files.select("name", "content").mapInArrow(put, "size long").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first().size


class FilesWriter(DataSourceArrowWriter):
    """Tasks write below a folder of the job's own; ``files`` is what a format adds: (suffix, bytes) of each of its files."""

    def __init__(self, options: dict[str, str]):
        self.options, self.uri, self.job = dict(options), options["path"], f"_job-{uuid4().hex}"

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem_of(self.uri)
        store.create_dir(f"{root}/{self.job}")
        names = []
        for group in self.files(iterator):
            stem = f"part-{uuid4().hex}"  # attempts of a task never meet
            for suffix, data in group.items():
                with store.open_output_stream(f"{root}/{self.job}/{stem}.{suffix}") as out:
                    out.write(data)
                names.append(f"{stem}.{suffix}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem_of(self.uri)
        for name in (n for m in messages if m for n in m.files):
            store.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem_of(self.uri)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


def tiff_bytes(image: np.ndarray, xmin: float, ymax: float, xres: float, yres: float) -> bytes:
    """A little-endian TIFF of doubles (rows, columns, bands), one deflated strip, with the extent as GeoTIFF has it."""
    h, w, bands = image.shape
    strip = zlib.compress(np.ascontiguousarray(image, "<f8").tobytes())
    # tag: (letter of its type, number of its type, values), in the order of tags
    tags = {256: ("I", 4, [w]), 257: ("I", 4, [h]), 258: ("H", 3, [64] * bands), 259: ("H", 3, [8]), 262: ("H", 3, [1]), 273: ("I", 4, [8]), 277: ("H", 3, [bands]), 278: ("I", 4, [h]), 279: ("I", 4, [len(strip)]),
            284: ("H", 3, [1]), 339: ("H", 3, [3] * bands), 33550: ("d", 12, [xres, yres, 0.0]), 33922: ("d", 12, [0.0, 0.0, 0.0, xmin, ymax, 0.0])}
    strip += b"\0" * (len(strip) % 2)
    at = 8 + len(strip)
    beyond, entries, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, (letter, number, values) in tags.items():
        data = struct.pack(f"<{len(values)}{letter}", *values)
        if len(data) > 4:
            place, extra = struct.pack("<I", beyond + len(extra)), extra + data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, number, len(values)) + place
    return b"II*\0" + struct.pack("<I", at) + strip + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


class TiffWriter(FilesWriter):
    """Batches (ti, tj, row, col, bands...) in order of tiles: one file a tile, of which one at a time is held."""

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, bytes]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ti, tj = batch.column("ti").to_numpy(), batch.column("tj").to_numpy()
            cuts = np.flatnonzero((np.diff(ti) != 0) | (np.diff(tj) != 0)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                if end > start:
                    if held and (held[0].column("ti")[0].as_py(), held[0].column("tj")[0].as_py()) != (int(ti[start]), int(tj[start])):
                        yield {"tif": self.tile(held)}
                        held = []
                    held.append(batch.slice(int(start), int(end - start)))
        if held:
            yield {"tif": self.tile(held)}

    def tile(self, held: list[pa.RecordBatch]) -> bytes:
        pixels = pa.Table.from_batches(held)
        row, col = pixels.column("row").to_numpy(), pixels.column("col").to_numpy()
        top, left = int(row.min()), int(col.min())
        image = np.full((int(row.max()) - top + 1, int(col.max()) - left + 1, pixels.num_columns - 4), np.nan)
        for b in range(4, pixels.num_columns):
            image[row - top, col - left, b - 4] = pixels.column(b).to_numpy()
        xmin, ymax, xres, yres = (float(self.options[k]) for k in ("xmin", "ymax", "xres", "yres"))
        return tiff_bytes(image, xmin + left * xres, ymax - top * yres, xres, yres)


class ShapeWriter(FilesWriter):
    """Batches (rings or x and y, attributes...): .shp, .shx and .dbf files of at most about ``FILE_BYTES`` each."""

    def __init__(self, options: dict[str, str], fields: list[tuple[str, str]]):
        super().__init__(options)
        self.fields = fields

    def shape(self, row: dict) -> tuple[bytes, tuple | None]:
        """A shape's content, and its bounds; without a place it is empty."""
        if row.get("rings") is not None:
            parts = []
            for ring in row["rings"]:
                pts = np.array([(p["x"], p["y"]) for p in ring["pts"]], float).reshape(-1, 2)
                if not len(pts):
                    continue
                pts = pts if (pts[0] == pts[-1]).all() else np.vstack([pts, pts[:1]])
                parts.append(pts if (_twice_area(pts) > 0) == ring["hole"] else pts[::-1])
            if parts:
                every = np.vstack(parts)
                box = (*every.min(axis=0), *every.max(axis=0))
                starts = np.cumsum([0, *map(len, parts)])[:-1].astype("<i4")
                return struct.pack("<i4d2i", POLYGON, *box, len(parts), len(every)) + starts.tobytes() + every.astype("<f8").tobytes(), box
        elif row.get("x") is not None and row.get("y") is not None:
            return struct.pack("<i2d", POINT, row["x"], row["y"]), (row["x"], row["y"]) * 2
        return struct.pack("<i", 0), None

    def attributes(self, row: dict) -> bytes:
        out = b" "
        for name, kind in self.fields:
            text = "" if row[name] is None else repr(row[name]) if kind == "double" else str(row[name])
            data, (letter, width) = text.encode("latin-1"), FIELDS[kind]
            if len(data) > width:
                raise ValueError(f"{name}: a value of {len(data)} characters; the format holds {width}")
            out += data.ljust(width) if letter == "C" else data.rjust(width)
        return out

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, bytes]]:
        shapes, rows, boxes, size = [], [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                shape, box = self.shape(row)
                shapes.append(shape)
                rows.append(self.attributes(row))
                boxes += [] if box is None else [box]
                size += len(shape) + len(rows[-1])
                if size > FILE_BYTES:
                    yield self.group(shapes, rows, boxes)
                    shapes, rows, boxes, size = [], [], [], 0
        if shapes:
            yield self.group(shapes, rows, boxes)

    def group(self, shapes: list[bytes], rows: list[bytes], boxes: list[tuple]) -> dict[str, bytes]:
        box = np.array(boxes).reshape(-1, 4)
        bounds = (*box[:, :2].min(axis=0), *box[:, 2:].max(axis=0)) if len(box) else (0.0,) * 4
        kind = next((k for k in (struct.unpack_from("<i", s)[0] for s in shapes) if k), 0)

        def head(size: int) -> bytes:
            return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, *bounds, 0, 0, 0, 0)

        main, index, at = [], [], 100
        for k, s in enumerate(shapes, 1):
            main.append(struct.pack(">2i", k, len(s) // 2) + s)
            index.append(struct.pack(">2i", at // 2, len(s) // 2))
            at += 8 + len(s)
        fields = b"".join(struct.pack("<11sc4xBB14x", name.encode("latin-1"), FIELDS[t][0].encode(), FIELDS[t][1], 0) for name, t in self.fields)
        width = 1 + sum(FIELDS[t][1] for _, t in self.fields)
        table = struct.pack("<B3xIHH20x", 3, len(rows), 33 + len(fields), width) + fields + b"\r" + b"".join(rows) + b"\x1a"
        return {"shp": head(at) + b"".join(main), "shx": head(100 + 8 * len(shapes)) + b"".join(index), "dbf": table}


class TiffSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "verdance_tiff"

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(self.options)


class ShapeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "verdance_shapes"

    def writer(self, schema, overwrite: bool) -> ShapeWriter:
        return ShapeWriter(self.options, [(f.name, f.dataType.simpleString()) for f in schema.fields if f.name not in ("rings", "x", "y")])


def write_tiff(pixels: DataFrame, path: str, bands: list[str], xmin: float, ymax: float, xres: float, yres: float, side: int = 1024) -> None:
    """One TIFF of doubles for each tile of ``side`` cells that has pixels (row, col, bands), added to the folder ``path``.

    Row 0, column 0 has its corner at (xmin, ymax). Nulls and places without a pixel are NaN; pixels without a place are left
    out; of repeated places one pixel counts. An empty table writes nothing.
    """
    pixels.sparkSession.dataSource.register(TiffSink)
    place = [F.col(c).cast("long") for c in ("row", "col")]
    narrow = pixels.filter("row is not null and col is not null").select(
        F.floor(place[0] / side).alias("ti"), F.floor(place[1] / side).alias("tj"), place[0].alias("row"), place[1].alias("col"), *[F.col(f"`{b}`").cast("double").alias(f"b{k}") for k, b in enumerate(bands)]
    )
    extent = {"xmin": repr(float(xmin)), "ymax": repr(float(ymax)), "xres": repr(float(xres)), "yres": repr(float(yres))}
    narrow.repartition("ti", "tj").sortWithinPartitions("ti", "tj").write.format("verdance_tiff").mode("append").options(**extent).save(path)


def write_shapes(shapes: DataFrame, path: str, columns: list[str]) -> None:
    """Polygons (``rings``) or points (x, y) with the attributes ``columns``, a set of files for each task, added to ``path``.

    Outer rings become clockwise and holes the other way; a ring that is open is closed. Shapes without a place are
    empty. Names longer than ten characters, texts longer than 254 bytes, and types other than whole numbers, doubles and texts are
    errors, as the format can't hold them.
    """
    kinds = {c: shapes.schema[c].dataType.simpleString() for c in columns}
    for c, kind in kinds.items():
        if len(c) > 10 or kind not in FIELDS:
            raise ValueError(f"the format holds no column {c} of type {kind}")
    shapes.sparkSession.dataSource.register(ShapeSink)
    place = ["rings"] if "rings" in shapes.columns else ["x", "y"]
    shapes.select(*place, *[F.col(f"`{c}`") for c in columns]).write.format("verdance_shapes").mode("append").save(path)
