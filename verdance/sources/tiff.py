"""TIFF images: the tags of their first directory and their pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: sizes and letters of tag types, and letters of sample formats.
SIZES, LETTERS = {1: 1, 2: 1, 3: 2, 4: 4, 12: 8}, {1: "B", 2: "s", 3: "H", 4: "I", 12: "d"}
FORMATS = {1: "u", 2: "i", 3: "f"}
#: Pixels that leave a task together.
BATCH_CELLS = 65_536


def tiff_tags(data: bytes) -> dict[int, tuple] | None:
    """{tag: values} of a TIFF's first directory, with the byte order under 0; None if it is no TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        return None
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {0: (order,)}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        here = at + 2 + 12 * k
        tag, kind, n = struct.unpack(order + "HHI", data[here : here + 8])
        if kind in SIZES:
            place = here + 8 if SIZES[kind] * n <= 4 else struct.unpack(order + "I", data[here + 8 : here + 12])[0]
            tags[tag] = struct.unpack(f"{order}{n}{LETTERS[kind]}", data[place : place + SIZES[kind] * n])
    return tags


def tiff_meta(data: bytes) -> dict | None:
    """Size and extent: tags 256, 257, 277, and GeoTIFF's 33550 and 33922."""
    tags = tiff_tags(data)
    if tags is None:
        return None
    ncol, nrow = tags[256][0], tags[257][0]
    xres, yres = tags.get(33550, (1.0, 1.0))[:2]
    tie = tags.get(33922, (0.0, 0.0, 0.0, 0.0, float(nrow), 0.0))
    xmin, ymax = tie[3] - tie[0] * xres, tie[4] + tie[1] * yres
    return {"nrow": nrow, "ncol": ncol, "layers": tags.get(277, (1,))[0], "xmin": xmin, "xmax": xmin + ncol * xres, "ymin": ymax - nrow * yres, "ymax": ymax, "crs": ""}


BLOCK = pa.schema([("file", pa.string()), ("top", pa.int64()), ("left", pa.int64()), ("height", pa.int64()), ("width", pa.int64()), ("nrow", pa.int64()), ("ncol", pa.int64()), ("layers", pa.int64()), ("xmin", pa.float64()), ("ymax", pa.float64()),
                   ("xres", pa.float64()), ("yres", pa.float64()), ("kind", pa.string()), ("deflated", pa.bool_()), ("differences", pa.bool_()), ("missing", pa.float64()), ("data", pa.list_(pa.binary()))])
BLOCKS = "file string, top long, left long, height long, width long, nrow long, ncol long, layers long, xmin double, ymax double, xres double, yres double, kind string, deflated boolean, differences boolean, missing double, data array<binary>"


def tiff_blocks(name: str, data: bytes) -> Iterator[dict]:
    """Strips or tiles as they are stored, with what it takes to decode them; one of several planes holds a chunk a band."""
    tags = tiff_tags(data)
    if tags is None:
        raise ValueError(f"{name} is no TIFF")
    meta, one = tiff_meta(data), lambda tag, value: tags.get(tag, (value,))[0]
    compression, predictor, bits = one(259, 1), one(317, 1), one(258, 1)
    if compression not in (1, 8, 32946) or predictor not in (1, 2) or bits % 8 or (predictor == 2 and one(339, 1) == 3):
        raise ValueError(f"{name}: compression {compression}, predictor {predictor} or {bits} bits are not supported")
    tiled = 322 in tags
    width, height = (tags[322][0], tags[323][0]) if tiled else (meta["ncol"], min(one(278, meta["nrow"]), meta["nrow"]))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-meta["ncol"] // width), -(-meta["nrow"] // height)
    planes = meta["layers"] if one(284, 1) == 2 else 1
    missing = tags.get(42113, (b"",))[0].strip(b" \0")
    fixed = {"file": name, **{k: meta[k] for k in ("nrow", "ncol", "layers", "xmin", "ymax")}, "xres": (meta["xmax"] - meta["xmin"]) / meta["ncol"], "yres": (meta["ymax"] - meta["ymin"]) / meta["nrow"], "width": width,
             "kind": f"{tags[0][0]}{FORMATS[one(339, 1)]}{bits // 8}", "deflated": compression != 1, "differences": predictor == 2, "missing": float(missing) if missing else None}
    for k in range(across * down):
        top = k // across * height
        chunks = [k + p * across * down for p in range(planes)]
        # the last strip ends with the image, a tile is always whole
        yield {**fixed, "top": top, "left": k % across * width, "height": height if tiled else min(height, meta["nrow"] - top), "data": [data[offsets[c] : offsets[c] + counts[c]] for c in chunks]}


def decoded(block: dict) -> np.ndarray:
    """(rows, columns, bands) of a block as doubles, without what lies beyond the image; missing values are nan."""
    kind = np.dtype(block["kind"])
    bands = block["layers"] // len(block["data"])
    planes = []
    for chunk in block["data"]:
        raw = zlib.decompress(chunk) if block["deflated"] else chunk
        cells = np.frombuffer(raw, kind, block["height"] * block["width"] * bands).reshape(block["height"], block["width"], bands)
        planes.append(np.cumsum(cells, axis=1, dtype=kind.newbyteorder("=")) if block["differences"] else cells)
    image = np.concatenate(planes, axis=2)[: block["nrow"] - block["top"], : block["ncol"] - block["left"]].astype(np.float64)
    if block["missing"] is not None:
        image[image == block["missing"]] = np.nan
    return image


def read_tiff(spark: SparkSession, path: str, bands: list[str]) -> DataFrame:
    """Pixels (file, row, col, cell, x, y and a column for each band, in the files' order) of the TIFF files at ``path``.

    Uncompressed and deflated strips or tiles, bands by pixel or by plane. A task reads a file (below 2 GB) only to cut it
    to its stored blocks; these are dealt out evenly before they are decoded, so that a large image spreads over the cluster.
    Missing values (the file's own, and nan) are null. A file with another number of bands is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").option("recursiveFileLookup", "true").load(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for block in tiff_blocks(name, content):
                    yield pa.RecordBatch.from_pylist([block], BLOCK)

    schema = "file string, row long, col long, cell long, x double, y double, " + ", ".join(f"`{b}` double" for b in bands)
    names = ["file", "row", "col", "cell", "x", "y", *bands]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1).to_pylist()[0]
                if block["layers"] != len(bands):
                    raise ValueError(f"{block['file']} has {block['layers']} bands, not {len(bands)}")
                image = decoded(block)
                row, col = (a.ravel() for a in np.mgrid[: image.shape[0], : image.shape[1]])
                row, col = row + block["top"], col + block["left"]
                places = [row, col, row * block["ncol"] + col + 1, block["xmin"] + (col + 0.5) * block["xres"], block["ymax"] - (row + 0.5) * block["yres"]]
                columns = [pa.array([block["file"]] * len(row)), *map(pa.array, places), *[pa.array(image[:, :, b].ravel(), from_pandas=True) for b in range(len(bands))]]
                pixels = pa.RecordBatch.from_arrays(columns, names=names)
                for at in range(0, len(row), BATCH_CELLS):
                    yield pixels.slice(at, BATCH_CELLS)

    return files.select("path", "content").mapInArrow(cut, BLOCKS).repartition("file", "top", "left").mapInArrow(decode, schema)
