"""Raster files and their catalogue: ENVI images (.bsq with a .hdr) and the headers of TIFF files (their pixels: ``tiff``)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.functions.indices import index_column
from verdance.sources.sinks import write_binaries
from verdance.sources.tiff import tiff_meta

# ENVI's numbers for data types, and the band centres (nm) of two sensors.
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
SENSOR_BANDS = {"terrabella": (482.5, 555.0, 650.0, 820.0)}


def envi_header(text: str) -> dict[str, str]:
    """Names and values of an ENVI header; values in braces may span lines."""
    return {k.strip().lower(): v.strip().strip("{}").strip() for k, v in re.findall(r"^([^=\n;]+)=\s*(\{[^}]*\}|[^\n]*)", text, re.M)}


def envi_meta(header: dict[str, str]) -> dict:
    nrow, ncol, layers = (int(header[k]) for k in ("lines", "samples", "bands"))
    info = [p.strip() for p in header.get("map info", "").split(",")]
    px, py, x, y, xres, yres = (float(v) for v in info[1:7]) if len(info) > 6 else (1.0, 1.0, 0.0, float(nrow), 1.0, 1.0)
    xmin, ymax = x - (px - 1) * xres, y + (py - 1) * yres
    return {"nrow": nrow, "ncol": ncol, "layers": layers, "xmin": xmin, "xmax": xmin + ncol * xres, "ymin": ymax - nrow * yres, "ymax": ymax, "crs": ",".join(info[7:]) or info[0]}


CATALOG = "fname string, fullname string, nrow long, ncol long, layers long, xmin double, xmax double, ymin double, ymax double, crs string, status string"


def raster_catalog(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row for each .bsq (by its header), .tif and .dem file: name, size and extent; unreadable ones with a status."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{hdr,tif,dem}").option("recursiveFileLookup", str(recursive).lower()).load(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CATALOG.split(", ")]
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                full = re.sub(r"\.hdr$", ".bsq", name)
                try:
                    meta, status = (envi_meta(envi_header(content.decode("latin-1"))) if name.endswith(".hdr") else tiff_meta(content)), "ok"
                    status = status if meta else "no header"
                except (KeyError, ValueError, struct.error) as problem:
                    meta, status = None, f"bad header: {problem}"
                rows.append({"fname": full.rsplit("/", 1)[-1], "fullname": full, "status": status, **(meta or {})})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for n, c in zip(names, CATALOG.split(", "), strict=True)]))

    return files.select("path", "content").mapInArrow(read, CATALOG)


def read_envi(spark: SparkSession, path: str, wavelengths: list[float] | None = None) -> DataFrame:
    """Pixels (row, col, cell, x, y and a column for each band) of one band-sequential image.

    The header is read by Spark, the image as records of one line of one band (the file is a plain array), so that the lines
    of a large image spread over tasks; a pivot by line puts a pixel's bands together.
    """
    header = envi_header(spark.read.text(re.sub(r"\.bsq$", ".hdr", path), wholetext=True).first().value)
    meta, skip = envi_meta(header), int(header.get("header offset", 0))
    if skip:
        raise ValueError("images with a header offset are not supported")
    kind = np.dtype(ENVI_TYPES[int(header["data type"])]).newbyteorder(">" if header.get("byte order", "0") == "1" else "<")
    nrow, ncol, layers = meta["nrow"], meta["ncol"], meta["layers"]
    nm = wavelengths or [float(v) for v in header["wavelength"].split(",")]
    lines = spark.sparkContext.binaryRecords(path, ncol * kind.itemsize).zipWithIndex().map(lambda r: (r[1] // nrow, r[1] % nrow, bytearray(r[0]))).toDF("band int, row long, data binary")
    names = [f"X{w:.6f}.Nanometers" for w in nm]
    res = (meta["xmax"] - meta["xmin"]) / ncol, (meta["ymax"] - meta["ymin"]) / nrow
    schema = "row long, col long, cell long, x double, y double, " + ", ".join(f"`{n}` double" for n in names)

    def decode(key: tuple, rows: pa.Table) -> pa.Table:
        row, col = key[0].as_py(), np.arange(ncol)
        bands = dict(zip(rows.column("band").to_pylist(), rows.column("data").to_pylist(), strict=True))
        cells = [pa.array(np.full(ncol, row)), pa.array(col), pa.array(row * ncol + col + 1), pa.array(meta["xmin"] + (col + 0.5) * res[0]), pa.array(np.full(ncol, meta["ymax"] - (row + 0.5) * res[1]))]
        return pa.Table.from_arrays(cells + [pa.array(np.frombuffer(bands[k], kind).astype(np.float64)) for k in range(layers)], names=["row", "col", "cell", "x", "y", *names])

    return lines.groupBy("row").applyInArrow(decode, schema)


def scene_parts(path: Column) -> tuple[Column, Column]:
    """(sensor number, date) from a scene's file name; a part that is no date gives null."""
    base = F.substring_index(path, "/", -1)
    return F.substring(base, 1, 3), F.try_to_timestamp(F.substring(base, 5, 8), F.lit("yyyyMMdd")).cast("date")


def tile_code(path: Column, start: int = 1, length: int = 16) -> Column:
    """The tile's code in a file name, with all separators alike."""
    return F.regexp_replace(F.substring(F.substring_index(path, "/", -1), start, length), "[-.]", "_")


def predictor_names(spark: SparkSession, path: str, start: int = 17) -> list[str]:
    """A tile's predictors in the order of a text file, one a line: ``l`` and what follows the tile's code in each name."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]  # a list of a few dozen names
    return ["l" + re.sub(r"\.[A-Za-z]+$", "", line.strip().strip('"'))[start - 1 :] for text in lines for line in text.splitlines() if line.strip()]


def write_indices(pixels: DataFrame, names: list[str], folder: str, key: str = "pixel_id", overwrite: bool = True) -> list[str]:
    """Each index as a dataset of its own, named after it; without ``overwrite`` those that are there stay. Returns what was written."""
    done = []
    for name in names:
        path = f"{folder}/{name}"
        jvm = pixels.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if overwrite or not at.getFileSystem(pixels.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(at):
            pixels.select(key, index_column(pixels, name).alias(name)).write.mode("overwrite").parquet(path)
            done.append(path)
    return done


def write_texts(df: DataFrame, folder: str, suffix: str) -> None:
    """A small file for each row of (name, text), headers for instance, through the cluster's file system; for short tables."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for row in df.select("name", "text").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row.name}{suffix}")
        out = at.getFileSystem(conf).create(at, True)
        out.write(bytearray(row.text.encode("utf-8")))
        out.close()


def copy_dataset(spark: SparkSession, source: str, target: str, overwrite: bool = True) -> bool:
    """Copies a dataset's data files, a folder of them or one, by tasks; False if there is none, or if ``target`` is there to stay.

    Files (below 2 GB each, Spark's bound for whole files) go to a folder beside ``target`` that takes its place at the end, so that
    an interrupted copy is never seen; files that Spark doesn't list, such as markers, are left out.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs, to = a.getFileSystem(conf), b.getFileSystem(conf)
    if not fs.exists(a) or (to.exists(b) and not overwrite):
        return False
    whole = fs.makeQualified(a)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    single = fs.getFileStatus(a).isFile()
    name = F.lit(whole.getName()) if single else F.substring(F.col("path"), F.instr(F.col("path"), whole.toUri().getPath()) + len(whole.toUri().getPath()) + 1, F.lit(1 << 20))
    beside = f"{target.rstrip('/')}-{uuid4().hex}"
    write_binaries(files.select(name.alias("name"), "content"), beside)
    new = jvm.org.apache.hadoop.fs.Path(beside)
    if not to.exists(new):
        to.mkdirs(new)
    to.delete(b, True)
    done = to.rename(jvm.org.apache.hadoop.fs.Path(new, whole.getName()) if single else new, b)
    if single:
        to.delete(new, True)
    return bool(done)
