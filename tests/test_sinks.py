"""Files that tasks write, read back."""

import os

import numpy as np
import pytest

from verdance.sources import sinks, tiff, vectors


def test_tiff_tiles_round_trip(spark, tmp_path):
    image = np.random.default_rng(1).normal(size=(23, 17, 2))
    rows = [(i, j, float(image[i, j, 0]), float(image[i, j, 1]) if (i + j) % 5 else None) for i in range(23) for j in range(17) if (i, j) != (3, 3)] + [(None, 1, 1.0, 1.0)]
    pixels = spark.createDataFrame(rows, "row long, col long, `X1.0` double, b0 double").selectExpr("*", "9 as ti").repartition(5)
    path = str(tmp_path / "out")
    sinks.write_tiff(pixels, path, ["X1.0", "b0"], 100.0, 50.0, 2.0, 0.5, side=8)
    assert sorted({n.split(".")[-1] for n in os.listdir(path)}) == ["tif"] and len(os.listdir(path)) == 9
    got = {(r.x, r.y): (r.p, r.q) for r in tiff.read_tiff(spark, path, ["p", "q"]).collect()}
    want = {(100 + (j + 0.5) * 2, 50 - (i + 0.5) * 0.5): (p, q) for i, j, p, q in rows if i is not None}
    assert got == {**want, (107.0, 48.25): (None, None)}
    sinks.write_tiff(pixels.limit(0), str(tmp_path / "none"), ["b0"], 0.0, 0.0, 1.0, 1.0)
    assert not (tmp_path / "none").exists() or not any(n.endswith("tif") for n in os.listdir(tmp_path / "none"))


def test_shapes_round_trip(spark, tmp_path, monkeypatch):
    ring = lambda part, hole, pts: {"part": part, "hole": hole, "pts": [{"x": float(x), "y": float(y)} for x, y in pts]}
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]  # counterclockwise: turned round on its way out
    hole = [(1, 1), (1, 2), (2, 2), (2, 1)]  # open and clockwise
    far = [(9, 9), (9, 10), (10, 10), (9, 9)]
    rows = [(7, 0.1, "Größe", [ring(0, False, square), ring(0, True, hole), ring(1, False, far)]), (8, None, None, None), (None, float("-1e-300"), "", [])]
    df = spark.createDataFrame(rows, f"fid long, w double, t string, rings {vectors.RINGS}").selectExpr("*", "5 as unused")
    path = str(tmp_path / "s")
    sinks.write_shapes(df, path, ["fid", "w", "t"])
    got = {r.fid: r for r in vectors.read_vectors(spark, path, {"fid": "long", "w": "double", "t": "string"}).collect()}
    assert {k: (r.w, r.t) for k, r in got.items()} == {7: (0.1, "Größe"), 8: (None, None), None: (-1e-300, None)}
    assert [(g.part, g.hole, {(p.x, p.y) for p in g.pts}, len(g.pts)) for g in got[7].rings] == [(0, False, set(square), 5), (0, True, set(hole), 5), (1, False, set(far), 4)]
    assert got[8].rings is None and got[None].rings is None
    assert not [n for n in os.listdir(path) if n.startswith("_")]
    points = spark.createDataFrame([(1, 2.5, -3.5), (2, None, 1.0)], "fid int, x double, y double")
    sinks.write_shapes(points, str(tmp_path / "p"), ["fid"])
    assert sorted((r.fid, r.x, r.y) for r in vectors.read_vectors(spark, str(tmp_path / "p"), {"fid": "int"}).collect()) == [(1, 2.5, -3.5), (2, None, None)]
    with pytest.raises(ValueError, match="no column"):
        sinks.write_shapes(df, path, ["rings"])


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "x" * 300)], "x double, y double, t string")
    with pytest.raises(Exception, match="300 characters"):
        sinks.write_shapes(df, str(tmp_path / "f"), ["t"])
    assert not [n for n in os.listdir(tmp_path / "f")]
