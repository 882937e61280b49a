"""Vector files and TIFF pixels, from files that the tests write byte by byte."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators.vector import in_polygon, polygon_area
from verdance.sources import rasters, tiff, vectors


def write_shapes(folder, name, records, rows=None):
    """``records``: contents from the kind on; ``rows``: (text, number) attributes, None for a deleted row."""
    body = b"".join(struct.pack(">ii", k, len(r) // 2) + r for k, r in enumerate(records, 1))
    (folder / f"{name}.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + bytes(72) + body)
    if rows is not None:
        fields = b"".join(n.ljust(11, b"\0") + kind + bytes(4) + bytes([size, 0]) + bytes(14) for n, kind, size in ((b"name", b"C", 6), (b"probcut", b"N", 4)))
        data = b"".join(b"*" + b" " * 10 if r is None else b" " + r[0].encode("latin-1").ljust(6) + r[1].encode().rjust(4) for r in rows)
        head = struct.pack("<4BIHH", 3, 0, 0, 0, len(rows), 32 + len(fields) + 1, 11) + bytes(20)
        (folder / f"{name}.dbf").write_bytes(head + fields + b"\x0d" + data + b"\x1a")


def poly(kind, *rings):
    starts = np.cumsum([0, *[len(r) for r in rings[:-1]]]).astype("<i4").tobytes()
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(rings), sum(map(len, rings))) + starts + np.array([p for r in rings for p in r], "<f8").tobytes()


def square(x, y, side, clockwise=True):
    ring = [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]
    return ring if clockwise else ring[::-1]


def test_polygons_with_parts_holes_and_attributes(spark, tmp_path):
    records = [poly(5, square(0, 0, 10), square(20, 0, 4), square(2, 2, 3, False)), struct.pack("<i", 0), poly(15, square(0, 0, 2, False)), poly(5, square(5, 5, 1))]
    write_shapes(tmp_path, "crowns", records, [("été", "97"), ("", "x"), None])
    write_shapes(tmp_path, "more", [poly(3, [(0, 0), (1, 1)], [(2, 2), (3, 3)]), struct.pack("<i2d", 1, 3.0, 4.0), struct.pack("<i4di4d", 8, 0, 0, 0, 0, 2, 1, 2, 3, 4)])
    found = vectors.read_vectors(spark, str(tmp_path), {"name": "string", "probcut": "int"})
    got = {(r.file.rsplit("/", 1)[-1], r.rec): r for r in found.withColumn("area", polygon_area(F.col("rings"))).collect()}
    assert len(got) == 7
    first = got["crowns", 1]
    assert [(g.part, g.hole) for g in first.rings] == [(0, False), (1, False), (0, True)] and first.area == 100 + 16 - 9 and (first.name, first.probcut) == ("été", 97)
    assert got["crowns", 2].rings is None and (got["crowns", 2].name, got["crowns", 2].probcut) == (None, None)
    assert [(g.part, g.hole) for g in got["crowns", 3].rings] == [(0, False)] and got["crowns", 3].name is None and got["crowns", 4].probcut is None
    assert [len(g.pts) for g in got["more", 1].rings] == [2, 2] and (got["more", 2].x, got["more", 2].y) == (3.0, 4.0) and len(got["more", 3].rings) == 2
    inside = vectors.read_shapes(spark, str(tmp_path)).filter("kind = 5 AND rec = 1").select(*[in_polygon(F.col("rings"), F.lit(x), F.lit(1.0)).alias(f"p{int(x)}") for x in (1.0, 15.0, 21.0)]).first()
    assert (inside.p1, inside.p15, inside.p21) == (True, False, True)


def test_attributes_as_a_map(spark, tmp_path):
    write_shapes(tmp_path, "a", [poly(5, square(0, 0, 1))], [("pine", "9")])
    assert vectors.read_vectors(spark, str(tmp_path)).first().attributes == {"name": "pine", "probcut": "9"}
    (tmp_path / "none").mkdir()
    write_shapes(tmp_path / "none", "b", [], [])
    assert vectors.read_vectors(spark, str(tmp_path / "none")).count() == 0


def write_tiff(path, image, order="<", tile=None, rows_per_strip=2, deflate=False, predictor=1, planar=1, missing=None):
    nrow, ncol, layers = image.shape
    h, w = tile or (rows_per_strip, ncol)
    chunks = []
    for plane in range(layers) if planar == 2 else [slice(None)]:
        part = image[:, :, plane : plane + 1] if planar == 2 else image
        for top in range(0, nrow, h):
            for left in range(0, ncol, w):
                block = part[top : top + h, left : left + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
                chunks.append(zlib.compress(raw) if deflate else raw)
    starts = np.cumsum([8, *map(len, chunks)]).tolist()
    kinds = {"u": 1, "i": 2, "f": 3}
    tags = [(256, 4, [ncol]), (257, 4, [nrow]), (258, 3, [image.dtype.itemsize * 8] * layers), (259, 3, [8 if deflate else 1]), (277, 3, [layers]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kinds[image.dtype.kind]] * layers)]
    tags += [(322, 4, [w]), (323, 4, [h]), (324, 4, starts[:-1]), (325, 4, [len(c) for c in chunks])] if tile else [(273, 4, starts[:-1]), (278, 4, [h]), (279, 4, [len(c) for c in chunks])]
    tags += [(33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 200.0, 0.0])] + ([(42113, 2, [missing.encode() + b"\0"])] if missing else [])
    at, entries, extra = starts[-1], b"", b""
    for tag, kind, values in sorted(tags):
        raw = values[0] if kind == 2 else struct.pack(order + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
        n = len(raw) if kind == 2 else len(values)
        if len(raw) > 4:
            place = struct.pack(order + "I", at + 2 + 12 * len(tags) + 4 + len(extra))
            extra += raw
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, kind, n) + place
    path.write_bytes((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(chunks) + struct.pack(order + "H", len(tags)) + entries + bytes(4) + extra)


@pytest.mark.parametrize(
    "kind,options",
    [("u1", {}), ("u2", {"deflate": True, "predictor": 2}), ("f4", {"tile": (16, 16), "deflate": True}), ("i2", {"order": ">", "planar": 2, "rows_per_strip": 5}), ("u2", {"tile": (16, 16), "predictor": 2, "planar": 2, "order": ">"})],
)
def test_tiff_pixels(spark, tmp_path, kind, options):
    image = np.random.default_rng(5).integers(0, 120, (21, 19, 2)).astype(kind)
    image[3, 4] = 7
    write_tiff(tmp_path / "a.tif", image, missing="7", **options)
    rows = tiff.read_tiff(spark, str(tmp_path), ["red", "nir"]).orderBy("cell").collect()
    want = np.where(image == 7, np.nan, image.astype(float)).reshape(-1, 2)
    got = np.array([(np.nan if r.red is None else r.red, np.nan if r.nir is None else r.nir) for r in rows])
    assert np.array_equal(got, want, equal_nan=True) and [r.cell for r in rows] == list(range(1, 21 * 19 + 1))
    assert (rows[0].x, rows[0].y, rows[-1].x, rows[-1].y) == (101.0, 199.0, 100 + 2 * 18.5, 200 - 2 * 20.5)
    meta = rasters.raster_catalog(spark, str(tmp_path)).first()
    assert (meta.nrow, meta.ncol, meta.layers, meta.xmin, meta.ymax) == (21, 19, 2, 100.0, 200.0)


def test_tiffs_that_cannot_be_read(spark, tmp_path):
    write_tiff(tmp_path / "a.tif", np.zeros((3, 3, 1), "u1"))
    with pytest.raises(Exception, match="has 1 bands, not 2"):
        tiff.read_tiff(spark, str(tmp_path), ["a", "b"]).count()
    (tmp_path / "b.tif").write_bytes(b"no image")
    with pytest.raises(Exception, match="is no TIFF"):
        tiff.read_tiff(spark, str(tmp_path), ["a"]).count()


def test_boxes_of_any_size_find_their_highest_cell(spark):
    from verdance.operators import zonal

    rng = np.random.default_rng(11)
    rows = [(k + 1, f"z{rng.integers(6)}" if k % 3 else ("wide" if k % 2 else None), float(k % 30), float(k // 30), float(rng.integers(40))) for k in range(900)]
    rows = [(c, z if z == "wide" or z is None else f"{z}{int(x // 7)}", x, y, v) for c, z, x, y, v in rows]
    df = spark.createDataFrame([*rows, (901, "z00", None, 2.0, 1.0), (902, "alone", -50.5, -3.0, 2.0), (903, None, 1.0, 1.0, None)], "cell long, z string, x double, y double, v double")
    want = {}
    for zone in {z for _, z, *_ in rows if z}:
        mine = [r for r in rows if r[1] == zone]
        x0, x1, y0, y1 = (f(r[k] for r in mine) for k in (2, 3) for f in (min, max))
        top = max(r[4] for r in mine)
        want[zone] = min(r[0] for r in rows if x0 <= r[2] <= x1 and y0 <= r[3] <= y1 and r[4] >= top)
    for side in (None, 0.7, 100.0):
        got = {r.z: r.cell for r in zonal.zone_extreme(df, "z", "v", bounding_box=True, side=side).collect()}
        assert got == {**want, "alone": 902}


def test_hills_merge_across_a_border_only_where_the_saddle_allows(spark):
    from verdance.operators import segment

    # two hills (peaks at columns 3 and 12), the border of tiles a and b in the valley, that of b and c on the second peak
    rows = [(r * 20 + c, r, c, 0 if c < 8 else 1 if c < 13 else 2, 10.0 - min(abs(c - 3), abs(c - 12)) - 0.01 * r) for r in range(3) for c in range(16)]
    cells = spark.createDataFrame(rows, "cell long, row long, col long, tile long, h double")
    parts = {k: {r.label for r in segment.watershed_crowns(cells, "h", tolerance=0.5, smooth=False, border_tolerance=k).collect()} for k in (None, 0.5, 20.0)}
    assert len(parts[None]) == len(parts[20.0]) == 1 and parts[0.5] == {0, 8}


def test_order_statistics_are_exact(spark):
    from verdance.operators import stats

    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(0, 1e-3, 500), rng.integers(-3, 3, 500), [1e308, -1e308, np.inf, -np.inf, 5e-324, 0.0]])
    df = spark.createDataFrame([(float(x), float(k % 2), None) for k, x in enumerate(a)] + [(float("nan"), None, None)], "a double, b double, e double")
    want = np.sort(a)
    places = [0, 1, 17, 500, 501, 502, 503, 504, len(want) - 2, len(want) - 1]
    got = stats.order_statistics(df, {"a": places, "b": [0, 502, 503, 1005], "e": []}, bins=8)
    assert [got["a"][p] for p in places] == want[places].tolist()
    assert [got["b"][p] for p in (0, 502, 503, 1005)] == np.sort([k % 2 for k in range(1006)])[[0, 502, 503, 1005]].tolist() and got["e"] == {}
    breaks = stats.quantile_breaks(df.filter("abs(a) < 10"), ["a", "e"], [0, 0.3, 1])
    few = want[np.abs(want) < 10]
    assert breaks["e"] == [] and abs(breaks["a"][1] - np.quantile(few, 0.3)) < 1e-12
