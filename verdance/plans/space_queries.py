"""Queries on grids, distances, neighbourhoods and polygons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.operators import cover, distance, focal, grid, models, overlay, projection, rings, spatial, vector, zonal
from verdance.operators.graph import stored
from verdance.operators.grid import RasterMeta
from verdance.plans.sql import BINARY, GRID, POINTS_A, POINTS_B
from verdance.sources import fixtures

#: The fixtures' grid.
META = RasterMeta(50, 50, 0.0, 1000.0, 0.0, 1000.0)


def tile_extents(spark, sf_dir: str) -> DataFrame:
    """A raster of 100 x 100 cells and 6 layers in tiles of at most 50,000 values: the points in each."""
    meta = RasterMeta(100, 100, 0.0, 1000.0, 0.0, 500.0, layers=6)
    inside = fixtures.points_a(spark, sf_dir).filter("y < 500").groupBy(grid.tile_of(meta, 50_000).alias("tile")).agg(F.count("*").alias("points"))
    return grid.tile_extents(spark, meta, 50_000).join(inside, "tile", "left").na.fill(0, ["points"])


def tile_members(spark, sf_dir: str) -> DataFrame:
    """Cells by tile of the grid."""
    return fixtures.grid(spark, sf_dir).groupBy(grid.tile_of(META, 300).alias("tile")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def proximity(spark, sf_dir: str) -> DataFrame:
    """The grid's values around each point in the order of a window's cells by distance, cells outside the grid left out."""
    window = grid.proximity(spark, 11, 9).withColumn("i", (F.col("pixnr") - 1) % 11 - 5).withColumn("j", F.floor((F.col("pixnr") - 1) / 11) - 4)
    points = fixtures.points_b(spark, sf_dir).select("fid", META.row_of(F.col("y")).alias("r"), META.col_of(F.col("x")).alias("c"))
    around = points.join(F.broadcast(window), how="cross")  # a window's 99 cells for each point
    cells = fixtures.grid(spark, sf_dir).select("row", "col", "v")
    return around.select("fid", "place", F.round("dist", 6).alias("dist"), (F.col("r") + F.col("i")).alias("row"), (F.col("c") + F.col("j")).alias("col")).join(cells, ["row", "col"]).select("fid", "place", "dist", "v")


def _neighbour_values(spark, sf_dir: str, diagonals: bool) -> DataFrame:
    cells = fixtures.grid(spark, sf_dir).select("cell", "v")
    values = cells.select(F.col("cell").alias("neighbour"), "v")
    return grid.neighbours(cells.select("cell"), 50, 50, diagonals).join(values, "neighbour").select("cell", "neighbour", "v")


def neighbours8(spark, sf_dir: str) -> DataFrame:
    """Each cell with each of its neighbours, corners included, and the neighbour's value."""
    return _neighbour_values(spark, sf_dir, True)


def neighbours4(spark, sf_dir: str) -> DataFrame:
    """Each cell's neighbours that share a side: their number and the sum of their values."""
    return _neighbour_values(spark, sf_dir, False).groupBy("cell").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def odd_grid(spark, sf_dir: str) -> DataFrame:
    """The grid cut to odd sizes, and the window for a radius on it."""
    w, h = grid.window_size(4.0, 0.15)
    return grid.odd_sized(fixtures.grid(spark, sf_dir), 50, 50).agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.lit(w).cast("long").alias("w"), F.lit(h).cast("long").alias("h"))


def n_neighbours(spark, sf_dir: str) -> DataFrame:
    return spatial.neighbours_wide(fixtures.points_b(spark, sf_dir), 3)


def nearest_target(spark, sf_dir: str) -> DataFrame:
    return spatial.nearest(fixtures.points_a(spark, sf_dir), fixtures.points_b(spark, sf_dir)).select("fid", "b_fid", "distance")


def presence_within_radius(spark, sf_dir: str) -> DataFrame:
    return spatial.count_within(fixtures.points_a(spark, sf_dir), fixtures.grid_binary(spark, sf_dir).filter("presence"), 50.0).select("fid", "class", "n")


def _observations(spark, sf_dir: str) -> DataFrame:
    points = fixtures.points_b(spark, sf_dir).withColumn("class", (F.col("fid") % 2).cast("string"))
    return models.error_observations(points, fixtures.grid_binary(spark, sf_dir), 8.0, 100, seed=None)


def error_observations(spark, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).select(F.col("vis").cast("long").alias("vis"), "pred", "class")


def error_rates(spark, sf_dir: str) -> DataFrame:
    return models.error_rates(_observations(spark, sf_dir))


def false_positive_far(spark, sf_dir: str) -> DataFrame:
    return spatial.false_positives(fixtures.grid_binary(spark, sf_dir), fixtures.points_b(spark, sf_dir), 15.0, 0.5, 300, seed=None).select("cell", "x", "y", "v")


def false_positive_random(spark, sf_dir: str) -> DataFrame:
    """A seeded random share instead of the first cells."""
    return spatial.false_positives(fixtures.grid_binary(spark, sf_dir), fixtures.points_b(spark, sf_dir), 15.0, 0.5, 300, seed=3).select("cell", "x", "y", "v")


def training_frame(spark, sf_dir: str) -> DataFrame:
    cells = fixtures.grid_binary(spark, sf_dir)
    return models.training_frame(cells.filter("presence"), cells, fixtures.points_b(spark, sf_dir), ["v"], "wilted", 500, distance=12.0, seed=None).select("cell", F.col("pres").cast("long").alias("pres"), "v", "class")


def calibration_cells(spark, sf_dir: str) -> DataFrame:
    """Evenly spaced cells of the zones of two classes, one of them with two names."""
    zones = models.classes_of(fixtures.points_a(spark, sf_dir), "class", ["BUILDING", ["FURNITURE", "HOUSEHOLD"]])
    cells = zones.select("class", META.cell_of(F.col("x"), F.col("y")).cast("long").alias("cell"))
    return models.systematic_cells(cells, "class", 40)


def shadow_quantile(spark, sf_dir: str) -> DataFrame:
    shade = spatial.quantile_within(fixtures.points_b(spark, sf_dir), fixtures.grid(spark, sf_dir), "v", 100.0, (10.0, -10.0))
    return shade.select("fid", F.round("shade", 6).alias("shade"))


def shadow_filter(spark, sf_dir: str) -> DataFrame:
    cells = fixtures.grid(spark, sf_dir)
    return spatial.shadow_filter(fixtures.points_b(spark, sf_dir), cells, "v", 22.0, 100.0, (10.0, -10.0))


def focal_mean3(spark, sf_dir: str) -> DataFrame:
    return focal.focal_mean(fixtures.grid(spark, sf_dir), "v").select("cell", F.round("mean", 6).alias("mean"))


def clump_filter(spark, sf_dir: str) -> DataFrame:
    return focal.clump_filter(fixtures.grid_binary(spark, sf_dir), "presence", 50.0, 20.0, 6).select("cell", F.col("clump").cast("long").alias("clump"))


def remoteness(spark, sf_dir: str) -> DataFrame:
    """Mean distance to presences in a ring that is wide enough to be worked on in blocks."""
    cells = fixtures.grid_binary(spark, sf_dir).withColumn("p", F.col("presence").cast("double"))
    return focal.remoteness(cells, "p", 300.0, 60.0, 20.0).select("cell", F.round("remoteness", 6).alias("remoteness"))


def remoteness_narrow(spark, sf_dir: str) -> DataFrame:
    cells = fixtures.grid_binary(spark, sf_dir).withColumn("p", F.col("presence").cast("double"))
    return focal.remoteness(cells, "p", 140.0, 60.0, 20.0).select("cell", F.round("remoteness", 6).alias("remoteness"))


def mask_zone(spark, sf_dir: str) -> DataFrame:
    zone = vector.polygon_cells(fixtures.squares(spark, sf_dir), META)
    return zonal.mask_outside(fixtures.grid(spark, sf_dir), zone, "v").select("cell", "v")


def mask_zone_cropped(spark, sf_dir: str) -> DataFrame:
    zone = vector.polygon_cells(fixtures.squares(spark, sf_dir), META)
    return zonal.mask_outside(fixtures.grid(spark, sf_dir), zone, "v", crop=True).select("cell", "v")


def zonal_weighted(spark, sf_dir: str) -> DataFrame:
    """Means of the grid by square, each cell weighted by the share of it that the square covers."""
    shares = vector.cell_shares(fixtures.squares(spark, sf_dir), META)
    cells = fixtures.grid(spark, sf_dir).select("cell", F.col("v").cast("double").alias("v"))
    return zonal.zonal_mean(shares.join(cells, "cell"), "fid", ["v"], weight="share", digits=6)


def zonal_points(spark, sf_dir: str) -> DataFrame:
    """The grid's value at the centre of each square."""
    c = vector.centroid(F.col("rings"))
    points = fixtures.squares(spark, sf_dir).select("fid", META.cell_of(c["x"], c["y"]).cast("long").alias("cell"))
    return zonal.point_values(fixtures.grid(spark, sf_dir), points).select("fid", "cell", "v")


def polygon_area_filter(spark, sf_dir: str) -> DataFrame:
    polygons = vector.remove_small(fixtures.squares(spark, sf_dir), 1000.0)
    return polygons.select("fid", F.round(vector.polygon_area(F.col("rings")), 6).alias("area"))


def centroids(spark, sf_dir: str) -> DataFrame:
    c = vector.centroid(F.col("rings"))
    return fixtures.squares(spark, sf_dir).select("fid", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


def fill_holes(spark, sf_dir: str) -> DataFrame:
    filled = vector.remove_holes(F.col("rings"))
    return fixtures.squares(spark, sf_dir).select("fid", F.size(filled).cast("long").alias("rings"), F.round(vector.polygon_area(filled), 6).alias("area"))


def keep_seed_part(spark, sf_dir: str) -> DataFrame:
    kept = vector.keep_part_with(F.col("rings"), F.col("x"), F.col("y"))
    return fixtures.squares(spark, sf_dir).select("fid", F.size(kept).cast("long").alias("n_rings"), F.round(vector.polygon_area(kept), 6).alias("area"))


def clip_to_extents(spark, sf_dir: str) -> DataFrame:
    boxes = grid.tile_extents(spark, RasterMeta(50, 50, 100.0, 900.0, 100.0, 900.0), 1000).withColumnRenamed("tile", "box")
    cut = vector.clip_to_extents(fixtures.squares(spark, sf_dir), boxes)
    return cut.select("fid", "box", F.round(vector.polygon_area(F.col("rings")), 6).alias("area")).filter("area > 0")


def overlay_outline(spark, sf_dir: str) -> DataFrame:
    return vector.outlines(fixtures.squares(spark, sf_dir)).select("fid", F.col("ring").cast("long").alias("ring"), F.col("place").cast("long").alias("place"), "x", "y")


def seeds_at_maximum(spark, sf_dir: str) -> DataFrame:
    """The cell with the highest value in each square."""
    return vector.polygons_to_seeds(fixtures.squares(spark, sf_dir), fixtures.grid(spark, sf_dir), "v", META)


def points_in_squares(spark, sf_dir: str) -> DataFrame:
    """Every point with each square around it."""
    cells = stored(cover.polygon_cover(fixtures.squares(spark, sf_dir)), "squares-cover")
    return cover.points_in_polygons(fixtures.points_a(spark, sf_dir), cells).select("fid", "zone")


def label_polygons(spark, sf_dir: str) -> DataFrame:
    """The grid's values modulo 3 as polygons: their areas, parts and holes."""
    cells = fixtures.grid(spark, sf_dir).select((F.col("v") % 3).alias("label"), "row", "col")
    made, r = rings.cells_to_polygons(cells, META), F.col("rings")
    return made.select("label", F.round(vector.polygon_area(r), 6).alias("area"), rings.ring_count(r, False).alias("parts"), rings.ring_count(r, True).alias("holes"))


def union_by_group(spark, sf_dir: str) -> DataFrame:
    """Squares that overlap put together by group: area and length of the outlines."""
    groups = fixtures.squares(spark, sf_dir).select((F.col("fid") % 5).alias("grp"), "rings")
    r = F.col("rings")
    return overlay.union(groups, "grp", 128.0).select("grp", F.round(vector.polygon_area(r), 6).alias("area"), F.round(vector.perimeter(r), 6).alias("outline"))


def _halves(spark, sf_dir: str, operation: str) -> DataFrame:
    squares = fixtures.squares(spark, sf_dir)
    found = overlay.combine(squares.filter("fid % 2 = 0"), squares.filter("fid % 2 = 1"), operation, "fid", 128.0)
    return found.select("fid", F.round(vector.polygon_area(F.col("rings")), 6).alias("area"))


def polygon_difference(spark, sf_dir: str) -> DataFrame:
    """Squares with even numbers without what those with odd numbers cover."""
    return _halves(spark, sf_dir, "difference")


def polygon_intersection(spark, sf_dir: str) -> DataFrame:
    """What squares with even numbers have in common with those with odd numbers."""
    return _halves(spark, sf_dir, "intersection")


def buffer_distance(spark, sf_dir: str) -> DataFrame:
    """Distance of each cell from the nearest presence, up to a reach that spans blocks, and a narrow buffer around presences."""
    cells = distance.buffer(fixtures.grid_binary(spark, sf_dir), "presence", 25.0, 20.0)
    wide = distance.distance_to(cells, "presence", 300.0, 20.0)
    return wide.select("cell", "near", F.round("distance", 6).alias("distance"))


#: Where the reprojected fixture lies.
_ZONE, _NEXT = projection.utm(29), projection.utm(30)


def reprojected_points(spark, sf_dir: str) -> DataFrame:
    """Points given in degrees, in the metres of a zone and of the next one, and whether the way from zone to zone agrees to the millimetre."""
    lon, lat = -9 + F.col("x") / 250, 37 + F.col("y") / 200
    points = fixtures.points_a(spark, sf_dir).select("fid", _ZONE.project(lon, lat).alias("p"), _NEXT.project(lon, lat).alias("q"))
    m = projection.moved(F.col("p"), _ZONE, _NEXT)
    near = points.withColumn("m", m).withColumn("agree", (F.abs(F.col("m.x") - F.col("q.x")) < 0.001) & (F.abs(F.col("m.y") - F.col("q.y")) < 0.001))
    return near.select("fid", "agree", *[F.round(f"{a}.{c}", 3).alias(f"{c}_{n}") for a, n in (("p", 29), ("q", 30)) for c in ("x", "y")])


def usable_tiles(spark, sf_dir: str) -> DataFrame:
    """Tiles with all layers and more than one point."""
    tile = grid.tile_of(META, 300)
    tiles = fixtures.grid(spark, sf_dir).select(tile.alias("tile")).distinct().withColumn("layers", F.when(F.col("tile") % 4 == 0, 22).otherwise(23))
    return models.usable_tiles(tiles, fixtures.points_b(spark, sf_dir).select(tile.alias("tile")))


QUERIES = {
    f.__name__: f
    for f in (
        tile_extents, tile_members, proximity, neighbours8, neighbours4, odd_grid, n_neighbours, nearest_target, presence_within_radius, error_observations, error_rates, false_positive_far, false_positive_random,
        training_frame, calibration_cells, shadow_quantile, shadow_filter, focal_mean3, clump_filter, remoteness, remoteness_narrow, mask_zone, mask_zone_cropped, zonal_weighted, zonal_points, polygon_area_filter,
        centroids, fill_holes, keep_seed_part, clip_to_extents, overlay_outline, seeds_at_maximum, usable_tiles, points_in_squares, label_polygons, union_by_group, polygon_difference, polygon_intersection, buffer_distance, reprojected_points,
    )
}

_D = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"
_SQ = POINTS_B + ", sq AS (SELECT fid, x, y, CAST(10 * (1 + fid % 9) AS DOUBLE) AS s, fid % 3 = 0 AS hole, fid % 4 = 0 AS two FROM b)"
_AREA = "s * s - CASE WHEN hole THEN s * s / 4 ELSE 0 END + CASE WHEN two THEN s * s / 4 ELSE 0 END"
_IN = """(g.x >= q.x - s / 2 AND g.x < q.x + s / 2 AND g.y >= q.y - s / 2 AND g.y < q.y + s / 2
    AND NOT (hole AND g.x >= q.x - s / 4 AND g.x < q.x + s / 4 AND g.y >= q.y - s / 4 AND g.y < q.y + s / 4)
    OR two AND g.x >= q.x + 2 * s - s / 4 AND g.x < q.x + 2 * s + s / 4 AND g.y >= q.y - s / 4 AND g.y < q.y + s / 4)"""
#: The squares' corners are multiples of 0.5: all cells of that size in each of them.
_FINE = f"""{_SQ}, fine AS MATERIALIZED (
  SELECT DISTINCT fid, i, j FROM (
    SELECT fid, CAST((x - s / 2) * 2 AS BIGINT) + a AS i, CAST((y - s / 2) * 2 AS BIGINT) + b AS j FROM sq, range(180) p(a), range(180) q(b)
    WHERE a < s * 2 AND b < s * 2 AND NOT (hole AND a >= s / 2 AND a < 3 * s / 2 AND b >= s / 2 AND b < 3 * s / 2)
    UNION ALL
    SELECT fid, CAST((x + 2 * s - s / 4) * 2 AS BIGINT) + a, CAST((y - s / 4) * 2 AS BIGINT) + b FROM sq, range(90) p(a), range(90) q(b) WHERE two AND a < s AND b < s))"""
_OBS = f"""{BINARY}, {POINTS_B}, pts AS (SELECT fid, x, y, CAST(fid % 2 AS VARCHAR) AS class FROM b),
pres AS (SELECT * FROM cells WHERE presence),
seen AS (SELECT 1 AS vis, count(q.cell) AS pred, any_value(p.class) AS class FROM pts p LEFT JOIN pres q ON {_D} <= 8 GROUP BY p.fid),
far AS (SELECT * FROM cells p WHERE NOT EXISTS (SELECT 1 FROM pts q WHERE {_D} <= 16) ORDER BY cell LIMIT 100),
unseen AS (SELECT 0 AS vis, count(q.cell) AS pred FROM far p LEFT JOIN pres q ON {_D} <= 8 GROUP BY p.cell),
obs AS (SELECT vis, pred, class FROM seen UNION ALL SELECT vis, pred, class FROM unseen, (SELECT DISTINCT class FROM pts))"""


def _common(x0: str, x1: str, y0: str, y1: str) -> str:
    """The area that a square, without its hole and with its second part, has in common with a box."""

    def square(cx: str, half: str) -> str:
        return f"greatest(least({x1}, {cx} + {half}) - greatest({x0}, {cx} - {half}), 0) * greatest(least({y1}, q.y + {half}) - greatest({y0}, q.y - {half}), 0)"

    return f"({square('q.x', 's / 2')} - CASE WHEN hole THEN {square('q.x', 's / 4')} ELSE 0 END + CASE WHEN two THEN {square('q.x + 2 * s', 's / 4')} ELSE 0 END)"


def _ring_sql(outer: float, inner: float) -> str:
    return f"""WITH {BINARY}, o AS (SELECT i, j, sqrt(CAST(i * i + j * j AS DOUBLE)) AS w FROM range(-20, 21) a(i), range(-20, 21) b(j) WHERE i * i + j * j > {inner * inner} AND i * i + j * j <= {outer * outer}),
s AS (SELECT c.cell, sum(w) AS s, count(*) AS n FROM cells c, o JOIN cells q ON q.row = c.row + i AND q.col = c.col + j WHERE q.presence GROUP BY c.cell)
SELECT cells.cell, round(s.s / s.n, 6) AS remoteness FROM cells LEFT JOIN s ON s.cell = cells.cell"""


def _mercator_sql(zone: projection.TransverseMercator, name: str, lon: str, lat: str) -> str:
    """CTEs that end in ``name`` (fid, x, y): the zone's coordinates of a table g (fid, lon, lat)."""
    e = 2 * zone.n**0.5 / (1 + zone.n)
    terms = list(enumerate(zone.forward_terms, 1))
    x = " + ".join(f"{a!r}::DOUBLE * cos({2 * k} * u) * sinh({2 * k} * v)" for k, a in terms)
    y = " + ".join(f"{a!r}::DOUBLE * sin({2 * k} * u) * cosh({2 * k} * v)" for k, a in terms)
    return f"""{name}_t AS (SELECT fid, sinh(atanh(sin(radians({lat}))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians({lat})))) AS t, radians({lon} - ({zone.meridian})) AS d FROM g),
{name}_u AS (SELECT fid, atan2(t, cos(d)) AS u, atanh(sin(d) / sqrt(1 + t * t)) AS v FROM {name}_t),
{name} AS (SELECT fid, {zone.east} + {zone.rectifying!r}::DOUBLE * (v + {x}) AS x, {zone.north} + {zone.rectifying!r}::DOUBLE * (u + {y}) AS y FROM {name}_u)"""


ORACLES = {
    "reprojected_points": f"""WITH {POINTS_A}, g AS (SELECT fid, -9 + x / 250 AS lon, 37 + y / 200 AS lat FROM a), {_mercator_sql(_ZONE, "p", "lon", "lat")}, {_mercator_sql(_NEXT, "q", "lon", "lat")}
SELECT p.fid, true AS agree, round(p.x, 3) AS x_29, round(p.y, 3) AS y_29, round(q.x, 3) AS x_30, round(q.y, 3) AS y_30 FROM p JOIN q ON q.fid = p.fid""",
    "tile_extents": f"""WITH {POINTS_A}, n AS (SELECT CAST(least(floor(x / 500), 1) + 2 * least(floor(y / 250), 1) AS BIGINT) AS tile, count(*) AS points FROM a WHERE y < 500 GROUP BY 1)
SELECT i + 2 * j AS tile, i * 500::DOUBLE AS xmin, (i + 1) * 500::DOUBLE AS xmax, j * 250::DOUBLE AS ymin, (j + 1) * 250::DOUBLE AS ymax, coalesce(points, 0) AS points
FROM range(2) p(i) CROSS JOIN range(2) q(j) LEFT JOIN n ON n.tile = i + 2 * j""",
    "tile_members": f"""WITH {GRID} SELECT CAST(least(floor(x / (1000 / 3.0::DOUBLE)), 2) + 3 * least(floor(y / (1000 / 3.0::DOUBLE)), 2) AS BIGINT) AS tile, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM grid GROUP BY 1""",
    "proximity": f"""WITH {GRID}, {POINTS_B},
c AS (SELECT i + 1 AS pixnr, i % 11 - 5 AS di, i // 11 - 4 AS dj, sqrt(CAST((i % 11 - 5) * (i % 11 - 5) + (i // 11 - 4) * (i // 11 - 4) AS DOUBLE)) AS dist FROM range(99) r(i)),
w AS (SELECT *, row_number() OVER (ORDER BY dist, pixnr) AS place FROM c),
p AS (SELECT fid, CAST(least(floor((1000 - y) / 20), 49) AS BIGINT) AS r, CAST(least(floor(x / 20), 49) AS BIGINT) AS c FROM b)
SELECT fid, place, round(dist, 6) AS dist, v FROM p, w JOIN grid ON row = r + di AND col = p.c + dj""",
    "neighbours8": f"""WITH {GRID} SELECT p.cell, q.cell AS neighbour, q.v FROM grid p JOIN grid q ON abs(p.row - q.row) <= 1 AND abs(p.col - q.col) <= 1 AND p.cell <> q.cell""",
    "neighbours4": f"""WITH {GRID} SELECT p.cell, count(*) AS n, CAST(sum(q.v) AS BIGINT) AS v FROM grid p JOIN grid q ON abs(p.row - q.row) <= 1 AND abs(p.col - q.col) <= 1 AND p.cell <> q.cell AND (p.row = q.row OR p.col = q.col) GROUP BY p.cell""",
    "odd_grid": f"WITH {GRID} SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS v, CAST(55 AS BIGINT) AS w, CAST(55 AS BIGINT) AS h FROM grid WHERE row < 49 AND col < 49",
    "n_neighbours": f"""WITH {POINTS_B}, r AS (SELECT p.fid, q.fid AS other, row_number() OVER (PARTITION BY p.fid ORDER BY {_D}, q.fid) AS k FROM b p JOIN b q ON p.fid <> q.fid)
SELECT b.fid, b.x, b.y, max(CASE WHEN k = 1 THEN other END) AS IDneighb_1, max(CASE WHEN k = 2 THEN other END) AS IDneighb_2, max(CASE WHEN k = 3 THEN other END) AS IDneighb_3
FROM b LEFT JOIN r ON r.fid = b.fid AND k <= 3 GROUP BY ALL""",
    "nearest_target": f"WITH {POINTS_A}, {POINTS_B} SELECT p.fid, q.fid AS b_fid, {_D} AS distance FROM a p, b q QUALIFY row_number() OVER (PARTITION BY p.fid ORDER BY {_D}, q.fid) = 1",
    "presence_within_radius": f"WITH {BINARY}, {POINTS_A} SELECT p.fid, p.class, count(q.cell) AS n FROM a p LEFT JOIN (SELECT * FROM cells WHERE presence) q ON {_D} <= 50 GROUP BY ALL",
    "error_observations": f"WITH {_OBS} SELECT CAST(vis AS BIGINT) AS vis, pred, class FROM obs",
    "error_rates": f"""WITH {_OBS} SELECT class, round(1 - avg(CAST(pred > 0 AS DOUBLE)) FILTER (WHERE vis = 1), 6) AS omission, round(avg(CAST(pred > 0 AS DOUBLE)) FILTER (WHERE vis = 0), 6) AS commission, count(*) AS n FROM obs GROUP BY class""",
    "false_positive_far": f"""WITH {BINARY}, {POINTS_B}, n AS (SELECT least(round_even(0.5 * count(*), 0), 300) AS n FROM cells WHERE presence),
d AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY cell) AS rn FROM cells WHERE presence), n WHERE rn <= n)
SELECT cell, x, y, v FROM d p WHERE NOT EXISTS (SELECT 1 FROM b q WHERE {_D} <= 15)""",
    "false_positive_random": f"""WITH {BINARY}, {POINTS_B}, n AS (SELECT least(round_even(0.5 * count(*), 0), 300) AS n FROM cells WHERE presence),
d AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('3:' || cell), cell) AS rn FROM cells WHERE presence), n WHERE rn <= n)
SELECT cell, x, y, v FROM d p WHERE NOT EXISTS (SELECT 1 FROM b q WHERE {_D} <= 15)""",
    "training_frame": f"""WITH {BINARY}, {POINTS_B}, pr AS (SELECT * FROM cells WHERE presence),
d AS (SELECT * FROM cells WHERE cell NOT IN (SELECT cell FROM pr) ORDER BY cell LIMIT 500)
SELECT cell, CAST(1 AS BIGINT) AS pres, v, 'wilted' AS class FROM pr UNION ALL SELECT cell, 0, v, 'wilted' FROM d p WHERE NOT EXISTS (SELECT 1 FROM b q WHERE {_D} <= 12)""",
    "calibration_cells": f"""WITH {POINTS_A}, z AS (SELECT DISTINCT CASE WHEN class = 'BUILDING' THEN 'BUILDING' ELSE 'FURNITURE' END AS class,
  CAST(least(floor((1000 - y) / 20), 49) * 50 + least(floor(x / 20), 49) + 1 AS BIGINT) AS cell FROM a WHERE class IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD')),
n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY cell) - 1 AS rn, greatest(count(*) OVER (PARTITION BY class) // 40, 1) AS step FROM z)
SELECT class, cell FROM n WHERE rn % step = 0""",
    "shadow_quantile": f"WITH {GRID}, {POINTS_B}, m AS (SELECT fid, x + 10 AS x, y - 10 AS y FROM b) SELECT q.fid, round(quantile_cont(p.v, 0.3), 6) AS shade FROM grid p JOIN m q ON {_D} <= 50 GROUP BY q.fid",
    "shadow_filter": f"""WITH {GRID}, {POINTS_B}, m AS (SELECT fid, x + 10 AS x, y - 10 AS y FROM b),
s AS (SELECT q.fid FROM grid p JOIN m q ON {_D} <= 50 GROUP BY q.fid HAVING quantile_cont(p.v, 0.3) < 22) SELECT fid, x, y FROM b WHERE fid IN (SELECT fid FROM s)""",
    "focal_mean3": f"""WITH {GRID} SELECT p.cell, CASE WHEN count(*) = 9 THEN round(sum(q.v) / 9.0::DOUBLE, 6) END AS mean FROM grid p JOIN grid q ON abs(p.row - q.row) <= 1 AND abs(p.col - q.col) <= 1 GROUP BY p.cell""",
    "clump_filter": f"""WITH {BINARY} SELECT p.cell, CAST(count(q.cell) > 6 AS BIGINT) AS clump FROM cells p LEFT JOIN cells q ON q.presence AND (p.row - q.row) * (p.row - q.row) * 400 + (p.col - q.col) * (p.col - q.col) * 400 <= 2500 GROUP BY p.cell""",
    "remoteness": _ring_sql(7, 1),
    "remoteness_narrow": _ring_sql(3, 1),
    "mask_zone": f"WITH {GRID}, {_SQ} SELECT g.cell, CASE WHEN EXISTS (SELECT 1 FROM sq q WHERE {_IN}) THEN g.v END AS v FROM grid g",
    "mask_zone_cropped": f"""WITH {GRID}, {_SQ}, i AS (SELECT g.* FROM grid g WHERE EXISTS (SELECT 1 FROM sq q WHERE {_IN})),
e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM i)
SELECT g.cell, i.v FROM e, grid g LEFT JOIN i ON i.cell = g.cell WHERE g.row BETWEEN r0 AND r1 AND g.col BETWEEN c0 AND c1""",
    "zonal_weighted": f"""WITH {GRID}, {_SQ}, w AS (
  SELECT fid, v, {_common("g.x - 10", "g.x + 10", "g.y - 10", "g.y + 10")} AS a FROM sq q, grid g)
SELECT fid, round(sum(a * v) / sum(a), 6) AS v FROM w WHERE a > 0 GROUP BY fid""",
    "zonal_points": f"""WITH {GRID}, {_SQ}, c AS (SELECT fid, y, CASE WHEN two THEN x + 2 * s * (s * s / 4) / ({_AREA}) ELSE x END AS x FROM sq),
k AS (SELECT fid, CASE WHEN x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000 THEN CAST(least(floor((1000 - y) / 20), 49) * 50 + least(floor(x / 20), 49) + 1 AS BIGINT) END AS cell FROM c)
SELECT fid, k.cell, v FROM k LEFT JOIN grid ON grid.cell = k.cell""",
    "polygon_area_filter": f"WITH {_SQ} SELECT fid, round({_AREA}, 6) AS area FROM sq WHERE {_AREA} >= 1000",
    "centroids": f"WITH {_SQ} SELECT fid, round(x + CASE WHEN two THEN 2 * s * (s * s / 4) / ({_AREA}) ELSE 0 END, 6) AS cx, round(y, 6) AS cy FROM sq",
    "fill_holes": f"WITH {_SQ} SELECT fid, CAST(CASE WHEN two THEN 2 ELSE 1 END AS BIGINT) AS rings, round(s * s + CASE WHEN two THEN s * s / 4 ELSE 0 END, 6) AS area FROM sq",
    "keep_seed_part": f"WITH {_SQ} SELECT fid, CAST(CASE WHEN hole THEN 2 ELSE 1 END AS BIGINT) AS n_rings, round(s * s - CASE WHEN hole THEN s * s / 4 ELSE 0 END, 6) AS area FROM sq",
    "clip_to_extents": f"""WITH {_SQ}, e AS (SELECT i + 2 * j AS box, 100 + i * 400 AS x0, 500 + i * 400 AS x1, 100 + j * 400 AS y0, 500 + j * 400 AS y1 FROM range(2) a(i), range(2) c(j)),
o AS (SELECT fid, box, round({_common("x0", "x1", "y0", "y1")}, 6) AS area FROM sq q, e) SELECT * FROM o WHERE area > 0""",
    "seeds_at_maximum": f"WITH {GRID}, {_SQ} SELECT q.fid, g.x, g.y FROM sq q JOIN grid g ON {_IN} QUALIFY row_number() OVER (PARTITION BY q.fid ORDER BY g.v DESC, g.cell) = 1",
    "points_in_squares": f"WITH {POINTS_A}, {_SQ} SELECT g.fid, q.fid AS zone FROM a g JOIN sq q ON {_IN}",
    "buffer_distance": f"""WITH {BINARY}, d AS (SELECT p.cell, min({_D}) AS d FROM cells p JOIN (SELECT * FROM cells WHERE presence) q ON abs(p.x - q.x) <= 300 AND abs(p.y - q.y) <= 300 GROUP BY p.cell)
SELECT c.cell, coalesce(d <= 25, false) AS near, CASE WHEN d <= 300 THEN round(d, 6) END AS distance FROM cells c LEFT JOIN d USING (cell)""",
    "union_by_group": f"""WITH {_FINE}, u AS MATERIALIZED (SELECT DISTINCT fid % 5 AS grp, i, j FROM fine),
n AS (SELECT u.grp, count(*) AS n FROM u, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(a, b) WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.grp = u.grp AND v.i = u.i + a AND v.j = u.j + b) GROUP BY u.grp)
SELECT grp, round(0.25::DOUBLE * c, 6) AS area, round(0.5::DOUBLE * n, 6) AS outline FROM (SELECT grp, count(*) AS c FROM u GROUP BY grp) JOIN n USING (grp)""",
    "polygon_difference": f"""WITH {_FINE}, o AS (SELECT DISTINCT i, j FROM fine WHERE fid % 2 = 1)
SELECT fid, round(0.25::DOUBLE * count(*), 6) AS area FROM fine f WHERE fid % 2 = 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.i = f.i AND o.j = f.j) GROUP BY fid""",
    "polygon_intersection": f"""WITH {_FINE}, o AS (SELECT DISTINCT i, j FROM fine WHERE fid % 2 = 1)
SELECT fid, round(0.25::DOUBLE * count(*), 6) AS area FROM fine f JOIN o USING (i, j) WHERE fid % 2 = 0 GROUP BY fid""",
    # parts: cells that share sides; holes of a part: other cells inside its bounds that share sides and don't reach the bounds
    "label_polygons": f"""WITH RECURSIVE {GRID},
side AS MATERIALIZED (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(i, j)),
l AS MATERIALIZED (SELECT row, col, cell, v % 3 AS label FROM grid),
near AS MATERIALIZED (SELECT p.cell, q.cell AS other FROM l p, side s JOIN l q ON q.row = p.row + i AND q.col = p.col + j WHERE p.label = q.label),
reach(cell, part) USING KEY (cell) AS (
  SELECT cell, cell FROM l
  UNION SELECT n.other, min(r.part) FROM reach r JOIN near n ON n.cell = r.cell JOIN recurring.reach c ON c.cell = n.other WHERE r.part < c.part GROUP BY n.other),
home AS MATERIALIZED (SELECT l.*, part FROM l JOIN reach USING (cell)),
box AS MATERIALIZED (SELECT part, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM home GROUP BY part HAVING count(*) > 6),
o AS MATERIALIZED (SELECT b.part, h.row, h.col, h.cell, h.row IN (r0, r1) OR h.col IN (c0, c1) AS edge FROM box b JOIN home h ON h.row BETWEEN r0 AND r1 AND h.col BETWEEN c0 AND c1 AND h.part <> b.part),
step AS MATERIALIZED (SELECT p.part, p.cell, q.cell AS other FROM o p, side s JOIN o q ON q.part = p.part AND q.row = p.row + i AND q.col = p.col + j),
outside AS (SELECT part, cell FROM o WHERE edge UNION SELECT s.part, s.other FROM outside u JOIN step s ON s.part = u.part AND s.cell = u.cell),
inner_cells AS MATERIALIZED (SELECT part, cell FROM o EXCEPT SELECT part, cell FROM outside),
hole(part, cell, m) USING KEY (part, cell) AS (
  SELECT part, cell, cell FROM inner_cells
  UNION SELECT s.part, s.other, min(h.m) FROM hole h JOIN step s ON s.part = h.part AND s.cell = h.cell
    JOIN recurring.hole c ON c.part = s.part AND c.cell = s.other WHERE h.m < c.m GROUP BY s.part, s.other)
SELECT label, 400.0::DOUBLE * count(*) AS area, count(DISTINCT part) AS parts,
       (SELECT count(*) FROM hole JOIN home h ON h.cell = hole.part WHERE hole.m = hole.cell AND h.label = home.label) AS holes FROM home GROUP BY label""",
    "usable_tiles": f"""WITH {POINTS_B}, t AS (SELECT CAST(least(floor(x / (1000 / 3.0::DOUBLE)), 2) + 3 * least(floor(y / (1000 / 3.0::DOUBLE)), 2) AS BIGINT) AS tile FROM b)
SELECT tile, count(*) AS points FROM t WHERE tile % 4 <> 0 GROUP BY tile HAVING count(*) >= 2""",
    "overlay_outline": f"""WITH {_SQ}, k AS (SELECT * FROM (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) t(place, dx, dy)),
r AS (SELECT fid, 0 AS ring, x AS cx, y AS cy, s / 2 AS h FROM sq UNION ALL SELECT fid, 1, x, y, s / 4 FROM sq WHERE hole UNION ALL SELECT fid, CASE WHEN hole THEN 2 ELSE 1 END, x + 2 * s, y, s / 4 FROM sq WHERE two)
SELECT fid, CAST(ring AS BIGINT) AS ring, CAST(place AS BIGINT) AS place, cx + dx * h AS x, cy + dy * h AS y FROM r, k""",
}
