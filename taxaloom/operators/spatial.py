"""Points, polygons and grid cells without a geometry type: edges and cell numbers instead."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.functions.names import coordinate_text
from taxaloom.functions.projections import PROJECTIONS, SPHERE, haversine
from taxaloom.operators.grids import Grid, resample
from taxaloom.operators.quantiles import group_medians
from taxaloom.operators.rows import running_total, seeded_order
from taxaloom.operators.tiles import cells_in_polygons, crosses, points_in_tiles, polygon_index
from taxaloom.shared import shared_folder, stored

#: Metres in a degree of latitude, as used for cell sizes.
DEGREE = 111_320.0


def ring_edges(vertices: DataFrame, keys: Sequence[str] = ("poly_id", "ring")) -> DataFrame:
    """Consecutive vertex pairs of each ring; the last vertex leads back to the first."""
    w = Window.partitionBy(*keys).orderBy("seq")
    following = [F.coalesce(F.lead(c).over(w), F.first(c).over(w)).alias(f"{c}2") for c in ("x", "y")]
    return vertices.select(*keys, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), *following)


def parse_polygons(df: DataFrame, poly_id: str, wkt: str) -> DataFrame:
    """Vertices of POLYGON texts: ring and seq count from 1, a closing vertex is dropped."""
    rings = df.select(F.col(poly_id).alias("poly_id"), F.posexplode(F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("r", "text"))
    points = rings.select("poly_id", (F.col("r") + 1).alias("ring"), F.posexplode(F.split(F.trim("text"), r"\s*,\s*")).alias("p", "xy"))
    xy = F.split(F.trim("xy"), r"\s+")
    out = points.select("poly_id", "ring", (F.col("p") + 1).alias("seq"), xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))
    w = Window.partitionBy("poly_id", "ring").orderBy("seq")
    first = [F.first(c).over(w) == F.col(c) for c in ("x", "y")]
    return out.withColumn("_closing", (F.col("seq") > 1) & first[0] & first[1]).where("not _closing").drop("_closing")


def orientation(edges: DataFrame, keys: Sequence[str] = ("poly_id", "ring")) -> DataFrame:
    """Signed area of each ring and its sense."""
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    out = edges.groupBy(*keys).agg(area.alias("area"))
    return out.withColumn("sense", F.when(F.col("area") > 0, "counter-clockwise").when(F.col("area") < 0, "clockwise").otherwise("error"))


def bounding_box(vertices: DataFrame, keys: Sequence[str], pins: dict[str, float] | None = None) -> DataFrame:
    """Extent by key, pinned edges put in, with a counter-clockwise POLYGON text of five decimals."""
    pins = pins or {}
    edge = {"min_x": F.min("x"), "max_x": F.max("x"), "min_y": F.min("y"), "max_y": F.max("y")}
    out = vertices.groupBy(*keys).agg(*[c.alias(n) for n, c in edge.items()]).withColumns({n: F.lit(v) for n, v in pins.items()})
    t = {n: coordinate_text(F.col(n)) for n in edge}
    corners = [("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y")]
    pairs = [F.concat_ws(" ", t[a], t[b]) for a, b in corners]
    return out.withColumn("wkt", F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *pairs), F.lit("))")))


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pairs of point and polygon: an odd number of edges of closed rings crosses the ray to the east of the point."""
    return points_in_tiles(points, polygon_index(edges), point_id, lon, lat)


def cell_of(lon: Column, lat: Column, resolution: float) -> Column:
    """Number of the global grid cell, row by row from the north-west."""
    columns = round(360 / resolution)
    return F.floor((90 - lat) / resolution) * columns + F.floor((lon + 180) / resolution)


def values_at_points(points: DataFrame, cells: DataFrame, resolution: float, values: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Climate values of the cell that holds each point; points with any null go."""
    keyed = points.withColumn("cell", cell_of(F.col(lon), F.col(lat), resolution))
    return keyed.join(cells.select("cell", *values), "cell").dropna(subset=list(values))


def cells_to_regions(cells: DataFrame, edges: DataFrame, resolution: float) -> DataFrame:
    """The first polygon (smallest id) that holds each cell's centre; null for none."""
    inside = cells_in_polygons(edges, resolution).groupBy("cell").agg(F.min("poly_id").alias("poly_id"))
    return cells.select("cell").join(inside, "cell", "left")


def thin(points: DataFrame, species: str, point_id: str, metres: float, seed: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One seeded record in each cell of a grid that starts at the species' own extent."""
    r = metres / DEGREE
    start = points.groupBy(F.col(species).alias("_s")).agg(F.min(lon).alias("_x0"), F.min(lat).alias("_y0"))
    placed = points.join(start, points[species] == start["_s"]).withColumns({"_i": F.floor((F.col(lon) - F.col("_x0")) / r), "_j": F.floor((F.col(lat) - F.col("_y0")) / r)})
    pick = F.min(F.struct(seeded_order(seed, point_id).alias("_h"), *points.columns)).alias("m")
    return placed.groupBy("_s", "_i", "_j").agg(pick).select(*[F.col(f"m.`{c}`") for c in points.columns])


def coordinate_tests(points: DataFrame, species: str, listed: DataFrame, near_metres: float, outlier_factor: float = 5.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Keeps points in range that aren't zero, equal, near a listed point, or far from their species.

    ``listed`` (x, y) holds capitals, centroids and institutions; both sides meet on degree cells, as many to each side as the
    radius spans at the listed point's latitude, round the globe. A point is far if its distance to the species' median place is more than ``outlier_factor`` times the median such distance.
    """
    x, y = F.col(lon), F.col(lat)
    ok = x.between(-180, 180) & y.between(-90, 90) & (x != y) & ~((x == 0) & (y == 0))
    wrapped = lambda i: F.pmod(i + 180, F.lit(360)) - 180
    reach = math.degrees(near_metres / SPHERE) + 1e-6
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(near_metres / SPHERE, math.pi / 2))) / F.cos(F.radians("y")))))
    all_round = F.abs("y") + reach >= 90
    columns = F.when(all_round, F.sequence(F.lit(-180).cast("long"), F.lit(179).cast("long"))).otherwise(F.sequence(F.floor(F.col("x") - wide - 1e-6), F.floor(F.col("x") + wide + 1e-6)))
    around = listed.select("x", "y", F.explode(F.array_distinct(F.transform(columns, wrapped))).alias("_i"))
    around = around.withColumn("_j", F.explode(F.sequence(F.floor(F.col("y") - reach), F.floor(F.col("y") + reach))))
    valid = points.where(ok).withColumns({"_i": wrapped(F.floor(x)), "_j": F.floor(y)})
    close = (valid["_i"] == around["_i"]) & (valid["_j"] == around["_j"]) & (haversine(x, y, around["x"], around["y"]) <= near_metres)
    folder = shared_folder(points.sparkSession, "tests")
    away = stored(valid.join(around, close, "left_anti").drop("_i", "_j"), folder, "away")
    middle = group_medians(away, [species], [lon, lat]).select(F.col(f"`{species}`").alias("_s"), F.col(f"{lon}_median").alias("_mx"), F.col(f"{lat}_median").alias("_my"))
    # A row for each species is stored, and the distances are reckoned again where they are read: that costs less than writing all points twice.
    far = away.join(stored(middle, folder, "middle"), F.col(species) == F.col("_s")).withColumn("_d", haversine(x, y, F.col("_mx"), F.col("_my")))
    limit = group_medians(far, ["_s"], ["_d"]).select(F.col("_s").alias("_t"), (F.col("_d_median") * outlier_factor).alias("_limit"))
    return far.join(limit, F.col("_s") == F.col("_t")).where(F.col("_d") <= F.col("_limit")).select(*points.columns)


def clean_occurrences(points: DataFrame, species: str, point_id: str, listed: DataFrame, metres: float, seed: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Distinct places, tested and thinned, with the species' median latitude."""
    one = points.groupBy(species, lon, lat).agg(F.min(point_id).alias(point_id))
    kept = stored(thin(coordinate_tests(one, species, listed, 10_000, lon=lon, lat=lat), species, point_id, metres, seed, lon, lat), shared_folder(points.sparkSession, "clean"), "kept")
    middle = group_medians(kept, [species], [lat]).select(F.col(f"`{species}`").alias("_s"), F.col(f"{lat}_median").alias("median_lat"))
    return kept.join(middle, kept[species] == middle["_s"]).drop("_s")


def scale_layers(cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Each layer to mean 0 and deviation 1: one row of statistics, broadcast."""
    stats = cells.agg(*[f(c).alias(f"_{n}_{c}") for c in layers for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
    out = cells.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in layers}).select(*cells.columns)


def crop(cells: DataFrame, edges: DataFrame, resolution: float) -> DataFrame:
    """Cells whose centre lies in any polygon."""
    return cells.join(cells_in_polygons(edges, resolution).select("cell").distinct(), "cell", "left_semi")


def reproject(df: DataFrame, projection: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds px and py in metres."""
    x, y = PROJECTIONS[projection](F.col(lon), F.col(lat))
    return df.withColumns({"px": x, "py": y})


def clip(vertices: DataFrame, axis: str, bound: float, upper: bool, keys: Sequence[str] = ("poly_id", "ring")) -> DataFrame:
    """Rings cut along a line: the part at or above ``bound`` on the axis (``upper``) or at or below it.

    Where an edge crosses the line a vertex is put in, and the ring closes along the line. A part in several pieces stays one
    ring whose pieces hang together along the line, which leaves areas and insides right. Rings wholly beyond the line go;
    a ring that only touches it goes too. Keys, seq (from 1), x and y.
    """
    edges = ring_edges(vertices.withColumns({c: F.col(c).cast("double") for c in "xy"}), keys)
    other = "y" if axis == "x" else "x"
    a, b = F.col(f"{axis}1"), F.col(f"{axis}2")
    holds = (lambda c: c >= bound) if upper else (lambda c: c <= bound)
    crosses = ((a < bound) & (b > bound)) | ((a > bound) & (b < bound))
    cut = F.col(f"{other}1") + (F.col(f"{other}2") - F.col(f"{other}1")) * (bound - a) / (b - a)
    point = lambda n, x, y: F.struct(F.lit(n).alias("n"), x.alias("x"), y.alias("y"))
    line = F.lit(float(bound))
    found = F.array(F.when(holds(a), point(1, F.col("x1"), F.col("y1"))), F.when(crosses, point(2, line, cut) if axis == "x" else point(2, cut, line)))
    new = edges.withColumn("v", F.explode(F.filter(found, lambda v: v.isNotNull()))).select(*keys, "seq", "v.*")
    rings = Window.partitionBy(*keys)
    beyond = F.max((F.col(axis) > bound) if upper else (F.col(axis) < bound)).over(rings)
    out = new.withColumns({"_in": beyond, "_n": F.row_number().over(rings.orderBy("seq", "n"))}).where("_in")
    return out.select(*keys, F.col("_n").alias("seq"), "x", "y")


def split_at_meridian(vertices: DataFrame, meridian: float = 0.0, gap: float = 1e-5, keys: Sequence[str] = ("poly_id", "ring")) -> DataFrame:
    """Polygons cut in two at a meridian, so that either part can be moved to its own side of the map: keys, side, seq, x, y.

    The eastern part begins ``gap`` degrees off the meridian, so that the parts don't touch.
    """
    west = clip(vertices, "x", meridian, False, keys).withColumn("side", F.lit("west"))
    return west.unionByName(clip(vertices, "x", meridian + gap, True, keys).withColumn("side", F.lit("east")))


def centroids(edges: DataFrame, keys: Sequence[str] = ("poly_id",)) -> DataFrame:
    """Area centroid of each polygon, by its edges."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    total = F.sum(cross)
    return edges.groupBy(*keys).agg((F.sum((F.col("x1") + F.col("x2")) * cross) / (3 * total)).alias("cx"), (F.sum((F.col("y1") + F.col("y2")) * cross) / (3 * total)).alias("cy"))


def sub_region_centroid(edges: DataFrame, attributes: DataFrame, sub_region: str) -> DataFrame:
    """Of each sub-region the polygon centroid nearest the mean of its centroids."""
    own = centroids(edges).join(attributes.select("poly_id", sub_region), "poly_id")
    mean = own.groupBy(sub_region).agg(F.avg("cx").alias("_mx"), F.avg("cy").alias("_my"))
    d = F.pow(F.col("cx") - F.col("_mx"), 2) + F.pow(F.col("cy") - F.col("_my"), 2)
    best = own.join(mean, sub_region).groupBy(sub_region).agg(F.min(F.struct(F.round(d, 9).alias("d"), "poly_id", "cx", "cy")).alias("m"))
    return best.select(sub_region, "m.poly_id", "m.cx", "m.cy")


def inner_centroid(edges: DataFrame) -> DataFrame:
    """Centroid of each polygon, or a point inside where the centroid lies outside (``inside`` tells which).

    That point is the middle of the widest chord on the parallel through the centroid; where none is there, on that halfway through the
    polygon's latitudes. Polygons without an area have no row.
    """
    middle = centroids(edges).where("cx is not null").select("poly_id", "cx", "cy")
    inside = middle.join(edges, "poly_id").groupBy("poly_id").agg((F.count_if(crosses("cx", "cy")) % 2 == 1).alias("_in")).where("_in")
    half = edges.groupBy("poly_id").agg(((F.min(F.least("y1", "y2")) + F.max(F.greatest("y1", "y2"))) / 2).alias("_half"))
    lines = middle.join(half, "poly_id").select("poly_id", F.posexplode(F.array("cy", "_half")).alias("_k", "_y"))
    chord = widest_chord(edges, lines).groupBy("poly_id").agg(F.min(F.struct("_k", "_x", "_y")).alias("v"))
    out = middle.join(inside, "poly_id", "left").join(chord, "poly_id", "left")
    own = F.coalesce("_in", F.lit(False))
    return out.select("poly_id", F.when(own | F.col("v").isNull(), F.col("cx")).otherwise(F.col("v._x")).alias("cx"), F.when(own | F.col("v").isNull(), F.col("cy")).otherwise(F.col("v._y")).alias("cy"), own.alias("inside"))


def widest_chord(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Of each polygon and parallel (poly_id, _k, _y) the middle _x of the widest stretch inside; ties take the western one."""
    met = edges.join(lines, "poly_id").where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
    met = met.withColumn("_at", (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    w = Window.partitionBy("poly_id", "_k").orderBy("_at")
    pairs = met.withColumns({"_n": F.row_number().over(w), "_to": F.lead("_at").over(w)}).where("_n % 2 = 1 and _to is not null")
    best = pairs.groupBy("poly_id", "_k", "_y").agg(F.max(F.struct((F.col("_to") - F.col("_at")).alias("d"), (-F.col("_at")).alias("a"), F.col("_to"))).alias("m"))
    return best.select("poly_id", "_k", "_y", ((F.col("m._to") - F.col("m.a")) / 2).alias("_x"))


def recode(regions: DataFrame, codes: DataFrame, key: str, split_longitude: float) -> DataFrame:
    """New codes and names from a map; the part of a region east of a longitude gets a code of its own."""
    out = regions.join(codes.select(key, "new_code", "new_name"), key, "left")
    east = F.col("cx") >= split_longitude
    code = F.coalesce("new_code", F.col(key).cast("long"))
    return out.withColumn("code", F.when(east, code + 1000).otherwise(code)).withColumn("name", F.concat(F.coalesce("new_name", F.lit("region")), F.when(east, " east").otherwise(""))).drop("new_code", "new_name")


def level_names(df: DataFrame, level: int) -> DataFrame:
    """Columns named for their level: code, name and the codes above."""
    return df.toDF(*[f"level{level}Code", f"level{level}Name", *[f"level{k}Code" for k in range(level - 1, 0, -1)]])


def uncertainty_limit(points: DataFrame, resolution: float, lat: str = "lat") -> DataFrame:
    """Edge of a cell in metres at the latitude farthest from the equator: the most a coordinate may be off."""
    at = points.agg(F.max(F.abs(lat)).alias("latitude"))
    side = F.lit(resolution * DEGREE)
    return at.select("latitude", F.least(side, side * F.cos(F.radians("latitude"))).alias("metres"))


def dense_template(values: DataFrame, cells: int, cell: str = "cell") -> DataFrame:
    """All cells of a grid in order, null where the input has none."""
    grid = values.sparkSession.range(cells).withColumnRenamed("id", cell)
    return grid.join(values, cell, "left")


def stack_layers(layers: DataFrame, species: str, source: Grid | None = None, target: Grid | None = None, method: str = "near", binary: bool = False) -> DataFrame:
    """Cells of all species in one table with the species' place by its total score; optionally 0 or 1.

    With a ``source`` and ``target`` grid the layers are first moved to the target, by ``near`` or ``bilinear``.
    """
    order = layers.groupBy(species).agg(F.round(F.sum("value"), 6).alias("_t"))
    place = running_total(order.withColumn("_t", -F.col("_t")), ["_t", species], F.lit(1), "layer").withColumn("layer", F.col("layer").cast("int")).drop("_t")
    moved = resample(layers, source, target, method, [species]) if source else layers
    value = F.ceil("value").cast("double") if binary else F.col("value")
    return moved.join(place, species).withColumn("value", value)
