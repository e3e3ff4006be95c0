"""An index of polygons over square tiles of longitude and latitude, and a scanline fill for cells.

A point is inside a polygon if an odd number of edges crosses the ray to its east. For the points of one tile all edges whose west end
lies east of the tile count only by the parity of their end points above a point, and in a closed ring these cancel except where
the ring crosses the meridian of the tile's east side. So a tile needs the edges that reach into its columns, and one bit for everything
else. Without such edges the bit decides all points of the tile at once. Tiles are refined level by level, and only where edges are; a
point meets decided tiles of any level and the edges of its own finest tile. All tests are on the edges as given, so the answer is
that of the plain ray.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.shared import shared_folder, stored

#: Sides of tiles in degrees, from coarse to fine; powers of two, so that their borders are exact.
LEVELS = (8.0, 0.5)
#: Degrees by which the place of an edge inside a row of tiles may be wrong.
PAD = 1e-6
_TILE = ("poly_id", "_i", "_j")


def crosses(x: str, y: str):
    """The ray from (x, y) to the east crosses the edge."""
    straddles = (F.col("y1") > F.col(y)) != (F.col("y2") > F.col(y))
    return straddles & (F.col(x) < (F.col("x2") - F.col("x1")) * (F.col(y) - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))


def _level(edges: DataFrame, side: float, parents: DataFrame | None, ratio: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of one level: the edges that a tile must test ('c': does the ray cross it; 'm': does it cross the tile's eastern meridian and
    end above the point), and all tiles inside ``parents`` with their bit and whether they are borders."""
    low_x, high_x, low_y, high_y = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    cell = lambda v: F.floor(v / side)
    rows = edges.withColumn("_j", F.explode(F.sequence(cell(low_y), cell(high_y))))
    # The edge's own extent inside the row, a little wider.
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    bottom, top = F.greatest(low_y, F.col("_j") * side), F.least(high_y, (F.col("_j") + 1) * side)
    flat = F.col("y1") == F.col("y2")
    west = F.when(flat, low_x).otherwise(F.least(at(bottom), at(top))) - PAD
    east = F.when(flat, high_x).otherwise(F.greatest(at(bottom), at(top))) + PAD
    first = F.ceil(low_x / side) - 1  # the first column whose east side isn't west of the whole edge
    spans = (low_y <= F.col("_j") * side) & (high_y >= (F.col("_j") + 1) * side)
    ahead = F.when(F.col("x1") > F.col("x2"), F.col("y1")).otherwise(F.col("y2"))  # latitude of the eastern end
    rows = rows.withColumns({"_first": first, "_last": cell(east), "_v": ahead, "_m": F.when(cell(ahead) == F.col("_j"), F.ceil(high_x / side) - 2)})
    rows = rows.withColumn("_near", F.when(spans, F.greatest("_first", cell(west))).otherwise(F.col("_first")))
    run = lambda a, b, kind: F.when(b >= a, F.transform(F.sequence(a, b), lambda i: F.struct(i.alias("i"), F.lit(kind).alias("kind"))))
    none = F.array().cast("array<struct<i:bigint,kind:string>>")
    # 'c': to be tested. 'w': it passes through the row east of the tile, and counts for every point. 'm': it crosses the tile's eastern meridian and ends in the row.
    facts = F.concat(*[F.coalesce(x, none) for x in (F.when(~flat, run(F.col("_near"), F.col("_last"), "c")), run(F.col("_first"), F.col("_near") - 1, "w"), run(F.col("_first"), F.col("_m"), "m"))])
    facts = rows.withColumn("f", F.explode(facts)).select("poly_id", F.col("f.i").alias("_i"), "_j", F.col("f.kind").alias("kind"), "x1", F.when(F.col("f.kind") == "m", F.col("_v")).otherwise(F.col("y1")).alias("y1"), "x2", "y2")
    facts = stored(facts, folder, f"facts-{side}")
    if parents is None:
        box = edges.groupBy("poly_id").agg(*[f(cell(c)).alias(n) for n, f, c in (("a", F.min, low_x), ("b", F.max, high_x), ("c", F.min, low_y), ("d", F.max, high_y))])
        tiles = box.withColumn("_i", F.explode(F.sequence("a", "b"))).withColumn("_j", F.explode(F.sequence("c", "d"))).select(*_TILE)
    else:
        steps = lambda c: F.explode(F.sequence(F.col(c) * ratio, F.col(c) * ratio + ratio - 1))
        tiles = parents.select("poly_id", F.col("_i").alias("_pi"), F.col("_j").alias("_pj")).withColumn("_i", steps("_pi")).withColumn("_j", steps("_pj")).select(*_TILE)
    # All that is known of a tile stands half a row below the meridian crossings of its row, which are counted from the north.
    kind, flag = F.col("kind"), lambda c: c.cast("long")
    here = F.explode(F.filter(F.array(F.struct((F.col("_j") + 0.5).alias("at"), F.lit(0).cast("long").alias("e")), F.when(kind == "m", F.struct(F.col("_j").cast("double").alias("at"), F.lit(1).cast("long").alias("e")))), lambda x: x.isNotNull()))
    known = facts.select("poly_id", "_i", here.alias("h"), flag(kind == "w").alias("_w"), flag(kind != "w").alias("_b"), F.lit(0).cast("long").alias("_a"))
    known = known.select("poly_id", "_i", F.col("h.at").alias("_at"), F.col("h.e").alias("_e"), F.when(F.col("h.e") == 0, F.col("_w")).otherwise(0).alias("_w"), "_b", "_a")
    asked = tiles.select("poly_id", "_i", (F.col("_j") + 0.5).alias("_at"), *[F.lit(v).cast("long").alias(c) for c, v in (("_e", 0), ("_w", 0), ("_b", 0), ("_a", 1))])
    told = known.unionByName(asked).groupBy("poly_id", "_i", "_at").agg(F.sum("_e").alias("_e"), F.sum("_w").alias("_w"), F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    north = Window.partitionBy("poly_id", "_i").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = told.withColumn("_above", F.sum("_e").over(north)).where("_a = 1")
    tiles = out.select("poly_id", "_i", F.floor("_at").alias("_j"), ((F.col("_above") + F.col("_w")) % 2).cast("int").alias("bit"), (F.col("_b") == 1).alias("border"))
    return facts.where("kind <> 'w'"), stored(tiles, folder, f"tiles-{side}")


def polygon_index(edges: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Rows of tiles (level, _i, _j, poly_id) by kind: 'i' for a tile wholly inside; at the finest level also a row for each edge to test ('c', 'm'), and 'b' for a
    tile whose bit is set."""
    folder = shared_folder(edges.sparkSession, "tiles")
    edges = edges.select("poly_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).dropna()
    none = [F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    out, parents, local, tiles = None, None, None, None
    for k, side in enumerate(levels):
        local, tiles = _level(edges, side, parents, round(levels[k - 1] / side) if k else 1, folder)
        last = k == len(levels) - 1
        kind = F.when(F.col("border"), "b").otherwise("i")
        decided = tiles.where("bit = 1" if last else "bit = 1 and not border").select(F.lit(k).alias("level"), *_TILE, kind.alias("kind"), *none)
        out = decided if out is None else out.unionByName(decided)
        parents = tiles.where("border").select(*_TILE)
    own = parents.withColumnsRenamed({c: f"_{c}" for c in _TILE})
    same = (F.col("poly_id") == F.col("_poly_id")) & (F.col("_i") == F.col("__i")) & (F.col("_j") == F.col("__j"))
    tests = local.join(own, same, "left_semi").select(F.lit(len(levels) - 1).alias("level"), *_TILE, "kind", "x1", "y1", "x2", "y2")
    return stored(out.unionByName(tests), folder, "index")


def points_in_tiles(points: DataFrame, index: DataFrame, point_id: str, lon: str, lat: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Pairs of point and polygon. A point has one row for each level; the join is on (level, tile), so the points of a tile with very
    many of them are split. Points with a null place are in no polygon."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    placed = points.select(F.col(point_id), x.alias("_x"), y.alias("_y")).where("_x is not null and _y is not null")
    tile = lambda side, k: F.struct(F.lit(k).alias("level"), F.floor(F.col("_x") / side).alias("i"), F.floor(F.col("_y") / side).alias("j"))
    keyed = placed.withColumn("t", F.explode(F.array(*[tile(side, k) for k, side in enumerate(levels)])))
    keyed = keyed.select(point_id, "_x", "_y", "t.level", F.col("t.i").alias("_i"), F.col("t.j").alias("_j"))
    odd = F.when(F.col("kind").isin("i", "b"), True).when(F.col("kind") == "m", F.col("y1") > F.col("_y")).otherwise(crosses("_x", "_y"))
    met = keyed.join(index, ["level", "_i", "_j"]).groupBy(point_id, "poly_id").agg(F.count_if(odd).alias("_n"))
    return met.where("_n % 2 = 1").select(point_id, "poly_id")


def cells_in_polygons(edges: DataFrame, resolution: float) -> DataFrame:
    """cell and poly_id of each cell of the global grid whose centre is inside: crossings of the centres' parallels, in pairs from
    the east, are runs of cells."""
    columns, rows = round(360 / resolution), round(180 / resolution)
    edges = edges.select("poly_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).dropna().where("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    from_, to = F.floor((90 - high) / resolution) - 1, F.floor((90 - low) / resolution) + 1
    met = edges.withColumns({"_a": F.greatest(from_, F.lit(0)), "_b": F.least(to, F.lit(rows - 1))}).where("_b >= _a").withColumn("_row", F.explode(F.sequence("_a", "_b"))).withColumn("_y", 90 - F.col("_row") * resolution - resolution / 2)
    met = met.where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
    met = met.select("poly_id", "_row", ((F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("_to"))
    w = Window.partitionBy("poly_id", "_row").orderBy(F.col("_to").desc())
    runs = met.withColumns({"_k": F.row_number().over(w), "_from": F.lead("_to").over(w)}).where("_k % 2 = 1")
    # A run has the centres from _from (or the west) up to, but not at, _to.
    start = F.coalesce(F.floor((F.col("_from") + 180) / resolution - 0.5) - 1, F.lit(0))
    begin, end = F.greatest(start, F.lit(0)), F.least(F.floor((F.col("_to") + 180) / resolution - 0.5) + 1, F.lit(columns - 1))
    spread = runs.withColumns({"_a": begin, "_b": end}).where("_b >= _a").withColumn("_col", F.explode(F.sequence("_a", "_b"))).withColumn("_x", -180 + F.col("_col") * resolution + resolution / 2)
    kept = spread.where((F.col("_x") < F.col("_to")) & (F.col("_from").isNull() | (F.col("_x") >= F.col("_from"))))
    return kept.select((F.col("_row") * columns + F.col("_col")).alias("cell"), "poly_id")
