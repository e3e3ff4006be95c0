"""Spatial queries: occurrences, a global grid, and polygons generated from nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaloom.functions import projections
from taxaloom.operators import grids, rows, spatial, tiles
from taxaloom.plans import base as b
from taxaloom.plans.base import CTE
from taxaloom.registry import query

_VERT = """vert as (select n_nationkey as poly_id, 1 as ring, seq, -180 + (n_nationkey * 37) % 330 + dx * (10 + n_nationkey % 15) as x, -80 + (n_nationkey * 23) % 140 + dy * (8 + n_nationkey % 12) as y
  from nation cross join (values (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, 1)) v(seq, dx, dy) where n_nationkey % 3 <> 0 or seq < 4)"""
_EDGE = """edge as (select poly_id, ring, seq, x as x1, y as y1, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from vert window w as (partition by poly_id, ring order by seq))"""
_CROSS = "(y1 > {y}) <> (y2 > {y}) and {x} < (x2 - x1) * ({y} - y1) / (y2 - y1)::double + x1"
_INSIDE = f"select obs_id, poly_id from occ join edge on {_CROSS.format(x='lon', y='lat')} group by all having count(*) % 2 = 1"
_CELL = "(floor((90 - lat) / 5) * 72 + floor((lon + 180) / 5))::bigint"
_GRID = f"""grid as (select {_CELL} as cell, round(avg(bio1), 9) as bio1, round(avg(bio2), 9) as bio2, round(avg(bio3), 9) as bio3, round(avg(bio4), 9) as bio4 from occ group by 1)"""
_CENTRE = "centre as (select *, -180 + (cell % 72) * 5 + 2.5 as x, 90 - (cell // 72) * 5 - 2.5 as y from grid)"


def sql(body: str, *more: str, occ: bool = True) -> str:
    return f"with {', '.join([CTE['occ']] * occ + list(more))} {body}"


def _vert(s, d):
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, x, y in ((1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, 1))]))
    v = b.table(s, d, "nation").select("n_nationkey", corners.alias("v")).where("n_nationkey % 3 <> 0 or v.seq < 4")
    return v.selectExpr("n_nationkey as poly_id", "1 as ring", "v.seq as seq", "-180 + (n_nationkey * 37) % 330 + v.dx * (10 + n_nationkey % 15) as x", "-80 + (n_nationkey * 23) % 140 + v.dy * (8 + n_nationkey % 12) as y")


def _edge(s, d):
    return spatial.ring_edges(_vert(s, d))


def _grid(s, d):
    cell = spatial.cell_of(F.col("lon"), F.col("lat"), 5).cast("long").alias("cell")
    return b.occ(s, d).groupBy(cell).agg(*[F.round(F.avg(c), 9).alias(c) for c in ("bio1", "bio2", "bio3", "bio4")])


def _centre(s, d):
    return _grid(s, d).selectExpr("*", "-180 + (cell % 72) * 5 + 2.5D as x", "90 - floor(cell / 72) * 5 - 2.5D as y")


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("W12_ring_edges", f"with {_VERT}, {_EDGE} select * from edge")
def w12(s, d):
    return _edge(s, d)


@query("S9_region_polygons", f"with {_VERT} select poly_id, ring, seq, x::double as x, y::double as y from vert")
def s9(s, d):
    text = _vert(s, d).groupBy("poly_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.concat_ws(" ", "x", "y").alias("p")))).alias("v"))
    wkt = text.select("poly_id", F.concat(F.lit("POLYGON (("), F.array_join(F.transform("v", lambda p: p["p"]), ", "), F.lit(", "), F.col("v")[0]["p"], F.lit("))")).alias("wkt"))
    return spatial.parse_polygons(wkt, "poly_id", "wkt")


@query("P7_bounding_box", f"""with {_VERT}, x as (select poly_id, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y from vert group by 1) select *, 'POLYGON ((' || min_x || ' ' || min_y || ', ' || max_x || ' ' || min_y || ', ' || max_x || ' ' || max_y || ', ' || min_x || ' ' || max_y || ', ' || min_x || ' ' || min_y || '))' as wkt from x""")
def p7(s, d):
    return spatial.bounding_box(_vert(s, d).withColumns({c: F.col(c).cast("double") for c in "xy"}), ["poly_id"]).withColumns({c: F.col(c).cast("int") for c in ("min_x", "max_x", "min_y", "max_y")})


@query("P8_ring_orientation", f"with {_VERT}, {_EDGE} select poly_id, ring, sum(x1 * y2 - x2 * y1) / 2 as area, case when sum(x1 * y2 - x2 * y1) > 0 then 'counter-clockwise' else 'clockwise' end as sense from edge group by all")
def p8(s, d):
    return spatial.orientation(_edge(s, d))


@query("J13_points_in_polygons", sql(_INSIDE, _VERT, _EDGE))
def j13(s, d):
    return spatial.points_in_polygons(b.occ(s, d), _edge(s, d), "obs_id")


@query("J14_values_at_points", sql(f"select obs_id, g.bio1, g.bio2 from occ o join grid g on g.cell = (floor((90 - o.lat) / 5) * 72 + floor((o.lon + 180) / 5))::bigint where o.has_coordinate", _GRID))
def j14(s, d):
    points = b.occ(s, d).where("has_coordinate").select("obs_id", "lon", "lat")
    return spatial.values_at_points(points, _grid(s, d), 5, ["bio1", "bio2"]).select("obs_id", "bio1", "bio2")


@query("J15_cells_to_regions", sql(f"select c.cell, min(i.poly_id) as poly_id from centre c left join (select cell, poly_id from centre join edge on {_CROSS.format(x='x', y='y')} group by all having count(*) % 2 = 1) i using (cell) group by 1", _GRID, _CENTRE, _VERT, _EDGE))
def j15(s, d):
    return spatial.cells_to_regions(_grid(s, d), _edge(s, d), 5)


@query("S8_climate_cells", sql("select cell, bio1, bio2, bio3, bio4 from grid", _GRID))
def s8(s, d):
    return _grid(s, d)


@query("S10_raster_to_rows", sql(f"select cell, bio1 as value, poly_id from centre join edge on {_CROSS.format(x='x', y='y')} group by all having count(*) % 2 = 1", _GRID, _CENTRE, _VERT, _EDGE))
def s10(s, d):
    return _grid(s, d).join(tiles.cells_in_polygons(_edge(s, d), 5), "cell").select("cell", F.col("bio1").alias("value"), "poly_id")


_THIN = "select clean_name, arg_min(obs_id, (md5(concat_ws('|', '12034', obs_id)), obs_id)) as obs_id from (select *, floor((lon - min(lon) over (partition by clean_name)) / r) as i, floor((lat - min(lat) over (partition by clean_name)) / r) as j from (select *, 1113200 / 111320.0::double as r from {})) group by clean_name, i, j"


@query("G1_thin_occurrences", sql(_THIN.format("occ")))
def g1(s, d):
    return spatial.thin(b.occ(s, d).select("clean_name", "obs_id", "lon", "lat"), "clean_name", "obs_id", 1_113_200, 12034).select("clean_name", "obs_id")


_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({b})) * pow(sin(radians({a} - lon) / 2), 2))))"
_TEST = f"""ok as (select * from occ where lon between -180 and 180 and lat between -90 and 90 and lon <> lat and not (lon = 0 and lat = 0)),
  away as (select * from ok o where not exists (select 1 from vert v where {_HAV.format(a='v.x', b='v.y')} <= 60000)),
  far as (select *, {_HAV.format(a='mx', b='my')} as dist from away join (select clean_name, median(lon) mx, median(lat) my from away group by 1) using (clean_name)),
  kept as (select * from far join (select clean_name, median(dist) * 1.5 as lim from far group by 1) using (clean_name) where dist <= lim)"""


@query("G3_coordinate_tests", sql("select obs_id from kept", _VERT, _TEST))
def g3(s, d):
    return spatial.coordinate_tests(b.occ(s, d).select("obs_id", "clean_name", "lon", "lat"), "clean_name", _vert(s, d), 60_000, 1.5).select("obs_id")


_ONE = "one as (select clean_name, lon, lat, min(obs_id) as obs_id from occ group by all)"
_CLEAN = f"{_VERT}, {_ONE}, {_TEST.replace('from occ', 'from one').replace('60000', '10000').replace('* 1.5', '* 5')}"


@query("G2_clean_occurrences", sql(f"select t.clean_name, t.obs_id, round(median(k.lat) over (partition by t.clean_name), 6) as median_lat from ({_THIN.format('kept')}) t join kept k using (obs_id)", _CLEAN))
def g2(s, d):
    return _rounded(spatial.clean_occurrences(b.occ(s, d), "clean_name", "obs_id", _vert(s, d), 1_113_200, 12034).select("clean_name", "obs_id", "median_lat"), 6, "median_lat")


@query("G4_prepared_species", sql(f"select p_brand as clean_name, n is null as excluded, coalesce(n, 0) as points from (select distinct p_brand from part) left join (select clean_name, count(*) as n from ({_THIN.format('kept')}) group by 1) on clean_name = p_brand", _CLEAN))
def g4(s, d):
    kept = spatial.clean_occurrences(b.occ(s, d), "clean_name", "obs_id", _vert(s, d), 1_113_200, 12034).groupBy("clean_name").agg(F.count("*").alias("n"))
    names = b.table(s, d, "part").select(F.col("p_brand").alias("clean_name")).distinct()
    return names.join(kept, "clean_name", "left").select("clean_name", F.col("n").isNull().alias("excluded"), F.coalesce("n", F.lit(0)).alias("points"))


@query("G5_scale_layers", sql("select cell, round((bio1 - avg(bio1) over ()) / stddev_samp(bio1) over (), 6) as bio1, round((bio2 - avg(bio2) over ()) / stddev_samp(bio2) over (), 6) as bio2 from grid", _GRID))
def g5(s, d):
    return _rounded(spatial.scale_layers(_grid(s, d).select("cell", "bio1", "bio2"), ["bio1", "bio2"]), 6, "bio1", "bio2")


_CROP = f"select distinct cell from (select cell from centre join edge on {_CROSS.format(x='x', y='y')} group by cell, poly_id having count(*) % 2 = 1)"


@query("G6_crop_and_mask", sql(f"select cell, bio1 from grid where cell in ({_CROP})", _GRID, _CENTRE, _VERT, _EDGE))
def g6(s, d):
    return spatial.crop(_grid(s, d), _edge(s, d), 5).select("cell", "bio1")


@query("G7_pick_layers", sql("select cell, variable, value from (select cell, bio1, bio3 from grid) unpivot (value for variable in (bio1, bio3))", _GRID))
def g7(s, d):
    return _grid(s, d).unpivot(["cell"], ["bio1", "bio2", "bio3", "bio4"], "variable", "value").where(F.col("variable").isin("bio1", "bio3"))


_A, _F = 6378137.0, 298.257223563
_E2 = 2 / _F - 1 / _F**2
_Q = "(1 - {e2}) * ({s} / (1 - {e2} * {s} * {s}) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e}))"


@query("G8_reproject", sql(f"select obs_id, round(rho * sin(radians(lon)), 3) as px, round(-rho * cos(radians(lon)), 3) as py from (select *, {_A} * sqrt(greatest(0.0, {_Q.format(e2=f'{_E2!r}::double', e=f'{_E2**0.5!r}::double', s='1.0::double')} - {_Q.format(e2=f'{_E2!r}::double', e=f'{_E2**0.5!r}::double', s='sin(radians(lat))')})) as rho from occ where lat > 0)"))
def g8(s, d):
    return _rounded(spatial.reproject(b.occ(s, d).where("lat > 0"), "laea").select("obs_id", "px", "py"), 3, "px", "py")


#: Polar inverses in SQL: longitude and latitude of (x, y).
_LON = "(case when degrees(atan2(x, -y)) >= 180 then degrees(atan2(x, -y)) - 360 else degrees(atan2(x, -y)) end)"
_QP = projections.Q_POLE
_BETA = f"asin(greatest(-1.0::double, least(1.0::double, ({_QP!r}::double - (x * x + y * y) / ({_A}::double * {_A}::double)) / {_QP!r}::double)))"
_INVERSE = {
    "laea": f"degrees({_BETA} + " + " + ".join(f"{c!r}::double * sin({2 * k} * {_BETA})" for k, c in enumerate(projections.SERIES, 1)) + ")",
    "aeqd": "90 - degrees(sqrt(x * x + y * y) / 6371000.0::double)",
}
_NEAR = "select cell, value from (select t.cell, (floor((90 - lat) / {r})::bigint * {c} + floor((lon + 180) / {r})::bigint) as source from target t where lat >= -90 and floor((90 - lat) / {r}) < {n}) join src using (source) where value is not null"
_BILINEAR = """select cell, sum(value * w) / sum(w) as value from (select cell, (cast(j as bigint) * {c} + ((cast(i as bigint) % {c}) + {c}) % {c}) as source, w from (
    select cell, floor(u) + di as i, floor(v) + dj as j, (case di when 1 then u - floor(u) else 1 - (u - floor(u)) end) * (case dj when 1 then v - floor(v) else 1 - (v - floor(v)) end) as w
    from (select cell, (lon + 180) / {r} - 0.5 as u, (90 - lat) / {r} - 0.5 as v from target where lat >= -90) cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) n(di, dj)) where w > 0 and j >= 0 and j < {n}) join src using (source) where value is not null group by cell"""


def _target(projection: str, west: float, resolution: float, columns: int) -> str:
    lat = _INVERSE[projection]
    return f"target as (select cell, {_LON} as lon, {lat} as lat from (select cell, {west}::double + (cell % {columns} + 0.5::double) * {resolution}::double as x, {-west}::double - (cell // {columns} + 0.5::double) * {resolution}::double as y from (select unnest(range(0, {columns * columns})) as cell)))"


#: Squares around the pole, in metres, whose cells don't divide the 5-degree grid's evenly.
_LAEA, _AEQD = grids.Grid(-8_900_000.0, 8_900_000.0, 222_500.0, 80, 80, "laea"), grids.Grid(-9_990_000.0, 9_990_000.0, 270_000.0, 74, 74, "aeqd")


def _of(grid: grids.Grid) -> str:
    return _target(grid.projection, grid.west, grid.resolution, grid.columns)


@query("G8_resample_near", sql(_NEAR.format(r=5, c=72, n=36), _GRID, "src as (select cell as source, bio1 as value from grid)", _of(_LAEA)))
def g8_near(s, d):
    return grids.resample(_grid(s, d).select("cell", F.col("bio1").alias("value")), grids.Grid.globe(5), _LAEA, "near")


@query("G8_resample_bilinear", sql(f"select cell, round(value, 6) as value from ({_BILINEAR.format(r=5, c=72, n=36)})", _GRID, "src as (select cell as source, case when cell % 7 <> 0 then bio2 end as value from grid)", _of(_AEQD)))
def g8_bilinear(s, d):
    layer = _grid(s, d).select("cell", F.when(F.col("cell") % 7 != 0, F.col("bio2")).alias("value"))
    return _rounded(grids.resample(layer, grids.Grid.globe(5), _AEQD, "bilinear"), 6, "value")


def _clip_sql(axis: str, bound: str, sign: str, source: str = "edge") -> str:
    """Rings cut at a bound of an axis, the part with the sign kept: as it is stated in spatial.clip."""
    other = "y" if axis == "x" else "x"
    cut = f"{other}1 + ({other}2 - {other}1) * ({bound} - {axis}1) / ({axis}2 - {axis}1)::double"
    new = (bound, cut) if axis == "x" else (cut, bound)
    return f"""(select poly_id, ring, row_number() over (partition by poly_id, ring order by seq, n) as seq, x, y from (select *, max({axis} {sign} {bound}) over (partition by poly_id, ring) as reach from (
    select poly_id, ring, seq, 1 as n, x1::double as x, y1::double as y from {source} where {axis}1 {sign}= {bound} union all
    select poly_id, ring, seq, 2, {new[0]}, {new[1]} from {source} where ({axis}1 < {bound} and {axis}2 > {bound}) or ({axis}1 > {bound} and {axis}2 < {bound}))) where reach)"""


_SIDES = "select poly_id, 'west' as side, seq, x, y from {} union all select poly_id, 'east', seq, x, y from {}"


@query("G9_antimeridian_split", f"with {_VERT}, {_EDGE} select poly_id, side, seq, round(x, 6) as x, round(y, 6) as y from ({_SIDES.format(_clip_sql('x', '0.0::double', '<'), _clip_sql('x', '0.00001::double', '>'))})")
def g9(s, d):
    return _rounded(spatial.split_at_meridian(_vert(s, d)).select("poly_id", "side", "seq", "x", "y"), 6, "x", "y")


@query("G9_split_areas", f"with {_VERT}, {_EDGE} select poly_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 4) as area from edge group by 1")
def g9_areas(s, d):
    """The areas of both parts of each polygon, cut without a gap; SQL has the area of the whole."""
    parts = spatial.ring_edges(spatial.split_at_meridian(_vert(s, d), gap=0.0), ("poly_id", "ring", "side"))
    area = spatial.orientation(parts, ("poly_id", "ring", "side")).groupBy("poly_id").agg(F.sum(F.abs("area")).alias("area"))
    return _rounded(area, 4, "area")


_CENT = "cent as (select poly_id, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3.0::double * sum(x1 * y2 - x2 * y1)) as cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3.0::double * sum(x1 * y2 - x2 * y1)) as cy from edge group by 1)"


@query("G10_sub_region_centroid", f"""with {_VERT}, {_EDGE}, {_CENT}, own as (select * from cent join nation on poly_id = n_nationkey), m as (select n_regionkey, avg(cx) mx, avg(cy) my from own group by 1)
  select n_regionkey as sub_region, arg_min(poly_id, (round(pow(cx - mx, 2) + pow(cy - my, 2), 9), poly_id)) as poly_id from own join m using (n_regionkey) group by 1""")
def g10(s, d):
    att = b.table(s, d, "nation").selectExpr("n_nationkey as poly_id", "n_regionkey as sub_region")
    return spatial.sub_region_centroid(_edge(s, d), att, "sub_region").select("sub_region", "poly_id")


#: Polygons with a bay from the east: the letter C, of which the centroid lies in the bay or in the bow.
_CVERT = """cvert as (select n_nationkey as poly_id, 1 as ring, seq, -170.0::double + n_nationkey * 9 + px * (2 + n_nationkey % 4) as x, -60.0::double + (n_nationkey * 29) % 110 + py * (1 + n_nationkey % 5) as y
  from nation cross join (values (1, 0, 0), (2, 4, 0), (3, 4, 1), (4, 1, 1), (5, 1, 5), (6, 4, 5), (7, 4, 6), (8, 0, 6)) v(seq, px, py))"""
_CCHORD = """line as (select poly_id, k, case k when 0 then cy else (lo + hi) / 2 end as y from (select poly_id, cx, cy, (select min(y1) from edge e where e.poly_id = cent.poly_id) as lo, (select max(y1) from edge e where e.poly_id = cent.poly_id) as hi from cent) cross join (values (0), (1)) v(k)),
  met as (select poly_id, k, y, (x2 - x1) * (y - y1) / (y2 - y1) + x1 as x from edge join line using (poly_id) where (y1 > y) <> (y2 > y)),
  pair as (select *, lead(x) over w as x2, row_number() over w as n from met window w as (partition by poly_id, k order by x)),
  chord as (select poly_id, arg_max((x + x2) / 2, (-k, x2 - x, -x)) as x, arg_max(y, (-k, x2 - x, -x)) as y from pair where n % 2 = 1 group by 1),
  ok as (select poly_id from cent c join edge e using (poly_id) where (y1 > cy) <> (y2 > cy) and cx < (x2 - x1) * (cy - y1) / (y2 - y1) + x1 group by 1 having count(*) % 2 = 1)"""
_CEDGE = _EDGE.replace("from vert", "from cvert")


def _cvert(s, d):
    corners = [(1, 0, 0), (2, 4, 0), (3, 4, 1), (4, 1, 1), (5, 1, 5), (6, 4, 5), (7, 4, 6), (8, 0, 6)]
    v = b.table(s, d, "nation").select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("px"), F.lit(y).alias("py")) for i, x, y in corners])).alias("v"))
    return v.selectExpr("n_nationkey as poly_id", "1 as ring", "v.seq as seq", "-170.0D + n_nationkey * 9 + v.px * (2 + n_nationkey % 4) as x", "-60.0D + (n_nationkey * 29) % 110 + v.py * (1 + n_nationkey % 5) as y")


@query("G11_region_centroid", f"with {_VERT}, {_EDGE}, {_CENT}, {_CCHORD} select c.poly_id, round(case when ok.poly_id is null then h.x else cx end, 6) as cx, round(case when ok.poly_id is null then h.y else cy end, 6) as cy, ok.poly_id is not null as inside from cent c left join ok using (poly_id) left join chord h using (poly_id)")
def g11(s, d):
    return _rounded(spatial.inner_centroid(_edge(s, d)), 6, "cx", "cy")


@query("G11_inside_points", f"with {_CVERT}, {_CEDGE}, {_CENT}, {_CCHORD} select c.poly_id, round(case when ok.poly_id is null then h.x else cx end, 6) as cx, round(case when ok.poly_id is null then h.y else cy end, 6) as cy, ok.poly_id is not null as inside, 1::bigint as found from cent c left join ok using (poly_id) left join chord h using (poly_id)")
def g11_inside(s, d):
    """Polygons with a bay; ``found`` counts how often the point lies in its own polygon by J13."""
    edges = spatial.ring_edges(_cvert(s, d))
    points = spatial.inner_centroid(edges)
    own = spatial.points_in_polygons(points.withColumnRenamed("poly_id", "own"), edges, "own", "cx", "cy").where("own = poly_id").groupBy("poly_id").agg(F.count("*").alias("found"))
    return _rounded(points.join(own, "poly_id", "left"), 6, "cx", "cy")


@query("G12_region_recode", f"with {_VERT}, {_EDGE}, {_CENT} select poly_id, case when cx >= 40 then 1000 else 0 end + case when r_regionkey is null then poly_id else r_regionkey end::bigint as code, coalesce(r_name, 'region') || case when cx >= 40 then ' east' else '' end as name from cent left join region on r_regionkey = poly_id")
def g12(s, d):
    codes = b.table(s, d, "region").selectExpr("r_regionkey as poly_id", "cast(r_regionkey as long) as new_code", "r_name as new_name")
    return spatial.recode(spatial.centroids(_edge(s, d)), codes, "poly_id", 40).select("poly_id", "code", "name")


@query("G13_region_level_names", "select n_nationkey as level3Code, n_name as level3Name, n_regionkey as level2Code, r_regionkey as level1Code from nation join region on n_regionkey = r_regionkey")
def g13(s, d):
    rows = b.table(s, d, "nation").join(b.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return spatial.level_names(rows.select("n_nationkey", "n_name", "n_regionkey", "r_regionkey"), 3)


@query("G14_uncertainty_limit", sql("select max(abs(lat)) as latitude, round(least(0.0416 * 111320.0, 0.0416 * 111320.0 * cos(radians(max(abs(lat))))), 4) as metres from occ where abs(lat) < 85"))
def g14(s, d):
    return _rounded(spatial.uncertainty_limit(b.occ(s, d).where("abs(lat) < 85"), 0.0416), 4, "metres")


_SCORE = "select species, row_number() over (order by round(sum(v), 6) desc, species)::int as layer from (select species, cell, max(suitability) as v from cells group by all) group by species"


@query("G15_stack_layers", f"with {CTE['cells']} select species, cell, layer, ceil(max(suitability)) as value from cells join ({_SCORE}) using (species) group by all")
def g15(s, d):
    one = b.cells(s, d).groupBy("species", "cell").agg(F.max("suitability").alias("value"))
    return spatial.stack_layers(one, "species", binary=True)


#: Squares of ten degrees, and a coarse square around the pole.
_POLAR = grids.Grid(-8_800_000.0, 8_800_000.0, 1_100_000.0, 16, 16, "laea")


@query("G15_stack_projected", f"with {CTE['cells']}, {_of(_POLAR)}, one as (select species, cell, max(suitability) as v from cells group by all), looked as (select t.cell, floor((90 - lat) / 10)::bigint * 36 + floor((lon + 180) / 10)::bigint as source from target t where lat >= -90) select species, looked.cell, layer, ceil(v) as value from one join looked on looked.source = one.cell join ({_SCORE}) using (species)")
def g15_projected(s, d):
    one = b.cells(s, d).groupBy("species", "cell").agg(F.max("suitability").alias("value"))
    return spatial.stack_layers(one, "species", grids.Grid.globe(10), _POLAR, "near", binary=True)


@query("G16_dense_template", sql("select r.cell, bio1 from (select unnest(range(0, 2592)) as cell) r left join grid using (cell)", _GRID))
def g16(s, d):
    return spatial.dense_template(_grid(s, d).select("cell", "bio1"), 2592)


@query("G17_world_polygons", f"with {_VERT}, {_EDGE} select poly_id, seq, round(6371000.0 * radians(90 - y) * sin(radians(x)), 3) as px, round(-6371000.0 * radians(90 - y) * cos(radians(x)), 3) as py from {_clip_sql('y', '0.0::double', '>')}")
def g17(s, d):
    north = spatial.clip(_vert(s, d), "y", 0.0, True)
    return _rounded(spatial.reproject(north, "aeqd", "x", "y").select("poly_id", "seq", "px", "py"), 3, "px", "py")


_LATEST = "latest as (select species, cell, arg_min(suitability, obs) as value from (select *, row_number() over (partition by species, cell order by obs desc) as k from cells where cell between 50 and 400) where k = 1 group by all)"


@query("G18_grid_repair", f"with {CTE['cells']}, {_LATEST} select species, cell, ceil(value) as value from latest")
def g18(s, d):
    return _latest(s, d).withColumn("value", F.ceil("value").cast("double"))


def _latest(s, d):
    last = rows.keep_first(b.cells(s, d).where("cell between 50 and 400"), ["species", "cell"], ["-obs", "suitability"])
    return last.select("species", "cell", F.col("suitability").alias("value"))


@query("G18_resample_template", f"with {CTE['cells']}, {_LATEST}, looked as (select cell, floor((90 - y) / 10)::bigint * 36 + floor((x + 180) / 10)::bigint as source from (select cell, -180 + (cell % 90) * 4 + 2.0::double as x, 76 - (cell // 90) * 4 - 2.0::double as y from (select unnest(range(0, 3060)) as cell))) select species, looked.cell, ceil(value) as value from latest join looked on looked.source = latest.cell")
def g18_template(s, d):
    """Layers of ten degrees on a template of four, from 76 north to 60 south."""
    return grids.resample(_latest(s, d), grids.Grid.globe(10), grids.Grid(-180.0, 76.0, 4.0, 90, 34), "near", ["species"], ceiling=True)


@query("G19_connection_points", sql("select distinct dataset_key, round(6371000.0 * radians(90 - lat) * sin(radians(lon)), 2) as px, round(-6371000.0 * radians(90 - lat) * cos(radians(lon)), 2) as py from (select dataset_key, round(avg(lon), 3) as lon, round(avg(lat), 3) as lat from occ group by 1)"))
def g19(s, d):
    ends = b.occ(s, d).groupBy("dataset_key").agg(F.round(F.avg("lon"), 3).alias("lon"), F.round(F.avg("lat"), 3).alias("lat"))
    return _rounded(spatial.reproject(ends, "aeqd").select("dataset_key", "px", "py").distinct(), 2, "px", "py")


@query("G20_climate_preparation", sql(f"select cell, round(z1, 6) as bio1, round(z2, 6) as bio2 from (select cell, (bio1 - avg(bio1) over ()) / stddev_samp(bio1) over () as z1, (bio2 - avg(bio2) over ()) / stddev_samp(bio2) over () as z2 from grid) where cell in ({_CROP})", _GRID, _CENTRE, _VERT, _EDGE))
def g20(s, d):
    scaled = spatial.scale_layers(_grid(s, d), ["bio1", "bio2"])
    return _rounded(spatial.crop(scaled, _edge(s, d), 5).select("cell", "bio1", "bio2"), 6, "bio1", "bio2")
