"""Polygon tiles, scanlines, grids, clipped rings and inside points against direct computation."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from taxaloom.functions import projections
from taxaloom.operators import grids, joins, spatial, tiles

VERTEX = "poly_id int, ring int, seq int, x double, y double"


def star(rng: random.Random, poly: int, ring: int, cx: float, cy: float, radius: float, corners: int, snap: float = 0.0) -> list[tuple]:
    out = []
    for k in range(corners):
        r = radius * rng.uniform(0.2, 1)
        x, y = cx + r * math.cos(2 * math.pi * k / corners), cy + r * math.sin(2 * math.pi * k / corners)
        out.append((poly, ring, k + 1, round(x / snap) * snap if snap else x, round(y / snap) * snap if snap else y))
    return out


def edges_of(rows: list[tuple]) -> dict[int, list[tuple]]:
    rings: dict[tuple, list] = {}
    for p, r, _, x, y in sorted(rows):
        rings.setdefault((p, r), []).append((x, y))
    out: dict[int, list] = {}
    for (p, _), v in rings.items():
        out.setdefault(p, []).extend((*a, *b) for a, b in zip(v, v[1:] + v[:1], strict=True))
    return out


def inside(edges: list[tuple], x: float, y: float) -> bool:
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1


def polygons(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = star(rng, 1, 1, 0, 0, 30, 400) + star(rng, 2, 1, 100, 40, 25, 9) + star(rng, 2, 2, 100, 40, 5, 7) + star(rng, 3, 1, -60, -30, 24, 40, snap=0.5) + star(rng, 4, 1, 5, 5, 0.3, 30)
    rows += [(5, 1, 1, -170.0, -80.0), (5, 1, 2, 170.0, -79.0), (5, 1, 3, 169.0, 80.0), (5, 1, 4, -150.0, 81.0)]
    return rows + [(6, 1, 1, 8.0, 8.0), (6, 1, 2, 16.0, 8.0), (6, 1, 3, 16.0, 16.0), (6, 1, 4, 8.0, 16.0)]


@pytest.mark.parametrize("levels", [(8.0, 0.5), (16.0, 2.0, 0.25), (4.0,)])
def test_tiles_equal_the_plain_ray(spark, levels):
    rng = random.Random(5)
    rows = polygons(2)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(1500)] + [(2000 + i, rng.uniform(-31, 31), rng.uniform(-31, 31)) for i in range(1500)]
    points += [(5000 + i, rng.choice([-60, 8, 0, 16, 100, -180, 180]) + rng.randint(-3, 3) * 0.5, rng.choice([-30, 8, 16, 40, 0]) + rng.randint(-3, 3) * 0.5) for i in range(400)] + [(9000, None, 1.0), (9001, 5.0, None)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    index = tiles.polygon_index(spatial.ring_edges(spark.createDataFrame(rows, VERTEX)), levels)
    got = {tuple(r) for r in tiles.points_in_tiles(df, index, "id", "lon", "lat", levels).collect()}
    want = {(i, p) for p, e in edges_of(rows).items() for i, x, y in points if x is not None and y is not None and inside(e, x, y)}
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("resolution", [5, 2.5, 1])
def test_scanlines_equal_the_plain_ray(spark, resolution):
    rows = polygons(3)
    got = {tuple(r) for r in tiles.cells_in_polygons(spatial.ring_edges(spark.createDataFrame(rows, VERTEX)), resolution).collect()}
    columns = round(360 / resolution)
    want = set()
    for p, e in edges_of(rows).items():
        for cell in range(columns * round(180 / resolution)):
            if inside(e, -180 + (cell % columns) * resolution + resolution / 2, 90 - (cell // columns) * resolution - resolution / 2):
                want.add((cell, p))
    assert got == want


def test_no_polygons_and_no_points(spark):
    edges = spatial.ring_edges(spark.createDataFrame([], VERTEX))
    assert tiles.cells_in_polygons(edges, 5).count() == 0
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lon double, lat double")
    assert spatial.points_in_polygons(df, edges, "id").count() == 0
    assert spatial.points_in_polygons(df.where("false"), spatial.ring_edges(spark.createDataFrame(polygons(1), VERTEX)), "id").count() == 0


def area(points: list[tuple]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


@pytest.mark.parametrize(("axis", "bound"), [("x", 0.0), ("y", 3.0), ("x", -500.0)])
def test_parts_of_clipped_rings_add_up(spark, axis, bound):
    rng = random.Random(9)
    rows = [r for p in range(1, 8) for r in star(rng, p, 1, rng.uniform(-8, 8), rng.uniform(-8, 8), 10, rng.randint(3, 30))]
    df = spark.createDataFrame(rows, VERTEX)
    parts = {}
    for upper in (True, False):
        for r in spatial.clip(df, axis, bound, upper).orderBy("poly_id", "seq").collect():
            parts.setdefault((r.poly_id, upper), []).append((r.x, r.y))
    for p in range(1, 8):
        whole = area([(x, y) for q, _, _, x, y in rows if q == p])
        assert sum(area(v) for (q, _), v in parts.items() if q == p) == pytest.approx(whole)
    for (_, upper), v in parts.items():
        assert all((c >= bound) if upper else (c <= bound) for c in (v_[0 if axis == "x" else 1] for v_ in v))


def test_split_leaves_whole_polygons_on_their_side(spark):
    rows = [(1, 1, 1, -5.0, 0.0), (1, 1, 2, -1.0, 0.0), (1, 1, 3, -1.0, 3.0), (2, 1, 1, 0.0, 0.0), (2, 1, 2, 4.0, 0.0), (2, 1, 3, 4.0, 4.0)]
    got = {(r.poly_id, r.side): r.n for r in spatial.split_at_meridian(spark.createDataFrame(rows, VERTEX)).groupBy("poly_id", "side").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "west"): 3, (2, "east"): 4}


def test_inside_point_of_a_bay(spark):
    c = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 5), (4, 5), (4, 6), (0, 6)]
    u = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 1), (2, 1), (2, 6), (0, 6)]
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    rows = [(p, 1, k, float(x), float(y)) for p, shape in ((1, c), (2, u), (3, square)) for k, (x, y) in enumerate(shape)]
    edges = edges_of(rows)
    got = {r.poly_id: r for r in spatial.inner_centroid(spatial.ring_edges(spark.createDataFrame(rows, VERTEX))).collect()}
    assert (got[3].cx, got[3].cy, got[3].inside) == (1.0, 1.0, True)
    for p in (1, 2):
        assert not got[p].inside and inside(edges[p], got[p].cx, got[p].cy)


@pytest.mark.parametrize("name", ["laea", "aeqd"])
def test_inverse_projections(spark, name):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.uniform(-179.9, 179.9), rng.uniform(-60, 89.9)) for _ in range(300)] + [(-180.0, 10.0), (0.0, 90.0)], "lon double, lat double")
    x, y = projections.PROJECTIONS[name](F.col("lon"), F.col("lat"))
    lon, lat = projections.INVERSES[name](F.col("x"), F.col("y"))
    for r in df.withColumns({"x": x, "y": y}).withColumns({"a": lon, "b": lat}).collect():
        assert r.b == pytest.approx(r.lat, abs=2e-6) and (r.lat == 90 or abs((r.a - r.lon + 180) % 360 - 180) < 1e-6) and -180 <= r.a < 180
    far = spark.createDataFrame([(4e7, 4e7)], "x double, y double").select(*[c.alias(n) for c, n in zip(projections.INVERSES[name](F.col("x"), F.col("y")), "ab", strict=True)]).first()
    assert far.a is None and far.b is None


@pytest.mark.parametrize("method", ["near", "bilinear"])
def test_resampling_equals_direct_look_ups(spark, method):
    rng = random.Random(2)
    source, target = grids.Grid.globe(10), grids.Grid(-180.0, 80.0, 4.0, 90, 38)
    values = {c: rng.uniform(0, 9) for c in range(source.cells) if rng.random() < 0.8}
    rows = [("a", c, v) for c, v in values.items()] + [("a", c, None) for c in range(source.cells) if c not in values] + [("b", 41, 1.5)]
    got = {(r.k, r.cell): r.value for r in grids.resample(spark.createDataFrame(rows, "k string, cell long, value double"), source, target, method, ["k"]).collect()}
    want = {}
    for cell in range(target.cells):
        x, y = -180 + (cell % 90 + 0.5) * 4, 80 - (cell // 90 + 0.5) * 4
        u, v = (x + 180) / 10, (90 - y) / 10
        if method == "near":
            near = [((int(v), int(u)), 1.0)]
        else:
            i, j = math.floor(u - 0.5), math.floor(v - 0.5)
            near = [((j + dj, (i + di) % 36), (u - 0.5 - i if di else 1 - (u - 0.5 - i)) * (v - 0.5 - j if dj else 1 - (v - 0.5 - j))) for di in (0, 1) for dj in (0, 1)]
        held = [(values[r * 36 + c], w) for (r, c), w in near if 0 <= r < 18 and r * 36 + c in values and w > 0]
        if held:
            want["a", cell] = sum(a * w for a, w in held) / sum(w for _, w in held)
    assert {k for k in got if k[0] == "a"} == set(want)
    assert all(got[k] == pytest.approx(v) for k, v in want.items()) and any(k[0] == "b" for k in got)


def test_containment_equals_brute_force(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 14))) for _ in range(150)] + [None, "", "abcabcabcabc", "abcabcabcabc"]
    items = ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 6))) for _ in range(120)] + [None, "", "zzz", "a", "é", "abcab"]
    a = spark.createDataFrame([(i,) for i in [*items, items[0]]], "item string")
    b = spark.createDataFrame(list(enumerate(names)), "id int, known string")
    for grams in (1, 2, 4, 9):
        got = sorted((r.item, r.id) for r in joins.containment_join(a, b, "item", "known", "id", grams).collect())
        assert got == sorted((i, k) for i in set(items) if i for k, n in enumerate(names) if n and i in n)
    assert joins.containment_join(a.where("false"), b, "item", "known", "id").count() == 0
