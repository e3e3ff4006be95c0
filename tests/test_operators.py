"""Operators on literal rows: nulls, ties, empty tables, and properties."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaloom.functions import names
from taxaloom.operators import checklist, joins, niche, rows, spatial, stats, zonal
from taxaloom.schemas import BACKBONE, assert_columns, with_missing
from taxaloom.sources import readers, writers


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_small_minus_known(spark):
    small = spark.createDataFrame([(x,) for x in ("Saxifraga oppositifolia", "Abelmoschus esculentus", "Abelmoschus manihot", "Dryas octopetala", "Eucalyptus regnans", "Phoenix dactylifera")], "name string")
    known = spark.createDataFrame([("Dryas octopetala",), ("Eucalyptus regnans",), ("Phoenix dactylifera",)], "name string")
    assert got(joins.anti_audited(small, known, ["name"])) == [("Abelmoschus esculentus",), ("Abelmoschus manihot",), ("Saxifraga oppositifolia",)]
    assert joins.inner_audited(small, known, ["name"]).count() == 3


def test_anti_and_semi_partition_the_left_side(spark):
    left = spark.createDataFrame([(i,) for i in range(20)], "k int")
    right = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "k int")
    assert joins.anti_audited(left, right, ["k"]).count() + left.join(right, "k", "left_semi").count() == 20


def test_union_distinct_is_idempotent(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), (None, 2)], "n string, v int")
    once = rows.union_distinct(a, a)
    assert got(once) == got(rows.union_distinct(once, once)) == [("x", 1), (None, 2)] or got(once) == got(rows.union_distinct(once, once))
    assert rows.union_distinct(a, a, drop_null_rows=True).count() == 1


def test_union_audit_counts_nulls_and_repeats_by_their_own_names(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,)], "n string")
    b = spark.createDataFrame([("y",), ("x",)], "n string")
    assert rows.union_audit(a, b).first().asDict() == {"rows_a": 3, "rows_b": 2, "merged": 3, "duplicates": 2, "incomplete": 1, "added": 1}


def test_union_audit_of_empty_tables(spark):
    e = spark.createDataFrame([], "n string")
    assert tuple(rows.union_audit(e, e).first()) == (0, 0, 0, 0, 0, 0)


def test_keep_first_breaks_ties_by_the_last_key(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 1, 3), (None, 2, 1), (None, 1, 2)], "k string, v int, id int")
    assert got(rows.keep_first(df, ["k"], ["v", "id"])) == [("a", 1, 3), (None, 1, 2)]


def test_fill_down_resets_below_a_higher_level(spark):
    df = spark.createDataFrame([(1, "A", None), (2, None, "f"), (3, None, None), (4, "B", None), (5, None, None), (6, None, "g")], "line int, class string, family string").withColumn("k", F.lit(0))
    out = {r.line: (r["class"], r.family) for r in rows.fill_down(df, ["k"], "line", ["class", "family"]).collect()}
    assert out == {1: ("A", None), 2: ("A", "f"), 3: ("A", "f"), 4: ("B", None), 5: ("B", None), 6: ("B", "g")}


@pytest.mark.parametrize("part_rows", [1000, 3])
def test_running_totals_are_the_same_in_parts(spark, part_rows):
    data = [(k, j, i) for i, (k, j) in enumerate((k, j) for k in ("b", None, "a", "c") for j in (2, None, 1, 5, 9))]
    df = spark.createDataFrame(data, "k string, j int, v int")
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    want = [(*r, sum(x[2] for x in order[: i + 1])) for i, r in enumerate(order)]
    assert got(rows.running_total(df, ["k", "j"], F.col("v"), "t", part_rows)) == sorted(want, key=str)
    assert got(rows.group_ids(df, ["k"], "id").select("k", "id").distinct()) == sorted([(None, 1), ("a", 2), ("b", 3), ("c", 4)], key=str)


def test_group_aggregates_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    assert got(rows.with_group_aggregates(df, ["k"], n=F.count("*"))) == [("a", 1, 1), (None, 2, 2), (None, 3, 2)]


def test_mode_takes_the_smallest_of_ties_and_blank_for_none(spark):
    df = spark.createDataFrame([("s", "b", None), ("s", "a", None), ("t", "z", "q")], "k string, c string, d string")
    assert got(zonal.mode_per_column(df, "k", ["c", "d"])) == [("s", "a", ""), ("t", "z", "q")]


def test_cell_richness_is_null_only_if_all_are(spark):
    df = spark.createDataFrame([(1, None), (1, 1.0), (2, None)], "cell int, inclusion double")
    assert got(zonal.cell_richness(df, ["cell"])) == [(1, 1.0), (2, None)]


def test_clean_split_moves_all_rows_of_a_mismatched_name(spark):
    df = spark.createDataFrame([("a", "a", 0), ("a", "b", 4), ("c", "c", 0)], "n string, f string, d int")
    out = checklist.clean_split(df, "n", "f", "d", 3)
    assert sorted((r.n, r.outcome) for r in out.collect()) == [("a", "mismatch"), ("a", "mismatch"), ("c", "clean")]


def test_cascade_matches_each_row_once(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, None, "q")], "id int, u string, v string")
    b = spark.createDataFrame([(10, "x", "q"), (11, "z", "p")], "id int, u string, v string")
    assert got(joins.cascading_match(a, b, [("u", "u"), ("v", "v")], "id", "id")) == [(1, 10, 1), (2, 11, 2)]


def test_cascade_keeps_all_pairs_of_a_key(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "y", "p")], "id int, u string, v string")
    b = spark.createDataFrame([(10, "x", "p"), (11, "x", "p"), (12, "w", "p")], "id int, u string, v string")
    assert got(joins.cascading_match(a, b, [("u", "u"), ("v", "v")], "id", "id")) == [(1, 10, 1), (1, 11, 1), (2, 10, 1), (2, 11, 1), (3, 12, 2)]


def test_fuzzy_match_finds_edits_anywhere(spark):
    """Against the distance to every name, with up to four random edits."""
    rng = random.Random(3)
    base = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))) for _ in range(60)})
    wanted = []
    for b in base:
        s = list(b)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        wanted.append("".join(s))
    names_ = spark.createDataFrame([(w,) for w in wanted], "name string")
    backbone = spark.createDataFrame(list(enumerate(base)), "id long, b string")
    every = names_.distinct().crossJoin(backbone).withColumn("d", F.levenshtein("name", "b")).where("d <= 3")
    want = got(every.groupBy("name").agg(F.min(F.struct("d", "id", "b")).alias("m")).select("name", "m.id", "m.b", "m.d"))
    assert got(joins.fuzzy_match(names_, backbone, "name", "b", "id")) == want and len(want) > 20


def test_fuzzy_match_prefers_distance_then_id(spark):
    wanted = spark.createDataFrame([("Betula nanna",), ("Betula nana",), ("Zea mays",)], "name string")
    backbone = spark.createDataFrame([(7, "Betula nana"), (5, "Betula nigra"), (9, "Betula nanae")], "id int, b string")
    assert got(joins.fuzzy_match(wanted, backbone, "name", "b", "id")) == [("Betula nana", 7, "Betula nana", 0), ("Betula nanna", 7, "Betula nana", 1)]


@pytest.mark.parametrize(("raw", "kind", "clean", "other"), [
    ("Calypso bulbosa var. americana (R.Br.) Luer", "infraspecificTaxon", "Calypso bulbosa var. americana", "(R.Br.) Luer"),
    ("Chrysosplenium alternifolium subsp. arctomontanum V.V.Petrovsky", "infraspecificTaxon", "Chrysosplenium alternifolium subsp. arctomontanum", "V.V.Petrovsky"),
    ("Poa alpina ssp. vivipara", "infraspecificTaxon", "Poa alpina subsp. vivipara", None),
    ("Poa alpina f. L. nana", "infraspecificTaxon", "Poa alpina f. nana", None),
    ("Poa alpina subsp. vivipara var. nana L.", "MultiInfraspecificTaxon", "Poa alpina subsp. vivipara", None),
    ("Musa × paradisiaca L.", "intraGenericHybrid", "Musa × paradisiaca", "L."),
    ("Opuntia ×bernichiana", "intraGenericHybrid", "Opuntia × bernichiana", None),
    ("Musa x paradisiaca", "intraGenericHybrid", "Musa × paradisiaca", None),
    ("× Dupoa labradorica", "interGenericHybrid", "× Dupoa labradorica", None),
    ("Poa alpina × Festuca rubra L.", "interGenericHybrid", "Poa alpina × Festuca rubra", "L."),
    ("Salix alba × fragilis", "interSpecificHybrid", "Salix alba × fragilis", None),
    ("Salix alba × S. fragilis L.", "interSpecificHybrid", "Salix alba × fragilis", "L."),
    ("Salix alba × Salix fragilis", "interSpecificHybrid", "Salix alba × fragilis", None),
    ("Salix alba × fragilis × caprea", "MultiIntraSpecificHybrid", "Salix alba × fragilis × caprea", None),
    ("Salix alba ×", "unknownHybrid", "Salix alba ×", None),
    ("× Dupoa labradorica subsp. nana", "interGenericHybridTaxon", "× Dupoa labradorica subsp. nana", None),
    ("Salix × alba var. nana", "interSpecificHybridTaxon", "Salix × alba var. nana", None),
    ("Salix alba L. f. × fragilis subsp. nana", "unknownInfraHybrid", "Salix alba L. f.", "× fragilis subsp. nana"),
    ("Rosa rugosa 'Alba'", "cultivar", "Rosa rugosa 'Alba'", None),
    ("Rosa 'Alba'", "cultivar", "Rosa 'Alba'", None),
    ("Rosa × 'Alba'", "hybridCultivar", "Rosa × 'Alba'", None),
    ("Saxifraga oppositifolia", "species", "Saxifraga oppositifolia", None),
    ("Huperzia selago (L.) Bernh. ex Schrank & Mart.", "species", "Huperzia selago", "(L.) Bernh. ex Schrank & Mart."),
    ("Silene samojedorum (= Lychnis x) Oxelman", "species", "Silene samojedorum", "Oxelman"),
    ("Carex cf. nigra", "species", "Carex nigra", "cf."),
    ("Poa alpina L. f.", "species", "Poa alpina", "L. f."),
    ("Poa alpina var.", "species", "Poa alpina", "var."),
    ("Draba", "species", "Draba", None),
    ("", "empty", None, None),
])
def test_name_structure(spark, raw, kind, clean, other):
    row = names.name_parts(spark.createDataFrame([(raw,)], "name string"), "name").first()
    assert (row.structure, row.clean_name, row.other) == (kind, clean, other)
    assert kind in names.STRUCTURES and row.full_name == (f"{clean} {other}" if other else clean)


def test_name_parts(spark):
    df = spark.createDataFrame([("× Dupoa labradorica subsp. nana",), ("Salix alba × S. fragilis L.",), ("Poa alpina subsp. vivipara var. nana L.",)], "name string")
    out = {r.name: r for r in names.name_parts(df, "name").collect()}
    a, b, c = (out[r.name] for r in df.collect())
    assert (a.genus, a.specific_epithet, a["rank"], a.infra_epithet, a.hybrid) == ("× Dupoa", "labradorica", "subsp.", "nana", "×")
    assert (b.genus, b.specific_epithet, b.hybrid, b.extra) == ("Salix", "alba × fragilis", "×", None)
    assert (c.infra_epithet, c.extra) == ("vivipara", "Poa alpina var. nana L.")


def test_null_name_has_no_parts(spark):
    row = names.name_parts(spark.createDataFrame([(None,)], "name string"), "name").first()
    assert (row.structure, row.clean_name) == ("empty", None)


def test_wrapped_lines_fit(spark):
    text = spark.createDataFrame([("one two three four five six",)], "t string").select(names.wrapped(F.col("t"), 10).alias("w")).first().w
    assert text.split("\n") == ["one two", "three four", "five six"]


def test_clean_text(spark):
    df = spark.createDataFrame([('  Poa "alpina" L..  – x subsp. K, y\u00a0z x a. X ab. “q”',)], "t string").select(names.clean_text(F.col("t")).alias("t"))
    assert df.first().t == "Poa alpina L. - subsp. K. y z x a. X ab. “q”"


def test_points_near_listed_places_across_the_date_line_and_near_the_pole(spark):
    points = spark.createDataFrame([("s", 1, -179.95, 10.0), ("s", 2, 100.0, 89.8), ("s", 3, 60.9, 80.0), ("s", 4, 50.0, 80.0), ("s", 5, 51.0, 79.0), ("s", 6, 180.0, 10.0)], "sp string, id int, lon double, lat double")
    listed = spark.createDataFrame([(179.9, 10.0), (-80.0, 89.9), (58.5, 80.0)], "x double, y double")
    kept = spatial.coordinate_tests(points, "sp", listed, 60_000, outlier_factor=100.0)
    assert sorted(r.id for r in kept.collect()) == [4, 5]


def test_point_on_each_side_of_a_triangle(spark):
    v = spark.createDataFrame([(1, 1, 1, 0.0, 0.0), (1, 1, 2, 10.0, 0.0), (1, 1, 3, 0.0, 10.0)], "poly_id int, ring int, seq int, x double, y double")
    p = spark.createDataFrame([(1, 2.0, 2.0), (2, 8.0, 8.0), (3, -1.0, 5.0), (4, 180.0, 5.0), (5, -180.0, 5.0)], "id int, lon double, lat double")
    edges = spatial.ring_edges(v)
    assert got(spatial.points_in_polygons(p, edges, "id")) == [(1, 1)]
    assert spatial.orientation(edges).first().sense == "counter-clockwise"
    assert tuple(spatial.centroids(edges).select("cx", "cy").first()) == pytest.approx((10 / 3, 10 / 3))


def test_polygon_text_round_trip(spark):
    df = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 3, 0 0), (1 1, 2 1, 1 2, 1 1))")], "id int, wkt string")
    v = spatial.parse_polygons(df, "id", "wkt")
    assert v.groupBy("ring").count().orderBy("ring").collect() == [(1, 3), (2, 3)]
    assert spatial.bounding_box(v, ["poly_id"]).first().wkt == "POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))"


def test_thinning_leaves_one_record_in_a_cell(spark):
    p = spark.createDataFrame([("s", i, (i * 37 % 100) / 10, (i * 53 % 100) / 10) for i in range(200)], "sp string, id int, lon double, lat double")
    out = spatial.thin(p, "sp", "id", 2 * 111_320, 1).collect()
    cells = {(math.floor(r.lon / 2), math.floor(r.lat / 2)) for r in out}
    assert len(cells) == len(out) == 25


def niche_of(spark, shift: float):
    data = [("a", f"a{i}", float(i % 5), float(i // 5), 0.5 + i % 3, 1.0 + i % 2) for i in range(60)] + [("b", f"b{i}", shift + i % 5, float(i // 5), 0.5 + i % 3, 1.0 + i % 2) for i in range(60)]
    return spark.createDataFrame(data, "species string, id string, x double, y double, z double, w double")


@pytest.mark.parametrize(("shift", "low", "high"), [(0.0, 0.9, 1.0), (100.0, 0.0, 0.0)])
def test_niche_overlap_of_equal_and_disjoint_sets(spark, shift, low, high):
    dims = ("x", "y", "z", "w")
    df = niche_of(spark, shift)
    widths = niche.bandwidths(df, "species", dims)
    points = niche.sample_points(df, widths, "species", "id", dims, 4, 1)
    covered = niche.covering(points, df, widths, "species", "pt", dims)
    v = {r.species: r.volume for r in niche.volumes(covered, widths, "species", dims, 4).collect()}
    one = points.where("species = 'a'").withColumn("species", F.lit("b"))
    inside = niche.covering(one, df, widths, "species", "pt", dims).select("pt").withColumn("i", F.lit(1.0))
    share = covered.where("species = 'a'").join(inside, "pt", "left").agg(F.sum(F.coalesce("i", F.lit(0.0)) / F.col("boxes")) / F.sum(1 / F.col("boxes"))).first()[0]
    out = niche.overlap_statistics(spark.createDataFrame([(v["a"], v["b"], share)], "v_species double, v_region double, share_inside double")).first()
    assert low <= out.jaccard <= out.sorensen <= 1 and out.jaccard <= high


def test_niches_are_sampled_by_the_plan_of_each_species(spark, monkeypatch):
    from taxaloom.plans import niches

    df = niche_of(spark, 100.0).where("species = 'a' or id < 'b3'")
    plan = niche.sampling_plan(niche.dimensionality_gate(df, "species", 4), 0)
    dims = ("x", "y", "z", "w")
    widths = niche.bandwidths(df, "species", dims).join(plan.select("species", "samples_per_point"), "species")
    points = niche.sample_points(df, widths, "species", "id", dims, "samples_per_point", 1)
    assert got(points.groupBy("species").count()) == got(plan.select("species", "random_points"))
    volume = {r.species: r.volume for r in niche.volumes(niche.covering(points, df, widths, "species", "pt", dims), widths, "species", dims, "samples_per_point").collect()}
    fixed = niche.sample_points(df, widths, "species", "id", dims, 40, 2)
    for r in niche.volumes(niche.covering(fixed, df, widths, "species", "pt", dims), widths, "species", dims, 40).collect():
        assert volume[r.species] == pytest.approx(r.volume, rel=0.15)

    made, sample = [], niche.sample_points
    monkeypatch.setattr(niche, "sample_points", lambda *a: made.append(sample(*a)) or made[-1])
    niches.n12(spark, "/root/testdata/sf0.001")
    counts = [r["count"] for r in made[0].groupBy("species").count().collect()]
    assert len(counts) > 1 and min(counts) >= 100_000


def test_gate_opens_above_exp_d(spark):
    n = math.exp(4)
    df = spark.createDataFrame([("no", i) for i in range(math.floor(n))] + [("yes", i) for i in range(math.ceil(n))], "s string, i int")
    assert got(niche.dimensionality_gate(df, "s", 4).select("s", "excluded")) == [("no", True), ("yes", False)]


def test_tail_probabilities():
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_two_sided(0, 5) == pytest.approx(1)


def test_false_discovery_keeps_order(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.005, 0.5))], "k int, p double")
    out = stats.false_discovery(df, "p", "k", 0.05).orderBy("p").collect()
    assert [r.p_adjusted for r in out] == sorted(r.p_adjusted for r in out)
    assert out[0].p_adjusted == pytest.approx(0.025)


def test_rank_sum_of_separate_groups(spark):
    df = spark.createDataFrame([(float(i), i < 20) for i in range(40)], "v double, a boolean")
    r = stats.rank_sum(df, "v", F.col("a")).first()
    assert r.u == 0 and r.p < 1e-6


def test_permanova_ranks_in_parts_like_one_order(spark, monkeypatch):
    rows = [(i, i % 3, float(i % 7), float(i * i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g int, x double, y double")

    def f(labels: list[int]) -> float:
        square = lambda own: sum(sum(v) ** 2 / len(v) for v in ([r[2] for r in own], [r[3] for r in own]))
        between = sum(square([r for r, g in zip(rows, labels, strict=True) if g == k]) for k in range(3)) - square(rows)
        total = sum(r[2] ** 2 + r[3] ** 2 for r in rows) - square(rows)
        return between / 2 / ((total - between) / 57)

    real, least = f([r[1] for r in rows]), 0
    for perm in range(1, 40):
        order = sorted(range(60), key=lambda i: hashlib.md5(f"5|{perm}|{i}".encode()).hexdigest())
        labels = [0] * 60
        for rank, i in enumerate(order):
            labels[i] = rank // 20
        least += f(labels) >= real
    monkeypatch.setattr(stats, "PART_ROWS", 7)
    out = stats.permanova(df, ["x", "y"], "g", "id", 39, 5).first()
    assert out.pseudo_f == pytest.approx(real) and out.p == pytest.approx((1 + least) / 40)


def test_permanova_query_has_999_permutations(spark, monkeypatch):
    from taxaloom.plans import statistics

    asked, plain = [], stats.permanova
    monkeypatch.setattr(stats, "permanova", lambda *a: asked.append(a[4]) or plain(*a))
    statistics.m6p(spark, "/root/testdata/sf0.001")
    assert asked == [999]


def test_schema_check(spark):
    df = spark.createDataFrame([("1",)], "taxonID string")
    with pytest.raises(ValueError):
        assert_columns(df, BACKBONE)
    assert assert_columns(with_missing(df, BACKBONE), BACKBONE).first().taxonRank is None


def test_numbered_lines_and_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a preamble\nname,x\nPoa,1\nTotal,1\nZea,\n")
    lines = readers.numbered_lines(spark, str(tmp_path / "m.txt"))
    assert got(readers.read_matrix(lines, 2).select("name", "x")) == [("Poa", "1"), ("Zea", None)]


def test_reused_table_is_made_once(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert writers.reused(spark, str(tmp_path / "t"), make).count() == 3
    assert len(calls) == 1


def test_principal_components_equal_those_of_the_correlation_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]]) + 5
    out = {r.variable: r for r in stats.principal_components(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"], 2).collect()}
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    for i, c in enumerate("abc"):
        assert out[c].loadings == pytest.approx(np.abs(vectors[i, ::-1][:2]))
        assert out[c].importance == pytest.approx(np.abs(vectors[i, ::-1][:2]).sum())
        assert out[c].explained == pytest.approx(values[::-1][:2].sum() / values.sum())


def test_model_comparison_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, 150)
    y = 0.3 + x - 0.5 * x**3 + rng.normal(0, 0.1, 150)
    basis = stats.spline_basis(F.col("x"), (-0.5, 0.5))
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double").select("y", *[c.alias(n) for n, c in basis.items()])
    columns = {"x1": x, "x2": x**2, "x3": x**3, "k0": np.maximum(x + 0.5, 0) ** 3, "k1": np.maximum(x - 0.5, 0) ** 3}
    nested = {"line": ["x1"], "cubic": ["x1", "x2", "x3"], "spline": list(columns)}
    out = {r.model: r for r in stats.compare_models(df, "y", nested).collect()}
    for name, used in nested.items():
        a = np.column_stack([np.ones(150), *[columns[c] for c in used]])
        rss = ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()
        k, likelihood = a.shape[1], -75 * (math.log(2 * math.pi * rss / 150) + 1)
        assert (out[name].deviance, out[name].explained) == pytest.approx((rss, 1 - rss / ((y - y.mean()) ** 2).sum()), rel=1e-4)
        assert (out[name].aic, out[name].bic) == pytest.approx((2 * (k + 1) - 2 * likelihood, (k + 1) * math.log(150) - 2 * likelihood), rel=1e-4)


def test_zero_inflated_models_equal_newton_and_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 400)
    p = 1 / (1 + np.exp(-(1.5 - 3 * x)))
    y = np.where(rng.random(400) < p, 0.0, np.clip(1 / (1 + np.exp(-(x - 2 + rng.normal(0, 0.3, 400)))), 0, 1))
    df = spark.createDataFrame(list(zip(x.tolist(), (x * x).tolist(), y.tolist(), strict=True)), "x1 double, x2 double, y double")
    nested = {"line": ["x1"], "square": ["x1", "x2"]}
    out = {(r.part, r.model): r for r in stats.zero_inflated_models(df, "y", nested).collect()}
    for name, used in nested.items():
        a = np.column_stack([np.ones(400), *[{"x1": x, "x2": x * x}[c] for c in used]])
        z, b = (y == 0).astype(float), np.zeros(a.shape[1])
        for _ in range(50):
            q = 1 / (1 + np.exp(-a @ b))
            b += np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]), a.T @ (z - q))
        q = 1 / (1 + np.exp(-a @ b))
        want = (z * np.log(q) + (1 - z) * np.log(1 - q)).sum()
        assert out["zero", name].log_likelihood == pytest.approx(want, rel=1e-5)
        assert out["zero", name].bic == pytest.approx(a.shape[1] * math.log(400) - 2 * want, rel=1e-5)
        t = np.log(y[y > 0] / (1 - y[y > 0]))
        rest = a[y > 0]
        rss = ((t - rest @ np.linalg.lstsq(rest, t, rcond=None)[0]) ** 2).sum()
        assert out["positive", name].log_likelihood == pytest.approx(-len(t) / 2 * (math.log(2 * math.pi * rss / len(t)) + 1), rel=1e-5)


@pytest.mark.parametrize("part_rows", [100_000, 7])
def test_permanova_p_equals_permutations_by_hand(spark, part_rows, monkeypatch):
    monkeypatch.setattr(stats, "PART_ROWS", part_rows)
    rng = np.random.default_rng(4)
    group = np.repeat(["a", "b", "c"], [12, 9, 14])
    x = rng.normal(size=(35, 2)) + (group == "b")[:, None] * 0.6
    df = spark.createDataFrame([(i, str(g), *map(float, v)) for i, (g, v) in enumerate(zip(group, x, strict=True))], "id long, g string, x double, y double")

    def pseudo_f(labels):
        within = sum(((x[labels == g] - x[labels == g].mean(axis=0)) ** 2).sum() for g in "abc")
        total = ((x - x.mean(axis=0)) ** 2).sum()
        return ((total - within) / 2) / (within / 32), 1 - within / total

    real, r2 = pseudo_f(group)
    higher = 0
    for k in range(1, 100):
        order = sorted(range(35), key=lambda i: (hashlib.md5(f"5|{k}|{i}".encode()).hexdigest(), i))
        labels = np.empty(35, dtype="<U1")
        labels[order] = group
        higher += pseudo_f(labels)[0] >= real
    row = stats.permanova(df, ["x", "y"], "g", "id", 99, 5).first()
    assert (row.pseudo_f, row.r2, row.p) == pytest.approx((real, r2, (1 + higher) / 100))


def test_niche_volumes_and_overlap_equal_counting_every_box(spark):
    """The planned points of two species against all boxes, by numpy."""
    rng = np.random.default_rng(5)
    dims = ["a", "b", "c", "d"]
    data = {"s": rng.normal(size=(90, 4)), "t": rng.normal(size=(150, 4)) * [1, 2, 1, 0.5] + 0.4}
    rows_ = [(k, f"{k}{i}", *map(float, v)) for k, x in data.items() for i, v in enumerate(x)]
    points = spark.createDataFrame(rows_, "species string, id string, a double, b double, c double, d double")
    plan = niche.sampling_plan(niche.dimensionality_gate(points, "species", 1), 1).withColumn("samples_per_point", F.floor(F.col("samples_per_point") / 20))
    widths = niche.bandwidths(points, "species", dims).join(plan.select("species", "samples_per_point"), "species")
    sampled = niche.sample_points(points, widths, "species", "id", dims, "samples_per_point", 7)
    covered = niche.covering(sampled, points, widths, "species", "pt", dims)
    volume = {r.species: r.volume for r in niche.volumes(covered, widths, "species", dims, "samples_per_point").collect()}
    other = niche.inside(sampled.where("species = 's'").withColumn("species", F.lit("t")), points, widths, "species", "pt", dims).count()
    drawn = sampled.toPandas()
    hits = 0
    for k, x in data.items():
        n, each = len(x), math.ceil(10**4 / len(x)) // 20
        w = x.std(axis=0, ddof=1) * (n * 6 / 4) ** (-1 / 8)
        own = drawn[drawn.species == k]
        assert len(own) == n * each > 400
        boxes = (np.abs(own[dims].to_numpy()[:, None, :] - x[None]) <= w).all(axis=2).sum(axis=1)
        assert volume[k] == pytest.approx(np.prod(2 * w) * (1 / boxes).sum() / each)
        if k == "t":
            hits = (np.abs(drawn[drawn.species == "s"][dims].to_numpy()[:, None, :] - x[None]) <= w).all(axis=2).any(axis=1).sum()
    assert other == hits > 0


def test_p_values_of_the_registered_correlations(spark):
    from taxaloom import registry

    def two_sided(t: float, df: int) -> float:
        # The tail's integral of Student's density, by a substitution that makes it finite.
        u = np.linspace(0, 1, 200_001)[1:]
        x = abs(t) + (1 - u) / u
        logs = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df)
        return float(2 * np.trapezoid(np.exp(logs) / u**2, u))

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    out = registry.queries()["M1_correlation_p_values"](spark, sf).collect()
    assert len(out) == 6
    for r in out:
        assert r.n == n and r.p == pytest.approx(two_sided(r.t, n - 2), abs=2e-4)


def test_gates_of_the_niche_pipeline_in_their_order(spark):
    import duckdb

    from taxaloom import registry

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in "region nation supplier part lineitem".split():
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    enough = {s for s, n in c.sql("select p_brand, count(*) from lineitem join part on l_partkey = p_partkey group by 1").fetchall() if math.log(n) > 4}
    included = {s for s, _, stopped in c.sql(registry.oracle_sql()["N4_inclusion_test"]).fetchall() if not stopped}
    out = registry.queries()["N12_niche_pipeline"](spark, sf).collect()
    assert {r.species for r in out} == enough & included
    volume = dict((s, v) for s, _, v in c.sql(registry.oracle_sql()["N5_box_volume"]).fetchall())
    order = dict(c.sql("select p_brand, arg_min(p_type, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))) from lineitem join part on l_partkey = p_partkey group by 1").fetchall())
    for r in out:
        assert r.volume == pytest.approx(volume[r.species], abs=1e-6) and r["order"] == order[r.species]
