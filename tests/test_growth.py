"""Work that must not grow faster than the tables: repeated values, large groups and skewed keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from taxaloom import registry
from taxaloom.operators import joins, niche, rows, spatial, stats
from taxaloom.sources import writers

DIMS = ("x", "y", "z", "v")


def _records(spark, n, copies):
    rng = random.Random(5)
    held = [("s", *[round(rng.random(), 1) for _ in DIMS]) for _ in range(n)]
    return held, spark.createDataFrame([(f"{i}-{k}", *r) for i, r in enumerate(held) for k in range(copies)], "id string, species string, " + ", ".join(f"{c} double" for c in DIMS))


def test_equal_records_are_one_box(spark):
    held, df = _records(spark, 200, 6)
    widths = spark.createDataFrame([("s", 0.2, 0.2, 0.2, 0.2)], "species string, " + ", ".join(f"w_{c} double" for c in DIMS))
    boxes = niche._boxes(df, widths, "species", DIMS)
    assert boxes.count() == len(set(held)) and boxes.agg(F.sum("_many")).first()[0] == 1200
    points = spark.createDataFrame([(i, "s", *[0.05 + (i * k) % 10 / 10 for k in (1, 3, 7, 9)]) for i in range(60)], "pt long, species string, " + ", ".join(f"{c} double" for c in DIMS))
    direct = {p.pt: sum(6 for r in held if all(abs(a - b) <= 0.2 for a, b in zip(r[1:], p[2:], strict=True))) for p in points.collect()}
    counted = {r.pt: r.boxes for r in niche.covering(points, df, widths, "species", "pt", DIMS).collect()}
    assert counted == {k: v for k, v in direct.items() if v}
    once = niche.covered_points(points, df, widths, "species", "pt", DIMS)
    assert sorted(r.boxes for r in once.collect()) == sorted(counted.values())
    # Points are counted where they met their boxes: the plan groups them without another exchange of points.
    plan = niche.covered_points(points, df, widths, "species", "pt", DIMS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "pt#" in x]


def test_lattice_bins_of_equal_ranges_are_spread_once(spark):
    _, df = _records(spark, 300, 3)
    widths = niche.bandwidths(df, "species", DIMS)
    w = [widths.first()[f"w_{c}"] for c in DIMS]
    steps = [x * 0.7 for x in w]
    found = {tuple(r) for r in niche.occupied_bins(df, widths, "species", DIMS, steps).collect()}
    direct = set()
    for r in df.collect():
        spans = [[b for b in range(-10, 40) if abs((b + 0.5) * s - r[c]) <= x + 1e-12] for c, s, x in zip(DIMS, steps, w, strict=True)]
        direct |= {("s", a, b, c, d) for a in spans[0] for b in spans[1] for c in spans[2] for d in spans[3]}
    assert found == direct


def test_union_of_intervals_by_cells(spark):
    rng = random.Random(9)
    values = [round(rng.random() * 50, 3) for _ in range(400)] * 3 + [500.0]
    df = spark.createDataFrame([("s", v, 1.0) for v in values], "species string, x double, y double")
    widths = spark.createDataFrame([("s", 0.05, 0.0)], "species string, w_x double, w_y double")
    found = {r.dim: r.length for r in niche.interval_volumes(df, "species", ("x", "y"), widths).collect()}
    different = sorted(set(values))
    direct = 0.1 + sum(min(b - a, 0.1) for a, b in zip(different, different[1:], strict=False))
    assert abs(found["x"] - direct) < 1e-9 and found["y"] == 0
    # No window sees all values of a dimension but the one over cells.
    plan = niche.interval_volumes(df, "species", ("x", "y"), widths)._jdf.queryExecution().analyzed().toString()
    assert "_cell" in plan


def test_join_audit_drops_repeats_before_it_joins(spark):
    a = spark.createDataFrame([("n", f"c{i % 3}") for i in range(3000)] + [("m", None)], "k string, a string")
    b = spark.createDataFrame([("n", f"d{i % 4}") for i in range(3000)] + [(None, "d")], "k string, b string")
    out = joins.inner_audited(a, b, ["k"])
    assert sorted(map(tuple, out.collect())) == sorted(("n", f"c{i}", f"d{j}") for i in range(3) for j in range(4))
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Join" in plan[0] or "Join" in plan[1]


def test_pairs_of_a_large_key_are_many_tasks_work(spark):
    a = spark.createDataFrame([(i, "big" if i < 700 else f"k{i % 40}") for i in range(900)] + [(-1, None)], "id long, k string")
    b = spark.createDataFrame([(i, "big" if i < 500 else f"k{i % 50}") for i in range(700)] + [(-2, None)], "other long, k string")
    out = joins.all_pairs(a, b, ["k"], "id", "other", block=64)
    left, right = a.collect(), b.collect()
    direct = sorted((x.k, x.id, y.other) for x in left for y in right if x.k is not None and x.k == y.k)
    assert sorted(map(tuple, out.collect())) == direct
    held = [r["n"] for r in out.where("k = 'big'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(held) < 0.6 * sum(held)


def test_equal_names_are_searched_once(spark):
    names = spark.createDataFrame([(i, f"salix {'alba' if i % 2 else 'nigra'}") for i in range(400)], "id long, name string")
    items = spark.createDataFrame([("alba",), ("lix n",), ("x",), ("absent",)], "item string")
    out = joins.containment_join(items, names, "item", "name", "id")
    wanted, held = items.collect(), names.collect()
    direct = sorted((i.item, n.id, n.name) for i in wanted for n in held if i.item in n.name)
    assert sorted(map(tuple, out.collect())) == direct
    # The search sees different names only: a grouping of the names stands below the search for runs.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert max(plan.count("Aggregate [_name"), plan.count("Aggregate [name")) >= 2


def test_fill_down_orders_once(spark):
    df = spark.createDataFrame([(1, 1, "a", None, None), (1, 2, None, "f", None), (1, 3, None, None, "g"), (1, 4, None, "h", None), (1, 5, "b", None, "z"), (1, 6, None, None, None), (2, 1, None, "q", None), (2, 2, "c", None, None)], "k int, i int, one string, two string, three string")
    out = rows.fill_down(df, ["k"], "i", ["one", "two", "three"])
    want = [(1, 1, "a", None, None), (1, 2, "a", "f", None), (1, 3, "a", "f", "g"), (1, 4, "a", "h", None), (1, 5, "b", None, "z"), (1, 6, "b", None, "z"), (2, 1, None, "q", None), (2, 2, "c", None, None)]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == want
    plan = rows.fill_down(df, ["k"], "i", ["one", "two", "three"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Sort [") == 1


def test_models_fit_equal_rows_once(spark, monkeypatch):
    rng = random.Random(3)
    held = [(round(rng.random(), 1), 0.0 if rng.random() < 0.4 else round(0.1 + 0.8 * rng.random(), 1)) for _ in range(300)]
    one = spark.createDataFrame([(x, x * x, y) for x, y in held], "x double, x2 double, y double")
    many = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("i")
    kept = []
    monkeypatch.setattr(stats, "stored", lambda df, *where: kept.append(df.count()) or df)
    nested = {"line": ["x"], "square": ["x", "x2"]}
    a = {(r.part, r.model): r for r in stats.zero_inflated_models(one, "y", nested).collect()}
    b = {(r.part, r.model): r for r in stats.zero_inflated_models(many, "y", nested).collect()}
    assert kept == [len(set(held))] * 2
    assert all(abs(b[k].log_likelihood - 3 * a[k].log_likelihood) < 1e-3 for k in a)


def test_coordinate_tests_store_points_once(spark, monkeypatch):
    points = spark.createDataFrame([(i, "s", i % 37 / 10 + 1, i % 41 / 10 + 9) for i in range(300)], "id int, species string, lon double, lat double")
    listed = spark.createDataFrame([(100.0, 50.0)], "x double, y double")
    kept = []
    real = spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, folder, name: kept.append((name, df.count())) or real(df, folder, name))
    assert spatial.coordinate_tests(points, "species", listed, 1000.0).count() <= 300
    assert sum(n for _, n in kept) < 302


def test_bucketed_tables_are_sorted_in_parts_of_a_size(spark, tmp_path):
    df = spark.range(20_000, numPartitions=1).selectExpr("concat('s', id % 50) as species", "sha2(string(id), 256) as note")
    hot = spark.range(40_000, numPartitions=16).selectExpr("'hot' as species", "sha2(string(id), 256) as note")
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for name, rows_, share in (("sorted_even", df, 0.4), ("sorted_hot", hot, 0.2)):
            table = writers.write_bucketed(rows_, name, f"file://{tmp_path}/{name}", "species", 4)
            # A task's number stands in its files' names: one input partition is several tasks' work, and so is one species.
            tasks = table.groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).alias("task")).count().collect()
            assert max(r["count"] for r in tasks) < share * rows_.count(), tasks
            assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows_.collect()))
            assert "Exchange" not in table.groupBy("species").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in ("sorted_even", "sorted_hot"):
            spark.sql(f"drop table if exists {name}")


def test_bucketed_records_are_dealt_while_they_are_narrow(spark, monkeypatch):
    dealt = []
    real = writers.deal
    monkeypatch.setattr(writers, "deal", lambda df, key: dealt.append((key, df.columns)) or real(df, key))
    for name in ("S12_bucketed_sink", "S12_bucketed_names"):
        dealt.clear()
        registry.queries()[name](spark, "/root/testdata/sf0.001")
        # After the join, which may split a large key as long as its sides aren't dealt by hand.
        assert [key for key, columns in dealt if {"l_partkey", "p_partkey"} <= set(columns)] == ["l_partkey"]
        assert not [columns for _, columns in dealt if "obs_id" in columns]


def test_records_with_their_number_count_as_repeated(spark):
    _, df = _records(spark, 150, 4)
    once = niche.different(df, ["species"], DIMS)
    assert once.count() < 600 and once.agg(F.sum("many")).first()[0] == 600
    plain, weighed = niche.bandwidths(df, "species", DIMS).first(), niche.bandwidths(once, "species", DIMS, "many").first()
    assert plain.n == weighed.n == 600
    assert all(abs(plain[f"w_{c}"] - weighed[f"w_{c}"]) < 1e-12 for c in DIMS)
    assert niche.dimensionality_gate(once, "species", 4, "many").first().observations == 600
    single = spark.createDataFrame([("t", 1.0, 2.0, 3.0, 4.0, 1)], "species string, x double, y double, z double, v double, many long")
    assert niche.bandwidths(single, "species", DIMS, "many").first().w_x is None


def test_points_are_marked_by_one_niche_without_being_stored(spark):
    rng = random.Random(3)
    boxes = spark.createDataFrame([("r", *[rng.gauss(0, 1) for _ in DIMS]) for _ in range(200)], "species string, x double, y double, z double, v double")
    widths = niche.bandwidths(boxes, "species", DIMS)
    # The queries' columns are named as the boxes' are, species too.
    points = spark.createDataFrame([(f"s{i}", *[rng.gauss(0, 1.3) for _ in DIMS]) for i in range(600)], "species string, x double, y double, z double, v double")
    marked = niche.marked_inside(points, boxes, widths, DIMS, "inside")
    w = widths.first()
    held = [tuple(b[c] for c in DIMS) for b in boxes.collect()]
    direct = {p.species for p in points.collect() if any(all(abs(p[c] - b[k]) <= w[f"w_{c}"] for k, c in enumerate(DIMS)) for b in held)}
    found = marked.collect()
    assert len(found) == 600 and {r.species for r in found if r.inside} == direct and 0 < len(direct) < 600


def test_inclusion_meets_different_places_only(spark, monkeypatch):
    from taxaloom.plans import niches

    met, covered = [], niche.covered_points
    monkeypatch.setattr(niche, "covered_points", lambda points, *a: met.append(points) or covered(points, *a))
    obs = niches._obs(spark, "/root/testdata/sf0.001")
    twice = obs.union(obs.withColumn("id", F.concat("id", F.lit("x"))))
    niches._included(niches._different(twice)).collect()
    assert met[0].count() == obs.select(*niches.DIMS).distinct().count()


def test_suppliers_meet_lines_before_these_are_shuffled(spark):
    from taxaloom.plans import niches

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")
    try:
        plan = niches._obs(spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "s_suppkey" in x]
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and ("suppkey" in x.split("hashpartitioning")[1] or "dataset_key" in x)]


def test_inclusion_of_the_niche_pipeline_looks_at_the_region_s_random_points(spark, monkeypatch):
    from taxaloom.plans import niches

    # Points are drawn by box: of those in four boxes a quarter counts.
    covered = spark.createDataFrame([(x,) for x in (1, 1, 2, 4, 4, 4, 4)], "boxes long")
    assert niche.even_quantile(covered, 0.5).first().q == 1 and niche.even_quantile(covered, 0.6).first().q == 2 and niche.even_quantile(covered, 1.0).first().q == 4
    assert niche.even_quantile(covered.where("boxes > 9"), 0.5).first().q is None

    seen, quantile, shares, share = [], niche.even_quantile, [], niche.included_share
    monkeypatch.setattr(niche, "even_quantile", lambda points, q: seen.append((points.localCheckpoint(), q)) or quantile(seen[-1][0], q))
    monkeypatch.setattr(niche, "included_share", lambda records, spots, limit, *a: shares.append((spots, limit)) or share(records, spots, limit, *a))
    niches.n12(spark, "/root/testdata/sf0.001")
    (points, q), (spots, limit) = seen[0], shares[0]
    counts = sorted(r.boxes for r in points.collect())
    assert q == 0.5 and len(counts) >= 100_000
    even, upto = sum(1 / x for x in counts) / 2, 0.0
    for x in counts:
        upto += 1 / x
        if upto >= even:
            break
    # The region's own records lie denser than its volume does.
    assert limit.first().q == x < spots.where("regional > 0").agg(F.percentile("boxes", F.lit(0.5), F.col("regional"))).first()[0]


def test_inclusion_where_ids_repeat_is_the_sql_s(spark, tmp_path):
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem"):
        source = f"'/root/testdata/sf0.001/{t}.parquet'"
        twice = f" union all select * from {source} where l_orderkey % 3 = 0" if t == "lineitem" else ""
        c.execute(f"copy (select * from {source}{twice}) to '{tmp_path}/{t}.parquet'")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    expected = sorted(c.execute(registry.oracle_sql()["N4_inclusion_test"]).fetchall())
    assert sorted(tuple(r) for r in registry.queries()["N4_inclusion_test"](spark, str(tmp_path)).collect()) == expected
