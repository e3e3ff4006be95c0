"""Bucketed tables, files that grow, batches counted, and aggregates with a state of their own."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from taxaloom import plugins
from taxaloom.operators import joins, niche, spatial, zonal
from taxaloom.sources import writers
from taxaloom.streaming import growing
from taxaloom.streaming.ingest import ingest


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_are_grouped_and_joined_as_they_lie(spark, tmp_path, monkeypatch):
    rows = [(f"s{i % 7}", i, float(i % 13), float(i % 11), "x" if i % 2 else "y") for i in range(400)] + [(None, 1000, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "species string, id int, lon double, lat double, kind string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = writers.write_bucketed(df, "bucketed_test", f"file://{tmp_path}/t", "species", 8)
        keys = writers.write_bucketed(df.selectExpr("species", "upper(species) as accepted_name", "species as listed_name").distinct(), "bucketed_keys", f"file://{tmp_path}/k", "species", 8)
        for out in (table.groupBy("species").count(), zonal.mode_per_column(table, "species", ["kind", "lon"]), spatial.thin(table, "species", "id", 2 * 111_320, 1), joins.accepted_names(table.withColumnRenamed("kind", "name"), keys, "species", "name")):
            assert "Exchange" not in plan_of(out), plan_of(out)
        assert sorted(map(tuple, table.groupBy("species").count().collect()), key=str) == sorted(Counter(r[0] for r in rows).items(), key=str)
        assert "Exchange" in plan_of(df.groupBy("species").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists bucketed_test")
        spark.sql("drop table if exists bucketed_keys")


SCHEMA = "id long, name string, v double"


def line(i: int) -> str:
    return f"{i}\t{'' if i % 5 == 0 else f'n é {i}'}\t{'' if i % 7 == 0 else i / 2}\n"


def kept(spark, path: Path) -> list[tuple]:
    return sorted((r.id, r.name, r.v) for r in spark.read.parquet(f"file://{path}").collect())


def wanted(n: range) -> list[tuple]:
    return sorted((i, "" if i % 5 == 0 else f"n é {i}", None if i % 7 == 0 else i / 2) for i in n)


def test_a_file_that_grows_is_taken_up_where_it_was_left(spark, tmp_path):
    source, text = tmp_path / "in", "".join(map(line, range(300))).encode()
    source.mkdir()
    run = lambda: growing.ingest_growing(spark, f"file://{source}", SCHEMA, f"file://{tmp_path}/out", f"file://{tmp_path}/state", header=True, range_bytes=700)
    head = b"id\tname\tv\n"
    cuts = [0, 40, 41, 1500, 1501, len(text) - 3, len(text)]
    batches = 0
    for a in cuts:
        (source / "a.csv").write_bytes(head + text[:a])
        batches += run()
    (source / "b.csv").write_bytes(head + "".join(map(line, range(300, 320))).encode())
    batches += run()
    assert run() == 0 and batches >= 5
    assert kept(spark, tmp_path / "out") == wanted(range(320))


def test_a_batch_that_fails_is_read_again_from_the_same_bytes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a").write_text("".join(map(line, range(50))))
    broken = {"now": True}

    def chain(batch):
        if broken["now"]:
            batch.limit(10).write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch=0")
            raise OSError("stopped")
        return batch

    run = lambda: growing.ingest_growing(spark, f"file://{source}", SCHEMA, f"file://{tmp_path}/out", f"file://{tmp_path}/state", transform=chain)
    with pytest.raises(Exception, match="stopped"):
        run()
    (source / "a").write_text("".join(map(line, range(80))))
    broken["now"] = False
    assert run() >= 1
    run()
    assert kept(spark, tmp_path / "out") == wanted(range(80))


def test_lines_of_any_stretch_are_whole_and_once(tmp_path):
    rng = random.Random(3)
    data = b"".join(bytes(rng.choices(b"abc", k=rng.randint(0, 30))) + b"\n" for _ in range(200))
    (tmp_path / "f").write_bytes(data)
    for size in (1, 7, 64, 5000, 10**6):
        for block in (3, 50, 10**6):
            with open(tmp_path / "f", "rb") as f:
                assert b"".join(x for a in range(0, len(data), size) for x in growing.lines_of(f, a, min(a + size, len(data)), len(data), block=block)) == data


def test_all_batches_are_counted(spark, tmp_path):
    for k in range(120):
        spark_free = tmp_path / "in" / f"{k:03d}.csv"
        spark_free.parent.mkdir(exist_ok=True)
        spark_free.write_text(f"{k}\n")
    assert ingest(spark, f"file://{tmp_path}/in", "k long", f"file://{tmp_path}/out", f"file://{tmp_path}/state", file_format="csv", max_files=1) == 120
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 120
    assert ingest(spark, f"file://{tmp_path}/in", "k long", f"file://{tmp_path}/out", f"file://{tmp_path}/state", file_format="csv", max_files=1) == 0


def test_reused_raises_for_a_broken_table(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    path = f"file://{tmp_path}/t"
    assert writers.reused(spark, path, make).count() == 3 and writers.reused(spark, path, make).count() == 3 and len(made) == 1
    for f in (tmp_path / "t").glob("*part*"):
        f.unlink()
    with pytest.raises(Exception):  # noqa: B017
        writers.reused(spark, path, make).count()


@pytest.mark.parametrize(("held", "fan_in"), [(10_000, 64), (2, 2)])
def test_own_aggregate_is_within_its_bound(spark, held, fan_in):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), int(rng.paretovariate(0.7)), 1) for _ in range(5000)] + [("c", None, 1), ("d", 7, 1)]
    df = spark.createDataFrame(rows, "k string, v long, _salt int").repartition(9).drop("_salt")
    size = 20
    got = {r.k: r for r in plugins.own_aggregate(df, ["k"], plugins.HeavyValues("v", size), "n long, `values` array<string>, counts array<long>", held, fan_in).collect()}
    assert set(got) == {"a", "b", None, "c", "d"} and got["c"].n == 0 and got["c"]["values"] == []
    for k in ("a", "b", None, "d"):
        true = Counter(v for g, v, _ in rows if g == k)
        told = dict(zip(map(int, got[k]["values"]), got[k].counts, strict=True))
        assert got[k].n == sum(true.values()) and len(told) <= size
        for v, t in true.items():
            assert t - got[k].n / size <= told.get(v, 0) <= t
    assert plugins.own_aggregate(df.where("false"), ["k"], plugins.HeavyValues("v", size), "n long, `values` array<string>, counts array<long>").count() == 0


def niches(spark):
    rng = random.Random(12)
    spread = {"wide": 3.0, "narrow": 2.0, "far": 1.5}
    rows = [(s, f"{s}{i}", *[rng.gauss(9 if s == "far" else 0, w) for _ in range(4)]) for s, w in spread.items() for i in range(60)]
    return spark.createDataFrame(rows, "species string, id string, x double, y double, z double, w double")


def test_all_species_on_one_grid_without_a_cross_join(spark):
    df, dims = niches(spark), ("x", "y", "z", "w")
    widths = niche.bandwidths(df, "species", dims)
    cells = df.where("species <> 'far'").select(F.col("id").alias("cell"), *dims)
    out = niche.covering(cells, df, widths, "species", "cell", dims, per_species=False)
    assert "Cartesian" not in plan_of(out) and "NestedLoop" not in plan_of(out)
    held, w = df.collect(), {r.species: r for r in widths.collect()}
    want = Counter((o.species, q.cell) for q in cells.collect() for o in held if all(abs(q[c] - o[c]) <= w[o.species][f"w_{c}"] for c in dims))
    assert {(r.species, r.cell): r.boxes for r in out.collect()} == dict(want)


def test_binned_overlap_agrees_with_random_points(spark):
    df, dims = niches(spark), ("x", "y", "z", "w")
    region = df.where("species = 'wide'")
    got = {r.species: r for r in niche.binned_overlap(df, region, "species", dims, fineness=3.0).collect()}
    assert got["wide"].jaccard == 1.0 and got["wide"].unique_species == 0.0 and got["far"].shared < got["far"].bins_species
    own, area = niche.bandwidths(df, "species", dims), niche.bandwidths(region, "species", dims)
    points = niche.sample_points(df, own, "species", "id", dims, 60, 5)
    covered = niche.covering(points, df, own, "species", "pt", dims)
    inside = niche.inside(points.withColumn("species", F.lit("wide")), region, area, "species", "pt", dims).withColumn("i", F.lit(1.0))
    for r in covered.join(inside, "pt", "left").groupBy("species").agg((F.sum(F.coalesce("i", F.lit(0.0)) / F.col("boxes")) / F.sum(1 / F.col("boxes"))).alias("share")).collect():
        assert 1 - got[r.species].unique_species == pytest.approx(r.share, abs=0.06), r.species
