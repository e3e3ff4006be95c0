"""Aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from taxaloom.operators import rows, zonal
from taxaloom.plans import base as b
from taxaloom.plans.base import sql
from taxaloom.registry import query


@query("A1_count_by_dataset", "select l_suppkey as dataset_key, count(*) as n from lineitem group by 1")
def a1(s, d):
    return b.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("dataset_key")).agg(F.count("*").alias("n"))


@query("A2_distinct_per_group", sql("cells", body='select "order", count(distinct cell) as cells, count(distinct species) as species from cells group by 1'))
def a2(s, d):
    return b.cells(s, d).groupBy("order").agg(F.countDistinct("cell").alias("cells"), F.countDistinct("species").alias("species"))


@query("A3_mode_per_column", """with c as (select p_brand k, 'p_type' c, p_type v, count(*) n from part group by 1, 3 union all select p_brand, 'p_name', p_name, count(*) from part group by 1, 3),
  m as (select k, c, arg_min(v, (-n, v)) v from c group by all) select k as p_brand, max(case when c = 'p_type' then v end) as p_type, max(case when c = 'p_name' then v end) as p_name from m group by k""")
def a3(s, d):
    return zonal.mode_per_column(b.table(s, d, "part"), "p_brand", ["p_type", "p_name"])


@query("A4_absolute_centre", sql("occ", body="select clean_name, round(median(abs(lat)), 6) as median_lat, round(avg(abs(lat)), 6) as mean_lat from occ group by 1"))
def a4(s, d):
    centre = [F.round(zonal.absolute_centre("lat", m), 6).alias(f"{m}_lat") for m in ("median", "mean")]
    return b.occ(s, d).groupBy("clean_name").agg(*centre)


@query("A5_in_region_share", sql("occ", body="select scientific_name, count(*) as records, count_if(lat > 60)::bigint as in_region, round(count_if(lat > 60) / count(*), 8) as share, count_if(lat > 60) > 0 as present from occ group by 1"))
def a5(s, d):
    return zonal.in_region_share(b.occ(s, d), F.col("lat") > 60, "scientific_name").withColumn("share", F.round("share", 8))


@query("A6_cell_richness", sql("cells", body="select cell, sum(inclusion)::double as richness from (select species, cell, max(inclusion) as inclusion from cells group by all) group by 1"))
def a6(s, d):
    one = b.cells(s, d).groupBy("species", "cell").agg(F.max("inclusion").alias("inclusion"))
    return zonal.cell_richness(one, ["cell"])


@query("A7_richness_over_groups", sql("cells", body='select cell, "order", sum(inclusion)::double as richness from cells group by all union all select cell, \'all\', sum(inclusion)::double from cells group by 1'))
def a7(s, d):
    return zonal.richness_by_group(b.cells(s, d), "cell", "order")


@query("A8_area_of_occupancy", sql("cells", "region_cells", body="""select p.species, p.sub_region, p.country, t.tpaoo, round(t.tpaoo / t.n, 8) as prop_tpaoo, p.paoo, round(p.paoo / p.m, 8) as prop_paoo
  from (select species, sub_region, country, sum(has)::bigint as paoo, count(*) as m from (select species, cell, max(case when inclusion > 0 then 1 else 0 end) as has from cells group by all) h join region_cells using (cell) group by all) p
  join (select species, sum(has)::bigint as tpaoo, count(*) as n from (select species, cell, max(case when inclusion > 0 then 1 else 0 end) as has from cells group by all) group by 1) t using (species)"""))
def a8(s, d):
    return zonal.area_of_occupancy(b.cells(s, d), b.region_cells(s, d)).withColumns({c: F.round(c, 8) for c in ("prop_tpaoo", "prop_paoo")})


@query("A9_suitability_statistics", sql("cells", "region_cells", body="""select species, sub_region, round(total_min, 6) as total_min, round(total_mean, 6) as total_mean, round(total_median, 6) as total_median, round(total_max, 6) as total_max,
  round(region_min, 6) as region_min, round(region_mean, 6) as region_mean, round(region_median, 6) as region_median, round(region_max, 6) as region_max
  from (select species, min(suitability) total_min, avg(suitability) total_mean, median(suitability) total_median, max(suitability) total_max from cells group by 1)
  join (select species, sub_region, min(suitability) region_min, avg(suitability) region_mean, median(suitability) region_median, max(suitability) region_max from cells join region_cells using (cell) group by all) using (species) where region_max > 0"""))
def a9(s, d):
    out = zonal.suitability_statistics(b.cells(s, d), b.region_cells(s, d))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if "_m" in c})


_RICH = """select sub_region, "order", count(distinct clean_name) as taxon_richness, any_value(t) as total_richness, round(count(distinct clean_name) / any_value(t), 8) as relative_richness
  from paoo join (select sub_region, count(distinct clean_name) as t from paoo where paoo > 20 group by 1) using (sub_region) where paoo > 20 group by all"""


def _rich(s, d):
    return zonal.taxon_richness(b.paoo(s, d).where("paoo > 20"), "order", ["sub_region"])


@query("A10_taxon_richness", sql("paoo", body=_RICH))
def a10(s, d):
    return _rich(s, d).withColumn("relative_richness", F.round("relative_richness", 8))


@query("A11_group_share", sql("paoo", body=f"""select sub_region, "order", length("order") % 3 as "group", round(sum(relative_richness) over (partition by sub_region, length("order") % 3), 6) as group_share from ({_RICH})"""))
def a11(s, d):
    out = zonal.share_by_group(_rich(s, d), F.length("order") % 3, "sub_region")
    return out.select("sub_region", "order", F.col("group").cast("long").alias("group"), F.round("group_share", 6).alias("group_share"))


@query("A12_baseline_composition", sql("paoo", body="""select "order", count(distinct clean_name) as taxon_richness, (select count(distinct clean_name) from paoo) as total_richness, round(count(distinct clean_name) / (select count(distinct clean_name) from paoo), 8) as relative_richness from paoo group by 1"""))
def a12(s, d):
    return zonal.taxon_richness(b.paoo(s, d), "order", []).withColumn("relative_richness", F.round("relative_richness", 8))


@query("A13_no_overlap_summary", sql("stats", body='select "order", clean_name, count(*) as n, round(avg(observations), 6) as mean_obs, median(observations) as median_obs, min(observations) as min_obs, max(observations) as max_obs, round(avg(volume), 4) as mean_volume from stats where overlap = 0 group by all'))
def a13(s, d):
    o = F.col("observations")
    return b.stats(s, d).where("overlap = 0").groupBy("order", "clean_name").agg(F.count("*").alias("n"), F.round(F.avg(o), 6).alias("mean_obs"), F.median(o).alias("median_obs"), F.min(o).alias("min_obs"), F.max(o).alias("max_obs"), F.round(F.avg("volume"), 4).alias("mean_volume"))


_REASON = "case when excluded and observations <= 2 then 'few' when excluded then 'none' else 'included' end"


@query("A14_exclusion_profile", sql("stats", body=f"""select clean_name, source, reason, n, round(n / sum(n) over (partition by clean_name, source), 8) as share from (
  select clean_name, source::varchar as source, {_REASON} as reason, count(*) as n from stats group by all union all select clean_name, 'all', {_REASON}, count(*) from stats group by all)"""))
def a14(s, d):
    return zonal.exclusion_profile(b.stats(s, d).withColumn("reason", F.expr(_REASON)), "clean_name", "source", "reason").withColumn("share", F.round("share", 8))


@query("A15_detection_rate", sql("stats", body="""select count(*) as total, count_if(ln(observations) <= 1)::bigint as too_few, count_if(not excluded)::bigint as included, round(100 * count_if(not excluded) / (count(*) - count_if(ln(observations) <= 1)), 6) as rate,
  100 * count_if(not excluded) / (count(*) - count_if(ln(observations) <= 1)) > 80 as reliable from stats"""))
def a15(s, d):
    return zonal.detection_rate(b.stats(s, d), F.log("observations") <= 1).withColumn("rate", F.round("rate", 6))


@query("A16_location_summary", sql("occ", body="select status, round(avg(lon), 5) as mean_lon, round(stddev_samp(lon), 5) as sd_lon, round(avg(lat), 5) as mean_lat, round(stddev_samp(lat), 5) as sd_lat from occ group by 1"))
def a16(s, d):
    return b.occ(s, d).groupBy("status").agg(*[F.round(f(c), 5).alias(f"{n}_{c}") for c in ("lon", "lat") for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))])


_FLOW = """flow as (select distinct p_name as species, p_type as "order", p_brand as family, o.n_name as origin, t.n_name as destination from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation o on s_nationkey = o.n_nationkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation t on c_nationkey = t.n_nationkey)"""


def _flow(s, d):
    start = b.located(s, d).select("l_orderkey", F.col("p_name").alias("species"), F.col("p_type").alias("order"), F.col("p_brand").alias("family"), F.col("n_name").alias("origin"))
    goal = b.table(s, d, "orders").join(b.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(b.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    both = start.join(goal.select(F.col("o_orderkey").alias("l_orderkey"), F.col("n_name").alias("destination")), "l_orderkey")
    return zonal.connections(both, "species", "origin", "destination", ["order", "family"])


@query("A17_connections", f'with {_FLOW} select family, "order", count(*) as connections from flow group by all')
def a17(s, d):
    return _flow(s, d).groupBy("family", "order").agg(F.sum("connections").alias("connections"))


@query("A18_connection_totals", f"with {_FLOW} select 'origin' as side, origin as place, count(distinct species) as species from flow group by all union all select 'destination', destination, count(distinct species) from flow group by all")
def a18(s, d):
    flow = _flow(s, d)
    of = lambda c: flow.groupBy(F.lit(c).alias("side"), F.col(c).alias("place")).agg(F.countDistinct("species").alias("species"))
    return of("origin").unionByName(of("destination")).orderBy(F.desc("species"), "side", "place")


@query("A19_flow_table", f"with {_FLOW}, w as (select *, 1.0 / count(*) over (partition by destination) as weight from flow) select origin, destination, round(sum(weight), 6) as flow from w group by all")
def a19(s, d):
    weighted = rows.with_group_aggregates(_flow(s, d), ["destination"], n=F.count("*"))
    return weighted.groupBy("origin", "destination").agg(F.round(F.sum(1 / F.col("n")), 6).alias("flow")).orderBy(F.desc("flow"), "origin", "destination")


@query("A20_log_binned_frequency", "select o_orderstatus, floor(log10(o_totalprice) / 0.05)::bigint as bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by o_orderstatus), 8) as share from orders where o_totalprice > 0 group by 1, 2")
def a20(s, d):
    return zonal.log_binned(b.table(s, d, "orders"), "o_totalprice", 0.05, ["o_orderstatus"]).withColumn("share", F.round("share", 8))


_PLACED = "select 'log10' as scale, floor(log10(paoo) / 0.1::double)::bigint as bin, country, sub_region from paoo where paoo > 0 union all select 'log', floor(ln(paoo) / 0.2::double)::bigint, country, sub_region from paoo where paoo > 0 union all select 'sqrt', floor(sqrt(paoo) / 0.5::double)::bigint, country, sub_region from paoo where paoo >= 0"
_GRAIN = "select scale, '{}' as grain, {} as country, {} as sub_region, bin, count(*) as n from placed group by scale, bin{}"


@query("A20_frequency_grains", sql("paoo", body=f"""select scale, grain, country, sub_region, bin, n, round(share, 8) as share, round(case scale when 'log10' then pow(10, (bin + 0.5::double) * 0.1::double) when 'log' then exp((bin + 0.5::double) * 0.2::double) else pow((bin + 0.5::double) * 0.5::double, 2) end, 6) as middle
  from (select *, n / sum(n) over (partition by scale, grain, country, sub_region) as share from (with placed as ({_PLACED}) {_GRAIN.format('all', 'null::varchar', 'null::varchar', '')} union all {_GRAIN.format('country', 'placed.country', 'null', ', placed.country')} union all {_GRAIN.format('sub_region', 'placed.country', 'placed.sub_region', ', placed.country, placed.sub_region')}))"""))
def a20_grains(s, d):
    out = zonal.frequency_grains(b.paoo(s, d), "paoo", {"log10": 0.1, "log": 0.2, "sqrt": 0.5}, ["country", "sub_region"])
    return out.withColumns({"share": F.round("share", 8), "middle": F.round("middle", 6)})


@query("A21_union_audit", """with a as (select p_name, p_brand from part where p_size % 2 = 0), c as (select case when p_size % 5 = 0 then null else p_name end as p_name, p_brand from part where p_size % 3 = 0), u as (select distinct * from (select * from a union all select * from c))
  select (select count(*) from a) as rows_a, (select count(*) from c) as rows_b, count(*) as merged, (select count(*) from a) + (select count(*) from c) - count(*) as duplicates, count_if(p_name is null or p_brand is null)::bigint as incomplete,
  (select count(*) from (select distinct * from c except select * from a)) as added from u""")
def a21(s, d):
    part = b.table(s, d, "part")
    return rows.union_audit(part.where("p_size % 2 = 0").select("p_name", "p_brand"), part.where("p_size % 3 = 0").select(F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("p_name"), "p_brand"))


@query("A22_filter_summary", sql("chk", "known", "cand", body="""select 'known' as step, count(*) as rows from known union all select 'candidates', count(*) from cand union all select 'unknown', count(*) from cand where verbatim_name not in (select verbatim_name from known)"""))
def a22(s, d):
    from taxaloom.operators import joins

    c, k = b.cand(s, d), b.known(s, d)
    return joins.step_counts(known=k, candidates=c, unknown=c.join(k.select("verbatim_name").distinct(), "verbatim_name", "left_anti"))


@query("A23_region_mean_response", sql("occ", body="""select dataset_key, round(ln(p / (1 - p)), 6) as response from (select dataset_key, greatest(1e-6, least(1 - 1e-6, greatest(0, least(1, avg(bio3 * 8))))) as p from occ group by 1)"""))
def a23(s, d):
    out = zonal.mean_response(b.occ(s, d).withColumn("y", F.col("bio3") * 8), "dataset_key", "y", logit=True)
    return out.withColumn("response", F.round("response", 6))


@query("A24_centroid_latitude", sql("occ", body="select clean_name, round(avg(lat), 6) as latitude, count(*) as points from occ where has_coordinate group by 1"))
def a24(s, d):
    return b.occ(s, d).where("has_coordinate").groupBy("clean_name").agg(F.round(F.avg("lat"), 6).alias("latitude"), F.count("*").alias("points"))


@query("A25_latitude_profile", sql("occ", "stats", body="""select clean_name, raw, cleaned, latitude, overlap from (select clean_name, count(*) as raw, count_if(has_coordinate and not has_issue)::bigint as cleaned, round(median(abs(lat)), 6) as latitude from occ group by 1)
  join (select clean_name, round(avg(overlap), 6) as overlap from stats group by 1) using (clean_name)"""))
def a25(s, d):
    own = b.occ(s, d).groupBy("clean_name").agg(F.count("*").alias("raw"), F.count_if(F.col("has_coordinate") & ~F.col("has_issue")).alias("cleaned"), F.round(F.median(F.abs("lat")), 6).alias("latitude"))
    return own.join(b.stats(s, d).groupBy("clean_name").agg(F.round(F.avg("overlap"), 6).alias("overlap")), "clean_name")


@query("W1_keep_first", "select p_name, arg_min(p_partkey, (p_size, p_partkey)) as p_partkey from part group by 1")
def w1(s, d):
    return rows.keep_first(b.table(s, d, "part"), ["p_name"], ["p_size", "p_partkey"]).select("p_name", "p_partkey")


@query("W2_first_and_repeats", "select p_partkey, row_number() over (partition by p_name order by p_partkey) > 1 as repeat from part")
def w2(s, d):
    n = rows.number_in_group(b.table(s, d, "part"), ["p_name"], ["p_partkey"], "n")
    first, repeats = rows.split_by(n, F.col("n") == 1)
    return first.select("p_partkey", F.lit(False).alias("repeat")).unionByName(repeats.select("p_partkey", F.lit(True).alias("repeat")))


@query("W3_keep_last", "select p_name, max(p_partkey) as p_partkey from part group by 1")
def w3(s, d):
    return rows.keep_first(b.table(s, d, "part"), ["p_name"], ["-p_partkey"]).select("p_name", "p_partkey")


@query("W4_group_maximum", "select n_name, arg_min(s_suppkey, (-s_acctbal, s_suppkey)) as s_suppkey from supplier join nation on s_nationkey = n_nationkey group by 1")
def w4(s, d):
    rows_ = b.table(s, d, "supplier").join(b.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    best = rows_.groupBy("n_name").agg(F.min(F.struct((-F.col("s_acctbal")).alias("v"), "s_suppkey")).alias("m"))
    return best.select("n_name", "m.s_suppkey")


@query("W5_top_3_per_group", "select p_brand, p_partkey, p_retailprice from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 3")
def w5(s, d):
    return rows.top_per_group(b.table(s, d, "part"), ["p_brand"], ["-p_retailprice", "p_partkey"], 3).select("p_brand", "p_partkey", "p_retailprice")


@query("W6_group_id", "select p_partkey, dense_rank() over (order by p_brand, p_type)::int as group_id from part")
def w6(s, d):
    return rows.group_ids(b.table(s, d, "part"), ["p_brand", "p_type"], "group_id").select("p_partkey", "group_id")


@query("W7_sequence_in_group", "select p_partkey, row_number() over (partition by p_name order by p_size, p_partkey)::int as seq from part")
def w7(s, d):
    return rows.number_in_group(b.table(s, d, "part"), ["p_name"], ["p_size", "p_partkey"], "seq").select("p_partkey", "seq")


@query("W8_group_count_on_rows", "select p_partkey, count(*) over (partition by p_brand) as n, round(p_retailprice / sum(p_retailprice) over (partition by p_brand), 8) as share from part")
def w8(s, d):
    out = rows.with_group_aggregates(b.table(s, d, "part"), ["p_brand"], n=F.count("*"), total=F.sum("p_retailprice"))
    return out.select("p_partkey", "n", F.round(F.col("p_retailprice") / F.col("total"), 8).alias("share"))


@query("W9_group_aggregates_on_rows", "select p_partkey, round(avg(p_retailprice) over w, 6) as mean, min(p_retailprice) over w as low, round(median(p_retailprice) over w, 6) as mid, max(p_retailprice) over w as high from part window w as (partition by p_type)")
def w9(s, d):
    v = "p_retailprice"
    return rows.with_group_aggregates(b.table(s, d, "part"), ["p_type"], mean=F.round(F.avg(v), 6), low=F.min(v), mid=F.round(F.median(v), 6), high=F.max(v)).select("p_partkey", "mean", "low", "mid", "high")


@query("W10_local_peaks", """with c as (select o_orderstatus, floor(o_totalprice / 10000)::bigint as bin, count(*) as n from orders group by 1, 2), x as (select *, lag(n) over w as a, lead(n) over w as z from c window w as (partition by o_orderstatus order by bin)) select o_orderstatus, bin, n from x where n - a > 2 and n - z > 2""")
def w10(s, d):
    bins = b.table(s, d, "orders").groupBy("o_orderstatus", F.floor(F.col("o_totalprice") / 10000).alias("bin")).agg(F.count("*").alias("n"))
    return rows.local_peaks(bins, ["o_orderstatus"], "bin", "n", 2)


@query("W11_fill_down", """with x as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i, l_returnflag, l_linestatus, l_quantity from lineitem),
  y as (select k, i, case when i = 1 then 'c' || l_returnflag when l_quantity < 15 then 'c' || l_linestatus end as class, case when l_quantity between 15 and 30 then 'f' || l_returnflag end as family from x),
  z as (select *, count(class) over w as g1, count(*) filter (class is not null or family is not null) over w as g2 from y window w as (partition by k order by i rows unbounded preceding))
  select k, i, max(class) over (partition by k, g1) as class, max(family) over (partition by k, g2) as family from z""")
def w11(s, d):
    line = rows.number_in_group(b.table(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "i").withColumn("i", F.col("i").cast("long"))
    raw = line.selectExpr("l_orderkey as k", "i", "case when i = 1 then concat('c', l_returnflag) when l_quantity < 15 then concat('c', l_linestatus) end as class", "case when l_quantity between 15 and 30 then concat('f', l_returnflag) end as family")
    return rows.fill_down(raw, ["k"], "i", ["class", "family"])


@query("W13_seeded_pick", sql("occ", body="select clean_name, floor(lon / 10)::bigint as x, floor(lat / 10)::bigint as y, arg_min(obs_id, (md5(concat_ws('|', '12034', obs_id)), obs_id)) as obs_id from occ group by 1, 2, 3"))
def w13(s, d):
    cell = b.occ(s, d).select("clean_name", F.floor(F.col("lon") / 10).alias("x"), F.floor(F.col("lat") / 10).alias("y"), "obs_id")
    pick = F.min(F.struct(rows.seeded_order(12034, "obs_id").alias("h"), "obs_id"))
    return cell.groupBy("clean_name", "x", "y").agg(pick.alias("m")).select("clean_name", "x", "y", "m.obs_id")


@query("W14_best_distinct_keys", "select p_name, max(p_retailprice) as p_retailprice from part group by 1 order by 2 desc, 1 limit 9")
def w14(s, d):
    return rows.best_by_key(b.table(s, d, "part").select("p_name", "p_retailprice"), "p_name", "p_retailprice", 9)


@query("O1_multi_key_sort", "select c_custkey, c_mktsegment, c_acctbal from customer")
def o1(s, d):
    return b.table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(*rows.ordered(["-c_acctbal", "c_mktsegment", "c_custkey"]))


@query("O2_merge_groups_top_n", "select s_suppkey as id, s_acctbal as score from supplier union all select c_custkey, c_acctbal from customer order by score desc, id limit 25")
def o2(s, d):
    a = b.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return a.unionByName(b.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))).orderBy(F.desc("score"), "id").limit(25)


@query("O3_top_9_per_group", "with m as (select p_type, p_name, round(avg(p_retailprice), 6) as mean from part group by all) select * from m qualify row_number() over (partition by p_type order by mean desc, p_name) <= 9")
def o3(s, d):
    means = b.table(s, d, "part").groupBy("p_type", "p_name").agg(F.round(F.avg("p_retailprice"), 6).alias("mean"))
    return rows.top_per_group(means, ["p_type"], ["-mean", "p_name"], 9)


@query("O4_taxonomic_order_sort", "with o as (select p_type as t, row_number() over (order by md5(p_type)) as pos from (select distinct p_type from part)) select p_partkey, pos::int as pos from part join o on p_type = t")
def o4(s, d):
    order = rows.number_in_group(b.table(s, d, "part").select("p_type").distinct().withColumn("one", F.lit(1)), ["one"], [F.md5("p_type")], "pos").drop("one")
    return b.table(s, d, "part").join(order, "p_type").select("p_partkey", "pos").orderBy("pos", "p_partkey")


@query("O5_split_by_group", "select p_partkey, case when p_size < 17 then 'low' when p_size < 34 then 'mid' else 'high' end as \"group\" from part")
def o5(s, d):
    return b.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") < 17, "low").when(F.col("p_size") < 34, "mid").otherwise("high").alias("group"))


@query("O6_union_distinct", "select distinct p_name, p_brand from part where (p_size % 2 = 0 or p_size % 3 = 0) and p_name is not null")
def o6(s, d):
    part = b.table(s, d, "part").select("p_name", "p_brand", "p_size")
    return rows.union_distinct(part.where("p_size % 2 = 0").drop("p_size"), part.where("p_size % 3 = 0").drop("p_size"), drop_null_rows=True)


@query("O7_ragged_union", "select s_suppkey as id, s_name as name, null::varchar as segment from supplier union all select c_custkey, null, c_mktsegment from customer")
def o7(s, d):
    a = b.table(s, d, "supplier").selectExpr("s_suppkey as id", "s_name as name")
    return rows.ragged_union(a, b.table(s, d, "customer").selectExpr("c_custkey as id", "c_mktsegment as segment"))


@query("O8_set_difference", "select p_partkey as k from part except select l_partkey from lineitem where l_linenumber = 7 and l_tax > 0.06")
def o8(s, d):
    return b.table(s, d, "part").select(F.col("p_partkey").alias("k")).subtract(b.table(s, d, "lineitem").where("l_linenumber = 7 and l_tax > 0.06D").select(F.col("l_partkey").alias("k")))


@query("O9_intersect", "select p_partkey as k from part intersect select l_partkey from lineitem where l_linenumber > 5")
def o9(s, d):
    return b.table(s, d, "part").select(F.col("p_partkey").alias("k")).intersect(b.table(s, d, "lineitem").where("l_linenumber > 5").select(F.col("l_partkey").alias("k")))


@query("O10_list_algebra", """with l as (select p_partkey as k, p_size % 4 as src, p_retailprice < 1200 as present from part), p as (select k from l where src in (0, 1) and present), a as (select k from l where src in (0, 1) and not present and k not in (select k from p)), c as (select k from l where src = 2)
  select k from c where k not in (select k from p) union select k from a""")
def o10(s, d):
    l = b.table(s, d, "part").selectExpr("p_partkey as k", "p_size % 4 as src", "p_retailprice < 1200 as present")  # noqa: E741
    of = lambda w: l.where(w).select("k")
    present = rows.union_distinct(of("src = 0 and present"), of("src = 1 and present"))
    absent = rows.union_distinct(of("src = 0 and not present"), of("src = 1 and not present")).join(present, "k", "left_anti")
    return rows.union_distinct(of("src = 2").join(present, "k", "left_anti"), absent)


@query("O11_wide_to_long", "select p_partkey, variable, value from (select p_partkey, p_size::double as size, p_retailprice as price from part) unpivot (value for variable in (size, price))")
def o11(s, d):
    wide = b.table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot(wide, ["p_partkey"], ["size", "price"])


@query("O12_unnest", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def o12(s, d):
    return b.table(s, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
