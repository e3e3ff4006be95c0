"""Sources, sinks, ingestion and plug-ins over the driver tables written out in other formats.

Folders come from the session's checkpoint folder, which all executors share.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import functions as F

from taxaloom import plugins
from taxaloom.operators import joins, rows
from taxaloom.package import ship
from taxaloom.plans import base as b
from taxaloom.plans.base import sql
from taxaloom.registry import query
from taxaloom.shared import shared_folder
from taxaloom.sources import readers, writers
from taxaloom.streaming.growing import ingest_growing
from taxaloom.streaming.ingest import ingest


def folder(spark) -> str:
    return shared_folder(spark, "tables")


@query("S1_occurrence_scan", "select l_orderkey, l_partkey, l_quantity, l_returnflag from lineitem")
def s1(s, d):
    path = folder(s)
    line = b.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linenumber")
    line.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_occurrences(s, path, line.schema).select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")


@query("S2_checklist_scan", "select p_name as verbatimName, p_name as interimName, 'parts' as sourceDataset, 'present' as presence from part")
def s2(s, d):
    path = folder(s)
    b.table(s, d, "part").select("p_name", F.col("p_brand").alias("scientificNameAuthorship")).write.option("header", True).csv(path)
    return readers.read_checklist(s, path, "p_name", "parts").select("verbatimName", "interimName", "sourceDataset", "presence")


@query("S3_wide_checklist", "select p_name as verbatimName, arg_min(p_brand, p_partkey) as p_brand from part group by 1")
def s3(s, d):
    return readers.wide_checklist(b.table(s, d, "part"), "p_name", ["p_brand"], ["p_partkey"])


@query("S4_headerless_matrix", "select n_nationkey::varchar as code, n_name as name from nation")
def s4(s, d):
    path = folder(s)
    text = b.table(s, d, "nation").select(F.struct(F.lit(3).alias("o"), F.col("n_nationkey").alias("k"), F.concat_ws(",", "n_nationkey", "n_name").alias("value")).alias("x"))
    extra = s.createDataFrame([(0, 0, "a list of nations"), (2, 0, "code, name"), (9, 0, "Total,25")], "o int, k int, value string").select(F.struct("o", "k", "value").alias("x"))
    text.unionByName(extra).select("x.*").coalesce(1).sortWithinPartitions("o", "k").select("value").write.text(path)
    return readers.read_matrix(readers.numbered_lines(s, path), header_line=2).select("code", "name")


@query("S5_many_folders", "select 'list' || (p_size % 3) || '_' || case when p_size % 2 = 0 then 'present' else 'absent' end as source, p_name as name from part where position(' ' in p_name) > 0 group by all")
def s5(s, d):
    path = folder(s)
    lists = b.chk(s, d).select("source_dataset", "presence", "verbatim_name")
    keys = [(f"list{k}", p) for k in range(3) for p in ("present", "absent")]
    for source, presence in keys:
        lists.where((F.col("source_dataset") == source) & (F.col("presence") == presence)).select("verbatim_name").write.option("header", True).csv(f"{path}/{source}/{presence}")
    return readers.read_folders(s, path, "verbatim_name")


@query("S6_backbone_scan", "select p_partkey::varchar as taxonID, p_name as scientificName, p_type as taxonRank from part where p_size % 4 <> 0")
def s6(s, d):
    path = folder(s)
    status = "case when p_size % 4 = 0 then 'Synonym' else 'Accepted' end as taxonomicStatus"
    b.table(s, d, "part").selectExpr("p_partkey as taxonID", "p_name as scientificName", "p_brand as scientificNameAuthorship", "p_type as taxonRank", "'' as nomenclaturalStatus", status).write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_backbone(s, path).select("taxonID", "scientificName", "taxonRank")


@query("S7_clade_orders", "select p_partkey, case when p_size % 3 = 0 then 'ferns' when p_size % 3 = 1 then 'conifers' end as \"group\" from part")
def s7(s, d):
    orders = readers.clade_orders(s, {"ferns": ["0"], "conifers": ["1"]})
    part = b.table(s, d, "part").select("p_partkey", (F.col("p_size") % 3).cast("string").alias("order"))
    return part.join(orders, "order", "left").select("p_partkey", "group")


@query("S11_table_sink", "select p_partkey, upper(p_name) as p_name from part")
def s11(s, d):
    return writers.write_transformed(b.table(s, d, "part").select("p_partkey", "p_name"), folder(s), lambda t: t.withColumn("p_name", F.upper("p_name")))


@query("S12_species_sink", "select p_brand, count(*) as n from part group by 1")
def s12(s, d):
    path = folder(s)
    writers.write_by_species(b.table(s, d, "part"), path, "p_brand", 4, salt=4)
    return s.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("S12_bucketed_sink", sql("occ", body="select taxon_key, count(*) as n, round(max(lat), 6) as north from occ group by 1"))
def s12_bucketed(s, d):
    """Grouped as it lies: the plan has no shuffle of the records."""
    return bucketed(s, b.occ(s, d, dealt=True), "taxon_key", dealt=True).groupBy("taxon_key").agg(F.count("*").alias("n"), F.round(F.max("lat"), 6).alias("north"))


@query("S12_bucketed_names", sql("occ", "backbone", body="""select o.obs_id, coalesce(case when k.usage_key % 2 = 0 then upper(k.name) end, case when k.usage_key % 3 = 0 then k.name || '?' end, o.scientific_name) as scientific_name, o.scientific_name as original_name
  from occ o left join backbone k on k.usage_key = o.taxon_key"""))
def s12_names(s, d):
    """J21 over two tables of equal buckets: neither side is shuffled."""
    records = bucketed(s, b.occ(s, d, dealt=True).select("obs_id", "taxon_key", "scientific_name"), "taxon_key", dealt=True)
    return joins.accepted_names(records, bucketed(s, accepted(s, d), "taxon_key"), "taxon_key", "scientific_name").select("obs_id", "scientific_name", "original_name")


def bucketed(s, df, key, buckets: int = 16, dealt: bool = False):
    return writers.write_bucketed(df, f"bucketed_{uuid.uuid4().hex}", folder(s), key, buckets, dealt)


def accepted(s, d):
    return b.backbone(s, d).selectExpr("usage_key as taxon_key", "case when usage_key % 2 = 0 then upper(name) end as accepted_name", "case when usage_key % 3 = 0 then concat(name, '?') end as listed_name")


@query("S13_append_sink", "select s_suppkey as k from supplier union all select s_suppkey + 1000000 from supplier")
def s13(s, d):
    path = folder(s)
    keys = b.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    writers.append_results(keys, path)
    writers.append_results(keys.withColumn("k", F.col("k") + 1_000_000), path)
    return s.read.parquet(path)


@query("S14_step_summary", "select 'in' as step, count(*) as rows from part union all select 'out', count(distinct p_name) from part union all select 'lost', count(*) - count(distinct p_name) from part")
def s14(s, d):
    part = b.table(s, d, "part")
    both = part.agg(F.count("*").alias("in"), F.countDistinct("p_name").alias("out")).withColumn("lost", F.col("in") - F.col("out"))
    return rows.unpivot(both, [], ["in", "out", "lost"], "step", "rows")


@query("S15_rows_and_distinct", 'select count(*) as rows, count(distinct l_partkey) as "distinct" from lineitem')
def s15(s, d):
    return readers.rows_and_distinct(b.table(s, d, "lineitem"), "l_partkey")


@query("S16_rows_per_file", "select 3::bigint as files, count(*) as rows from orders")
def s16(s, d):
    path = folder(s)
    b.table(s, d, "orders").repartition(3, "o_orderkey").write.parquet(path)
    return readers.rows_per_file(s.read.parquet(path)).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


@query("S17_reused_table", "select n_nationkey, n_name from nation")
def s17(s, d):
    path = folder(s)
    make = lambda: b.table(s, d, "nation").select("n_nationkey", "n_name")
    writers.reused(s, path, make)
    return writers.reused(s, path, make)


@query("T1_resumable_ingestion", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def t1(s, d):
    path = folder(s)
    events = b.table(s, d, "events").select("event_id", "event_type", "value")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{path}/in")
        ingest(s, f"{path}/in", "event_id long, event_type string, value double", f"{path}/out", f"{path}/state")
    return s.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("T1_chunk_protocol", sql("occ", "backbone", body="""select scientific_name, count(*) as n, count(distinct obs_id) as records from (select o.obs_id, coalesce(case when k.usage_key % 2 = 0 then upper(k.name) end, case when k.usage_key % 3 = 0 then k.name || '?' end, o.scientific_name) as scientific_name
  from occ o left join backbone k on k.usage_key = o.taxon_key) where replace(scientific_name, ' ', '') in (select replace(upper(p_name), ' ', '') from part where p_size < 30) group by 1"""))
def t1_chunks(s, d):
    """Records arrive in files that grow; each batch is moved to accepted names (J21) and reduced to known species (J22) before it is appended."""
    path = folder(s)
    b.occ(s, d).select("obs_id", "taxon_key", "scientific_name").write.option("sep", "\t").csv(f"{path}/whole")
    known = b.table(s, d, "part").where("p_size < 30").select(F.upper("p_name").alias("scientific_name"))

    def chain(batch):
        return joins.known_species_only(joins.accepted_names(batch, accepted(s, d), "taxon_key", "scientific_name"), known, "scientific_name")[0]

    for share in (0.4, 1.0):
        arrive(s, f"{path}/whole", f"{path}/in", share)
        ingest_growing(s, f"{path}/in", "obs_id string, taxon_key long, scientific_name string", f"{path}/out", f"{path}/state", transform=chain)
    return s.read.parquet(f"{path}/out").groupBy("scientific_name").agg(F.count("*").alias("n"), F.countDistinct("obs_id").alias("records"))


def arrive(spark, whole: str, target: str, share: float) -> None:
    """Puts the first bytes of each file into another folder, cut wherever they end: as far as files have been written so far."""
    ship(spark)

    def copy(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, to = fs.FileSystem.from_uri(target)
                store.create_dir(to, recursive=True)
                at, source = fs.FileSystem.from_uri(name)
                file, left = source.rsplit("/", 1)[1], int(at.get_file_info(source).size * share)
                with at.open_input_stream(source) as f, store.open_output_stream(f"{to}/.{file}") as out:
                    while left and (piece := f.read(min(left, 1 << 20))):
                        out.write(piece)
                        left -= len(piece)
                store.move(f"{to}/.{file}", f"{to}/{file}")
            yield batch

    files = spark.read.text(whole).select(F.input_file_name().alias("file")).distinct()
    files.mapInArrow(copy, "file string").write.format("noop").mode("overwrite").save()


@query("U1_source_plugin", "select sourceDataset, count(*) as n from (select 'a' as sourceDataset from part where p_size < 10 union all select 'b' from part where p_size >= 40) group by 1")
def u1(s, d):
    def source(name: str, where: str):
        return lambda spark: b.table(spark, d, "part").where(where).selectExpr("p_name as verbatimName", "p_brand as verbatimNameAuthorship", "p_name as interimName", "p_brand as interimNameAuthorship", f"'{name}' as sourceDataset", "'present' as presence")

    return plugins.gather(s, {"a": source("a", "p_size < 10"), "b": source("b", "p_size >= 40")}).groupBy("sourceDataset").agg(F.count("*").alias("n"))


@query("U2_filter_plugin", "select p_partkey from part where p_size > 10 and p_size % 2 = 1")
def u2(s, d):
    return plugins.apply_filters(b.table(s, d, "part"), lambda t: t.where("p_size > 10"), lambda t: t.where("p_size % 2 = 1").select("p_partkey"))


@query("U3_region_plugin", "select n_nationkey, n_name from nation where n_regionkey <> 2")
def u3(s, d):
    return plugins.prepare_region(b.table(s, d, "nation"), lambda t: t.select("n_nationkey", F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("n_name")))


@query("U4_partial_aggregate", "select l_returnflag, sum(l_quantity) as total, max(l_extendedprice) as top from lineitem group by 1")
def u4(s, d):
    line = b.table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_orderkey")
    execute = lambda t: t.groupBy("l_returnflag", "_salt").agg(F.sum("l_quantity").alias("total"), F.max("l_extendedprice").alias("top"))
    return plugins.partial_aggregate(line, ["l_returnflag"], execute, lambda t: t.groupBy("l_returnflag").agg(F.sum("total").alias("total"), F.max("top").alias("top")))


@query("U4_own_state", "select l_returnflag, count(*) as n, true as bounded from lineitem group by 1")
def u4_state(s, d):
    """The user's own state, merged in a tree: frequent parts by flag, each count within its bound of the true one."""
    line = b.table(s, d, "lineitem").select("l_returnflag", "l_partkey")
    size = 200
    found = plugins.own_aggregate(line, ["l_returnflag"], plugins.HeavyValues("l_partkey", size), "n long, `values` array<string>, counts array<long>")
    told = found.select("l_returnflag", F.explode(F.arrays_zip("values", "counts")).alias("x")).select("l_returnflag", F.col("x.values").cast("long").alias("l_partkey"), F.col("x.counts").alias("c"))
    true = line.groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("t"))
    less = F.col("t") - F.coalesce("c", F.lit(0))
    checked = true.join(told, ["l_returnflag", "l_partkey"], "left").join(found.select("l_returnflag", "n"), "l_returnflag").groupBy("l_returnflag", "n").agg(F.bool_and((less >= 0) & (less <= F.col("n") / size)).alias("bounded"))
    return checked.select("l_returnflag", "n", "bounded")
