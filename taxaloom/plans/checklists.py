"""Filters, joins, windows and sets on checklists and occurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaloom.operators import checklist, joins, rows
from taxaloom.plans import base as b
from taxaloom.plans.base import sql
from taxaloom.registry import query

KC = ("chk", "known", "cand")


#: A long known name: the species' own stands in its middle.
_LONG = "concat_ws(' ', p_brand, p_name, p_type)"


@query("P1_occurrence_quality", sql("occ", body="""select obs_id, taxon_key, lon, lat from occ where taxon_key in (select p_partkey from part where p_size % 2 = 0)
  and basis in ('HUMAN_OBSERVATION', 'PRESERVED_SPECIMEN') and has_coordinate and not has_issue and status = 'PRESENT' and "year" >= 1970 and uncertainty <= 4700
  and lon between -170 and 170 and lat between -60 and 90"""))
def p1(s, d):
    keys = b.table(s, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("taxon_key"))
    return checklist.quality_filter(b.occ(s, d), keys, 4700, (-170, 170, -60, 90)).select("obs_id", "taxon_key", "lon", "lat")


@query("P2_species_list", sql("occ", body="""select distinct scientific_name from occ where basis in ('HUMAN_OBSERVATION', 'PRESERVED_SPECIMEN') and has_coordinate
  and not has_issue and status = 'PRESENT' and "year" >= 1970 and uncertainty <= 4700"""))
def p2(s, d):
    return checklist.species_list(b.occ(s, d), "scientific_name")


@query("P3_rank_filter", sql("backbone", body="select usage_key, name, rank from backbone where rank in (select distinct p_type from part order by 1 limit 5) and trim(name) <> ''"))
def p3(s, d):
    ranks = b.table(s, d, "part").select(F.col("p_type").alias("rank")).distinct().orderBy("rank").limit(5)
    return checklist.rank_filter(b.backbone(s, d), ranks, "rank", "name").select("usage_key", "name", "rank")


@query("P4_presence_filter", sql("occ", body="select obs_id, clean_name from occ where status = 'PRESENT'"))
def p4(s, d):
    return b.occ(s, d).where("status = 'PRESENT'").select("obs_id", "clean_name")


@query("P5_blank_species", "select p_partkey, nullif(trim(case when p_size % 5 = 0 then ' ' else p_name end), '') as species from part where p_size % 5 <> 0 and trim(p_name) <> ''")
def p5(s, d):
    raw = b.table(s, d, "part").selectExpr("p_partkey", "case when p_size % 5 = 0 then ' ' else p_name end as species")
    return raw.withColumn("species", rows.blank_to_null(F.col("species"))).where("species is not null")


@query("P6_valid_coordinates", sql("occ", body="select obs_id, lon, lat from occ where has_coordinate"))
def p6(s, d):
    raw = b.occ(s, d).withColumn("lon", F.when(F.col("has_coordinate"), F.col("lon")))
    return raw.dropna(subset=["lon", "lat"]).select("obs_id", "lon", "lat")


@query("P9_exclusion_reason", sql("stats", body="""select clean_name, "order", source, overlap, case when not excluded and overlap > 0 then 'Included' when ln(observations) <= 4 then 'Too Few Observations'
  when overlap = 0 then 'No Hypervolume Overlap' else 'Other' end as reason from stats"""))
def p9(s, d):
    return b.stats(s, d).select("clean_name", "order", "source", "overlap", checklist.exclusion_reason("excluded", "observations", "overlap", 4).alias("reason"))


_FLAGS = "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice as price, {} as flag from lineitem"


@query("P10_any_symbol", _FLAGS.format("l_returnflag in ('R', 'O') or l_linestatus in ('R', 'O')"))
def p10(s, d):
    return b.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("price"), rows.any_symbol(["l_returnflag", "l_linestatus"], ["R", "O"]).alias("flag"))


@query("P11_all_symbols", _FLAGS.format("l_returnflag in ('N', 'O') and l_linestatus in ('N', 'O')"))
def p11(s, d):
    return b.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("price"), rows.all_symbols(["l_returnflag", "l_linestatus"], ["N", "O"]).alias("flag"))


@query("P12_rank_prefixed_name", """select p_partkey, concat_ws(' ', p_name, case p_size % 4 when 1 then 'subsp.' when 2 then 'var.' when 3 then 'f.' end, case when p_size % 4 > 0 then lower(p_brand) end) as full_name from part""")
def p12(s, d):
    ranked = b.table(s, d, "part").selectExpr("p_partkey", "p_name", "element_at(array('SPECIES', 'SUBSPECIES', 'VARIETY', 'FORM'), p_size % 4 + 1) as rank", "case when p_size % 4 > 0 then lower(p_brand) end as epithet")
    return ranked.select("p_partkey", checklist.prefixed_name("p_name", "rank", "epithet").alias("full_name"))


@query("P13_name_with_author", sql("chk", body="select id, case when size % 3 = 0 then verbatim_name else verbatim_name || ' ' || authorship end as full_name from chk"))
def p13(s, d):
    return b.chk(s, d).withColumn("authorship", F.when(F.col("size") % 3 == 0, " ").otherwise(F.col("authorship"))).select("id", checklist.name_with_author("verbatim_name", "authorship").alias("full_name"))


_MATCH = """m as (select p_partkey as id, p_name as input, case when p_size % 7 = 0 then null when p_size % 3 = 0 then p_name || ' alba' else p_name end as found, p_size % 5 as dist from part)"""


def _match(s, d):
    return b.table(s, d, "part").selectExpr("p_partkey as id", "p_name as input", "case when p_size % 7 = 0 then null when p_size % 3 = 0 then concat(p_name, ' alba') else p_name end as found", "p_size % 5 as dist")


@query("P14_clean_split", f"""with {_MATCH}, f as (select *, coalesce(dist >= 3 and found <> input, false) as bad from m where found is not null),
  g as (select f.id, f.input, f.found, f.input in (select input from f where bad) as mismatch from f) select id, input, found, case when mismatch then 'mismatch' else 'clean' end as outcome from g""")
def p14(s, d):
    return checklist.clean_split(_match(s, d).where("found is not null"), "input", "found", "dist", 3).select("id", "input", "found", "outcome")


@query("P15_no_match_split", f"with {_MATCH} select id, input, found is null as no_match from m")
def p15(s, d):
    return _match(s, d).select("id", "input", F.col("found").isNull().alias("no_match"))


@query("P16_null_name_split", f"with {_MATCH} select id, case when found is null or trim(found) = '' then 'na' else 'named' end as side from m")
def p16(s, d):
    named, na = rows.split_by(_match(s, d), rows.blank_to_null(F.col("found")).isNotNull())
    return named.select("id", F.lit("named").alias("side")).unionByName(na.select("id", F.lit("na").alias("side")))


@query("P17_lower_taxon_filter", """select p_partkey, p_size from part a where p_size = 1 or not exists (select 1 from part x where x.p_size = 1 and x.p_name = a.p_name)""")
def p17(s, d):
    return checklist.drop_lower_taxa(b.table(s, d, "part"), "p_name", F.col("p_size") == 1).select("p_partkey", "p_size")


@query("P18_taxon_group", """with o as (select p_type as t, row_number() over (order by p_type) as pos from (select distinct p_type from part)) select p_partkey,
  case when pos % 4 = 0 then 'pteridophytes' when pos % 4 = 1 then 'gymnosperms' when pos % 4 = 2 then 'angiosperms' else 'others' end as "group" from part join o on t = p_type""")
def p18(s, d):
    part = b.table(s, d, "part")
    orders = rows.group_ids(part.select("p_type").distinct(), ["p_type"], "pos").where("pos % 4 <> 3")
    groups = orders.select(F.col("p_type").alias("order"), F.element_at(F.array(*map(F.lit, ("pteridophytes", "gymnosperms", "angiosperms"))), (F.col("pos") % 4 + 1).cast("int")).alias("group"))
    return checklist.tag_groups(part, groups, "p_type").select("p_partkey", "group")


@query("P19_included_excluded", sql("stats", body="select excluded, count(*) as species, sum(observations)::bigint as observations from stats group by excluded"))
def p19(s, d):
    kept, removed = rows.split_by(b.stats(s, d), ~F.col("excluded"))
    return kept.unionByName(removed).groupBy("excluded").agg(F.count("*").alias("species"), F.sum("observations").alias("observations"))


@query("P19_underlying_taxa", sql("stats", body=f"select s.clean_name, k.known, exists (select 1 from part where p_size > 40 and p_brand = s.clean_name) as analysed from (select distinct clean_name from stats where not excluded) s join (select distinct {_LONG} as known from part) k on contains(known, clean_name)"))
def p19_underlying(s, d):
    included = b.stats(s, d).where("not excluded").select("clean_name")
    part = b.table(s, d, "part")
    return checklist.underlying_taxa(included, part.select(F.expr(_LONG).alias("known")), part.where("p_size > 40").select(F.col("p_brand").alias("clean_name")), "clean_name", "known")


@query("P20_result_sanity", sql("stats", body="""select 'unexpected' as problem, count(*) as n from (select distinct clean_name from stats where clean_name not in (select p_brand from part where p_size > 3))
  union all select 'included without overlap', count(*) from stats where not excluded and overlap = 0"""))
def p20(s, d):
    expected = b.table(s, d, "part").where("p_size > 3").select(F.col("p_brand").alias("clean_name"))
    return checklist.result_problems(b.stats(s, d), expected, "clean_name")


@query("P21_manual_corrections", """select p_partkey, trim(p_name) as name, 'list' || (p_size % 3) as source from part where p_size % 4 not in (0, 1) and 'list' || (p_size % 3) in ('list0', 'list1')
  union all select -1, 'base', 'list0'""")
def p21(s, d):
    edits = b.table(s, d, "part").selectExpr("p_partkey", "case when p_size % 4 = 0 then 'removed' when p_size % 4 = 1 then ' ' else p_name end as name", "concat('list', p_size % 3) as source")
    base = s.createDataFrame([(-1, "base", "list0"), (-2, None, "list1")], "p_partkey long, name string, source string").where("name is not null")
    sources = s.createDataFrame([("list0",), ("list1",)], "source string")
    return checklist.merge_corrections(base, edits, sources, "name", "source")


@query("P22_review_queue", f"with {_MATCH}, q as (select id, input, 'na' as origin from m where found is null union all select id, input, 'mismatch' from m where found <> input and dist >= 3) select input as name, min(id) as id, arg_min(origin, (origin, id)) as origin, null::varchar as accepted_name, null::varchar as comment from q group by input")
def p22(s, d):
    m = _match(s, d)
    return checklist.review_queue({"na": m.where("found is null"), "mismatch": m.where("found <> input and dist >= 3")}, "input", "id")


@query("P23_loss_accounting", f"with {_MATCH} select dist as source, count(*) as n_in, count(found) as matched, count_if(found = input)::bigint as clean, count_if(found <> input)::bigint as mismatch, count_if(found is null)::bigint as na, count(*) - count(distinct input) as duplicates, greatest(0, count(*) - count(found) - count_if(found is null))::bigint as lost from m group by dist")
def p23(s, d):
    return checklist.loss_accounting(_match(s, d), "dist", "input", "found").withColumnRenamed("dist", "source")


@query("J1_anti_join_audit", sql(*KC, body="""select distinct verbatim_name, authorship from cand where (verbatim_name, authorship) not in (select (verbatim_name, authorship) from known)"""))
def j1(s, d):
    return joins.anti_audited(b.cand(s, d).select("verbatim_name", "authorship"), b.known(s, d), ["verbatim_name", "authorship"])


@query("J2_inner_join_audit", sql(*KC, body="select distinct c.verbatim_name, c.authorship as candidate_author, k.authorship as known_author from cand c join known k using (verbatim_name)"))
def j2(s, d):
    return joins.inner_audited(b.cand(s, d).select("verbatim_name", F.col("authorship").alias("candidate_author")), b.known(s, d).select("verbatim_name", F.col("authorship").alias("known_author")), ["verbatim_name"])


@query("J3_present_absent", sql(*KC, body="select id, verbatim_name, case when verbatim_name in (select verbatim_name from known) then 'present' else 'absent' end as presence from cand"))
def j3(s, d):
    return joins.presence_split(b.cand(s, d).select("id", "verbatim_name"), b.known(s, d), "verbatim_name")


@query("J4_right_lookup", "select n_nationkey, n_name, count(s_suppkey) as suppliers from supplier right join nation on s_nationkey = n_nationkey group by all")
def j4(s, d):
    out = b.table(s, d, "supplier").join(b.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right")
    return out.groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("J5_many_to_many", """select a.p_brand, a.p_partkey, s.p_partkey as other from part a join part s on a.p_name = s.p_name and a.p_brand = s.p_brand""")
def j5(s, d):
    part = b.table(s, d, "part")
    other = part.withColumnRenamed("p_partkey", "other")
    return joins.all_pairs(part, other, ["p_name", "p_brand"], "p_partkey", "other").select("p_brand", "p_partkey", "other")


@query("J6_update_join", "select p_partkey, coalesce(q, p_size)::bigint as p_size from part left join (select l_partkey, sum(l_quantity)::bigint as q from lineitem where l_returnflag = 'R' group by 1) on l_partkey = p_partkey")
def j6(s, d):
    new = b.table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("p_size"))
    return joins.update_join(b.table(s, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size")), new, ["p_partkey"], "p_size")


@query("J7_sort_table_join", "select s_suppkey, s_nationkey, n_name, n_regionkey as west_east from supplier left join nation on s_nationkey = n_nationkey and n_nationkey % 2 = 0")
def j7(s, d):
    order = b.table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("west_east"))
    return b.table(s, d, "supplier").select("s_suppkey", "s_nationkey").join(order, "s_nationkey", "left")


@query("J8_semi_join", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def j8(s, d):
    keys = b.table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return b.table(s, d, "orders").select("o_orderkey", "o_custkey").join(keys, "o_custkey", "left_semi")


@query("J9_prefix_join", "with i as (select distinct split_part(p_name, ' ', 1) as item from part where p_size % 2 = 0) select item, min(p_partkey) as match_id, count(*) as matches from i join part on starts_with(p_name, item) and lower(split_part(p_name, ' ', 1)) = lower(item) group by item")
def j9(s, d):
    part = b.table(s, d, "part")
    items = part.where("p_size % 2 = 0").select(F.substring_index("p_name", " ", 1).alias("item")).distinct()
    return joins.prefix_join(items, part, "item", "p_name", "p_partkey")


@query("J9_containment_join", f"with i as (select distinct p_name as item from part where p_size % 2 = 0 union select distinct p_type from part where p_size % 3 = 0 union select distinct substr(p_name, 3, 2) from part) select item, p_partkey, {_LONG} as known from i join part on contains({_LONG}, item)")
def j9_inside(s, d):
    part = b.table(s, d, "part")
    items = part.where("p_size % 2 = 0").select(F.col("p_name").alias("item")).union(part.where("p_size % 3 = 0").select("p_type")).union(part.select(F.substring("p_name", 3, 2)))
    return joins.containment_join(items, part.select("p_partkey", F.expr(_LONG).alias("known")), "item", "known", "p_partkey")


@query("J10_full_outer", """with a as (select l_suppkey k, count(*) n from lineitem where l_returnflag = 'R' and l_tax > 0.06 group by 1), c as (select s_suppkey k, s_nationkey from supplier where s_suppkey % 2 = 0) select k, n, s_nationkey from a full join c using (k)""")
def j10(s, d):
    a = b.table(s, d, "lineitem").where("l_returnflag = 'R' and l_tax > 0.06D").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    return a.join(b.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), "s_nationkey"), "k", "full")


@query("J11_merge_and_sum", """with a as (select l_partkey k, count(*) v from lineitem where l_returnflag = 'R' group by 1), c as (select l_partkey k, count(*) v from lineitem where l_linenumber = 1 group by 1) select k, coalesce(a.v, 0) + coalesce(c.v, 0) as v from a full join c using (k)""")
def j11(s, d):
    line = b.table(s, d, "lineitem")
    of = lambda w: line.where(w).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("v"))
    return joins.merge_and_sum(of("l_returnflag = 'R'"), of("l_linenumber = 1"), "k", "v")


_PASS = """with i as (select p_partkey id, p_name a, p_type t, p_partkey * 2 as u from part where p_partkey % 2 = 0), r as (select p_partkey id, p_name a, p_type t, p_partkey as u from part where p_partkey % 2 = 1 or p_partkey % 8 = 0),
 h1 as (select i.id item_id, r.id reference_id, 1 as pass from i join r using (u)),
 i2 as (select * from i where id not in (select item_id from h1)), r2 as (select * from r where id not in (select reference_id from h1)),
 h2 as (select i2.id item_id, r2.id reference_id, 2 as pass from i2 join r2 using (a)),
 i3 as (select * from i2 where id not in (select item_id from h2)), r3 as (select * from r2 where id not in (select reference_id from h2)),
 h3 as (select i3.id item_id, r3.id reference_id, 3 as pass from i3 join r3 using (t))
 select * from h1 union all select * from h2 union all select * from h3"""


@query("J12_cascading_match", _PASS)
def j12(s, d):
    part = b.table(s, d, "part")
    items = part.where("p_partkey % 2 = 0").selectExpr("p_partkey as id", "p_name as a", "p_type as t", "p_partkey * 2 as u")
    reference = part.where("p_partkey % 2 = 1 or p_partkey % 8 = 0").selectExpr("p_partkey as id", "p_name as a", "p_type as t", "p_partkey as u")
    return joins.cascading_match(items, reference, [("u", "u"), ("a", "a"), ("t", "t")], "id", "id")


@query("J16_synonym_resolution", sql("backbone", body="select x.usage_key, a.name, a.rank, a.family, x.accepted_key <> x.usage_key as synonym, x.accepted_key as resolved_key from backbone x join backbone a on x.accepted_key = a.usage_key"))
def j16(s, d):
    return joins.resolve_synonyms(b.backbone(s, d), "usage_key", "accepted_key", ["name", "rank", "family"]).drop("accepted_key")


@query("J17_exact_backbone_match", """with k as (select lower(trim(p_name)) as n, min(p_partkey) as usage_key from part where p_size < 25 group by 1) select p_partkey, p_name, usage_key, usage_key is not null as matched from part left join k on lower(trim(p_name)) = n""")
def j17(s, d):
    part = b.table(s, d, "part")
    keyed = part.where("p_size < 25").select(F.upper("p_name").alias("name"), F.col("p_partkey").alias("usage_key"))
    return joins.backbone_match(part.select("p_partkey", "p_name"), keyed, "p_name", "name", ["usage_key"]).select("p_partkey", "p_name", "usage_key", "matched")


@query("J18_standardize_checklist", sql("chk", "backbone", body="""select a.name as accepted_name, k.accepted as species_key, count(*) as names from (select verbatim_name from chk group by 1) c
  join (select lower(trim(name)) n, min(accepted_key) as accepted from backbone where usage_key % 5 <> 0 group by 1) k on lower(trim(verbatim_name)) = n join backbone a on a.usage_key = k.accepted group by all"""))
def j18(s, d):
    back = b.backbone(s, d)
    return checklist.standardize(b.chk(s, d), back.where("usage_key % 5 <> 0"), back)


@query("J19_fuzzy_match", """with b as (select p_name as n, min(p_partkey) as id from part where p_partkey % 2 = 0 group by 1), q as (select distinct case p_size % 3 when 0 then p_name || 'x' when 1 then 'q' || substr(p_name, 3) else p_name end as name from part),
  x as (select name, id as match_id, n as match_name, levenshtein(name, n)::int as distance from q join b on levenshtein(name, n) <= 3)
  select name, arg_min(match_id, (distance, match_id)) as match_id, arg_min(match_name, (distance, match_id)) as match_name, min(distance) as distance from x group by name""")
def j19(s, d):
    part = b.table(s, d, "part")
    names = part.select(F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("x"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("q"), F.substring("p_name", 3, 1000))).otherwise(F.col("p_name")).alias("name"))
    return joins.fuzzy_match(names, part.where("p_partkey % 2 = 0"), "name", "p_name", "p_partkey", 3)


@query("J20_best_match", "select p_name, arg_min(p_partkey, (p_size % 2, p_size, p_partkey)) as match_id from part group by p_name")
def j20(s, d):
    part = b.table(s, d, "part").withColumn("accepted", F.col("p_size") % 2 == 0)
    return rows.keep_first(part, ["p_name"], [F.col("accepted").desc(), "p_size", "p_partkey"]).select("p_name", F.col("p_partkey").alias("match_id"))


@query("J21_accepted_occurrences", sql("occ", "backbone", body="""select o.obs_id, coalesce(case when k.usage_key % 2 = 0 then upper(k.name) end, case when k.usage_key % 3 = 0 then k.name || '?' end, o.scientific_name) as scientific_name, o.scientific_name as original_name
  from occ o left join backbone k on k.usage_key = o.taxon_key"""))
def j21(s, d):
    keys = b.backbone(s, d).selectExpr("usage_key as taxon_key", "case when usage_key % 2 = 0 then upper(name) end as accepted_name", "case when usage_key % 3 = 0 then concat(name, '?') end as listed_name")
    return joins.accepted_names(b.occ(s, d).select("obs_id", "taxon_key", "scientific_name"), keys, "taxon_key", "scientific_name").select("obs_id", "scientific_name", "original_name")


@query("J22_known_species_filter", sql("occ", body="select scientific_name, count(*) as n from occ where replace(scientific_name, ' ', '') in (select replace(p_name, ' ', '') from part where p_size < 10) group by 1"))
def j22(s, d):
    keys = b.table(s, d, "part").where("p_size < 10").select(F.col("p_name").alias("scientific_name"))
    return joins.known_species_only(b.occ(s, d), keys, "scientific_name")[0].groupBy("scientific_name").agg(F.count("*").alias("n"))


@query("J23_replicate_over_regions", sql("stats", "paoo", body="""select s.clean_name, s.source, s.observations, s."order", s.overlap, r.sub_region from stats s join (select distinct family, sub_region from paoo) r on r.family = s.clean_name"""))
def j23(s, d):
    regions = b.paoo(s, d).select(F.col("family").alias("clean_name"), "sub_region").distinct()
    return b.stats(s, d).select("clean_name", "source", "observations", "order", "overlap").join(regions, "clean_name")


@query("J24_reconciliation", """with a as (select l_suppkey k, count(*) n from lineitem where l_linenumber = 1 and l_suppkey % 3 <> 0 group by 1), c as (select s_suppkey k, count(*) n from supplier where s_suppkey % 4 <> 0 group by 1)
  select k, coalesce(a.n, 0) as rows_a, coalesce(c.n, 0) as rows_b, case when a.n is null then 'stats' when c.n is null then 'maps' end as missing_from, coalesce(a.n, 0) > 1 or coalesce(c.n, 0) > 1 as duplicated from a full join c using (k)""")
def j24(s, d):
    a = b.table(s, d, "lineitem").where("l_linenumber = 1 and l_suppkey % 3 <> 0").select(F.col("l_suppkey").alias("k"))
    return joins.reconcile(a, b.table(s, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("k")), "k", ("stats", "maps"))


@query("J25_stats_plus_removed", sql("stats", body="""select clean_name, source, "order", overlap, observations, volume from stats where not excluded union all select clean_name, source, "order", overlap, observations, null from stats where excluded"""))
def j25(s, d):
    st = b.stats(s, d).select("clean_name", "source", "order", "overlap", "observations", "volume", "excluded")
    return rows.ragged_union(st.where("not excluded").drop("excluded"), st.where("excluded").drop("volume", "excluded"))


@query("J26_zero_fill", "select p_partkey, coalesce(n, 0) as n from part left join (select l_partkey, count(*) as n from lineitem where l_tax > 0.07 and l_returnflag = 'R' group by 1) on l_partkey = p_partkey")
def j26(s, d):
    n = b.table(s, d, "lineitem").where("l_tax > 0.07D and l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return joins.zero_filled(b.table(s, d, "part").select("p_partkey"), n, "p_partkey", ["n"])


@query("J27_composition_difference", sql("paoo", "chk", body="""select r.sub_region, g."order", round(coalesce(s.share, 0), 8) as share, round(coalesce(x.share, 0), 8) as baseline_share, round(coalesce(s.share, 0) - coalesce(x.share, 0), 8) as difference
  from (select distinct sub_region from paoo) r cross join (select "order" from paoo union select "order" from chk) g
  left join (select sub_region, "order", sum(records) / sum(sum(records)) over (partition by sub_region) as share from paoo group by 1, 2) s on s.sub_region = r.sub_region and s."order" = g."order"
  left join (select "order", count(*) / sum(count(*)) over () as share from chk group by 1) x on x."order" = g."order" where s.share is not null or x.share is not null"""))
def j27(s, d):
    out = joins.share_difference(b.paoo(s, d), b.chk(s, d).withColumn("records", F.lit(1)), "sub_region", "order", "records")
    return out.withColumns({c: F.round(c, 8) for c in ("share", "baseline_share", "difference")})
