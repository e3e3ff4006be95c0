"""Name functions over distinct part names with marks added, so that every rule has rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaloom.functions import names
from taxaloom.plans import base as b
from taxaloom.registry import query

#: Raw names: a genus-like first word, then marks that depend on the part's size.
_RAW = """raw as (select p_partkey as id, p_size as size, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || case p_size % 8 when 0 then ' x hybrida' when 1 then ' ssp. alba' when 2 then ' variety nana' when 3 then '  sp.'
  when 4 then ' aff. rubra' when 5 then ' var. minor' when 6 then ' "Rosea"..' else '' end as name from part)"""


def _raw(s, d):
    mark = "case p_size % 8 when 0 then ' x hybrida' when 1 then ' ssp. alba' when 2 then ' variety nana' when 3 then '  sp.' when 4 then ' aff. rubra' when 5 then ' var. minor' when 6 then ' \"Rosea\"..' else '' end"
    return b.table(s, d, "part").selectExpr("p_partkey as id", "p_size as size", f"concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), {mark}) as name")


def _one(name: str, column: str, expression: str, make) -> None:
    """A query with one expression over the raw names."""

    @query(name, f"with {_RAW} select id, {expression} as {column} from raw")
    def run(s, d):
        return _raw(s, d).select("id", make(F.col("name")).alias(column))


_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_one("H1_clean_text", "clean", _SQUEEZE.format("regexp_replace(regexp_replace(regexp_replace(replace(translate(name || ' – “q” x subsp. K, Xx x y', '–' || chr(160), '- '), '\"', ''), '([A-Z]),', '\\1.', 'g'), '\\.\\.', '.', 'g'), '\\s+x\\s+(\\S{2,}\\.)', ' \\1', 'g')"), lambda c: names.clean_text(F.concat(c, F.lit(" – “q” x subsp. K, Xx x y"))))
_one("H2_hybrid_symbols", "clean", _SQUEEZE.format("replace(name, ' x ', ' × ')"), names.clean_symbols)
_one("H3_rank_designations", "clean", "replace(replace(name, ' ssp. ', ' subsp. '), ' variety ', ' var. ')", names.clean_designations)
_one("H4_without_qualifiers", "clean", _SQUEEZE.format("regexp_replace(regexp_replace(name, '\\s(aff|agg|coll|sp|cf)\\.(\\s|$)', ' ', 'g'), ' s\\. lat\\.', '', 'g')"), names.without_qualifiers)
_one("H5_without_infraspecific", "clean", _SQUEEZE.format("regexp_replace(name, '\\s(subsp\\.|var\\.|f\\.|subvar\\.|subf\\.|cv\\.|sect\\.|ser\\.)\\s.*$', '')"), names.without_infraspecific)
_one("H6_infraspecific_part", "part", "nullif(regexp_extract(name, '\\s((subsp|var|f)\\.\\s+\\S+)', 1), '')", names.infraspecific)
_one("H10_word_count", "words", "len(string_split_regex(trim(name), '\\s+'))", lambda c: names.word_count(c).cast("long"))
_one("H11_sentence_case", "clean", "upper(substr(name, 1, 1)) || lower(substr(name, 2))", names.sentence_case)


@query("H7_name_structure")
def h7(s, d):
    return names.name_parts(_raw(s, d), "name")


@query("H8_file_names", f"with {_RAW} select id, regexp_replace(trim(name), '\\s+', '_', 'g') as file, regexp_replace(trim(name), '\\s+', ' ', 'g') as species from raw where position('_' in name) = 0")
def h8(s, d):
    raw = _raw(s, d).where("instr(name, '_') = 0").withColumn("file", names.file_name(F.col("name")))
    return raw.select("id", "file", names.species_of_file(F.concat(F.lit("chunk/species/"), "file", F.lit(".csv"))).alias("species"))


@query("H9_pattern_from_list", "select p_partkey, regexp_matches(p_type, 'a|o\\.|e') as hit from part")
def h9(s, d):
    return b.table(s, d, "part").select("p_partkey", F.col("p_type").rlike(names.any_of(["a", "o.", "e", "a"])).alias("hit"))


@query("H12_text_wrap")
def h12(s, d):
    return b.table(s, d, "documents").select("doc_id", names.wrapped(F.regexp_replace("text", r"\s+", " "), 20).alias("wrapped"))


@query("H13_number_formats", "select p_partkey, regexp_replace(regexp_replace(printf('%.5f', p_retailprice), '0+$', ''), '\\.$', '') as price, round(p_retailprice, 1) as rounded from part")
def h13(s, d):
    return b.table(s, d, "part").select("p_partkey", names.coordinate_text(F.col("p_retailprice")).alias("price"), F.round("p_retailprice", 1).alias("rounded"))


@query("H14_math", "select p_partkey, round(ln(p_size), 8) as ln, round(sqrt(p_retailprice), 8) as root, ceil(p_retailprice)::bigint as up, floor(p_retailprice)::bigint as down, round(exp(p_size / 50.0), 8) as e, round(cos(radians(p_size)), 8) as c, round(pow(p_size, 1.5), 6) as p from part where p_size > 0")
def h14(s, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    part = b.table(s, d, "part").where("p_size > 0")
    return part.select("p_partkey", F.round(F.log(size), 8).alias("ln"), F.round(F.sqrt(price), 8).alias("root"), F.ceil(price).alias("up"), F.floor(price).alias("down"), F.round(F.exp(size / 50.0), 8).alias("e"), F.round(F.cos(F.radians(size)), 8).alias("c"), F.round(F.pow(size, 1.5), 6).alias("p"))


@query("H15_logit", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round(ln(p / (1 - p)), 6) as logit, round(1 / (1 + exp(-l_discount)), 8) as inverse from (select *, greatest(1e-6, least(1 - 1e-6, l_discount * 12)) as p from lineitem)")
def h15(s, d):
    line = b.table(s, d, "lineitem")
    return line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.round(names.logit(F.col("l_discount") * 12), 6).alias("logit"), F.round(names.inverse_logit(F.col("l_discount")), 8).alias("inverse"))


@query("H16_null_safe_add", "select p_partkey, case when a is null and c is null then null else coalesce(a, 0) + coalesce(c, 0) end as total from (select p_partkey, case when p_size % 2 = 0 then p_size end as a, case when p_size % 3 = 0 then p_size end as c from part)")
def h16(s, d):
    from taxaloom.operators.joins import null_safe_add

    a, c = (F.when(F.col("p_size") % k == 0, F.col("p_size")) for k in (2, 3))
    return b.table(s, d, "part").select("p_partkey", null_safe_add(a, c).alias("total"))


@query("H17_utf8_round_trip", "select doc_id, length(text) as chars, strlen(text) as bytes from documents")
def h17(s, d):
    text = F.decode(F.encode("text", "UTF-8"), "UTF-8")
    return b.table(s, d, "documents").select("doc_id", F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"))
