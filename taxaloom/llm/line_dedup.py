"""Site-relative boilerplate lines (operator 6, DataFrame functions only).

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the number
of the host's pages; lines above the allowed ratio are dropped from every page of that host. Lines travel as 128-bit
hashes, so a shuffle moves no text but that of the final join; a frequent line is counted before the shuffle and a
large host is spread over its lines. A page's time follows its lines, however many of them go.

On a host of fewer pages than one over the ratio any line exceeds it. ``min_pages`` (1: no such limit) keeps lines that are on
fewer pages.

Defined cases: a null host is a host of its own; a null or empty text has no lines and stays as it is; blank
lines are never boilerplate; repeated rows count as pages each; an empty table gives an empty result;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), line).alias("a"), F.xxhash64(F.lit(2), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _page_lines(rows: DataFrame) -> DataFrame:
    """Each different line of each page that isn't blank: host and hash."""
    kept = F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")
    # Strings are told apart by a hash set; structs would be compared with each other.
    return rows.select("host", F.explode(F.transform(F.array_distinct(kept), _hash)).alias("line"))


def _placed_lines(rows: DataFrame) -> DataFrame:
    """Every line of each page that isn't blank: key, host, place and hash."""
    each = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("place"), F.when(F.trim(x) != "", _hash(x)).alias("line")))
    return rows.select("key", "host", F.explode(F.filter(each, lambda x: x["line"].isNotNull())).alias("x")).select("key", "host", "x.place", "x.line")


def frequent_lines(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 1, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Boilerplate lines by host: host, line (hash), pages, host_pages."""
    return _frequent(_keyed(docs, host_col, id_col, text_col), max_ratio, min_pages)


def _keyed(docs: DataFrame, host_col: str, id_col: str, text_col: str) -> DataFrame:
    """Host, text and a key that equal rows share: they have the same lines and lose the same."""
    host, text = F.col(host_col).cast("string"), F.col(text_col)
    key = F.struct(F.xxhash64(F.lit(1), F.col(id_col).cast("string"), host, text).alias("a"), F.xxhash64(F.lit(2), F.col(id_col).cast("string"), host, text).alias("b"))
    return docs.select(key.alias("key"), F.struct(host.alias("name")).alias("host"), text.alias("text"))


def _frequent(rows: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    totals = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = _page_lines(rows).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "host").where(F.col("pages") > F.lit(max_ratio) * F.col("host_pages"))


def drop_frequent_lines(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 1, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with boilerplate lines taken out of their text; all other columns as they are.

    Adds nothing: see ``line_report`` for counts.
    """
    names = docs.columns
    out = _with_drops(docs, max_ratio, min_pages, host_col, id_col, text_col)
    return out.select(*[_kept().alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names])


def line_report(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 1, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, lines, lines dropped and the text that stays."""
    out = _with_drops(docs, max_ratio, min_pages, host_col, id_col, text_col)
    lines = F.when(F.col("lines").isNull() | (F.col("lines") == F.array(F.lit(""))), F.lit(0)).otherwise(F.size("lines"))
    dropped = F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size("drops"))
    return out.select(F.col(f"row.`{id_col}`").alias(id_col), lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), _kept().alias("text"))


def _with_drops(docs: DataFrame, max_ratio: float, min_pages: int, host_col: str, id_col: str, text_col: str) -> DataFrame:
    """row: all columns but the text; lines: the text's; drops: the places of the lines to drop, null for none."""
    rows = _keyed(docs, host_col, id_col, text_col)
    found = _placed_lines(rows).join(_frequent(rows, max_ratio, min_pages).select("host", "line"), ["host", "line"])
    drops = found.groupBy("key").agg(F.collect_set("place").alias("drops"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0)]
    whole = docs.select(F.struct(*others).alias("row"), _keyed_key(host_col, id_col, text_col).alias("key"), _lines(F.col(f"`{text_col}`")).alias("lines"))
    return whole.join(drops, "key", "left")


def _keyed_key(host_col: str, id_col: str, text_col: str) -> Column:
    host, text, doc = F.col(host_col).cast("string"), F.col(text_col), F.col(id_col).cast("string")
    return F.struct(F.xxhash64(F.lit(1), doc, host, text).alias("a"), F.xxhash64(F.lit(2), doc, host, text).alias("b"))


def _kept() -> Column:
    """The text of the lines that stay. Places are told apart by a hash set, and ``lines`` is a column of its own: linear."""
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    return F.when(F.col("drops").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))


#: The report in DuckDB's SQL; the names in braces are the table, the columns and the limits.
REPORT_SQL = """
with page as (select row_number() over () as k, {id} as id, {host} as host, {text} as body from {table}),
line as (select k, host, unnest(string_split(body, chr(10))) as line, unnest(range(1, len(string_split(body, chr(10))) + 1)) as pos from page where body <> ''),
total as (select host, count(*) as n from page group by host),
often as (select l.host, l.line from (select host, line, count(distinct k) as c from line where trim(line, ' ') <> '' group by host, line) l
          join total t on l.host is not distinct from t.host where l.c >= {min_pages} and l.c > {max_ratio} * t.n),
flagged as (select l.k, l.pos, l.line, o.line is not null as bad from line l left join often o on l.line = o.line and l.host is not distinct from o.host),
report as (select k, count(*) as n_lines, sum(bad::int) as n_dropped, string_agg(line, chr(10) order by pos) filter (where not bad) as text from flagged group by k)
select p.id as {id}, coalesce(r.n_lines, 0)::bigint as n_lines, coalesce(r.n_dropped, 0)::bigint as n_dropped,
       case when r.k is null then p.body else coalesce(r.text, '') end as text
from page p left join report r using (k)
"""
