"""Statistics over occurrences and compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaloom.operators import stats
from taxaloom.plans import base as b
from taxaloom.plans.base import sql
from taxaloom.registry import query

BIO = ("bio1", "bio2", "bio3", "bio4")


def _round(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


@query("M1_correlation_matrix", sql("occ", body=" union all ".join(f"select '{x}' as a, '{y}' as b, round(corr({x}, {y}), 6) as r, round(corr({x}, {y}) * sqrt((count(*) - 2) / (1 - corr({x}, {y}) * corr({x}, {y}))), 4) as t from occ" for i, x in enumerate(BIO) for y in BIO[i + 1 :])))
def m1(s, d):
    return stats.correlations(b.occ(s, d), BIO).select("a", "b", F.round("r", 6).alias("r"), F.round("t", 4).alias("t"))


@query("M1_correlation_p_values")
def m1p(s, d):
    return _round(stats.correlations(b.occ(s, d), BIO))


@query("M2_principal_components")
def m2(s, d):
    return _round(stats.principal_components(b.occ(s, d), BIO, 4).select("variable", "importance", "explained"))


_EXP = """t as (select sub_region, count(*) as t from paoo group by 1), o as (select sub_region, "order", count(*) as n from paoo group by all), e as (select "order", count(*) * 30.0::double / sum(count(*)) over () as e from chk group by 1),
  f as (select t.sub_region, e."order", round(coalesce(n, 0) / t * 30.0::double) as ob, e from t cross join e left join o on o.sub_region = t.sub_region and o."order" = e."order")"""
_X2 = "x as (select sub_region, sum(pow(ob - e, 2) / e) as x2, count(*) - 1 as df, sum(ob) as n from f group by 1)"


@query("M3_composition_test", f"with {b.CTE['paoo']}, {b.CTE['chk']}, {_EXP}, {_X2} select sub_region, round(x2, 6) as chi_square, df, n, round(sqrt(x2 / (n * df)), 6) as effect_size, case when sqrt(x2 / (n * df)) < 0.1 then 'negligible' when sqrt(x2 / (n * df)) < 0.3 then 'small' when sqrt(x2 / (n * df)) < 0.5 then 'medium' else 'large' end as interpretation from x")
def m3(s, d):
    return _round(stats.chi_square(b.paoo(s, d), b.chk(s, d), "sub_region", "order", 30))


_SIM = """bins as (select "order", e, sum(e) over (order by "order") / 30.0::double as hi from e), draws as (select d, i, ((('0x' || substr(md5(concat_ws('|', '12034', d, i)), 1, 12))::bigint)::double / 281474976710656.0::double) as u from range(0, 2000) r(d), range(1, 31) q(i)),
  k as (select d, "order", e, count(*) as k from draws join bins on u >= hi - e / 30 and u < hi group by all), sim as (select d, sum(pow(k - e, 2) / e - e) + 30 as x2 from k group by 1)"""


@query("M3_simulated_p", f"with {b.CTE['paoo']}, {b.CTE['chk']}, {_EXP}, {_X2}, {_SIM} select sub_region, round((1 + count_if(sim.x2 >= x.x2 - 1e-9)) / 2001.0::double, 8) as p_value from x cross join sim group by 1")
def m3p(s, d):
    return stats.simulated_p(b.paoo(s, d), b.chk(s, d), "sub_region", "order", 30, 2000, 12034).select("sub_region", F.round("p_value", 8).alias("p_value"))


@query("M4_false_discovery", """with p as (select n_name as key, (sum(n_nationkey) * 7 % 100 + 1) / 1000.0::double as p from nation group by 1), r as (select *, row_number() over (order by p, key) as r, count(*) over () as m from p)
  select key, p, round(least(1.0, min(p * m / r) over (order by r desc rows unbounded preceding)), 9) as p_adjusted, least(1.0, min(p * m / r) over (order by r desc rows unbounded preceding)) < 0.05 as significant from r""")
def m4(s, d):
    p = b.table(s, d, "nation").groupBy(F.col("n_name").alias("key")).agg(((F.sum("n_nationkey") * 7 % 100 + 1) / 1000.0).alias("p"))
    return stats.false_discovery(p, "p", "key", 0.05).withColumn("p_adjusted", F.round("p_adjusted", 9))


@query("M5_rank_sum", sql("occ", body="""select n1, n2, u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) as z from (
  select sum(a)::bigint as n1, sum(t - a)::bigint as n2, sum(rank * a) - sum(a) * (sum(a) + 1) / 2 as u, sum(pow(t, 3) - t) as ties from (select bio1, count(*) as t, count_if(has_issue) as a, coalesce(sum(count(*)) over (order by bio1 rows between unbounded preceding and 1 preceding), 0) + (count(*) + 1) / 2 as rank from occ group by bio1))"""))
def m5(s, d):
    return stats.rank_sum(b.occ(s, d), "bio1", F.col("has_issue")).select("n1", "n2", "u", F.round("z", 6).alias("z"))


@query("M5_rank_sum_p")
def m5p(s, d):
    return _round(stats.rank_sum(b.occ(s, d), "bio1", F.col("has_issue")), 9)


@query("M6_permanova", """with g as (select s_suppkey as id, n_regionkey as g, s_acctbal as x, s_nationkey::double as y from supplier join nation on s_nationkey = n_nationkey), a as (select count(*) n, count(distinct g) k, sum(x) sx, sum(y) sy, sum(x * x + y * y) q from g),
  w as (select sum((sx * sx + sy * sy) / n) as bt from (select count(*) n, sum(x) sx, sum(y) sy from g group by g)), f as (select bt - (sx * sx + sy * sy) / n as am, q - (sx * sx + sy * sy) / n as tot, n, k from a, w)
  select round((am / (k - 1)) / ((tot - am) / (n - k)), 6) as pseudo_f, round(am / tot, 8) as r2 from f""")
def m6(s, d):
    return stats.permanova(_perm_rows(s, d), ["x", "y"], "g", "id", 19, 12034).select(F.round("pseudo_f", 6).alias("pseudo_f"), F.round("r2", 8).alias("r2"))


def _perm_rows(s, d):
    sup = b.table(s, d, "supplier").join(b.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return sup.select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("g"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))


@query("M6_permanova_p")
def m6p(s, d):
    return _round(stats.permanova(_perm_rows(s, d), ["x", "y"], "g", "id", 999, 12034))


@query("M7_latitude_effect", sql("occ", body="select floor(abs(lat) / 10)::bigint as band, count(*) as n, round(count_if(bio3 = 0) / count(*), 8) as zero_share, round(avg(case when bio3 > 0 then bio3 end), 6) as mean_positive from occ group by 1"))
def m7(s, d):
    return _round(stats.zero_share_by_band(b.occ(s, d).withColumn("a", F.abs("lat")), "a", "bio3", 10), 6).withColumn("zero_share", F.round("zero_share", 8))


@query("M7_latitude_models")
def m7models(s, d):
    x = F.abs("lat") / 90
    rows = b.occ(s, d).select("bio3", x.alias("x1"), (x * x).alias("x2"), (x * x * x).alias("x3"))
    return _round(stats.zero_inflated_models(rows, "bio3", {"line": ["x1"], "square": ["x1", "x2"], "cubic": ["x1", "x2", "x3"]}), 4)


@query("M8_smooth_latitude_curve")
def m8(s, d):
    x = F.col("lat") / 90
    rows = b.occ(s, d).select((F.col("bio1") / 50 + 0.05 * x * x).alias("y"), *[c.alias(n) for n, c in stats.spline_basis(x, (-0.5, 0.0, 0.5)).items()])
    return _round(stats.compare_models(rows, "y", {"line": ["x1"], "cubic": ["x1", "x2", "x3"], "spline": ["x1", "x2", "x3", "k0", "k1", "k2"]}))


_TAUS = (0.1, 0.25, 0.5, 0.75, 0.9)


@query("M9_quantile_curves", sql("occ", body=" union all ".join(f"select floor(lat / 15)::bigint as band, {t}::double as tau, round(quantile_cont(bio2, {t}), 4) as value from occ group by 1" for t in _TAUS)))
def m9(s, d):
    return stats.quantile_curves(b.occ(s, d), "lat", "bio2", 15, _TAUS).select("band", "tau", F.round("value", 4).alias("value"))


@query("M10_quantile_fit_summary", sql("occ", body=f"select tau, round(count_if(abs(bio3) < 0.01) / count(*), 8) as near_zero, round(1 - sum(abs(bio3 - value)) / sum(abs(bio3 - m)), 6) as fit from (select *, floor(lat / 15)::bigint as band, median(bio3) over () as m from occ) join ({' union all '.join(f'select floor(lat / 15)::bigint as band, {t}::double as tau, quantile_cont(bio3, {t}) as value from occ group by 1' for t in _TAUS)}) using (band) group by tau"))
def m10(s, d):
    rows = b.occ(s, d)
    out = stats.quantile_summary(rows, stats.quantile_curves(rows, "lat", "bio3", 15, _TAUS), "lat", "bio3", 15)
    return out.select("tau", F.round("near_zero", 8).alias("near_zero"), F.round("fit", 6).alias("fit"))


@query("M11_prediction_grid", sql("occ", body="select i::int as i, round(x, 6) as x, round(0.5 + 0.1 * x + 0.01 * x * x, 4) as fit, round(0.5 + 0.1 * x + 0.01 * x * x - 1.96 * 0.2, 4) as low, round(0.5 + 0.1 * x + 0.01 * x * x + 1.96 * 0.2, 4) as high from (select i, lo + (hi - lo) * i / 99 as x from (select min(lat) lo, max(lat) hi from occ), range(0, 100) r(i))"))
def m11(s, d):
    out = stats.prediction_grid(b.occ(s, d), "lat", 100, (0.5, 0.1, 0.01), 0.2)
    return out.select("i", F.round("x", 6).alias("x"), *[F.round(c, 4).alias(c) for c in ("fit", "low", "high")])
