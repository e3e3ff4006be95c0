"""Tests and models on tables: group sums in Spark, tail probabilities on the few result rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaloom.functions.names import logit
from taxaloom.operators.quantiles import group_medians, group_quantiles
from taxaloom.operators.rows import running_total, uniform
from taxaloom.package import ship
from taxaloom.shared import shared_folder, stored

Columns = Sequence[str]

#: About so many rows of a permutation are ordered by one task.
PART_ROWS = 100_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(b)) if pd.notna(a) and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def correlations(df: DataFrame, columns: Columns) -> DataFrame:
    """Pearson's r of each pair with t and a two-sided p, all pairs in one pass."""
    ship(df.sparkSession)
    pairs = list(combinations(columns, 2))
    stats = df.agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    one = stats.select("n", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*", "n")
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return one.withColumn("t", t).withColumn("p", t_p_value("t", F.col("n") - 2))


def principal_components(df: DataFrame, columns: Columns, k: int) -> DataFrame:
    """Variables by the sum of their absolute loadings on k components of the scaled data, with the variance explained."""
    spark = df.sparkSession
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(df.dropna(subset=list(columns))).select("_raw")
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(scaled)
    loadings, explained = model.pc.toArray(), model.explainedVariance.toArray()
    rows = [(c, float(abs(loadings[i]).sum()), [float(abs(v)) for v in loadings[i]], float(explained.sum())) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "variable string, importance double, loadings array<double>, explained double").orderBy(F.desc("importance"))


def chi_square(study: DataFrame, baseline: DataFrame, region: str, group: str, size: int) -> DataFrame:
    """Composition of each region against the baseline, on counts scaled to ``size``: X2, df and effect size."""
    both = _expected(study, baseline, region, group, size)
    x2 = F.sum(F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected"))
    out = both.groupBy(region).agg(x2.alias("chi_square"), (F.count("*") - 1).alias("df"), F.sum("observed").alias("n"))
    effect = F.sqrt(F.col("chi_square") / (F.col("n") * F.col("df")))
    label = F.when(effect < 0.1, "negligible").when(effect < 0.3, "small").when(effect < 0.5, "medium").otherwise("large")
    return out.withColumns({"effect_size": effect, "interpretation": label})


def _expected(study: DataFrame, baseline: DataFrame, region: str, group: str, size: int) -> DataFrame:
    """observed and expected counts of every baseline group in every region (groups the baseline lacks don't count)."""
    own = study.groupBy(region, group).agg(F.count("*").alias("_n"))
    total = own.groupBy(region).agg(F.sum("_n").alias("_t"))
    share = baseline.groupBy(group).agg(F.count("*").alias("_b"))
    every = baseline.agg(F.count("*").alias("_all"))
    frame = total.crossJoin(share).crossJoin(F.broadcast(every)).join(own, [region, group], "left")
    observed = F.round(F.coalesce(F.col("_n"), F.lit(0)) / F.col("_t") * size)
    return frame.select(region, group, observed.alias("observed"), (F.col("_b") / F.col("_all") * size).alias("expected"))


def simulated_p(study: DataFrame, baseline: DataFrame, region: str, group: str, size: int, draws: int, seed: int) -> DataFrame:
    """p by simulation: ``draws`` samples of ``size`` from the baseline's shares, each binned on the cumulative share."""
    both = _expected(study, baseline, region, group, size)
    shares = both.select(group, "expected").distinct()
    upper = F.sum("expected").over(Window.orderBy(group)) / F.lit(float(size))
    bins = shares.select(group, "expected", upper.alias("upper"), (upper - F.col("expected") / size).alias("lower"))
    spark = study.sparkSession
    picks = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(size))).alias("i"))
    picks = picks.withColumn("u", uniform(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("i").cast("string"))))
    hit = picks.join(F.broadcast(bins), (F.col("u") >= F.col("lower")) & (F.col("u") < F.col("upper")))
    counts = hit.groupBy("draw", group, "expected").agg(F.count("*").alias("k"))
    # Groups without a draw add their expectation: sum over all of e, less the e of those drawn.
    simulated = counts.groupBy("draw").agg((F.sum(F.pow(F.col("k") - F.col("expected"), 2) / F.col("expected") - F.col("expected")) + size).alias("x2"))
    observed = chi_square(study, baseline, region, group, size).select(region, "chi_square")
    return observed.crossJoin(simulated).groupBy(region, "chi_square").agg(((1 + F.count_if(F.col("x2") >= F.col("chi_square") - 1e-9)) / (draws + 1)).alias("p_value"))


def false_discovery(df: DataFrame, p: str, key: str, alpha: float) -> DataFrame:
    """Benjamini and Hochberg's adjusted p: the least p * m / rank from the largest rank down. For result tables."""
    n = df.agg(F.count("*").alias("_m"))
    ranked = df.crossJoin(F.broadcast(n)).withColumn("_r", F.row_number().over(Window.orderBy(p, key)))
    down = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))
    return ranked.withColumn("p_adjusted", adjusted).withColumn("significant", F.col("p_adjusted") < alpha).drop("_m", "_r")


def rank_sum(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """Wilcoxon's rank-sum test by the normal approximation with tie correction.

    Ranks come from counts of distinct values, so rows with equal values are combined before they are ordered, in parts.
    """
    ship(df.sparkSession)
    counts = df.groupBy(value).agg(F.count("*").alias("t"), F.count_if(in_first).alias("a"))
    ranked = running_total(counts, [value], F.col("t"), "upto").withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("rank") * F.col("a")).alias("w"), F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = s.withColumn("u", F.col("w") - n1 * (n1 + 1) / 2)
    z = (F.col("u") - n1 * n2 / 2) / F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return out.withColumn("z", z).withColumn("p", normal_two_sided("z")).select("n1", "n2", "u", "z", "p")


def permanova(df: DataFrame, columns: Columns, group: str, row_id: str, permutations: int, seed: int) -> DataFrame:
    """Pseudo-F, R2 and p of groups on Euclidean distances, from sums of squares: no distance matrix.

    A permutation deals the group labels in the order of hashed ids. The first bits of the hash split the order of a
    permutation into equal parts of about PART_ROWS rows; a row's rank is its rank in its part and the rows of the
    parts before it, so no task sorts a whole permutation.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    upto = Window.orderBy(group)
    ranges = sizes.select(F.col(group).alias("_g"), F.sum("n").over(upto).alias("_hi"), (F.sum("n").over(upto) - F.col("n")).alias("_lo"))
    parts = max(1, -(-df.count() // PART_ROWS))
    spread = df.select(row_id, group, *columns).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    spread = spread.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col(row_id).cast("string"))))
    spread = spread.withColumn("_part", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * parts / (1 << 32)))
    before = Window.partitionBy("perm").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = spread.groupBy("perm", "_part").agg(F.count("*").alias("_n")).select("perm", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    local = F.row_number().over(Window.partitionBy("perm", "_part").orderBy("_h", row_id))
    ranked = spread.withColumn("_local", local).join(ahead, ["perm", "_part"]).withColumn("_r", F.col("_ahead") + F.col("_local"))
    dealt = ranked.join(F.broadcast(ranges), (F.col("_r") > F.col("_lo")) & (F.col("_r") <= F.col("_hi")))
    label = F.when(F.col("perm") == 0, F.col(group)).otherwise(F.col("_g"))
    sums = dealt.groupBy("perm", label.alias("label")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in columns])
    square = sum((F.pow(F.col(f"s_{c}"), 2) for c in columns[1:]), F.pow(F.col(f"s_{columns[0]}"), 2))
    whole = [F.pow(F.sum(f"s_{c}"), 2) for c in columns]
    total_q = [F.sum(f"q_{c}") for c in columns]
    fit = sums.groupBy("perm").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(square / F.col("n")).alias("between"), sum(whole[1:], whole[0]).alias("whole"), sum(total_q[1:], total_q[0]).alias("q"))
    among = F.col("between") - F.col("whole") / F.col("n")
    total = F.col("q") - F.col("whole") / F.col("n")
    f = (among / (F.col("k") - 1)) / ((total - among) / (F.col("n") - F.col("k")))
    scored = fit.select("perm", f.alias("f"), (among / total).alias("r2"))
    real = scored.where("perm = 0").select(F.col("f").alias("pseudo_f"), "r2")
    return scored.where("perm > 0").select("f").crossJoin(F.broadcast(real)).groupBy("pseudo_f", "r2").agg(((1 + F.count_if(F.col("f") >= F.col("pseudo_f"))) / (permutations + 1)).alias("p"))


def zero_share_by_band(df: DataFrame, predictor: str, response: str, width: float) -> DataFrame:
    """Per band of the predictor: rows, share of zero responses, mean of the rest."""
    band = F.floor(F.col(predictor) / width).alias("band")
    return df.groupBy(band).agg(F.count("*").alias("n"), (F.count_if(F.col(response) == 0) / F.count("*")).alias("zero_share"), F.avg(F.when(F.col(response) > 0, F.col(response))).alias("mean_positive"))


def spline_basis(x: Column, knots: Sequence[float]) -> dict[str, Column]:
    """A cubic with a truncated cube at each knot."""
    return {"x1": x, "x2": x * x, "x3": x * x * x} | {f"k{i}": F.pow(F.greatest(x - k, F.lit(0.0)), 3) for i, k in enumerate(knots)}


def compare_models(df: DataFrame, response: str, nested: dict[str, Sequence[str]], weight: str | None = None) -> DataFrame:
    """Gaussian fits of nested sets of columns: deviance, share of the null deviance explained, AIC and BIC. A row stands for ``weight`` rows."""
    rows = []
    n = df.agg(F.sum(weight)).first()[0] if weight else df.count()
    for name, columns in nested.items():
        x = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df)
        fit = GeneralizedLinearRegression(family="gaussian", featuresCol="_x", labelCol=response)
        s = (fit.setWeightCol(weight) if weight else fit).fit(x).summary
        k = len(columns) + 1
        log_likelihood = -n / 2 * (math.log(2 * math.pi * max(s.deviance, 1e-300) / n) + 1)
        rows.append((name, k, s.deviance, 1 - s.deviance / s.nullDeviance, 2 * (k + 1) - 2 * log_likelihood, (k + 1) * math.log(n) - 2 * log_likelihood))
    return df.sparkSession.createDataFrame(rows, "model string, parameters int, deviance double, explained double, aic double, bic double").orderBy("aic")


def zero_inflated_models(df: DataFrame, response: str, nested: dict[str, Sequence[str]]) -> DataFrame:
    """Both parts of a response with many zeros, for nested sets of columns: a logistic regression of being zero, and a Gaussian
    fit of the logit of the rest. part, model, parameters, log-likelihood, AIC and BIC, the least AIC of a part first.

    Equal rows are one with their number as its weight, stored before the fits: each of their many rounds reads the different rows only.
    """
    rows = []
    columns = list(dict.fromkeys(c for cs in nested.values() for c in cs))
    held = df.groupBy(response, *columns).agg(F.count("*").cast("double").alias("_w"))
    held = stored(held, shared_folder(df.sparkSession, "models"), "held")
    zero = held.withColumn("_zero", (F.col(response) == 0).cast("double"))
    n = zero.agg(F.sum("_w")).first()[0]
    for name, columns in nested.items():
        x = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(zero)
        model = LogisticRegression(featuresCol="_x", labelCol="_zero", weightCol="_w", maxIter=200, tol=1e-10, standardization=True).fit(x)
        z = sum((F.lit(float(b)) * F.col(c) for b, c in zip(model.coefficients, columns, strict=True)), F.lit(float(model.intercept)))
        # log p = -log(1 + exp(-z)), by the side on which exp can't overflow.
        signed = F.when(F.col("_zero") == 1, z).otherwise(-z)
        likelihood = zero.agg(F.sum(F.col("_w") * (F.least(signed, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))))).first()[0]
        k = len(columns) + 1
        rows.append(("zero", name, k, likelihood, 2 * k - 2 * likelihood, k * math.log(n) - 2 * likelihood))
    rest = held.where(F.col(response) > 0).withColumn("_y", logit(F.col(response)))
    m = rest.agg(F.sum("_w")).first()[0]
    for r in compare_models(rest, "_y", nested, "_w").collect():
        k = r.parameters + 1
        rows.append(("positive", r.model, k, k - r.aic / 2, r.aic, k * math.log(m) - 2 * (k - r.aic / 2)))
    rows.sort(key=lambda r: (r[0], r[4]))
    return df.sparkSession.createDataFrame(rows, "part string, model string, parameters int, log_likelihood double, aic double, bic double")


def quantile_curves(df: DataFrame, predictor: str, response: str, width: float, taus: Sequence[float]) -> DataFrame:
    """Exact percentiles of the response by band of the predictor, in long form."""
    placed = df.select(F.floor(F.col(predictor) / width).alias("band"), response)
    wide = group_quantiles(placed, ["band"], [response], taus).select("band", F.col(f"{response}_quantiles").alias("q"))
    return wide.select("band", F.posexplode("q").alias("i", "value")).withColumn("tau", F.element_at(F.array(*map(F.lit, taus)), F.col("i") + 1)).drop("i")


def quantile_summary(df: DataFrame, curves: DataFrame, predictor: str, response: str, width: float) -> DataFrame:
    """Per tau: share of responses near zero and one less residual over deviation from the median."""
    middle = group_medians(df, [], [response]).select(F.col(f"{response}_median").alias("_m"))
    placed = df.withColumn("band", F.floor(F.col(predictor) / width)).join(curves, "band").crossJoin(F.broadcast(middle))
    residual, deviation = F.sum(F.abs(F.col(response) - F.col("value"))), F.sum(F.abs(F.col(response) - F.col("_m")))
    return placed.groupBy("tau").agg((F.count_if(F.abs(response) < 0.01) / F.count("*")).alias("near_zero"), (1 - residual / deviation).alias("fit"))


def prediction_grid(df: DataFrame, predictor: str, points: int, coefficients: Sequence[float], error: float) -> DataFrame:
    """``points`` equal steps over the predictor's range with a polynomial's value and its 95 % band."""
    span = df.agg(F.min(predictor).alias("_lo"), F.max(predictor).alias("_hi"))
    grid = span.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / (points - 1))
    value = sum((F.lit(c) * F.pow("x", k) for k, c in enumerate(coefficients)), F.lit(0.0))
    return grid.select("i", "x", value.alias("fit"), (value - 1.96 * error).alias("low"), (value + 1.96 * error).alias("high"))
