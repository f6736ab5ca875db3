"""Inequality, agreement and multiple-testing statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import ranked_whole, step_up


def gini(df: DataFrame, value: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Gini coefficient of each group by ranks; NULL for an empty group or a zero total. Equal values are counted together,
    so sorting moves one row per distinct value."""
    v = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    r = v.withColumn("upto", F.sum("c").over(w))
    # the ranks of c equal values sum to c * (upto - (c - 1) / 2)
    s = r.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("x") * F.col("c")).alias("total"), F.sum(F.col("x") * F.col("c") * (F.col("upto") - (F.col("c") - 1) / 2)).alias("ranked"))
    g = 2 * F.col("ranked") / F.nullif(F.col("n") * F.col("total"), F.lit(0.0)) - (F.col("n") + 1) / F.nullif(F.col("n"), F.lit(0))
    return s.select(*by, F.when(g.isNotNull(), F.greatest(g, F.lit(0.0))).alias("gini"))


def dynamic_gini(panel: DataFrame, *, value: str = "num_bikes_available", by: tuple[str, ...] = ("fetched_at",)) -> DataFrame:
    return gini(panel, value, by=by)


def theil(df: DataFrame, value: str, *, groups: str | None = None) -> DataFrame:
    """Theil index of positive values: total; with groups also between and within."""
    x = df.where(F.col(value) > 0).select(F.col(value).cast("double").alias("x"), *([F.col(groups).alias("g")] if groups else [F.lit(0).alias("g")]))
    per = x.groupBy("g").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.log("x")).alias("xl"))
    # T = sum(x ln x) / S - ln(S / n)
    tot = per.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("xl").alias("all_xl"))
    rows = per.join(F.broadcast(tot))  # one row
    share, part = F.col("s") / F.col("all_s"), F.col("n") / F.col("all_n")
    own = F.col("xl") / F.col("s") - F.log(F.col("s") / F.col("n"))
    return rows.agg(F.first(F.col("all_xl") / F.col("all_s") - F.log(F.col("all_s") / F.col("all_n"))).alias("theil"), F.sum(share * F.log(share / part)).alias("between"), F.sum(share * own).alias("within"))


def ranked(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a value, their rank `i`, the number `n` of the group and the sum `cum` up to the rank. Without `by` ranges of
    values are ranked in parallel, and what lies before each range is added."""
    rows = df.where(F.col(value).isNotNull())
    if not by:
        return ranked_whole(rows, [value], value).withColumnsRenamed({"__i": "i", "__n": "n", "__cum": "cum", "__sum": "total"})
    w = Window.partitionBy(*by).orderBy(value)
    return rows.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*by))}).withColumns({"cum": F.sum(value).over(Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(value).over(Window.partitionBy(*by))})


def palma(df: DataFrame, value: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of the top tenth over the sum of the bottom four tenths; NULL where the latter is not positive."""
    r = ranked(df, value, by)
    top, low = F.sum(F.when(F.col("i") > F.ceil(F.col("n") * 9 / 10), F.col(value))), F.sum(F.when(F.col("i") <= F.floor(F.col("n") * 4 / 10), F.col(value)))
    return r.groupBy(*by).agg((top / F.when(low > 0, low)).alias("palma"))


def lorenz(df: DataFrame, value: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative shares of population and value, from the origin on."""
    r = ranked(df, value, by)
    rows = r.select(*by, (F.col("i") / F.col("n")).alias("population"), (F.col("cum") / F.nullif(F.col("total"), F.lit(0))).alias("share"))
    return rows.unionByName(r.select(*by).distinct().withColumns({"population": F.lit(0.0), "share": F.lit(0.0)}))


def concentration(info: DataFrame, *, value: str = "capacity", by: tuple[str, ...] = ("system_id",)) -> DataFrame:
    """n, total, share of the top tenth, Gini and Theil (4 digits) of the positive values."""
    pos = info.where(F.col(value) > 0)
    r = ranked(pos, value, by)
    x = F.col(value).cast("double")
    top = r.groupBy(*by).agg(F.count("*").alias("n_positive"), F.sum(value).alias("total"), F.bround(F.sum(F.when(F.col("i") > F.col("n") - F.ceil(F.col("n") / 10), F.col(value))) / F.sum(value), 4).alias("top_decile_share"), F.bround(F.sum(x * F.log(x)) / F.sum(x) - F.log(F.sum(x) / F.count("*")), 4).alias("theil"))
    out = top.join(gini(pos, value, by=by), list(by)) if by else top.join(F.broadcast(gini(pos, value)))  # one row without `by`
    return out.withColumn("gini", F.bround("gini", 4))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance; rows with a NULL are left out."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("c"))
    left, right = cells.groupBy("a").agg(F.sum("c").alias("ca")), cells.groupBy("b").agg(F.sum("c").alias("cb"))
    pe = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).cast("double").alias("pe"))
    po = cells.agg(F.sum("c").cast("double").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))), F.lit(0)).alias("same"))
    n, e = F.col("n"), F.col("pe") / (F.col("n") * F.col("n"))
    return po.join(F.broadcast(pe)).select(F.when(e >= 1, 1.0).otherwise((F.col("same") / n - e) / (1 - e)).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, *, unit: str = "unit", label: str = "label") -> DataFrame:
    """Nominal alpha of long ratings; units with one rating are left out."""
    cells = ratings.where(F.col(label).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(label).alias("v")).agg(F.count("*").cast("double").alias("c"))
    units = cells.groupBy("u").agg(F.sum("c").alias("m")).where("m > 1")
    x = cells.join(units, "u")
    diag = x.agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("d"))
    marg = x.groupBy("v").agg(F.sum("c").alias("nc")).agg(F.sum("nc").alias("n"), F.sum(F.col("nc") * F.col("nc")).alias("q"))
    n = F.col("n")
    bottom = n * n - F.col("q")
    return diag.join(F.broadcast(marg)).select(F.when(bottom == 0, 1.0).otherwise(1 - (n - 1) * (n - F.col("d")) / F.nullif(bottom, F.lit(0.0))).alias("alpha"))


def fdr_adjust(df: DataFrame, p: str, *, method: str = "bh", by: tuple[str, ...] = ()) -> DataFrame:
    """df with `p_adjusted` by the step-up procedure; NULLs stay."""
    if method not in ("bh", "by"):
        raise ValueError(method)
    keep = df.where(F.col(p).isNotNull())
    harmonic = lambda n: F.lit(1.0) if method == "bh" else F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    if by:
        part = Window.partitionBy(*by)
        n = F.count("*").over(part)
        r = keep.withColumn("__q", F.col(p) * n * harmonic(n) / F.row_number().over(part.orderBy(p)))
        out = r.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("__q").over(part.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)))).drop("__q")
    else:
        out = step_up(keep, p, harmonic)
    return out.unionByName(df.where(F.col(p).isNull()).withColumn("p_adjusted", F.lit(None).cast("double")))


def normal_sf(z):
    """Upper tail of the normal distribution (Abramowitz and Stegun 7.1.26, error under 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)
