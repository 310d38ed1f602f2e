"""Hypothesis tests and survival: aggregate on Spark, finish on one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import as_double, join_small, q
from framewise.functions.distributions import chi2_pvalue, t_pvalue
from framewise.plans.ordered import running_sums
from framewise.session import cut_lineage


def groups(df: DataFrame, col: str) -> DataFrame:
    """distinct non-null values of a grouping column."""
    return df.select(q(col).alias(col)).where(F.col(col).isNotNull()).distinct()


def welch_stats(df: DataFrame, value: str, group: str, g1, g2) -> DataFrame:
    """F2 statistics: n, mean, sample variance per group, Welch t and
    Welch-Satterthwaite degrees of freedom, in one aggregate."""
    x = as_double(df, value)
    sel = df.where(q(group).isin(g1, g2)).select(q(group).alias("_g"), x.alias("_x")).where(F.col("_x").isNotNull())
    a = sel.agg(*[f for g, tag in ((g1, "1"), (g2, "2")) for f in (
        F.count(F.when(F.col("_g") == F.lit(g), F.col("_x"))).alias(f"n{tag}"),
        F.avg(F.when(F.col("_g") == F.lit(g), F.col("_x"))).alias(f"mean{tag}"),
        F.var_samp(F.when(F.col("_g") == F.lit(g), F.col("_x"))).alias(f"var{tag}"))])
    se1 = F.col("var1") / F.col("n1")
    se2 = F.col("var2") / F.col("n2")
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    t = F.when(ok, F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(se1 + se2)))
    dof = F.when(ok, F.try_divide((se1 + se2) * (se1 + se2),
                                  se1 * se1 / (F.col("n1") - 1) + se2 * se2 / (F.col("n2") - 1)))
    return a.select(F.lit(str(g1)).alias("group1"), F.lit(str(g2)).alias("group2"),
                    F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                    "mean1", "mean2", "var1", "var2", t.alias("t"), dof.alias("df"))


def welch_ttest(df: DataFrame, value: str, group: str, g1, g2, alpha: float = 0.05) -> DataFrame:
    """Welch two-sample t-test, two-sided; refused (nulls) unless both
    groups have more than one value."""
    s = welch_stats(df, value, group, g1, g2)
    s = s.withColumn("p_value", t_pvalue(F.col("t"), F.col("df")))
    return s.withColumn("reject", F.col("p_value") < F.lit(alpha))


def ab_summary(df: DataFrame, variant: str, converted: str, control) -> DataFrame:
    """E1 statistics: per-arm size and conversions, rates, lift over control and
    the 2x2 chi-squared statistic (no continuity correction)."""
    conv = F.col(converted).cast("double")
    arms = df.groupBy(q(variant).alias("variant")).agg(F.count(F.lit(1)).alias("n"),
                                                        F.sum(conv).alias("conversions"))
    arms = arms.where(F.col("variant").isNotNull())
    # the control arm's totals are one small row: they travel as literals
    c = arms.where(F.col("variant") == F.lit(control)).first()
    t = arms.withColumns({"n_c": F.lit(c["n"] if c else None).cast("long"),
                          "x_c": F.lit(c["conversions"] if c else None).cast("double")})
    n, x, nc, xc = (F.col("n").cast("double"), F.col("conversions"), F.col("n_c").cast("double"), F.col("x_c"))
    rate = F.try_divide(x, n)
    rate_c = F.try_divide(xc, nc)
    tot_n, tot_x = n + nc, x + xc
    p = F.try_divide(tot_x, tot_n)
    # chi-squared over the 2x2 table arm vs control
    e11, e12, e21, e22 = n * p, n * (1 - p), nc * p, nc * (1 - p)
    chi2 = (F.try_divide((x - e11) * (x - e11), e11) + F.try_divide(((n - x) - e12) * ((n - x) - e12), e12)
            + F.try_divide((xc - e21) * (xc - e21), e21) + F.try_divide(((nc - xc) - e22) * ((nc - xc) - e22), e22))
    is_c = F.col("variant") == F.lit(control)
    return t.select("variant", F.col("n").cast("long").alias("n"), F.col("conversions").cast("long").alias("conversions"),
                    rate.alias("rate"),
                    F.when(~is_c, F.try_divide(rate - rate_c, rate_c)).alias("lift"),
                    F.when(~is_c, chi2).alias("chi2"))


def ab_test(df: DataFrame, variant: str, converted: str, control, alpha: float = 0.05) -> DataFrame:
    """:func:`ab_summary` plus the chi-squared p-value and decision."""
    s = ab_summary(df, variant, converted, control)
    return s.withColumn("p_value", chi2_pvalue(F.col("chi2"))).withColumn(
        "significant", F.col("p_value") < F.lit(alpha))


def kaplan_meier(df: DataFrame, duration: str, event: str, by: str | None = None) -> DataFrame:
    """Product-limit survival table.

    Rows collapse to one per (group, distinct time) with deaths and exits; the
    number at risk is a reverse running sum over the distinct times, and
    S(t) = exp(sum(log(1 - d/n))), exactly 0 once every subject at risk died."""
    by_cols = [by] if by else []
    t = as_double(df, duration)
    ev = F.col(event).cast("int")
    per_t = (df.where(t.isNotNull()).groupBy(*[q(b).alias(b) for b in by_cols], t.alias("time"))
             .agg(F.sum(F.when(ev == 1, 1).otherwise(0)).cast("long").alias("events"),
                  F.count(F.lit(1)).alias("exits")))
    # at risk = exits at or after t = total - exits strictly before t; the
    # running sums use the bucketed order scheme, not a one-task window
    pb = by_cols
    # the per-time table feeds several jobs: materialise it once
    per_t = cut_lineage(per_t)
    totals = per_t.groupBy(*pb).agg(F.sum("exits").alias("_tot"))
    dead_all = F.col("events") == F.col("at_risk")
    per_t = running_sums(per_t, {"exits": "_cum"}, ["time"], pb)
    per_t = (join_small(per_t, totals, pb) if pb else
             per_t.withColumn("_tot", F.lit(totals.first()["_tot"])))
    per_t = per_t.withColumn("at_risk", (F.col("_tot") - F.col("_cum") + F.col("exits")).cast("long"))
    per_t = per_t.withColumn("_dead_all", F.when(dead_all, 1.0).otherwise(0.0)).withColumn(
        "_lf", F.when(dead_all, F.lit(None)).otherwise(F.log1p(-F.col("events") / F.col("at_risk"))))
    per_t = running_sums(per_t, {"_dead_all": "_zero", "_lf": "_ls"}, ["time"], pb)
    surv = F.when(F.col("_zero") > 0, F.lit(0.0)).otherwise(F.exp(F.coalesce(F.col("_ls"), F.lit(0.0))))
    return per_t.select(*by_cols, "time", "at_risk", "events",
                        (F.col("exits") - F.col("events")).alias("censored"), surv.alias("survival")) \
        .orderBy(*by_cols, "time")
