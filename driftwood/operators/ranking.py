"""Ranks, running totals and ranking metrics, without a window that needs all rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.operators.selection import percentiles
from driftwood.sources.scratch import checkpointed

#: Order buckets of a running total.
BUCKETS = 128


def _place(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the ascending bounds are below a value, as a tree of comparisons, which Spark compiles."""
    if not bounds:
        return F.lit(first)
    at = len(bounds) // 2
    return F.when(value > bounds[at], _place(value, bounds[at + 1 :], first + at + 1)).otherwise(_place(value, bounds[:at], first))


def running_totals(df: DataFrame, order: str, sums: dict[str, Column], by: list[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """df with one inclusive running total for each of sums, in ascending order of a numeric column (ties in any order).

    Rows fall into buckets between approximate quantiles; each bucket has its own window, and the totals of
    the buckets before (buckets rows for each group) are added.  df is written once, as quantiles, totals and windows all read it.
    """
    by, df = list(by), checkpointed(df)
    bounds = sorted(set(df.filter(F.col(order).isNotNull()).approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.005)))
    df = df.withColumn("_bucket", _place(F.col(order), bounds)).withColumns({f"_v_{name}": c for name, c in sums.items()})
    totals = df.groupBy(*by, "_bucket").agg(*(F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col("_bucket").alias("_b"), *(F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums))
    here = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_r_{name}": F.sum(f"_v_{name}").over(here) for name in sums})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by), F.col("_bucket") == F.col("_b"))
    out = df.join(totals, same).withColumns({name: F.col(f"_r_{name}") + F.col(f"_o_{name}") for name in sums})
    return out.drop("_bucket", "_b", *(f"_b_{c}" for c in by), *(f"_{k}_{name}" for k in "vro" for name in sums))


def steps(scores: DataFrame, score: str, label: Column, weight: Column | None = None, by: list[str] = ()) -> DataFrame:
    """One row for each distinct score: pos, neg (weights there) and cum_pos, cum_neg (weights up to and with it)."""
    weight = F.lit(1.0) if weight is None else weight
    ties = scores.groupBy(*by, score).agg(F.sum(F.when(label, weight).otherwise(0.0)).alias("pos"), F.sum(F.when(label, 0.0).otherwise(weight)).alias("neg"))
    return running_totals(ties, score, {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, by)


def auc(scores: DataFrame, score: str, label: Column, weight: Column | None = None, by: list[str] = ()) -> DataFrame:
    """Weighted area under the ROC curve, ties counting half; one row, or one for each group."""
    s = steps(scores, score, label, weight, by)
    below = F.col("cum_neg") - F.col("neg") * 0.5
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * below), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("w_pos"), F.sum("neg").alias("w_neg"))


def partial_auc(scores: DataFrame, score: str, label: Column, max_fpr: float, by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve up to max_fpr, interpolated at the cut and standardised to 0.5 .. 1 (McClish)."""
    s = steps(scores, score, label, None, by)
    totals = s.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = s.join(F.broadcast(totals), list(by)) if by else s.crossJoin(totals)  # totals: one row for each group
    # from a score's step (threshold above it) to the next (threshold at it)
    fpr0, tpr0 = (F.col("n") - F.col("cum_neg")) / F.col("n"), (F.col("p") - F.col("cum_pos")) / F.col("p")
    fpr1, tpr1 = fpr0 + F.col("neg") / F.col("n"), tpr0 + F.col("pos") / F.col("p")
    cut = F.least(fpr1, F.lit(max_fpr))
    slope = F.when(fpr1 > fpr0, (tpr1 - tpr0) / (fpr1 - fpr0)).otherwise(0.0)
    area = F.when(fpr0 < max_fpr, (cut - fpr0) * (tpr0 + slope * (cut - fpr0) / 2)).otherwise(0.0)
    least, most = max_fpr * max_fpr / 2, max_fpr
    return s.groupBy(*by).agg((0.5 * (1 + (F.sum(area) - least) / (most - least))).alias("pauc"))


def thresholds(scores: DataFrame, score: str, label: Column, alphas: list[float], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """(by, alpha, threshold): the exact linear quantile 1 - alpha of the negatives' scores; with weight, a row stands for so many equal ones."""
    neg = percentiles(scores.filter(~label), score, [1 - a for a in alphas], by, weight)
    return neg.select(*by, F.posexplode("q").alias("k", "threshold")).withColumn("alpha", F.element_at(F.array(*map(F.lit, alphas)), F.col("k") + 1)).drop("k")


def caught(scores: DataFrame, limits: DataFrame, score: str, label: Column, weight: Column | None = None, by: list[str] = ()) -> DataFrame:
    """(by, alpha, tpr, tpr_w, fpr): shares of positives and negatives above each threshold (strictly)."""
    weight = F.lit(1.0) if weight is None else weight
    limits = F.broadcast(limits)  # one row for each group and alpha
    joined = scores.join(limits, list(by)) if by else scores.crossJoin(limits)
    above = F.col(score) > F.col("threshold")
    return joined.groupBy(*by, "alpha").agg(
        F.avg(F.when(label, above.cast("double"))).alias("tpr"),
        F.try_divide(F.sum(F.when(label & above, weight).otherwise(0.0)), F.sum(F.when(label, weight).otherwise(0.0))).alias("tpr_w"),
        F.avg(F.when(~label, above.cast("double"))).alias("fpr"),
    )


def midrank(df: DataFrame, score: str, by: list[str] = (), name: str = "pct") -> DataFrame:
    """df with the average-tie percentile rank of score, in (0, 1]."""
    ties = df.groupBy(*by, score).agg(F.count("*").alias("_n"))
    cum = running_totals(ties, score, {"_upto": F.col("_n")}, by)
    total = df.groupBy(*by).agg(F.count("*").alias("_all"))
    cum = cum.join(F.broadcast(total), list(by)) if by else cum.crossJoin(total)  # total: one row for each group
    rank = cum.select(*by, score, ((F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_all")).alias(name))
    return df.join(rank, [*by, score])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's correlation: Pearson's of the average-tie ranks."""
    ranked = midrank(midrank(df.select(a, b), a, name="_ra"), b, name="_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"))


def holm(tests: DataFrame, p: str, by: list[str]) -> DataFrame:
    """tests with p_holm: the step-down running maximum of (m - rank) p within each family, at most 1."""
    w = Window.partitionBy(*by).orderBy(p)
    family = Window.partitionBy(*by)
    step = (F.count("*").over(family) - F.row_number().over(w) + 1) * F.col(p)
    return tests.withColumn("_step", step).withColumn("p_holm", F.least(F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_step")


def tail_score(reference: DataFrame, query: DataFrame, score: str) -> DataFrame:
    """query with calibrated: -ln of the share of reference scores at least as high (plus one), and 1e-3 of the clipped z score."""
    both = reference.select(F.col(score).alias("_s"), F.lit(1).alias("_ref")).groupBy("_s").agg(F.sum("_ref").alias("_ref")).unionByName(query.groupBy(F.col(score).alias("_s")).agg(F.lit(0).cast("long").alias("_ref")))
    both = both.groupBy("_s").agg(F.sum("_ref").alias("_ref"))
    ranked = running_totals(both, "_s", {"_upto": F.col("_ref")})
    stats = reference.agg(F.count("*").alias("_n")).crossJoin(percentiles(reference, score, [0.5, 0.99]).select(F.get("q", F.lit(0)).alias("_mid"), F.get("q", F.lit(1)).alias("_high")))
    ranked = ranked.crossJoin(stats)  # of one row
    p = (1 + F.col("_n") - F.col("_upto") + F.col("_ref")) / (1 + F.col("_n"))
    z = (F.col("_s") - F.col("_mid")) / F.greatest(F.col("_high") - F.col("_mid"), F.lit(1e-12))
    return query.join(ranked.select(F.col("_s").alias(score), (-F.log(p) + 1e-3 * F.least(F.greatest(z, F.lit(-1e3)), F.lit(1e3))).alias("calibrated")), score)
