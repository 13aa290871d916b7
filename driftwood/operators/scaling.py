"""Scaling of numeric columns with statistics of chosen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.operators.relational import unpivot
from driftwood.operators.selection import percentiles


def _applied(df: DataFrame, stats: DataFrame, columns: list[str], scaled) -> DataFrame:
    """df with each column x replaced by scaled(x, statistics of the column); stats has one row."""
    return df.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns), *(scaled(F.col(c), c).alias(c) for c in columns))


def log_standard(df: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """log1p (of values clipped at 0) and standardise columns that are not all 0 or 1 on the fit rows (population deviation, 0 counts as 1)."""
    fitted = df.filter(fit)
    logs = lambda x: F.log1p(F.greatest(x, F.lit(0.0)))
    stats = fitted.agg(*(e for c in columns for e in (F.avg(logs(F.col(c))).alias(f"_m_{c}"), F.stddev_pop(logs(F.col(c))).alias(f"_s_{c}"), F.bool_and(F.col(c).isin(0, 1)).alias(f"_b_{c}"))))
    return _applied(df, stats, columns, lambda x, c: F.when(F.col(f"_b_{c}"), x).otherwise((logs(x) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))))


def robust(df: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """(x - median) / (IQR / 1.349) of the fit rows; an IQR of 0 counts as 1.349."""
    values = df.filter(fit).select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select("s.*")
    each = percentiles(values, "v", [0.25, 0.5, 0.75], ["c"])  # a row for each column
    stats = each.agg(*(F.max(F.when(F.col("c") == c, F.col("q"))).alias(f"_q_{c}") for c in columns))

    def scaled(x: Column, c: str) -> Column:
        spread = (F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]) / 1.349
        return (x - F.col(f"_q_{c}")[1]) / F.when(spread == 0, 1.0).otherwise(spread)

    return _applied(df, stats, columns, scaled)


def binary_raw(df: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """Standardise (population deviation) all columns but those of only 0 and 1 in any row."""
    binary = df.agg(*(F.bool_and(F.col(c).isin(0, 1)).alias(f"_b_{c}") for c in columns))
    stats = df.filter(fit).agg(*(e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")))).crossJoin(binary)
    return _applied(df, stats, columns, lambda x, c: F.when(F.col(f"_b_{c}"), x.cast("double")).otherwise((x - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))))


def rescale_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Each position standardised with its mean and sample deviation; positions of a deviation below 1e-8 stay."""
    stats = df.select(F.posexplode(vector).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))  # one row for each position
    stats = stats.agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("_stats"))
    scaled = F.zip_with(vector, "_stats", lambda x, s: F.when(s["s"] < 1e-8, x.cast("double")).otherwise((x - s["m"]) / s["s"]))
    return df.crossJoin(F.broadcast(stats)).withColumn(vector, scaled).drop("_stats")


__all__ = ["binary_raw", "log_standard", "rescale_vectors", "robust", "unpivot"]
