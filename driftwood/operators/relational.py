"""Projections, joins, deduplication, sampling and set operators used by the plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.functions.scalars import u01
from driftwood.operators.graph import number


def feature_columns(df: DataFrame, excluded: set[str]) -> list[str]:
    """The numeric columns that are not excluded, in order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in excluded]


def drop_features(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such feature columns: {missing}")
    return df.drop(*columns)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in a stated total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Left join with one row of the right side for each key."""
    return left.join(keep_first(right, keys, order), keys, "left")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def repair_failed(df: DataFrame, failed: Column, columns: list[str], defaults: dict[str, float] | None = None) -> DataFrame:
    """Columns of a failed scan count as missing; then defaults, else 0, fill what is missing."""
    gone = {c: F.when(failed, None).otherwise(F.col(c)) for c in columns}
    return df.withColumns(gone).na.fill(defaults or {}).na.fill(0, columns)


def capped_groups(df: DataFrame, group: str, key: str, cap: int, salt: str) -> DataFrame:
    """At most cap rows of each group, in order of their hash, with weight 1 / rows kept."""
    u = u01(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")))
    ranked = df.withColumn("u", u).withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("u", key)))
    return ranked.filter(F.col("n") <= cap).withColumn("family_weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(group))).drop("n")


#: Rows of a sample from which on no limit, whose rows would meet in one task, takes them.
LARGE = 50_000


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """df with u, the salted hash of its key, and place, its number from 0 on in the order of u and key, counted over range partitions."""
    drawn = df.withColumn("u", u01(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return number(drawn.withColumn("_at", F.struct("u", key)), "_at", "place").drop("_at")


def sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows without replacement: those of least salted hash."""
    if n >= LARGE:
        return shuffled(df, key, seed).filter(F.col("place") < n).drop("place")
    return df.withColumn("u", u01(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("u", key).limit(n)


def quotas(counts: DataFrame, name: str, n: str, total: int) -> DataFrame:
    """counts with quota: total shared in proportion to n, the remainder to the largest fractions.  One row for each year or so."""
    everything = counts.agg(F.sum(n).alias("_all"))
    exact = F.lit(total) * F.col(n) / F.col("_all")
    base = counts.crossJoin(everything).withColumns({"_floor": F.floor(exact), "_frac": exact - F.floor(exact)}).drop("_all")
    left = base.agg((F.lit(total) - F.sum("_floor")).alias("_left"))
    ranked = base.crossJoin(left).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_frac"), name)))
    return ranked.withColumn("quota", (F.col("_floor") + (F.col("_r") <= F.col("_left")).cast("int")).cast("bigint")).drop("_floor", "_frac", "_left", "_r")


def cube_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.cube(a, b).agg(F.count("*").alias("n"))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*ids, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(ids, columns, name, value)


def variability(long: DataFrame) -> DataFrame:
    """(feature, mode, variability): the most common value (rounded to 6 digits; of equals the least) and the share of other rows."""
    counts = long.groupBy("feature", F.round("value", 6).alias("v")).agg(F.count("*").alias("n"))
    best = counts.groupBy("feature").agg(F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("top"), F.sum("n").alias("all"))
    return best.select("feature", (-F.col("top.m")).alias("mode"), (1 - F.col("top.n") / F.col("all")).alias("variability"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an earlier run has not written yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
