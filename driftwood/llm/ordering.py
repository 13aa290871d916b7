"""Places and running totals in an order, for groups of any size: DataFrame functions only.

Rows are dealt over range partitions of (group, order), so a hot group lies in many; each partition numbers its own rows, and
the partitions' totals, a row for each partition and group, are added in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import fresh, materialize


def numbered(df: DataFrame, group: list[str], order: list[Column], amount: str | None = None, merge: bool = False) -> DataFrame:
    """df with place (0-based, in its group) and rows (of its group); with an amount also before and total, its sums.

    Groups may be null, which is a group like others.  Rows that agree in group and order are numbered in any order, but each
    once, as they are written before they are counted.  merge: no side of a join is broadcast, however small.
    """
    part, slot, first, p = fresh(df, "part", "slot", "first", "p")
    keys = [F.col(c).asc_nulls_first() for c in group]
    dealt = df.repartitionByRange(*keys, *order) if group or order else df
    t = materialize(dealt.sortWithinPartitions(*keys, *order).withColumn(slot, F.monotonically_increasing_id())).withColumn(part, F.shiftright(slot, 33))
    sums = [F.min(slot).alias(first), F.count("*").alias("n")] + ([F.sum(amount).alias("a")] if amount else [])
    per = t.groupBy(part, *group).agg(*sums)
    whole = Window.partitionBy(*[F.col(c) for c in group] or [F.lit(0)])
    upto = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = {"rows": F.sum("n").over(whole), "ahead": F.sum("n").over(upto) - F.col("n")}
    if amount:
        over |= {"total": F.sum("a").over(whole), "a_ahead": F.sum("a").over(upto) - F.col("a")}
        mine = Window.partitionBy(part, *group).orderBy(slot).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        t = t.withColumn("own", F.sum(amount).over(mine) - F.col(amount))
    per = per.withColumns(over).drop("n", "a").withColumnsRenamed({c: f"{p}_{c}" for c in (part, *group)})
    on = F.col(part) == F.col(f"{p}_{part}")
    for c in group:
        on &= F.col(c).eqNullSafe(F.col(f"{p}_{c}"))
    out = t.join(per.hint("merge") if merge else per, on).withColumn("place", F.col(slot) - F.col(first) + F.col("ahead"))
    if amount:
        out = out.withColumn("before", F.col("own") + F.col("a_ahead"))
    return out.select(*df.columns, "place", "rows", *(["before", "total"] if amount else []))
