"""Exact quantiles by counted range refinement: no task holds the values of a group, nor even its distinct ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.sources.scratch import checkpointed

#: Parts of a bracket; brackets that are sent to every task at most, else they are joined by a shuffle.
PARTS, SENT = 4096, 20_000


def ranked(df: DataFrame, value: str, ranks: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """ranks(by, k, rank) with x, the value of that rank (0-based) in its group of df; values are numbers, none of them null.
    A row stands for as many equal ones as its weight, a whole number above 0, says; without weight, for one.

    A rank begins in the bracket from the least to the greatest value of its group.  A pass counts the values of all open brackets in
    PARTS equal parts of each, where partial sums leave little to shuffle, and a rank goes on in the part that it lies in, from
    the least to the greatest value there, until these are one.  Brackets are one or two numbers for each rank; every pass shrinks
    them by PARTS at least, so few passes are needed.
    """
    by, spark = list(by), df.sparkSession
    rows = df.select(*by, F.col(value).cast("double").alias("_v"), *([F.col(weight).alias("_w")] if weight else [])).filter("_v is not null")
    size = F.sum("_w") if weight else F.count("*")
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    ends = rows.groupBy(*by).agg(F.min("_v").alias("low"), F.max("_v").alias("high")).withColumnsRenamed({c: f"_b_{c}" for c in by})
    open_ = ranks.join(ends, same) if by else ranks.crossJoin(F.broadcast(ends))  # one row
    open_ = checkpointed(open_.select(*by, "k", "rank", "low", "high", F.lit(0).cast("bigint").alias("base")))
    done = []
    while True:
        done.append(open_.filter("low = high").select(*by, "k", "rank", F.col("low").alias("x")))
        open_ = open_.filter("low < high")
        n = open_.count()
        if not n:
            break
        brackets = open_.select(*(F.col(c).alias(f"_b_{c}") for c in by), "low", "high").distinct()
        inside = [*same, F.col("_v").between(F.col("low"), F.col("high"))]
        met = rows.join(F.broadcast(brackets) if n <= SENT else brackets, inside)
        # a monotone function of the value, whatever it is rounded to
        part = F.least(F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * PARTS), F.lit(PARTS - 1))
        counts = met.groupBy(*by, "low", "high", part.alias("part")).agg(size.alias("n"), F.min("_v").alias("from"), F.max("_v").alias("to"))
        own = Window.partitionBy(*by, "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # PARTS rows
        counts = counts.withColumn("upto", F.sum("n").over(own)).withColumnsRenamed({**{c: f"_b_{c}" for c in by}, "low": "low_", "high": "high_"})
        here = [*same, F.col("low") == F.col("low_"), F.col("high") == F.col("high_"), F.col("rank") >= F.col("base") + F.col("upto") - F.col("n"), F.col("rank") < F.col("base") + F.col("upto")]
        open_ = checkpointed(open_.join(counts, here).select(*by, "k", "rank", F.col("from").alias("low"), F.col("to").alias("high"), (F.col("base") + F.col("upto") - F.col("n")).alias("base")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def percentiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """(by, q): the exact quantiles of each group, linear between neighbours; nulls don't count, a group of nulls has none.

    Without by there is always a row, whose q is null without values.  With weight, a whole number, a row stands for so many equal ones.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v"), *([F.col(weight).cast("long").alias("_w")] if weight else [])).filter("_v is not null")
    rows = checkpointed(rows.filter("_w > 0") if weight else rows)
    size = F.coalesce(F.sum("_w"), F.lit(0)) if weight else F.count("*")
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(probabilities)))).alias("s")
    sizes = rows.groupBy(*by).agg(size.alias("n")).filter("n > 0").select(*by, "n", at).select(*by, "s.k", (F.col("s.p") * (F.col("n") - 1)).alias("at"))
    ends = sizes.select(*by, "k", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    places = checkpointed(ends)
    x = ranked(rows, "_v", places.select(*by, "k", "rank"), by, "_w" if weight else None).withColumnsRenamed({**{c: f"_x_{c}" for c in by}, "k": "_x_k", "rank": "_x_rank"})
    met = places.join(x, [*(F.col(c).eqNullSafe(F.col(f"_x_{c}")) for c in by), F.col("k") == F.col("_x_k"), F.col("rank") == F.col("_x_rank")])
    low, high = F.min(F.struct("rank", "x"))["x"], F.max(F.struct("rank", "x"))["x"]
    place = F.first("at")
    between = F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)
    each = met.groupBy(*by, "k").agg(between.alias("q"))
    lists = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("q"))
    return lists if by else lists.select(F.when(F.size("q") > 0, F.col("q")).alias("q"))
