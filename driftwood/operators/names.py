"""Lookalike names: edit-distance, separator and affix joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.functions.scalars import squash

# Affixes that imitate a popular name.
PREFIXES = ["python-", "py-", "py"]
SUFFIXES = ["-python", "-py", "-dev", "-lib", "-sdk", "-api", "2", "3"]


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    row = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        now, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            now.append(min(row[-1][j] + (x != y), now[j] + 1, row[-1][j + 1] + 1, row[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        row.append(now)
        last[x] = i
    return row[-1][-1]


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau(x, y) for x, y in zip(a, b, strict=True)])


def most_edits(target: Column) -> Column:
    return F.when(F.length(target) <= 3, 0).when(F.length(target) <= 8, 1).otherwise(2)


def deletions(name: Column, most: int) -> Column:
    """name and all strings with up to most characters taken out."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    out = F.array(name)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def edit_pairs(names: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, target, rank, distance) with 0 < distance <= most_edits(target); names(name), targets(target, rank).

    Candidates share a string after deletions, so no name meets every target; the distance is then computed.
    """
    targets = targets.withColumn("most", most_edits(F.col("target"))).filter("most > 0")
    longest = targets.agg(F.coalesce(F.max(F.length("target")), F.lit(0)).alias("longest"))
    names = names.join(F.broadcast(longest), F.expr("length(name) <= longest + 2")).select("name")  # of one row; longer names are near no target
    variants = F.when(F.col("most") == 1, deletions(F.col("target"), 1)).otherwise(deletions(F.col("target"), 2))
    t = targets.select("target", "rank", "most", F.explode(variants).alias("v"))
    # a name meets targets of up to two edits; one shorter than 7 only those of one
    n = names.select("name", F.explode(F.when(F.length("name") < 7, deletions(F.col("name"), 1)).otherwise(deletions(F.col("name"), 2))).alias("v"))
    pairs = n.join(t, "v").filter("name <> target and abs(length(name) - length(target)) <= most").select("name", "target", "rank", "most").distinct()
    return pairs.withColumn("distance", F.pandas_udf(_distances, "int")("name", "target")).filter("distance between 1 and most").select("name", "target", "rank", "distance")


def separator_pairs(names: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, target): equal but for separators."""
    return names.withColumn("k", squash(F.col("name"))).join(targets.withColumn("k", squash(F.col("target"))), "k").filter("name <> target").select("name", "target")


def affix_pairs(names: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, target): a name is a target behind one of the prefixes or before one of the suffixes."""
    cut = [F.when(F.startswith("name", F.lit(p)), F.substring(F.col("name"), F.lit(len(p) + 1), F.length("name"))) for p in PREFIXES]
    cut += [F.when(F.endswith("name", F.lit(s)), F.substring(F.col("name"), F.lit(1), F.length("name") - len(s))) for s in SUFFIXES]
    bare = names.select("name", F.explode(F.array_distinct(F.array_compact(F.array(*cut)))).alias("target"))
    return bare.join(targets.select("target"), "target").select("name", "target").distinct()
