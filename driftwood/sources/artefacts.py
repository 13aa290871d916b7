"""Bundles of tables with their settings, a cache of extracted rows, and checks before a job."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict) -> None:
    """Each table as Parquet under path, the settings and the tables' names as JSON beside them, written last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps({"tables": sorted(tables), "settings": settings})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle.json")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and settings of save_bundle(); fails on a bundle that was not finished."""
    found = json.loads(spark.read.text(f"{path}/bundle.json").first().value)
    return {name: spark.read.parquet(f"{path}/{name}") for name in found["tables"]}, found["settings"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(items: DataFrame, key: str, path: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """extract(items) by way of a Parquet cache: only items whose key the cache lacks are extracted, and appended.

    extract keeps the key and may give several rows for an item; an item without rows is asked again.  Repeated keys
    are extracted once; items without a key are left out.
    """
    spark = items.sparkSession
    items = items.filter(F.col(key).isNotNull()).dropDuplicates([key])
    todo = items.join(spark.read.parquet(path).select(key), key, "left_anti") if _exists(spark, path) else items
    extract(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(items.select(key), key, "left_semi")


def preflight(df: DataFrame, types: dict[str, T.DataType], holds: dict[str, Column]) -> DataFrame:
    """(name, failed): for each column whether it is missing or of another type, for each named condition the rows that break it (or leave it null)."""
    have = {f.name: f.dataType for f in df.schema}
    rows = [(f"column {c}", int(have.get(c) != t)) for c, t in types.items()]
    fixed = df.sparkSession.createDataFrame(rows, "name string, failed long")
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in holds.items())) if holds else None
    return fixed if counts is None else fixed.unionByName(counts.select(F.explode(F.create_map(*(x for n in holds for x in (F.lit(n), F.col(f"`{n}`"))))).alias("name", "failed")))


def required(df: DataFrame, types: dict[str, T.DataType], holds: dict[str, Column]) -> DataFrame:
    """df, or an error that names every check of preflight() that failed."""
    missing = [c for c, t in types.items() if {f.name: f.dataType for f in df.schema}.get(c) != t]
    if missing:
        raise ValueError(f"preflight: columns missing or of another type: {missing}")
    bad = [r["name"] for r in preflight(df, types, holds).filter("failed > 0").collect()]
    if bad:
        raise ValueError(f"preflight: {bad}")
    return df
