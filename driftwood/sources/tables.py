"""Readers of tables, with explicit schemas where a format has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV files as one table: typed, pruned by the columns that a plan uses; "null", "nan" and "None" stay strings, empty is "". """
    df = spark.read.schema(schema).option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(paths)
    return df.na.fill("", [f.name for f in schema if isinstance(f.dataType, T.StringType)])


def popular_names(spark: SparkSession, path: str, top: int) -> DataFrame:
    """(name, rank): best rank of each name over the first top rows of each yearly JSON snapshot."""
    schema = "last_update string, rows array<struct<project: string, download_count: bigint>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("rows").alias("pos", "row"))
    return rows.filter(F.col("pos") < top).groupBy(F.lower(F.regexp_replace("row.project", "[-_.]+", "-")).alias("name")).agg(F.min(F.col("pos") + 1).alias("rank"))


def verified(files: DataFrame, sums: DataFrame, most: int) -> DataFrame:
    """(path, status) of files(path, content) against sums(path, sha256): ok, too_large, checksum_mismatch or download_failed."""
    found = files.select("path", F.length("content").alias("size"), F.sha2("content", 256).alias("digest"))
    status = F.when(F.col("digest").isNull(), "download_failed").when(F.col("size") > most, "too_large").when(F.col("digest") != F.col("sha256"), "checksum_mismatch").otherwise("ok")
    return sums.join(found, "path", "left").select("path", status.alias("status"))


def runs(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The rows of one run of a result table partitioned by run, without columns that are null throughout."""
    df = spark.read.parquet(path).filter(F.col("run") == run)
    filled = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if filled[c]))
