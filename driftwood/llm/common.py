"""Session settings, shared scratch tables and small plan helpers of the llm operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts are long, so batches stay small in a Python worker.
ARROW_ROWS = 512

_scratch: list[str] = []


def tune(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches and let AQE split hot join keys."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # a union that reports its children's partitioning can meet a side that AQE has coalesced or split differently
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only where none is set (local runs, tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            found = "file://" + tempfile.mkdtemp(prefix="driftwood-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table of materialize() that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path in _scratch:
        _scratch.remove(path)
        _delete(df.sparkSession, path)


def scratch() -> list[str]:
    """Paths of the tables of materialize() that are still there."""
    return list(_scratch)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables of materialize(); only when every result read from them has been written."""
    for path in paths:
        if path in _scratch:
            _scratch.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unit_hash(c: Column, hex_digits: int = 15) -> Column:
    """The first hex digits of md5 as a non-negative bigint; DuckDB gives the same."""
    return F.conv(F.substring(F.md5(c), 1, hex_digits), 16, 10).cast("bigint")
