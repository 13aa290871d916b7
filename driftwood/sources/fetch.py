"""Files and metadata by URL, with retries, a size limit and checksums; states are kept, so a run goes on where the last one ended."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that another run doesn't try again.
FINAL = ("ok", "too_large", "checksum_mismatch", "not_found")
SCHEMA = "url string, status string, tries int, bytes long, sha256 string, content binary, error string"


def attempt(url: str, most: int, timeout: float) -> tuple[str, bytes | None, str | None]:
    """(status, content, error) of one try; no more than most bytes, and one, are read."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            size = answer.headers.get("Content-Length")
            content = b"" if size and size.isdigit() and int(size) > most else answer.read(most + 1)
            large = len(content) > most or (size is not None and size.isdigit() and int(size) > most)
            return ("too_large", None, None) if large else ("ok", content, None)
    except urllib.error.HTTPError as e:
        return ("not_found" if e.code in (404, 410) else "failed"), None, f"HTTP {e.code}"
    except urllib.error.URLError as e:
        return ("not_found" if isinstance(e.reason, FileNotFoundError) else "failed"), None, str(e.reason)
    except (OSError, ValueError) as e:  # a broken connection, or no URL at all
        return "failed", None, str(e)


def fetched(requests: DataFrame, most: int = 50_000_000, tries: int = 4, wait: float = 1.0, timeout: float = 60.0) -> DataFrame:
    """(url, status, tries, bytes, sha256, content, error) of each distinct url of requests(url, sha256), whose sha256 may be null.

    A failed try is made again after wait, 2 wait, 4 wait, ... seconds; what isn't there or is too large isn't.  Content is kept where
    it is whole and has the checksum asked for.  A url asked for with several checksums is fetched for each.  Requests are dealt out,
    so tasks wait side by side; one file at a time is in a task's memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url, wanted in zip(batch["url"], batch["sha256"], strict=True):
                status, content, error, n = "failed", None, "no url", 0
                for n in range(1, tries + 1) if url else ():
                    status, content, error = attempt(url, most, timeout)
                    if status != "failed":
                        break
                    if n < tries:
                        time.sleep(wait * 2 ** (n - 1))
                digest = hashlib.sha256(content).hexdigest() if content is not None else None
                if digest and wanted and digest != wanted.lower():
                    status, content = "checksum_mismatch", None
                yield pd.DataFrame({"url": [url], "status": [status], "tries": [n], "bytes": [len(content) if content is not None else None], "sha256": [digest], "content": [content], "error": [error]}).astype({"bytes": "Int64"})

    distinct = requests.select("url", "sha256").distinct()
    return distinct.mapInPandas(run, SCHEMA)


def pending(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests without a final state in states(url, status) so far."""
    return requests.join(states.filter(F.col("status").isin(*FINAL)).select("url"), "url", "left_anti")


def fetch_into(requests: DataFrame, path: str, **options) -> DataFrame:
    """The states of all requests in the table at path, after those that were pending have been fetched and appended; the last state of a url counts."""
    spark = requests.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    todo = pending(requests, spark.read.parquet(path)) if there else requests
    fetched(todo, **options).withColumn("run", F.lit(time.time_ns())).write.mode("append").parquet(path)
    states = spark.read.parquet(path)
    last = states.groupBy("url").agg(F.max("run").alias("run"))
    return states.join(last, ["url", "run"]).drop("run")
