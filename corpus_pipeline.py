"""From raw documents to packed training sequences: the stages are applied in order, each to all that the one before kept.

Every stage takes any further columns, whatever their names: the operators see them under names of the pipeline's own,
and they come back as they were.  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.common import release, scratch, shared_dir, table
from driftwood.llm.decontaminate import contamination
from driftwood.llm.near_duplicates import near_duplicates
from driftwood.llm.packing import pack
from driftwood.llm.pii import replace_pii
from driftwood.llm.quality import scored

#: Documents with a lower probability of good quality are rejected.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts have the score of a text without words; repeated rows have equal scores, so all of them stay or go;
    a score of exactly LEAST_QUALITY stays, so without any label nothing goes.
    """
    return scored(docs, table(spark, sf_dir, "labels")).filter(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that of the least doc_id.

    Rows of one doc_id with different texts are in the groups of their texts; if several of a group have its least doc_id,
    the one of the least text hash stays.  Of rows that agree in doc_id and text, the one whose other columns come first
    stays.  Null, empty and wordless texts are like nothing but themselves.  Rows without a doc_id all stay.
    """
    found = near_duplicates(docs)
    alone = F.when(F.col("group_id").isNull(), F.col("text_hash"))
    kept = found.filter("kept").groupBy("doc_id", "group_id", alone.alias("alone")).agg(F.min("text_hash").alias("text_hash"))
    times = found.filter("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = kept.join(times, ["doc_id", "text_hash"]).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "n")
    here = (F.col("doc_id") == F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash"))
    rows = docs.join(kept.filter("n = 1"), here, "left_semi").unionByName(docs.filter("doc_id is null"))
    repeated = docs.join(kept.filter("n > 1"), here, "left_semi")
    others = F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("none"))
    first = repeated.groupBy("doc_id", "text").agg(F.min_by(others, F.to_json(others)).alias("others"))
    return rows.unionByName(first.select("doc_id", "text", "others.*").drop("none")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null and empty texts have none and stay; repeated rows stay or go together; an empty benchmark rejects nothing.
    """
    return contamination(docs, table(spark, sf_dir, "benchmark").filter("text is not null")).filter("hit is null").select(*docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced.  Null and empty texts stay as they are; repeated rows stay equal."""
    return replace_pii(docs, spark.conf.get("driftwood.pii.key", "driftwood"), count=None).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.  Null and empty texts are their end mark alone; repeated rows are packed each."""
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


#: Scratch tables of the stage that was called last.
_last: dict[str, list[str]] = {}


def _stage(f):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name in _last.keys() - {f.__name__}:  # another stage's result has been written when this one begins; nothing else goes
            release(spark, _last.pop(name))
        there = set(scratch())
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        own = {c: f"user_column_{k}" for k, c in enumerate(others)}
        out = f(spark, docs.withColumnsRenamed(own), sf_dir)
        _last.setdefault(f.__name__, []).extend(path for path in scratch() if path not in there)
        if f is packing:
            return out
        out = out.withColumnsRenamed({v: c for c, v in own.items()}).select(*docs.columns)
        if f is pii_surrogates and "n_chars" in others:  # follows the new text
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return out

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


STAGES = [(f.__name__, _stage(f)) for f in (quality_classifier, near_duplicate_groups, benchmark_decontamination, pii_surrogates, packing)]

#: No SQL can express the classifier, the connected components or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the output of each is written as Parquet in the shared folder and read again, then its input goes."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, f) in enumerate(STAGES):
        out = f(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
        if k:
            release(spark, [f"{base}/{k - 1}"])
    return docs
