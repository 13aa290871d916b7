"""Work that grows with the input no faster than it must: equal rows are counted once, inputs are read once, pairs are dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import graph, ranking, resampling, selection
from driftwood.plans import composites, detection, text
from driftwood.plans.registry import registered

DATA = "/root/testdata/sf0.001"


def test_weighted_percentiles_are_those_of_repeated_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v), int(n)) for g in "ab" for v, n in zip(rng.normal(size=60).round(1), rng.integers(0, 9, 60), strict=True)] + [("a", None, 3), ("none", None, 2), ("zero", 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(3)
    repeated = df.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    got, want = ({r.g: r.q for r in selection.percentiles(x, "v", [0.0, 0.25, 0.5, 0.95, 1.0], ["g"], w).collect()} for x, w in ((df, "n"), (repeated, None)))
    assert got == want and set(got) == {"a", "b"}
    assert [r.q for r in selection.percentiles(df.filter("n = 0"), "v", [0.5], weight="n").collect()] == [None]


@pytest.mark.parametrize("name", ["learning_curve", "metric_population_suite"])
def test_equal_rows_meet_the_runs_and_groups_once(spark, monkeypatch, tmp_path, name):
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    few = f"{tmp_path}/few"
    many = f"{tmp_path}/many"
    li.write.parquet(f"{few}/lineitem.parquet")
    li.union(li).union(li).write.parquet(f"{many}/lineitem.parquet")
    seen = []
    monkeypatch.setattr(composites, "percentiles", lambda df, *a, **k: (seen.append(df.count()), selection.percentiles(df, *a, **k))[1])
    query = registered()[name][0]
    assert query(spark, few).count() == query(spark, many).count() > 0
    half = len(seen) // 2
    assert seen[:half] == seen[half:]


def test_running_totals_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return float(v)

    df = spark.range(500).select(F.udf(seen, "double")("id").alias("v"))
    got = ranking.running_totals(df, "v", {"cum": F.lit(1)}, buckets=8).collect()
    assert all(r.cum == r.v + 1 for r in got) and len(got) == read.value == 500


def test_sums_of_resamples_are_those_of_their_units(spark, monkeypatch):
    monkeypatch.setattr(resampling, "DRAWS", 50)
    units = spark.createDataFrame([(7 * i % 101, i, i * i) for i in range(101)], "unit long, x long, y long").repartition(3)
    times = resampling.multiplicities(units.select("unit"), "unit", "s", 6)
    want = {r.b: (r.x, r.y) for r in times.join(units, "unit").groupBy("b").agg(F.sum(F.col("times") * F.col("x")).alias("x"), F.sum(F.col("times") * F.col("y")).alias("y")).collect()}
    got = {r.b: (r.x, r.y) for r in resampling.resampled_sums(units, "unit", "s", 6).collect()}
    assert got == want and len(got) == 6
    assert resampling.resampled_sums(units.limit(0), "unit", "s", 6).count() == 0


def test_pairs_of_sets_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 20)
    rng = np.random.default_rng(8)
    q, r = ({i: {0, *map(int, rng.integers(0, 12, 4))} for i in range(n)} for n in (30, 40))
    frame = lambda sets: spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, token long")
    got = {x.q: x.max_jaccard for x in graph.max_jaccard(frame(q), frame(r)).collect()}
    assert got == pytest.approx({i: max(len(s & o) / len(s | o) for o in r.values()) for i, s in q.items()})
    assert {x.q: x.support for x in graph.containment_support(frame(q), frame(r)).collect()} == {i: sum(s <= o for o in r.values()) for i, s in q.items()}
    assert graph._overlaps(frame(q), frame(r))[1].rdd.getNumPartitions() > 20


def test_sets_are_dealt_out_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 10)
    sets = spark.createDataFrame([(i, t) for i in range(30) for t in (i, i + 1, i + 1)], "id long, token long")
    dealt = graph._dealt(sets, "q")
    assert dealt.count() == 60 and dealt.rdd.getNumPartitions() == 9


def test_noise_words_leave_no_match_out(spark):
    hits = ["Proof-of concept", "a PoC.", "SECURITY_test", "bug bounty", "vulnerability research", "Red Team", "responsible disclosure", "DO NOT\u00a0use", "donotinstall", "this package is test", "harmles\u017f", "ben\u0131gn", "BEN\u0130GN"]
    hits += ["hac\u212aerone", "x.oast.pro", "ceye.io", "INTERACT.SH", "c\u0131eye.io dnslog.cn", "capture the FLAG", "flag{x}", "CTF", "te\u017ft", "Testing", "requestbin"]
    rows = [(i, x) for i, x in enumerate([*hits, "note", "flags", "contest", "the package", "do not", "", *(x + " é" for x in hits)])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("low", F.lower("text"))
    got = df.select("id", *(c.alias(k) for k, c in text.noise_flags(F.col("text"), F.col("low")).items()))
    want = df.select("id", *(F.col("text").rlike(p).alias(k) for k, p in text.FULL_NOISE.items()))
    assert sorted(got.collect()) == sorted(want.collect())
    assert want.filter("research").count() >= 26


def test_flagship_reads_its_texts_once(spark, monkeypatch):
    written = []
    keep = detection.checkpointed
    monkeypatch.setattr(detection, "checkpointed", lambda df: (written.append(df.columns), keep(df))[1])
    out = registered()["flagship_detection_report"][0](spark, DATA)
    assert "text" not in sum(written, []) and len(written) == 2
    assert "documents.parquet" not in out._jdf.queryExecution().optimizedPlan().toString()
