"""Large samples are those that an ordered limit takes, without one."""

from driftwood.operators import relational as rel


def test_large_samples_equal_small_ones(spark, monkeypatch):
    df = spark.range(900).selectExpr("id div 3 as key").repartition(3)  # copies have equal hashes
    for n in (1, 400, 401, 402, 899, 900, 1000):
        want = [r.key for r in rel.sample(df, "key", "s", n).collect()]
        monkeypatch.setattr(rel, "LARGE", 1)
        large = rel.sample(df, "key", "s", n)
        assert sorted(r.key for r in large.collect()) == sorted(want)
        monkeypatch.setattr(rel, "LARGE", 50_000)
    monkeypatch.setattr(rel, "LARGE", 1)
    assert "Limit 900" not in rel.sample(df, "key", "s", 900)._jdf.queryExecution().optimizedPlan().toString()
