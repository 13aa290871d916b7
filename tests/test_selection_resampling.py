"""Exact quantiles and resamples against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import resampling, selection
from driftwood.plans import metrics


@pytest.mark.parametrize("parts,sent", [(4096, 20_000), (3, 0)])
def test_percentiles_are_exact(spark, monkeypatch, parts, sent):
    monkeypatch.setattr(selection, "PARTS", parts)
    monkeypatch.setattr(selection, "SENT", sent)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=997), None: rng.lognormal(3, 4, 40), "one": np.array([-5.5]), "same": np.full(30, 2.0), "two": np.array([1e-300, 1e300]), "ties": np.repeat([0.1, 0.2, 0.3], [5, 1, 7]), "few": np.array([-1e308, 1e308, 0.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probabilities = [0.0, 0.025, 0.5, 0.99, 1.0]
    got = {r.g: r.q for r in selection.percentiles(df, "v", probabilities, ["g"]).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probabilities))).alias("q")).collect() if r.q}
    assert got == want
    assert selection.percentiles(df, "v", [0.5]).first().q == [df.agg(F.percentile("v", 0.5)).first()[0]]
    assert [r.q for r in selection.percentiles(df.limit(0), "v", [0.5]).collect()] == [None]
    assert selection.percentiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def resampled(rows, b, fpr, block=16):
    """(auc, tpr) of a resample over rows (s, pos, w, key), by the definition."""
    times = []
    for *_, key in rows:
        name = f"{b // block}:{key}".encode()
        h = hashlib.sha256(name).digest() if block == 16 else hashlib.shake_128(name).digest(2 * block)
        u = int.from_bytes(h[2 * (b % block) : 2 * (b % block) + 2], "big")
        times.append(sum(u >= t for t in resampling.POISSON))
    s, pos, w, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array(times)
    neg = np.repeat(s[~pos], t[~pos])
    weight = (w * t)[pos]
    below = (neg[None, :] < s[pos][:, None]).sum(1) + (neg[None, :] == s[pos][:, None]).sum(1) / 2
    limit = np.quantile(neg, 1 - fpr)
    return (weight * below).sum() / weight.sum() / len(neg), weight[s[pos] > limit].sum() / weight.sum()


@pytest.mark.parametrize("part,rows_at_once,cells,block", [(30_000, 4096, 1 << 21, 16), (40, 7, 16, 32), (7, 3, 700, 16)])
def test_resamples_equal_their_definition(spark, monkeypatch, part, rows_at_once, cells, block):
    for name, value in (("PART", part), ("ROWS", rows_at_once), ("CELLS", cells)):
        monkeypatch.setattr(resampling, name, value)
    rng = np.random.default_rng(3)
    scores = np.concatenate([rng.normal(size=150).round(2), np.full(60, 0.5), rng.normal(0.7, 1, 80).round(1)])
    labels = rng.random(len(scores)) < 0.35
    made = [(i, float(s), bool(y), int(i % 23), float(1 + i % 3)) for i, (s, y) in enumerate(zip(scores, labels, strict=True))] + [(999, None, True, 1, 1.0), (998, 0.1, None, 1, 1.0)]
    df = spark.createDataFrame(made, "id long, score double, label boolean, family long, w double").repartition(4)
    got = resampling.bootstrap(df, "score", F.col("label"), F.col("w"), F.col("family"), F.col("id").cast("string"), 37, 0.1, block).toPandas().set_index("b")
    rows = [(s, y, w, f"family:{f}" if y else f"row:{i}") for i, s, y, f, w in made if s is not None and y is not None]
    assert sorted(got.index) == list(range(37))
    for b in range(37):
        assert (got.auc[b], got.tpr[b]) == pytest.approx(resampled(rows, b, 0.1, block))


def test_many_resamples_hash_a_key_once(spark, monkeypatch):
    hashed = []
    monkeypatch.setattr(resampling, "sha256", lambda b: hashed.append(b) or hashlib.sha256(b))
    monkeypatch.setattr(resampling, "shake_128", None)  # one a key and block would take most of the time
    keys = [f"row:{i}" for i in range(600)]
    times = resampling.drawn(keys, 0, 1000, resampling.MANY)
    assert hashed == [k.encode() for k in keys]
    assert (resampling.drawn(keys[5:9], 256, 140, resampling.MANY) == times[5:9, 256:396]).all()
    assert times.mean() == pytest.approx(1, abs=0.01) and times.var() == pytest.approx(1, abs=0.02)
    assert max(np.abs(np.corrcoef(m[:40])[np.triu_indices(40, 1)]).max() for m in (times, times.T)) < 0.25
    rng = np.random.default_rng(4)
    made = [(i, round(float(rng.normal()), 1), i % 3 == 0, i // 9, float(1 + i % 2)) for i in range(300)]
    df = spark.createDataFrame(made, "id long, score double, label boolean, family long, w double").repartition(3)
    got = {r.b: r for r in resampling.bootstrap(df, "score", F.col("label"), F.col("w"), F.col("family"), F.col("id").cast("string"), 130, 0.1, resampling.MANY).collect()}
    t = resampling.drawn([f"family:{f}" if y else f"row:{i}" for i, _, y, f, _ in made], 0, 130, resampling.MANY)
    s, pos, w = np.array([r[1] for r in made]), np.array([r[2] for r in made]), np.array([r[4] for r in made])
    for b in (0, 64, 129):
        neg, weight = np.repeat(s[~pos], t[~pos, b]), (w * t[:, b])[pos]
        below = (neg[None, :] < s[pos][:, None]).sum(1) + (neg[None, :] == s[pos][:, None]).sum(1) / 2
        assert got[b].auc == pytest.approx((weight * below).sum() / weight.sum() / len(neg))
        assert got[b].tpr == pytest.approx(weight[s[pos] > np.quantile(neg, 0.9)].sum() / weight.sum())


def test_paired_test_finds_the_better_scorer(spark):
    rng = np.random.default_rng(5)
    rows = []
    for seed in range(2):
        for i in range(400):
            y = i < 120
            rows.append((seed, i, i // 4, y, float(rng.normal(1.5 * y)), float(rng.normal(0.2 * y))))
    df = spark.createDataFrame(rows, "seed long, id long, family long, label boolean, a double, b double")
    better = metrics.paired_test(df, [0, 1], 64).first()
    assert better.ci_lo > 0 and better.p == pytest.approx(2 / 65) and better.resamples == 64
    assert better.diff == pytest.approx(np.mean([better.ci_lo, better.ci_hi]), abs=0.1)
    same = metrics.paired_test(df.withColumn("b", F.col("a")), [0, 1], 16).first()
    assert (same.diff, same.ci_lo, same.ci_hi, same.p) == (0, 0, 0, 1)
