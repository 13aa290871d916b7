"""Every registered query against its SQL in DuckDB on the smallest tables; those without SQL must give rows of a stable schema."""

import datetime
import hashlib
import os

import duckdb
import pytest

from driftwood.plans.registry import registered

DATA = "/root/testdata/sf0.001"
QUERIES = registered()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.7g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v) if not isinstance(v, int) else f"{float(v):.7g}" if abs(v) < 1e6 else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, DATA)
    got = df.collect()
    if sql is None:
        assert df.columns and query(spark, DATA).schema == df.schema
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())


def test_no_plan_multiplies_all_rows_with_all(spark):
    for name in ("join_peer_overlap", "join_edit_distance", "join_max_jaccard", "graph_build_edges"):
        plan = QUERIES[name][0](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, name


def test_noise_patterns_of_whole_documents(spark):
    import re

    from driftwood.plans import text

    rows = [(0, "a" * 300 + " made for\n research " + "b" * 300), (1, "x" * 100 + "😀 CTF 😀 webhook.site and Do_Not-Install"), (2, "test-it is nothing"), (3, None), (4, ""), (5, "poctf flags {"), (6, "Benign " + "word " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in text.noise_matches(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        t = t or ""
        for k, p in text.FULL_NOISE.items():
            m = re.search(p.removeprefix("(?iU)"), t, re.I)
            snippet = re.sub(r"\s+", " ", t[max(0, m.start() - 60) : m.end() + 60])[:160] if m else ""
            assert (got[i][k], got[i][f"{k}_match"]) == (m is not None, snippet), (i, k)
    assert [i for i in got if got[i].test_name] == [2]


def test_shingles_of_whole_documents(spark):
    from driftwood.plans import text

    rows = [(0, "abcdefghi" * 60), (1, None), (2, ""), (3, "x" * 499), (4, "é" + "word😀 " * 200 + "the end"), (5, "y" * 500)]
    got = {r.doc_id: r for r in text.document_shingles(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        cut = {t[k : k + 9] for k in range(len(t) - 8)} if t and len(t) >= 500 else None
        assert (got[i].n, got[i].least) == ((len(cut), min(cut)) if cut else (None, None))


def test_losses_of_all_batches_and_bootstraps_of_many_resamples(spark):
    import numpy as np

    from driftwood.plans import detection, metrics

    x = np.random.default_rng(2).normal(size=(101, 6))
    df = spark.createDataFrame([(1000 + 3 * i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    truth = []
    for lo in range(0, len(x), 32):
        b = x[lo : lo + 32]
        u = b / np.linalg.norm(b, axis=1, keepdims=True)
        s = u @ u.T / 0.5
        truth.append(np.mean([np.log(np.exp(np.delete(s[i], i)).sum()) - s[i, i ^ 1] for i in range(len(b)) if i ^ 1 < len(b)]))
    got = [r.infonce for r in detection.batch_losses(df).orderBy("batch").collect()]
    assert np.allclose(got, truth) and len(got) == 4
    far = lambda p, q: np.linalg.norm(x[p] - x[q])
    got = [r.loss for r in detection.triplet_losses(df).orderBy("triplet").collect()]
    assert np.allclose(got, [max(0.0, far(k, k + 1) - far(k, k + 2) + 0.5) for k in range(0, 99, 3)])
    # families alone are drawn here, by position; boot_ci, which draws negatives too, is held against its SQL above
    s = metrics.score_rows(spark, DATA).toPandas()
    pos, neg = s[s.label], np.sort(s[~s.label].score.to_numpy())
    below = (np.searchsorted(neg, pos.score, "left") + np.searchsorted(neg, pos.score, "right")) / 2 / len(neg)
    families = np.sort(pos.family.unique())
    aucs = []
    for b in range(metrics.BOOT):
        picks = [int(hashlib.sha256(f"boot:{b}:{j}".encode()).hexdigest()[:15], 16) / 2**60 for j in range(len(families))]
        times = dict(zip(*np.unique(families[[int(u * len(families)) for u in picks]], return_counts=True), strict=True))
        w = pos.w.to_numpy() * np.array([times.get(f, 0) for f in pos.family])
        aucs.append((w * below).sum() / w.sum())
    few = metrics.family_auc_ci(metrics.score_rows(spark, DATA), metrics.BOOT).first()
    assert np.allclose((few.lo, few.hi), np.percentile(aucs, [2.5, 97.5]), atol=2e-6) and few.resamples == metrics.BOOT
    assert QUERIES["boot_ci_5000"][0](spark, DATA).first().resamples == 5000
