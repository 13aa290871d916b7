"""op11, op12 and op13 against brute force, with the odd cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.llm import manifest as mf
from driftwood.llm import mixing as mx
from driftwood.llm import quantiles as qs

SHA = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    """(root, each leaf's siblings level by level, left to right)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([SHA(last[k : k + fanout]) for k in range(0, len(last), fanout)])
    proofs = []
    for i in range(len(leaves)):
        out, at = [], i
        for level in levels[:-1]:
            run = at // fanout * fanout
            out += [d for k, d in enumerate(level[run : run + fanout], run) if k != at]
            at //= fanout
        proofs.append(out)
    return levels[-1][0], proofs


@pytest.mark.parametrize("fanout,levels", [(16, 1), (3, 2), (16, 3)])
def test_manifest_equals_plain_trees(spark, fanout, levels):
    rng = random.Random(3)
    sizes = {None: 17, "": 1, "a": 16, "é": 257, "zz": 33, "hot": 600}
    rows = [(i * 7 % 5003, rng.choice(["Text", "", None, "Ünï " * 50]), s, None, i % 3, "taken", "x") for s, n in sizes.items() for i in range(n)]
    rows += [rows[0]] * 3 + [(None, "no id", "a", "en", 1, "y", "x"), (2**60 + 1, "LARGE", "a", "en", 1, "y", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, leaf string, digest string")
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: SHA([cell(v) for v in (r[0], r[2], r[3], r[4], text)])
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    changed = mf.leaf_hash([F.translate("text", mf._UPPER, mf._LOWER) if c == "text" else F.col(c) for c in mf.FIELDS])
    out = mf.manifest(docs, mf.FIELDS, claimed=F.when(F.col("n_chars") == 1, changed), proofs=True, fanout=fanout, levels=levels).collect()
    groups, found = {}, {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([d for _, d, _ in sorted(groups[s], key=lambda g: g[:2])], fanout) for s in order}
    root, tops = tree([trees[s][0] for s in order], fanout)
    for s, top in zip(order, tops, strict=True):
        for (_, d, r), proof in zip(sorted(groups[s], key=lambda g: g[:2]), trees[s][1], strict=True):
            ok = r[4] != 1 or lower(r[1]) == r[1]
            found.setdefault((r[0], d, trees[s][0], "".join(proof + top), ok), []).append(1)
    for r in out:
        assert r.root == root and r.proof_sha256 == SHA([r.proof])
        found[r.doc_id, r.leaf, r.subroot, r.proof, r.folded_root == root].pop()
    assert not any(found.values())
    assert mf.manifest(docs.limit(0), mf.FIELDS).count() == 0
    one = mf.manifest(docs.limit(1), mf.FIELDS).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == SHA([])


def test_folding_notices_every_change():
    leaves = [SHA([str(i)]) for i in range(50)]
    root, proofs = tree(leaves, 16)
    for i in (0, 15, 16, 47, 48, 49):
        proof = "".join(proofs[i])
        assert mf.fold(leaves[i], proof, [(i, 50)]) == root
        assert mf.fold(leaves[i - 1], proof, [(i, 50)]) != root
        assert mf.fold(leaves[i], proof[:-1] + ("0" if proof[-1] != "0" else "1"), [(i, 50)]) != root


def test_hypergeometric_draws_have_their_distribution(spark):
    n = 20_000
    for whole, marked, drawn in ((50, 20, 10), (7, 7, 3), (9, 0, 4), (30, 29, 15), (400, 100, 200)):
        x = mx.hypergeometric(f"{whole}L", f"{marked}L", f"{drawn}L", "u")
        got = spark.range(n).withColumn("u", (F.col("id") + 0.5) / n).select(F.expr(x).alias("x")).groupBy("x").count().toPandas().set_index("x")["count"]
        want = {k: math.comb(marked, k) * math.comb(whole - marked, drawn - k) / math.comb(whole, drawn) for k in range(min(marked, drawn) + 1)}
        assert all(abs(got.get(k, 0) / n - p) < 2 / n for k, p in want.items()) and got.sum() == n
    large = mx.hypergeometric("3000000000L", "1000000000L", "1500000000L", "u")
    got = spark.range(200).withColumn("u", (F.col("id") + 0.5) / 200).select(F.expr(large).alias("x")).toPandas().x
    assert abs(got.mean() - 5e8) < 1000 and got.std() == pytest.approx((3e9 * 0.25 * 2 / 9 / 2) ** 0.5 * 2**0.5, rel=0.5)


@pytest.mark.parametrize("width", [256, 2])
def test_quotas_are_dealt_out_exactly(spark, width):
    q = {0: 1000, 1: 500, 2: 3, 4: 90, 7: 1}
    out = mx.split(spark.createDataFrame(list(q.items()), "g long, q long"), 4, 5, width).toPandas()
    assert out.groupby("g").q.sum().to_dict() == q
    assert set(out.groupby("shard").q.sum()) <= {sum(q.values()) // 16, sum(q.values()) // 16 + 1} and len(set(out.shard)) == 16
    for g, own in out.groupby("g"):
        own = own.sort_values("start")
        assert own.start.tolist() == np.concatenate(([0], own.q.cumsum()[:-1])).tolist(), g
    assert (out[out.g == 0].q.between(35, 90)).all()


def test_the_tree_mixes_as_a_random_permutation(spark):
    halves = [mx.split(spark.createDataFrame([(0, 6), (1, 4)], "g long, q long"), 1, seed).filter("shard = 0 and g = 0").agg(F.coalesce(F.sum("q"), F.lit(0))).first()[0] for seed in range(60)]
    assert {3} < set(halves) <= {1, 2, 3, 4, 5} and abs(np.mean(halves) - 3) < 0.4


def water(sizes, weights):
    total, out = 1.5 * sum(sizes), [0.0] * len(sizes)
    capped = set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        rest = total - sum(2 * sizes[k] for k in capped)
        for k in free:
            out[k] = rest * weights[k] / sum(weights[j] for j in free)
        over = {k for k in free if out[k] > 2 * sizes[k]}
        for k in over:
            out[k] = 2.0 * sizes[k]
        if not over:
            return out
        capped |= over


def test_mix_hits_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randint(0, 40), s) for i, s in enumerate("a" * 200 + "b" * 150 + "c" * 20 + "é" * 90)]
    rows += [(1000, "x " * 30_000, "b"), (1001, None, "a"), (1002, "", None), (1003, "\t\n", "only"), (1004, "in none", None), (None, "no id", "c")] + [(7, "twin twin", "a")] * 50
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, taken int, g int")
    rows_, pieces = mx.mix(docs, block=16, shard_blocks=8)
    out = rows_.join(pieces.groupBy("g", "doc").agg(F.sum("words").alias("taken")), ["g", "doc"], "left").fillna(0, ["taken"]).toPandas()
    assert len(out) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(out["size"]) == sorted(words(t) for _, t, _ in rows)
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words(t) for _, t, s in rows if s == o) for o in order]
    for o, size, aim in zip(order, sizes, water(sizes, [5, 2, 1] * 3), strict=False):
        own = out[out.source.isna()] if o is None else out[out.source == o]
        assert (own.source_size == size).all() and own.target.to_numpy() == pytest.approx(aim)
        assert abs(own.taken.sum() - aim) <= 0.5
    assert (out.taken <= 2 * out["size"]).all()
    p = pieces.toPandas()
    shards = p.drop_duplicates(["shard", "place"]).groupby("shard").place
    assert shards.size().max() - shards.size().min() <= 1 and (shards.max() + 1 == shards.size()).all()
    seen = set()
    for r in p.itertuples():  # no word twice in a pass
        for k in range(r.start, r.start + r.words):
            key = (r.g, r.doc, r[3], k)
            assert key not in seen
            seen.add(key)
    again = mx.mix(docs.repartition(3), block=16, shard_blocks=8)[1].toPandas()
    columns = p.columns.tolist()
    assert p.sort_values(columns).to_numpy().tolist() == again.sort_values(columns).to_numpy().tolist()
    assert [d.count() for d in mx.mix(docs.limit(0))] == [0, 0]
    assert [d.count() for d in mx.mix(docs.filter("doc_id = 1003"))] == [1, 0]


def made_counts():
    rng = np.random.default_rng(2)
    groups = {
        ("hot", 0): np.concatenate([rng.integers(0, 10**6, 30_000), np.full(9000, 77)]), ("hot", 1): rng.lognormal(10, 2, 8000).astype(int), (None, 0): rng.integers(-500, 500, 999),
        ("line", 0): np.arange(5000), ("few", 0): np.array([3] * 19 + [9]), ("few", 1): np.array([1] * 19), ("one", 3): np.full(1000, -5), ("small", 2): rng.integers(0, 10**9, 60), ("jumps", 0): np.repeat([1, 10, 10**12], [400, 1, 600]),
    }
    return {k: np.sort(v.astype(np.int64)) for k, v in groups.items()}


@pytest.mark.parametrize("chunk,fan,held", [(1 << 16, 64, 1 << 20), (300, 2, 500)])
def test_quantiles_are_within_their_bound(spark, monkeypatch, chunk, fan, held):
    monkeypatch.setattr(qs, "CHUNK", chunk)
    monkeypatch.setattr(qs, "FAN", fan)
    monkeypatch.setattr(qs, "HELD", held)
    groups = made_counts()
    rows = [(g, b, int(x), int(c)) for (g, b), v in groups.items() for x, c in zip(*np.unique(v, return_counts=True), strict=True)]
    counts = spark.createDataFrame(rows, "grp string, batch int, x long, c long").repartition(6).cache()
    batches = qs.summarise(counts, ["grp", "batch"])
    wholes = qs.merge(batches, ["grp"]).withColumn("batch", F.lit(-1))
    kept = {(r.grp, r.batch): r for r in batches.unionByName(wholes).collect()}
    for (g, b), v in list(groups.items()):
        groups[g, -1] = np.sort(np.concatenate([w for (h, c), w in groups.items() if h == g and c >= 0]))
    assert kept.keys() == groups.keys()
    for k, v in groups.items():
        assert kept[k].n == len(v) and min(20, len(np.unique(v))) <= len(kept[k].knots) <= min(len(v), 2000)
    asked = qs.answers(batches.unionByName(wholes), ["grp", "batch"])
    found = qs.audit(asked.cache(), counts.unionByName(counts.withColumn("batch", F.lit(-1))), ["grp", "batch"]).toPandas()
    want = {k: v for k, v in groups.items() if len(v) >= 20}
    assert len(found) == 19 * len(want)
    for (g, b), v in want.items():
        own = found[(found.grp.isna() if g is None else found.grp == g) & (found.batch == b)].sort_values("i")
        n, a = len(v), own.answer.to_numpy()
        target = -(-np.arange(1, 20) * n // 20)
        assert own.target.tolist() == target.tolist() and own.exact_x.tolist() == v[target - 1].tolist()
        assert own.n_below.tolist() == np.searchsorted(v, a, "left").tolist() and own.n_upto.tolist() == np.searchsorted(v, a, "right").tolist()
        error = np.maximum(0, np.maximum(own.n_below + 1 - target, target - own.n_upto))
        assert (1000 * error <= 10 * n).all() and (np.diff(a) >= 0).all() and v[0] <= a[0] and a[-1] <= v[-1]
        if n < 100:
            assert a.tolist() == v[target - 1].tolist()


def test_a_fit_stays_within_its_error_and_few_knots():
    rng = np.random.default_rng(4)
    for _ in range(5):
        x = np.unique(rng.lognormal(8, 2, 5000).astype(int))
        c = rng.integers(1, 50, len(x))
        c[rng.integers(len(x))] = 20_000
        upto = np.cumsum(c).astype(float)
        below, error = upto - c, 0.002 * upto[-1]
        k = qs.fit(x, below, upto, error)
        line = np.interp(x, np.repeat(x[k], 2) + np.tile([0, 1e-9], len(k)), np.stack([below[k], upto[k]], 1).ravel())
        inner = np.setdiff1d(np.arange(len(x)), k)
        assert len(k) <= 1 / 0.002 + 2 and (line[inner] <= below[inner] + error + 1e-3).all() and (line[inner] >= upto[inner] - error - 1e-3).all()
    straight = np.arange(10_000)
    assert len(qs.fit(straight, straight.astype(float), straight + 1.0, 50.0)) == 20


def test_sums_of_summaries_are_the_summary_of_the_sum():
    a, b = (np.array([1, 5]), np.array([0.0, 2.0]), np.array([2.0, 6.0])), (np.array([3, 5, 9]), np.array([0.0, 1.0, 3.0]), np.array([1.0, 3.0, 4.0]))
    x, below, upto = qs.added(tuple(np.concatenate(p) for p in zip(a, b, strict=True)), np.array([0, 2]))
    assert x.tolist() == [1, 3, 5, 9] and below.tolist() == [0, 2, 3, 9] and upto.tolist() == [2, 3, 9, 10]


def test_empty_streams(spark):
    none = spark.createDataFrame([], "grp string, x long, c long")
    asked = qs.answers(qs.summarise(none, ["grp"]), ["grp"])
    assert qs.audit(asked, none, ["grp"]).count() == 0
