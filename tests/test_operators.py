"""Operators against brute force, and sources and the stream over temporary folders."""

import io
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import detectors, families, graph, names, ranking
from driftwood.operators.resampling import multiplicities
from driftwood.sources import archives
from driftwood.sources.tables import popular_names, read_csv, verified
from driftwood.streaming.ingest import ingest


def scores(seed=0, n=400):
    rng = random.Random(seed)
    return [(rng.randint(0, 60) / 10, rng.random() < 0.3, rng.choice([0.5, 1.0, 2.0]), rng.choice("ab")) for _ in range(n)]


def test_auc_and_ranks(spark):
    rows = scores()
    df = spark.createDataFrame(rows, "s double, y boolean, w double, g string")
    for g in "ab":
        own = [r for r in rows if r[3] == g]
        wins = sum(p[2] * q[2] * ((p[0] > q[0]) + 0.5 * (p[0] == q[0])) for p in own if p[1] for q in own if not q[1])
        truth = wins / (sum(p[2] for p in own if p[1]) * sum(q[2] for q in own if not q[1]))
        got = ranking.auc(df, "s", F.col("y"), F.col("w"), ["g"]).filter(F.col("g") == g).first().auc
        assert abs(got - truth) < 1e-12
    values = np.array([r[0] for r in rows])
    got = {r.s: r.pct for r in ranking.midrank(df.select("s"), "s").distinct().collect()}
    for v, p in got.items():
        assert abs(p - ((values < v).sum() + ((values == v).sum() + 1) / 2) / len(values)) < 1e-12


def test_partial_auc(spark):
    rows = scores(3)
    y, s = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    cuts = [np.inf, *sorted(set(s), reverse=True)]
    fpr, tpr = [np.mean(s[~y] >= c) for c in cuts], [np.mean(s[y] >= c) for c in cuts]
    f = 0.1
    xs = [x for x in fpr if x < f] + [f]
    ys = list(np.interp(xs, fpr, tpr)) if len(set(fpr)) == len(fpr) else [np.interp(x, fpr, tpr) for x in xs]
    keep = [(a, b) for a, b in zip(fpr, tpr, strict=True) if a < f] + [(f, ys[-1])]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(keep, keep[1:], strict=False))
    truth = 0.5 * (1 + (area - f * f / 2) / (f - f * f / 2))
    got = ranking.partial_auc(spark.createDataFrame(rows, "s double, y boolean, w double, g string"), "s", F.col("y"), f).first().pauc
    assert abs(got - truth) < 1e-9


def test_holm(spark):
    p = [0.001, 0.04, 0.03, 0.005, 0.9]
    got = {r.p: r.p_holm for r in ranking.holm(spark.createDataFrame([("f", x) for x in p], "family string, p double"), "p", ["family"]).collect()}
    running = 0.0
    for k, x in enumerate(sorted(p)):
        running = max(running, min(1.0, (len(p) - k) * x))
        assert abs(got[x] - running) < 1e-12


def test_damerau():
    assert [names.damerau(*x) for x in (("ca", "abc"), ("reqeusts", "requests"), ("", "ab"), ("abc", "abc"), ("numpy", "numpi"))] == [2, 1, 2, 0, 1]


def test_edit_blocking_is_complete(spark):
    import itertools

    alphabet = ["".join(x) for n in range(3, 6) for x in itertools.product("ab", repeat=n)] + ["abababababa", "ababababab", "bababababab", "abababbabab", "aababababab"]
    n = spark.createDataFrame([(w,) for w in alphabet], "name string")
    t = n.select(F.col("name").alias("target"), F.lit(1).cast("long").alias("rank"))
    got = {(r.name, r.target) for r in names.edit_pairs(n, t).collect()}
    most = lambda x: 0 if len(x) <= 3 else 1 if len(x) <= 8 else 2
    assert got == {(a, b) for a in alphabet for b in alphabet if 0 < names.damerau(a, b) <= most(b)}


def test_components_and_hubs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(800, 860)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    nodes = spark.range(900).select("id")
    got = {r.id: r.component for r in graph.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == root(i) for i in range(900))


def test_peers_agree_with_pairs(spark):
    rng = random.Random(1)
    tok = spark.createDataFrame([(i, rng.randrange(40)) for i in range(60) for _ in range(3)] + [(i, 999) for i in range(0, 60, 2)], "id long, token long")
    q, r = tok.filter("id < 30"), tok.filter("id >= 20")
    pairs = {x.q for x in graph.peer_pairs(q, r).filter("q <> r").collect()}
    assert {x.id for x in graph.has_peers(q, r).collect()} == pairs


def test_near_copies(spark):
    rng = random.Random(0)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [base, base[:450] + "#" + base[450:], base, "short", "".join(rng.choice("abcdefgh ") for _ in range(900))]
    pairs = families.near_duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.8).collect()
    cut = lambda t: {t[i : i + 9] for i in range(len(t) - 8)}
    a, b = cut(texts[0]), cut(texts[1])
    assert [(p.a, p.b) for p in pairs] == [(0, 1)] and abs(pairs[0].jaccard - len(a & b) / len(a | b)) < 1e-12


def test_resamples_draw_as_many_as_there_are(spark):
    drawn = multiplicities(spark.range(50).select("id"), "id", "s", 6).groupBy("b").agg(F.sum("times").alias("n")).collect()
    assert len(drawn) == 6 and all(r.n == 50 for r in drawn)


def test_detectors_find_the_outlier(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 4)))] + [(999, [9.0] * 4)]
    v = spark.createDataFrame(rows, "id long, x array<double>")
    fit = v.filter("id < 150")
    for model in (detectors.IsolationForest(40), detectors.OneClassMachine()):
        assert model.fit(fit).score(v).orderBy(F.desc("score")).first().id == 999
    assert detectors.local_outlier_factor(v.filter("id > 140"), v.filter("id <= 140"), 5).orderBy(F.desc("lof")).first().id == 999


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = archive({"p/PKG-INFO": "Name: p\nHome-page: https://github.com/me/p\n\ntext", "p/setup.py": "from setuptools import setup\nsetup(install_requires=['Num_Py>=1', 'b; x'], extras_require={'t': ['pytest']})", "p/requirements.txt": "# no\n-r x\nb==2\ngit+https://x\n"})
    for where, data in (("p/1.0/p.zip", good), ("q/q.zip", b"broken"), (".git/1/x.zip", good)):
        (tmp_path / where).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / where).write_bytes(data)
    found = archives.archives(spark, str(tmp_path))
    assert sorted((r.name, r.version) for r in found.select("name", "version").collect()) == [("p", "1.0"), ("q", "unknown")]
    rows = {r.path.rsplit("/", 1)[1]: r for r in archives.features(found).collect()}
    assert rows["q.zip"].status == "unreadable" and rows["p.zip"].n_py_files == 1 and rows["p.zip"].link_count == 1
    assert {(x.dep, x.optional) for x in rows["p.zip"].deps} == {("num-py", 0), ("b", 0), ("pytest", 1)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n\nnull,1\n,2\n"nan",3\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    assert [r.name for r in read_csv(spark, str(tmp_path / "a.csv"), schema).orderBy("n").collect()] == ["null", "", "nan"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text('{"rows": [{"project": "A_b"}, {"project": "c"}]}')
    (tmp_path / "s" / "2.json").write_text('{"rows": [{"project": "c"}, {"project": "d"}, {"project": "e"}]}')
    assert {(r.name, r["rank"]) for r in popular_names(spark, str(tmp_path / "s"), 2).collect()} == {("a-b", 1), ("c", 1), ("d", 2)}
    import hashlib

    files = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"22"))], "path string, content binary")
    sums = spark.createDataFrame([("x", hashlib.sha256(b"1").hexdigest()), ("y", "0"), ("z", "0")], "path string, sha256 string")
    assert {(r.path, r.status) for r in verified(files, sums, 5).collect()} == {("x", "ok"), ("y", "checksum_mismatch"), ("z", "download_failed")}


def test_ingest_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for batch in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i, f"v{i}") for i in batch], "k long, v string").coalesce(1).write.mode("append").parquet(src)
        ingest(spark, spark.readStream.schema("k long, v string").parquet(src), "k", out, ck).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_copies_are_twins_and_share_their_neighbours(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = " ".join(word() for _ in range(120))
    other = " ".join(word() for _ in range(120))
    rows = [(5, base), (1, base), (9, base + " tail"), (3, base + " tail"), (7, other), (2, other), (4, " ".join(word() for _ in range(120)))]
    t = spark.createDataFrame(rows, "id long, text string")
    pairs, classes = families.near_duplicate_pairs(t, 0.7), families.copy_classes(t)
    cut = {i: {x[k : k + 9] for k in range(len(x) - 8)} for i, x in rows}
    alike = lambda a, b: len(cut[a] & cut[b]) / len(cut[a] | cut[b])
    truth = {(a, b): alike(a, b) for a in cut for b in cut if a < b and alike(a, b) >= 0.7}
    got = families.with_copies(pairs, classes).collect()
    assert len(got) == len(truth) and all(abs(truth[p.a, p.b] - p.jaccard) < 1e-12 for p in got)
    for flagged in ({7}, {3}, {5, 4}, {1, 2, 7}):
        flags = spark.createDataFrame([(i, i in flagged) for i in cut], "id long, flag boolean")
        near = {r.id: r.near_flag for r in families.flagged_twins(flags, pairs, classes).collect()}
        want = {}
        for a, b in truth:
            want[a] = want.get(a, False) or b in flagged
            want[b] = want.get(b, False) or a in flagged
        assert near == want


def test_pairs_just_at_the_threshold_are_all_found(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for k in range(400):
        base = text(600)
        rows += [(2 * k, base), (2 * k + 1, base[: 496 + k % 8] + text(104 - k % 8))]  # 488 of 696 shingles and more
    pairs = families.near_duplicate_pairs(spark.createDataFrame(rows, "id long, text string"), 0.7).collect()
    assert {(p.a, p.b) for p in pairs} == {(2 * k, 2 * k + 1) for k in range(400)}
    assert all((1 - t**families.BAND) ** families.bands(t) <= 1e-6 for t in (0.5, 0.7, 0.8, 0.9))


def test_a_failed_preflight_names_its_checks(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from driftwood.sources.artefacts import required

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    assert required(df, {"id": T.LongType()}, {"positive": F.col("id") > 0}).count() == 2
    with pytest.raises(ValueError, match="named"):
        required(df, {"id": T.LongType()}, {"positive": F.col("id") > 0, "named": F.col("name").isNotNull()})
    with pytest.raises(ValueError, match="rank"):
        required(df, {"rank": T.LongType()}, {})


def test_the_cache_extracts_only_what_it_lacks(spark, tmp_path):
    from pyspark.sql import functions as F

    from driftwood.sources.artefacts import cached

    items = spark.createDataFrame([(k, v) for k, v in ((1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "d"))], "id long, v string")
    first = cached(items.filter("id < 3"), "id", f"{tmp_path}/cache", lambda t: t.withColumn("run", F.lit(1)))
    assert sorted(r.id for r in first.collect()) == [1, 2]
    again = cached(items, "id", f"{tmp_path}/cache", lambda t: t.withColumn("run", F.lit(2)))
    assert sorted((r.id, r.run) for r in again.collect()) == [(1, 1), (2, 1), (3, 2)]


def test_near_copies_meet_in_blocks_and_pass_scores_on(spark, monkeypatch):
    from driftwood.plans.similarity import twin_summary

    monkeypatch.setattr(families, "BLOCK", 3)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    base = [text(700) for _ in range(4)]
    rows = [(i, b[: 690 - k] + text(k)) for i, (b, k) in enumerate((b, k) for b in base for k in (0, 0, 5, 20, 60, 90, 130))] + [(100 + k, text(510 + 30 * k)) for k in range(12)] + [(200, "short"), (201, None)]
    cut = {i: {x[k : k + 9] for k in range(len(x) - 8)} for i, x in rows if x and len(x) >= 500}
    alike = lambda a, b: len(cut[a] & cut[b]) / len(cut[a] | cut[b])
    truth = {(a, b): alike(a, b) for a in cut for b in cut if a < b and alike(a, b) >= 0.7}
    t = spark.createDataFrame(rows, "id long, text string")
    got = {(p.a, p.b): p.jaccard for p in families.with_copies(families.near_duplicate_pairs(t, 0.7), families.copy_classes(t)).collect()}
    assert got.keys() == truth.keys() and all(abs(got[k] - truth[k]) < 1e-12 for k in truth)

    label = {i: i % 3 == 0 for i, _ in rows}
    score = {i: float(len(x or "")) for i, x in rows}
    near = {i: [b if a == i else a for a, b in truth if i in (a, b)] for i in label}
    after = {i: max([score[i], *(score[j] for j in near[i])]) for i in label}
    limit = lambda of: np.quantile([of[i] for i in label if not label[i]], 0.95)
    c, a = {i: score[i] > limit(score) for i in label}, {i: after[i] > limit(after) for i in label}
    r = twin_summary(t, spark.createDataFrame([(i, y) for i, y in label.items()], "id long, label boolean")).first()
    pos = [i for i in label if label[i]]
    family = {i: None if x is None else re.sub(r"\s+", "", re.sub("[A-Za-z0-9+/=]{200,}", "<BLOB>", x)) for i, x in rows}
    w = {i: 1 / sum(family[j] == family[i] for j in pos) for i in pos}
    share = lambda hit, of: sum(w[i] for i in pos if of(i) and hit(i)) / sum(w[i] for i in pos if of(i)) if any(of(i) for i in pos) else None
    every, missed, caught = (lambda i: True), (lambda i: not c[i]), (lambda i: c[i])
    want = [len(pos), share(caught, every), share(lambda i: a[i], every), share(lambda i: bool(near[i]), missed), share(lambda i: bool(near[i]), caught), share(lambda i: any(not label[j] for j in near[i]), missed), share(lambda i: a[i], missed), share(lambda i: not a[i], caught)]
    normal = [i for i in label if not label[i]]
    want += [np.mean([bool(near[i]) for i in normal]), np.mean([after[i] > limit(score) and not c[i] for i in normal])]
    assert [None if v is None else pytest.approx(v) for v in want] == list(r)


def test_set_joins_hold_with_hubs(spark):
    rng = random.Random(3)
    sets = lambda n, size: {i: {rng.randint(1, 30) for _ in range(rng.randint(1, size))} | ({0} if i % 2 else set()) for i in range(n)}
    q, r = sets(60, 4), sets(80, 5)
    q |= {100: {0}, 101: {0, 99}, 102: {98, 99}, 103: {5}, 104: {0, 1, 2}}
    r |= {200 + k: {0, 1000 + k} for k in range(40)}
    frame = lambda of: spark.createDataFrame([(i, t) for i, s in of.items() for t in s] * 2, "id long, token long")
    got = {x.q: x.max_jaccard for x in graph.max_jaccard(frame(q), frame(r)).collect()}
    want = {i: max(len(s & t) / len(s | t) for t in r.values()) for i, s in q.items()}
    assert got == pytest.approx({i: v for i, v in want.items() if v > 0})
    support = {x.q: x.support for x in graph.containment_support(frame(q), frame(r)).collect()}
    assert support == {i: sum(s <= t for t in r.values()) for i, s in q.items()}
    _, pairs = graph._overlaps(frame({1: {0}, 2: {0, 7}}), frame({i: {0} if i % 2 else {0, i + 10} for i in range(50)}))
    assert pairs.count() == 0  # the hub alone makes no pair


def test_near_copies_are_summed_up_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(families, "SHINGLES", 9000)  # a dozen texts
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    base = [text(700), text(800)]
    rows = [(i, b[: len(b) - k] + text(k)) for i, (b, k) in enumerate((b, k) for b in base for k in [*range(0, 160, 4), 0, 0])] + [(900, text(600)), (901, "short"), (902, None)]
    cut = {i: {x[k : k + 9] for k in range(len(x) - 8)} for i, x in rows if x and len(x) >= 500}
    near = {i: {j: len(cut[i] & cut[j]) / len(cut[i] | cut[j]) for j in cut if j != i} for i in cut}
    t = spark.createDataFrame(rows, "id long, text string")

    def reach(least):
        comp = {i: i for i, _ in rows}
        while (now := {i: min([comp[i], *(comp[j] for j, s in near.get(i, {}).items() if s >= least)]) for i in comp}) != comp:
            comp = now
        return comp

    links = {i: sum(s >= 0.8 for s in near.get(i, {}).values()) for i, _ in rows}
    got = {r.id: (r.component_id, r.n_links) for r in families.link_numbers(t, 0.8).collect()}
    assert got == {i: (c, links[i]) for i, c in reach(0.8).items()}

    levels = (0.7, 0.8, 0.9, 0.95)
    met = families.near_copies(t, 0.7, t.select("id"), tied=levels)
    assert met.count() < sum(len(x) for x in near.values()) / 4  # no row a pair
    reps = families.copy_classes(t).filter("id = rep").select("id")
    for least in levels:
        comp = reach(least)
        assert all(comp[r.id] == r.component for r in graph.components(reps, families.tied_at(met, least)).collect())

    flags = spark.createDataFrame([(i, i in (3, 44, 900)) for i, _ in rows], "id long, flag boolean")
    want = {i: any(j in (3, 44, 900) for j, s in x.items() if s >= 0.7) for i, x in near.items() if any(s >= 0.7 for s in x.values())}
    assert {r.id: r.near_flag for r in families.flagged_near(t, flags, 0.7).collect()} == want


def test_a_batch_of_texts_keeps_no_sets_but_one(monkeypatch):
    import pyarrow as pa

    held, most = [], []
    make = families.shingles

    class Kept(np.ndarray):
        def __del__(self):
            held.pop()

    def counted(t, size):
        held.append(1)
        most.append(len(held))
        return make(t, size).view(Kept)

    monkeypatch.setattr(families, "shingles", counted)
    batch = pa.RecordBatch.from_pydict({"id": list(range(30)), "m": ["m"] * 30, "text": [f"{k} text of some length" for k in range(30)]})
    out = list(families._shingled(9, lambda h: np.array([len(h)], np.uint64))([batch]))
    assert sum(b.num_rows for b in out) == 30 and max(most) <= 3
