"""op1, op5 and op7 against brute force, with the odd cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from driftwood.llm.embeddings import near_duplicate_vectors
from driftwood.llm.near_duplicates import near_duplicates
from driftwood.llm.repeats import KEY, _kept, longest_matches, repeated_ranges, suffix_order, with_ranges

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made_texts(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(120)]
    texts = [" ".join(word() for _ in range(rng.randint(5, 200))) for _ in range(25)]
    for share in (0.0, 0.01, 0.02, 0.03, 0.05, 0.2):
        texts += [" ".join(w if rng.random() > share else word() for w in base) for _ in range(4)]
    texts += [" ".join(base), " ".join(base).upper(), "one two", "One\tTWO", "", None, "  \n ", "x" * 3000, " ".join(["again"] * 900)]
    return texts


def brute_components(texts, size, num, den):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return [len(s) for s in sets], comp


@pytest.mark.parametrize("size,num", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, size, num):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, "sig", 1) for i, t in enumerate(texts)], "doc_id long, text string, bands string, n_shingles int")
    got = {r.doc_id: r for r in near_duplicates(docs, size, num, 100, bands=34, rows=5).collect()}
    n, comp = brute_components(texts, size, num, 100)
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert all(got[i].kept == (comp[i] == i) for i in range(len(texts)))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    import driftwood.llm.near_duplicates as nd

    monkeypatch.setattr(nd, "BUCKET", 2)
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "ROUNDS", 0)
    texts = made_texts(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 85, 100, bands=26, rows=5).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 3, 85, 100)[1]


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], schema)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id) == [(1, 1), (1, 1), (2, 2)]
    assert [r.kept for r in rows if r.doc_id is None] == [None]


def brute_removed(texts, span, keep_first=False):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, t in enumerate(raw):
        for p in range(len(t) - span + 1):
            seen.setdefault(t[p : p + span], []).append((i, p))
    out = []
    for i, t in enumerate(raw):
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            at = seen[t[p : p + span]]
            if len(at) > 1 and not (keep_first and at[0] == (i, p)):
                gone[p : p + span] = b"\1" * span
        out.append(bytes(gone))
    return raw, out


def repeat_texts():
    rng = random.Random(5)
    filler = lambda n: "".join(rng.choice("abcdefgh éß") for _ in range(n))
    passage, short = filler(450), filler(150)
    texts = [filler(rng.randint(0, 900)) for _ in range(12)]
    texts += [filler(rng.randint(0, 300)) + passage + filler(rng.randint(0, 300)) for _ in range(9)]
    texts += [filler(100) + short + filler(200) for _ in range(6)] + [passage, passage, "ab" * 400, "Te " * 300, filler(300) * 2, "", None]
    return texts


@pytest.mark.parametrize("group", [512, 1])
def test_repeats_match_brute_force(spark, monkeypatch, group):
    import driftwood.llm.repeats as rp

    monkeypatch.setattr(rp, "GROUP", group)
    texts = repeat_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    got = {r.doc_id: r for r in with_ranges(docs.drop("h")).mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()}
    for i, (t, gone) in enumerate(zip(*brute_removed(texts, 200), strict=True)):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("group", [512, 1])
def test_first_copies_stay(spark, monkeypatch, group):
    import driftwood.llm.repeats as rp
    from pyspark.sql import functions as F

    monkeypatch.setattr(rp, "GROUP", group)
    texts = [t for t in repeat_texts() if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("h"), "text")
    assert KEY == ["doc_id", "h"]
    ranges = repeated_ranges(docs, keep_first=True).collect()
    for i, (t, gone) in enumerate(zip(*brute_removed(texts, 200, True), strict=True)):
        own = bytearray(len(t))
        for r in ranges:
            if r.doc_id == i:
                own[r.first : r.end] = b"\1" * (r.end - r.first)
        assert bytes(own) == gone, i


def test_longest_matches_are_exact():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    span = 24
    starts = np.arange(len(data) - span + 1)
    order, common = suffix_order(data, starts, span)
    earlier, later = longest_matches(order, common)
    match = lambda i, j: next((k for k in range(span) if data[i + k] != data[j + k]), span)
    for i in starts:
        assert earlier[i] == max((match(i, j) for j in range(i)), default=0)
        assert later[i] == max((match(i, j) for j in range(i + 1, len(starts))), default=0)


def test_repeats_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert with_ranges(spark.createDataFrame([], schema)).count() == 0
    rows = with_ranges(spark.createDataFrame([(7, "q" * 100 + "z" * 150), (7, "q" * 100 + "z" * 150), (None, None)], schema)).collect()
    assert sum(r.ranges is not None for r in rows) == 2 and len(rows) == 3


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    hub = rng.normal(size=16)
    x[100:180] = hub + 0.15 * rng.normal(size=(80, 16))
    x[200:203] = x[5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None], 0), (904, [], 0), (5, x[5].tolist(), 0)]
    got = {}
    for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"), shards=3).collect():
        got.setdefault(r.vec_id, []).append(r)
    ids = list(range(400)) + [5]
    full = np.vstack((x, x[5]))
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9 - 1e-12
    np.fill_diagonal(link, False)
    comp = np.array(ids)
    while True:
        new = np.array([min(comp[i], *comp[link[i]]) if link[i].any() else comp[i] for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    found = sum(got[i][0].n_links for i in range(400))
    assert 0.99 * link[:400].sum() <= found <= link[:400].sum()
    assert sum(got[i][0].component_id == comp[i] for i in range(400)) >= 398
    assert len(got[5]) == 2 and all(r.n_links == link[5].sum() for r in got[5])
    for i in range(900, 905):
        assert (got[i][0].n_links, got[i][0].component_id, got[i][0].kept) == (0, i, True)


def test_no_vectors(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_dense_group_does_not_decide_the_audit():
    from driftwood.llm import embeddings as em

    rng = np.random.default_rng(6)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = lambda x, by: unit(x + by * unit(rng.normal(size=x.shape)))
    one = unit(rng.normal(size=(1, 32)))
    firsts = unit(rng.normal(size=(600, 32)))
    v = np.concatenate((near(np.repeat(one, 1000, 0), 0.2), firsts, near(firsts, 0.3), unit(rng.normal(size=(800, 32)))))
    order = rng.permutation(len(v))
    place = np.argsort(order)
    v = v[order]
    graph, own = em.Graph(v), np.arange(len(v))
    found = graph.near(v, 0.9, graph.audited_width(v, 0.9, own))
    pairs = [(place[1000 + k], place[1600 + k]) for k in range(600)]
    pairs = [(a, b) for a, b in pairs if v[a] @ v[b] >= 0.9001]
    assert len(pairs) > 500 and np.mean([b in found[a] and a in found[b] for a, b in pairs]) >= 0.99
    hidden = {int(x) for p in pairs for x in p}
    graph.links[0][np.isin(graph.links[0], list(hidden))] = -1  # nothing leads to the pairs any more
    assert graph.audited_width(v, 0.9, own) > em.FIRST_BEAM


def test_opposite_links_are_chosen_by_similarity():
    from driftwood.llm import embeddings as em

    angle = np.concatenate(([0.0], np.linspace(1.5, 0.01, 300)))
    v = np.stack((np.cos(angle), np.sin(angle)), 1).astype(np.float32)
    links = np.full((301, 48), -1, np.int32)
    links[1:, 0] = 0
    em._back(links, v, 1, 301, 48)
    assert 300 in links[0]


def test_dense_group_and_shared_ids_lose_no_link(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1600, 24))
    x[:1000] = x[0] + 0.1 * rng.normal(size=(1000, 24))  # 1000 near-equal vectors
    x[1000:1003] = x[1003] + 0.02 * rng.normal(size=(3, 24))
    ids = list(range(1600))
    ids[1599] = 1001  # another vector under an id of a linked one
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    out = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=3).collect()
    got = {}
    for r in out:
        got.setdefault(r.vec_id, []).append(r)
    n = sum(r.n_links for r in out)
    assert len(out) == 1600 and 0.999 * link.sum() <= n <= link.sum()
    assert {got[i][0].component_id for i in range(1000)} == {0} and {got[i][0].component_id for i in (1000, 1002, 1003)} == {1000}
    assert sorted(r.n_links for r in got[1001]) == sorted([link[1001].sum(), link[1599].sum()])
    assert sorted(r.component_id for r in got[1001]) == [1000, 1001]
    assert all(r.audited_recall >= 0.99 for r in out)


def test_extreme_lengths_of_vectors(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1.0, 1.0]), (4, [1.0, -1.0]), (5, [-1.0, -1.0]), (6, [1.0])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


def test_repeated_ids_with_different_texts_keep_their_links(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a, b = (" ".join(word() for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, b + " z"), (3, a + " y"), (3, a + " y")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False)]


def test_long_chains_are_one_component(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = [" ".join(words[4 * i : 4 * i + 100]) for i in range(60)]  # each like the next, the ends unlike each other
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert [got[i] for i in range(60)] == brute_components(texts, 5, 80, 100)[1] == [0] * 60
