import numpy as np
import pytest

from driftwood.operators import graph


@pytest.mark.parametrize("whole", [64, 3, 0])
def test_best_similarities_send_no_pairs_of_small_sets(spark, monkeypatch, whole):
    rng = np.random.default_rng(5)
    q = {i: set(rng.choice(9, rng.integers(1, 6), False).tolist()) for i in range(60)} | {60: {77}, 61: {0, 77}}
    r = {1000 + i: set(rng.choice(9, rng.integers(1, 6), False).tolist()) for i in range(60)}
    sizes, write = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: [out := write(df), sizes.append(out.count())][0])
    monkeypatch.setattr(graph, "WHOLE", whole)
    frame = lambda sets: spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, token long")
    got = {x.q: x.max_jaccard for x in graph.max_jaccard(frame(q), frame(r)).collect()}
    want = {i: max(len(s & o) / len(s | o) for o in r.values()) for i, s in q.items()}
    assert got == pytest.approx({i: v for i, v in want.items() if v})
    if whole == 64:
        assert max(sizes) <= sum(map(len, r.values())) + sum(map(len, q.values()))  # thousands of pairs before
