import math

import numpy as np
import pytest

from quadtide.llm import covertree, hilbert


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)) + 3 * rng.standard_normal((6, 16))[rng.integers(0, 6, 900)]
    x[300:600] = x[300]  # a third of all rows alike
    rows = [(i, [float(v) for v in np.float32(r)], "clash") for i, r in enumerate(x)]
    rows += [(2000, None, ""), (2050, [1.0, None] * 8, ""), (2100, [math.nan] * 16, ""), (2150, [math.inf] * 16, ""), (2200, [], ""), (None, [1.0] * 16, ""), (2300, [0.0] * 16, "")]
    rows.append(rows[50])
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string")


def usable(vectors, zero):
    out = {}
    for r in vectors.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v)):
            out[r.vec_id] = np.array(v, float)
    return out


def test_exact_search_equals_all_pairs(spark, vectors):
    conf = covertree.Trees(pivots=8, sample=200, block=100, asked=8, leaf=16)
    got = [tuple(r) for r in covertree.search(vectors, 50, 5, conf=conf).collect()]
    x = {i: np.floor(256 * v) for i, v in usable(vectors, True).items()}
    want = []
    for q in (i for i in x if i % 50 == 0):
        best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_traversal_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.standard_normal((2000, 3)) / 20 + np.eye(3)[rng.integers(0, 3, 2000)] * 4))
    q, ids, conf = x[:20], np.arange(2000), covertree.Trees(leaf=4)
    best, seen = covertree.Best(20, 5), 0
    offer = best.offer

    def counted(rows, scores, names):
        nonlocal seen
        seen += scores.size
        offer(rows, scores, names)

    best.offer = counted
    covertree.traverse(covertree.Node(q, np.arange(20), conf), covertree.Node(x, ids, conf), q, ids[:20], x, ids, best)
    for i in range(20):
        assert best.ids[i].tolist() == [j for _, j in sorted((-float(q[i] @ x[j]), j) for j in range(2000) if j != i)[:5]]
    assert seen < 20 * 2000 / 2


def test_neighbours_reach_their_recall(spark, vectors):
    got = hilbert.nearest(vectors, 20, 20, conf=hilbert.Curves(block=64, sample=400)).collect()
    x = usable(vectors, False)
    hits = total = 0
    for q in (i for i in x if i % 20 == 0):
        want = sorted((-float((x[q] * x[i]).sum()), i) for i in x if i != q)[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in {r.vec_id for r in mine}
        assert all(r.score == float((x[q] * x[r.vec_id]).sum()) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += sum(r.score >= -want[-1][0] for r in mine)
        total += 20
    assert hits >= 0.9 * total


def test_hilbert_steps_to_a_neighbouring_cell():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(hilbert.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in covertree.search(few, 50, 5).collect()] == [(0, 1, 1, 256 * 128)]
    assert [tuple(r) for r in hilbert.nearest(few, 20, 20).collect()] == [(0, 1, 1, 0.5)]
    assert covertree.search(few.limit(0), 50, 5).count() == 0 and hilbert.nearest(few.limit(0), 20, 20).count() == 0
