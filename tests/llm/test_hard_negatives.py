import math
import random

import numpy as np
import pytest

from quadtide.llm.kronecker import Mining, first, hard_negatives, packed, scores

CONF = Mining(every=10, block=64, asked=8, strip=(5, 17))
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, conf):
    """Plain Python over all pairs; rows that repeat an id are told apart by their place."""
    ok = [(i, [math.floor(conf.scale * x) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, c in ok:
        if i % conf.every == 0 and (i not in anchors or (c, v) < anchors[i]):
            anchors[i] = (c, v)
    out = []
    for a, (c, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, k) for i, w, k in ok if i != a and len(w) == len(v))
        for minus, positive, _ in [t for t in scored if t[2] == c][: conf.positives]:
            fits = [t for t in scored if t[2] != c and conf.low * -minus <= -t[0] * conf.of <= conf.high * -minus]
            out += [(a, positive, n, i, -minus, -s) for n, (s, i, _) in enumerate(fits[: conf.negatives], 1)]
    return sorted(out)


def found(spark, rows, conf=CONF, schema=SCHEMA):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, schema), conf=conf).collect())


@pytest.mark.parametrize("limit", [0, 1, 3, 200, 10**6, 1 << 30, 1 << 70])
def test_packed_products_are_exact(limit):
    rng = random.Random(limit)
    make = lambda n: np.array([[rng.randint(-limit, limit) for _ in range(7)] for _ in range(n)], np.int64 if limit < 1 << 31 else object)
    a, c = make(9), make(23)
    assert scores(a, c, (4, 3)).tolist() == [[sum(x * y for x, y in zip(p, q)) for q in c.tolist()] for p in a.tolist()]
    assert scores(abs(a), abs(c)).tolist() == (abs(a).astype(object) @ abs(c).astype(object).T).tolist()


def test_fields_hold_several_candidates():
    c = np.array([[1, -2], [3, 4], [0, 0]])
    words = packed(c, 2, 8, 2)
    assert words.tolist() == [[3 + (5 << 8), 2], [0 + (6 << 8), 2]]


def test_first_takes_ties_by_place():
    s = np.array([1, 5, 5, 2, 5, 0, 5, 1, 1, 1, 1, 1, 1])
    assert first(s, 3).tolist() == [1, 2, 4] == first(s[:7], 3).tolist()


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], rng.choice([0, 0, 0, 1, 2, 7])) for i in range(400)]
    assert found(spark, rows) == brute(rows, CONF) != []


def test_ties_and_copies(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)], i % 3) for i in range(250)]
    rows += [(i, rows[40][1], 1) for i in range(250, 320)] + rows[30:40] + [(60, [0.5, 0.5, 0.5], 2), (60, [0.25, 0.5, 0.5], 0)]
    assert found(spark, rows) == brute(rows, CONF)


def test_odd_rows(spark):
    rows = [(10 * i, [0.1 * i, 0.5], i % 2) for i in range(8)] + [(10 * i + 1, [0.3, 0.1 * i], i % 2) for i in range(8)]
    rows += [(None, [0.5, 0.5], 1), (3, None, 1), (4, [0.5, None], 1), (5, [0.5, math.nan], 1), (6, [math.inf, 0.5], 0), (7, [0.5, 0.5], None)]
    rows += [(8, [], 1), (20, [], 1), (90, [0.2], 0), (92, [0.3], 0), (93, [0.1], 1), (-10, [0.4, 0.4], 1)]
    assert found(spark, rows) == brute(rows, CONF)


def test_other_columns_and_no_rows(spark):
    schema = SCHEMA + ", id string, row string, label2 int, PLACE int, one int, found int"
    rows = [(i, [0.1 * (i % 7), 0.2], i % 2) for i in range(40)]
    wide = [(*r, "x", None, 1, 2, 3, 4) for r in rows]
    assert found(spark, wide, schema=schema) == brute(rows, CONF)
    assert found(spark, []) == [] and found(spark, rows[1:9]) == []


def test_large_numbers(spark):
    rows = [(i, [1e9 * (i % 5 + 1), 2e9], i % 2) for i in range(20)]
    conf = Mining(every=10, scale=1)
    assert found(spark, rows, conf) == [r for r in brute(rows, conf)]
    assert len(found(spark, [(i, [1e300, 2.0], i % 2) for i in range(4)], conf)) == 0
