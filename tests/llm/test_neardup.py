import random
import re

import pytest

from quadtide.llm.common import Shingler
from quadtide.llm.neardup import NearDup, common_counts, keep_one, near_duplicates

CONF = NearDup(k=3, num=85, den=100)


def shingles(text, k):
    """Sets of word tuples, without hashing."""
    words = [w.lower() if w.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def components_of(texts, conf):
    """(set size, component) by place, from all pairs."""
    sets, root = [shingles(t, conf.k) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(sets[a] & sets[b])
            if common and conf.den * common >= conf.num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def brute(docs, conf):
    docs = sorted(docs)
    return {docs[i][0]: (n, docs[top][0]) for i, (n, top) in enumerate(components_of([t for _, t in docs], conf))}


@pytest.fixture(scope="module")
def family():
    """Copies, chains that drift away from their start, and look-alikes just below the threshold."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    docs, n = [], 0
    for _ in range(12):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(14):
            docs.append((n, " ".join(text)))
            n += 1
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
    return docs


def test_equals_all_pairs(spark, family):
    got = near_duplicates(spark.createDataFrame(family, "doc_id long, text string"), conf=CONF).collect()
    assert {r.id: (r.n, r.component) for r in got} == brute(family, CONF)


def test_documents_without_an_id_are_linked(spark, family):
    """Ids of every third document only, and some ids twice with other texts."""
    docs = [(None if i % 3 else i // 2, t) for i, t in family] + [(None, "alone without an id in the whole table")]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), conf=CONF)
    found = components_of([t for _, t in docs], CONF)
    least = {}
    for (i, _), (_, top) in zip(docs, found):
        least[top] = min((x for x in (least.get(top), i) if x is not None), default=None)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, n, least[top]) for (i, _), (n, top) in zip(docs, found)), key=key)
    kept = keep_one(spark.createDataFrame(docs, "doc_id long, text string"), conf=CONF).collect()
    assert len(kept) == len(least) and sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(x for x in least.values() if x is not None)


def test_pairs_within_a_group_are_not_needed(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base + [f"tail{i}"])) for i in range(700)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), conf=CONF).collect()
    assert {r.component for r in got} == {0} and len(got) == 700


def test_odd_rows(odd, none):
    got = near_duplicates(odd, conf=CONF).collect()
    by = {r.id: (r.n, r.component) for r in got if r.id is not None}
    assert len(got) == 13
    assert by[1] == by[2] == by[3] == (10, 1)
    assert by[4] == (0, 4) and by[5] == (0, 5) and by[6] == (0, 6)
    assert by[7][1] == by[8][1] == 7 and by[9] == (1, 9)
    assert sorted((r.n, r.component) for r in got if r.id is None) == [(0, None), (3, None)]
    assert near_duplicates(none, conf=CONF).count() == 0


def test_keep_one(odd, none):
    got = keep_one(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 9, 10]
    assert keep_one(none).count() == 0


def test_common_counts():
    sets = [Shingler(1)(t) for t in ("a b c", "b c d", "x", "a b c d")]
    assert common_counts(sets).tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]


def test_words_are_split_at_ascii_white_space_only():
    s = Shingler(2)
    assert s("A b").tolist() == s("a\x0b\x0cB").tolist()
    assert s("a b c").tolist() != s("a b c").tolist()
    assert len(s("Ä x")) == 1 and s("Ä x").tolist() != s("ä x").tolist()
