import hashlib
import random

import numpy as np
import pytest

from quadtide.llm import induced, repeats
from quadtide.llm.repeats import LAST, SLAB, Repeats, anchors, gather, hashed, pieces, places, remove, with_partner, without

SCHEMA = "doc_id long, text string"


def brute(docs, window=50):
    """Removed bytes by a table of all windows."""
    least = {}
    rows = [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in rows:
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            least[w] = min(least.get(w, i), i)
    out = []
    for (name, _), (i, b) in zip(docs, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if least[b[p : p + window]] < i:
                gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and (not p or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((name, len(b), runs, sum(gone), kept))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    return sorted(((r.id, r.n_bytes, len(r.runs), sum(s.end - s.start for s in r.runs), bytes(r.kept)) for r in rows), key=str)


def corpus(n, seed=1):
    """Texts with shared passages of all lengths around the window, copies, runs of one letter and small alphabets."""
    rng = random.Random(seed)
    say = lambda k, letters="abcdefghij klmno é€": "".join(rng.choice(letters) for _ in range(k))
    passages = [say(rng.choice([30, 49, 50, 51, 60, 200, 700])) for _ in range(12)] + ["x" * 300, "ab" * 120, " " * 51]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            at = rng.randrange(len(p))
            parts += [say(rng.randint(0, 40)), rng.choice([p, p, p[at:], p[:at]])]
        docs.append((i, "".join(parts)))
    docs += [(n + i, docs[rng.randrange(n)][1]) for i in range(n // 3)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("chunk, memory, base", [(1 << 16, 1 << 20, 1 << 20), (64, 500, 8), (7, 0, 1)])
def test_order_and_common_prefixes(monkeypatch, chunk, memory, base):
    monkeypatch.setattr(induced, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        letters, n, depth = rng.choice([1, 2, 3, 20, 200]), rng.choice([1, 2, 5, 30, 300]), rng.choice([2, 5, 50])
        t = [rng.randint(1, letters) for _ in range(n)]
        t += rng.choice([[], t[: n // 2] + [1] + t, [rng.randint(1, letters)] * rng.randint(1, 300)])
        t = np.array([*t, 0], np.uint8)
        raw, got = bytes(t), [int(e) for part in induced.descending(t, 0, depth, memory, base) for e in part]
        at = [e >> 8 for e in got]
        assert sorted(at) == list(range(len(t) - 1))
        heads = [raw[p : p + depth] for p in at]
        assert heads == sorted(heads, reverse=True)
        for x, y, e in zip(at, at[1:], got[1:]):
            k = 0
            while k < depth and max(x, y) + k < len(raw) and raw[x + k] == raw[y + k]:
                k += 1
            assert e & 255 == k


def test_anchors_are_those_of_each_window():
    x = np.frombuffer(random.Random(3).randbytes(400), np.uint8) % 4
    for conf in (Repeats(), Repeats(window=9, anchor=6), Repeats(window=16, anchor=16)):
        got = anchors(x, conf)
        assert len(got) == 401 - conf.window
        assert [int(anchors(x[i : i + conf.window], conf)[0]) for i in range(len(got))] == got.tolist()


def test_pieces_cover_each_window_once():
    rng = random.Random(4)
    texts = [rng.randbytes(rng.choice([0, 3, 49, 50, 51, 700])) for _ in range(40)] + [b"z" * 900]
    x, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    conf, seen = Repeats(longest=64), []
    for d, s, n, _ in zip(*pieces(x, ends, conf)):
        assert n - 49 <= 64
        begin = int(ends[d]) - len(texts[d])
        seen += [(int(d), int(s) - begin + k) for k in range(n - 49)]
    assert seen == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - 49)]


@pytest.mark.parametrize("conf", [Repeats(), Repeats(shard=4000, memory=3000, longest=20)])
def test_equals_a_table_of_all_windows(spark, conf):
    docs = corpus(90)
    want = brute(docs)
    assert found(remove(spark.createDataFrame(docs, SCHEMA), conf=conf)) == want
    assert sum(w[3] for w in want) > 1000 and any(w[3] == 0 < w[1] for w in want)


def test_long_texts_are_cut_in_slabs(spark):
    """Passages on and around the edges of slabs, in one text of several slabs and in short ones."""
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh") for _ in range(2 * SLAB + 500))
    docs = [(5, long), (9, "x" + long[SLAB - 70 : SLAB + 60] + "y"), (7, long[SLAB - 25 : SLAB + 25]), (8, long[2 * SLAB - 49 : 2 * SLAB + 1]), (6, long[SLAB - 24 : SLAB + 25])]
    assert found(remove(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_no_ids_and_repeated_ids(spark):
    docs = corpus(30, 2)
    docs = [(None if i % 5 == 0 else i // 3, t) for i, t in docs] + docs[:4] + docs[:4]
    assert found(remove(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_query(spark, tmp_path):
    from quadtide.llm.queries import op12_repeats

    docs = corpus(40, 3)
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_spans, r.n_removed, r.kept_sha256) for r in op12_repeats(spark, str(tmp_path)).collect()}
    assert got == {i: (n, s, m, hashlib.sha256(k).hexdigest()) for i, n, s, m, k in brute(docs)}


def test_odd_rows(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(remove(odd)) == brute(docs)
    assert remove(none).count() == 0


def test_pieces_are_sorted_only_with_a_common_stretch(spark, monkeypatch):
    """Phrases shorter than a window share anchors, but nothing that could be a window."""
    rng = random.Random(11)
    say = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    phrases = [say(24) for _ in range(20)]
    docs = [(i, "".join(x for _ in range(30) for x in (say(30), rng.choice(phrases)))) for i in range(40)]
    # What copies share is decided by equal pieces.
    docs += [(40 + i, t) for i, t in docs[:5]]

    def sort(*_):
        raise AssertionError("sorted")

    monkeypatch.setattr(repeats, "descending", sort)
    got = found(remove(spark.createDataFrame(docs, SCHEMA)))
    assert got == brute(docs) and sum(r[3] for r in got) == sum(len(t) for _, t in docs[:5])


@pytest.mark.parametrize("window, anchor, letters", [(50, 16, 4), (9, 6, 3), (16, 16, 2), (12, 4, 1)])
def test_no_common_window_is_left_out(window, anchor, letters):
    conf, rng = Repeats(window=window, anchor=anchor), random.Random(window)
    for _ in range(30):
        say = lambda k: bytes(rng.randrange(letters) + 97 for _ in range(k))
        shared = [say(window + rng.randint(-2, 3)) for _ in range(4)] + [say(2) * window]
        texts = [b"".join(x for _ in range(4) for x in (say(rng.randint(0, 9)), rng.choice(shared))) for _ in range(8)]
        x, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        hashes = hashed(x, anchor)
        doc, start, size, low = pieces(x, ends, conf, hashes)
        place = places(hashes, start, low, conf)
        assert (hashes[start + place] == low).all()
        text = gather(x, start, size)
        kept = set(with_partner(text, size, low, place, doc, conf).tolist())
        own = [{text[a + k : a + k + window].tobytes() for k in range(n - window + 1)} for a, n in zip(np.cumsum(size) - size, size)]
        for i in range(len(own)):
            assert i in kept or not any(doc[i] != doc[j] and own[i] & own[j] for j in range(len(own)))


def test_what_is_left():
    assert without(b"0123456789", [(4, 6), (1, 3), (3, 4), (8, 9)]) == (b"0679", [(1, 6), (8, 9)])
    assert without(b"", []) == (b"", [])
