import random
import re
import zlib
from collections import Counter

import pytest

from quadtide.llm.spelling import Spelling, halves, near_pairs, signatures, variants

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    """Plain dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def brute(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = "".join(c for k, c in enumerate(run) if k != h % len(run))
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out, form = {}, {}
    for w in n:
        near = sorted((o for o in n if abs(len(o) - len(w)) < 2 and one_edit(w, o)), key=lambda o: (-n[o], o))
        if near and n[near[0]] >= 10 * n[w]:
            form[w] = near[0]
        out[w] = (n[w], len(near))
    for w in n:
        last = w
        while last in form:
            last = form[last]
        out[w] += (form.get(w), n.get(form.get(w)), last)
    return out


def found(spark, docs, schema=SCHEMA):
    rows = variants(spark.createDataFrame(docs, schema)).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def edited(rng, word, letters):
    at, c = rng.randrange(len(word)), rng.choice(letters)
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]])


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "ab", "aé÷ÿ"])
def test_no_near_pair_is_missed(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(60)}
    for _ in range(3):
        words |= {edited(rng, w, letters) for w in sorted(words)}
    words = sorted(words)[:600]
    got = near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), Spelling())
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_one_edit_keeps_a_signature_and_a_half():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
        b = edited(rng, a, "abcde")
        for parts in (3, 4, 5):
            assert set(signatures(a, parts)) & set(signatures(b, parts))
        assert set(halves(a)) & set(halves(b)) or not b
    assert len(signatures("signature", 5)) == 10


def test_equals_plain_python(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    docs = []
    for i in range(220):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.6)), 11)]
            for _ in range(rng.choice([0] * 40 + [1, 1, 2])):
                w = edited(rng, w, "abcdeé")
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "\n", "_", "9"]).join(words)))
    got = found(spark, docs)
    assert got == brute(docs)
    assert any(v[2] for v in got.values())


def test_chains_of_forms(spark):
    text = " ".join(["steppingx"] * 2 + ["steppings"] * 20 + ["stepping"] * 210 + ["stappings"] * 20 + ["tepping"] * 3)
    got = found(spark, [(None, text)])
    assert got == brute([(None, text)])
    assert got["steppingx"] == (2, 2, "stepping", 210, "stepping") and got["stappings"][4] == "stappings"


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants(odd).collect()}
    assert got == brute(rows) and "exactly" not in got
    assert variants(none).count() == 0
    long = [(1, "y" * 50_000 + " " + "y" * 50_000), (2, "y" * 50_001 + " " + "y" * 50_001), (3, "ÀÉÎÕÜÝß ÀÉÎÕÜÝß ÀÉÎÕÜÝS ÀÉÎÕÜÝs"), (4, ""), (4, None)]
    got = found(spark, long)
    assert {w: v for w, v in got.items() if len(w) < 100} == brute(long[2:])
    assert got["y" * 50_001][1] == 1
