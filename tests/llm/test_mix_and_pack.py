import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadtide.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_targets_share_the_budget(spark):
    docs = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 11 else None) for i in range(3000)] + [(9000 + i, "w", "hot") for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    conf = mixing.Mix(bucket=200)
    got = mixing.shares(frame, conf=conf).withColumn("taken", mixing.taken(conf)).collect()
    size, target, taken = {}, {}, {}
    for r in got:
        size[r.skey] = size.get(r.skey, 0) + r["size"]
        target[r.skey] = r.target
        taken[r.skey] = taken.get(r.skey, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sorted(size))}
    level = {target[s] / weight[s] for s in size if target[s] < 2 * size[s]}
    assert max(level) - min(level) < 1e-6 * max(level)
    assert all(target[s] == 2 * size[s] for s in size if target[s] / weight[s] < max(level) * (1 - 1e-9))
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = mixing.shares(frame.repartition(7), conf=conf).withColumn("taken", mixing.taken(conf)).collect()
    assert sorted((r.id, r.taken) for r in again) == sorted((r.id, r.taken) for r in got)


def test_mix_holds_what_was_taken(odd, none):
    conf = mixing.Mix()
    plan = mixing.shares(odd, conf=conf).withColumn("taken", mixing.taken(conf)).collect()
    assert len(plan) == 13 and all(r.taken == 0 for r in plan if r["size"] == 0)
    out = mixing.mix(odd, conf=conf)
    assert out.columns == odd.columns
    assert out.select(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] == sum(r.taken for r in plan)
    assert mixing.shares(none).count() == 0 and mixing.mix(none).count() == 0


def test_tokens_equal_the_library():
    texts = ["", " \n", "Don't STOP, it's 2024!! a__b", "Été über İ K ΣαΣ", "x\x1cy z é", "<|endoftext|> a <|ENDOFTEXT|>", "foo, foo. FOO;; (bar) 1,000.50 \U0001F600!"]
    plain, fast = Tokenizer.from_file(PATH), packing.ChunkTokenizer(PATH)
    for _ in range(2):
        assert [x.tolist() for x in fast(texts, 2)] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert fast([None], 2)[0].tolist() == [2]


def check(rows, docs, length):
    plain = Tokenizer.from_file(PATH)
    want = sorted((i or -1, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs)
    pieces, used = {}, {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id or -1, []).append((r.start, r.ids))
    for parts in used.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert total == length or total & (total - 1) == 0
    flat = lambda x: sorted(t for ids in x for t in ids)
    for i in pieces:
        assert flat(p for _, p in pieces[i]) == flat(ids for d, ids in want if d == i)
    ids = [d for d, _ in want]
    for i, tokens in want:
        if ids.count(i) == 1:
            assert [t for _, p in sorted(pieces[i]) for t in p] == tokens


@pytest.mark.parametrize("group", [64, 700, 1 << 20])
def test_every_id_is_in_one_piece(spark, group):
    docs = [(i, "alpha beta, gamma. " * (i * i % 23)) for i in range(60)] + [(60, "long " * 3000)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), length=128, group=group, with_ids=True).collect()
    check(rows, docs, 128)


def test_odd_rows(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    check(packing.pack(odd, with_ids=True).collect(), docs, 4096)
    assert packing.pack(none).count() == 0


def test_costs_are_balanced():
    lengths = list(np.random.default_rng(2).integers(1, 4000, 400))
    room = [4096] * (sum(lengths) // 4096) + packing.powers(int(sum(lengths)) % 4096)
    pieces, over = packing.assign([int(n) for n in lengths], room, 1.0, 1 / 4096)
    assert not over and sum(p[2] for p in pieces) == sum(lengths)
    cost = np.zeros(len(room))
    for _, _, m, k, _ in pieces:
        cost[k] += m + m * m / 4096
    first = np.cumsum(lengths) // 4096  # documents as they come
    naive = np.bincount(first, weights=[n + n * n / 4096 for n in lengths])
    assert cost[np.array(room) == 4096].std() < naive.std()
