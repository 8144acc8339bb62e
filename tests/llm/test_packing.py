"""op2: an exact round trip, and the number of sequences against the least possible."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sextant.llm import packing

TEXTS = [None, "", "a", "Hello, world! <|endoftext|> x", "  \n\n tabs\t   é 漢字 🙂🙂", " " * 5000, "x" * 9000, "the quick brown fox " * 1000, "1 22 333 4444 " * 200, "'s't're DON'T", "a\r\n\r\n b", "word " * 1023, "word " * 1022]


def test_ids():
    path = public_tokenizers.path(packing.TOKENIZER)
    slow = Tokenizer.from_file(path)
    assert packing.encoder(path)([t or "" for t in TEXTS]) == [slow.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("parts", [1, 7])
def test_round_trip(spark, parts):
    r = random.Random(1)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "a", None), (None, "b", None)] + [(100 + i, "word " * r.randint(1, 2500), "") for i in range(150)] + [(900, "copy of this", "")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(parts)
    out = packing.pack(df, with_ids=True)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = out.collect()
    slow = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for d, t, _ in rows:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for v in held.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(held) <= 1.05 * -(-total // 1024) + 1
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(out).collect()} == {k: sum(n for _, n in v) for k, v in held.items()}


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_search_helps():
    r = random.Random(2)
    for _ in range(5):
        counts = dict(Counter(r.choice([r.randint(200, 520), r.randint(20, 1000)]) for _ in range(900)))
        first = packing.best_fit(counts, 1024)
        after = packing.local_search(first, 1024)
        for bins in (first, after):
            assert Counter({k: v for k, v in counts.items()}) == sum((Counter({x: n * p.count(x) for x in set(p)}) for p, n in bins.items()), Counter())
            assert max(map(sum, bins)) <= 1024
        assert sum(after.values()) <= sum(first.values())
    assert packing.local_search(Counter({(600,): 2, (500,): 1}), 1024) == Counter({(600,): 2, (500,): 1})
    assert sum(packing.local_search(Counter({(500, 300): 1, (700, 100): 1, (224, 224): 1}), 1024).values()) == 2


def test_search_covers_every_underfull_bin():
    for n in (1, 100, 2000, 10**6):  # a length's bins all alike, however many: the share that goes is the same
        counts = {522: 6 * n, 276: 6 * n, 266: 6 * n, 236: 12 * n}
        first = packing.best_fit(counts, 1024)
        after = packing.local_search(first, 1024)
        assert sum(first.values()) == 11 * n
        assert sum(after.values()) <= 10.6 * n
        assert counts == sum((Counter({x: k * p.count(x) for x in set(p)}) for p, k in after.items()), Counter())
        assert max(map(sum, after)) <= 1024


def test_search_ends_where_no_exchange_helps():
    r = random.Random(3)
    for _ in range(30):
        counts = dict(Counter(r.randint(20, 95) for _ in range(r.randint(20, 60))))
        after = packing.local_search(packing.best_fit(counts, 100), 100)
        if sum(after.values()) == -(-sum(k * n for k, n in counts.items()) // 100):
            continue
        for a in after:
            for b in after:
                if a == b and after[a] < 2 or sum(a) > sum(b):
                    continue
                gives = [*a, *(a[i] + a[j] for i in range(len(a)) for j in range(i))]
                assert not [x for x in a if sum(b) + x <= 100]
                assert not [(x, y) for x in gives for y in b if x > y and sum(b) + x - y <= 100]
