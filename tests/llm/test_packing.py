import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import corpus, documents

from sievewright.llm import packing


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    return [[*e.ids, packing.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from(" \t\n\r.,!|'’sStdé<|>İΣ1"), max_size=60), max_size=6))
def test_words_equal_the_tokenizer(texts):
    words = packing._words.setdefault("test", packing.Words(packing.vocabulary()))
    assert [[*x.tolist(), packing.END] for x in words.ids(texts)] == reference(texts)


def test_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    words = packing.Words(packing.vocabulary())
    for _ in range(2):
        assert [[*x.tolist(), packing.END] for x in words.ids(["a b c, don't stop", "<|endoftext|> a", ""])] == reference(["a b c, don't stop", "<|endoftext|> a", ""])
        assert len(words.known) <= 3


def test_encoding_a_batch_takes_few_times_its_room():
    import tracemalloc

    words = packing.Words(packing.vocabulary())
    rng = random.Random(3)
    texts = pa.array([" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9)}" for _ in range(1000)) for _ in range(1000)], pa.large_string())
    first = words.ids(texts)
    tracemalloc.start()
    again = words.ids(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(x, y) for x, y in zip(first, again)) and len(again) == 1000
    total = sum(map(len, again))
    assert peak < 2 * (4 * total + 8 * 1_000_000), (peak, total)  # ids, and a place for each word, not several for each id
    assert [[*x.tolist(), packing.END] for x in first[:3]] == reference(texts.to_pylist()[:3])


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(3).integers(1, 1025, 3000)
    at = packing.partition(sizes)
    sums = np.bincount(at, sizes)
    assert sums.max() <= packing.CAPACITY and sizes.sum() / len(sums) / packing.CAPACITY > 0.99
    assert packing.partition(np.array([4096, 1, 4096])).tolist() in ([0, 1, 2], [1, 2, 0], [2, 0, 1], [0, 2, 1], [1, 0, 2], [2, 1, 0])


def test_round_trip(spark):
    rows = [r for r in corpus() if r[0] is not None] + [(2003, "one", "en", "s2")]
    ids = defaultdict(list)
    for (i, *_), x in zip(rows, reference([t for _, t, *_ in rows])):
        ids[i].append(x)
    got = [r.asDict() for r in packing.pack(documents(spark, rows), group=64).collect()]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        n = len(ids[i])
        assert sum(r["length"] for r in own) == sum(map(len, ids[i]))
        x = ids[i][0]
        for r in own:
            assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4"))
        starts = sorted(r["start"] for r in own)
        assert starts == sorted(s for s in set(starts) for _ in range(n))
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert own[-1]["offset"] + own[-1]["length"] <= packing.CAPACITY


def test_empty_and_null(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    got = packing.pack(documents(spark, [(1, None, None, None), (2, "", None, None)])).collect()
    assert [(r.length, r.doc_tokens, r.ids_crc32) for r in got] == [(1, 1, zlib.crc32(np.array([2], "<u4")))] * 2


def test_random_sizes_fit():
    rng = random.Random(5)
    for _ in range(20):
        sizes = np.array([rng.randint(1, 1024) for _ in range(rng.randint(1, 60))])
        assert np.bincount(packing.partition(sizes), sizes).max() <= packing.CAPACITY
