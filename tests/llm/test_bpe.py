import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tables import corpus, documents, prose

from sievewright.llm import bpe, packing
from sievewright.llm.transducer import Transducer, _states, compiled

PATH = packing.vocabulary()
MERGES = bpe._merging(PATH)


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


LIBRARY = library()
WORDS = st.text("abé", min_size=1, max_size=7).map(str.encode)


def look_up(words: Transducer, asked: list[bytes]) -> list[list[int] | None]:
    rank = words.ranks(np.frombuffer(b"".join(asked), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in asked], dtype=np.int64)]))
    return [None if r < 0 else words.flat[words.starts[r] : words.starts[r + 1]].tolist() for r in rank.tolist()]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(WORDS, st.lists(st.integers(0, 9), max_size=3), max_size=40), st.lists(WORDS, max_size=20))
def test_transducer_equals_a_dictionary(entries, others):
    asked = [*entries, *others]
    assert look_up(Transducer(compiled(entries)), asked) == [entries.get(w) for w in asked]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), min_size=1, max_size=40))
def test_transducer_is_minimal(words):
    """As many states as there are different sets of endings."""
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert Transducer(compiled({w: [1] for w in words})).states == len(endings)
    assert _states(sorted(words))[2] == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from(" \t\n\r.,!|'’sStdé<|>İΣ1"), max_size=60), max_size=6), st.booleans())
def test_texts_equal_the_library(texts, known):
    words = [w for w in ("the", "a", "s", ".", "'s", "été", "|") if known]
    symbols, counts = MERGES.ids(words)
    cut = np.split(symbols, np.cumsum(counts)[:-1]) if words else []
    lexicon = Transducer(compiled({w.encode(): x.tolist() for w, x in zip(words, cut)}))
    got = bpe._encoded(pa.array(texts, pa.large_string()), MERGES, lexicon)
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert got.to_pylist() == want
    assert bpe.Pieces(PATH).texts(got).to_pylist() == [LIBRARY.decode(x, skip_special_tokens=False) for x in want]


def test_words_of_any_length():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (1, 2, 255, 256, 257, 5000, 60_000)] + ["a" * 1000, "ab" * 700, "é" * 300, "aaa", "aaaa"]
    for w in words:
        assert MERGES.ids([w])[0].tolist() == LIBRARY.encode(w, add_special_tokens=False).ids
    symbols, counts = MERGES.ids([*words, "<|endoftext|>x<|startoftext|>", ""])
    assert symbols.tolist() == [i for e in LIBRARY.encode_batch([*words, "<|endoftext|>x<|startoftext|>", ""], add_special_tokens=False) for i in e.ids] and counts[-1] == 0


def test_ids_out_of_the_vocabulary():
    lists = [[49407, 320], [10**6, 320, -1, 320], [10**6], [], [49408]]
    got = bpe.Pieces(PATH).texts(pa.array(lists, pa.list_(pa.int32()))).to_pylist()
    assert got == [LIBRARY.decode([i for i in x if i >= 0], skip_special_tokens=False) for x in lists]


def test_round_trip(spark, monkeypatch):
    rng = random.Random(7)
    rows = corpus() + [(7000, "x" * 70_000 + " End.", "en", "s"), (7001, "<|endoftext|> The<|startoftext|>End <|ENDOFTEXT|>", None, None), (7002, "naïve İstanbul ẞ Σσς café x y", "fr", None), (2003, "one", "en", "s2")]
    rows += [(7100 + i, prose(rng, 50).upper(), "en", "s") for i in range(5)]
    want = sorted([(i, x := LIBRARY.encode(t or "", add_special_tokens=False).ids, LIBRARY.decode(x, skip_special_tokens=False)) for i, t, *_ in rows], key=repr)
    for size in (300, 0):
        made = bpe.encode(documents(spark, rows), size=size)
        got = made.select("doc_id", "ids", bpe.decode(F.col("ids")).alias("text"), bpe.ids_sha256(F.col("ids")).alias("sha")).collect()
        assert sorted([(r.doc_id, r.ids, r.text) for r in got], key=repr) == want
        assert all(r.sha == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in got)


def test_frequent_words_cover_all_texts(spark):
    counts = {r.word: r.n for r in bpe.word_counts(documents(spark, [(1, "A b a", "", ""), (2, "b\tb", "", ""), (3, None, "", ""), (4, "y" * 65, "", "")])).collect()}
    assert counts == {"a": 2, "b": 3}


def test_empty_table_and_text_ids(spark):
    assert bpe.encode(documents(spark, [])).count() == 0
    docs = spark.createDataFrame([("k", "", 1), (None, None, 2)], "doc_id string, text string, ids int")
    assert sorted(map(tuple, bpe.encode(docs).collect()), key=repr) == [("k", []), (None, [])]
