import hashlib

import numpy as np
from tables import corpus, documents, prose

from sievewright.llm import fingerprint as fp


def brute(data: bytes):
    """Feature places by the definition, window by window."""
    if len(data) < fp.WINDOW:
        return [0] if data else []
    n = len(data) - fp.WINDOW + 1
    rank = [sum(fp._F[c] for c in np.bincount(np.frombuffer(data[i : i + fp.WINDOW], np.uint8))) for i in range(n)]
    votes = [0] * n
    for j in range(n - fp.AROUND + 1):
        votes[j + int(np.argmin(rank[j : j + fp.AROUND]))] += 1
    return [i for i in range(n) if votes[i] >= fp.VOTES] or [int(np.argmin(rank))]


def test_features_equal_brute_force():
    texts = [(t or "").encode() for _, t, *_ in corpus() if t is None or len(t) < 3000] + [b"a" * 300, b"ab" * 200, bytes(range(256)) * 2]
    for data, got in zip(texts, fp.features(texts)):
        assert got.tolist() == brute(data)


def test_tail_is_read_alone():
    import random

    rng = random.Random(4)
    for words in (1, 5, 60, 300, 900):
        text, after = prose(rng, words), prose(rng, 400)
        edited = fp._edit(text, after)
        mine, theirs = fp._digests([(text, edited)])[0]
        assert fp.written_as(mine) == fp.fingerprint(text) and fp.written_as(theirs) == fp.fingerprint(edited)
        if words > 4:
            assert 0.4 < fp.likeness(mine, theirs) < 1 and fp.likeness(mine, fp.read_from(fp.fingerprint(after))) < 0.1


def test_likeness():
    a, none = fp.read_from(fp.fingerprint("x" * 40 + "yes")), fp.read_from(fp.fingerprint(""))
    assert fp.likeness(a, a) == 1 and fp.likeness(none, none) == 1 and fp.likeness(a, none) == 0 == fp.likeness(none, a)
    assert fp.fingerprint("") == "0:"


def test_edits(spark):
    rows = corpus()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    got = {r.doc_id: r for r in fp.compare_edits(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(order):
        t, after, r = t or "", order[(k + 1) % len(order)][1] or "", got[i]
        edited = fp._edit(t, after)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp.fingerprint(t) and r.edited_fingerprint == fp.fingerprint(edited)
        assert r.near_edited == fp.likeness(*(fp.read_from(x) for x in (r.fingerprint, r.edited_fingerprint)))
        assert r.near_next == fp.likeness(fp.read_from(r.fingerprint), fp.read_from(fp.fingerprint(after)))


def test_few_rows(spark):
    assert fp.compare_edits(documents(spark, [])).count() == 0
    alone = fp.compare_edits(documents(spark, [(5, "abcdefgh" * 9, None, None)])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    twice = fp.compare_edits(documents(spark, [(5, "abcd", None, None)] * 2 + [(6, None, None, None)])).collect()
    assert sorted(r.edited_sha256 for r in twice) == sorted(hashlib.sha256(x).hexdigest() for x in (b"abca", b"abc", b""))
    assert fp.fingerprints(documents(spark, [(5, "abcd", None, None), (6, None, None, None)])).count() == 2


def test_likeness_falls_smoothly_with_length():
    """No length of the text or its edited form decides by itself."""
    import random

    means = []
    for n in range(200, 420, 20):
        got = []
        for seed in range(30):
            rng = random.Random(1000 * n + seed)
            text, after = prose(rng, 200)[:n], prose(rng, 200)
            got += [fp.likeness(*(fp.read_from(fp.fingerprint(x)) for x in (text, fp._edit(text, after)))), fp.likeness(*(fp.read_from(fp.fingerprint(x)) for x in (text, text[: n * 4 // 5])))]
        means.append(np.mean(got))
    assert min(means) > 0.6 and max(abs(a - b) for a, b in zip(means, means[1:])) < 0.08


def test_ranges_are_level_and_ids_of_any_type(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    rows = [(10**15 if i == 0 else None if i > 3900 else i, f"text {i}", "en", "s") for i in range(4000)]
    sizes = Counter(r.range for r in fp._followed(documents(spark, rows)).where("NOT extra").select("range").collect())
    assert len(sizes) == 4 and max(sizes.values()) < 2 * min(sizes.values())
    docs = documents(spark, [(i, f"the text of number {i} " * 3, "en", "s") for i in range(100, 140)])
    want = {str(r.doc_id): tuple(r)[1:] for r in fp.compare_edits(docs).collect()}
    for kind in ("string", "smallint", "decimal(20,0)", "int"):
        got = fp.compare_edits(docs.withColumn("doc_id", F.col("doc_id").cast(kind)))
        assert got.schema["doc_id"].dataType.simpleString() == kind and {str(r.doc_id): tuple(r)[1:] for r in got.collect()} == want
