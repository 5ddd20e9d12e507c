import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from tables import corpus, documents, edited, prose

from sievewright.llm import lattice, linedup, minhash
from sievewright.llm.common import components
from sievewright.tables import collected, drop_path


def smallest(ids, links):
    """The smallest id that each reaches."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest({x for p in links if p[0] != p[1] for x in p}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def near(rows, n, percent):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in smallest(sets, links).items()}


def family(seed):
    """Copies at all distances from a text that isn't there, a chain of edits, and texts in the same words."""
    rng = random.Random(seed)
    base, rows = prose(rng, 120), []
    for i in range(60):
        rows.append((i, edited(rng, base, rng.uniform(0, 0.14)), None, None))
    text = prose(rng, 90)
    for i in range(100, 130):
        rows.append((i, text, None, None))
        text = edited(rng, text, 0.02)
    for i in range(200, 230):
        rows.append((i, base[: rng.randint(20, len(base))], None, None))
    return rows


@pytest.mark.parametrize("percent", [60, 40])
def test_bands_follow_the_threshold(spark, percent):
    assert [minhash.rows_for(p) for p in (85, 80)] == [minhash.ROWS] * 2
    common, rows = percent, []
    for i in range(150):  # pairs of sets with `percent` words in common out of 100
        words = [f"w{i}_{k}" for k in range(100)]
        own = (100 - common) // 2
        rows += [(2 * i, " ".join(words[: common + own]), "en", "s"), (2 * i + 1, " ".join(words[:common] + words[common + own :]), "en", "s")]
    got = minhash.near_duplicates(documents(spark, rows), 1, percent).where("doc_id <> component_id").count()
    assert got == 150
    with pytest.raises(ValueError, match="reliably"):
        minhash.rows_for(5)


@pytest.mark.parametrize(("rows", "n", "percent"), [(corpus(), 3, 85), (family(1), 3, 85), (family(2), 5, 80), (family(3), 3, 60)], ids=["corpus", "family", "five", "loose"])
def test_near_duplicates_equal_brute_force(spark, rows, n, percent):
    rows = [r for r in rows if r[0] is not None]
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, rows), n, percent).collect()}
    want = near(rows, n, percent)
    assert {i: r.n_shingles for i, r in got.items()} == {i: s for i, (s, _) in want.items()}
    wrong = [i for i, r in got.items() if r.component_id != want[i][1]]
    assert not wrong if percent >= 80 else len(wrong) <= 0.1 * len(got)  # bands are laid out for 80 and more
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def within(spark, sets, percent, monkeypatch):
    """Links within one star around set 0, and the number of pairs compared besides those with the centre."""
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, shingles array<long>")
    shares = 1 + len(sets) // minhash.SHARE
    pairs = spark.createDataFrame([(0, i, i % shares, shares) for i in sets if i], "a long, b long, s int, shares int")
    measured = minhash._measured(pairs, table, percent)
    links = measured.where("linked").select("a", "b")
    odd = minhash._odd(minhash._members(measured, components(links), percent), table)
    sure = minhash._certain(odd, percent)
    compared, kept = [], minhash.written

    def count(df, name):
        out = kept(df, name)
        compared.append(out.count() if name == "met" else 0)
        return out

    monkeypatch.setattr(minhash, "written", count)
    more = minhash._within(minhash._labelled(odd, components(links.union(sure)), "b", "part"), percent)
    links = links.union(sure) if more is None else links.union(sure).union(more)
    found = {(r.a, r.b) for r in links.collect()}
    return found, sum(compared)


def test_within_a_star_is_exact(spark, monkeypatch):
    """Pairs that aren't both linked with the centre, from the differences alone."""
    rng, centre = random.Random(4), set(range(200))
    sets = {0: centre}
    for i in range(1, 90):
        s = set(rng.sample(sorted(centre), 200 - rng.randint(0, 50))) | {1000 * i + k for k in range(rng.randint(0, 30))}
        sets[i] = s
        if i % 4 == 0:  # one much like it, beyond the centre's reach
            sets[i + 500] = (s | {9_000_000 + i}) - {min(s)}
    sets[300] = centre | {-k for k in range(1, 33)}
    sets[301] = set(sorted(centre)[:168])
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    found, compared = within(spark, sets, 85, monkeypatch)
    assert all(link(*p) for p in found)
    assert smallest(sets, found) == smallest(sets, [p for p in combinations(sorted(sets), 2) if link(*p)])
    assert compared < len(sets) ** 2 / 8


@pytest.mark.parametrize("m", [20, 80])
def test_families_within_a_star_give_few_pairs(spark, monkeypatch, m):
    """Four families of m, none linked with the centre or another family: pairs grow with m, not with its square."""
    rng, centre = random.Random(m), set(range(200))
    sets = {0: centre}
    for f in range(4):
        base = (centre - set(range(20 * f, 20 * f + 20))) | {10_000 * (f + 1) + k for k in range(16)}
        for i in range(m):
            sets[1 + f * m + i] = base | {1_000_000 * (f + 1) + 10 * i + k for k in range(rng.randint(0, 3))}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert not any(link(0, i) for i in sets if i)
    found, compared = within(spark, sets, 85, monkeypatch)
    assert smallest(sets, found) == {i: 0 if i == 0 else (i - 1) // m * m + 1 for i in sets}
    assert compared <= 16 * m


def test_repeated_ids_lose_no_link(spark):
    """Each text of an id is searched, and one doesn't carry the other's links on."""
    rng = random.Random(9)
    one, two = prose(rng, 40), prose(rng, 40)
    rows = [(5, one, "en", "s"), (5, two, "en", "s"), (7, one + " more", "en", "s"), (9, two + " more", "en", "s"), (None, one, "en", "s"), (None, "alone here", "en", "s")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("9", "5", False), ("None", "5", False), ("None", "None", True)]
    rows = [(1, one, "en", "s"), (5, one, "en", "s"), (5, two, "en", "s"), (6, two + " more", "fr", "s"), (8, "", "en", "s"), (8, "", "en", "s"), (9, None, "en", "s"), (5, two, "de", "t")]
    out = minhash.dedup(documents(spark, rows))
    assert out.columns == documents(spark, rows).columns
    got = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert got == [(1, one), (5, two), (8, ""), (9, "")]
    assert minhash.dedup(documents(spark, [])).count() == 0
    versions = [(3, one, "en", "s"), (3, one + " more", "en", "s"), (3, one + " other", "en", "s")]
    assert minhash.dedup(documents(spark, versions)).count() == 1


def shuffled(spark, run):
    """What run() gives, and how many bytes it writes into shuffles, with no table small enough for a broadcast of Spark's."""

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        every = sc.statusStore().executorList(False).iterator()
        total = 0
        while every.hasNext():
            total += every.next().totalShuffleWrite()
        return total

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        return run(), written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_sets_leave_texts_where_they_are(spark):
    rng = random.Random(12)
    rows = [(None if i % 100 == 50 else i, prose(rng, 400), "en", "s") for i in range(300)]
    docs = minhash._keyed(documents(spark, rows)).cache()
    wanted = docs.where("doc_id IS NULL OR doc_id % 20 = 0").select("doc_id", "key")
    got, moved = shuffled(spark, lambda: minhash._whole_sets(docs, wanted, 3).collect())
    sets = {frozenset(r.shingles) for r in got}
    want, ends = minhash.shingle_sets(pa.array([t for i, t, *_ in rows if i is None or i % 20 == 0]), 3)
    assert {frozenset(x.tolist()) for x in np.split(want.view(np.int64), ends[:-1])} <= sets
    assert len(got) <= 40
    assert moved < sum(len(t) for _, t, *_ in rows) / 10
    docs.unpersist()


def test_near_duplicates_move_sets_twice_and_keep_no_bands(spark):
    """Whole sets go to their class and to their stars; buckets are deleted once stars are known."""
    rng = random.Random(13)
    rows = []
    for i in range(40):
        text = prose(rng, 1500)
        rows += [(2 * i, text, "en", "s"), (2 * i + 1, edited(rng, text, 0.01), "en", "s")]
    with collected() as paths:
        out, moved = shuffled(spark, lambda: minhash.near_duplicates(documents(spark, rows), 3, 85).collect())
    left = [c for p in paths for c in spark.read.parquet(p).columns]
    for p in paths:
        drop_path(spark, p)
    assert sorted((r.doc_id, r.component_id) for r in out) == [(i, i - i % 2) for i in range(80)]
    assert "digest" in left and "bands" not in left
    assert moved < 3 * sum(8 * r.n_shingles for r in out)


def test_shingle_sets_and_densification():
    texts = ["", None, " \t", "a", "A b", "a b c a b c", "x\x0by É É", "x y É é"]
    sets, ends = minhash.shingle_sets(pa.array(texts), 3)
    sizes = np.diff(ends, prepend=0).tolist()
    assert sizes == [len(shingles(t, 3)) for t in texts]
    keys = minhash.band_keys(sets, ends)
    assert keys.shape == (len(texts), minhash.BANDS)
    rng, agree = np.random.default_rng(1), []
    for n in (6, 40, 400):
        hits = []
        for _ in range(150):
            common = rng.integers(0, 1 << 63, round(n * 0.85), dtype=np.uint64)
            rest = rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)
            a, b = np.sort(np.concatenate([common, rest[::2]])), np.sort(np.concatenate([common, rest[1::2]]))
            k = minhash.band_keys(np.concatenate([a, b]), np.cumsum([len(a), len(b)]))
            hits.append((k[0] == k[1]).mean())
        agree.append(np.mean(hits))
    assert all(abs(x - 0.85**minhash.ROWS) < 0.08 for x in agree)


def test_near_duplicates_odd_rows(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    rows = [(5, "a b c d e f", None, None)] * 3 + [(4, "A B c d E f", None, None), (3, None, None, None), (2, "", None, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == [(2, 2, True), (3, 3, True), (4, 4, True)] + [(5, 4, False)] * 3


def removed(rows, least):
    """Remaining texts: every window of lines with enough words that stood before goes, but for lines of its first copy."""
    seen, out = {}, {}
    docs = sorted((i, t.split("\n")) for i, t, *_ in rows if t is not None)
    spans = []
    for i, lines in docs:
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(len(x.encode().split()) for x in lines[s:e]) >= least:
                    spans.append((i, s, e, seen.setdefault(tuple(lines[s:e]), (i, s))))
    gone = {(i, p) for i, s, e, (j, first) in spans if (j, first) != (i, s) for p in range(s, e) if j != i or p >= first + e - s}
    for i, lines in docs:
        out[i] = "\n".join(x for p, x in enumerate(lines) if (i, p) not in gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = [prose(rng, rng.choice([1, 2, 5, 12])).replace("\n", "") for _ in range(25)] + ["", ""]
    rows = []
    for i in range(60):
        kind = i % 4
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) if kind else "\n".join(prose(rng, 6).replace("\n", "") for _ in range(4))
        rows.append((i, (rows[-2][1] or "") + "\n" + text if kind == 3 else text, "en", "s"))
    rows += [(100, "\n".join([lines[0], lines[1]] * 20), "en", "s"), (101, None, "en", "s"), (102, "", "en", "s")]
    docs = documents(spark, rows)
    out = linedup.dedup(docs, least=12)
    assert out.columns == [*docs.columns, "n_lines", "n_deleted"]
    want = removed(rows, 12)
    for r in out.collect():
        assert r.text == want.get(r.doc_id), r.doc_id
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert r.n_lines == (0 if text is None else text.count("\n") + 1) and r.n_chars == (None if r.text is None else len(r.text))


def test_line_dedup_passages(spark):
    rng = random.Random(6)
    passage, short = prose(rng, 51).replace("\n", ""), prose(rng, 20).replace("\n", "")
    rows = [(i, "\n".join([prose(rng, 9).replace("\n", ""), passage if i % 2 else short, prose(rng, 9).replace("\n", "")]), None, None) for i in range(8)]
    got = {r.doc_id: r for r in linedup.dedup(documents(spark, rows)).collect()}
    assert [i for i, r in got.items() if r.n_deleted] == [] or {i for i, r in got.items() if r.n_deleted} == {3, 5, 7}
    assert passage in got[1].text and all(passage not in got[i].text for i in (3, 5, 7)) and all(short in got[i].text for i in (0, 2, 4, 6))


def test_overlapping_copies_leave_the_first_whole(spark):
    line = "one two three four five"
    rows = [(1, "\n".join([line] * 30), "en", "s"), (2, "\n".join([line, "x y z"] * 40), "en", "s"), (3, "\n".join([line] * 12), "en", "s")]
    got = {r.doc_id: r.text.split("\n") for r in linedup.dedup(documents(spark, rows)).collect()}
    assert got[1] == [line] * 10 and got[2] == ([line, "x y z"] * 7)[:13] and got[3] == [line, line][:0] + [""]
    assert {i: "\n".join(t) for i, t in got.items()} == removed(rows, linedup.MIN_WORDS)


def test_line_dedup_odd_rows(spark):
    assert linedup.dedup(documents(spark, [])).count() == 0
    text = "a b c\nd e f"
    rows = [(1, text, None, None)] * 2 + [(None, text, None, None), (2, text, None, None)]
    got = sorted(((str(r.doc_id), r.text, r.n_deleted) for r in linedup.dedup(documents(spark, rows), least=3).collect()))
    assert got == [("1", "", 2), ("1", "", 2), ("2", "", 2), ("None", text, 0)]


def links(vectors, labels, threshold):
    out = []
    for a, b in combinations(range(len(vectors)), 2):
        x, y = vectors[a], vectors[b]
        if labels[a] is None or labels[a] != labels[b] or any(v is None or None in v or len(v) == 0 for v in (x, y)) or len(x) != len(y):
            continue
        x, y = np.array(x, np.float64), np.array(y, np.float64)
        if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
            out.append((a, b))
    return out


@pytest.mark.parametrize("spread", [256, 4])
def test_lattice_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(lattice, "SPREAD", spread)
    monkeypatch.setattr(lattice, "TILE", (16, 32))
    rng = np.random.default_rng(7)
    vectors, labels = [], []
    for g in range(30):
        base = rng.standard_normal(64)
        for k in range(40 if g < 2 else 4):
            vectors.append((base + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.12, 0.16])).tolist())
            labels.append(g % 3)
    odd = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0] * 32, [1.0] * 32, [-0.0] + [1.0] * 63, [0.0] + [1.0] * 63, vectors[0]]
    vectors += odd
    labels += [1] * 10 + [None]
    ids = (rng.permutation(len(vectors)) * 5).tolist()
    rows = [(i, v, y, 1, True) for i, v, y in zip(ids, vectors, labels)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int, kept boolean")
    found = links(vectors, labels, 0.98)
    want = smallest(ids, [(ids[a], ids[b]) for a, b in found])
    got = {r.vec_id: r for r in lattice.near_duplicates(table).collect()}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        assert got[i].n_links == sum(k in p for p in found)
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    assert lattice.near_duplicates(table.where("false")).count() == 0


def test_lattice_repeated_ids(spark):
    """Each vector of an id is searched, and one doesn't carry the other's links on."""
    v, w = [1.0] * 64, [1.0, -1.0] * 32
    near = lambda x: [x[0] + 0.1, *x[1:]]
    rows = [(5, v, 1), (5, w, 1), (7, near(v), 1), (9, near(w), 1), (None, near(v), 1), (None, [1.0] + [0.0] * 63, 1), (9, near(w), 1)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [("5", 2, "5", True), ("5", 2, "5", True), ("7", 2, "5", False), ("9", 2, "5", False), ("9", 2, "5", False), ("None", 0, "None", True), ("None", 2, "5", False)]


def test_decoding_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.uniform(-3, 3, (300, 8))
    point = lattice.decode(x)
    assert len(lattice.ROOTS) == 240 and np.allclose(np.square(lattice.ROOTS).sum(1), 2)
    assert ((2 * point) % 1 == 0).all() and (point.sum(1) % 2 == 0).all()
    own = np.square(x - point).sum(1)
    others = np.square(x[:, None] - point[:, None] - lattice.ROOTS).sum(2).min(1)
    assert (own <= others + 1e-12).all() and own.max() <= 1 + 1e-9  # the covering radius is 1
