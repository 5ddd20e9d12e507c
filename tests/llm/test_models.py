import math
import random

import numpy as np
from pyspark.sql import functions as F
from tables import corpus, documents, prose

from sievewright.llm import langid, quality


def junk(rng, n):
    return rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: t.replace(" ", "### "), lambda t: " ".join(w for w in t.split() for _ in range(6))])(prose(rng, n))


def test_quality_held_out(spark):
    rng = random.Random(8)
    rows = [(i, junk(rng, rng.randint(2, 90)) if i % 5 == 0 else prose(rng, rng.randint(2, 200)), "en", "s") for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 800)] + [(0, None, 0), (5, 3, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark, rows), labels)
    again = {r.doc_id: r.score for r in quality.classify(documents(spark, rows[::-1]), labels).collect()}
    out = [r for r in got.collect()]
    held = [r for r in out if r.held_out]
    assert 100 < len(held) < 220 and {r.doc_id: r.score for r in out} == again
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in held) >= 0.97 * len(held)


def test_quality_equals_plain_densities():
    """Scores against inverses and determinants of the shrunk covariances, worked out one by one."""
    rng = random.Random(5)
    texts = [junk(rng, rng.randint(1, 80)) if i % 3 == 0 else prose(rng, rng.randint(1, 150)) for i in range(240)]
    counts, y = np.array([quality.statistics(t) for t in texts], float), np.array([int(i % 3 != 0) for i in range(240)])
    model = quality.Discriminant(counts, y)
    x = quality.transformed(counts, quality.shares(counts))
    middle, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - middle) / scale
    size, cov = z.shape[1], []
    for c in (0, 1):
        own = z[y == c] - z[y == c].mean(0)
        cov.append(sum(np.outer(v, v) for v in own) / len(own))
    pooled = sum(np.mean(y == c) * cov[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        s = (1 - quality.POOLED) * cov[c] + quality.POOLED * pooled
        s = (1 - quality.RIDGE) * s + quality.RIDGE * np.trace(s) / size * np.eye(size)
        inverse, mean = np.linalg.inv(s), z[y == c].mean(0)
        logs.append([-0.5 * ((v - mean) @ inverse @ (v - mean) + np.linalg.slogdet(s)[1]) + math.log(np.mean(y == c)) for v in z])
    d = np.array(logs[1]) - np.array(logs[0])
    assert np.allclose(model.difference(x), d, rtol=1e-6, atol=1e-6)
    a, b = model.curve
    assert np.allclose(model.score(counts), [1 / (1 + math.exp(-max(-30, min(30, a * math.copysign(math.sqrt(abs(v)), v) + b)))) for v in d], atol=1e-9)
    # the curve is where the likelihood of the labels is flat
    f = np.column_stack([np.sign(d) * np.sqrt(np.abs(d)), np.ones(len(d))])
    up, down = np.sum(y == 1), np.sum(y == 0)
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    assert np.abs(f.T @ (target - 1 / (1 + np.exp(-f @ model.curve)))).max() < 1e-2


def test_quality_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    rng, seen, fit = random.Random(3), [], quality.Discriminant
    rows = [(i % 40, junk(rng, 40) if i % 2 else prose(rng, 60), "en", "s") for i in range(400)]
    monkeypatch.setattr(quality, "Discriminant", lambda x, y: seen.append(len(x)) or fit(x, y))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    assert quality.classify(documents(spark, rows), labels).count() == 400 and seen[0] <= 40


def test_quality_uses_no_held_out_label(spark):
    rng = random.Random(9)
    docs = documents(spark, [(i, junk(rng, 40) if i % 3 == 0 else prose(rng, 60), "en", "s") for i in range(150)])
    ids = [r.doc_id for r in quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).where("held_out").collect()]
    labels = [(i, int(i % 3 != 0)) for i in range(150)]
    flipped = [(i, 1 - y if i in ids else y) for i, y in labels]
    a, b = (sorted(map(tuple, quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (labels, flipped))
    assert a == b


def test_quality_odd_rows(spark):
    rows = corpus(n=6)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(documents(spark, []), none).count() == 0
    out = quality.classify(documents(spark, rows), none).collect()
    assert len(out) == len(rows) and all(r.score == 0.5 and r.predicted == 1 for r in out)
    one = quality.classify(documents(spark, rows), spark.createDataFrame([(3, 1), (6, 1)], "doc_id long, quality int")).collect()
    assert all(r.score == 1 for r in one)


def test_quality_sample_is_bounded(spark):
    rng = random.Random(2)
    rows = [(i, junk(rng, 40) if i % 2 else prose(rng, 60), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    out = quality.classify(documents(spark, rows), labels, most=100).where("held_out").collect()
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in out) >= 0.9 * len(out)


def test_language_held_out_and_mixed(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(3, 150), ["en", "fr", "de"][i % 3]), ["en", "fr", "de"][i % 3] if i % 7 else None, "s") for i in range(300)]
    docs = documents(spark, rows)
    model = langid.learn(docs.where("doc_id % 2 = 0"))
    out = langid.identify(docs.where("doc_id % 2 = 1"), model)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "rank", "kept", "lang_pred", "score", "languages"}
    found = out.collect()
    assert sum(r.lang_pred == ["en", "fr", "de"][r.doc_id % 3] for r in found) >= 0.98 * len(found) and all(0 <= r.score <= 1 for r in found)
    both, pure = prose(rng, 300, "fr") + " " + prose(rng, 150, "de"), prose(rng, 300, "en")
    lang, score, shares = model.infer(both)
    assert lang == "fr" and {k for k, _ in shares} == {"fr", "de"} and abs(score - 2 / 3) < 0.12
    assert [k for k, _ in model.infer(pure)[2]] == ["en"]
    assert all(model.infer(t)[0] != "und" for t in ("a", "é", "1 b 2")) and model.infer("12 !?")[0] == "und"


def plain_mixture(table, languages, text):
    """The set of languages and its shares by a direct loop over n-grams and languages."""
    buckets, counts = langid.ngrams(text)
    rows = [([table[b][k] for k in range(len(languages))], c) for b, c in zip(buckets.tolist(), counts.tolist())]
    total = sum(c for _, c in rows)

    def fit(chosen):
        shares = [1 / len(chosen)] * len(chosen)
        for _ in range(langid.ROUNDS if len(chosen) > 1 else 0):
            new = [0.0] * len(chosen)
            for p, c in rows:
                whole = sum(p[k] * s for k, s in zip(chosen, shares))
                for at, k in enumerate(chosen):
                    new[at] += c * p[k] * shares[at] / whole / total
            moved = max(abs(a - b) for a, b in zip(shares, new))
            shares = new
            if moved < langid.CLOSE:
                break
        return shares, sum(c * math.log(sum(p[k] * s for k, s in zip(chosen, shares))) for p, c in rows)

    every, _ = fit(range(len(languages)))
    order = sorted(range(len(languages)), key=lambda k: -every[k])
    chosen = order[:1]
    shares, best = fit(chosen)
    for k in order[1:]:
        more, likelihood = fit([*chosen, k])
        if every[k] < 0.01 or likelihood - best <= langid.PRICE * math.log(1 + total):
            break
        chosen, shares, best = [*chosen, k], more, likelihood
    top = max(range(len(chosen)), key=lambda at: shares[at])
    return languages[chosen[top]], every[chosen[0]] if len(chosen) == 1 else shares[top], {languages[k]: s for k, s in zip(chosen, shares)}


def test_language_equals_a_direct_loop(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60, ["en", "fr", "de"][i % 3]), ["en", "fr", "de"][i % 3], "s") for i in range(60)]
    model = langid.learn(documents(spark, rows))
    assert model.languages == ["de", "en", "fr"]
    counts = np.zeros((langid.BUCKETS, 3))
    for _, text, lang, _ in rows:
        buckets, n = langid.ngrams(text)
        for b, c in zip(buckets.tolist(), n.tolist()):
            counts[b, model.languages.index(lang)] += c
    table = [[(c + langid.SMOOTHING) / (counts[:, k].sum() + langid.SMOOTHING * langid.BUCKETS) for k, c in enumerate(row)] for row in counts.tolist()]
    assert np.allclose(model.table, table)
    for text in [prose(rng, 3, "fr"), prose(rng, 40, "en") + " " + prose(rng, 40, "de"), prose(rng, 30, "de") + prose(rng, 25, "fr") + prose(rng, 20, "en"), "a", prose(rng, 90, "en")]:
        lang, score, shares = model.infer(text)
        want = plain_mixture(table, model.languages, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-6 and {k: round(s, 6) for k, s in shares} == {k: round(s, 6) for k, s in want[2].items()}


def test_no_letter_no_language(spark):
    model = langid.learn(documents(spark, [(1, "the thing", "en", "s"), (2, "eau de feu", "fr", "s")]))
    assert [model.infer(t)[0] for t in ("½ ²", "٣٤ ①", "— … “”", "", "12_3")] == ["und"] * 5
    assert all(model.infer(t)[0] != "und" for t in ("½ x", "é", "字", "ª"))
    labels = documents(spark, [(i, "abc", f"l{i}", "s") for i in range(6)])
    try:
        langid.learn(labels, most_languages=5)
    except ValueError as e:
        assert "more than 5" in str(e)
    else:
        raise AssertionError
    assert len(langid.learn(labels, most_languages=6).languages) == 6


def test_language_odd_rows(spark):
    docs = documents(spark, corpus())
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model, keep_text=True).collect()}
    assert [got[i].lang_pred for i in (2000, 2001, 2002)] == ["und"] * 3 and got[2001].score == 0 and got[2007].text
    assert len(got) == docs.count()
    empty = langid.learn(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0
    few = langid.learn(docs, most=5)
    assert sum(few.infer(t)[0] == lang for i, t, lang, _ in corpus() if i is not None and i < 180 and len(t) > 200) > 20


def test_contract_folds(spark):
    import zlib

    from sievewright.llm.common import held_out

    for r in spark.range(50).select("id", held_out(F.col("id"), 5, 0).alias("a"), held_out(F.col("id"), 3, 1).alias("b")).collect():
        x = zlib.crc32(str(r.id).encode())
        assert (r.a, r.b) == (x % 5 == 0, x % 3 == 1)
