import zlib

import numpy as np
import pyarrow as pa

from folioflow.llm.quality_model import features, fit, quality_scores, score_batch, train


def corpus(n=240):
    good = [f"The ship number {i} sails to the far harbour, and word{i % 17} rests." for i in range(n)]
    bad = [f"BUY!! NOW!! CHEAP{i % 13}!! *** offer ### {i}" for i in range(n)]
    return [(i, t, y) for i, (t, y) in enumerate([(g, 1) for g in good] + [(b, 0) for b in bad])]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = [(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.1), (901, "", 0.1), (None, "x", 0.1), (902, "BUY!! " * 20_000, 0.1), (0, rows[0][1], 0.1)]
    labels = [(i, y) for i, _, y in rows] + [(900, 1), (901, None), (None, 1)]
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string, score double"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality_scores(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict((i, y) for i, _, y in rows)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality_scores(df, lab.limit(0)).where("score = 0.5").count() == len(docs)
    assert quality_scores(df.limit(0), lab).count() == 0


def test_score_is_the_sparse_dot_product():
    w = np.random.default_rng(1).normal(size=(1 << 10) + 1)
    texts = pa.array(["One two, two!", "", None, "ü 12 ab"])
    buckets, first = features(texts, 10)
    for i, s in enumerate(score_batch(texts, w)):
        part = buckets[first[i] : first[i + 1]]
        x = sum(w[b] for b in part) / np.sqrt(max(1, len(part))) + w[-1]
        assert abs(s - 1 / (1 + np.exp(-x))) < 1e-9


def test_one_label_learns_nothing():
    assert not train([(np.array([0]), np.array([1.0]), 1)] * 3, 3, 1, 0.1, 1.0, 0.0, 0.0).any()


def test_sample_bound(spark):
    rows = [(i, t, y) for i, t, y in corpus(40)]
    df = spark.createDataFrame(rows, "order bigint, text string, label int")
    assert (fit(df, bits=10, max_rows=50) == fit(df.where("order < 50"), bits=10)).all()


def test_training_is_ftrl_proximal():
    """Against the update written out coordinate by coordinate."""
    rng = np.random.default_rng(3)
    rows = [(np.append(np.sort(rng.choice(8, 3, replace=False)), 8), np.append(rng.random(3), 1.0), int(rng.random() < 0.5)) for _ in range(40)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for idx, x, y in rows:
            w = {i: weight(i) for i in idx}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(idx, x))))
            for i, v in zip(idx, x):
                g = (p - y) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = train(rows, 3, 2, alpha, beta, l1, l2)
    assert np.allclose(got, [weight(i) for i in range(9)]) and got.any()


def test_query_against_brute_force(spark):
    """The whole query: vectors by counting, training in label order, scores text by text."""
    rows = corpus(30)
    df = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(77, None, 0.0)], "doc_id bigint, text string, score double")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows] + [(77, 1)], "doc_id bigint, quality int")
    hashed = {r.id: r.h for r in spark.sql("select id, xxhash64(id) h from range(100)").collect()}
    learn = sorted((hashed[i], t, y) for i, t, y in rows + [(77, "", 1)] if zlib.crc32(str(i).encode()) % 5)

    def vector(t):
        buckets = features(pa.array([t]), 18)[0].tolist()
        i = sorted(set(buckets))
        return np.append(i, 1 << 18).astype(int), np.append([buckets.count(b) / max(1, len(buckets)) ** 0.5 for b in i], 1.0), len(buckets)

    w = train([(*vector(t)[:2], y) for _, t, y in learn], 18, 5, 0.3, 1.0, 0.02, 0.1)
    want = {i: 1 / (1 + np.exp(-(w[vector(t)[0]] @ vector(t)[1]))) for i, t, _ in [*rows, (77, "", 1)]}
    got = {r.doc_id: r.score for r in quality_scores(df, lab).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-4


def test_a_score_depends_on_its_text_alone():
    w = np.random.default_rng(2).normal(size=(1 << 10) + 1)
    texts = [t for _, t, _ in corpus(100)] + ["", None]
    together = score_batch(pa.array(texts, pa.string()), w)
    assert [score_batch(pa.array([t], pa.string()), w)[0] for t in texts] == together.tolist()
