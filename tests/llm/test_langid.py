import random

import numpy as np

from folioflow.llm.langid import LEARNED, MARK, SCORED, default_vocabulary, expected, expected_long, forward, forward_long, identify, pieces


def test_forward_sums_all_segmentations():
    p = pieces(default_vocabulary())
    rng = np.random.default_rng(0)
    probs = rng.dirichlet(np.ones(len(p.prior)), 2).T
    number = {r: i for i, r in enumerate(p.raw)}

    def total(w, k):
        if not w:
            return 1.0
        return sum(probs[number[w[:j]], k] * total(w[j:], k) for j in range(1, len(w) + 1) if w[:j] in number)

    for w in (b"the", "été".encode(), MARK + b"hello", b"\xff\x00z"):
        got = forward(np.frombuffer(w, np.uint8)[None], p, probs)[0]
        assert np.allclose(got, [np.log(total(w, 0)), np.log(total(w, 1))])
        assert np.allclose(forward_long(np.frombuffer(w, np.uint8), p, probs), got)


def test_words_of_any_length_are_summed_whole():
    p = pieces(default_vocabulary())
    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.ones(len(p.prior)), 3).T
    number = {r: i for i, r in enumerate(p.raw)}
    for text in ("responsibility", "representation" * 4, "日本語のとても長い文です" * 30, "─" * 40, "x" * 3000):
        w = MARK + text.encode()
        log = [np.zeros(3)]  # exact sums with every piece, in logarithms
        for j in range(1, len(w) + 1):
            log.append(np.logaddexp.reduce([log[i] + np.log(probs[number[w[i:j]]]) for i in range(max(0, j - p.longest), j) if w[i:j] in number]))
        row = np.frombuffer(w, np.uint8)
        assert np.allclose(forward_long(row, p, probs), log[-1])
        if len(w) <= SCORED + len(MARK):
            assert np.allclose(forward(row[None], p, probs)[0], log[-1])


def test_tiny_probabilities_are_summed_too():
    p = pieces(default_vocabulary())
    probs = np.full((len(p.prior), 2), 1e-14)
    probs[300:, 0] = 1 / len(p.prior)
    for w in (MARK + b"\xf0\x9f\x99\x82" * 15, MARK + bytes(range(128, 190)), MARK + b"\xff" * 500):
        row = np.frombuffer(w, np.uint8)
        log = [np.zeros(2)]
        number = {r: i for i, r in enumerate(p.raw)}
        for j in range(1, len(w) + 1):
            log.append(np.logaddexp.reduce([log[i] + np.log(probs[number[w[i:j]]]) for i in range(max(0, j - p.longest), j) if w[i:j] in number]))
        got = [forward_long(row, p, probs)] + ([forward(row[None], p, probs)[0]] if len(w) <= SCORED + len(MARK) else [])
        assert all(np.allclose(g, log[-1]) and np.isfinite(g).all() for g in got)


def test_counts_of_long_words_are_those_of_short_ones():
    p = pieces(default_vocabulary())
    for text in ("internationalität", "x", "été" * 5):
        row, weight = np.frombuffer(MARK + text.encode(), np.uint8), np.array([2.0, 0.0, 0.5])
        a, b = np.zeros((3, len(p.prior))), np.zeros((3, len(p.prior)))
        expected(row[None], weight[None], p, a)
        expected_long(row, weight, p, b)
        assert np.allclose(a, b) and a[0].sum() > 0 and not a[1].any()


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(1)
    lists = {"en": "the of and with ship harbour water", "de": "und der ist nicht schiff hafen wasser", "fr": "le des est pas bateau port eau été"}
    docs = [(i, " ".join(rnd.choice(lists[x].split()) for _ in range(8)), x) for i in range(150) for x in [rnd.choice(list(lists))]]
    edge = [(500, None, "en"), (501, "", "en"), (502, "123 ...", "de"), (503, "Und " * 9000, None), (504, "x" * (3 * SCORED + 5), "de"), (505, "ab" * LEARNED, "de"), (None, "und der", None), (1, docs[1][1], docs[1][2])]
    df = spark.createDataFrame([(*d, "clash") for d in docs + edge], "doc_id bigint, text string, lang string, score string")
    got = identify(df).collect()
    assert len(got) == len(docs) + len(edge)
    truth = {i: x for i, _, x in docs}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (500, 501, 502, 503, None)] == ["und", "und", "und", "de", "de"]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in identify(df.withColumn("lang", df.lang.substr(9, 0)).where("lang is null")).collect()} == {"und"}
    assert identify(df.limit(0)).count() == 0
