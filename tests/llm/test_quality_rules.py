import random
import re
from collections import Counter
from math import comb

import pyarrow as pa
import pytest

from folioflow.llm.quality_rules import cutoffs, measures, quality_rules, upper_bound

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def texts():
    rnd = random.Random(4)
    out = [None, "", "\n\n", " a\n a\na\n a\n", "x\ny\nx", "é #ü| <b>", "a b c d e a b c d e f", "w " * 9, "line one\n" * 3, "q" * 50_000]
    return out + ["".join(rnd.choice(["a ", "b ", "\n", "ü", "#", "same line\n", "\t", "\x0b"]) for _ in range(rnd.randrange(90))) for _ in range(200)]


def test_base_counts_match_brute_force():
    m = measures(pa.array(texts()))
    for i, t in enumerate(texts()):
        assert tuple(int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), repr(t)


@pytest.mark.parametrize("k,n,delta", [(0, 100, 0.05), (3, 50, 0.001), (10, 10, 0.1)])
def test_bound_is_exact(k, n, delta):
    p = upper_bound(k, n, delta)
    if k == n:
        assert p == 1
    else:
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - delta) < 1e-6


def test_query(spark):
    good = "The old ship sails on to the far harbour and word%d rests in the calm bay"
    bad = "Buy*** now### cheap$$$ word%d %%%%%% offers*** from&&& us|| today### or*** never$$$ again"
    docs = [(i, (good if i % 4 else bad) % i, "en" if i % 2 or i % 4 == 0 else None, 1) for i in range(9000)]
    docs += [(10_000, None, "en", 1), (10_001, "", None, 1), (None, "x", "xx", 1), (0, "tie " * 30, "en", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(9000)] + [(5, None), (None, 1)], "doc_id bigint, quality int")
    got = quality_rules(df, labels).collect()
    assert len(got) == len(docs)
    for r in got:
        assert not (r.base_failed and r.kept)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        if r.doc_id is not None and 0 < r.doc_id < 9000:
            assert r.kept == (r.doc_id % 4 > 0)
    assert quality_rules(df.limit(0), labels).count() == 0
    assert quality_rules(df, labels.limit(0)).where("kept = base_failed").count() == 0


def test_few_labels_give_no_cutoffs(spark):
    rows = [("en", "bad ### " * 9 + str(i), i % 2) for i in range(40)]
    assert cutoffs(spark.createDataFrame(rows, "stratum string, text string, label int")) == {}


def test_cutoffs_against_brute_force():
    """Of all cutoffs whose exact bound holds, the one that catches most bad texts, the loosest of equals."""
    import numpy as np

    from folioflow.llm.quality_rules import GRIDS, choose

    rng = np.random.default_rng(5)
    for alpha, delta in ((0.02, 0.01), (0.1, 0.05)):
        values = {r: (rng.choice(g, 900) * rng.choice([0.5, 1, 1.5], 900, p=[0.96, 0.02, 0.02]), rng.choice(g, 300) * 1.5) for r, g in GRIDS.items()}
        bucket = lambda v, g: np.bincount([sum(x > c for c in g) for x in v], minlength=len(g) + 1)
        got = choose({r: bucket(values[r][0], g) for r, g in GRIDS.items()}, {r: bucket(values[r][1], g) for r, g in GRIDS.items()}, alpha, delta)
        want = {}
        for r, g in GRIDS.items():
            best = 0
            for c in sorted(g):
                k, caught = int((values[r][0] > c).sum()), int((values[r][1] > c).sum())
                # the bound is at most alpha exactly if so few rejections are that unlikely at alpha
                unlikely = sum(comb(900, i) * alpha**i * (1 - alpha) ** (900 - i) for i in range(k + 1)) <= delta
                if unlikely and caught and caught >= best:
                    best, want[r] = caught, c
        assert got == want


def test_labels_that_repeat_or_contradict(spark):
    good, bad = "The old ship sails on to the far harbour and word%d rests in the calm bay", "Buy*** now### cheap$$$ word%d %%%%%% offers*** from&&& us|| today### or*** never$$$ again"
    df = spark.createDataFrame([(i, (good if i % 4 else bad) % i, "en") for i in range(6000)], "doc_id bigint, text string, lang string")
    rows = [(i, 1 if i % 4 else 0) for i in range(6000)]
    once = spark.createDataFrame(rows, "doc_id bigint, quality int")
    twice = spark.createDataFrame(rows * 3 + [(7000, 1), (7000, 0)], "doc_id bigint, quality int")
    want = sorted((r.doc_id, r.kept) for r in quality_rules(df, once).collect())
    assert sorted((r.doc_id, r.kept) for r in quality_rules(df, twice).collect()) == want
    few = spark.createDataFrame(rows[:40] * 100, "doc_id bigint, quality int")  # 40 labels are few, however often repeated
    assert quality_rules(df, few).where("kept = base_failed").count() == 0
