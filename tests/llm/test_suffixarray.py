import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioflow.llm.suffixarray import common_prefixes, remove_repeats, suffix_array


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(r)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(r), sum(hit), runs, bytes(c for c, h in zip(r, hit) if not h)))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rnd = random.Random(seed)
    n = rnd.choice([0, 1, 2, 3, 10, 200, 3000])
    s = np.array([rnd.randrange(rnd.choice([1, 2, 3, 200])) + 1 for _ in range(n)], np.int64)
    if n > 100:
        s[50:90] = s[0:40]
    sa = suffix_array(s)
    low = s.tolist()
    assert sa.tolist() == sorted(range(n), key=lambda i: low[i:])
    plcp = common_prefixes(s, sa)
    for r in range(1, n):
        i, j, k = sa[r], sa[r - 1], 0
        while i + k < n and j + k < n and s[i + k] == s[j + k]:
            k += 1
        assert plcp[i] == k


def made(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["ab", "é", "of the", "x", "qu", "ß0"]) + rnd.choice("aeiou")
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(5)]
    texts = [text(rnd.randrange(40)) + rnd.choice(shared)[rnd.randrange(9) :] + text(rnd.randrange(20)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[1], None, "", "a" * 500, "ab" * 300, "short", "short", "\0" * 90, shared[0] * 3]
    return texts


@pytest.mark.parametrize("crowd", [1, 2_000])
def test_against_brute_force(spark, crowd):
    texts = made(7)
    rows = [(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    got = remove_repeats(df, length=40, gram=12, shard_bytes=2_000, crowd=crowd).collect()
    assert sorted((r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept_bytes)) for r in got) == sorted(brute(texts, 40))
    assert Counter(r.row.doc_id for r in got) == Counter(r[0] for r in rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_structured_texts_are_told_apart(spark):
    """A Thue-Morse word and its complement collide in any polynomial modulo a power of two; their windows do recur."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    word = lambda flip: "".join("ab"[b ^ flip] for b in bits)
    for length in (64, 1100):
        rows = [(1, word(0)), (2, word(1)), (3, "x" + word(0)[:1200] + "y")]
        seen = {}
        for _, t in rows:
            for i in range(len(t) - length + 1):
                seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
        want = {}
        for k, t in rows:
            hit = {j for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1 for j in range(i, i + length)}
            want[k] = len(hit)
        got = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=length, gram=16)
        assert {r.row.doc_id: r.n_removed for r in got.collect()} == want


@pytest.mark.parametrize("crowd, crowd_bytes", [(1, 1_000_000), (2_000, 1_000_000), (2_000, 300)])
def test_both_lengths_against_brute_force(spark, crowd, crowd_bytes):
    """One pass finds what strings of 60 bytes cover and, in runs of 5 words and more, what strings of 25 do."""
    texts = made(8) + made(9)[:30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(remove_repeats(df, length=60, passages=25, passage_words=5, gram=9, shard_bytes=2_000, crowd=crowd, crowd_bytes=crowd_bytes).collect(), key=lambda r: r.row.doc_id)
    assert [(r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept_bytes)) for r in got] == brute(texts, 60)
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 25] for r in raws for i in range(len(r) - 24))
    for r, raw in zip(got, raws):
        hit = np.zeros(len(raw) + 2, int)
        for i in range(len(raw) - 24):
            if seen[raw[i : i + 25]] > 1:
                hit[i + 1 : i + 26] = 1
        want = []
        for a, z in np.flatnonzero(np.diff(hit)).reshape(-1, 2).tolist():
            inside = [m for m in re.finditer(rb"\S+", raw) if m.start() >= a and m.end() <= z]
            if len(inside) >= 5:
                want += [a, z]
        assert list(r.passages) == want
    assert any(r.passages for r in got)
