import random
import re

import numpy as np
import pytest

from folioflow.llm.superminhash import near_duplicates, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, k=2):
    sets = []
    for i, t in rows:
        w = WORD.findall(lowered(t or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for j, (i, _) in enumerate(sets):
        if i is not None:
            low[find(j)] = min(low.get(find(j), i), i)
    return sorted(((i, len(s), low.get(find(j), None), i == low.get(find(j), None)) for j, (i, s) in enumerate(sets)), key=str)


def made(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Éa", "ü"]
    rows, n = [], 0
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 9, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 8])):
            words = [rnd.choice(vocab) if rnd.random() < 0.03 else w for w in base]
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, rows[0][1]), (n + 5, rows[0][1])]
    rows += [(n + 6, "x " * 30_000), (n + 7, "x " * 20_000)]
    return rows


def test_against_brute_force(spark):
    rows = made()
    got = near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, key string"), shingle=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("block", [3, 2_000])
def test_chain_beyond_the_leaders(spark, block):
    """Texts that shift step by step: many are linked only through others, in one block or several."""
    words = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 90])) for i in range(15)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2, block_rows=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(empty, shingle=2).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "z")], "doc_id bigint, text string"), shingle=2)
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got.collect()), key=str) == sorted([(None, 4, False), (4, 4, True), (None, None, True)], key=str)


@pytest.mark.parametrize("n", [1, 3, 40, 700])
def test_signature_is_superminhash(n):
    """Slots agree as often as the sets, and an element's permutation writes every slot once."""
    rng = np.random.default_rng(n)
    a = rng.integers(1, 1 << 63, n).astype(np.uint64)
    one = signatures(np.zeros(n, np.int64), np.sort(a), 1)
    assert (one != 0xFFFFFFFF).all()
    if n == 1:
        assert sorted(one[0] >> 24) == list(range(252))
    if n == 700:
        b = np.concatenate([a[:630], rng.integers(1, 1 << 63, 70).astype(np.uint64)])
        two = signatures(np.zeros(n, np.int64), np.sort(b), 1)
        assert abs((one == two).mean() - 630 / 770) < 0.08


def test_group_of_borderline_copies(spark):
    """Copies of one text with edits of their own: some pairs are links, many just aren't."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(f"e{rnd.randrange(30)}" if rnd.random() < 0.02 + 0.08 * (i % 4) / 3 else w for w in base)) for i in range(80)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2, block_rows=30)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_structured_words_are_told_apart(spark):
    """A Thue-Morse word and its complement collide in any polynomial modulo a power of two."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    word = lambda flip: "".join("ab"[b ^ flip] for b in bits)
    df = spark.createDataFrame([(1, word(0)), (2, word(1)), (3, word(0))], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1), (2, 2), (3, 1)]
