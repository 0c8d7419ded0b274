import hashlib
import random
import re

from folioflow.llm import decontaminate
from folioflow.llm.decontaminate import contamination, report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(13, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[a : a + n]:
                        hit.update(range(s, s + n))
                        found.add(str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice(["the", "of", "Été", "n1", "rare%d" % rnd.randrange(99), "a-b"]) for _ in range(n))
    items = [(k, text(rnd.choice([3, 14, 30]))) for k in range(12)] + [(20, None), (21, ""), (22, "..."), (23, "the of"), (2, text(15))]
    docs = [(i, text(50) + ", " + (rnd.choice(items[:12])[1] or "").upper() + "! " + text(rnd.randrange(40))) for i in range(30)]
    docs += [(90, None), (91, ""), (92, "the"), (93, "of the"), (94, items[1][1]), (94, items[1][1]), (None, items[2][1]), (95, "the of " * 9000)]
    got = report(spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, items string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert report(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in report(docs, items.limit(0)).collect()] == [0]


def test_blocks_shards_and_shuffles_change_nothing(spark, monkeypatch):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(["a", "b", "c", "r%d" % rnd.randrange(40)]) for _ in range(n))
    items = [(k, text(20)) for k in range(8)] + [(None, text(13))]
    docs = [(i, text(30) + " " + rnd.choice(items)[1] + " " + rnd.choice(items)[1] + " " + text(9)) for i in range(25)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(tuple, report(d, b).collect()))
    for name, value in (("BLOCK", 5), ("WINDOWS", 7), ("BROADCAST", 0)):
        monkeypatch.setattr(decontaminate, name, value)
    assert sorted(map(tuple, report(d, b).collect())) == want and any(r[2] for r in want)


def test_proximity(spark):
    docs = [(1, "x rare y z"), (2, "z rare w w w w w w y x"), (3, "x y z rare"), (4, "x y z"), (5, "rare z y x end"), (6, "rare rare x w w w w w y w w z")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, "x rare y z")], "item_id bigint, text string")
    got = {r.row.doc_id: (r.n_hit, list(r.items), list(r.near_items)) for r in contamination(d, b, span=3).collect()}
    assert got == {1: (4, ["7"], ["7"]), 2: (0, [], []), 3: (0, [], ["7"]), 4: (0, [], []), 5: (0, [], ["7"]), 6: (0, [], [])}
    assert all(not r.near_items for r in contamination(d, b).collect())
