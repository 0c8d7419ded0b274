import random

from folioflow.llm.licenses import TEMPLATES, ranking, scan, scan_licenses
from folioflow.llm.substring_dedup import repeated_sentences


def brute(rows, run, min_words):
    import re

    split = lambda t: [s for s in re.split(r"(?<=[.!?])[ \t]+|\n+", t or "") if s.strip(" ")]
    parts = [(i, t, split(t)) for i, t in rows]
    seen, out = {}, []
    order = sorted(((i, t, s, p) for i, t, s in parts for p in range(len(s) - run + 1)), key=lambda x: (x[0], x[3]))
    gone = {}
    for i, _, s, p in order:
        key = tuple(" ".join(x.lower().split()) for x in s[p : p + run])
        if len(" ".join(key).split()) >= min_words and seen.setdefault(key, (i, p)) != (i, p):
            gone.setdefault(i, set()).update(range(p, p + run))
    for i, _, s in parts:
        out.append((i, len(s), sorted(gone.get(i, ()))))
    return sorted(out)


def test_substring_dedup_matches_brute_force(spark):
    rnd = random.Random(6)
    bank = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 6))) + rnd.choice([".", "!", "?"]) for _ in range(25)]
    rows = [(i, "".join(rnd.choice(bank) + rnd.choice([" ", "\n", "  "]) for _ in range(rnd.randrange(25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[3][1]), (104, "A b. " * 6000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, h1 string")
    got = sorted((r.doc_id, r.n_sentences, list(r.gone)) for r in repeated_sentences(df, run=3, min_words=4).collect())
    assert got == brute(rows, 3, 4)
    assert repeated_sentences(df.limit(0)).count() == 0


def test_repeated_passages_go_and_clean_texts_stay(spark):
    rnd = random.Random(8)
    prose = lambda n: " ".join(" ".join(f"w{rnd.randrange(5000)}" for _ in range(12)) + "." for _ in range(n))
    passage = prose(5)
    rows = [(i, prose(4) + " " + (passage + " " if i % 3 == 0 else "") + prose(3)) for i in range(30)]
    rows += [(None, prose(3)), (7, rows[7][1])]
    got = repeated_sentences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 32
    for r in got:
        hit = r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id > 0
        assert len(r.gone) == (5 if hit else 0) and (passage in r.kept_text) == (r.doc_id == 0)


def test_licenses():
    for name, clauses in TEMPLATES.items():
        for c in clauses:
            got = scan(f"Some prose here.\n\n{c}\n\nMore prose.")
            assert got and got[0][0] == name and got[0][3] == 1.0, (name, c, got)
    changed = TEMPLATES["MIT"][1].replace("free of charge", "for a small fee").replace("publish, ", "")
    name, line, saved, cover, _, missing, added = scan("x\n" * 5 + changed)[0]
    assert name == "MIT" and 0.9 < cover < 1 and saved > 0.5 and {"free", "charge", "publish"} <= set(missing) and {"small", "fee"} <= set(added)
    assert ranking(TEMPLATES["MPL-2.0"][0])[0][0] == "MPL-2.0"
    assert scan("My driving license expired and the copyright of the song is old.") == [] == scan(None) == scan("")
    long = "word " * 20_000 + TEMPLATES["Apache-2.0"][0] + " word" * 20_000
    assert [x[0] for x in scan(long)] == ["Apache-2.0"]


def test_scan_keeps_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, None), (3, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, found int")
    got = [(r.row.doc_id, [x.license for x in r.found]) for r in scan_licenses(df).collect()]
    assert sorted(got, key=str) == sorted([(1, ["MIT"]), (1, ["MIT"]), (None, []), (3, [])], key=str)
    assert scan_licenses(df.limit(0)).count() == 0


def test_repeated_passages_of_short_sentences_go(spark):
    rnd = random.Random(9)
    some = lambda lens, end=".": " ".join(" ".join(f"w{rnd.randrange(9000)}" for _ in range(n)) + end for n in lens)
    passage = some([5, 8, 6, 7, 5, 5, 3, 2])
    lone = some([30])
    han = "".join("".join(chr(0x4E00 + rnd.randrange(9000)) for _ in range(9)) + "。" for _ in range(5))
    rows = [(i, f"{some([6, 6, 6])} {passage} {some([4, 4, 4])}") for i in range(4)]
    rows += [(10, lone), (11, lone), (20, "甲。" + han + "乙。"), (21, "丙。" + han + "丁。"), (30, "So it is. Yes."), (31, "So it is. Yes.")]
    rows += [(40, some([9, 9, 3]) + "\n" + passage.replace(". ", ".\n"))]
    got = {r.doc_id: (list(r.gone), r.n_sentences) for r in repeated_sentences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    mid = list(range(3, 11))
    assert got == {0: ([], 14), 1: (mid, 14), 2: (mid, 14), 3: (mid, 14), 10: ([], 1), 11: ([0], 1), 20: ([], 7), 21: ([1, 2, 3, 4, 5], 7), 30: ([], 2), 31: ([], 2), 40: (mid, 11)}


def test_every_repeated_run_of_the_word_bound_goes(spark):
    rnd = random.Random(10)
    bank = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 5))) + "." for _ in range(12)]
    rows = [(i, "\n".join(rnd.choice(bank) for _ in range(rnd.randrange(2, 14)))) for i in range(60)]
    split = {i: t.split("\n") for i, t in rows}
    seen, want = {}, {i: set() for i in split}
    for i, s in split.items():
        for p in range(len(s)):
            for n in range(2, len(s) - p + 1):
                if len(" ".join(s[p : p + n]).split()) >= 7 and seen.setdefault(tuple(s[p : p + n]), (i, p)) != (i, p):
                    want[i] |= set(range(p, p + n))
    got = {r.doc_id: set(r.gone) for r in repeated_sentences(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=7).collect()}
    assert got == want and any(want.values())


def test_every_notice_of_a_passage_is_found():
    short = {n: c[0] for n, c in TEMPLATES.items()}
    names = lambda t: [x[0] for x in scan(t)]
    assert names(short["MIT"] + "\n" + short["Apache-2.0"]) == ["MIT", "Apache-2.0"]
    assert names(" ".join(short.values())) == list(short)
    got = scan("\n".join(["intro", short["MIT"], "and again:", short["MIT"], *TEMPLATES["Apache-2.0"][1:]]))
    assert [(x[0], x[1], x[3]) for x in got] == [("MIT", 1, 1.0), ("MIT", 3, 1.0), ("Apache-2.0", 4, 1.0)]


def test_notices_across_line_40_are_found():
    import textwrap

    for name, clause in (("MIT", TEMPLATES["MIT"][1]), ("Apache-2.0", TEMPLATES["Apache-2.0"][1]), ("GPL-3.0", TEMPLATES["GPL-3.0"][1])):
        for before in range(34, 42):
            got = scan("line of code\n" * before + "\n".join(textwrap.wrap(clause, 60)) + "\nline of code" * 50)
            assert [(x[0], x[1], x[3]) for x in got] == [(name, before, 1.0)]


def test_runs_of_one_word_sentences_and_inside_a_long_sentence(spark):
    rnd = random.Random(10)
    words = lambda n: [f"w{rnd.randrange(90_000)}" for _ in range(n)]
    short = " ".join(w + "." for w in words(80))
    plain = " ".join(words(120))
    rows = [(i, " ".join([*words(30)]) + ". " + short + " " + " ".join(words(30)) + ".") for i in (1, 2)]
    rows += [(i, " ".join(words(35)) + " " + plain + " " + " ".join(words(35))) for i in (3, 4)]
    rows += [(5, "。".join("".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(12)) for _ in range(5)) + "。")]
    rows += [(6, rows[-1][1] + "新しい文。")]
    got = {r.doc_id: r for r in repeated_sentences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not got[1].gone and not got[3].gone and not got[5].gone
    assert len(got[2].gone) == 80 and got[6].kept_text == "新しい文。"
    left = set(got[4].kept_text.split()) & set(plain.split())
    assert len(left) < 40, len(left)


def test_scan_against_brute_force(spark):
    """The clause with the longest common subsequence of words at or over 0.9 in each text is the one found."""
    import re

    rnd = random.Random(12)
    words = lambda t: re.findall(r"[0-9a-z]+(?:[.\-][0-9a-z]+)*", t.lower())
    clauses = [(n, c) for n, cs in TEMPLATES.items() for c in cs]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    rows, want = [], {}
    for i in range(90):
        name, clause = rnd.choice(clauses)
        parts = clause.split()
        lose = rnd.choice([0, 0, int(0.1 * len(words(clause))), max(1, int(0.4 * len(parts)))])
        for _ in range(lose):
            parts.pop(rnd.randrange(len(parts)))
        for _ in range(rnd.randrange(4)):
            parts.insert(rnd.randrange(1, len(parts) + 1), "zz%d" % rnd.randrange(99))
        filler = lambda: rnd.choice([" ", "\n", "\n\n"]).join("the q%d" % rnd.randrange(9999) for _ in range(rnd.randrange(60)))
        text = f"{filler()}\n{' '.join(parts)}\n{filler()}"
        share = {(n, c): lcs(words(c), words(text)) / len(words(c)) for n, c in clauses}
        best = max(share, key=lambda k: share[k] * len(words(k[1])) if share[k] >= 0.9 else 0)
        want[i] = best[0] if share[best] >= 0.9 else None
        rows.append((i, text))
    got = {r.row.doc_id: sorted(r.found, key=lambda x: -len(x.clause)) for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: (f[0].license if f else None) for i, f in got.items()} == want and 20 < sum(v is None for v in want.values()) < 60


def test_notices_without_usual_words_or_lines(spark):
    clause = TEMPLATES["MIT"][1]
    bare = clause.replace("Permission is hereby granted", "Right is now given").replace("sublicense,", "")
    assert [x[0] for x in scan("prose " * 500 + bare + " prose" * 500)] == ["MIT"]
    assert [x[0] for x in scan(clause.replace(" ", "\n\n"))] == ["MIT"]
    assert scan("the of and to in the license the software " * 3000) == []
