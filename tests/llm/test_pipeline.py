"""Each stage of the pipeline against a brute-force version, on a small table with nulls, repeats and ties."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdeéλж") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() + rnd.choice(["", "", "", ",", "."]) for _ in range(n))
    texts = [prose(rnd.randrange(30, 160)) for _ in range(30)]
    shared, short, item = prose(70), prose(30), prose(40)
    for k in (3, 8, 14):
        texts[k] = texts[k] + "\n" + shared + " " + texts[k][::-1]
    texts[20] += " " + short + " " + prose(20)
    texts[21] += " " + short + " " + prose(20)
    texts[5] = prose(20) + " " + "".join(c.upper() if "a" <= c <= "z" else c for c in item) + " " + prose(30)
    texts[6] = prose(800) + " " + " ".join(item.split()[:20]) + " " + prose(800)
    copies = [texts[1], texts[1], " ".join([*texts[2].split()[:-1], "other"]), texts[2].upper().lower()]
    junk = ["### @@ || <> $$ %% && ## ** 77 " * rnd.randrange(3, 12) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([*texts, *copies, *junk])]
    rows += [(100, None), (101, ""), (102, "  \n"), (103, "one"), (103, "one"), (104, "one"), (None, prose(40)), (1, texts[9])]
    docs = [(i, t, rnd.choice(["en", None]), "s", None if t is None else len(t), 0.5, "x") for i, t in rows]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i < 34), 0) for i, t in rows if i is not None and i < 46] + [(1, 1, 0), (200, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return docs, spark.createDataFrame(docs, SCHEMA), at


def rows_of(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "string_dedup", "decontamination", "tokens"]


def test_quality(spark, tables):
    from folioflow.llm import quality_model

    docs, df, at = tables
    weights = quality_model.fit(quality_model.labelled(df, spark.read.parquet(f"{at}/labels.parquet")))

    def score(t):  # one text alone, its buckets added up one by one
        buckets, _ = quality_model.features(pa.array([t], pa.string()), 18)
        z = sum(float(weights[b]) for b in buckets) / max(1, len(buckets)) ** 0.5 + float(weights[-1])
        return 1 / (1 + np.exp(-max(-35, min(35, z))))

    got = rows_of(corpus_pipeline.quality(spark, df, at))
    assert got == sorted((d[:5] for d in docs if score(d[1]) >= 0.3), key=str)
    assert 12 <= len(docs) - len(got) <= 20  # the junk goes


def test_near_dedup(spark, tables):
    docs, df, at = tables
    sets = []
    for d in docs:
        w = WORD.findall(lower(d[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    import hashlib

    order = lambda k: (docs[k][0] is not None, docs[k][0] or 0, hashlib.md5((docs[k][1] or "").encode()).hexdigest())
    kept = {min((k for k in range(len(docs)) if group[k] == g), key=order) for g in group} | {k for k in range(len(docs)) if not sets[k]}
    got = rows_of(corpus_pipeline.near_dedup(spark, df, at))
    assert got == sorted((docs[k][:5] for k in kept), key=str) and len(got) < len(docs) - 10


def test_string_dedup(spark, tables):
    docs, df, at = tables
    raws, seen = [(d[1] or "").encode() for d in docs], {}
    for raw in raws:
        for i in range(len(raw) - 199):
            seen[raw[i : i + 200]] = seen.get(raw[i : i + 200], 0) + 1
    want = []
    for d, raw in zip(docs, raws):
        hit = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                hit[i : i + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(int)))
        parts, at_, cut = [], 0, False
        for a, z in edges.reshape(-1, 2).tolist():
            whole = [m for m in re.finditer(rb"\S+", raw) if m.start() >= a and m.end() <= z]
            if len(whole) >= 50:
                parts.append(raw[at_:a])
                at_, cut = z, True
        text = b"".join(p.decode("utf-8", "ignore").encode() for p in [*parts, raw[at_:]]).decode() if cut else d[1]
        want.append((d[0], text, d[2], d[3], len(text) if cut else d[4]))
    got = rows_of(corpus_pipeline.string_dedup(spark, df, at))
    assert got == sorted(want, key=str)
    assert sum(a[1] != b[1] for a, b in zip(want, docs)) >= 3


def test_decontamination(spark, tables):
    docs, df, at = tables
    item = BENCH.findall(lower(spark.read.parquet(f"{at}/benchmark.parquet").where("item_id = 7").first().text))
    grams = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    want = []
    for d in docs:
        w, hit = BENCH.findall(lower(d[1])), set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in grams:
                hit.update(range(i, i + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(d[:5])
    assert rows_of(corpus_pipeline.decontamination(spark, df, at)) == sorted(want, key=str) and len(want) == len(docs) - 1


def test_tokens(spark, tables):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    docs, df, at = tables
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = sorted(((r.doc_id, r.lang, r.source, r.n_tokens, list(r.ids), r.decodes) for r in corpus_pipeline.tokens(spark, df, at).collect()), key=str)
    assert got == sorted(((d[0], d[2], d[3], len(x := enc.encode_ordinary(d[1] or "")), x, True) for d in docs), key=str)


def test_run_of_empty_tables(spark, tables, tmp_path):
    _, df, at = tables
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_the_stages_one_after_another(spark, tables, tmp_path):
    docs, df, at = tables
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = df
    for name, stage in corpus_pipeline.STAGES:
        by = stage(spark, by, at)
        if name != "tokens":
            assert by.columns == df.columns
            by.write.parquet(f"{tmp_path}/{name}")
            by = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(map(str, got)) == sorted(map(str, by.collect())) and 0 < len(got) < len(docs)
