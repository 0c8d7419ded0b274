import base64
import hashlib
import random

import tiktoken

from folioflow.llm.bpe import codec, decode, default_vocabulary, encode, token_digests


def reference():
    path, pattern = default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "Hello wörld, Ünï 123456 \n\n  x", "a" * 1500, "ab" * 700, "\0\1 zéro", "<|endoftext|>", "日本語テキスト 🙂🙃", "aaaa " * 50, "antidisestablishmentarianism ththhtion", "é" * 400]


def test_words_match_tiktoken(spark):
    enc, rnd = reference(), random.Random(5)
    c = codec(*default_vocabulary())
    words = {"".join(rnd.choice("abcthioné ñ") for _ in range(rnd.randrange(1, 30))) for _ in range(3000)}
    words |= {"".join(rnd.choice("ab") for _ in range(n)) for n in (255, 256, 257, 900)}
    words = sorted(words)
    for w, (ids, raw) in zip(words, c.encode_words([w.encode() for w in words])):
        assert ids == ",".join(map(str, enc._encode_single_piece(w.encode()))), w
        assert raw == w.encode()


def test_digests(spark):
    enc = reference()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, *TEXTS])], "doc_id bigint, text string, id int")
    got = {r.doc_id: r for r in token_digests(df).collect()}
    for i, t in enumerate(TEXTS * 2):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert token_digests(df.limit(0)).count() == 0


def test_round_trip_keeps_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    out = decode(encode(df)).collect()
    assert sorted((r.row.doc_id, bytes(r.decoded)) for r in out) == [(i, (t or "").encode()) for i, t in enumerate(TEXTS)]


def test_latin_split_is_the_pattern():
    c = codec(*default_vocabulary())
    assert c.latin is not c.pattern
    for i in range(256):
        for x in (chr(i), "a" + chr(i), chr(i) + "a", "1" + chr(i), " " + chr(i), chr(i) + " ", "  " + chr(i), "#" + chr(i)):
            assert c.split(x) == c.pattern.findall(x)
