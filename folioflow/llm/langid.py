"""Language ID by segmentation-marginalised unigrams.

Each language gives every piece of a fixed public vocabulary (byte fallback included) a probability. A
word's probability is the sum over all ways to cut it into pieces, by the forward algorithm; a text's is
the product over its whitespace-separated lower-cased words, each behind a word mark. The piece
probabilities are learned from all training texts: one expectation step (forward-backward) under a
Zipf prior over the vocabulary's order gives each language's expected piece counts, which are summed.

Words are treated by type: a slice's different words are scored once, in numpy, all words of one
length together; scores of types are kept per task up to a bound. Probabilities are rescaled on the way; words
of many bytes, or of probabilities too small for that, are treated one by one in logarithms, with the same
sums. Texts are scored whole. The prediction maximises the likelihood; the score is
its posterior under equal priors. Null texts and texts without a letter are ``und`` with score 0, and so
is every text if nothing was learned.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import bounded_batches
from folioflow.llm.textkit import LOWER, SPACE, Words, buffers, mix, powers, slices

#: words of at most so many bytes are scored, or learned from, together with others of their length
SCORED, LEARNED, KEPT_TYPES = 64, 24, 600_000
#: positions between two rescalings, and the most words in one group
RESCALE, GROUP = 16, 20_000
#: text bytes whose words are looked up together: each length of words costs some hundred calls a slice
SLICE = 2_000_000
MARK = "▁".encode()
_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def light_prefix(data: np.ndarray) -> np.ndarray:
    """Running sums of one polynomial: pieces are so short that one tells them from each other."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(len(data)).up[: len(data)], out=sums[1:])
    return sums


def light_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix) - 1).down[start] + (end - start).astype(np.uint64))


class Pieces:
    """The vocabulary by hash: two open tables, the second for what collides in the first."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        raw: dict[bytes, None] = {bytes([b]): None for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                raw.setdefault(sp.id_to_piece(i).encode())
        self.raw = list(raw)
        self.lengths = sorted({len(r) for r in self.raw})
        self.longest = self.lengths[-1]
        n = len(self.raw)
        prior = 1.0 / (np.arange(n) + 100.0)
        prior[:256] = 1e-7  # byte fallback
        self.prior = prior / prior.sum()
        ends = np.cumsum([len(r) for r in self.raw])
        self.hash = light_hash(light_prefix(np.frombuffer(b"".join(self.raw), np.uint8)), np.append(0, ends[:-1]), ends)
        self.one = np.full(1 << 20, -1, np.int32)
        self.two = np.full(1 << 20, -1, np.int32)
        for i, h in enumerate(self.hash.tolist()):
            table, slot = (self.one, h >> 44) if self.one[h >> 44] < 0 else (self.two, h & 0xFFFFF)
            while table[slot] >= 0 and table is self.two:
                raise ValueError("vocabulary hashes collide")
            table[slot] = i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers; -1 where there is none."""
        i = self.one[(h >> np.uint64(44)).astype(np.int64)]
        miss = self.hash[i] != h
        i[miss] = self.two[(h[miss] & np.uint64(0xFFFFF)).astype(np.int64)]
        i[self.hash[i] != h] = -1
        return i


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> Pieces:
    return Pieces(vocabulary)


def forward(words: np.ndarray, p: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows, equally long) in each language (columns), summed over
    segmentations."""
    n, size = words.shape
    prefix = light_prefix(words.reshape(-1))
    base = np.arange(n) * size
    alpha = [np.ones((n, probs.shape[1]))]
    log = np.zeros_like(alpha[0])
    for j in range(1, size + 1):
        now = np.zeros_like(log)
        for i in (j - d for d in p.lengths if d <= j):
            ids = p.find(light_hash(prefix, base + i, base + j))
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                now[rows] += alpha[i][rows] * probs[ids[rows]]
        alpha.append(now)
        if j % RESCALE == 0 and j < size:
            live = range(max(0, j + 1 - p.longest), j + 1)
            top = np.max([alpha[i] for i in live], axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                log += np.log(top)
                for i in live:
                    alpha[i] = alpha[i] / top
            alpha[: live[0]] = [None] * live[0]
    with np.errstate(divide="ignore"):
        log += np.log(alpha[size])
    # where all that a window holds is too small beside its first position
    for k in np.flatnonzero(~np.isfinite(log).all(axis=1)):
        log[k] = forward_long(words[k], p, probs)
    return log


def spans(word: np.ndarray, p: Pieces) -> np.ndarray:
    """Piece numbers (end, length - 1) of all spans of one word, -1 where there is none."""
    prefix = light_prefix(word)
    out = np.full((len(word) + 1, min(p.longest, len(word))), -1, np.int32)
    for d in (x for x in p.lengths if x <= len(word)):
        at = np.arange(len(word) - d + 1)
        out[d:, d - 1] = p.find(light_hash(prefix, at, at + d))
    return out


def forward_long(word: np.ndarray, p: Pieces, probs: np.ndarray, logs: np.ndarray | None = None) -> np.ndarray:
    """``forward`` of one word of any length and any small probabilities, in logarithms, holding as many
    positions as the longest piece has bytes."""
    pieces_of, logs = spans(word, p), np.log(probs) if logs is None else logs
    width = pieces_of.shape[1]
    alpha = np.full((width, probs.shape[1]), -np.inf)  # row d: d + 1 bytes back
    alpha[0] = 0
    for j in range(1, len(word) + 1):
        d = np.flatnonzero(pieces_of[j] >= 0)
        now = np.logaddexp.reduce(alpha[d] + logs[pieces_of[j, d]], axis=0)
        alpha[1:] = alpha[:-1]
        alpha[0] = now
    return alpha[0]


def expected(words: np.ndarray, weights: np.ndarray, p: Pieces, out: np.ndarray) -> None:
    """Add equally long words' expected piece counts under the prior, times their weights per language, to out."""
    n, size = words.shape
    prefix = light_prefix(words.reshape(-1))
    base = np.arange(n) * size
    edges = {}
    for j in range(1, size + 1):
        for i in (j - d for d in p.lengths if d <= j):
            ids = p.find(light_hash(prefix, base + i, base + j))
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                edges[i, j] = rows, ids[rows]
    alpha, beta = np.zeros((size + 1, n)), np.zeros((size + 1, n))
    alpha[0] = beta[size] = 1
    for (i, j), (rows, ids) in edges.items():  # by j
        alpha[j, rows] += alpha[i, rows] * p.prior[ids]
    for (i, j), (rows, ids) in sorted(edges.items(), key=lambda x: -x[0][0]):
        beta[i, rows] += p.prior[ids] * beta[j, rows]
    for (i, j), (rows, ids) in edges.items():
        share = alpha[i, rows] * p.prior[ids] * beta[j, rows] / alpha[size, rows]
        for k in range(weights.shape[1]):
            out[k] += np.bincount(ids, share * weights[rows, k], len(p.prior))


def expected_long(word: np.ndarray, weight: np.ndarray, p: Pieces, out: np.ndarray) -> None:
    """``expected`` of one word of any length, in logarithms."""
    pieces_of = spans(word, p)
    n, width = len(word), pieces_of.shape[1]
    prior = np.append(np.log(p.prior), -np.inf)[pieces_of]  # -1 is the last, no probability
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0
    back = np.arange(1, width + 1)
    for j in range(1, n + 1):
        d = back[: min(j, width)]
        alpha[j] = np.logaddexp.reduce(alpha[j - d] + prior[j, d - 1])
    for i in range(n - 1, -1, -1):
        d = back[: min(n - i, width)]
        beta[i] = np.logaddexp.reduce(beta[i + d] + prior[i + d, d - 1])
    for d in range(1, width + 1):
        j = d + np.flatnonzero(pieces_of[d:, d - 1] >= 0)
        ids = pieces_of[j, d - 1]
        share = np.exp(alpha[j - d] + prior[j, d - 1] + beta[j] - alpha[n])
        for k in np.flatnonzero(weight):
            out[k] += np.bincount(ids, share * weight[k], len(p.prior))


def _groups(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int):
    """Words behind a word mark, lower-cased: (indices, their bytes in rows) of equally long ones together, and
    those of over ``most`` bytes one by one."""
    mark = np.frombuffer(MARK, np.uint8)
    size = end - start
    for s in np.unique(size[size <= most]):
        group = np.flatnonzero(size == s)
        for lo in range(0, len(group), GROUP):
            g = group[lo : lo + GROUP]
            yield g, np.concatenate([np.tile(mark, (len(g), 1)), LOWER[data[start[g][:, None] + np.arange(s)]]], 1)
    for g in np.flatnonzero(size > most):
        yield np.array([g]), np.concatenate([mark, LOWER[data[start[g] : end[g]]]])[None, :]


def _types(b: pa.RecordBatch):
    data, offsets = buffers(b.column("text"))
    words = Words(data, offsets, SPACE, True)
    hashes, sample, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    return data, words, hashes, sample, inverse


def _learn(batches, vocabulary: str, langs: list[str]):
    p = pieces(vocabulary)
    out = np.zeros((len(langs), len(p.prior)))
    number = {x: k for k, x in enumerate(langs)}
    blob: list[bytes] = []
    hashes, counts = np.zeros(0, np.uint64), np.zeros((0, len(langs)))

    def flush():
        sizes = np.array([len(w) for w in blob])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(blob), np.uint8)
        for which, words in _groups(data, ends - sizes, ends, LEARNED):
            if words.shape[1] > LEARNED + len(MARK):
                expected_long(words[0], counts[which[0]], p, out)
            else:
                expected(words, counts[which], p, out)

    for b in slices(batches, limit=SLICE):
        data, words, own, sample, inverse = _types(b)
        lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
        tally = np.bincount(inverse * len(langs) + lang[words.doc], minlength=len(own) * len(langs)).reshape(len(own), len(langs))
        order = np.argsort(hashes)
        at = np.searchsorted(hashes, own, sorter=order) if len(hashes) else np.zeros(len(own), np.int64)
        place = order[np.minimum(at, len(order) - 1)] if len(order) else np.zeros(len(own), np.int64)
        met = hashes[place] == own if len(hashes) else np.zeros(len(own), bool)
        counts[place[met]] += tally[met]
        raw = data.tobytes()
        blob += [raw[s:e] for s, e in zip(words.start[sample[~met]].tolist(), words.end[sample[~met]].tolist())]
        hashes, counts = np.concatenate([hashes, own[~met]]), np.concatenate([counts, tally[~met]])
        if len(blob) > KEPT_TYPES // 2:
            flush()
            blob, hashes, counts = [], hashes[:0], counts[:0]
    if blob:
        flush()
    k, i = np.nonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(np.array(langs, object)[k], pa.string()), pa.array(i, pa.int32()), pa.array(out[k, i])], names=["lang", "piece", "n"])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def learn(texts: DataFrame, vocabulary: str | None = None, max_langs: int = 512) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from rows (text, lang). What returns to the driver is one count
    per language and piece of the fixed vocabulary; over ``max_langs`` languages are an error."""
    vocabulary = vocabulary or default_vocabulary()
    bounded_batches(texts.sparkSession)
    texts = texts.where("lang is not null and text is not null")
    langs = sorted(r[0] for r in texts.select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    p = pieces(vocabulary)
    counts = np.zeros((len(langs), len(p.prior)))
    if langs:

        def run(batches):
            return _learn(batches, vocabulary, langs)

        number = {x: k for k, x in enumerate(langs)}
        for r in texts.select("text", "lang").mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[number[r.lang], r.piece] = r.n
    counts += 50 * p.prior
    return langs, counts / counts.sum(axis=1, keepdims=True)


def _letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predict(batches, vocabulary: str, langs: list[str], probs: np.ndarray):
    p = pieces(vocabulary)
    known, scores = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
    table = np.ascontiguousarray(probs.T)
    logs = np.log(table)
    for b in slices(batches, limit=SLICE):
        data, words, own, sample, inverse = _types(b)
        if len(known) > KEPT_TYPES:
            known, scores = known[:0], scores[:0]
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        new = known[at] != own if len(known) else np.ones(len(own), bool)
        fresh = np.zeros((int(new.sum()), len(langs)))
        for which, rows in _groups(data, words.start[sample[new]], words.end[sample[new]], SCORED):
            fresh[which] = forward_long(rows[0], p, table, logs) if rows.shape[1] > SCORED + len(MARK) else forward(rows, p, table)
        mine = np.empty((len(own), len(langs)))
        mine[~new], mine[new] = scores[at[~new]] if len(known) else fresh[:0], fresh
        merged = np.concatenate([known, own[new]])
        order = np.argsort(merged, kind="stable")
        known, scores = merged[order], np.concatenate([scores, fresh])[order]
        total = np.zeros((len(words.hash) + 1, len(langs)))
        np.cumsum(mine[inverse], axis=0, out=total[1:])
        likelihood = total[words.first[1:]] - total[words.first[:-1]]
        letters = np.array([_letters(t) for t in b.column("text").to_pylist()], bool) & bool(langs)
        if langs:
            best = likelihood.argmax(axis=1)
            posterior = 1 / np.exp(np.maximum(likelihood - likelihood.max(axis=1, keepdims=True), -700)).sum(axis=1)
        else:
            best, posterior = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
        names = np.array([*langs, "und"], object)[np.where(letters, best, len(langs))]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(names, pa.string()), pa.array(np.where(letters, posterior, 0.0))], names=["row", "lang_pred", "score"])


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(row, lang_pred, score) of every row of df."""
    bounded_batches(df.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    langs, shared = model[0], df.sparkSession.sparkContext.broadcast(model[1])
    src = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["row"].dataType.simpleString()

    def run(batches):
        return _predict(batches, vocabulary, langs, shared.value)

    return src.mapInArrow(run, f"row {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    remainder = "crc32(cast({} as string)) % 3"
    model = learn(docs.where(f"coalesce({remainder.format('doc_id')} <> 1, false)").select(F.col("text").cast("string").alias("text"), "lang"))
    got = predict(docs.select("doc_id", "text"), model)
    return got.select("row.doc_id", F.expr(f"coalesce({remainder.format('row.doc_id')} = 1, false)").alias("held_out"), "lang_pred", "score")
