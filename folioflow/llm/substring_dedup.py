"""Substring dedup over sliding sentence spans.

A text is cut after every sentence end (``. ! ?`` and what closes it, before white space; the full-width
ends also without it) and at line ends; a sentence of over ``long`` words is cut further at clause marks,
and a piece that still is as long before every word whose hash is a multiple of 8, so the same words are
cut alike wherever they stand. A run is at least ``run`` consecutive sentences that hold at least
``min_words`` words, so stock phrases stay; a text of fewer sentences is one run if it holds the words. The
first place of a repeated run, by (id, text's hash, position), stays, and the sentences of every other
place go, with the white space behind them.

Hashed (124 bits, over the words with A-Z in lower case, whatever white space parts them) and joined globally
are, from every sentence on and up to every sentence, the shortest run: they cover a repeated run of any
length from its first sentence to its last, however short its sentences are. Han and kana characters,
which no space parts, count as words beside the words that white space parts.

Sentences are found and hashed in numpy; counting, the first places and the join back are DataFrame
operations. The first place of a hash is a minimum, combined before the shuffle, so a run that a third of
all texts hold costs one row per task; the join back is an equi-join that the engine splits when a key is
hot. Only hashes met twice or more are joined; their table stays in the shared folder, since the result reads it.

Null or empty texts have no sentences, lose nothing and are kept as ''. Null ids sort before all. Rows
with equal ids and equal texts are one place: none of them repeats another. Texts of equal ids that differ are
told apart by their texts' hashes. Columns of df other than the two named don't matter.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import bounded_batches, drop, keep, tidy
from folioflow.llm.textkit import SPACE, Words, buffers, sequence_hash, slices, span_hash

_CLOSE = "(?:[\"')\\]]|»|”|’|」|』|）|】)".encode()
_GAP = rb"[ \t\x0B\f\r\n]"
ENDS = re.compile("(?:[.!?]|…)".encode() + _CLOSE + rb"{0,3}" + _GAP + rb"+|" + "(?:。|！|？|｡)+".encode() + _CLOSE + rb"{0,3}" + _GAP + rb"*|\n+")
CLAUSES = re.compile(rb"[,;:]" + _CLOSE + rb"{0,3}" + _GAP + rb"+|" + "(?:，|；|：|、)".encode())


#: bytes that a sentence's end may begin with, by what must follow them
_ENDER, _AFTER = np.zeros(256, bool), np.ones(256, bool)
_ENDER[list(b".!?")] = True
_AFTER[[x for x in range(128) if x not in b" \t\x0B\f\r\n\"')]"]] = False
_WIDE = [np.frombuffer(c.encode(), np.uint8) for c in "…。！？｡"]


def ends_of(data: np.ndarray, raw: bytes, offsets: np.ndarray) -> list[int]:
    """Where ``ENDS`` ends in each text: tried only at bytes that can begin it."""
    room = len(data)
    may = data == 10
    may[:-1] |= _ENDER[data[:-1]] & _AFTER[data[1:]]
    lead = np.flatnonzero((data == 0xE2) | (data == 0xE3) | (data == 0xEF))
    lead = lead[lead + 2 < room]
    for c in _WIDE:
        may[lead[(data[lead] == c[0]) & (data[lead + 1] == c[1]) & (data[lead + 2] == c[2])]] = True
    at = np.flatnonzero(may)
    stop = offsets[np.searchsorted(offsets, at, "right")] if len(at) else at
    out, done, match = [], 0, ENDS.match
    for q, hi in zip(at.tolist(), stop.tolist()):
        if q >= done and (m := match(raw, q, hi)):
            done = m.end()
            out.append(done)
    return out


class Sentences:
    """The sentences with words of a slice: ``start`` (byte), ``n_words``, ``words`` (first and last,
    exclusive), ``first`` (index of each document's first sentence, one more entry than documents)."""

    def __init__(self, texts: pa.Array, long: int):
        data, offsets = buffers(texts)
        raw = data.tobytes()
        cuts = ends_of(data, raw, offsets)
        lead = (data >= 0xE4) & (data <= 0xE9)
        lead[:-1] |= (data[:-1] == 0xE3) & (data[1:] >= 0x81)
        unspaced = np.concatenate([[0], np.cumsum(lead)])
        self._cut(data, np.concatenate([offsets, cuts]).astype(np.int64), unspaced)
        if (self.n_words > long).any():
            which = np.flatnonzero(self.n_words > long)
            more = [m.end() for lo, hi in zip(self.bounds[which].tolist(), self.bounds[which + 1].tolist()) for m in CLAUSES.finditer(raw, lo, hi)]
            self._cut(data, np.concatenate([self.bounds, more]).astype(np.int64), unspaced)
        if (self.n_words > long).any():
            w = self._words
            inside = np.flatnonzero(np.repeat(self.n_words > long, w.counts))
            hashes = span_hash(w.prefix, w.start[inside], w.end[inside])
            self._cut(data, np.concatenate([self.bounds, w.start[inside[hashes % np.uint64(8) == 0]]]), unspaced)
        worded = np.flatnonzero(self._words.counts > 0)
        self.start, self.n_words = self.bounds[worded], self.n_words[worded]
        self.words = self._words.first[worded], self._words.first[worded + 1]
        self.first = np.searchsorted(self.start, offsets)

    @property
    def hash(self) -> np.ndarray:
        return self._words.hash

    def _cut(self, data: np.ndarray, bounds: np.ndarray, unspaced: np.ndarray) -> None:
        self.bounds = np.unique(np.append(bounds, len(data)))
        if len(self.bounds) < 2:
            self.bounds = np.zeros(2, np.int64)
        known = getattr(self, "_words", None)
        self._words = Words(data, self.bounds, SPACE, True)
        if known is not None and "prefix" in vars(known):  # the bytes are the same
            self._words.prefix = known.prefix
        self.n_words = self._words.counts + unspaced[self.bounds[1:]] - unspaced[self.bounds[:-1]]


def shortest_runs(s: Sentences, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) sentences, to exclusive, of the shortest runs from every sentence and up to every one."""
    n = len(s.start)
    many = np.diff(s.first)
    least = np.repeat(np.minimum(run, many), many)
    begin, end = np.repeat(s.first[:-1], many), np.repeat(s.first[1:], many)
    total = np.concatenate([[0], np.cumsum(s.n_words)])
    at = np.arange(n)
    to = np.maximum(np.searchsorted(total, total[:-1] + min_words), at + least)
    fits = to <= end
    since = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, at + 1 - least)
    other = since >= begin
    other[other] = to[since[other]] != at[other] + 1
    return np.concatenate([at[fits], since[other]]), np.concatenate([to[fits], at[other] + 1])


def _runs(batches, run: int, min_words: int, long: int):
    for b in slices(batches):
        s = Sentences(b.column("text"), long)
        since, to = shortest_runs(s, run, min_words)
        h1, h2 = sequence_hash(s.hash, s.words[0][since], s.words[1][to - 1])
        doc = np.searchsorted(s.first, since, "right") - 1
        rows = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(rows), b.column("th").take(rows), pa.array((since - s.first[doc]).astype(np.int32)), pa.array((to - since).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
            names=["id", "th", "pos", "n", "h1", "h2"],
        )


def _rest(batches, long: int):
    for b in slices(batches):
        texts, places = b.column("text"), b.column("places").to_pylist()
        s = Sentences(texts, long)
        first = s.first.tolist()
        _, offsets = buffers(texts)
        gone, kept = [], []
        for i, p in enumerate(places):
            went = np.zeros(first[i + 1] - first[i], bool)
            for x in p or ():
                went[x["pos"] : x["pos"] + x["n"]] = True
            gone.append(np.flatnonzero(went).tolist())
            raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
            if gone[-1]:
                edges = np.append(s.start[first[i] : first[i + 1]], offsets[i + 1]) - offsets[i]
                raw = raw[: edges[0]] + b"".join(raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~went))
            kept.append(raw.decode())
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(np.diff(s.first), pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(kept, pa.string())],
            names=["id", "n_sentences", "gone", "kept_text"],
        )


@tidy
def repeated_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, min_words: int = 20, long: int = 40) -> DataFrame:
    """(id, n_sentences, gone, kept_text): per row of df the positions of the sentences removed and the
    text without them."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    every = keep(docs.mapInArrow(partial(_runs, run=run, min_words=min_words, long=long), f"id {kind}, th bigint, pos int, n int, h1 bigint, h2 bigint"))
    # most runs stand in one place only: counts of one hash alone, the least that can tell, leave them out first
    often = every.groupBy("h1").agg(F.count("*").alias("n_places")).where("n_places > 1").select("h1")
    again = keep(every.join(often, "h1"))
    drop(every)
    first = again.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "pos")).alias("first"))
    later = again.join(first, ["h1", "h2"]).where(~F.struct("id", "th", "pos").eqNullSafe(F.col("first")))
    places = later.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "n")).alias("places"))
    found = places.select(F.col("id").alias("gid"), F.col("th").alias("gth"), "places")
    out = docs.join(found, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left").select("id", "text", "places")
    got = out.mapInArrow(partial(_rest, long=long), f"id {kind}, n_sentences bigint, gone array<int>, kept_text string")
    return got.withColumnRenamed("id", id_col)
