"""Byte-level BPE encoding and decoding with DuckDB recursive queries per partition.

Each task holds one in-memory DuckDB database (one thread, a fixed memory limit) with the vocabulary
and its merge table: every way to cut a token in two tokens, ranked by the token. The different
words of a slice of texts become token-position rows; a recursive query joins adjacent positions
with the merge table and contracts each word's leftmost pair of minimum rank until no pair is left.
Ordered aggregation turns token rows back to bytes. A word that is a token itself needs no merging.

A word of over 256 bytes is merged by ``_encode_long``. A null text is an empty text: no ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from folioflow.llm.shared import bounded_batches
from folioflow.llm.textkit import slices

LONG = 256
#: some 300 bytes each
CACHE_WORDS = 500_000

#: The usual pattern, and the same one with its classes written out for texts below U+0100, which the
#: standard library matches faster.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

#: word_bytes holds a row per byte: k = 512 * word + position, its token, and the next row's k and token.
#: A step finds each word's least (rank, position) pair; the row there takes the merged token and the
#: following row's links, that row goes, and the row before learns the new token. A word without a
#: pair ends its rows (live is false).
ENCODE = """
WITH RECURSIVE step(k, id, nk, nid, live) AS (
  SELECT k, id, nk, nid, true FROM word_bytes
  UNION ALL
  SELECT r.k, CASE WHEN r.k = b.cut THEN b.new ELSE r.id END, CASE WHEN r.k = b.cut THEN t.nk ELSE r.nk END,
         CASE WHEN r.k = b.cut THEN t.nid WHEN r.nk = b.cut THEN b.new ELSE r.nid END, b.cut IS NOT NULL
  FROM (SELECT * FROM step WHERE live) r LEFT JOIN (
    SELECT w, w * 512 + best % 512 AS cut, (best // 512)::INT AS new, gone FROM (
      SELECT p.k // 512 AS w, min(m.id::BIGINT * 512 + p.k % 512) AS best, arg_min(p.nk, m.id::BIGINT * 512 + p.k % 512) AS gone
      FROM step p JOIN merges m ON m.a = p.id AND m.b = p.nid WHERE p.live GROUP BY 1)
  ) b ON b.w = r.k // 512 LEFT JOIN step t ON t.k = b.gone AND t.live AND r.k = b.cut
  WHERE b.gone IS NULL OR r.k <> b.gone
)
SELECT k // 512 AS w, string_agg(id, ',' ORDER BY k) AS ids, string_agg(v.chars, '' ORDER BY k) AS chars
FROM step JOIN vocab v USING (id) WHERE NOT live GROUP BY 1
"""

DECODE = """
SELECT r.w, string_agg(v.chars, '' ORDER BY r.pos) AS chars
FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM encoded) r JOIN vocab v USING (id) GROUP BY r.w
"""


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


class Codec:
    def __init__(self, vocabulary: str, pattern: str, memory: str = "300MB"):
        import duckdb

        self.pattern = regex.compile(pattern)
        self.latin = LATIN if pattern == USUAL else self.pattern
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        a, b, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                x, y = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if x is not None and y is not None:
                    a.append(x), b.append(y), rank.append(r)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False})
        ids = list(self.ranks.values())
        vocab = pa.table({"id": pa.array(ids, pa.int32()), "raw": pa.array(list(self.ranks), pa.binary()), "chars": [t.decode("latin-1") for t in self.ranks]})  # noqa: F841
        merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "id": pa.array(rank, pa.int32())})  # noqa: F841
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([x])] for x in range(256)], np.int32)
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.unlike: dict[str, bytes] = {}

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin.findall(text)

    def encode_words(self, raws: list[bytes], step: int = 20_000) -> list[tuple[str, bytes]]:
        """The comma-joined token ids of each word, and the bytes decoded from them."""
        out: list[tuple[str, bytes]] = [("", b"")] * len(raws)
        short = []
        for i, r in enumerate(raws):
            if r in self.ranks:
                out[i] = (str(self.ranks[r]), r)
            elif len(r) > LONG:
                ids = self._encode_long(r)
                out[i] = (",".join(map(str, ids)), b"".join([self.tokens[x] for x in ids]))
            elif r:
                short.append(i)
        for at in range(0, len(short), step):
            part = short[at : at + step]
            sizes = np.array([len(raws[i]) for i in part])
            ends = np.cumsum(sizes)
            ids = self.byte_ids[np.frombuffer(b"".join([raws[i] for i in part]), np.uint8)]
            k = np.repeat(np.arange(len(part), dtype=np.int64), sizes) * 512 + np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            nk, nid = np.append(k[1:], -1), np.append(ids[1:], -1).astype(np.int32)
            nk[ends - 1] = nid[ends - 1] = -1
            self.db.register("word_bytes", pa.table({"k": k, "id": ids, "nk": nk, "nid": nid}))
            for w, found, chars in self.db.execute(ENCODE).fetchall():
                out[part[w]] = (found, chars.encode("latin-1"))
        return out

    def _encode_long(self, raw: bytes) -> list[int]:
        """A word of many bytes: the same contraction, with the pairs of the word in a heap by
        (rank, position) instead of a query a merge, so that it takes n log n steps."""
        import heapq

        n = len(raw)
        ids = [self.ranks[raw[i : i + 1]] for i in range(n)]
        parts: list[bytes] = [raw[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or len(parts[i]) + len(parts[j]) != size or self.ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i], ids[i], alive[j] = parts[i] + parts[j], r, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (q := self.ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (q, x, len(parts[x]) + len(parts[y])))
        return [ids[i] for i in range(n) if alive[i]]

    def decode_rows(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids, by ordered aggregation."""
        out = [b""] * len(ids)
        unknown = {x for row in ids for x in row if x not in self.tokens}
        if unknown:
            raise ValueError(f"ids that the vocabulary doesn't have: {sorted(unknown, key=str)[:5]}")
        encoded = pa.table({"w": pa.array(range(len(ids)), pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))})  # noqa: F841
        for w, chars in self.db.execute(DECODE).fetchall():
            out[w] = chars.encode("latin-1")
        return out

    def learn(self, words: set[str]) -> None:
        """Encode and decode the words not met before. What a word's ids decode to is kept only where it is
        not the word itself."""
        if len(self.known) > CACHE_WORDS // 2:  # the last half stays, and of the half before what is met again
            self.known, self.before = {}, self.known
        unmet = [w for w in words if w not in self.known]
        new = [w for w in unmet if w not in self.before]
        self.known.update((w, self.before[w]) for w in unmet if w in self.before)
        if new:
            raws = [w.encode() for w in new]
            for w, raw, (ids, back) in zip(new, raws, self.encode_words(raws)):
                self.known[w] = ids
                if back != raw:
                    self.unlike[w] = back

    def decoded(self, words: list[str]) -> bytes:
        """The bytes that the words' ids decode to."""
        if self.unlike:
            return b"".join([self.unlike.get(w, w.encode()) for w in words])
        return "".join(words).encode()


def digests(batches, vocabulary: str, pattern: str):
    """Per row: id, n_tokens, sha256 of the comma-joined ids, sha256 of the bytes decoded from them."""
    c = codec(vocabulary, pattern)
    for b in slices(batches):
        rows: list[list] = [[], [], []]
        words = [c.split(t) for t in b.column("text").to_pylist()]
        c.learn(set().union(*words))
        for ws in words:
            ids = ",".join([c.known[w] for w in ws])
            rows[0].append(ids.count(",") + 1 if ws else 0)
            rows[1].append(hashlib.sha256(ids.encode()).hexdigest())
            rows[2].append(hashlib.sha256(c.decoded(ws)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoded(batches, vocabulary: str, pattern: str):
    """The rows with their token ids."""
    c = codec(vocabulary, pattern)
    for b in slices(batches):
        words = [c.split(t) for t in b.column("text").to_pylist()]
        c.learn(set().union(*words))
        ids = [np.fromstring(",".join([c.known[w] for w in ws]), np.int32, sep=",") if ws else np.zeros(0, np.int32) for ws in words]
        back = [c.decoded(ws) == (t or "").encode() for ws, t in zip(words, b.column("text").to_pylist())]
        ends = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        yield pa.RecordBatch.from_arrays([b.column("row"), lists, pa.array(back)], names=["row", "ids", "decodes"])


def decoded(batches, vocabulary: str, pattern: str):
    c = codec(vocabulary, pattern)
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(c.decode_rows([x or [] for x in part.column("ids").to_pylist()]), pa.binary())], names=["row", "decoded"])


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df, text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None):
    """df as a struct ``row``, the ``ids`` of its whole text, and whether their decoding is the text."""
    from functools import partial

    from pyspark.sql import functions as F

    bounded_batches(df.sparkSession)
    path, pat = default_vocabulary()
    src = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(partial(encoded, vocabulary=vocabulary or path, pattern=pattern or pat), f"row {kind}, ids array<int>, decodes boolean")


def decode(df, vocabulary: str | None = None, pattern: str | None = None):
    """(row, ids) to (row, decoded bytes). Null ids are no ids; an id that the vocabulary doesn't have is an
    error, not a gap."""
    from functools import partial

    bounded_batches(df.sparkSession)
    path, pat = default_vocabulary()
    kind = df.schema["row"].dataType.simpleString()
    return df.select("row", "ids").mapInArrow(partial(decoded, vocabulary=vocabulary or path, pattern=pattern or pat), f"row {kind}, decoded binary")


def token_digests(df, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None):
    from functools import partial

    from pyspark.sql import functions as F

    bounded_batches(df.sparkSession)
    path, pat = default_vocabulary()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(partial(digests, vocabulary=vocabulary or path, pattern=pattern or pat), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
