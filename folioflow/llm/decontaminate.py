"""Benchmark decontamination by a distributed positional inverted index.

The index is stored as segments: each slice of training texts is one row of a table in the shared folder,
with its terms (hashes) in order, how often each is there, and their positions. A search goes in steps that
meet in joins, so neither the corpus nor the benchmark is ever on one machine:

1. the benchmark's items become windows of ``n`` words, equal ones one row;
2. the segments count the windows' terms, which ranks each window's terms from the rarest on; a window
   with a term that no text has is out;
3. the segments give the positions of the windows' rarest and second rarest terms alone; places of the rarest term
   that have the second one near in the same segment are the candidates;
4. each segment takes its candidates' other terms from the rarest on and intersects their position lists,
   adjusted by their offsets, with the starts still alive: what stays is an exact match. A proximity match
   is a place of the rarest term with every other term within ``span`` words in the same text.

Segments are stored compressed and meet their candidates in one shuffle by segment. Sides that don't grow with the
corpus are broadcast if their measured bytes are at most ``BROADCAST``, and else both sides are shuffled. Terms that all segments must look up
travel in blocks of at most ``BLOCK`` terms.

Null and empty texts have no words; texts are told apart by their content, so rows with equal texts have equal
results, whatever their ids. Rows of the benchmark with equal item ids are one item; a null id is an item of its
own, shown as ''. An empty benchmark hits nothing. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import bounded_batches, drop, keep, tidy
from folioflow.llm.textkit import LOWER, NON_ALNUM, buffers, kernel, release, slices

#: terms in one block of lookups, 0.5 MB
BLOCK = 65_536
#: bytes up to which a side of a join is broadcast
BROADCAST = 32_000_000
#: windows whose candidates one segment takes at once
WINDOWS = 20_000

_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
SEGMENT = "segment binary, keys binary, first binary, terms binary, counts binary, positions binary"


def pack(values: np.ndarray) -> bytes:
    """An array's bytes, all first bytes before all second ones and so on, compressed."""
    import zstandard

    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def _index(batches):
    for b in slices(batches):
        words = kernel(b.column("text"), NON_ALNUM, True)
        order = np.argsort(words.hash, kind="stable").astype(np.uint32)
        terms, counts = np.unique(words.hash, return_counts=True)
        keys = b"".join(b.column("key").to_pylist())
        row = [hashlib.md5(keys).digest(), keys, *map(pack, (words.first.astype(np.uint32), terms, counts.astype(np.uint32), order))]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["segment", "keys", "first", "terms", "counts", "positions"])


class Segment:
    """Postings of one stored row."""

    def __init__(self, row: dict):
        get = lambda k, kind: unpack(row[k], kind)
        self.terms, counts = get("terms", np.uint64), get("counts", np.uint32)
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts
        self.positions, self.first = get("positions", np.uint32).astype(np.int64), get("first", np.uint32).astype(np.int64)

    def of(self, term: int) -> np.ndarray:
        """The positions of a term, ascending."""
        i = int(np.searchsorted(self.terms, np.uint64(term)))
        if i == len(self.terms) or self.terms[i] != np.uint64(term):
            return self.positions[:0]
        return self.positions[self.starts[i] : self.ends[i]]

    def inside(self, starts: np.ndarray, n: int) -> np.ndarray:
        """The starts from which n words stand in one text."""
        starts = starts[(starts >= 0) & (starts + n <= self.first[-1])] if len(self.first) else starts[:0]
        return starts[self.first[np.searchsorted(self.first, starts, "right")] >= starts + n]

    def phrase(self, terms: np.ndarray, order: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Starts of the whole phrase; order: its offsets from the rarest term on; places: where that one is."""
        found = self.inside(places - order[0], len(terms))
        for offset in order[1:]:
            if not len(found):
                break
            at = self.of(terms[offset])
            i = np.searchsorted(at, found + offset)
            fits = i < len(at)
            fits[fits] = at[i[fits]] == found[fits] + offset
            found = found[fits]
        return found

    def near(self, terms: np.ndarray, order: np.ndarray, places: np.ndarray, span: int) -> np.ndarray:
        """Places of the rarest term that have every other term within ``span`` words in the same text."""
        doc = np.searchsorted(self.first, places, "right") - 1
        low, high = np.maximum(places - span, self.first[doc]), np.minimum(places + span, self.first[doc + 1] - 1)
        for offset in order[1:]:
            if not len(places):
                break
            at = self.of(terms[offset])
            left = np.searchsorted(at, low)
            fits = left < len(at)
            fits[fits] = at[left[fits]] <= high[fits]
            places, low, high = places[fits], low[fits], high[fits]
        return places


def _lookup(batches, with_positions: bool):
    """How often, or where, the wanted terms of a block stand in a segment."""
    for b in batches:
        for row in b.to_pylist():
            terms, counts, wanted = unpack(row["terms"], np.uint64), unpack(row["counts"], np.uint32), np.frombuffer(row["wanted"], np.uint64)
            at = np.flatnonzero(np.isin(terms, wanted, assume_unique=True))
            cols = [pa.array(terms[at].view(np.int64)), pa.array(counts[at].astype(np.int64))]
            if with_positions:
                ends = np.cumsum(counts, dtype=np.int64)
                raw = unpack(row["positions"], np.uint32).tobytes()
                places = [raw[4 * (ends[i] - int(counts[i])) : 4 * ends[i]] for i in at.tolist()]
                cols = [pa.array([row["segment"]] * len(at), pa.binary()), cols[0], pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["segment", "term", "places"] if with_positions else ["term", "n"])
    release()


def _near_second(batches, width: int):
    """Candidates with the places that have one of the second term's within ``width`` words, if there is one."""
    for b in batches:
        out: list[list] = [[], [], []]
        for segment, wid, second, one, two in zip(*(b.column(k).to_pylist() for k in ("segment", "wid", "second", "places", "others"))):
            if second is not None:
                if two is None:
                    continue
                at, others = np.frombuffer(one, np.uint32).astype(np.int64), np.frombuffer(two, np.uint32)
                left = np.searchsorted(others, at - width)
                fits = left < len(others)
                fits[fits] = others[left[fits]] <= at[fits] + width
                if not fits.any():
                    continue
                one = at[fits].astype(np.uint32).tobytes()
            for col, v in zip(out, (segment, wid, one)):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["segment", "wid", "places"])


def _match(batches, span: int | None):
    """Per text with a match: its key, the spans of its words hit, the windows in it and the near ones."""
    for b in batches:
        for row in b.to_pylist():
            s = Segment(row)
            doc_of = lambda at: np.searchsorted(s.first, at, "right") - 1
            spans: dict[int, list[dict]] = {}
            exact: dict[int, dict] = {}
            close: dict[int, dict] = {}
            for c in row["candidates"]:
                terms, order, places = np.frombuffer(c["words"], np.uint64), np.array(c["order"]), np.frombuffer(c["places"], np.uint32).astype(np.int64)
                starts = s.phrase(terms, order, places)
                for d, at in zip(doc_of(starts).tolist(), starts.tolist()):
                    exact.setdefault(d, {})[c["wid"]] = None
                    spans.setdefault(d, []).append({"a": at - int(s.first[d]), "z": at - int(s.first[d]) + len(terms)})
                if span is not None:
                    for d in np.unique(doc_of(s.near(terms, order, places, span))).tolist():
                        close.setdefault(d, {})[c["wid"]] = None
            docs = sorted({*exact, *close})
            keys = [row["keys"][16 * d : 16 * d + 16] for d in docs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([spans.get(d, []) for d in docs], _SPANS), *(pa.array([list(x.get(d, ())) for d in docs], pa.list_(pa.binary())) for x in (exact, close))],
                names=["key", "spans", "exact", "close"],
            )
    release()


def _windows(batches, n: int):
    """(item, none, wid, words): the different windows of each item; an item of fewer words is one."""
    for b in slices(batches):
        words = kernel(b.column("text"), NON_ALNUM, True)
        rows, found = [], []
        for i in range(b.num_rows):
            raw = words.hash[words.first[i] : words.first[i + 1]].tobytes()
            if raw:
                own = {raw[8 * j : 8 * (j + n)] for j in range(max(1, len(raw) // 8 - n + 1))}
                rows += [i] * len(own)
                found += sorted(own)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("item").take(at), b.column("none").take(at), pa.array([hashlib.md5(x).digest() for x in found], pa.binary()), pa.array(found, pa.binary())], names=["item", "none", "wid", "words"])


def _terms(batches):
    """(wid, words, term, offsets): a window's different terms with the offsets where they stand."""
    for b in batches:
        rows: list[list] = [[], [], [], []]
        for wid, raw in zip(b.column("wid").to_pylist(), b.column("words").to_pylist()):
            at: dict[int, list[int]] = {}
            for j, t in enumerate(np.frombuffer(raw, np.int64).tolist()):
                at.setdefault(t, []).append(j)
            for t, offsets in at.items():
                for col, v in zip(rows, (wid, raw, t, offsets)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32())))], names=["wid", "words", "term", "offsets"])


def _packed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([np.sort(np.array(x, np.int64).view(np.uint64)).tobytes() for x in b.column("terms").to_pylist()], pa.binary())], names=["wanted"])


def _small(df: DataFrame, size: Column) -> DataFrame:
    """df with a broadcast hint if its bytes, measured, are at most ``BROADCAST``."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST else df


def _blocks(terms: DataFrame) -> DataFrame:
    """Different terms packed in rows of about ``BLOCK``: the query set that every segment looks up."""
    n = max(1, -(-terms.count() // BLOCK))
    packed = terms.groupBy(F.pmod(F.xxhash64("term"), F.lit(n)).alias("block")).agg(F.collect_list("term").alias("terms"))
    return _small(packed.select("terms").mapInArrow(_packed, "wanted binary"), F.octet_length("wanted"))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def index(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The stored segments (``SEGMENT``) of df's texts."""
    bounded_batches(df.sparkSession)
    text = F.col(text_col).cast("string")
    return keep(df.select(text_key(text).alias("key"), text.alias("text")).where("text <> ''").mapInArrow(_index, SEGMENT))


def windows(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", n: int = 13) -> DataFrame:
    """The stored windows (item, none, wid, words) of the benchmark's items."""
    bounded_batches(benchmark.sparkSession)
    item = F.col(item_col).cast("string")
    rows = benchmark.select(F.coalesce(item, F.lit("")).alias("item"), item.isNull().alias("none"), F.col(item_text_col).cast("string").alias("text"))
    return keep(rows.where("text is not null").mapInArrow(partial(_windows, n=n), "item string, none boolean, wid binary, words binary").distinct())


@tidy
def search(segments: DataFrame, queries: DataFrame, span: int | None = None) -> DataFrame:
    """(key, n_hit, exact, close) per text of the index in which a window stands exactly, or has all its terms
    within ``span`` words of its rarest one: the words in exact matches, and the windows' ids."""
    different = queries.select("wid", "words").distinct()
    each = keep(different.mapInArrow(_terms, "wid binary, words binary, term bigint, offsets array<int>"))
    asked = segments.select("terms", "counts").crossJoin(_blocks(each.select("term").distinct()))
    known = keep(asked.mapInArrow(partial(_lookup, with_positions=False), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")))
    # every term with its offsets, from the rarest on; a window with a term that isn't there is out
    ranked = each.join(known, "term").groupBy("wid", "words").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offsets"))).alias("r"))
    order = F.flatten(F.transform("r", lambda x: x["offsets"]))
    second = F.when(F.size("r") > 1, F.get("r", F.lit(1))["term"]).alias("second")
    ranked = keep(ranked.select("wid", "words", F.col("r")[0]["term"].alias("term"), second, order.alias("order")).where(F.size("order") * 8 == F.octet_length("words")))
    wanted = ranked.select("term").union(ranked.where("second is not null").select("second")).distinct()
    pivots = segments.select("segment", "terms", "counts", "positions").crossJoin(_blocks(wanted))
    places = keep(pivots.mapInArrow(partial(_lookup, with_positions=True), "segment binary, term bigint, places binary"))
    first = places.join(_small(ranked.select("wid", "term", "second"), F.lit(32)), "term").select("segment", "wid", "second", "places")
    others = places.select("segment", F.col("term").alias("second"), F.col("places").alias("others"))
    both = first.join(others, ["segment", "second"], "left").select("segment", "wid", "second", "places", "others")
    longest = different.agg(F.max(F.octet_length("words")) / 8).first()[0] or 0
    close = both.mapInArrow(partial(_near_second, width=max(int(longest), span or 0)), "segment binary, wid binary, places binary")
    shards = max(1, -(-ranked.count() // WINDOWS))
    met = close.join(_small(ranked.select("wid", "words", "order"), F.octet_length("words") * 2), "wid").withColumn("shard", F.pmod(F.xxhash64("wid"), F.lit(shards)))
    candidates = keep(met.groupBy("segment", "shard").agg(F.collect_list(F.struct("wid", "words", "order", "places")).alias("candidates")))
    full = segments.join(candidates, "segment")  # true matches grow with the corpus: no broadcast hint
    found = full.mapInArrow(partial(_match, span=span), "key binary, spans array<struct<a:int,z:int>>, exact array<binary>, close array<binary>")
    # a text that stands in several segments, or meets several shards of windows, has a row for each
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    whole = found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), every("exact"), every("close"))
    grow = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["z"] - F.greatest(x["a"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["z"]).alias("to"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to")), grow, lambda acc: acc["n"])
    out = keep(whole.select("key", n_hit.alias("n_hit"), "exact", "close"))
    drop(each, known, ranked, places, candidates)
    return out


def _count(batches):
    for b in slices(batches):
        data, offsets = buffers(b.column("text"))
        word = ~NON_ALNUM[LOWER[data]]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = word[inner]
        sums = np.concatenate([[0], np.cumsum(begins)])
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64())], names=["row", "key", "n_words"])


@tidy
def contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, span: int | None = None) -> DataFrame:
    """(row, n_words, n_hit, items, near_items) per row of df: words inside occurrences of item windows,
    the items, sorted as strings, that have one, and with ``span`` those with a proximity match."""
    segments, queries = index(df, text_col), windows(benchmark, item_col, item_text_col, n)
    found = search(segments, queries, span)
    named = queries.select("wid", F.struct(F.col("item"), F.col("none")).alias("item"))
    kinds = F.explode(F.concat(F.transform("exact", lambda w: F.struct(F.lit("items").alias("kind"), w.alias("wid"))), F.transform("close", lambda w: F.struct(F.lit("near_items").alias("kind"), w.alias("wid")))))
    pairs = found.select("key", "n_hit", kinds.alias("w")).select("key", "n_hit", "w.kind", "w.wid").join(named, "wid")
    names = lambda kind: F.transform(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("item")))), lambda x: x["item"])
    hits = keep(pairs.groupBy("key").agg(F.first("n_hit").alias("n_hit"), names("items").alias("items"), names("near_items").alias("near_items")).withColumnRenamed("key", "hit_key"))
    drop(segments, queries, found)
    text = F.col(text_col).cast("string")
    src = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), text_key(text).alias("key"), text.alias("text"))
    kind = src.schema["row"].dataType.simpleString()
    counted = src.mapInArrow(_count, f"row {kind}, key binary, n_words bigint")
    size = F.lit(64) + 24 * (F.size("items") + F.size("near_items"))
    none = F.array().cast("array<string>")
    joined = counted.join(_small(hits, size), F.col("key") == F.col("hit_key"), "left")
    return joined.select("row", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 26) -> DataFrame:
    """The contract's columns, and n_near: items of which a window's words all stand, in any order, within
    ``span`` words of its rarest one."""
    found = contamination(df.select(id_col, text_col), benchmark, text_col, span=span)
    return found.select(
        F.col(f"row.{id_col}").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near"),
    )
