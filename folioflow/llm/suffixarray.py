"""Suffix-array dedup: remove every byte covered by a long string that starts anywhere else.

How the corpus becomes shards: every ``length``-byte window of every text is assigned to one anchor,
the leftmost least hash among the ``gram``-byte strings inside it, so equal windows have equal anchors.
The windows of one anchor occurrence are consecutive; the bytes under them are its context, which can go on for
longer strings that start at the same places. Only
contexts whose anchor occurs at least twice can repeat; equal contexts are one row with a count.
Contexts of one anchor hash share a shard, where a suffix array is built by induced sorting and
permuted common prefixes (PLCP) tell which windows occur elsewhere.

Induced sorting: suffixes are classified as S or L from the right, the leftmost S of every run (LMS)
seeds the order, L then S suffixes are induced bucket by bucket, equal LMS substrings get equal names
and the string of names, at most half as long, is sorted by doubling the names compared. The buckets are
filled with numpy, one wave for each run of the bucket's own byte.

Scale: all texts equal to another are settled by one hash aggregate. An anchor with very many different
contexts (a passage that a share of all texts holds) or with more than ``crowd_bytes`` under them (periodic
texts) is split: its windows are counted by their own 128-bit hashes instead, which spread over all tasks
and are combined before the shuffle. So a shard holds ``shard_bytes`` and one anchor's contexts at most.
Null texts are empty. Rows with equal ids are different rows. Matches never cross texts.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import bounded_batches, drop, keep, tidy
from folioflow.llm.textkit import buffers, mix, prefix_hash, release, slices, span_hash

# --- induced sorting -------------------------------------------------------------------------


def _sort_names(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names, an ending least: ranks by ever twice as many names, of the suffixes that
    are not told apart yet alone."""
    n = len(s)
    live = np.argsort(s, kind="stable")
    group, value = np.zeros(n, np.int64), s[live]
    rank, width = np.zeros(n + 1, np.int64), 0
    while len(live):
        at = np.arange(len(live))
        new = np.concatenate([[True], value[1:] != value[:-1]])
        whole = np.concatenate([[True], group[1:] != group[:-1]])
        # a place is its group's, and how many of the group are less
        rank[live] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(whole, at, 0))
        several = ~(new & np.concatenate([new[1:], [True]]))
        live, width = live[several], max(1, 2 * width)
        rank[n] = -1
        group = rank[live]
        value = group * (n + 1) + rank[np.minimum(live + width, n)] + 1
        order = np.argsort(value, kind="stable")
        live, group, value = live[order], group[order], value[order]
    sa = np.empty(n, np.int64)
    sa[rank[:n]] = np.arange(n)
    return sa


def _induce_bytes(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Bucket by bucket: what a bucket's suffixes induce is grouped by first byte, in order, at once."""
    n = len(s)
    sizes = np.bincount(s, minlength=sigma)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    seeds: list[np.ndarray] = [np.zeros(0, np.int64)] * sigma
    by = s[lms]
    order = np.argsort(by, kind="stable")
    cut = np.searchsorted(by[order], np.arange(sigma + 1))
    for c in np.flatnonzero(np.diff(cut)):
        seeds[c] = lms[order[cut[c] : cut[c + 1]]]
    low: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    low[s[n - 1]].append(np.array([n - 1], np.int64))

    def give(found: np.ndarray, to: list[list[np.ndarray]]) -> None:
        first = s[found]
        if not len(first):
            return
        order = np.argsort(first, kind="stable")
        first, found = first[order], found[order]
        edges = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(found, edges):
            to[s[part[0]]].append(part)

    larger: list[np.ndarray] = [np.zeros(0, np.int64)] * sigma
    for c in range(sigma):
        if not sizes[c]:
            continue
        done = 0
        while done < len(low[c]):
            wave = low[c][done] if done + 1 == len(low[c]) else np.concatenate(low[c][done:])
            low[c][done:] = [wave]
            done += 1
            j = wave - 1
            j = j[j >= 0]
            give(j[~is_s[j]], low)
        larger[c] = np.concatenate(low[c]) if low[c] else np.zeros(0, np.int64)
        j = seeds[c] - 1
        give(j[(j >= 0)][~is_s[j[j >= 0]]], low)
    high: list[list[np.ndarray]] = [[] for _ in range(sigma)]  # each from the largest down
    sa = np.empty(n, np.int64)
    for c in range(sigma - 1, -1, -1):
        if not sizes[c]:
            continue
        done = 0
        while done < len(high[c]):
            wave = high[c][done] if done + 1 == len(high[c]) else np.concatenate(high[c][done:])
            high[c][done:] = [wave]
            done += 1
            j = wave - 1
            j = j[j >= 0]
            give(j[is_s[j]], high)
        smaller = np.concatenate(high[c])[::-1] if high[c] else np.zeros(0, np.int64)
        sa[heads[c] : heads[c] + len(larger[c])] = larger[c]
        sa[tails[c] - len(smaller) : tails[c]] = smaller
        j = larger[c][::-1] - 1
        j = j[j >= 0]
        give(j[is_s[j]], high)
    return sa


def suffix_array(s: np.ndarray, sigma: int = 257) -> np.ndarray:
    """Suffix array of small integers below sigma by induced sorting; an ending is least."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.uint16)  # numpy sorts these by radix
    # S where the next different value is larger; the last run is L
    change = np.flatnonzero(s[1:] != s[:-1])
    rises = s[change] < s[change + 1]
    is_s = np.zeros(n, bool)
    if len(change):
        is_s[: change[-1] + 1] = np.repeat(rises, np.diff(np.concatenate([[-1], change])))
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(lms):
        return _induce_bytes(s, is_s, lms, sigma)
    first = _induce_bytes(s, is_s, lms, sigma)
    mark = np.zeros(n, bool)
    mark[lms] = True
    ordered = first[mark[first]]
    stop = np.full(n, n, np.int64)
    stop[lms[:-1]] = lms[1:]
    a, b = ordered[:-1], ordered[1:]
    la, lb = stop[a] - a, stop[b] - b
    differs = (la != lb) | (stop[a] == n) | (stop[b] == n)
    same = np.flatnonzero(~differs)
    step = 0
    while len(same):
        unequal = s[a[same] + step] != s[b[same] + step]
        differs[same[unequal]] = True
        step += 1
        same = same[~unequal & (la[same] >= step)]
    names = np.zeros(n, np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(differs)])
    reduced = names[lms]
    count = int(reduced.max()) + 1
    order = np.argsort(reduced) if count == len(lms) else _sort_names(reduced)
    return _induce_bytes(s, is_s, lms[order], sigma)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """PLCP: per position, the common prefix with the suffix before it in the suffix array.

    Only irreducible values (where the values before the two suffixes differ) are compared, together
    O(n log n) steps; all others are the value of the position before less one."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (before > 0)
    reducible[reducible] = s[at[reducible] - 1] == s[before[reducible] - 1]
    open_ = np.flatnonzero(~reducible)
    base = np.zeros(n, np.int64)
    live = open_[before[open_] >= 0]
    padded = np.concatenate([s, np.full(64, -1, s.dtype)])
    other = np.concatenate([s, np.full(64, -2, s.dtype)])
    width, length = 4, 0
    while len(live):
        span = np.arange(width)
        same = padded[live[:, None] + length + span] == other[before[live][:, None] + length + span]
        full = same.all(axis=1)
        base[live] += np.where(full, width, same.argmin(axis=1))
        live, length = live[full], length + width
        width = min(64, 2 * width) if length >= width else width
    irreducible = np.zeros(n, np.int64)
    irreducible[open_] = open_
    last = np.maximum.accumulate(irreducible)
    return base[last] - (at - last)


def repeated_starts(pieces: list[bytes], own: list[int], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """Per length and piece, which of the piece's first ``own`` positions start a string of that length that
    starts at another piece's own position too, or at another of the same piece. What follows a piece's own
    positions only shows how far their strings go."""
    sizes = np.array([len(p) for p in pieces])
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    joined[ends] = 0
    begins = ends - sizes
    mine = np.zeros(len(joined) + 1, np.int32)
    np.add.at(mine, begins, 1)
    np.add.at(mine, begins + np.minimum(own, sizes), -1)
    mine = np.cumsum(mine[:-1]) > 0
    sa = suffix_array(joined)
    prefix = common_prefixes(joined, sa)[sa]
    rank = np.flatnonzero(mine[sa])
    # between neighbours in order among the own positions, the least prefix of the steps between them
    shared = np.minimum.reduceat(prefix[: rank[-1] + 1], rank[:-1] + 1) if len(rank) > 1 else np.zeros(0, np.int64)
    place = sa[rank]
    out = []
    for length in lengths:
        hit = np.zeros(len(joined), bool)
        long = shared >= length
        hit[place[1:][long]] = True
        hit[place[:-1][long]] = True
        out.append([np.flatnonzero(hit[x : x + max(0, min(n, size - length + 1))]) for x, n, size in zip(begins.tolist(), own, sizes.tolist())])
    return out


# --- windows, anchors, contexts --------------------------------------------------------------


def _least_in_windows(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from block-wise running minima."""
    n = len(h)
    if n < w:
        return np.zeros(0, h.dtype)
    blocks = -(-n // w)
    grid = np.full(blocks * w, np.iinfo(h.dtype).max, h.dtype)
    grid[:n] = h
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _anchors(batches, length: int, gram: int, reach: int):
    """Per text: the anchors of its windows: hash, first start, number of starts, hash and size of the context,
    which goes on for strings of ``reach`` bytes as far as the text does."""
    for b in slices(batches):
        data, offsets = buffers(b.column("text"))
        prefix = prefix_hash(data)
        n = len(data)
        starts = np.zeros(0, np.int64)
        if n >= length:
            at, w = np.arange(n - gram + 1), length - gram + 1
            grams = span_hash(prefix, at, at + gram)
            least = _least_in_windows(grams, w)
            room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - np.arange(len(least)) >= length
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | ~room[:-1]
            inner = offsets[offsets < len(least)]
            new[inner] = True
            starts = np.flatnonzero(room & new)
            run = np.cumsum(room & new)[room] - 1
            many = np.bincount(run, minlength=len(starts))
            hashes = least[starts]
            size = np.minimum(starts + many + reach - 1, offsets[np.searchsorted(offsets, starts, "right")]) - starts
            context = mix(span_hash(prefix, starts, starts + size) + many.astype(np.uint64))
            pad = np.zeros(w - 1, np.uint64)
            spot = np.flatnonzero(grams == ~_least_in_windows(~np.concatenate([pad, least, pad]), w))
            # each run's first anchor place, and whether another of the same hash stands near it
            value, place = np.concatenate([grams[spot], hashes]), np.concatenate([spot, starts])
            is_run = np.arange(len(value)) >= len(spot)
            order = np.lexsort((~is_run, place, value))
            v, q = value[order], np.where(is_run[order], n, place[order])
            nearest = np.minimum.accumulate(np.where(is_run[order], len(order), np.arange(len(order)))[::-1])[::-1]
            own = nearest[is_run[order]]
            first = np.empty(len(starts), np.int64)
            first[order[is_run[order]] - len(spot)] = own
            spots = np.flatnonzero(~is_run[order])
            rank = np.searchsorted(spots, first)
            after = spots[np.minimum(rank + 1, len(spots) - 1)]
            again = (rank + 1 < len(spots)) & (v[after] == hashes) & (q[after] < starts + many + length - gram)
            off = np.where(again, -1, q[first] - starts)
        else:
            many = size = np.zeros(0, np.int64)
            hashes = context = np.zeros(0, np.uint64)
            again, off = np.zeros(0, bool), np.zeros(0, np.int64)
        cut = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(b.num_rows), np.diff(cut))
        struct = pa.StructArray.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(context.view(np.int64)), pa.array(starts - offsets[doc], pa.int64()), pa.array(many, pa.int64()), pa.array(again), pa.array(off, pa.int64()), pa.array(size, pa.int64())],
            names=["g", "c", "at", "m", "again", "off", "z"],
        )
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), struct)], names=["key", "anchors"])


_KEPT = ("g", "c", "copies", "k", "off", "m")


def _contexts(batches):
    """Texts with the anchors wanted of them: a row per context, with its bytes."""
    for b in slices(batches):
        texts, wanted = b.column("text"), b.column("wanted").to_pylist()
        rows: dict[str, list] = {k: [] for k in (*_KEPT, "bytes")}
        for i, anchors in enumerate(wanted):
            raw = texts[i].as_buffer()
            for x in anchors:
                for k in _KEPT:
                    rows[k].append(x[k])
                rows["bytes"].append(raw[x["at"] : x["at"] + x["z"]].to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows[k], pa.int64()) for k in _KEPT] + [pa.array(rows["bytes"], pa.binary())], names=list(rows))


def _covered(starts: np.ndarray, length: int) -> list[int]:
    """from, to, from, to ... of the bytes under these windows."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + length], 1).ravel().tolist()


def _narrow(rows: list[tuple], length: int, gram: int, parts: int = 4) -> list[tuple[int, int]]:
    """Per context, the starts (from, to) that may repeat. A window stands x bytes before its anchor;
    all windows of one part of the x share a core, so a part whose core no other context of the
    anchor has can't repeat. Where a context has several places of its anchor (off < 0), all stay whole."""
    sizes = np.array([len(r[4]) for r in rows])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    prefix = prefix_hash(data)
    off = np.array([r[3] for r in rows])
    g = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    off[np.isin(g, g[off < 0])] = -1
    m = np.array([r[5] for r in rows])
    w = length - gram + 1
    low, high = np.where(off < 0, 0, m), np.where(off < 0, m, 0)
    edges = [w * i // parts for i in range(parts + 1)]
    for lo, hi in zip(edges, [e - 1 for e in edges[1:]]):
        fit = np.flatnonzero((off >= lo) & (hi >= off - m + 1))
        if not len(fit):
            continue
        a = base[fit] + off[fit] - lo
        key = span_hash(prefix, a, a + lo - hi + length) ^ g[fit]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = fit[(count[which] > 1)]
        low[hit] = np.minimum(low[hit], np.maximum(0, off[hit] - hi))
        high[hit] = np.maximum(high[hit], np.minimum(m[hit], off[hit] - lo + 1))
    return list(zip(low.tolist(), high.tolist()))


_SPANS = "g bigint, c bigint, spans array<bigint>, far array<bigint>"


def _span_batch(g: list, c: list, spans: list, far: list) -> pa.RecordBatch:
    lists = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(spans, lists), pa.array(far, lists)], names=["g", "c", "spans", "far"])


def _shards(batches, length: int, gram: int, reach: int, shard_bytes: int):
    """Rows arrive sorted by anchor; whole anchors are gathered to shards of about shard_bytes."""
    rows: list[tuple] = []
    held = 0

    def solve():
        spans: list[list[int]] = [[0, r[5] + length - 1] if r[2] > 1 else [] for r in rows]
        far: list[list[int]] = [[0, len(r[4])] if r[2] > 1 and len(r[4]) >= reach else [] for r in rows]
        cut = [(i, lo, hi) for i, (lo, hi) in enumerate(_narrow(rows, length, gram)) if hi > lo]
        if cut:
            both = repeated_starts([rows[i][4][lo : hi + reach - 1] for i, lo, hi in cut], [hi - lo for _, lo, hi in cut], (length, reach))
            for (i, lo, _), x, y in zip(cut, *both):
                spans[i] = spans[i] or _covered(x + lo, length)
                far[i] = far[i] or _covered(y + lo, reach)
        hit = [i for i, x in enumerate(spans) if x]
        return _span_batch([rows[i][0] for i in hit], [rows[i][1] for i in hit], [spans[i] for i in hit], [far[i] for i in hit])

    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in ("g", "c", "copies", "off", "bytes", "m"))):
            if held >= shard_bytes and r[0] != rows[-1][0]:
                yield solve()
                rows, held = [], 0
            rows.append(r)
            held += len(r[4])
    if rows:
        yield solve()
    rows = []
    release()


def _window_rows(batches, length: int, reach: int):
    """Every window of the contexts of a crowded anchor, of either length, by a hash of 128 bits."""
    for b in batches:
        for g, c, copies, m, raw in zip(*(b.column(k).to_pylist() for k in ("g", "c", "copies", "m", "bytes"))):
            data = np.frombuffer(raw, np.uint8)
            one, two = prefix_hash(data), prefix_hash(data ^ np.uint8(0xA5))
            for size in dict.fromkeys((length, reach)):
                at = np.arange(min(m, len(data) - size + 1))
                if not len(at):
                    continue
                w1, w2, n = span_hash(one, at, at + size), span_hash(two, at, at + size), len(at)
                fixed = [pa.array(np.full(n, x, np.int64)) for x in (g, c, copies, size)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(at), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names=["g", "c", "copies", "size", "at", "w1", "w2"])


def _window_spans(batches, length: int, reach: int):
    for b in batches:
        near, far = ([_covered(np.unique(np.array(x or [], np.int64)), size) for x in b.column(k).to_pylist()] for k, size in (("near", length), ("far", reach)))
        yield _span_batch(b.column("g").to_pylist(), b.column("c").to_pylist(), near, far)


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


#: first bytes of the UTF-8 letters that no white space parts: Han and kana
_UNSPACED = bytes([*range(0xE4, 0xEA)])


def _n_words(raw: bytes, a: int, z: int) -> int:
    """Words wholly inside raw[a:z]; Han and kana characters are a word each."""
    part = raw[a:z]
    words = part.split()
    if not words:
        return 0
    cut = a > 0 and not raw[a - 1 : a].isspace() and not part[:1].isspace()
    cut_end = z < len(raw) and not raw[z : z + 1].isspace() and not part[-1:].isspace()
    return len(words) - cut - (cut_end and len(words) > cut) + len(part) - len(part.translate(None, _UNSPACED))


def _cut(batches, length: int, reach: int, min_words: int, passage_words: int):
    for b in batches:
        texts, found, copies = b.column("text"), b.column("found").to_pylist(), b.column("copies").to_pylist()
        cols: list[list] = [[], [], [], [], [], []]
        for i in range(b.num_rows):
            raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""

            def covered(kind: str, size: int, words: int) -> list[list[int]]:
                if (copies[i] or 0) > 1 and len(raw) >= size:
                    spans = [[0, len(raw)]]
                else:
                    spans = _merge([(x["at"] + a, x["at"] + z) for x in found[i] or () for a, z in zip(x[kind][::2], x[kind][1::2])])
                return [x for x in spans if _n_words(raw, *x) >= words] if words else spans

            spans = covered("far", reach, min_words)
            passages = covered("spans", length, passage_words) if length < reach else []
            at, left = 0, []
            for a, z in spans:
                left.append(raw[at:a])
                at = z
            left.append(raw[at:])
            text = "".join([x.decode("utf-8", "ignore") for x in left]) if texts[i].is_valid else None
            for col, v in zip(cols, (len(raw), sum(z - a for a, z in spans), [y for x in spans for y in x], b"".join(left), text, [y for x in passages for y in x])):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string(), pa.list_(pa.int64()))))],
            names=["row", "n_bytes", "n_removed", "spans", "kept_bytes", "kept_text", "passages"],
        )


@tidy
def repeated_spans(texts: DataFrame, length: int = 400, gram: int = 128, reach: int | None = None, shard_bytes: int = 300_000, crowd: int = 2_000, crowd_bytes: int = 1_000_000) -> DataFrame:
    """(key, copies, found) for texts (key, text): found lists (at, spans, far) of covered bytes per context,
    spans under strings of ``length`` bytes, far under those of ``reach`` bytes (``length`` by default).

    Texts that are there more than once have their copies counted and no spans: all of them repeats."""
    bounded_batches(texts.sparkSession)
    reach = reach or length
    sizes = {"length": length, "reach": reach}
    per_text = texts.where(F.octet_length("text") >= length).mapInArrow(partial(_anchors, gram=gram, **sizes), "key binary, anchors array<struct<g:bigint,c:bigint,at:bigint,m:bigint,again:boolean,off:bigint,z:bigint>>")
    distinct = keep(per_text.groupBy("key").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors")))
    each = distinct.select("key", "copies", F.explode("anchors").alias("x")).select("key", "copies", "x.*")
    crowded = each.groupBy("g").agg(F.sum("copies").alias("n"), F.bool_or("again").alias("again")).where("n > 1 or again").select("g")
    shared = keep(each.join(crowded, "g"))
    contexts = keep(shared.groupBy("g", "c").agg(F.sum("copies").alias("copies"), F.bool_or("again").alias("again"), F.min(F.struct("key", "at", "m", "off", "z")).alias("src")))
    kinds = contexts.groupBy("g").agg(F.count("*").alias("k"), F.sum("src.z").alias("held"))
    known = contexts.join(kinds, "g")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    whole = F.when(F.col("src.z") >= reach, F.array(zero, F.col("src.z"))).otherwise(none)
    alone = known.where("k = 1 and copies > 1").select("g", "c", F.array(zero, F.col("src.m") + (length - 1)).alias("spans"), whole.alias("far"))
    crowd_of = F.when(F.col("held") > crowd_bytes, F.lit(1 << 40)).otherwise(F.col("k")).alias("k")
    of_src = [F.col(f"src.{c}").alias(c) for c in ("at", "m", "off", "z")]
    wanted = known.where("k > 1 or (copies = 1 and again)").groupBy(F.col("src.key").alias("key")).agg(F.collect_list(F.struct("g", "c", "copies", crowd_of, *of_src)).alias("wanted"))
    pieces = keep(texts.join(wanted.hint("merge"), "key").dropDuplicates(["key"]).select("text", "wanted").mapInArrow(_contexts, "g bigint, c bigint, copies bigint, k bigint, off bigint, m bigint, bytes binary"))
    few = pieces.where(F.col("k") <= crowd).repartition("g").sortWithinPartitions("g")
    solved = few.mapInArrow(partial(_shards, gram=gram, shard_bytes=shard_bytes, **sizes), _SPANS)
    windows = pieces.where(F.col("k") > crowd).mapInArrow(partial(_window_rows, **sizes), "g bigint, c bigint, copies bigint, size bigint, at bigint, w1 bigint, w2 bigint")
    often = windows.groupBy("size", "w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("size", "w1", "w2")
    at = lambda size: F.collect_list(F.when(F.col("size") == size, F.col("at")))
    counted = windows.join(often, ["size", "w1", "w2"]).groupBy("g", "c").agg(at(length).alias("near"), at(reach).alias("far")).mapInArrow(partial(_window_spans, **sizes), _SPANS)
    results = keep(alone.unionByName(solved).unionByName(counted))
    spans = shared.where("copies = 1").join(results, ["g", "c"]).groupBy("key").agg(F.collect_list(F.struct("at", "spans", "far")).alias("found"))
    several = distinct.where("copies > 1").select("key", "copies", F.lit(None).cast("array<struct<at:bigint,spans:array<bigint>,far:array<bigint>>>").alias("found"))
    out = keep(spans.select("key", F.lit(1).cast("bigint").alias("copies"), "found").unionByName(several))
    drop(distinct, shared, contexts, pieces, results)
    return out


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = 400, min_words: int = 0, passages: int | None = None, passage_words: int = 50, **options) -> DataFrame:
    """df with n_bytes, n_removed, spans (from, to pairs), kept_bytes, kept_text (without characters
    that lost a byte; null for a null text) and passages beside a struct ``row`` of its own columns, the text left
    out. Every byte under a ``length``-byte string that also starts elsewhere goes; with ``min_words``, only whole
    runs of such bytes that hold as many words.

    With ``passages``, a shorter length, the same pass also finds the runs under strings of that many bytes that
    hold ``passage_words`` words (from, to pairs); nothing of them goes for that."""
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    keyed = keyed.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    short = min(passages or length, length)
    found = repeated_spans(keyed.select("key", "text"), short, reach=length, **options)
    slim = keyed.withColumn("row", F.col("row").dropFields(text_col)) if len(df.columns) > 1 else keyed
    joined = slim.join(found, "key", "left").select("row", "text", "copies", "found")
    kind = joined.schema["row"].dataType.simpleString()
    cut = partial(_cut, length=short, reach=length, min_words=min_words, passage_words=passage_words)
    return joined.mapInArrow(cut, f"row {kind}, n_bytes bigint, n_removed bigint, spans array<bigint>, kept_bytes binary, kept_text string, passages array<bigint>")
