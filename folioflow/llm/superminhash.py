"""MinHash near-dedup with SuperMinHash signatures, banding, verification and union-find.

A document's set is its distinct word shingles. SuperMinHash walks one random permutation of the
signature's slots per element: its step j writes a rank in [j, j+1) into one slot that the element
has not written before. Steps are taken level by level for all documents of a slice, and a document
stops once all of its slots hold ranks of finished levels, since later ranks are larger.

Scale: identical sets are one node. A bucket (equal band) compares its members with a leader only,
the member that meets most others. Verified links become components. Where a bucket still holds
several components, the components that share buckets form a group, which is cut into blocks of a bounded
number of elements, those of its most frequent component apart; each pair of blocks, but for two of that
component, is one cell, whose inverted index compares every set outside the cell's most frequent component with
all others and gives back the links that join components. So no
candidate is capped, no pair is a row unless it is compared with a leader or is a link, and no task
holds a group. All joins are equi-joins that the engine can split; counts are combined before shuffles.

Null or empty texts have no set and are linked with nothing. Rows with equal ids count as rows of
their own; a null id is never a component's name unless all rows of it have none.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import bounded_batches, drop, keep, tidy
from folioflow.llm.textkit import SPACE, buffers, kernel, mix, release, shingles, slices

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint32(0xFFFFFFFF)


def signatures(doc: np.ndarray, elements: np.ndarray, n_docs: int, m: int = 252, traced: int = 4, block: int = 100_000) -> np.ndarray:
    """SuperMinHash of each document: (n_docs, m) of level << 24 | rank. doc is sorted; m <= 255."""
    sig = np.full((n_docs, m), _EMPTY, np.uint32)
    flat = sig.reshape(-1)

    def draw(e: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(e + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        slot = np.uint64(j) + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32))
        return (np.uint32(j << 24) | (x >> np.uint64(40)).astype(np.uint32)), slot.astype(np.int64)

    swaps: list[np.ndarray] = []
    d, e = doc, elements
    for j in range(min(traced, m)):
        if not len(e):
            return sig
        rank, k = draw(e, j)
        at = k.copy()  # what stands at k now: undo the earlier swaps, last first
        for i in range(j - 1, -1, -1):
            moved = at == swaps[i]
            back = at == i
            at = np.where(moved, i, np.where(back, swaps[i], at))
        np.minimum.at(flat, d * m + at, rank)
        swaps.append(k)
        open_docs = (sig == _EMPTY).any(axis=1)
        left = open_docs[d]
        if not left.all():
            d, e, swaps = d[left], e[left], [s[left] for s in swaps]
    cuts = [0]
    while cuts[-1] < len(e):  # whole documents per block, for their early stop
        end = min(cuts[-1] + block, len(e))
        if end < len(e):
            end = max(int(np.searchsorted(d, d[end], "left")), int(np.searchsorted(d, d[cuts[-1]], "right")))
        cuts.append(end)
    for lo, hi in zip(cuts, cuts[1:]):
        bd, be = d[lo:hi], e[lo:hi]
        slots = np.tile(np.arange(m, dtype=np.uint8), (hi - lo, 1))
        rows = np.arange(hi - lo)
        for i, s in enumerate(swaps):
            k = s[lo:hi]
            a, b = slots[rows, i].copy(), slots[rows, k].copy()
            slots[rows, k], slots[rows, i] = a, b
        for j in range(len(swaps), m):
            rank, k = draw(be, j)
            rows = np.arange(len(be))
            at = slots[rows, k].astype(np.int64)
            slots[rows, k] = slots[:, j]
            np.minimum.at(flat, bd * m + at, rank)
            if j % 4 == 3:
                first, last = int(bd[0]), int(bd[-1]) + 1
                open_docs = (sig[first:last] == _EMPTY).any(axis=1)
                left = open_docs[bd - first]
                if not left.any():
                    break
                if left.mean() < 0.7:
                    bd, be, slots = bd[left], be[left], slots[left]
    return sig


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band; the band's number is part of it."""
    n = sig.shape[1] // rows
    parts = sig[:, : n * rows].reshape(len(sig), n, rows).astype(np.uint64)
    acc = np.tile(mix(np.arange(1, n + 1, dtype=np.uint64)), (len(sig), 1))
    for t in range(rows):
        acc = mix(acc * _STEP + parts[:, :, t])
    return acc


def set_keys(doc: np.ndarray, elements: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16 bytes that name a set."""
    out = np.zeros((len(counts), 2), np.uint64)
    for i, salt in enumerate((0x51ED270B7F4A7C15, 0xC2B2AE3D27D4EB4F)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(salt)), dtype=np.uint64)])
        last = np.cumsum(counts)
        out[:, i] = mix(sums[last] - sums[last - counts] + counts.astype(np.uint64))
    raw = out.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _sketch(batches, shingle: int, m: int, rows: int):
    for b in slices(batches):
        d, e = shingles(kernel(b.column("text"), SPACE, True), shingle)
        n = b.num_rows
        counts = np.bincount(d, minlength=n)
        hashes = bands(signatures(d, e, n, m), rows).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("id"),
                pa.array(counts, pa.int64()),
                pa.array(set_keys(d, e, counts), pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, hashes.shape[1]), pa.int32()), pa.array(hashes.reshape(-1))),
            ],
            names=["id", "n", "key", "bands"],
        )


def _keyed(batches, shingle: int):
    """The texts with the keys of their sets; empty sets are left out."""
    for b in slices(batches):
        d, e = shingles(kernel(b.column("text"), SPACE, True), shingle)
        counts = np.bincount(d, minlength=b.num_rows)
        out = pa.RecordBatch.from_arrays([pa.array(set_keys(d, e, counts), pa.binary()), b.column("text")], names=["key", "text"])
        yield out.filter(pa.array(counts > 0))


def _sets(batches, shingle: int):
    for b in slices(batches):
        d, e = shingles(kernel(b.column("text"), SPACE, True), shingle)
        ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=b.num_rows))])
        raw = e.tobytes()
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([raw[8 * i : 8 * j] for i, j in zip(ends, ends[1:])], pa.binary())], names=["key", "elements"])


def _confirm(batches, percent: int):
    """Pairs whose full sets have percent * union <= 100 * intersection."""
    for b in batches:
        left, right = b.column("ea"), b.column("eb")
        linked = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            linked[i] = 100 * common >= percent * (len(x) + len(y) - common)
        yield b.select(["a", "b"]).filter(pa.array(linked))


def _cell_links(keys: list[bytes], labels: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join different components among these sets, a spanning set of them: every set outside
    the most frequent component meets all others through an inverted index over the elements."""
    number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    comp = np.array([number[x] for x in labels])
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    postings, ends = row[order], np.cumsum(np.bincount(code))
    starts, cut = ends - np.bincount(code), np.cumsum(sizes) - sizes
    out, biggest = [], np.bincount(comp).argmax()
    for x in np.flatnonzero(comp != biggest):
        mine = code[cut[x] : cut[x] + sizes[x]]
        common = np.bincount(np.concatenate([postings[starts[c] : ends[c]] for c in mine]), minlength=len(sets))
        for y in np.flatnonzero(100 * common >= percent * (sizes[x] + sizes - common)):
            if comp[y] != comp[x]:
                out.append((keys[x], keys[y]))
                comp[comp == comp[y]] = comp[x]
    return out


def _cells(batches, percent: int):
    """Rows sorted by cell; each cell holds two blocks of a group, of a bounded number of elements."""
    cell, keys, labels, sets = None, [], [], []

    def solve():
        found = _cell_links(keys, labels, sets, percent) if len(set(labels)) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    for b in batches:
        for *at, key, label, raw in zip(*(b.column(k).to_pylist() for k in ("g", "side", "lo", "hi", "key", "label", "elements"))):
            if at != cell:
                if keys:
                    yield solve()
                cell, keys, labels, sets = at, [], [], []
            keys.append(key)
            labels.append(label)
            sets.append(np.frombuffer(raw, np.uint64))
    if keys:
        yield solve()
    release()


def _neighbours(rows: DataFrame) -> DataFrame:
    """The different rows (x, y) with x's least y and the y before: one shuffle, sorted and read as a stream."""
    by = Window.partitionBy("x").orderBy("y")
    return rows.select("x", "y", F.first("y").over(by).alias("low"), F.lag("y").over(by).alias("before")).where("before is null or before <> y")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours with the least of its neighbours and itself. A row (x, x) names
    a vertex without smaller neighbours; moved is set somewhere unless the edges are stars already."""
    way = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    row = lambda a, b, moved: f"struct({a} as a, {b} as b, {moved} as moved)"
    met = _neighbours(edges.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*"))
    given = f"""case when y > x and before is null then array({row("y", "x", "false")}, {row("x", "x", "false")})
        when y > x then array({row("y", "least(x, low)", "low < x")})
        when before = low then array({row("x", "x", "true")}) end"""
    return met.select(F.explode(F.expr(given)).alias("e")).select("e.*")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself with the least of them; in edges a > b."""
    met = _neighbours(edges.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")))
    return met.select(F.when(F.col("before").isNull(), F.col("x")).otherwise(F.col("y")).alias("a"), F.col("low").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of every vertex of edges (a, b), a <> b, once; label is the least key of the component. Large and
    small stars in turn until all components are stars, two turns a table; there are never more edges than at first,
    and turns grow with the log of a component's width."""
    stars = _large_star(edges)
    while True:
        found = keep(_large_star(_small_star(_large_star(_small_star(stars)))))
        drop(stars)
        stars = found
        if not found.where("moved").limit(1).count():
            labels = found.select(F.col("a").alias("key"), F.col("b").alias("label"))
            labels.kept_at = found.kept_at
            return labels


@tidy
def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    slots: int = 252,
    band_rows: int = 6,
    block_rows: int = 2_000,
    block_elements: int = 500_000,
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id that links reach), kept (it is that id).

    Links join sets with 100 * intersection >= percent * union, confirmed on the full sets.
    With 252 slots in 42 bands of 6, a pair at a similarity of 0.8 shares no band once in 350,000."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sketch = keep(docs.mapInArrow(partial(_sketch, shingle=shingle, m=slots, rows=band_rows), f"id {kind}, n bigint, key binary, bands array<bigint>"))
    nodes = sketch.where("n > 0").dropDuplicates(["key"]).select("key", "n", F.explode("bands").alias("h"))
    crowded = nodes.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    members = keep(nodes.join(crowded, "h"))
    mass = members.groupBy("key").agg(F.sum("c").alias("mass"))
    now = keep(members.join(mass, "key").select("h", "key", "n", "mass"))
    drop(members)
    wanted = now.select("key").distinct()
    texts = docs.mapInArrow(partial(_keyed, shingle=shingle), "key binary, text string")
    sets = keep(texts.join(wanted.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).mapInArrow(partial(_sets, shingle=shingle), "key binary, elements binary"))

    def confirm(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("key").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("key").alias("b"), F.col("elements").alias("eb")), "b")
        return keep(full.select("a", "b", "ea", "eb").mapInArrow(partial(_confirm, percent=percent), "a binary, b binary"))

    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    leaders = now.groupBy("h").agg(F.max(F.struct("mass", "key", "n")).alias("top"))
    pairs = now.join(leaders, "h").where("key <> top.key").select(F.col("key").alias("a"), F.col("top.key").alias("b"), F.col("n").alias("na"), F.col("top.n").alias("nb"))
    links = confirm(pairs.where(fits).select("a", "b").distinct())
    labels = components(links)
    tables = [now, links, labels]
    cast = now.join(labels.select("key", "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = cast.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h", "lo")
    left = keep(cast.join(mixed, "h").select("key", "label", "lo", "n").distinct())
    tables.append(left)
    if left.limit(1).count():
        # groups of components that share mixed buckets: far fewer edges than members
        groups = components(left.where("label <> lo").select(F.col("label").alias("a"), F.col("lo").alias("b")).distinct())
        member = left.select("key", "label", "n").distinct().join(groups.select(F.col("key").alias("label"), F.col("label").alias("g")), "label")
        # the group's most frequent component needs no comparing with itself: its blocks meet the others' alone
        main = member.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
        member = member.join(main, "g").withColumn("rest", F.col("label") != F.col("main"))
        blocks = lambda side: F.greatest(F.ceil(F.count(F.when(side, 1)) / block_rows), F.ceil(F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)) / block_elements))
        size = member.groupBy("g").agg(blocks(~F.col("rest")).alias("mains"), blocks(F.col("rest")).alias("rests"))
        placed = member.join(size, "g").withColumn("i", F.pmod(F.xxhash64("key"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))))
        cell = lambda kind, lo, hi: F.struct(F.lit(kind).alias("side"), lo.alias("lo"), hi.alias("hi"))
        each = lambda n, made: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1), made)
        with_main, among = each("mains", lambda j: cell(0, j, F.col("i"))), each("rests", lambda j: cell(1, F.least("i", j), F.greatest("i", j)))
        own = F.when(F.col("rest"), F.concat(with_main, among)).otherwise(each("rests", lambda j: cell(0, F.col("i"), j)))
        cells = placed.select("key", "label", "g", F.explode(own).alias("x")).select("key", "label", "g", "x.*")
        filled = cells.join(sets, "key").repartition("g", "side", "lo", "hi").sortWithinPartitions("g", "side", "lo", "hi", "key")
        more = keep(filled.select("g", "side", "lo", "hi", "key", "label", "elements").mapInArrow(partial(_cells, percent=percent), "a binary, b binary"))
        tables += [groups, more]
        if more.limit(1).count():
            tables.append(labels)
            labels = components(labels.where("key <> label").select(F.col("key").alias("a"), F.col("label").alias("b")).union(more))
    named = sketch.where("n > 0").groupBy("key").agg(F.min("id").alias("least")).join(labels.select("key", "label"), "key")
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = keep(named.join(heads, "label").select("key", "component_id"))
    drop(*tables, labels, sets)
    alone = sketch.where("n > 0").groupBy("key").agg(F.min("id").alias("least"))
    heads = alone.join(known, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"))
    out = sketch.select("id", "n", "key").join(heads.where("component_id is not null"), "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.col("component_id").isNull()).alias("kept"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df of which no near-duplicate has a smaller (id, text's hash); of equal rows one.
    Rows without words have no near-duplicates and all stay. df's other columns may have any names."""
    th = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = df.select(F.struct(F.col(id_col).alias("id"), th.alias("th")).alias("id"), F.col(text_col).alias("text"))
    found = near_duplicates(keyed, "id", "text", **options)
    first = found.where("kept and n_shingles > 0").select("id").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    worded = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    mine = df.select(row.alias("row"), F.struct(F.col(id_col).alias("id"), th.alias("th")).alias("id"), worded.alias("worded"))
    same = mine["id"]["id"].eqNullSafe(first["id"]["id"]) & (mine["id"]["th"] == first["id"]["th"])
    kept = mine.where("worded").join(first, same, "left_semi").dropDuplicates(["id"])
    return kept.unionByName(mine.where("not worded")).select("row.*")
