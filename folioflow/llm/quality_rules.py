"""Quality rules with risk-controlled thresholds.

Every rule is a number per text that grows with badness (``METRICS``) and a fixed grid of cutoffs. On
the labelled texts of a stratum (its language), the false rejections of a cutoff are binomial; a cutoff
may be used if the exact (Clopper-Pearson) upper bound of its false rejection rate is at most ``alpha``
divided by the number of rules, at a confidence of 1 - ``delta`` shared out by Bonferroni over all
rules, cutoffs and strata. Of those the one that rejects most labelled bad texts is taken, the loosest
among equals, and none if it rejects no bad text. So all rules together reject at most ``alpha`` of a
stratum's good texts, with a confidence of 1 - ``delta``. Strata without enough labels have no cutoffs.

What is gathered is one count per stratum, rule and grid bucket; no text leaves its partition.
Null texts have no words; a null language is the stratum ''.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import bounded_batches, keep, tidy
from folioflow.llm.textkit import SPACE, Words, buffers, mix, ngrams, slices, span_hash

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: rule name to its grid of cutoffs; a text with a value above the cutoff fails
GRIDS = {
    "symbol_share": [0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_share": [0.02, 0.05, 0.1, 0.15],
    "upper_share": [0.1, 0.2, 0.3, 0.5, 0.8],
    "bang_share": [0.02, 0.05, 0.1, 0.2, 0.4],
    "long_word": [9.0, 10.0, 12.0, 15.0, 20.0],
    "short_word": [-4.0, -3.5, -3.0, -2.5, -2.0],
}


def _repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (doc, key) is there twice or more, and whether an equal one stands before it."""
    k = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts and the rules' raw counts of each text."""
    data, offsets = buffers(texts)
    n = len(texts)
    w = Words(data, offsets, SPACE, False)
    doc = w.doc

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    points = (data & 0xC0) != 0x80
    out = {"n_words": w.counts, "word_chars": per_text(points & ~SPACE[data]), "n_symbols": per_text(SYMBOLS[data])}
    # lines
    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    starts = starts[starts < len(data)]
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
    _, later = _repeats(line_doc, span_hash(w.prefix, starts, ends))
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    # 5-word windows
    grams = ngrams(w.hash, 5)
    at = np.flatnonzero(doc[: len(grams)] == doc[4 : 4 + len(grams)])
    twice, _ = _repeats(doc[at], grams[at])
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    out["n_upper"] = per_text((data >= 65) & (data <= 90))
    out["n_bang"] = per_text(data == 33)
    return {k: v.astype(np.int64) for k, v in out.items()}


def metrics(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    chars, words, lines = (np.maximum(1, m[k]) for k in ("word_chars", "n_words", "n_lines"))
    return {
        "symbol_share": m["n_symbols"] / chars,
        "dup_line_share": m["n_dup_lines"] / lines,
        "repeat_share": m["n_repeat_words"] / words,
        "upper_share": m["n_upper"] / chars,
        "bang_share": m["n_bang"] / words,
        "long_word": m["word_chars"] / words,
        "short_word": -m["word_chars"] / words,
    }


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws at p, as a regularised incomplete beta function (continued fraction, whose
    steps grow with the root of n)."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p  # I_{1-p}(n - k, k + 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact binomial (Clopper-Pearson) upper bound of a rate: the p with P(X <= k; n, p) = delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if binomial_tail(k, n, mid) > delta:
            low = mid
        else:
            high = mid
    return high


def choose(good: dict[str, np.ndarray], bad: dict[str, np.ndarray], alpha: float, delta: float) -> dict[str, float]:
    """Cutoffs of a stratum from counts per grid bucket (bucket j: values above j cutoffs)."""
    out = {}
    for rule, grid in GRIDS.items():
        total, best = int(good[rule].sum()), (0, -1)
        above = np.cumsum(good[rule][::-1])[::-1][1:]
        caught = np.cumsum(bad[rule][::-1])[::-1][1:]
        for j in range(len(grid)):
            # cutoffs loosen with j; the bound grows with k, so a rate over alpha can't pass
            if total and above[j] <= alpha * total and caught[j] and caught[j] >= best[0] and upper_bound(int(above[j]), total, delta) <= alpha:
                best = (int(caught[j]), j)
        if best[1] >= 0:
            out[rule] = grid[best[1]]
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches):
    for b in slices(batches):
        m = measures(b.column("text"))
        values = np.stack(list(metrics(m).values()), axis=1)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("stratum"), *(pa.array(m[k]) for k in COUNTS), pa.array(base_failed(m)), rows], names=["row", "stratum", *COUNTS, "base_failed", "values"])


def measured(df: DataFrame, text_col: str = "text", stratum_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """(row, stratum, counts, base_failed, values) per row of df: ``row`` has the columns ``carry`` (all
    by default), values the rules' numbers in the order of ``GRIDS``."""
    bounded_batches(df.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in (df.columns if carry is None else carry))).alias("row")
    src = df.select(row, F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    counts = ", ".join(f"{k} bigint" for k in COUNTS)
    return src.mapInArrow(_measure, f"row {src.schema['row'].dataType.simpleString()}, stratum string, {counts}, base_failed boolean, values array<double>")


def cutoffs_of(known: DataFrame, alpha: float = 0.02, delta: float = 0.05, max_strata: int = 1_000) -> dict[str, dict[str, float]]:
    """Cutoffs per stratum from rows (stratum, base_failed, values, label). A stratum whose good texts are
    too few for any cutoff is left out before counts are gathered; of more than ``max_strata`` others an
    error tells, since the counts (41 per stratum and label) and the cutoffs go through the driver."""
    labelled = known.where("label in (0, 1)").select("stratum", F.col("label").cast("int").alias("label"), "base_failed", "values")
    tests = sum(map(len, GRIDS.values()))
    need = log(1 / (delta / tests)) / (alpha / len(GRIDS))  # fewer can't pass even without rejections
    counts = labelled.groupBy("stratum").agg(F.sum("label").alias("good")).where(F.col("good") >= need / 2).select("stratum").limit(max_strata + 1).collect()
    if len(counts) > max_strata:
        raise ValueError(f"more than {max_strata} strata; choose a coarser stratum")
    held = {r.stratum: tuple({k: np.zeros(len(g) + 1, np.int64) for k, g in GRIDS.items()} for _ in range(2)) for r in counts}
    grids = F.array(*(F.array(*map(F.lit, g)) for g in GRIDS.values()))
    above = F.transform("values", lambda v, i: F.size(F.filter(F.get(grids, i), lambda c: c < v)))
    passed = labelled.where(~F.col("base_failed") & F.col("stratum").isin(list(held)))
    tally = passed.select("stratum", "label", F.posexplode(above).alias("rule", "bucket")).groupBy("stratum", "label", "rule", "bucket").agg(F.count("*").alias("n"))
    names = list(GRIDS)
    for r in tally.collect():
        held[r.stratum][r.label][names[r.rule]][r.bucket] += r.n
    shared = delta / (tests * max(1, len(held)))
    return {s: choose(good, bad, alpha / len(GRIDS), shared) for s, (bad, good) in held.items()}


def cutoffs(texts: DataFrame, alpha: float = 0.02, delta: float = 0.05, max_strata: int = 1_000) -> dict[str, dict[str, float]]:
    """``cutoffs_of`` from rows (stratum, text, label)."""
    return cutoffs_of(measured(texts, "text", "stratum", ["label"]).withColumn("label", F.col("row.label")), alpha, delta, max_strata)


def verdicts(rows: DataFrame, rules: dict[str, dict[str, float]]) -> DataFrame:
    """Rows of ``measured`` with ``kept`` instead of values; the rules are broadcast, which their bound on
    strata keeps small."""
    table = [(s, [float(own.get(k, "inf")) for k in GRIDS]) for s, own in rules.items()]
    limits = rows.sparkSession.createDataFrame(table, "__stratum string, __limits array<double>")
    met = rows.join(F.broadcast(limits), F.col("stratum") == F.col("__stratum"), "left")
    rejected = F.coalesce(F.exists(F.zip_with("values", "__limits", lambda v, c: v > c), lambda x: x), F.lit(False))
    return met.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum", "values", "__stratum", "__limits")


def judge(df: DataFrame, rules: dict[str, dict[str, float]], text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(row, counts, base_failed, kept) for every row of df."""
    return verdicts(measured(df, text_col, stratum_col), rules)


@tidy
def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Thresholds from all labelled documents, applied to all documents. Texts are measured once, where
    they are read; only their numbers meet the labels. The labelled documents are the holdout: nothing is
    fitted to them but the choice among fixed cutoffs, which the correction pays for. Each counts once:
    repeated labels and repeated rows with the same numbers are one, and a document with both labels
    is left out. The table of numbers stays in the shared folder, since the result reads it."""
    rows = keep(measured(docs, carry=["doc_id"]))
    marked = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("label"), F.max("quality").alias("__most")).where("label = __most").drop("__most")
    known = rows.withColumn("__id", F.col("row.doc_id")).join(marked, "__id").dropDuplicates(["__id", "stratum", "base_failed", "values"])
    rules = cutoffs_of(known, alpha, delta)
    return verdicts(rows, rules).select("row.doc_id", *COUNTS, "base_failed", "kept")
