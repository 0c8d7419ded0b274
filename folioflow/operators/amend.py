"""Amendments: an ordered fold over a law's text, versions of laws, unified diffs."""

from __future__ import annotations

import difflib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions import text as T

LOW = 0.75


def _swap(txt: Column, old: Column, new: Column) -> Column:
    """The first place of old replaced."""
    at = F.position(old, txt)
    return F.concat(F.substring(txt, F.lit(1), at - 1), new, F.substring(txt, at + F.length(old), F.length(txt)))


def step(acc: Column, a: Column, number: Column) -> Column:
    """One amendment on struct<text, changed, low, notes>."""
    op = F.lower(F.coalesce(F.nullif(a["operation"], F.lit("")), F.lit("unknown")))
    old, new = F.coalesce(a["old_text"], F.lit("")), F.coalesce(a["new_text"], F.lit(""))
    conf = F.coalesce(a["confidence"].try_cast("double"), F.lit(0.0))
    txt = acc["text"]
    has_old = (old != "") & (F.position(old, txt) > 0)
    anchor = T.strip(old)
    has_anchor = (anchor != "") & (F.position(anchor, txt) > 0)
    at = F.concat(F.lit("amendment #"), number.cast("string"))
    low = conf < LOW
    known = op.isin("replace", "insert", "delete")
    out = (
        F.when((op == "replace") & has_old, _swap(txt, old, new))
        .when((op == "delete") & has_old, _swap(txt, old, F.lit("")))
        .when((op == "insert") & has_anchor, _swap(txt, anchor, F.concat(anchor, F.lit("\n"), new)))
        .when(op == "insert", F.concat(txt, F.lit("\n\n"), new))
        .otherwise(txt)
    )
    changed = (op == "insert") | (op.isin("replace", "delete") & has_old)
    notes = F.array_compact(
        F.array(
            F.when(low, F.concat(at, F.lit(" low confidence ("), F.format_string("%.2f", conf), F.lit(")"))),
            F.when(op.isin("replace", "delete") & ~has_old, F.concat(op, F.lit(" failed in "), at, F.lit(": old_text not found"))),
            F.when(~known, F.concat(F.lit("unknown operation in "), at)),
        )
    )
    return F.struct(out.alias("text"), (acc["changed"] | changed).alias("changed"), (acc["low"] | low | ~known).alias("low"), F.concat(acc["notes"], notes).alias("notes"))


def apply_amendments(text: Column, amendments: Column, one_by_one: bool = True) -> Column:
    """struct<text, changed, low, notes> after array<struct<operation, old_text, new_text, confidence>>.
    one_by_one: every amendment is a call of its own and so is number 1."""
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(False).alias("changed"), F.lit(False).alias("low"), F.array().cast("array<string>").alias("notes"))
    numbered = F.transform(amendments, lambda a, i: F.struct(a.alias("a"), (F.lit(1) if one_by_one else i + 1).alias("i")))
    return F.aggregate(numbered, start, lambda acc, x: step(acc, x["a"], x["i"]))


def amended(text: str, operation: str | None, old: str | None, new: str | None, confidence: float, number: int = 1) -> tuple[str, bool, bool, list[str]]:
    """``step`` on plain values: (text, changed, low, notes)."""
    op, old, new, at = (operation or "unknown").lower(), old or "", new or "", f"amendment #{number}"
    notes = [f"{at} low confidence ({confidence:.2f})"] if confidence < LOW else []
    if op == "insert":
        anchor = old.strip()
        there = anchor and anchor in text
        return (text.replace(anchor, f"{anchor}\n{new}", 1) if there else f"{text}\n\n{new}"), True, bool(notes), notes
    if op in ("replace", "delete"):
        if old and old in text:
            return text.replace(old, new if op == "replace" else "", 1), True, bool(notes), notes
        return text, False, bool(notes), [*notes, f"{op} failed in {at}: old_text not found"]
    return text, False, True, [*notes, f"unknown operation in {at}"]


def _folded(batches):
    """Rows sorted by law, a law's current text (kind 0) first: one row per law with its last state."""
    law, state, out = None, None, []

    def done():
        cols = list(zip(*out)) or [[]] * 5
        types = (law_type, pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["law", "text", "changed", "low", "notes"])

    law_type, held = None, 0
    for b in batches:
        law_type = b.column("law").type
        for row in b.to_pylist():
            if state is None or row["law"] != law:
                if state is not None:
                    out.append((law, *state))
                    held += len(state[0])
                    if held > 2_000_000:
                        yield done()
                        out, held = [], 0
                law, state = row["law"], ["", False, False, []]
            if row["kind"] == 0:
                state[0] = row["new_text"] or ""
                continue
            text, changed, low, notes = amended(state[0], row["operation"], row["old_text"], row["new_text"], row["confidence"])
            state[0], state[1], state[2] = text, state[1] or changed, state[2] or low
            state[3] += notes
    if state is not None:
        out.append((law, *state))
    if out:
        yield done()


def fold_laws(events: DataFrame, law: str, order: list[str], laws: DataFrame | None = None) -> DataFrame:
    """(law, text, changed, low, notes): each law's amendments in order, from its current text. A fold is
    sequential within a law by nature: its rows stream by in the sort's order, which spills, and only the
    text and the notes are held. Laws are independent. Ties in ``order`` go by the amendment's fields."""
    conf = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence")
    src = events.select(F.col(law).alias("law"), F.lit(1).alias("kind"), F.struct(*order).alias("o"), *(F.col(c).cast("string").alias(c) for c in ("operation", "old_text", "new_text")), conf)
    if laws is not None:
        none = F.lit(None).cast("string")
        known = laws.select(F.col(law).alias("law"), F.lit(0).alias("kind"), F.lit(None).cast(src.schema["o"].dataType).alias("o"), none.alias("operation"), none.alias("old_text"), F.col("current_text").alias("new_text"), F.lit(0.0).alias("confidence"))
        src = src.unionByName(known.join(src.select("law").distinct(), "law", "left_semi"))
    ready = src.repartition("law").sortWithinPartitions("law", "kind", "o", "operation", "old_text", "new_text", "confidence").drop("o")
    kind = src.schema["law"].dataType.simpleString()
    return ready.mapInArrow(_folded, f"law {kind}, text string, changed boolean, low boolean, notes array<string>").withColumnRenamed("law", law)


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Unified diff of two texts, '' where they are equal."""

    def one(a: str | None, b: str | None) -> str:
        return "".join(difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), "current", "updated"))

    return pd.Series([one(a, b) for a, b in zip(old, new)])


def latest(versions: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row written under each key: same-day versions overwrite one another."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return versions.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def snapshot(changes: DataFrame, law: str, seq: str, old: str, new: str, date: str, diff: str | None = None) -> DataFrame:
    """Rows (law, kind, date_label, seq, text) that an update writes: previous only over a text, diff only
    where there is one. A missing date is today's (UTC session)."""
    changes = changes.withColumn(date, F.coalesce(F.nullif(F.col(date), F.lit("")), F.date_format(F.current_timestamp(), "yyyy-MM-dd")))
    kinds = [F.struct(F.lit("version").alias("kind"), F.col(new).alias("text")), F.struct(F.lit("current").alias("kind"), F.col(new).alias("text"))]
    kinds.append(F.when(F.coalesce(F.col(old), F.lit("")) != "", F.struct(F.lit("previous").alias("kind"), F.col(old).alias("text"))))
    if diff:
        kinds.append(F.when(F.coalesce(F.col(diff), F.lit("")) != "", F.struct(F.lit("diff").alias("kind"), F.col(diff).alias("text"))))
    rows = changes.select(law, date, seq, F.explode(F.array_compact(F.array(*kinds))).alias("k"))
    return rows.select(law, "k.kind", F.when(F.col("k.kind") == "current", F.lit("")).otherwise(F.col(date)).alias("date_label"), seq, "k.text")
