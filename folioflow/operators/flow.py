"""Raw text to structured documents: chunks, a provider's replies, one retry, stubs, one merged payload.

The provider is a callable from a prompt to a reply (a string, or ``models.Reply``). Its calls have effects
outside and cost more than anything else here, so each pass's replies are written by ``save`` (a function
from a DataFrame to the same rows read back) before they are used twice; only chunks whose first reply
can't be read are asked again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import pages, payload, render

#: characters of a chunk in the second prompt, of the page in a preview
RETRY_CHARS, PREVIEW = 4000, 1500
ASK, ASK_AGAIN = "Structure this text as JSON:\n{text}", "Return one JSON object only:\n{text}"

PARTS = "sections array<struct<kind:string,text:string>>, signatures array<string>, metadata map<string,string>, amendments array<map<string,string>>"


def ask(rows: DataFrame, provider: Callable, prompt: str = "prompt") -> DataFrame:
    """rows with reply, model, reason and failure: what the provider raised, where it did."""

    def one(text: str) -> tuple:
        try:
            got = provider(text)
        except Exception as e:  # the row tells, the job goes on
            return None, None, None, f"{type(e).__name__}: {e}"
        return (got, None, None, None) if isinstance(got, str) else (got.raw, got.model, got.reason, None)

    def run(frames):
        for f in frames:
            answers = pd.DataFrame([one(t) for t in f[prompt]], columns=["reply", "model", "reason", "failure"], index=f.index)
            yield pd.concat([f.drop(columns=[prompt]), answers], axis=1)

    kept = [f"`{c}` {t}" for c, t in rows.dtypes if c != prompt]
    return rows.mapInPandas(run, ", ".join([*kept, "reply string, model string, reason string, failure string"]))


def structure_chunks(chunks: DataFrame, provider: Callable, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chunks (…, chunk_index, chunk) with payload (JSON under canonical names), error, retried, model and
    reason. A first reply that can't be read is asked for again with the chunk's first 4,000 characters;
    the second failing leaves a stub that names the error."""
    own = chunks.columns

    def read(asked: DataFrame) -> DataFrame:
        got = asked.withColumn("x", payload.extract(F.col("reply")))
        return got.select(*own, F.col("x.payload").alias("payload"), F.coalesce("failure", "x.error").alias("error"), "model", "reason")

    first = save(read(ask(chunks.withColumn("prompt", F.replace(F.lit(ASK), F.lit("{text}"), "chunk")), provider)))
    bad = first.where("error is not null").select(*own).withColumn("prompt", F.replace(F.lit(ASK_AGAIN), F.lit("{text}"), F.substring("chunk", 1, RETRY_CHARS)))
    second = save(read(ask(bad, provider)))
    stubbed = F.coalesce("payload", payload.stub(F.col("chunk_index") + 1, F.col("error")))
    return first.where("error is null").withColumn("retried", F.lit(False)).unionByName(second.withColumn("payload", stubbed).withColumn("retried", F.col("error").isNull()))


def parsed(json_text: Column, retried: Column) -> Column:
    """struct of a payload's fields, defaults filled in; lists and the metadata typed."""
    f = payload.filled(payload.normalise(json_text))
    listed = lambda c, kind: F.coalesce(F.from_json(c, kind), F.array().cast(kind))
    meta = F.coalesce(F.from_json(f["metadata"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    meta = F.when(retried, F.map_concat(F.map_filter(meta, lambda k, v: k != "retried"), F.create_map(F.lit("retried"), F.lit("true")))).otherwise(meta)
    return F.struct(
        *(f[k].alias(k) for k in ("document_type", "title", "document_id", "publication_date")),
        listed(f["sections"], "array<struct<kind:string,text:string>>").alias("sections"),
        listed(f["signatures"], "array<string>").alias("signatures"),
        meta.alias("metadata"),
        listed(f["amendments"], "array<map<string,string>>").alias("amendments"),
    )


def structure(docs: DataFrame, provider: Callable, save: Callable[[DataFrame], DataFrame], at: Column, doc: str = "doc_id", raw: str = "raw_text", limit: int = pages.CHUNK_CHARS) -> DataFrame:
    """One structured row per document of docs (doc, raw): the merged payload's fields, questions,
    needs_review, and the metadata stamped with model, reason, number of chunks and time."""
    chunks = pages.chunks(docs, doc, raw, limit)
    done = structure_chunks(chunks, provider, save)
    rows = done.select(doc, "total", "chunk_index", "model", "reason", parsed(F.col("payload"), F.col("retried")).alias("p")).select(doc, "total", "chunk_index", "model", "reason", "p.*")
    confidence = F.coalesce(F.col("metadata")["confidence"].try_cast("double"), F.lit(0.0))
    rows = rows.withColumn("confidence", confidence)
    # the model that a payload's own metadata names; the provider's is on the chunk rows
    rows = rows.withColumn("first_model", F.try_element_at("metadata", F.lit("model"))).withColumn("first_reason", F.try_element_at("metadata", F.lit("model_reason"))).drop("model", "reason")
    merged = payload.merge_chunks(rows, doc, "chunk_index")
    # a single chunk passes as it is; of several the best confidence stands
    meta = F.map_concat(F.map_filter("metadata", lambda k, v: k != "confidence"), F.create_map(F.lit("confidence"), F.col("confidence").cast("string")))
    meta = payload.stamped(F.when((F.col("total") > 1) | F.map_contains_key("metadata", "confidence"), meta).otherwise(F.col("metadata")), F.col("first_model"), F.col("first_reason"), F.col("total"), at)
    asked = F.transform("amendments", lambda a: F.struct(F.try_element_at(a, F.lit("confidence")).try_cast("double").alias("confidence"), F.try_element_at(a, F.lit("question_for_human")).alias("question")))
    out = merged.withColumn("metadata", meta).withColumn("questions", payload.review_questions(asked, F.try_element_at("metadata", F.lit("parse_error"))))
    return out.withColumn("needs_review", F.size("questions") > 0).drop("first_model", "first_reason", "total", "confidence")


def rendered(structured: DataFrame, raw: str = "raw_text", cabinet: str | None = None) -> DataFrame:
    """structured rows (with their raw text) with html_text, xml_text and html_preview. ``cabinet`` names a
    column of struct ``render.CABINET``, where the payload came as a cabinet act."""
    c = F.col
    meta = F.map_filter("metadata", lambda k, v: v.isNotNull())
    changes = F.transform("amendments", lambda a: F.struct(F.try_element_at(a, F.lit("target_law_id")).alias("target_law_id"), F.try_element_at(a, F.lit("diff")).alias("diff")))
    html = render.html(c("title"), c("document_id"), c("document_type"), c("publication_date"), c("sections"), c("signatures"), changes)
    generic = render.generic_xml(c("title"), c("document_id"), c("document_type"), c("publication_date"), c("sections"), c("signatures"), meta, c("amendments"))
    gazette = render.gate(c("document_type"), c("title"), c(raw), c("sections"))
    chapter = F.coalesce(c(raw).contains(render.CHAPTER), F.lit(False))
    old = render.act_xml(render.act(F.coalesce(c(raw), F.lit(""))), F.coalesce("title", F.lit("")), F.coalesce("document_type", F.lit("")), chapter)
    xml = render.to_xml(c(cabinet), gazette, old, generic) if cabinet else F.coalesce(F.when(gazette, old), generic)
    return structured.withColumn("html_text", html).withColumn("xml_text", xml).withColumn("html_preview", F.substring("html_text", 1, PREVIEW))


def amendments_of(structured: DataFrame, doc: str, seq: str) -> DataFrame:
    """Rows (doc, seq, pos, law_id, law_slug, effective_date and the amendment's fields) of all amendments
    that name a law; those without a target are left out. Applied in the order (seq, pos)."""
    each = structured.select(doc, seq, "publication_date", F.posexplode("amendments").alias("pos", "a"))
    get = lambda k: F.try_element_at("a", F.lit(k)).alias(k)
    rows = each.select(doc, seq, "pos", F.col("publication_date").alias("effective_date"), get("target_law_id"), get("operation"), get("old_text"), get("new_text"), get("confidence"))
    return rows.where("coalesce(target_law_id, '') <> ''").withColumn("law_slug", T.slugify(F.col("target_law_id")))


def notes_of(applied: DataFrame, doc: str, order: list[str], notes: str = "notes") -> DataFrame:
    """(doc, notes): all notes of a document's amendments, in their order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(notes).alias("n"))))
    return applied.groupBy(doc).agg(F.flatten(F.transform(parts, lambda x: x["n"])).alias("notes"))


def result(docs: DataFrame, xml_dir: str, html_dir: str) -> DataFrame:
    """The answer per document: id, title, paths, URLs by base name, and whether a person must look."""
    from folioflow.sources.outputs import output_paths

    at = output_paths(F.col("document_id"), xml_dir, html_dir)
    url = lambda kind, c: F.concat(F.lit(f"/outputs/{kind}/"), T.basename(c))
    review = F.coalesce(F.col("needs_review"), F.lit(False)) | (F.coalesce(F.size("notes"), F.lit(0)) > 0)
    return docs.select("document_id", "title", at["xml"].alias("xml"), at["html"].alias("html"), url("html", at["html"]).alias("html_url"), url("xml", at["xml"]).alias("xml_url"), review.alias("needs_review"))
