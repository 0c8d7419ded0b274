"""Semi-structured payloads: extraction and repair of JSON, aliases, defaults, merges, review."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: alternate spellings of top-level fields, and of section kinds
FIELD_ALIASES = {
    "documentType": "document_type", "documentId": "document_id", "publicationDate": "publication_date", "datePublished": "publication_date",
    "date": "publication_date", "documentNumber": "document_id", "issueNumber": "document_id", "type": "document_type", "kind": "document_type",
    "author": "_author_hint", "issuer": "_author_hint", "actionInfo": "action_info", "action_Info": "action_info",
    "documentStructure": "document_structure", "contactInfo": "contact_info", "contact_Info": "contact_info",
}
KIND_ALIASES = {"header": "heading", "title": "heading", "body": "paragraph", "text": "paragraph", "footnote": "note", "ref": "citation", "reference": "citation"}
REQUIRED = ["document_type", "title", "document_id", "sections", "metadata", "amendments"]
REVIEW_BELOW, EXCERPT = 0.75, 3000


def section_kind(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in KIND_ALIASES.items() for x in kv))
    kind = F.coalesce(kind, F.lit("paragraph"))
    return F.coalesce(F.try_element_at(known, kind), kind)


def balance(text: str, nested: bool = False) -> str:
    """Close what is open. Plain: all lists, then all objects; nested: in the order of opening, with
    an open string closed first."""
    stack, in_string, escaped = [], False, False
    for ch in text:
        if escaped:
            escaped = False
        elif in_string and ch == "\\":
            escaped = True
        elif ch == '"':
            in_string = not in_string
        elif not in_string and ch in "{[":
            stack.append(ch)
        elif not in_string and ch in "}]":
            opener = "{" if ch == "}" else "["
            if opener in stack:
                del stack[len(stack) - 1 - stack[::-1].index(opener)]
    if nested and in_string:
        text += '"'
    text = re.sub(r",\s*\Z", "", text)
    if nested:
        return text + "".join("}" if x == "{" else "]" for x in reversed(stack))
    return text + "]" * stack.count("[") + "}" * stack.count("{")


#: fixed values: messages of replies that can't be read
NO_OBJECT, NOT_OBJECT, NOT_JSON = "No JSON object found in LLM output", "LLM returned JSON but not an object: {kind}", "LLM returned non-JSON output: {error} | snippet: {snippet!r}"
UNPARSEABLE = "AI returned unparseable output – full manual review required."
#: fixed values: what a cut reply loses, its last incomplete pair or else its last incomplete object
CUTS = (r",\s*\"[^\"]+\"\s*:\s*[^,\n]*$", r",\s*\{[^}]*$")
SNIPPET = 400


def read_object(raw: str | None, compat: bool = True) -> dict:
    """The object in a reply: fences and what stands before the first brace go, open ends are closed, and
    a last incomplete pair or object is cut (compat: from the closed text, as it stands). A ValueError
    says why there is none."""
    text = re.sub(r"\s*```\s*$", "", re.sub(r"^```(?:json)?\s*", "", (raw or "").strip(), flags=re.I)).strip()
    start = text.find("{")
    if start < 0:
        raise ValueError(NO_OBJECT)
    text = text[start:]
    if compat:
        closed = balance(text)
        tries = [closed, *(balance(re.sub(p, "", closed.rstrip())) for p in CUTS)]
    else:
        tries = [balance(t, nested) for t in (text, *(re.sub(p, "", text.rstrip()) for p in CUTS)) for nested in (False, True)]
    first = None
    for candidate in tries:
        try:
            got = json.loads(candidate)
        except ValueError as e:
            first = first or e
            continue
        if not isinstance(got, dict):
            raise ValueError(NOT_OBJECT.format(kind=type(got)))
        return got
    raise ValueError(NOT_JSON.format(error=first, snippet=tries[0][:SNIPPET].replace("\n", " ")))


def canonical(got: dict) -> dict:
    """Fields under canonical names, the later of two spellings; sections' kinds under theirs."""
    out = {}
    for k, v in got.items():
        out[FIELD_ALIASES.get(k, k)] = v
    sections = out.get("sections")
    for s in sections if isinstance(sections, list) else ():
        if isinstance(s, dict):
            kind = s.get("kind", "paragraph")
            s["kind"] = KIND_ALIASES.get(kind, kind) if isinstance(kind, str) else kind
    return out


def repair(raw: str | None, compat: bool = True) -> str | None:
    """``read_object`` as JSON; None if no object can be read."""
    try:
        return json.dumps(read_object(raw, compat), ensure_ascii=False)
    except ValueError:
        return None


def repair_json(raw: Column, compat: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: repair(x, compat))

    return run(raw)


def extract(raw: Column, compat: bool = True) -> Column:
    """struct<payload, error>: the reply's object as JSON under canonical names, or why there is none."""

    @F.pandas_udf("struct<payload:string,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(x: str | None) -> tuple[str | None, str | None]:
            try:
                return json.dumps(canonical(read_object(x, compat)), ensure_ascii=False), None
            except ValueError as e:
                return None, str(e)

        return pd.DataFrame([one(x) for x in s], columns=["payload", "error"])

    return run(raw)


def normalise(payload: Column) -> Column:
    """map<string, string> of top-level fields under canonical names; of two spellings the later one in
    the text counts. Strings as they are, other values as JSON, a JSON null as null. What is not a JSON
    object is null as a whole."""

    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> dict[str, str | None] | None:
            try:
                got = json.loads(x) if x is not None else None
            except ValueError:
                return None
            if not isinstance(got, dict):
                return None
            return {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in canonical(got).items()}

        return s.map(one)

    return run(payload)


def stub(number: Column, error: Column) -> Column:
    """The payload of a chunk that could not be read, as JSON: a note for the reviewer instead of text."""
    note = F.struct(F.lit("note").alias("kind"), F.concat(F.lit("[chunk "), number.cast("string"), F.lit("] "), error).alias("text"))
    return F.to_json(
        F.struct(
            F.lit("unknown").alias("document_type"),
            F.lit("PARSE ERROR – manual review required").alias("title"),
            F.lit("parse-error").alias("document_id"),
            F.lit(None).cast("string").alias("publication_date"),
            F.array(note).alias("sections"),
            F.array().cast("array<string>").alias("signatures"),
            F.struct(F.lit(0.0).alias("confidence"), error.alias("parse_error")).alias("metadata"),
            F.array().cast("array<string>").alias("amendments"),
        ),
        {"ignoreNullFields": "false"},
    )


def filled(fields: Column) -> Column:
    """Defaults for absent keys only: a present null stays. The author hint titles the untitled."""
    has = lambda k: F.coalesce(F.map_contains_key(fields, k), F.lit(False))
    get = lambda k, d: F.when(has(k), F.try_element_at(fields, F.lit(k))).otherwise(d)
    return F.struct(
        get("document_type", F.lit("unknown")).alias("document_type"),
        get("title", get("_author_hint", F.lit("Untitled"))).alias("title"),
        get("document_id", F.lit("unknown")).alias("document_id"),
        get("publication_date", F.lit(None).cast("string")).alias("publication_date"),
        get("sections", F.lit("[]")).alias("sections"),
        get("signatures", F.lit("[]")).alias("signatures"),
        get("metadata", F.lit('{"confidence": 0.5}')).alias("metadata"),
        get("amendments", F.lit("[]")).alias("amendments"),
    )


def missing_keys(json_text: Column) -> Column:
    keys = F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))
    return F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: ~F.array_contains(keys, k))


def merge_chunks(chunks: DataFrame, doc: str, index: str) -> DataFrame:
    """Rows (title, sections, signatures, publication_date, confidence) per chunk to one per document:
    the first chunk's title, lists joined in order, the union of signatures in order of name, the first
    date that is not empty, the largest confidence. Amendments, where the rows have them, are joined in
    order like sections; any other column is the first chunk's."""
    by_index = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)  # noqa: E731  maps have no order of their own
    joined = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("at"), F.coalesce(c, F.array().cast(chunks.schema[c].dataType)).alias(c))), by_index), lambda x: x[c])).alias(c)
    dated = F.when(F.coalesce(F.col("publication_date"), F.lit("")) != "", F.col("publication_date"))
    return chunks.groupBy(doc).agg(
        F.min_by("title", index).alias("title"),
        joined("sections"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("signatures")))).alias("signatures"),
        F.min_by(dated, F.when(dated.isNotNull(), F.col(index))).alias("publication_date"),
        F.max("confidence").alias("confidence"),
        *(joined(c) if c == "amendments" else F.min_by(c, index).alias(c) for c in chunks.columns if c not in (doc, index, "title", "sections", "signatures", "publication_date", "confidence")),
    )


def review_questions(amendments: Column, parse_error: Column) -> Column:
    """Questions of amendments under the threshold, and a fixed one after a parse error."""
    asked = F.filter(amendments, lambda a: (F.coalesce(a["confidence"], F.lit(0.0)) < REVIEW_BELOW) & (F.coalesce(a["question"], F.lit("")) != ""))
    return F.concat(F.transform(asked, lambda a: a["question"]), F.when(F.coalesce(parse_error, F.lit("")) != "", F.array(F.lit(UNPARSEABLE))).otherwise(F.array().cast("array<string>")))


def review_items(docs: DataFrame, at: Column) -> DataFrame:
    """Queue rows of documents that need review, or have any note: status pending and the time unless the
    row brings its own; ``file_name`` is the time and the document's id."""
    have = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    named = F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.coalesce("document_id", F.lit("unknown")), F.lit(".json"))
    return docs.where("coalesce(needs_review, false) or size(notes) > 0").select(
        F.coalesce(have("status"), F.lit("pending")).alias("status"),
        F.coalesce(have("created_at"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("created_at"),
        "document_id",
        "title",
        F.concat(F.coalesce("questions", F.array().cast("array<string>")), F.coalesce("notes", F.array().cast("array<string>"))).alias("questions"),
        F.substring("raw_text", 1, EXCERPT).alias("raw_excerpt"),
        *(["metadata"] if "metadata" in docs.columns else []),
        named.alias("file_name"),
    )


def pending(items: DataFrame) -> DataFrame:
    return items.where("status = 'pending'").orderBy("file_name")


def stamped(metadata: Column, model: Column, reason: Column, chunks: Column, at: Column) -> Column:
    """map<string, string> metadata with the run's own entries over those of the payload."""
    own = F.create_map(
        F.lit("ai_mode"), F.lit("llm"), F.lit("model"), F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown")), F.lit("model_reason"), F.coalesce(reason, F.lit("")),
        F.lit("chunks_processed"), chunks.cast("string"), F.lit("processed_at"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    )
    rest = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
    return F.map_concat(rest, own)
