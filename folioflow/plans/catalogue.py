"""Every query of the reference's operators, by name, with its DuckDB oracle.

Conversations stand for documents (a turn is a page), documents for sections, events for amendments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import amend, flow, models, pages, payload, render
from folioflow.sources import documents as src
from folioflow.sources import outputs
from folioflow.streaming import events as ev

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return pages.merge_pages(_t(spark, d, "conversations").withColumn("page", F.col("turn") + 1), "conv_id", "page", "text")


_RAW = "SELECT conv_id, count(*) AS n_pages, string_agg('[PAGE ' || (turn + 1) || ']' || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS raw_text FROM conversations GROUP BY conv_id"


@_register(_RAW)
def page_merge(spark, d):
    return _raw(spark, d)


#: white space that both engines strip
_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@_register(f"""
WITH RECURSIVE raw AS ({_RAW}), cells AS (
  SELECT conv_id, list_concat(list_transform(list_zip(regexp_extract_all(raw_text, '\\[PAGE \\d+\\]'), string_split_regex(raw_text, '\\[PAGE \\d+\\]')[2:]), lambda x: x[1] || x[2]), [string_split_regex(raw_text, '\\[PAGE \\d+\\]')[-1]]) AS segs FROM raw
), fold(conv_id, segs, i, done, cur) AS (
  SELECT conv_id, segs, 1, []::VARCHAR[], '' FROM cells
  UNION ALL
  SELECT conv_id, segs, i + 1,
    CASE WHEN length(cur) + length(segs[i]) > 600 AND cur <> '' THEN list_append(done, trim(cur, {_WS})) ELSE done END,
    CASE WHEN length(cur) + length(segs[i]) > 600 AND cur <> '' THEN segs[i] ELSE cur || segs[i] END
  FROM fold WHERE i <= len(segs)
), packed AS (SELECT conv_id, CASE WHEN trim(cur, {_WS}) <> '' OR len(done) = 0 THEN list_append(done, trim(cur, {_WS})) ELSE done END AS c FROM fold WHERE i > len(segs))
SELECT conv_id, len(c)::BIGINT AS total, unnest(range(len(c)))::BIGINT AS chunk_index, unnest(c) AS chunk FROM packed""")
def chunk_pack(spark, d):
    """Conversations merged and packed to chunks of 600 characters, as the reference packs."""
    return pages.chunks(_raw(spark, d), "conv_id", limit=600)


_QUALITY = "CASE WHEN length(t) = 0 THEN 0.0 ELSE round_even((length(t) - length(regexp_replace(t, '[Ͱ-Ͽἀ-῿a-zA-Z0-9 \\t\\n\\v\\f\\r\u0085 .,;:\\-–()/«»\"''%€]', '', 'g'))) / length(t)::DOUBLE, 3) END"
_JUNK = "CASE WHEN doc_id % 7 = 0 THEN text || repeat('@', 2 * n_chars) ELSE text END"


def _junk(spark, d):
    return _t(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.repeat(F.lit("@"), (2 * F.col("n_chars")).cast("int")))).otherwise(F.col("text"))).withColumn("n_images", F.col("doc_id") % 3)


@_register(f"SELECT doc_id, {_QUALITY} AS quality FROM (SELECT doc_id, {_JUNK} AS t FROM documents)")
def text_quality(spark, d):
    return _junk(spark, d).select("doc_id", T.text_quality(F.col("text")).alias("quality"))


_CLASSES = f"SELECT doc_id, text, length(t) AS char_count, {_QUALITY} AS quality, length(t) >= 50 AND {_QUALITY} >= 0.6 AS has_text_layer FROM (SELECT doc_id, {_JUNK} AS text, trim({_JUNK}, {_WS}) AS t FROM documents)"


@_register(f"SELECT doc_id, char_count, quality, has_text_layer, NOT has_text_layer AS is_scanned, has_text_layer AND doc_id % 3 > 0 AS is_mixed FROM ({_CLASSES})")
def page_classify(spark, d):
    return pages.classify(_junk(spark, d)).select("doc_id", "char_count", "quality", "has_text_layer", "is_scanned", "is_mixed")


@_register(f"SELECT doc_id, CASE WHEN has_text_layer THEN text END AS page_text, CASE WHEN has_text_layer THEN 'pymupdf' ELSE 'tesseract_pending' END AS method, NOT has_text_layer OR doc_id % 3 > 0 AS to_ocr FROM ({_CLASSES})")
def page_text_route(spark, d):
    return pages.route(pages.classify(_junk(spark, d))).select("doc_id", "page_text", "method", (F.col("is_scanned") | F.col("is_mixed")).alias("to_ocr"))


@_register("SELECT url, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[ \\t\\n\\v\\f\\r]+', '-', 'g'), '[^a-z0-9_.Ͱ-Ͽἀ-῿-]', '', 'g'), ''), 'untitled') AS slug FROM (SELECT url FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT ' ν. 4622/2019 ' UNION ALL SELECT '!!!')")
def slugify(spark, d):
    names = _t(spark, d, "pages").select("url").unionAll(_t(spark, d, "part").select("p_name")).unionAll(spark.createDataFrame([(" ν. 4622/2019 ",), ("!!!",)], "url string"))
    return names.select("url", T.slugify(F.col("url")).alias("slug"))


@_register(f"SELECT doc_id, trim(regexp_replace(chr(13) || chr(10) || chr(9) || text || '  ', '[ \\t\\n\\v\\f\\r\u0085 ]+', ' ', 'g')) AS clean FROM documents")
def normalize_ws(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.normalize_ws(F.concat(F.lit("\r\n\t"), "text", F.lit("  "))).alias("clean"))


@_register("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", T.escape_markup(F.col("html")).alias("escaped"))


@_register("SELECT doc_id, string_agg(l, chr(10) ORDER BY length(l) % 7, i) AS page FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id")
def line_order(spark, d):
    blocks = F.transform(F.split("text", "\n"), lambda l, i: F.struct((F.length(l) % 7).alias("y"), i.alias("ord"), l.alias("text")))
    return _t(spark, d, "documents").select("doc_id", pages.lines_by_y(blocks).alias("page"))


_HALF = "substr(text, 1, n_chars // 2)"


@_register(f"SELECT doc_id, concat_ws(chr(10) || chr(10) || '--- ΣΤΗΛΗ 2 ---' || chr(10) || chr(10), nullif(trim(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE {_HALF} END, {_WS}), ''), nullif(trim(substr(text, n_chars // 2 + 1), {_WS}), '')) AS page FROM documents")
def two_column_join(spark, d):
    half = F.expr("substr(text, 1, int(n_chars div 2))")
    return _t(spark, d, "documents").select("doc_id", pages.two_columns(F.when(F.col("doc_id") % 5 == 0, " ").otherwise(half), F.expr("substr(text, int(n_chars div 2) + 1)")).alias("page"))


_MONTHS = "['" + "', '".join(T.GREEK_MONTHS) + "']"


def _written(spark, d):
    months = F.array(*map(F.lit, T.GREEK_MONTHS))
    return _t(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.element_at(months, F.month("o_orderdate")), F.year("o_orderdate").cast("string")).alias("t"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("dotted"))


@_register("SELECT o_orderkey, CASE WHEN month(o_orderdate) <> 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def greek_date(spark, d):
    return _written(spark, d).select("o_orderkey", T.greek_date(F.concat(F.lit("Αθήνα, "), "t")).alias("iso"))


@_register("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN month(o_orderdate) = 5 THEN '2001-02-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS picked FROM orders")
def dot_date(spark, d):
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.col("dotted")).otherwise(F.concat("t", F.lit(" 31.02.2001")))
    return _written(spark, d).select("o_orderkey", T.dot_date(F.col("dotted")).alias("iso"), T.publication_date(mixed).alias("picked"))


@_register("SELECT o_orderkey, 'α=' || o_orderpriority || ';γ=' || o_orderstatus AS items FROM orders")
def alpha_list(spark, d):
    t = F.concat(F.lit("λίστα: α) "), "o_orderpriority", F.lit(" β)  γ) "), "o_orderstatus")
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(T.alpha_list(t), lambda x: F.concat(x["letter"], F.lit("="), x["text"])), ";").alias("items"))


@_register("SELECT o_orderkey, '1=άρθρο;45=του ν.;' || o_orderkey || '=' || o_orderstatus || ';2=β' AS items FROM orders")
def numbered_items(spark, d):
    t = F.concat(F.lit("1. άρθρο 45. του ν. "), F.col("o_orderkey").cast("string"), F.lit(". "), "o_orderstatus", F.lit(" 2. β"))
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(T.numbered_items(t), lambda x: F.concat(x["number"], F.lit("="), x["text"])), ";").alias("items"))


def _gazette(spark, d):
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = _t(spark, d, "customer").join(F.broadcast(nation), "c_nationkey")  # nations are a fixed list of 25
    key = F.col("c_custkey").cast("string")
    raw = F.concat(
        F.lit("ΤΕΥΧΟΣ ΠΡΩΤΟ\nΑρ. Φύλλου "), key, F.lit("\n8 Ιανουαρίου 2026 ΠΡΑΞΕΙΣ ΥΠΟΥΡΓΙΚΟΥ ΣΥΜΒΟΥΛΙΟΥ\nΠράξη "), key, F.lit(" της 02-01-2026 Τίτλος "), "n_name",
        F.lit(" ΤΟ ΥΠΟΥΡΓΙΚΟ ΣΥΜΒΟΥΛΙΟ Έχοντας υπόψη: 1. Τις διατάξεις: α) πρώτη β) δεύτερη 2. Το γεγονός αποφασίζει: Εγκρίνει "), "c_mktsegment",
        F.lit(". Η παρούσα Πράξη να δημοσιευθεί στην Εφημερίδα. Ο Πρωθυπουργός "), "c_name", F.lit(" Τα Μέλη του Υπουργικού Συμβουλίου "), "n_name", F.lit(", , Β"), key, F.lit(" Καποδιστρίου 34 Τηλ. 210-"), key, F.lit(" https://x.gr/"), key,
    )
    return c.select("c_custkey", "n_name", "c_name", "c_mktsegment", raw.alias("raw"))


@_register("SELECT c_custkey, c_name AS premier, n_name || '|Β' || c_custkey AS members FROM customer JOIN nation ON n_nationkey = c_nationkey")
def signatures_parse(spark, d):
    g = _gazette(spark, d).select("c_custkey", T.signatures(T.normalize_ws(F.col("raw"))).alias("s"))
    return g.select("c_custkey", F.col("s.premier").alias("premier"), F.array_join("s.members", "|").alias("members"))


@_register("SELECT c_custkey, 'Καποδιστρίου 34' AS address, '210-' || c_custkey AS phone, 'https://x.gr/' || c_custkey AS url FROM customer")
def contact_parse(spark, d):
    return _gazette(spark, d).select("c_custkey", T.contacts(T.normalize_ws(F.col("raw"))).alias("c")).select("c_custkey", "c.*")


@_register("SELECT c_custkey, 'ΠΡΩΤΟ' AS issue, c_custkey::VARCHAR AS issue_number, '2026-01-08' AS publication_date, c_custkey::VARCHAR AS number, '02-01-2026' AS act_date, 'Τίτλος ' || n_name AS title, 'ΤΟ ΥΠΟΥΡΓΙΚΟ ΣΥΜΒΟΥΛΙΟ' AS organ, '1. Τις διατάξεις: α) πρώτη β) δεύτερη 2. Το γεγονός' AS reasoning, 'Εγκρίνει ' || c_mktsegment || '. Η παρούσα Πράξη να δημοσιευθεί στην Εφημερίδα.' AS decision FROM customer JOIN nation ON n_nationkey = c_nationkey")
def act_header(spark, d):
    return _gazette(spark, d).select("c_custkey", render.act(F.col("raw")).alias("a")).select("c_custkey", *(f"a.{c}" for c in ("issue", "issue_number", "publication_date", "number", "act_date", "title", "organ", "reasoning", "decision")))


@_register("""SELECT c_custkey, '<EfimeridaKyverniseos><Metadata><Titlos>Εφημερίδα της Κυβερνήσεως της Ελληνικής Δημοκρατίας</Titlos><Teychos>ΠΡΩΤΟ</Teychos><ArithmosFyllou>' || c_custkey || '</ArithmosFyllou><Hmerominia>2026-01-08</Hmerominia></Metadata><Periexomena><Kefalaio titlos="ΠΡΑΞΕΙΣ ΥΠΟΥΡΓΙΚΟΥ ΣΥΜΒΟΥΛΙΟΥ"><Praxi arithmos="' || c_custkey || '" hmerominia="02-01-2026"><Titlos>Τίτλος ' || n_name || '</Titlos><Organ>ΤΟ ΥΠΟΥΡΓΙΚΟ ΣΥΜΒΟΥΛΙΟ</Organ><AitiolologikoMeros><Eisagogi>Έχοντας υπόψη:</Eisagogi><Stoicheio arithmos="1"><Eisagogi>Τις διατάξεις:</Eisagogi><Lista><Peripton grammato="α">πρώτη</Peripton><Peripton grammato="β">δεύτερη</Peripton></Lista></Stoicheio><Stoicheio arithmos="2">Το γεγονός</Stoicheio></AitiolologikoMeros><ApoφασιστικόΜέρος><Eisagogi>αποφασίζει:</Eisagogi><Arthro>Εγκρίνει ' || c_mktsegment || '.</Arthro><DiataghDimosiefseos>Η παρούσα Πράξη να δημοσιευθεί στην Εφημερίδα της Κυβέρνησης.</DiataghDimosiefseos></ApoφασιστικόΜέρος><Ypografes><Prothypourgos><Onoma>' || c_name || '</Onoma></Prothypourgos><MeliYpourgikoySymvouliou><Melos>' || n_name || '</Melos><Melos>Β' || c_custkey || '</Melos></MeliYpourgikoySymvouliou></Ypografes></Praxi></Kefalaio></Periexomena><Epikoinonia><Dieuthinsi>Καποδιστρίου 34</Dieuthinsi><Tilefono>210-' || c_custkey || '</Tilefono><HlektronikaDieuthinsi>https://x.gr/' || c_custkey || '</HlektronikaDieuthinsi></Epikoinonia></EfimeridaKyverniseos>' AS xml FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def act_xml(spark, d):
    g = _gazette(spark, d).select("c_custkey", render.act(F.col("raw")).alias("a"))
    return g.select("c_custkey", render.act_xml(F.col("a"), F.lit(""), F.lit("fek"), F.lit(True)).alias("xml"))


@_register("SELECT doc_id, doc_id % 5 IN (0, 1, 2, 3) AS is_gazette FROM documents")
def gazette_gate(spark, d):
    k = F.col("doc_id") % 5
    sections = F.array(F.struct(F.when(k == 3, "ο πρωθυπουργός").otherwise("x").alias("text")))
    return _t(spark, d, "documents").select("doc_id", render.gate(F.when(k == 0, "cabinet_act").otherwise("law"), F.when(k == 1, "ΠΡΑΞΗ 3").otherwise("t"), F.when(k == 2, "ΕΦΗΜΕΡΙΔΑ ΤΗΣ ΚΥΒΕΡΝΗΣΕΩΣ").otherwise("raw"), sections).alias("is_gazette"))


_E = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _sections():
    return F.transform(F.split("text", "\n"), lambda l, i: F.struct(F.element_at(F.array(*map(F.lit, ("heading", "note", "citation", "paragraph"))), i % 4 + 1).alias("kind"), l.alias("text")))


_LINES = "SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents"


@_register(f"""SELECT doc_id, '<!doctype html>' || chr(10) || '<html><head><meta charset=''utf-8''>' || chr(10) || '{render._STYLE}' || chr(10) || '</head><body style=''font-family: sans-serif;''>' || chr(10) || '<h1>' || any_value(source) || '</h1>' || chr(10) || '<p><strong>ID:</strong> ' || doc_id || '</p>' || chr(10) || '<p><strong>Type:</strong> ' || any_value(lang) || '</p>' || chr(10) || string_agg(CASE i % 4 WHEN 0 THEN '<h2>' || {_E.format('l')} || '</h2>' WHEN 1 THEN '<blockquote>' || {_E.format('l')} || '</blockquote>' WHEN 2 THEN '<cite>' || {_E.format('l')} || '</cite>' ELSE '<p>' || {_E.format('l')} || '</p>' END, chr(10) ORDER BY i) || chr(10) || '<h3>Signatures</h3>' || chr(10) || '<p>' || any_value(source) || '</p>' || chr(10) || '</body></html>' AS html FROM ({_LINES}) GROUP BY doc_id""")
def render_html(spark, d):
    return _t(spark, d, "documents").select("doc_id", render.html(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), F.lit(None).cast("string"), _sections(), F.array("source")).alias("html"))


_X = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@_register(f"""SELECT doc_id, '<document><document_type>' || any_value(lang) || '</document_type><title>' || any_value(source) || '</title><document_id>' || doc_id || '</document_id><publication_date></publication_date><sections>' || string_agg('<section kind="' || CASE i % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'note' WHEN 2 THEN 'citation' ELSE 'paragraph' END || '">' || {_X.format('l')} || '</section>', '' ORDER BY i) || '</sections><signatures><signature>' || any_value(source) || '</signature></signatures><metadata><item key="confidence">0.5</item></metadata><amendments></amendments></document>' AS xml FROM ({_LINES}) GROUP BY doc_id""")
def render_xml_generic(spark, d):
    return _t(spark, d, "documents").select("doc_id", render.generic_xml(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), F.lit(None).cast("string"), _sections(), F.array("source"), F.create_map(F.lit("confidence"), F.lit("0.5"))).alias("xml"))


def _payloads(spark, d):
    body = F.concat(F.lit('{"documentType": "law", "title": "t'), F.col("doc_id").cast("string"), F.lit('", "sections": [], "n": '), F.col("n_chars").cast("string"), F.lit("}"))
    k = F.col("doc_id") % 6
    cut = F.concat(F.substring_index(body, ", \"n\"", 1), F.lit(","))
    nested = F.concat(F.lit('{"documentType": "law", "a": [{"b": '), F.col("doc_id").cast("string"))
    return _t(spark, d, "documents").select("doc_id", "n_chars", F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), body)).when(k == 3, cut).when(k == 4, nested).otherwise("no object").alias("raw"))


@_register("""SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN '{"documentType": "law"}' WHEN 5 THEN NULL WHEN 3 THEN '{"documentType": "law", "title": "t' || doc_id || '", "sections": []}' ELSE '{"documentType": "law", "title": "t' || doc_id || '", "sections": [], "n": ' || n_chars || '}' END AS payload FROM documents""")
def payload_repair(spark, d):
    return _payloads(spark, d).select("doc_id", payload.repair_json(F.col("raw")).alias("payload"))


@_register("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'law' ELSE 'act' END AS document_type, 'hint' || doc_id AS author, doc_id % 3 = 0 AS has_date FROM documents")
def field_aliases(spark, d):
    k = F.col("doc_id").cast("string")
    raw = F.concat(F.lit('{"kind": "x", "documentType": "'), F.when(F.col("doc_id") % 2 == 0, "law").otherwise("act"), F.lit('", "author": "hint'), k, F.lit('"'), F.when(F.col("doc_id") % 3 == 0, ', "date": "2026-01-08"').otherwise(""), F.lit("}"))
    m = _t(spark, d, "documents").select("doc_id", payload.normalise(raw).alias("m"))
    return m.select("doc_id", F.col("m.document_type"), F.col("m._author_hint").alias("author"), F.map_contains_key("m", "publication_date").alias("has_date"))


@_register("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' WHEN 2 THEN NULL ELSE 'hint' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'null' END AS publication_date, '[]' AS sections, '{\"confidence\": 0.5}' AS metadata FROM documents")
def fill_missing(spark, d):
    k = F.col("doc_id")
    raw = F.concat(F.lit('{"issuer": "hint"'), F.when(k % 4 == 0, ', "title": "T"').when(k % 4 == 2, ', "title": null').otherwise(""), F.when(k % 3 == 0, ', "publication_date": "null"').otherwise(""), F.lit("}"))
    f = _t(spark, d, "documents").select("doc_id", payload.filled(payload.normalise(raw)).alias("f"))
    return f.select("doc_id", "f.title", "f.publication_date", "f.sections", "f.metadata")


@_register("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'title,document_id,sections,metadata,amendments' ELSE 'document_type,document_id,sections,metadata,amendments' END AS missing FROM documents")
def required_keys(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(payload.missing_keys(F.when(F.col("doc_id") % 2 == 0, '{"document_type": null}').otherwise('{"title": "x"}')), ",").alias("missing"))


@_register("""SELECT conv_id, arg_min(role, turn) AS title, string_agg(coalesce(text, ''), '|' ORDER BY turn) AS sections, (SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT DISTINCT unnest(list(role)) AS r)) AS signatures, min(turn) FILTER (turn > 1)::VARCHAR AS publication_date, max(turn / 10) AS confidence FROM conversations GROUP BY conv_id""")
def chunk_merge(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("title"), F.array(F.coalesce("text", F.lit(""))).alias("sections"), F.array("role").alias("signatures"), F.when(F.col("turn") > 1, F.col("turn").cast("string")).otherwise("").alias("publication_date"), (F.col("turn") / 10).alias("confidence"))
    m = payload.merge_chunks(c, "conv_id", "turn")
    return m.select("conv_id", "title", F.array_join("sections", "|").alias("sections"), F.array_join("signatures", ",").alias("signatures"), "publication_date", "confidence")


@_register("SELECT doc_id, CASE WHEN quality = 0 THEN 'check ' || doc_id ELSE '' END || CASE WHEN toxic = 1 THEN CASE WHEN quality = 0 THEN '|' ELSE '' END || 'AI returned unparseable output – full manual review required.' ELSE '' END AS questions FROM labels")
def review_questions(spark, d):
    am = F.array(F.struct(F.col("quality").cast("double").alias("confidence"), F.concat(F.lit("check "), F.col("doc_id").cast("string")).alias("question")))
    return _t(spark, d, "labels").select("doc_id", F.array_join(payload.review_questions(am, F.when(F.col("toxic") == 1, "bad")), "|").alias("questions"))


@_register("SELECT doc_id, 'pending' AS status FROM labels WHERE quality = 0")
def review_pending(spark, d):
    items = _t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("pending").alias("status"), F.col("doc_id").alias("file_name"))
    return payload.pending(items).select("doc_id", "status")


_OLD = "substr(text, 5, 12)"


def _one(spark, d, op, conf=0.9):
    a = F.array(F.struct(F.lit(op).alias("operation"), F.expr("substr(text, 5, 12)").alias("old_text"), F.lit("NEW").alias("new_text"), F.lit(conf).alias("confidence")))
    r = _t(spark, d, "documents").select("doc_id", amend.apply_amendments(F.col("text"), a).alias("r"))
    return r.select("doc_id", F.col("r.text").alias("text"), F.col("r.changed").alias("changed"), F.array_join("r.notes", "|").alias("notes"))


#: a text of under 5 characters has no old text, and nothing of a null text is found
_FOUND = f"coalesce({_OLD}, '') <> ''"


@_register(f"SELECT doc_id, CASE WHEN {_FOUND} THEN substr(text, 1, instr(text, {_OLD}) - 1) || 'NEW' || substr(text, instr(text, {_OLD}) + length({_OLD})) ELSE coalesce(text, '') END AS text, {_FOUND} AS changed, CASE WHEN {_FOUND} THEN '' ELSE 'replace failed in amendment #1: old_text not found' END AS notes FROM documents")
def amend_replace(spark, d):
    return _one(spark, d, "replace")


@_register(f"SELECT doc_id, CASE WHEN {_FOUND} THEN substr(text, 1, instr(text, {_OLD}) - 1) || substr(text, instr(text, {_OLD}) + length({_OLD})) ELSE coalesce(text, '') END AS text, {_FOUND} AS changed, 'amendment #1 low confidence (0.50)' || CASE WHEN {_FOUND} THEN '' ELSE '|delete failed in amendment #1: old_text not found' END AS notes FROM documents")
def amend_delete(spark, d):
    return _one(spark, d, "DELETE", 0.5)


@_register(f"SELECT doc_id, CASE WHEN a = '' THEN text || chr(10) || chr(10) || 'NEW' ELSE substr(text, 1, instr(text, a) - 1) || a || chr(10) || 'NEW' || substr(text, instr(text, a) + length(a)) END AS text, true AS changed, '' AS notes FROM (SELECT doc_id, coalesce(text, '') AS text, trim(coalesce({_OLD}, ''), {_WS}) AS a FROM documents)")
def amend_insert(spark, d):
    return _one(spark, d, "insert")


@_register("SELECT doc_id, coalesce(text, '') AS text, false AS changed, 'unknown operation in amendment #1' AS notes FROM documents")
def amend_unknown(spark, d):
    return _one(spark, d, "repeal")


def _amendments(spark, d):
    kind = F.col("event_type")
    return _t(spark, d, "events").select(
        "user_id", "ts", "event_id", F.when(kind == "click", "replace").when(kind == "error", "delete").otherwise("insert").alias("operation"),
        F.when(kind.isin("click", "error"), F.concat(F.lit("e"), (F.col("event_id") % 10).cast("string"))).otherwise("").alias("old_text"),
        F.concat(F.lit("e"), (F.col("event_id") % 7).cast("string")).alias("new_text"), F.lit(0.9).alias("confidence"),
    )


_AM = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_type, CASE WHEN event_type IN ('click', 'error') THEN 'e' || (event_id % 10) ELSE '' END AS old, CASE event_type WHEN 'error' THEN '' ELSE 'e' || (event_id % 7) END AS new FROM events"


@_register(f"""WITH RECURSIVE am AS ({_AM}), fold(user_id, rn, txt, failed) AS (
  SELECT DISTINCT user_id, 0::BIGINT, '', 0 FROM am
  UNION ALL SELECT f.user_id, a.rn, CASE WHEN a.old = '' THEN f.txt || chr(10) || chr(10) || a.new WHEN instr(f.txt, a.old) > 0 THEN substr(f.txt, 1, instr(f.txt, a.old) - 1) || a.new || substr(f.txt, instr(f.txt, a.old) + length(a.old)) ELSE f.txt END,
    f.failed + CASE WHEN a.old <> '' AND instr(f.txt, a.old) = 0 THEN 1 ELSE 0 END
  FROM fold f JOIN am a ON a.user_id = f.user_id AND a.rn = f.rn + 1)
SELECT user_id, arg_max(txt, rn) AS text, arg_max(failed, rn)::BIGINT AS failed FROM fold GROUP BY user_id""")
def amend_fold(spark, d):
    r = amend.fold_laws(_amendments(spark, d), "user_id", ["ts", "event_id"])
    return r.select("user_id", "text", F.size("notes").cast("bigint").alias("failed"))


@_register("SELECT doc_id, CASE WHEN coalesce(lang, '') = coalesce(source, '') THEN '' ELSE '--- current' || chr(10) || '+++ updated' || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || ' a' || chr(10) || ' ' || doc_id || chr(10) || '-' || coalesce(lang, '') || '+' || coalesce(source, '') END AS diff FROM documents")
def unified_diff(spark, d):
    """Of two texts that differ in their last line, which no line end closes."""
    head = F.concat(F.lit("a\n"), F.col("doc_id").cast("string"), F.lit("\n"))
    end = lambda c: F.concat(head, F.coalesce(c, F.lit("")))
    return _t(spark, d, "documents").select("doc_id", amend.unified_diff(end("lang"), end("source")).alias("diff"))


_DAYS = "SELECT user_id, strftime(ts, '%Y-%m-%d') AS date_label, arg_max(props, (epoch_us(ts), event_id)) AS text FROM events GROUP BY ALL"


@_register(_DAYS)
def law_versions(spark, d):
    e = _t(spark, d, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd")).withColumn("seq", F.struct("ts", "event_id")).withColumn("old", F.lit(""))
    rows = amend.snapshot(e, "user_id", "seq", "old", "props", "date").where("kind = 'version'")
    return amend.latest(rows, ["user_id", "kind", "date_label"], "seq").select("user_id", "date_label", "text")


@_register("SELECT user_id, arg_max(props, (epoch_us(ts), event_id)) AS text FROM events GROUP BY user_id")
def law_current(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("law_slug"), F.lit("current").alias("kind"), F.struct("ts", "event_id").alias("seq"), F.col("props").alias("text"))
    return src.current_laws(e).select(F.col("law_slug").alias("user_id"), F.col("current_text").alias("text"))


@_register("""SELECT conv_id, turn, coalesce(c.text, '') || CASE WHEN b.text IS NULL THEN '' WHEN b.item_id % 2 = 0 THEN chr(10) || chr(10) || '![table](/' || b.item_id || ')' || chr(10) || chr(10)
  WHEN contains(coalesce(c.text, ''), substr(b.text, 1, 50)) THEN '' ELSE chr(10) || chr(10) || '[OCR TEXT]:' || chr(10) || b.text || chr(10) || chr(10) END AS page_md
FROM conversations c LEFT JOIN benchmark b ON b.item_id = c.conv_id % 60 AND c.turn = 1""")
def image_content_join(spark, d):
    p = _t(spark, d, "conversations").withColumn("xref", F.col("conv_id") % 60)
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("xref"), F.lit(1).cast("bigint").alias("turn"), "item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("![table](/"), F.col("item_id").cast("string"), F.lit(")"))).otherwise(F.col("text")).alias("content"))
    return pages.merge_images(p, b, ["xref", "turn"], "text", "content", "item_id").select("conv_id", "turn", "page_md")


@_register("SELECT doc_id::VARCHAR AS id, '/outputs/html/' || doc_id || '.html' AS html_url, CASE WHEN l.doc_id IS NOT NULL THEN '/outputs/xml/' || doc_id || '.xml' END AS xml_url FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def output_listing(spark, d):
    named = lambda t, ext: _t(spark, d, t).select(F.concat(F.lit("/data/out/"), F.col("doc_id").cast("string"), F.lit(ext)).alias("path"))
    return src.listing(named("documents", ".html"), named("labels", ".xml"))


def _hosts(spark, d):
    names = spark.createDataFrame([(n, i) for i, n in enumerate(["llava", "phi3:mini", "mistral:7b", "other"])], "name string, list_pos int")
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("host"), (F.col("s_acctbal") / 1000).alias("free_gb")).join(F.broadcast(names), F.expr("(host + list_pos) % 3 > 0"))  # four names


_HOSTS = "SELECT s_suppkey AS host, s_acctbal / 1000 AS free_gb, name, list_pos, pref, CASE WHEN pref IS NULL THEN 2 WHEN s_acctbal / 1000 >= need THEN 0 ELSE 1 END AS tier FROM supplier JOIN (VALUES ('llava', 0, NULL, NULL), ('phi3:mini', 1, 2, 3.0), ('mistral:7b', 2, 0, 9.0), ('other', 3, NULL, NULL)) m(name, list_pos, pref, need) ON (s_suppkey + list_pos) % 3 > 0"


@_register(f"SELECT host, name, row_number() OVER (PARTITION BY host ORDER BY tier, coalesce(pref, list_pos), list_pos) AS rank FROM ({_HOSTS})")
def model_candidates(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("sort_key")
    return models.candidates(_hosts(spark, d)).select("host", "name", F.row_number().over(w).cast("bigint").alias("rank"))


@_register(f"SELECT host, arg_min(name, (tier, coalesce(pref, list_pos), list_pos)) AS model, count(*) AS n_candidates, arg_min(name, (tier, coalesce(pref, list_pos), list_pos)) <> 'mistral:7b' AS downgraded FROM ({_HOSTS}) GROUP BY host")
def model_choice(spark, d):
    return models.choose(_hosts(spark, d)).select("host", "model", "n_candidates", "downgraded")


@_register("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'pure_text' WHEN 2 THEN 'chart' ELSE 'photo' END AS category FROM documents")
def image_category(spark, d):
    k = F.col("doc_id") % 4
    return _t(spark, d, "documents").select("doc_id", T.image_category(F.when(k == 0, "It is a TABLE.").when(k == 1, "pure_text, no table").when(k == 2, "Chart or photo").otherwise("unsure")).alias("category"))


@_register("SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'progress' END AS panel FROM events")
def event_route(spark, d):
    return ev.route(_t(spark, d, "events"), "event_type").select("event_id", "panel")


@_register("SELECT event_id, event_type AS stage, json_extract_string(props, '$.k') AS k FROM events")
def event_log(spark, d):
    extra = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    e = _t(spark, d, "events").select("event_id", ev.event_record(F.col("ts").cast("string"), F.col("event_type"), F.lit("m"), extra).alias("r"))
    return e.select("event_id", F.col("r.stage").alias("stage"), F.col("r.k").alias("k"))


@_register("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return ev.windowed(_t(spark, d, "events"))


@_register("SELECT item_id, text FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE contains(c.text, substr(b.text, 1, 50)))")
def dedup_prefix(spark, d):
    """Benchmark items whose first 50 characters (all of a shorter one) stand in no page."""
    return pages.unseen(_t(spark, d, "benchmark").select("item_id", "text"), _t(spark, d, "conversations").select(F.col("text").alias("page")), "text", "page")


@_register("""SELECT vec_id, best >= 9 AS two_columns, CASE WHEN best >= 9 THEN 2 * (40 + x) ELSE -1 END AS column_x FROM (
  SELECT vec_id, list_max(whites) AS best, list_position(whites, list_max(whites)) - 1 AS x FROM (
    SELECT vec_id, list_transform(range(20), lambda x: least(10, floor(abs(embedding[1 + x % len(embedding)]) * 40))::INT) AS whites FROM embeddings))""")
def column_detect(spark, d):
    """Pages of 100 x 10 pixels whose column 40 + x is white for as many rows as the vector's x-th value says."""
    e = F.col("embedding")
    whites = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: F.least(F.lit(10), F.floor(F.abs(F.get(e, x % F.size(e))) * 40).cast("int")))
    line = lambda y: F.concat(F.lit("00" * 40), F.array_join(F.transform(whites, lambda n: F.when(n > y, "FF").otherwise("00")), ""), F.lit("00" * 40))
    raster = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), line), ""))
    got = _t(spark, d, "embeddings").select("vec_id", F.lit(100).alias("width"), F.explode(F.array(raster)).alias("raster")).select("vec_id", src.column_divider("width", "raster").alias("c"))
    return got.select("vec_id", F.col("c.two_columns").alias("two_columns"), F.coalesce("c.column_x", F.lit(-1)).cast("bigint").alias("column_x"))


# --- cabinet acts, dispatch, review rows ---------------------------------------------------------


def _acts(spark, d):
    """A cabinet act per customer as JSON: subitems or a text, with or without signatures and contacts."""
    k = F.col("c_custkey")
    key = k.cast("string")
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = _t(spark, d, "customer").join(F.broadcast(nation), "c_nationkey")  # nations are a fixed list of 25
    act = F.concat(
        F.lit('{"document_type": "cabinet_act", "title": "t", "document_id": "ΦΕΚ Β\' '), key, F.lit("/"), key, F.lit('", "publication_date": "2026-01-08", "document_structure": "cabinet_act", "action_info": {"number": "'), key,
        F.lit('", "date": "2025-12-23", "title": "'), "n_name", F.lit('"}, "aitiologia": {"intro": "Έχοντας υπόψη:", "items": [{"number": 1, "intro": "i:", "subitems": [{"letter": "α", "text": "<a>"}]}, {"number": 2, "text": "'), "c_mktsegment",
        F.lit('"}]}, "decision": {"intro": "αποφασίζει:", "articles": [{"number": 1, "title": null, "text": "x"}]}'),
        F.when(k % 2 == 0, F.concat(F.lit(', "signatures": {"prothypourgos": "'), "c_name", F.lit('", "members": ["A", "B"]}'))).otherwise(', "signatures": {}'),
        F.when(k % 3 == 0, ', "contact_info": {"address": "", "phone": "210"}').otherwise(""), F.lit("}"),
    )
    return c.select("c_custkey", "n_name", "c_mktsegment", "c_name", act.alias("payload"))


@_register("""SELECT c_custkey, '<EfimeridaKyverniseos xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:noNamespaceSchemaLocation="fek.xsd"><Metadata><Titlos>Εφημερίδα της Κυβερνήσεως της Ελληνικής Δημοκρατίας</Titlos><Teychos>Β''</Teychos><ArithmosFyllou>' || c_custkey || '</ArithmosFyllou><Hmerominia>2026-01-08</Hmerominia></Metadata><Periexomena><Kefalaio titlos="ΠΡΑΞΕΙΣ ΥΠΟΥΡΓΙΚΟΥ ΣΥΜΒΟΥΛΙΟΥ"><Praxi arithmos="' || c_custkey || '" hmerominia="2025-12-23"><Titlos>' || n_name || '</Titlos><Organ>ΤΟ ΥΠΟΥΡΓΙΚΟ ΣΥΜΒΟΥΛΙΟ</Organ><AitiolologikoMeros><Eisagogi>Έχοντας υπόψη:</Eisagogi><Stoicheio arithmos="1"><Eisagogi>i:</Eisagogi><Lista><Peripton grammato="α">&lt;a&gt;</Peripton></Lista></Stoicheio><Stoicheio arithmos="2">' || c_mktsegment || '</Stoicheio></AitiolologikoMeros><ApoфasistikоMeros><Eisagogi>αποφασίζει:</Eisagogi><Arthro arithmos="1"><Keimeno>x</Keimeno></Arthro></ApoфasistikоMeros>' || CASE WHEN c_custkey % 2 = 0 THEN '<Ypografes><Prothypourgos><Onoma>' || c_name || '</Onoma></Prothypourgos><MeliYpourgikoySymbouliou><Melos>A</Melos><Melos>B</Melos></MeliYpourgikoySymbouliou></Ypografes>' ELSE '' END || '</Praxi></Kefalaio></Periexomena>' || CASE WHEN c_custkey % 3 = 0 THEN '<Epikoinonia><Tilefono>210</Tilefono></Epikoinonia>' ELSE '' END || '</EfimeridaKyverniseos>' AS xml FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def cabinet_xml(spark, d):
    return _acts(spark, d).select("c_custkey", F.from_json("payload", render.CABINET).alias("p")).select("c_custkey", render.cabinet_xml(F.col("p")).alias("xml"))


@_register("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'cabinet' WHEN 1 THEN 'raw' ELSE 'generic' END AS built, CASE c_custkey % 3 WHEN 2 THEN '<document' ELSE '<EfimeridaKyverniseos' END AS starts FROM customer JOIN nation ON n_nationkey = c_nationkey")
def xml_dispatch(spark, d):
    k = F.col("c_custkey") % 3
    p = F.from_json(F.when(k == 0, F.col("payload")).otherwise('{"document_structure": "cabinet_act", "action_info": {}}'), render.CABINET)
    raw = F.when(k == 1, "ΕΦΗΜΕΡΙΔΑ ΤΗΣ ΚΥΒΕΡΝΗΣΕΩΣ Πράξη 1 της 02-01-2026 Τ ΤΟ ΥΠΟΥΡΓΙΚΟ ΣΥΜΒΟΥΛΙΟ").otherwise("raw")
    none = F.array().cast("array<struct<kind:string,text:string>>")
    lit = F.lit("law")
    made = _acts(spark, d).withColumn("p", p).withColumn("raw", raw)
    gazette = render.gate(lit, F.lit("t"), F.col("raw"), none)
    old = render.act_xml(render.act(F.col("raw")), F.lit("t"), lit, F.lit(False))
    generic = render.generic_xml(F.lit("t"), F.lit("1"), lit, F.lit(None).cast("string"), none, F.array().cast("array<string>"), F.create_map().cast("map<string,string>"))
    xml = made.select("c_custkey", render.to_xml(F.col("p"), gazette, old, generic).alias("x"))
    built = F.when(F.col("x").contains("xsi:"), "cabinet").when(F.col("x").startswith("<document"), "generic").otherwise("raw")
    return xml.select("c_custkey", built.alias("built"), F.regexp_extract("x", "^<[A-Za-z]+", 0).alias("starts"))


@_register("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Γ''' WHEN 1 THEN 'Α''' ELSE 'Δ''' END AS issue, CASE WHEN s_suppkey % 3 = 0 THEN '1' ELSE s_suppkey::VARCHAR END AS number FROM supplier")
def document_number(spark, d):
    k = F.col("s_suppkey")
    made = F.concat(F.when(k % 4 == 0, "ΦΕΚ Γ' ").when(k % 4 == 1, "ΦΕΚ ").otherwise("Δ'"), F.when(k % 3 == 0, "7/12a").otherwise(F.concat(F.lit("1/"), k.cast("string"))))
    return _t(spark, d, "supplier").select("s_suppkey", render.document_number(made).alias("n")).select("s_suppkey", "n.*")


@_register("SELECT doc_id, '<h2>Amendments (Diff View)</h2>' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '<h3>Change to l' || doc_id || '</h3>' || chr(10) || '<div class=''fek-diff''>' || chr(10) || '<div class=''diff-removed''>-&lt;a&gt;</div>' || chr(10) || '<div class=''diff-added''>+b</div>' || chr(10) || '<div class=''''> c</div>' || chr(10) || '</div>' ELSE '' END AS part FROM documents")
def html_amendments(spark, d):
    am = F.array(F.struct(F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("target_law_id"), F.when(F.col("doc_id") % 2 == 0, "-<a>\n+b\n c\n").alias("diff")))
    none = F.lit(None).cast("string")
    page = render.html(none, none, none, none, F.array().cast("array<struct<kind:string,text:string>>"), F.array().cast("array<string>"), am)
    return _t(spark, d, "documents").select("doc_id", F.replace(F.substring_index(page, "<p><strong>Type:</strong> unknown</p>\n", -1), F.lit("\n</body></html>"), F.lit("")).alias("part"))


@_register("SELECT doc_id, '<amendments><amendment><target_law_id>l&amp;' || doc_id || '</target_law_id><operation>' || coalesce(lang, '') || '</operation><old_text></old_text></amendment></amendments>' AS part FROM documents")
def xml_amendments(spark, d):
    none = F.lit(None).cast("string")
    am = F.array(F.create_map(F.lit("target_law_id"), F.concat(F.lit("l&"), F.col("doc_id").cast("string")), F.lit("operation"), F.col("lang"), F.lit("old_text"), none))
    x = render.generic_xml(none, none, none, none, F.array().cast("array<struct<kind:string,text:string>>"), F.array().cast("array<string>"), F.create_map().cast("map<string,string>"), am)
    return _t(spark, d, "documents").select("doc_id", F.replace(F.concat(F.lit("<amendments>"), F.substring_index(x, "<amendments>", -1)), F.lit("</document>"), F.lit("")).alias("part"))


@_register("SELECT doc_id, CASE WHEN quality = 1 THEN 'id' || doc_id ELSE 'T' END AS heading, 'a, b' || doc_id AS questions FROM labels")
def queue_rows(spark, d):
    k = F.col("doc_id").cast("string")
    row = render.queue_row(F.when(F.col("quality") == 1, "").otherwise("T"), F.concat(F.lit("id"), k), F.array(F.lit("a"), F.concat(F.lit("b"), k)))
    return _t(spark, d, "labels").select("doc_id", row.alias("r")).select("doc_id", "r.*")


# --- payloads, flow -------------------------------------------------------------------------------


@_register("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'No JSON object found in LLM output' WHEN 2 THEN NULL ELSE 'LLM returned non-JSON output' END AS error, CASE doc_id % 4 WHEN 0 THEN 'heading,paragraph,citation' WHEN 2 THEN 'odd' END AS kinds FROM documents""")
def payload_extract(spark, d):
    """Replies with aliased section kinds, without an object, truncated behind a string, and beyond repair."""
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, '```JSON\n{"sections": [{"kind": "title"}, {"text": "x"}, {"kind": "ref"}]}\n```').when(k == 1, "nothing here").when(k == 2, '{"sections": [{"kind": "odd"}], "date": "2026').otherwise('{"s": [{"a": 1}, {"b": "x, y')
    x = _t(spark, d, "documents").select("doc_id", payload.extract(raw).alias("x"))
    kinds = F.array_join(F.transform(F.from_json(F.get_json_object("x.payload", "$.sections"), "array<struct<kind:string>>"), lambda s: s["kind"]), ",")
    return x.select("doc_id", F.substring_index("x.error", ":", 1).alias("error"), kinds.alias("kinds"))


def _provider(prompt: str) -> str:
    """Answers a chunk by its first digit: whole, only on the second prompt, or never."""
    import json

    body = prompt.split("\n", 1)[1]
    number = next((int(c) for c in body if c.isdigit()), 0)
    if number == 1 or (number == 2 and prompt.startswith("Structure")):
        return "no object"
    return json.dumps({"documentType": "law", "title": f"t{len(body) > 4000}", "sections": [{"kind": "body", "text": "x"}], "author": "h", "amendments": [{"target_law_id": "l", "confidence": 0.5, "question_for_human": "ok?"}]})


@_register("""SELECT conv_id, CASE conv_id % 3 WHEN 1 THEN 'PARSE ERROR – manual review required' ELSE 'tfalse' END AS title, CASE conv_id % 3 WHEN 1 THEN 'unknown' ELSE 'law' END AS document_type, CASE conv_id % 3 WHEN 1 THEN 'parse-error' ELSE 'unknown' END AS document_id, CASE conv_id % 3 WHEN 1 THEN 'note:[chunk 1] No JSON object found in LLM output' ELSE 'paragraph:x' END AS sections,
  CASE conv_id % 3 WHEN 1 THEN 'AI returned unparseable output – full manual review required.' ELSE 'ok?' END AS questions, CASE conv_id % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '0.0' ELSE '0.5' END AS confidence, conv_id % 3 = 2 AS retried, 'llm|unknown|1' AS stamp, true AS needs_review FROM (SELECT DISTINCT conv_id FROM conversations)""")
def structure_flow(spark, d):
    docs = _t(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.concat((F.col("conv_id") % 3).cast("string"), F.lit(" text")).alias("raw_text"))
    r = flow.structure(docs, _provider, outputs.saved, F.current_timestamp(), "conv_id")
    m = F.col("metadata")
    stamp = F.concat_ws("|", m["ai_mode"], m["model"], m["chunks_processed"])
    sections = F.array_join(F.transform("sections", lambda s: F.concat(s["kind"], F.lit(":"), s["text"])), ",")
    return r.select("conv_id", F.when(F.col("title").startswith("t"), F.lower("title")).otherwise(F.col("title")).alias("title"), "document_type", "document_id", sections.alias("sections"), F.array_join("questions", "|").alias("questions"), m["confidence"].alias("confidence"), F.coalesce(m["retried"] == "true", F.lit(False)).alias("retried"), stamp.alias("stamp"), "needs_review")


@_register("SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) AS n, string_agg('n' || event_id, '|' ORDER BY ts, event_id) FILTER (event_type <> 'click') AS notes FROM events GROUP BY user_id HAVING n > 0")
def amendment_targets(spark, d):
    """Amendments without a target are left out; the notes of the others come in their order."""
    e = _t(spark, d, "events")
    am = F.array(F.create_map(F.lit("target_law_id"), F.when(F.col("event_type") == "click", "").otherwise("law")))
    rows = flow.amendments_of(e.select("event_id", "ts", "user_id", F.lit("").alias("publication_date"), am.alias("amendments")), "event_id", "ts").join(e.select("event_id", "user_id"), "event_id")
    notes = flow.notes_of(rows.withColumn("notes", F.array(F.concat(F.lit("n"), F.col("event_id").cast("string")))), "user_id", ["ts", "event_id", "pos"])
    return notes.select("user_id", F.size("notes").cast("bigint").alias("n"), F.array_join("notes", "|").alias("notes"))


@_register("SELECT doc_id::VARCHAR AS document_id, 'x/' || doc_id || '.xml' AS xml, '/outputs/html/' || doc_id || '.html' AS html_url, quality = 0 OR toxic = 1 AS needs_review FROM labels")
def result_rows(spark, d):
    rows = _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("t").alias("title"), (F.col("quality") == 0).alias("needs_review"), F.when(F.col("toxic") == 1, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")).alias("notes"))
    return flow.result(rows, "x", "h").select("document_id", "xml", "html_url", "needs_review")


# --- sinks, read back ------------------------------------------------------------------------------


@_register("SELECT source AS name, arg_max(coalesce(text, ''), doc_id) AS text FROM documents GROUP BY source")
def sink_texts(spark, d):
    """Documents written under their source's name: of one name the last stays."""
    at = outputs.scratch(spark)
    outputs.write_texts(_t(spark, d, "documents"), at, T.slugify(F.col("source")), "text", "doc_id")
    return outputs.read_texts(spark, at)


@_register("SELECT user_id, kind, CASE WHEN kind = 'current' THEN '' ELSE date_label END AS date_label, arg_max(text, (epoch_us(ts), event_id)) AS text FROM (SELECT user_id, ts, event_id, strftime(ts, '%Y-%m-%d') AS date_label, unnest(['version', 'current', 'previous', 'diff']) AS kind, unnest([props, props, CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN event_id % 3 = 0 THEN 'd' || event_id END]) AS text FROM events) WHERE text IS NOT NULL GROUP BY ALL")
def sink_versions(spark, d):
    """All kinds of versions, written and read: the last under each law, kind and date."""
    e = _t(spark, d, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd")).withColumn("seq", F.struct("ts", "event_id")).withColumn("old", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("")).withColumn("diff", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("d"), F.col("event_id").cast("string"))))
    at = outputs.scratch(spark)
    outputs.write_versions(amend.snapshot(e, "user_id", "seq", "old", "props", "date", "diff"), at)
    return amend.latest(spark.read.parquet(at), ["user_id", "kind", "date_label"], "seq").select("user_id", "kind", "date_label", "text")


@_register("SELECT doc_id::VARCHAR AS document_id, 'q' || CASE WHEN toxic = 1 THEN '|n' ELSE '' END AS questions, true AS named, substr(coalesce(text, ''), 1, 3000) AS raw_excerpt FROM labels JOIN documents USING (doc_id) WHERE (quality = 0 OR toxic = 1) AND doc_id % 5 <> 0")
def review_queue(spark, d):
    """Rows queued as JSON and read back: those that are still pending, with the files they came from."""
    from datetime import datetime

    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("t").alias("title"), F.when(F.col("doc_id") % 5 == 0, "done").alias("status"), (F.col("quality") == 0).alias("needs_review"),
        F.array(F.lit("q")).alias("questions"), F.when(F.col("toxic") == 1, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")).alias("notes"), F.coalesce("text", F.lit("")).alias("raw_text"),
    )
    at = outputs.scratch(spark)
    items = payload.review_items(rows, F.lit(datetime(2026, 1, 8)).cast("timestamp"))
    # one folder for all, as a file per row is for queues that people read
    outputs.enqueue(items.withColumn("name", F.col("file_name")).withColumn("file_name", F.lit("all")), at)
    got = outputs.queued(spark, at, "status string, created_at string, document_id string, title string, questions array<string>, raw_excerpt string, name string")
    named = (F.col("name") == F.concat(F.lit("20260108T000000Z_"), "document_id", F.lit(".json"))) & F.col("_file").contains("file_name=all")
    return got.select("document_id", F.array_join("questions", "|").alias("questions"), named.alias("named"), "raw_excerpt")


# --- pages, images, models, events ------------------------------------------------------------------


@_register(f"SELECT doc_id, has_text_layer, NOT has_text_layer AS is_scanned, has_text_layer AND doc_id % 3 > 0 AS is_mixed, doc_id % 3 AS n_regions, quality AS confidence_hint, CASE WHEN NOT has_text_layer THEN 'tesseract_pending' ELSE 'pymupdf' END AS method, CASE WHEN has_text_layer THEN CASE WHEN doc_id % 2 = 0 THEN 'L' || chr(10) || chr(10) || '--- ΣΤΗΛΗ 2 ---' || chr(10) || chr(10) || 'R' ELSE 'top ' || doc_id || chr(10) || 'low' END END AS page_text FROM ({_CLASSES})")
def page_detect(spark, d):
    """Detection, then the text layer: two columns where the divider is not 0, blocks' lines by height elsewhere."""
    k = F.col("doc_id")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    span = lambda *t: F.array(*(F.struct(x.alias("text")) for x in t))
    line = lambda y, *t: F.struct(F.lit(y).alias("y"), span(*t).alias("spans"))
    block = lambda t, *x: F.struct(F.lit(t).alias("type"), F.array(*x).alias("lines"))
    blocks = F.array(block(0, line(9.0, F.lit("low"))), block(1, line(0.0, F.lit("image"))), block(0, line(1.0, F.lit("top "), k.cast("string"))))
    placed = F.array(F.slice(F.array(box, box), 1, (k % 3).cast("int")))
    raster = F.when(k % 2 == 0, F.unhex(F.lit(("00" * 41 + "FF" + "00" * 58) * 3))).otherwise(F.unhex(F.lit("00" * 300)))
    seen = pages.detect(_junk(spark, d).withColumn("placements", placed).withColumn("w", F.lit(100)).withColumn("px", raster), "text", "placements", ("w", "px"))
    got = pages.text_layer(seen.withColumn("blocks", blocks).withColumn("left_text", F.lit(" L ")).withColumn("right_text", F.lit("R")))
    return got.select("doc_id", "has_text_layer", "is_scanned", "is_mixed", F.size("image_regions").cast("bigint").alias("n_regions"), "confidence_hint", "method", "page_text")


@_register(f"SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '' WHEN 0 THEN 'L' || chr(10) || chr(10) || '--- ΣΤΗΛΗ 2 ---' || chr(10) || chr(10) || 'R' ELSE 'page' END AS page_text, doc_id % 4 = 1 AS failed FROM ({_CLASSES}) WHERE NOT has_text_layer OR doc_id % 3 > 0")
def page_recognise(spark, d):
    """Only scanned and mixed pages are read; a failing one is empty."""
    k = F.col("doc_id")
    cls = pages.classify(_junk(spark, d).withColumn("n_images", k % 3)).withColumn("has_two_columns", k % 4 == 0).withColumn("column_x", F.when(k % 4 == 0, 94))
    half = lambda t: F.lit(t).cast("binary")
    ready = cls.withColumn("image", F.when(k % 4 == 1, half("bad")).otherwise(half(" page"))).withColumn("left_image", half("L")).withColumn("right_image", half("R "))

    def ocr(raw: bytes, columns: bool) -> str:
        if raw == b"bad":
            raise ValueError("unreadable")
        return bytes(raw).decode()

    got = pages.recognise(ready, ocr).select("doc_id", "page_text", "failure")
    return pages.with_info(got, cls.select("doc_id", "char_count"), ["doc_id"]).select("doc_id", "page_text", F.col("failure").isNotNull().alias("failed"))


@_register("SELECT conv_id, arg_max(CASE WHEN role = 'user' THEN text ELSE '![table](/' || turn || '.png)' END, turn) AS content FROM conversations GROUP BY conv_id")
def image_content(spark, d):
    """An image listed several times counts as it was listed last."""
    i = _t(spark, d, "conversations").withColumn("category", F.when(F.col("role") == "user", "pure_text").otherwise("table")).withColumn("path", F.concat(F.col("turn").cast("string"), F.lit(".png")))
    return pages.image_content(i, ["conv_id"], "category", "text", "path", "turn")


@_register("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 2 END AS n_images, page_id % 3 = 0 AS failed, CASE WHEN page_id % 3 > 0 THEN 'chart,photo' ELSE '' END AS categories FROM pages")
def image_extract(spark, d):
    """Images per file; a file that can't be read is a row with its error."""
    f = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 3 == 0, F.lit("bad")).otherwise("ok").cast("binary").alias("content"))

    def images(raw: bytes):
        if bytes(raw) == b"bad":
            raise ValueError("broken")
        return [(1, 5, "png", b"chart"), (2, 6, "png", b"who knows")]

    got = src.categories(src.images(f, images), lambda x: bytes(x).decode())
    return got.groupBy(F.col("path").cast("bigint").alias("page_id")).agg(F.count("xref").alias("n_images"), F.bool_or(F.col("error").isNotNull()).alias("failed"), F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("xref").isNotNull(), F.col("category"))))).alias("categories"))


@_register(f"SELECT host, name, profile, row_number() OVER (PARTITION BY host ORDER BY tier, coalesce(pref, list_pos), list_pos, k) AS attempt, ctx AS num_ctx FROM ({_HOSTS}), (VALUES ('default', 0, 4096), ('cpu_safe', 1, 2048)) p(profile, k, ctx)")
def model_attempts(spark, d):
    return models.attempts(_hosts(spark, d)).select("host", "name", "profile", F.col("attempt").cast("bigint").alias("attempt"), F.col("num_ctx").cast("bigint").alias("num_ctx"))


@_register("SELECT s_suppkey AS host, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'other' END AS model, true AS downgraded, s_acctbal / 1000 < 2.5 AS pause FROM supplier")
def model_none(spark, d):
    """Hosts without a model still decide: for none."""
    h = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("host"), (F.col("s_acctbal") / 1000).alias("free_gb"))
    some = h.where("host % 3 <> 0").withColumn("name", F.explode(F.array(F.lit("other"), F.lit(""), F.lit("other")))).withColumn("list_pos", F.lit(0))
    got = models.choose(some, hosts=h).join(h, "host")
    return got.select("host", "model", "downgraded", models.should_pause(F.col("free_gb")).alias("pause"))


@_register("SELECT event_id, 'log' AS stage, upper(event_type) AS level, 'ai' AS source FROM events")
def event_levels(spark, d):
    e = _t(spark, d, "events").select("event_id", ev.log_record(F.col("ts").cast("string"), F.col("event_type"), F.lit("ai"), F.lit("m")).alias("r"))
    return e.select("event_id", F.col("r.stage").alias("stage"), F.col("r.level").alias("level"), F.col("r.source").alias("source"))


@_register("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS done, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations")
def event_progress(spark, d):
    return ev.progress(_t(spark, d, "conversations"), "conv_id", "turn", "ocr").select("conv_id", "turn", "done", "total")


@_register("SELECT event_type AS stage, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY ALL")
def event_parse(spark, d):
    """Events as JSON lines; what is no object is dropped."""
    line = F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("stage"), F.lit("m").alias("message"), F.col("value"))))
    return ev.parsed(_t(spark, d, "events").select(line.alias("value"))).where("map_contains_key(extra, 'value') or message = 'm'").groupBy("stage").agg(F.count("*").alias("n"))


@_register("SELECT url AS name, 'error' AS stage, 'Skipped non-PDF: ' || url AS message FROM pages WHERE page_id % 3 > 0")
def upload_errors(spark, d):
    n = _t(spark, d, "pages").withColumn("name", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".PdF"))).otherwise(F.col("url")))
    refused = src.uploads(n)[1]
    return src.upload_errors(refused).select(F.regexp_replace("message", "^Skipped non-PDF: ", "").alias("name"), "stage", "message")
