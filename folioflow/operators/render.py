"""Documents to HTML and XML strings, and the rule-based gazette parser, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text as T

#: fixed values: title of the gazette, its chapter and its organ
GAZETTE, CHAPTER, ORGAN = "Εφημερίδα της Κυβερνήσεως της Ελληνικής Δημοκρατίας", "ΠΡΑΞΕΙΣ ΥΠΟΥΡΓΙΚΟΥ ΣΥΜΒΟΥΛΙΟΥ", "ΤΟ ΥΠΟΥΡΓΙΚΟ ΣΥΜΒΟΥΛΙΟ"
PUBLISH = "Η παρούσα Πράξη να δημοσιευθεί"
#: fixed value: the style line of every page
_STYLE = "<style>.diff-added { color: #00703c; background-color: #d7f1e6; } .diff-removed { color: #d4351c; background-color: #f9d6d2; } .fek-diff { font-family: monospace; white-space: pre-wrap; background-color: #f3f2f1; padding: 10px; border: 1px solid #b1b4b6; }</style>"


def once(value: Column, made) -> Column:
    """made(value) with value computed once per row, however often ``made`` reads it: a variable of a higher-order
    function, which the optimizer doesn't copy into every use."""
    return F.transform(F.array(value), made)[0]


def _text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tag(name: str, *inner: Column, **attributes: Column) -> Column:
    attrs = [F.concat(F.lit(f' {k}="'), T.escape_markup(F.coalesce(v, F.lit(""))), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *attrs, F.lit(">"), *inner, F.lit(f"</{name}>"))


def maybe(value: Column, made: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", made).otherwise(F.lit(""))


def html(title: Column, doc_id: Column, kind: Column, date: Column, sections: Column, signatures: Column, amendments: Column | None = None) -> Column:
    """sections: array<struct<kind, text>>; signatures: array<string>; amendments:
    array<struct<target_law_id, diff>>, shown where there are any. Null ids are empty, null kinds unknown."""
    e = T.escape_markup

    def section(s: Column) -> Column:
        t = e(F.coalesce(s["text"], F.lit("")))
        wrap = lambda n: F.concat(F.lit(f"<{n}>"), t, F.lit(f"</{n}>"))
        return F.when(s["kind"] == "heading", wrap("h2")).when(s["kind"] == "note", wrap("blockquote")).when(s["kind"] == "citation", wrap("cite")).otherwise(wrap("p"))

    head = [F.lit("<!doctype html>"), F.lit("<html><head><meta charset='utf-8'>"), F.lit(_STYLE), F.lit("</head><body style='font-family: sans-serif;'>")]
    head += [F.concat(F.lit("<h1>"), e(F.coalesce(title, F.lit("Untitled"))), F.lit("</h1>")), F.concat(F.lit("<p><strong>ID:</strong> "), e(F.coalesce(doc_id, F.lit(""))), F.lit("</p>")), F.concat(F.lit("<p><strong>Type:</strong> "), e(F.coalesce(kind, F.lit("unknown"))), F.lit("</p>"))]
    none = F.array().cast("array<string>")
    dated = F.when(F.coalesce(date, F.lit("")) != "", F.array(F.concat(F.lit("<p><strong>Date:</strong> "), e(date), F.lit("</p>")))).otherwise(none)
    signed = F.when(F.size(signatures) > 0, F.concat(F.array(F.lit("<h3>Signatures</h3>")), F.transform(signatures, lambda s: F.concat(F.lit("<p>"), e(s), F.lit("</p>"))))).otherwise(none)
    changes = none
    if amendments is not None:
        with_diff = F.filter(amendments, lambda a: F.coalesce(a["diff"], F.lit("")) != "")
        shown = F.transform(with_diff, lambda a: diff_html(F.coalesce(a["target_law_id"], F.lit("None")), a["diff"]))
        changes = F.when(F.size(amendments) > 0, F.concat(F.array(F.lit("<h2>Amendments (Diff View)</h2>")), shown)).otherwise(none)
    return F.array_join(F.concat(F.array(*head), dated, F.transform(sections, section), signed, changes, F.array(F.lit("</body></html>"))), "\n")


def diff_html(target: Column, diff: Column) -> Column:
    """The diff view of one amendment: a line per line, with its class."""
    lines = F.split(diff, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    cls = lambda x: F.when(x.startswith("+"), "diff-added").when(x.startswith("-"), "diff-removed").otherwise("")
    shown = F.transform(lines, lambda x: F.concat(F.lit("<div class='"), cls(x), F.lit("'>"), T.escape_markup(x), F.lit("</div>")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("<h3>Change to "), target, F.lit("</h3>")), F.lit("<div class='fek-diff'>")), shown, F.array(F.lit("</div>"))), "\n")


def generic_xml(title: Column, doc_id: Column, kind: Column, date: Column, sections: Column, signatures: Column, metadata: Column, amendments: Column | None = None) -> Column:
    """metadata: map<string, string>, shown in order of keys; amendments: array<map<string, string>>, whose
    keys name the children, in the map's order."""
    items = F.array_sort(F.map_entries(metadata))

    def child(x: Column) -> Column:
        return F.concat(F.lit("<"), x["key"], F.lit(">"), _text(x["value"]), F.lit("</"), x["key"], F.lit(">"))

    changes = [] if amendments is None else [F.array_join(F.transform(amendments, lambda a: tag("amendment", F.array_join(F.transform(F.map_entries(a), child), ""))), "")]
    return tag(
        "document",
        *(tag(n, _text(c)) for n, c in (("document_type", kind), ("title", title), ("document_id", doc_id), ("publication_date", date))),
        tag("sections", F.array_join(F.transform(sections, lambda s: tag("section", _text(s["text"]), kind=F.coalesce(s["kind"], F.lit("paragraph")))), "")),
        tag("signatures", F.array_join(F.transform(signatures, lambda s: tag("signature", _text(s))), "")),
        tag("metadata", F.array_join(F.transform(items, lambda x: tag("item", _text(x["value"]), key=x["key"])), "")),
        tag("amendments", *changes),
    )


#: fixed values: where a cabinet act's schema is, and its default issue and number
SCHEMA, ISSUE, NUMBER = ' xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:noNamespaceSchemaLocation="fek.xsd"', "Α'", "1"
#: fixed values: the decision's element mixes alphabets, and the members' one differs from the raw-text builder's
DECISION_TAG, MEMBERS_TAG = "ApoфasistikоMeros", "MeliYpourgikoySymbouliou"


def document_number(doc_id: Column) -> Column:
    """struct<issue, number> of a document's id such as "ΦΕΚ Α' 1/2026": its series letter, and the digits
    behind its last slash."""
    found = lambda p, g, d: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(doc_id, F.lit("")), p, g), F.lit("")), F.lit(d))
    return F.struct(found("[ΑΒΓΔ]'", 0, ISSUE).alias("issue"), found(r"/(\d+)$", 1, NUMBER).alias("number"))


#: the payload of a cabinet act, as ``from_json`` reads it
CABINET = """document_type string, title string, document_id string, publication_date string, document_structure string, organ string,
action_info struct<number:string,date:string,title:string>,
aitiologia struct<intro:string,items:array<struct<number:string,intro:string,text:string,subitems:array<struct<letter:string,text:string>>>>>,
decision struct<intro:string,articles:array<struct<number:string,title:string,text:string>>,publication_instruction:string>,
signatures struct<prothypourgos:string,members:array<string>>, contact_info struct<address:string,phone:string,url:string>"""


def _filled(struct: Column, *names: str) -> Column:
    """Whether a struct has any field; an empty object is none."""
    some = F.lit(False)
    for n in names:
        some = some | struct[n].isNotNull()
    return F.coalesce(some, F.lit(False))


def cabinet_xml(p: Column) -> Column:
    """XML of a cabinet act's nested payload (struct ``CABINET``). Parts that are absent or empty leave no
    element; the organ has a default only if it is absent."""
    none = F.lit("")
    has = lambda c: F.coalesce(c, none) != ""
    joined = lambda c, made: F.coalesce(F.array_join(F.transform(c, made), ""), none)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    attr = lambda n, v: F.when(has(v), F.concat(F.lit(f' {n}="'), T.escape_markup(v), F.lit('"'))).otherwise(none)
    element = lambda n, attrs, inner: F.concat(F.lit(f"<{n}"), attrs, F.lit(">"), inner, F.lit(f"</{n}>"))
    act_, why, what, who, where = (p[k] for k in ("action_info", "aitiologia", "decision", "signatures", "contact_info"))
    number = document_number(p["document_id"])

    def item(x: Column) -> Column:
        listed = tag("Lista", joined(x["subitems"], lambda y: tag("Peripton", _text(y["text"]), grammato=y["letter"])))
        text = F.when(~some(x["subitems"]), _text(x["text"])).otherwise(none)
        return tag("Stoicheio", text, maybe(x["intro"], tag("Eisagogi", _text(x["intro"]))), F.when(some(x["subitems"]), listed).otherwise(none), arithmos=x["number"])

    def article(x: Column) -> Column:
        return element("Arthro", attr("arithmos", x["number"]), F.concat(maybe(x["title"], tag("Titlos", _text(x["title"]))), maybe(x["text"], tag("Keimeno", _text(x["text"])))))

    reasons = F.when(_filled(why, "intro", "items"), tag("AitiolologikoMeros", maybe(why["intro"], tag("Eisagogi", _text(why["intro"]))), joined(why["items"], item))).otherwise(none)
    published = maybe(what["publication_instruction"], tag("DiataghDimosiefseos", _text(what["publication_instruction"])))
    decided = F.when(_filled(what, "intro", "articles", "publication_instruction"), tag(DECISION_TAG, maybe(what["intro"], tag("Eisagogi", _text(what["intro"]))), joined(what["articles"], article), published)).otherwise(none)
    members = F.when(some(who["members"]), tag(MEMBERS_TAG, joined(who["members"], lambda m: tag("Melos", _text(m))))).otherwise(none)
    signed = F.when(_filled(who, "prothypourgos", "members"), tag("Ypografes", maybe(who["prothypourgos"], tag("Prothypourgos", tag("Onoma", _text(who["prothypourgos"])))), members)).otherwise(none)
    titled = tag("Titlos", _text(F.when(has(act_["title"]), act_["title"]).otherwise(p["title"])))
    praxi = element("Praxi", F.concat(attr("arithmos", act_["number"]), attr("hmerominia", act_["date"])), F.concat(titled, tag("Organ", _text(F.coalesce(p["organ"], F.lit(ORGAN)))), reasons, decided, signed))
    reached = F.concat(*(maybe(where[k], tag(n, _text(where[k]))) for k, n in (("address", "Dieuthinsi"), ("phone", "Tilefono"), ("url", "HlektronikaDieuthinsi"))))
    return element(
        "EfimeridaKyverniseos",
        F.lit(SCHEMA),
        F.concat(
            tag("Metadata", tag("Titlos", F.lit(GAZETTE)), tag("Teychos", _text(number["issue"])), tag("ArithmosFyllou", _text(number["number"])), tag("Hmerominia", _text(p["publication_date"]))),
            tag("Periexomena", tag("Kefalaio", praxi, titlos=F.lit(CHAPTER))),
            maybe(reached, tag("Epikoinonia", reached)),
        ),
    )


def is_cabinet(p: Column) -> Column:
    """Whether a payload (struct ``CABINET``) names its structure and says which act it is."""
    return (F.coalesce(p["document_structure"], F.lit("")) == "cabinet_act") & _filled(p["action_info"], "number", "date", "title")


def to_xml(cabinet: Column, gazette: Column, from_raw: Column, generic: Column) -> Column:
    """The first that applies: the cabinet builder (null where the payload is none), the builder from raw
    text where ``gazette`` holds, the generic one."""
    return F.coalesce(F.when(is_cabinet(cabinet), cabinet_xml(cabinet)), F.when(gazette, from_raw), generic)


def queue_row(title: Column, doc_id: Column, questions: Column) -> Column:
    """How a review row is shown: the title, or the id, and the questions in one line."""
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), doc_id).alias("heading"), F.array_join(questions, ", ").alias("questions"))


def act(raw: Column) -> Column:
    """struct of the gazette's header, act, reasoning and decision, from its raw text alone."""
    return once(T.normalize_ws(raw), _act)


def _act(t: Column) -> Column:
    none = F.lit("")
    p = r"(?iusU)Πράξη\s+(\d+)\s+της\s+(\d{2}-\d{2}-\d{4})\s*(.*?)\s+ΤΟ\s+ΥΠΟΥΡΓΙΚΟ\s+ΣΥΜΒΟΥΛΙΟ"
    got = lambda g: T.strip(F.regexp_extract(t, p, g))
    ends = r"Ο\s*Πρωθυπουργός|Τα\s*Μέλη\s*του\s*Υπουργικού\s*Συμβουλίου|Καποδιστρίου|Τηλ\.|https?://|$"
    return F.struct(
        F.coalesce(T.extract_one(t, r"Τεύχος\s*([Α-Ωα-ω'’]+)"), T.extract_one(t, r"ΤΕΥΧΟΣ\s*([Α-Ωα-ω'’]+)"), none).alias("issue"),
        F.coalesce(T.extract_one(t, r"Αρ\.\s*Φύλλου\s*(\d+)"), none).alias("issue_number"),
        T.publication_date(t).alias("publication_date"),
        got(1).alias("number"),
        got(2).alias("act_date"),
        got(3).alias("title"),
        F.when(t.rlike(r"(?iuU)ΤΟ\s+ΥΠΟΥΡΓΙΚΟ\s+ΣΥΜΒΟΥΛΙΟ"), ORGAN).otherwise("").alias("organ"),
        T.extract_one(t, r"Έχοντας υπόψη:\s*(.*?)(?:αποφασίζει:|αποφασίζει)", "ius").alias("reasoning"),
        T.extract_one(t, rf"(?:αποφασίζει:|αποφασίζει)\s*(.*?)(?:{ends})", "ius").alias("decision"),
        T.signatures(t).alias("signatures"),
        T.contacts(t).alias("contacts"),
    )


def gate(document_type: Column, title: Column, raw: Column, sections: Column) -> Column:
    """Whether a document is to be read as a gazette."""
    # fixed values: the three patterns
    in_title = title.rlike(r"(?iuU)Πράξη|ΠΡΑΞΗ|Υπουργικού\s+Συμβουλίου|Υπουργικό\s+Συμβούλιο")
    in_raw = raw.rlike(r"(?iuU)ΕΦΗΜΕΡΙΔΑ(ΤΗΣ|\s+ΤΗΣ)?\s+ΚΥΒΕΡΝΗΣΕΩΣ|ΠΡΑΞΕΙΣ\s+ΥΠΟΥΡΓΙΚΟΥ\s+ΣΥΜΒΟΥΛΙΟΥ|Πράξη\s+Υπουργικού\s+Συμβουλίου|Υπουργικού\s+Συμβουλίου")
    in_sections = F.exists(sections, lambda s: s["text"].rlike(r"(?iuU)Ο\s*Πρωθυπουργός|Τα\s*Μέλη\s*του\s*Υπουργικού\s*Συμβουλίου|Πράξη\s+Υπουργικού\s+Συμβουλίου"))
    return F.coalesce(document_type == "cabinet_act", F.lit(False)) | F.coalesce(in_title, F.lit(False)) | F.coalesce(in_raw, F.lit(False)) | F.coalesce(in_sections, F.lit(False))


def act_xml(a: Column, fallback_title: Column, document_type: Column, chapter_in_text: Column) -> Column:
    """XML of ``act``'s struct."""
    return once(a, lambda x: _act_xml(x, fallback_title, document_type, chapter_in_text))


def _act_xml(a: Column, fallback_title: Column, document_type: Column, chapter_in_text: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""

    def item(x: Column) -> Column:
        lead = r"(?sU)\A(.+?:)\s*(.*)"
        split = x["text"].rlike(lead)
        intro = F.when(split, tag("Eisagogi", _text(T.strip(F.regexp_extract(x["text"], lead, 1))))).otherwise("")
        rest = F.when(split, T.strip(F.regexp_extract(x["text"], lead, 2))).otherwise(x["text"])
        listed = T.alpha_list(rest)
        body = F.when(F.size(listed) > 0, F.concat(intro, tag("Lista", F.array_join(F.transform(listed, lambda e: tag("Peripton", _text(e["text"]), grammato=e["letter"])), "")))).otherwise(F.concat(_text(rest), intro))
        return tag("Stoicheio", body, arithmos=x["number"])

    published = a["decision"].contains(PUBLISH)
    decision = F.concat(
        tag("Eisagogi", F.lit("αποφασίζει:")),
        tag("Arthro", _text(T.strip(F.when(published, F.substring_index(a["decision"], PUBLISH, 1)).otherwise(a["decision"])))),
        F.when(published, tag("DiataghDimosiefseos", F.lit("Η παρούσα Πράξη να δημοσιευθεί στην Εφημερίδα της Κυβέρνησης."))).otherwise(""),
    )
    s, c = a["signatures"], a["contacts"]
    signed = F.concat(maybe(s["premier"], tag("Prothypourgos", tag("Onoma", _text(s["premier"])))), F.when(F.size(s["members"]) > 0, tag("MeliYpourgikoySymvouliou", F.array_join(F.transform(s["members"], lambda m: tag("Melos", _text(m))), ""))).otherwise(""))
    praxi = F.concat(
        tag("Titlos", _text(F.when(has(a["title"]), a["title"]).otherwise(fallback_title))),
        maybe(a["organ"], tag("Organ", _text(a["organ"]))),
        maybe(a["reasoning"], tag("AitiolologikoMeros", tag("Eisagogi", F.lit("Έχοντας υπόψη:")), F.array_join(F.transform(T.numbered_items(a["reasoning"]), item), ""))),
        maybe(a["decision"], tag("ApoφασιστικόΜέρος", decision)),
        maybe(signed, tag("Ypografes", signed)),
    )
    attr = lambda n, v: F.when(has(v), F.concat(F.lit(f' {n}="'), v, F.lit('"'))).otherwise("")
    act_tag = F.concat(F.lit("<Praxi"), attr("arithmos", a["number"]), attr("hmerominia", a["act_date"]), F.lit(">"), praxi, F.lit("</Praxi>"))
    reached = F.concat(maybe(c["address"], tag("Dieuthinsi", _text(c["address"]))), maybe(c["phone"], tag("Tilefono", _text(c["phone"]))), maybe(c["url"], tag("HlektronikaDieuthinsi", _text(c["url"]))))
    return tag(
        "EfimeridaKyverniseos",
        tag("Metadata", tag("Titlos", F.lit(GAZETTE)), tag("Teychos", _text(a["issue"])), tag("ArithmosFyllou", _text(a["issue_number"])), tag("Hmerominia", _text(a["publication_date"]))),
        tag("Periexomena", tag("Kefalaio", act_tag, titlos=F.when(chapter_in_text, CHAPTER).otherwise(document_type))),
        maybe(reached, tag("Epikoinonia", reached)),
    )
