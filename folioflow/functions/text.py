"""Column functions on text: slugs, white space, dates, lists, signatures, contacts, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: genitive month names in calendar order
GREEK_MONTHS = ["Ιανουαρίου", "Φεβρουαρίου", "Μαρτίου", "Απριλίου", "Μαΐου", "Ιουνίου", "Ιουλίου", "Αυγούστου", "Σεπτεμβρίου", "Οκτωβρίου", "Νοεμβρίου", "Δεκεμβρίου"]
#: fixed value: letters of a month name (ΐ is not among them, so May has no match)
MONTH_LETTERS = "Α-Ωα-ωΆΈΉΊΌΎΏάέήίόύώ"
#: fixed value: characters that count as readable text
READABLE = "\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}a-zA-Z0-9\\s.,;:\\-–()/«»\"'%€"
#: fixed values: headings and a street of the gazette, and the patterns below that read it
PREMIER, MEMBERS = "Ο Πρωθυπουργός", "Τα Μέλη του Υπουργικού Συμβουλίου"
MEMBERS_RE = r"Τα\s*Μέλη\s*του\s*Υπουργικού\s*Συμβουλίου"
STREET = "Καποδιστρίου"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def slugify(c: Column) -> Column:
    """Lower case, white space to '-', only letters, digits and -_. kept; never empty."""
    base = F.lower(strip(F.coalesce(F.nullif(c, F.lit("")), F.lit("untitled"))))
    dashed = F.regexp_replace(base, r"(?U)\s+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, r"[^a-z0-9\-_.\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]", ""), F.lit("")), F.lit("untitled"))


def normalize_ws(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def extract_one(c: Column, pattern: str, flags: str = "iu") -> Column:
    """Group 1 of the first match, stripped; null where nothing matches."""
    p = f"(?{flags}U){pattern}"
    return F.when(c.rlike(p), strip(F.regexp_extract(c, p, 1)))


def escape_markup(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def greek_date(c: Column) -> Column:
    p = rf"(\d{{1,2}})\s+([{MONTH_LETTERS}]+)\s+(\d{{4}})"
    months = F.create_map(*(x for i, m in enumerate(GREEK_MONTHS) for x in (F.lit(m), F.lit(i + 1))))
    month = F.try_element_at(months, F.regexp_extract(c, p, 2))
    made = F.format_string("%04d-%02d-%02d", F.regexp_extract(c, p, 3).cast("int"), month, F.regexp_extract(c, p, 1).cast("int"))
    return F.when(c.rlike(p) & month.isNotNull(), made)


def dot_date(c: Column) -> Column:
    p = r"(\d{2})\.(\d{2})\.(\d{4})"
    return F.when(c.rlike(p), F.concat_ws("-", *(F.regexp_extract(c, p, g) for g in (3, 2, 1))))


def publication_date(c: Column) -> Column:
    """The Greek date decides if any is written, even with an unknown month; else the dotted one."""
    looks = c.rlike(rf"(?iuU)\d{{1,2}}\s+[{MONTH_LETTERS}]+\s+\d{{4}}")
    return F.when(looks, F.coalesce(greek_date(c), F.lit(""))).otherwise(F.coalesce(dot_date(c), F.lit("")))


def alpha_list(c: Column) -> Column:
    """array<struct<letter, text>> of 'α) ... β) ...'."""
    p = r"(?U)\s*([α-ωΑ-Ω])\)\s*"
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("letter"), F.slice(F.split(c, p), 2, 1_000_000).alias("text"))
    return F.filter(F.transform(pairs, lambda x: F.struct(x["letter"].alias("letter"), strip(x["text"]).alias("text"))), lambda x: x["text"] != "")


def numbered_items(c: Column) -> Column:
    """array<struct<number, text>>; every 'digits.' starts an item, a year's too."""
    p = r"(?sU)(\d+)\.\s*(.*?)(?=\d+\.|$)"
    numbers, texts = (F.regexp_extract_all(c, F.lit(p), F.lit(g)) for g in (1, 2))
    return F.transform(F.arrays_zip(numbers.alias("number"), texts.alias("text")), lambda x: F.struct(x["number"].alias("number"), strip(x["text"]).alias("text")))


def _members(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(c, r","), strip), lambda m: m != ""), F.array().cast("array<string>"))


def signatures(c: Column) -> Column:
    """struct<premier, members>: both headings, or either of them."""
    both = c.contains(PREMIER) & c.contains(MEMBERS)
    premier = F.when(both, extract_one(c, rf"Ο\s*Πρωθυπουργός\s*(.*?)\s*{MEMBERS_RE}", "ius")).when(c.contains(PREMIER), extract_one(c, rf"Ο\s*Πρωθυπουργός\s*([{MONTH_LETTERS}\s\-]+)"))
    listed = F.when(both, extract_one(c, rf"{MEMBERS_RE}\s*(.*?)(?:{STREET}|Τηλ\.|https?://|$)", "ius")).when(c.contains(MEMBERS), extract_one(c, rf"{MEMBERS_RE}\s*(.*)$", "ius"))
    return F.struct(premier.alias("premier"), _members(listed).alias("members"))


def contacts(c: Column) -> Column:
    """struct<address, phone, url>, empty where absent; a capital Tau ends an address."""
    none = F.lit("")
    return F.struct(
        F.coalesce(extract_one(c, rf"({STREET}[^Τ]*?)\s*(?:Τηλ\.|https?://|$)", "s"), none).alias("address"),
        F.coalesce(extract_one(c, r"Τηλ\.\s*[:\s]*([0-9\s\-]+)"), none).alias("phone"),
        F.coalesce(extract_one(c, r"(https?://\S+)"), none).alias("url"),
    )


def text_quality(c: Column) -> Column:
    """Share of readable characters, 3 places; 0 for no text."""
    n = F.length(c)
    return F.when(n > 0, F.bround(F.regexp_count(c, F.lit(f"(?U)[{READABLE}]")) / n, 3)).otherwise(F.lit(0.0))


def image_category(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit("photo")
    for name in ("photo", "chart", "table", "pure_text"):
        out = F.when(low.contains(name), F.lit(name)).otherwise(out)
    return out


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def relative(c: Column, root: str) -> Column:
    """A path below ``root`` without it; others as they are."""
    head = root.rstrip("/") + "/"
    return F.when(c.startswith(head), F.substring(c, len(head) + 1, 1_000_000)).otherwise(c)


def extension(c: Column) -> Column:
    """What follows the last dot of a path's base name, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(basename(c), r"[^.]\.([^.]*)$", 1))
