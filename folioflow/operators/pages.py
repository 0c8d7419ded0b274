"""Pages: classification, routes, ordered merges, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

MIN_CHARS, MIN_QUALITY, CHUNK_CHARS, HEAD = 50, 0.6, 6000, 50
COLUMN_MARK = "\n\n--- ΣΤΗΛΗ 2 ---\n\n"


def classify(df: DataFrame, text: str = "text", n_images: str = "n_images") -> DataFrame:
    """Adds char_count, quality, has_text_layer, is_scanned, is_mixed."""
    stripped = T.strip(F.coalesce(F.col(text), F.lit("")))
    out = df.withColumn("char_count", F.length(stripped).cast("bigint")).withColumn("quality", T.text_quality(stripped))
    has = (F.col("char_count") >= MIN_CHARS) & (F.col("quality") >= MIN_QUALITY)
    return out.withColumn("has_text_layer", has).withColumn("is_scanned", ~has).withColumn("is_mixed", has & (F.col(n_images) > 0))


def route(df: DataFrame, text: str = "text") -> DataFrame:
    """Scanned pages wait for recognition with a null text; no page is dropped."""
    return df.withColumn("page_text", F.when(~F.col("is_scanned"), F.col(text))).withColumn("method", F.when(F.col("is_scanned"), "tesseract_pending").otherwise("pymupdf"))


def needs_ocr(df: DataFrame) -> DataFrame:
    return df.where("is_scanned or is_mixed")


def merge_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, n_pages, raw_text): '[PAGE n]' blocks in page order, one row per document. Partial sorts
    happen inside the aggregate's array; a document's pages must fit one row, as its raw text does."""
    block = F.concat(F.lit("[PAGE "), F.col(page).cast("string"), F.lit("]\n\n"), F.coalesce(F.col(text), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), block.alias("b"))))
    return pages.groupBy(doc).agg(F.count("*").alias("n_pages"), F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n").alias("raw_text"))


def segments(raw: Column, compat: bool = True) -> Column:
    """Marker-led segments. compat: text before the first marker is lost and the last page's body is
    there twice; otherwise the segments join to the text."""
    marks = F.regexp_extract_all(raw, F.lit(r"(\[PAGE \d+\])"), F.lit(1))
    bodies = F.split(raw, r"\[PAGE \d+\]")
    led = F.transform(F.arrays_zip(marks.alias("m"), F.slice(bodies, 2, 1_000_000).alias("b")), lambda x: F.concat(x["m"], x["b"]))
    if compat:
        return F.when(F.size(marks) == 0, F.array(raw)).otherwise(F.concat(led, F.array(F.element_at(bodies, -1))))
    return F.filter(F.concat(F.array(F.element_at(bodies, 1)), led), lambda s: s != "")


def pack(segs: Column, limit: int = CHUNK_CHARS) -> Column:
    """Greedy packing: a segment that would pass the limit starts a new chunk; chunks are stripped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, seg: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(seg) > limit) & (acc["cur"] != "")
        return F.struct(F.when(full, F.array_append(acc["done"], T.strip(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(full, seg).otherwise(F.concat(acc["cur"], seg)).alias("cur"))

    def end(acc: Column) -> Column:
        last = T.strip(acc["cur"])
        return F.when((last != "") | (F.size(acc["done"]) == 0), F.array_append(acc["done"], last)).otherwise(acc["done"])

    return F.aggregate(segs, start, add, end)


def chunks(docs: DataFrame, doc: str, raw: str = "raw_text", limit: int = CHUNK_CHARS, compat: bool = True) -> DataFrame:
    packed = docs.select(doc, pack(segments(F.col(raw), compat), limit).alias("c"))
    return packed.select(doc, F.size("c").cast("bigint").alias("total"), F.posexplode("c").alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def two_columns(left: Column, right: Column) -> Column:
    return F.array_join(F.filter(F.array(T.strip(left), T.strip(right)), lambda x: x != ""), COLUMN_MARK)


def lines_by_y(blocks: Column) -> Column:
    """Text of array<struct<y, ord, text>> in reading order: ascending y, then as listed."""
    return F.array_join(F.transform(F.array_sort(blocks), lambda x: x["text"]), "\n")


def detect(df: DataFrame, text: str = "text", placements: str = "placements", raster: tuple[str, str] | None = None) -> DataFrame:
    """``classify``, with image_regions (all placements of a page's images, array<array<struct<x0,y0,x1,y1>>>
    flattened), has_two_columns, column_x and confidence_hint. raster names the columns of a half-scale
    grey rendering's width and bytes; without one no columns are sought."""
    from folioflow.sources.documents import column_divider

    out = classify(df.withColumn("image_regions", F.flatten(F.coalesce(F.col(placements), F.array().cast(df.schema[placements].dataType)))).withColumn("__n", F.size("image_regions")), text, "__n").drop("__n")
    found = column_divider(F.col(raster[0]), F.col(raster[1])) if raster else F.struct(F.lit(False).alias("two_columns"), F.lit(None).cast("int").alias("column_x"))
    out = out.withColumn("__c", found).withColumn("has_two_columns", F.col("__c.two_columns")).withColumn("column_x", F.col("__c.column_x")).drop("__c")
    return out.withColumn("confidence_hint", F.col("quality"))


def page_lines(blocks: Column) -> Column:
    """Text of array<struct<type, lines: array<struct<y, spans: array<struct<text>>>>>>: only text blocks
    (type 0), a line's spans joined, lines by y and then as listed."""
    lines = F.flatten(F.transform(F.filter(blocks, lambda b: b["type"] == 0), lambda b: b["lines"]))
    placed = F.transform(lines, lambda x, i: F.struct(x["y"].alias("y"), i.alias("ord"), F.array_join(F.transform(x["spans"], lambda s: s["text"]), "").alias("text")))
    return T.strip(lines_by_y(placed))


def text_layer(df: DataFrame, blocks: str = "blocks", left: str = "left_text", right: str = "right_text") -> DataFrame:
    """Adds page_text and method to detected pages: two columns where a divider that is not 0 was found,
    lines in reading order otherwise; scanned pages wait with a null text."""
    split = F.coalesce(F.col("has_two_columns"), F.lit(False)) & (F.coalesce(F.col("column_x"), F.lit(0)) != 0)
    text = F.when(split, two_columns(F.col(left), F.col(right))).otherwise(page_lines(F.col(blocks)))
    return route(df.withColumn("__t", text), "__t").drop("__t")


def recognise(df: DataFrame, ocr, image: str = "image", halves: tuple[str, str] = ("left_image", "right_image")) -> DataFrame:
    """Scanned and mixed pages with page_text from ``ocr(bytes, columns)``, method and failure. Pages
    with a divider are read as two halves and joined; a page on which ocr fails has the empty text."""
    split = F.coalesce(F.col("has_two_columns"), F.lit(False)) & (F.coalesce(F.col("column_x"), F.lit(0)) != 0)
    src = needs_ocr(df).withColumn("__split", split)

    def run(frames):
        for f in frames:
            texts, failed = [], []
            for two, *images in zip(f["__split"], f[image], f[halves[0]], f[halves[1]]):
                try:
                    parts = [ocr(x, True).strip() for x in images[1:]] if two else [ocr(images[0], False).strip()]
                    texts.append(COLUMN_MARK.join(p for p in parts if p))
                    failed.append(None)
                except Exception as e:  # an engine may fail in any way
                    texts.append("")
                    failed.append(f"{type(e).__name__}: {e}")
            yield f.drop(columns=[image, *halves, "__split"]).assign(page_text=texts, method="tesseract", failure=failed)

    kept = [f"`{c}` {t}" for c, t in src.dtypes if c not in (image, *halves, "__split")]
    return src.mapInPandas(run, ", ".join([*kept, "page_text string, method string, failure string"]))


def with_info(texts: DataFrame, infos: DataFrame, keys: list[str]) -> DataFrame:
    """Pages joined with what was detected on them, by document and page number."""
    return texts.join(infos, keys)


def image_content(images: DataFrame, keys: list[str], category: str, text: str, path: str, order: str) -> DataFrame:
    """(keys, content): the recognised text of an image of pure text, a marker with its category and path of
    any other. An image listed twice under the same keys counts as its last listing says."""
    made = F.when(F.col(category) == "pure_text", F.col(text)).otherwise(F.concat(F.lit("!["), category, F.lit("](/"), path, F.lit(")")))
    return images.withColumn("content", made).groupBy(*keys).agg(F.max_by("content", order).alias("content"))


def merge_images(pages: DataFrame, images: DataFrame, keys: list[str], text: str, content: str, order: str) -> DataFrame:
    """Left join of page images, appended in order: markers as they are, recognised text only if its
    first 50 characters are not in the page yet."""
    listed = images.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(content, F.lit("")).alias("c")))).alias("imgs"))
    joined_ = pages.join(listed, keys, "left")
    found = F.coalesce(F.col("imgs"), F.array().cast("array<struct<o:bigint,c:string>>"))

    def add(md: Column, img: Column) -> Column:
        c = img["c"]
        known = F.contains(md, F.substring(c, 1, HEAD))
        return F.when(c.contains("!["), F.concat(md, F.lit("\n\n"), c, F.lit("\n\n"))).when((c != "") & ~known, F.concat(md, F.lit("\n\n[OCR TEXT]:\n"), c, F.lit("\n\n"))).otherwise(md)

    return joined_.withColumn("page_md", F.aggregate(found, F.coalesce(F.col(text), F.lit("")), add)).drop("imgs")


def unseen(items: DataFrame, pages_: DataFrame, text: str, page: str, head: int = HEAD) -> DataFrame:
    """The items whose first ``head`` characters (all, of a shorter one) stand in no page; an empty or null
    item stands in every page that is not null. A page's grams of each length that heads have meet the
    heads' hashes in an inner join that keeps the heads found, so only grams that are heads go on; the
    heads' lengths, at most ``head`` numbers, ride on every page."""
    heads = items.withColumn("__h", F.substring(F.coalesce(F.col(text), F.lit("")), 1, head))
    distinct = heads.select("__h").distinct()
    lengths = distinct.where("__h <> ''").agg(F.sort_array(F.collect_set(F.length("__h"))).alias("__n"))
    body = pages_.where(F.col(page).isNotNull()).select(F.col(page).alias("__p")).crossJoin(F.broadcast(lengths))  # one row
    grams = F.expr("flatten(transform(__n, n -> transform(sequence(1, greatest(1, length(__p) - n + 1)), i -> substr(__p, i, n))))")
    met = body.select(F.explode(F.array_distinct(grams)).alias("__h")).join(distinct, "__h", "left_semi").distinct()
    some = pages_.where(F.col(page).isNotNull()).limit(1).select(F.lit("").alias("__h"))
    return heads.join(met.unionByName(some), "__h", "left_anti").drop("__h")
