"""Where documents come from: files, rendered pages, listings; external converters are callables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from folioflow.functions import text as T


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the .pdf files under path, in any case of the letters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)


def uploads(names: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) by extension; null names are refused."""
    ok = F.lower(F.coalesce(F.col(name), F.lit(""))).endswith(".pdf")
    return names.where(ok), names.where(~ok)


def pages(files: DataFrame, convert: Callable[[bytes], Iterable[str | None]]) -> DataFrame:
    """(path, page_num, text, error): a converter's pages per file, numbered from 1. A file on which it
    fails is one row with the error, so others go on."""

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += [(path, k, t, None) for k, t in enumerate(convert(content), 1)]
                except Exception as e:  # a converter may fail in any way
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_num", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_num int, text string, error string")


def upload_errors(refused: DataFrame, name: str = "name") -> DataFrame:
    """An error event per refused upload."""
    return refused.select(F.lit("error").alias("stage"), F.concat(F.lit("Skipped non-PDF: "), F.coalesce(F.col(name), F.lit("None"))).alias("message"))


def images(files: DataFrame, extract: Callable[[bytes], Iterable[tuple[int, int, str, bytes]]]) -> DataFrame:
    """(path, page_num, xref, ext, name, image, error): the images of each file, from a callable that gives
    (page, xref, extension, bytes). An image on two pages is there twice. Its name is its content's hash,
    so a repeated run names it alike; a file that fails is one row with the error."""

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += [(path, p, x, e, bytes(b), None) for p, x, e, b in extract(content)]
                except Exception as e:  # a reader may fail in any way
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", "page_num", "xref", "ext", "image", "error"])
            yield out.astype({"page_num": "Int32", "xref": "Int32"})

    got = files.select("path", "content").mapInPandas(run, "path string, page_num int, xref int, ext string, image binary, error string")
    return got.withColumn("name", F.concat(F.sha2("image", 256), F.lit("."), "ext"))


def categories(images_: DataFrame, classify: Callable[[bytes], str]) -> DataFrame:
    """Adds category: the first known name in what the classifier says; a failing one says photo."""

    @F.pandas_udf("string")
    def said(content: pd.Series) -> pd.Series:
        def one(x):
            try:
                return str(classify(x)).strip()
            except Exception:  # as unsure as any other reply
                return "photo"

        return content.map(one)

    return images_.withColumn("category", T.image_category(said(F.col("image"))))


def structured(chunks: DataFrame, provider: Callable[[str], str], retry_chars: int = 4000) -> DataFrame:
    """Adds ``reply``: the provider's answer per chunk, once more with a prefix if it fails, else null.
    Calls have effects outside, so write the result before using it twice."""

    def run(frames):
        for f in frames:
            def ask(text: str) -> str | None:
                for t in (text, text[:retry_chars]):
                    try:
                        return provider(t)
                    except Exception:  # any failure of the service is retried, then left to the repair stage
                        continue
                return None

            yield f.assign(reply=f["chunk"].map(ask))

    return chunks.mapInPandas(run, f"{', '.join(f'`{c}` {t}' for c, t in chunks.dtypes)}, reply string")


@F.pandas_udf(StructType([StructField("two_columns", BooleanType()), StructField("column_x", IntegerType())]))
def column_divider(width: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    """The whitest pixel column between 40 and 60 % of a half-scale grey raster (bytes, row by row), in
    full-scale pixels, if at least 85 % of it is over 240; the leftmost of equals."""
    found = []
    for w, raw in zip(width, pixels):
        if raw is None or not w or len(raw) % int(w):
            found.append((False, None))
            continue
        grid = np.frombuffer(raw, np.uint8).reshape(-1, int(w))
        lo, hi = int(w * 0.40), int(w * 0.60)
        share = (grid[:, lo:hi] > 240).mean(axis=0) if hi > lo and len(grid) else np.zeros(0)
        best = int(share.argmax()) if len(share) else 0
        found.append((True, 2 * (lo + best)) if len(share) and share[best] >= 0.85 else (False, None))
    return pd.DataFrame(found, columns=["two_columns", "column_x"])


def listing(html: DataFrame, xml: DataFrame) -> DataFrame:
    """(id, html_url, xml_url) of outputs by base name, in order; no xml is null."""
    h = html.select(F.regexp_replace(T.basename(F.col("path")), r"\.html$", "").alias("id")).distinct()
    x = xml.select(F.regexp_replace(T.basename(F.col("path")), r"\.xml$", "").alias("id"), F.lit(True).alias("has")).distinct()
    return h.join(x, "id", "left").select("id", F.concat(F.lit("/outputs/html/"), "id", F.lit(".html")).alias("html_url"), F.when(F.col("has"), F.concat(F.lit("/outputs/xml/"), "id", F.lit(".xml"))).alias("xml_url")).orderBy("id")


def output(outputs: DataFrame, name: str, ext: str) -> DataFrame:
    """The output of that file name, (id, text); none if the name has another ending or nothing is kept."""
    ok = name.endswith(ext)
    return outputs.where(F.lit(ok) & (F.concat("id", F.lit(ext)) == name))


def current_laws(versions: DataFrame) -> DataFrame:
    return versions.where("kind = 'current'").groupBy("law_slug").agg(F.max_by("text", "seq").alias("current_text"))
