"""Where results go: rendered documents, versions of laws, the review queue, images."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import payload

#: defaults of the settings; a cluster sets them as spark.folioflow.<name>
SETTINGS = {"input.dir": "data/input", "output.xml.dir": "data/output/xml", "output.html.dir": "data/output/html", "laws.dir": "data/laws", "review.dir": "data/review", "images.dir": "data/images", "num_ctx": "4096", "max_output_tokens": "4096", "ram_danger_gb": "2.5", "auto_start": "true", "converter.endpoint": ""}


def settings(spark: SparkSession) -> dict[str, str | int | float | bool | None]:
    """The settings with their types: any text but "false" (in any case) is true, an empty endpoint None."""
    got = {k: spark.conf.get(f"spark.folioflow.{k}", d) for k, d in SETTINGS.items()}
    out: dict = dict(got)
    out |= {k: int(got[k]) for k in ("num_ctx", "max_output_tokens")}
    return out | {"ram_danger_gb": float(got["ram_danger_gb"]), "auto_start": got["auto_start"].lower() != "false", "converter.endpoint": got["converter.endpoint"] or None}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, in local mode under the
    system's temporary folder; elsewhere the setting must be there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base}/written/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to a folder of ``scratch`` and read back: what they cost is not paid twice."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def output_paths(doc_id: Column, xml_dir: str, html_dir: str) -> Column:
    """struct<xml, html>: the files of a document, named by its slug; equal slugs are one file."""
    slug = T.slugify(doc_id)
    return F.struct(F.concat(F.lit(f"{xml_dir}/"), slug, F.lit(".xml")).alias("xml"), F.concat(F.lit(f"{html_dir}/"), slug, F.lit(".html")).alias("html"))


def write_texts(docs: DataFrame, root: str, name: Column, text: str, order: str) -> None:
    """A folder ``name=...`` with one text file per name under root; of rows with one name the last by
    ``order`` stays, names that the rows don't have stay as they were. Folders are made as needed."""
    last = docs.select(name.alias("name"), F.coalesce(F.col(text), F.lit("")).alias("value"), F.col(order).alias("__o")).groupBy("name").agg(F.max_by("value", "__o").alias("value"))
    last.write.mode("overwrite").partitionBy("name").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").text(root)


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(name, text) of what ``write_texts`` left; the writer ends a file with one line end more."""
    got = spark.read.option("basePath", root).text(root, wholetext=True)
    return got.select(F.col("name").cast("string").alias("name"), F.expr("substr(value, 1, length(value) - 1)").alias("text"))


def write_versions(rows: DataFrame, path: str) -> None:
    """Appends the rows of ``amend.snapshot``; ``amend.latest`` reads what stands under each key."""
    rows.write.mode("append").partitionBy("kind").parquet(path)


def enqueue(items: DataFrame, path: str) -> None:
    """Appends review rows as JSON, one folder per queued file's name."""
    items.write.mode("append").partitionBy("file_name").option("ignoreNullFields", "false").json(path)


def queued(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The pending rows of the queue in order of their names, with the file each came from."""
    got = spark.read.schema(f"{schema}, file_name string").option("basePath", path).json(path)
    return payload.pending(got.withColumn("_file", F.col("_metadata.file_path")))


def write_images(images: DataFrame, path: str) -> None:
    """Image bytes under their names, one row per name."""
    images.where("image is not null").dropDuplicates(["name"]).select("name", "ext", "image").write.mode("append").parquet(path)
