"""Progress events as a stream: routes, per-stage counts with a watermark, and law state per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators import amend


def route(events: DataFrame, stage: str = "stage") -> DataFrame:
    """Adds panel: errors apart, the stages with a view of their own, all others progress."""
    s = F.col(stage)
    return events.withColumn("panel", F.when(s == "error", "error").when(s.isin("ai_preview", "save", "done"), s).otherwise("progress"))


def event_record(ts, stage, message, extra):
    """JSON of an event; extras override the fixed fields."""
    base = F.create_map(F.lit("ts"), ts, F.lit("stage"), stage, F.lit("message"), message)
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra))))


#: fixed values: the stages of a document's way
STAGES = ["start", "extract_images", "ocr", "markitdown", "merge", "ai_start", "ai", "save", "amend", "review", "done", "error", "log", "ai_purge"]


def log_record(ts, level, source, message):
    """An event of stage log, with its level in capitals and where it comes from."""
    return event_record(ts, F.lit("log"), message, F.create_map(F.lit("level"), F.upper(level), F.lit("source"), source))


def progress(rows: DataFrame, group: str, order: str, stage: str) -> DataFrame:
    """An event per row of a group: how many of its rows are done before it, and how many there are."""
    w = Window.partitionBy(group)
    done = F.row_number().over(w.orderBy(order)) - 1
    return rows.select(group, order, F.lit(stage).alias("stage"), done.cast("bigint").alias("done"), F.count("*").over(w).alias("total"))


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """(stage, message, extra) of JSON lines; what is not a JSON object with a stage is left out."""
    m = F.from_json(value, "map<string,string>")
    got = lines.select(m.alias("m")).where("m is not null and m['stage'] is not null")
    return got.select(F.col("m")["stage"].alias("stage"), F.col("m")["message"].alias("message"), F.map_filter("m", lambda k, v: ~k.isin("stage", "message")).alias("extra"))


def broadcast(stream: DataFrame, clients: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """A query that hands each micro-batch to every client; one that raises is not called again, and the
    others go on. Evicted clients leave the dict."""

    def send(batch: DataFrame, number: int) -> None:
        for name in list(clients):
            try:
                clients[name](batch, number)
            except Exception:  # a client's own failure ends its part only
                clients.pop(name, None)

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and key; late rows beyond the watermark are dropped when
    streaming, and the same expression runs in batch."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def law_state(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, law: str = "law_id", order: list[str] | None = None):
    """A query that folds each micro-batch's amendments into the laws under ``path``. A batch writes the state
    of all laws as ``path/batch=<n>``, from the batch before alone: laws that it doesn't touch go over as they
    are. A repeat overwrites its own folder, so a restart gives the same texts; the two last states stay."""
    order = order or ["ts", "event_id"]

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        folder = session._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(session._jsc.hadoopConfiguration())
        at = lambda n: f"{path}/batch={n}"
        written = lambda n: files.exists(session._jvm.org.apache.hadoop.fs.Path(f"{at(n)}/_SUCCESS"))
        before = session.read.parquet(at(number - 1)) if number and written(number - 1) else None
        laws = before.select(law, F.col("text").alias("current_text")) if before is not None else None
        now = amend.fold_laws(batch, law, order, laws)
        if before is not None:
            now = now.unionByName(before.join(batch.select(law).distinct(), law, "left_anti"))
        now.write.mode("overwrite").parquet(at(number))
        if number > 1:
            files.delete(session._jvm.org.apache.hadoop.fs.Path(at(number - 2)), True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def laws_now(spark: SparkSession, path: str) -> DataFrame:
    """The state that the last batch left."""
    every = spark.read.parquet(path)
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")
