"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset in local mode (tests), a folder of our own.
    Elsewhere that is an error: executors can't see a machine's own folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: bytes of one batch between the JVM and a Python worker, which both hold it several times over
BATCH_BYTES = 4_000_000
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: by rows alone, 10,000 long texts are one batch. A session that sets the
    bound itself keeps its own."""
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, BATCH_BYTES)


_scope = threading.local()


def tidy(f):
    """A function whose kept tables all go if it fails; if it doesn't, it drops them itself."""

    @functools.wraps(f)
    def run(*args, **options):
        outer, mine = getattr(_scope, "tables", None), []
        _scope.tables = mine
        try:
            return f(*args, **options)
        except BaseException:
            drop(*mine)
            raise
        finally:
            _scope.tables = outer
            if outer is not None:
                outer += mine

    return run


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor
    costs the tasks that it ran, not the work before. ``drop`` removes such a table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    if getattr(_scope, "tables", None) is not None:  # before the write, which may fail half-way
        _scope.tables.append(SimpleNamespace(kept_at=path, sparkSession=spark))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    for t in tables:
        path = getattr(t, "kept_at", None)
        if path:
            jvm = t.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
