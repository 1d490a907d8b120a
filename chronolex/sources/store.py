"""Tables that are built once a session and read by many queries: the index, retrieval runs, phrases."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_known: dict[tuple, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one beside the warehouse, or a new one of our own if all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        path = "file://" + tempfile.mkdtemp(prefix="chronolex-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_chronolex"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may be gone already
        return


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """Lengths and times of the input files, so a table is built anew when its input changes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    return ";".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes, written to the shared folder at its first use and read from there ever after."""
    key = spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir), name
    if key not in _known:
        df = build()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        atexit.register(drop, spark, path)
        _known[key] = path, df.schema
    path, schema = _known[key]
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its plan; dropped at the end of the session."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(drop, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a computation needs only until its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        while self.paths:
            drop(self.spark, self.paths.pop())


def stored_folder(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """The folder that ``build`` fills at its first use, kept like a table of ``stored``."""
    key = spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir), name
    if key not in _known:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(drop, spark, path)
        build(path)
        _known[key] = path, None
    return _known[key][0]


def forget(*but: str) -> None:
    """Build every table anew at its next use, except those of the names ``but``."""
    for key in [k for k in _known if k[-1] not in but]:
        del _known[key]
