"""Reading tables, and writing intermediate ones to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one serves on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    if not _made:
        atexit.register(drop_tables)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table that ``durable`` returned as ``df``, once nothing will read it: the step before, when the next is written."""
    path = getattr(df, "_tessera_path", None)
    if path in _made:
        _delete(path, _made.pop(path))


def drop_tables() -> None:
    """Delete what ``durable`` wrote. It runs when the program ends; results may read the tables until then."""
    while _made:
        _delete(*_made.popitem())


def _delete(path: str, spark: SparkSession) -> None:
    """With the session that wrote it, or another one where that is stopped."""
    for session in (spark, SparkSession.getActiveSession()):
        try:
            place = session._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)
            return
        except Exception:  # noqa: BLE001 - the session may be gone; the next table may have another
            continue
