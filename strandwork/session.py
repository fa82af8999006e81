"""Session helpers: where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_SEEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one of our own (tests, local mode only)."""
    named = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CONF} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="strandwork-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set(_CONF, own)
    return own


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandwork/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts the lineage.

    The table survives the loss of an executor. ``drop_materialized`` removes it early, ``drop_tables`` all of an application's; those
    left are removed when the driver's process ends."""
    spark = df.sparkSession
    folder = _own_tables(spark)
    if folder not in _SEEN:
        _SEEN.add(folder)
        atexit.register(_drop_at_exit, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandwork_path = path
    return out


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        system, target = file_system(spark, folder)
        system.delete(target, True)
    except Exception:  # the session has ended already
        pass


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` made for this application: when no result that rests on them is needed any more."""
    system, target = file_system(spark, _own_tables(spark))
    system.delete(target, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table made by ``materialize``."""
    path = getattr(df, "_strandwork_path", None)
    if path is not None:
        system, target = file_system(df.sparkSession, path)
        system.delete(target, True)


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver was started; a cluster installs it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
