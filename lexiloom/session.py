"""Session helpers: reading tables and cutting lineage in a folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` (a file or a folder of files) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() usable.

    A cluster names its shared folder in spark.checkpoint.dir. Only where that is unset (tests, one machine)
    a temporary folder is set here; checkpoint() replicates through the file system, so a lost executor loses nothing.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexiloom-checkpoint-"))


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Row-local work over a table in fewer files than there are cores is spread by a round-robin exchange;
    larger tables keep the partitions of their scan, without an exchange."""
    spark = df.sparkSession
    n = cores(spark)
    have = df.rdd.getNumPartitions()
    return df if have * 2 >= n else df.repartition(n)


def default_tokenizers() -> str:
    return os.environ.get("LEXILOOM_TOKENIZERS", "/opt/tokenizers")


def apart(spark: SparkSession, **conf: object) -> SparkSession:
    """A session of the same application with settings of its own, for eager steps: the caller's settings stay as they are.
    Names are those of spark.sql, with _ for the points."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():  # what was set on the caller's session since it began
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    for name, value in conf.items():
        own.conf.set("spark.sql." + name.replace("_", "."), value)
    return own


#: Paths of stored tables that are still there, by application.
_stored: dict[str, list[str]] = {}


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a parquet table in the checkpoint folder: lineage cut, columns prunable on every later read.

    The table stays until drop() is called for it, release() for all of the application, or Python ends.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(release)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return stored_table(spark, path, df.schema)


def stored_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table as a frame of any session of the application."""
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def moved(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A stored table (anything else is stored first) as a frame of another session."""
    there = df if hasattr(df, "_stored_at") else stored(df)
    return stored_table(spark, there._stored_at, there.schema)


def _delete(path: str) -> None:
    sc = SparkContext._active_spark_context
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by stored() that no later step reads; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        own = _stored.get(df.sparkSession.sparkContext.applicationId, [])
        if path in own:
            own.remove(path)
            _delete(path)


def release() -> None:
    """Delete all tables that the running application has stored. Results that are not yet written must not be used any more."""
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        for path in _stored.pop(sc.applicationId, []):
            _delete(path)
