"""Session settings and the one shared folder that jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on; the rest is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("evispark")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


#: Rows and bytes that cross to a Python worker in one go, Spark's own bounds and these: texts may be long, and both the executor and
#: the worker hold a batch in several copies. A longer row crosses alone.
BATCH = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"),
)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies in a folder that they share; elsewhere it has to be installed.

    The rows and bytes that go to them at once are lowered, unless the session has bounds of its own.
    """
    for name, usual, fewer in BATCH:
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, fewer)
    root = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local session gets a new folder; a cluster, whose
    executors couldn't read one another's files there, gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evispark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Paths that this process has given out, by application.
_GIVEN: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all that operators have stored in the shared folder for this application so far; how many paths went.

    Results that aren't written yet may still read these tables, so call it when they are.
    """
    given = _GIVEN.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in given:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(given)


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: later steps don't compute ``df`` again, and a lost executor costs a reread only.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
