"""Session defaults; every setting can be overridden by the caller's cluster."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", name: str = "patchrank") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(cpus))
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k"))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set.

    Set it as ``spark.checkpoint.dir`` on a cluster. The fallback serves local tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a reduced table that several later steps read."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


_TABLES: dict[tuple, str] = {}


def materialise(df: DataFrame, key: tuple) -> DataFrame:
    """Write ``df`` once per application as parquet in the checkpoint folder and read it back.

    Later readers prune columns and rows at the scan and survive the loss of an executor.
    """
    spark = df.sparkSession
    slot = (spark.sparkContext.applicationId, *key)
    if slot not in _TABLES:
        path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        _TABLES[slot] = path
    return spark.read.schema(df.schema).parquet(_TABLES[slot])


def is_materialised(spark: SparkSession, key: tuple) -> bool:
    return (spark.sparkContext.applicationId, *key) in _TABLES


def reopen(spark: SparkSession, key: tuple) -> DataFrame:
    return spark.read.parquet(_TABLES[(spark.sparkContext.applicationId, *key)])
