"""What a session needs to run this library's Python functions."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_find_us(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, whatever folder they start in. Installed copies elsewhere on their path work as well."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a temporary one if all run on one machine, as in tests, and an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="pixelframe-"))
        path = _OWN[0]
    return path.rstrip("/")


#: Folders made by this driver, for clear().
_MADE: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    _MADE.append(f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}")
    df.write.parquet(_MADE[-1])
    return spark.read.schema(df.schema).parquet(_MADE[-1])


def tables_made() -> int:
    """How many folders there are, for forget()."""
    return len(_MADE)


def forget(spark: SparkSession, since: int) -> None:
    """Delete the folders made after the first `since`, apart from the last one: what a round wrote on its way to its end."""
    gone, _MADE[since:] = _MADE[since:-1], _MADE[since:][-1:]
    for path in gone:
        _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate folders made so far. Results still to be read from them are lost, so write those first."""
    while _MADE:
        _delete(spark, _MADE.pop())
