"""Stage tables: results that several later steps read are written once.

A stage is a parquet table in the shared folder that the cluster names in
``spark.checkpoint.dir``. It cuts the lineage, outlives lost executors, keeps column
pruning and filter pushdown for its readers, and gives the optimizer a real table size
to decide broadcasts with. It lives as long as the application.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_folders: dict[int, str] = {}


def stage_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of its own in local mode only."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    local = re.match(r"local(\[|$)", spark.sparkContext.master)
    if folder:
        if not local and re.match(r"file:|/", folder):
            warnings.warn(
                f"{CHECKPOINT_DIR} is {folder}: stage tables need a folder that all machines"
                " mount there", stacklevel=2,
            )
        return folder
    if not local:
        raise ValueError(
            f"set {CHECKPOINT_DIR} to a folder that all executors share"
        )
    if id(spark.sparkContext) not in _local_folders:
        _local_folders[id(spark.sparkContext)] = tempfile.mkdtemp(prefix="airtide-stages-")
    return _local_folders[id(spark.sparkContext)]


def stage(table: DataFrame, name: str) -> DataFrame:
    """Write ``table`` to a fresh folder and return it as read from there."""
    path = new_folder(table.sparkSession, name)
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a fresh shared folder that the file system drops when the application ends."""
    path = f"{stage_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)  # only what is there can be marked
    system.deleteOnExit(folder)
    return path
