"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage: a lost executor costs only the tasks it was running, never the
passes before them. The folder is the session's spark.checkpoint.dir. A session without one may stage only
on a local master, where driver and executors are one process; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of local sessions that name none, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="sparkassay-")
    return _local_folders[application]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(table: DataFrame, name: str) -> DataFrame:
    """The table, written once as Parquet and read back."""
    spark = table.sparkSession
    path = new_path(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def free_name(table: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_name(text: Column) -> Column:
    """128 bits that name a text (null: the empty one)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))
