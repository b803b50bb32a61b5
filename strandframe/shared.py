"""Tables in the folder that driver and executors share: they cut a plan's lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def new_folder(spark: SparkSession) -> str:
    """A path in the folder that spark.checkpoint.dir names (in local mode a temporary one where it is unset); what is there goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/files-{uuid.uuid4().hex}"
    _folders.add(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows, written and read again."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    with contextlib.suppress(Exception):
        conf = SparkContext._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()
        for path in _folders:
            where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
