"""What the corpus operators share: tables, row ids and tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch; texts are long, so batches hold fewer rows than Spark's default of 10,000.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of one Arrow batch of texts; a smaller setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def packed(docs: DataFrame, keep: list[str], *others: Column) -> DataFrame:
    """The columns `keep` as one struct __row beside the columns that an operator reads, so that no name clashes."""
    return docs.select(F.struct(F.lit(0).alias("__0"), *[F.col(f"`{c}`") for c in keep]).alias("__row"), *others)  # a struct can't be empty


def schema_of(rows: DataFrame, columns: list[str], ddl: str) -> T.StructType:
    """The columns as they are, and those of a DDL text."""
    return T.StructType([*(rows.schema[c] for c in columns), *T.StructType.fromDDL(ddl).fields])


def unpacked(rows: DataFrame, *new: str) -> DataFrame:
    """The columns of __row, but for those of the names `new`, and these."""
    kept = [c for c in rows.schema["__row"].dataType.names if c != "__0" and c not in new]
    return rows.select(*[F.col(f"__row.`{c}`") for c in kept], *new)


#: A row's id holds its place in its file in the lower bits and the file's number in the upper ones.
ROW_BITS, MOST_FILES = 40, 1 << 20


def _numbered_files(df: DataFrame) -> DataFrame | None:
    """(file, number) of the Parquet files that a plain scan reads, in the order of their paths; None for other plans and for too many files."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if set(re.findall(r"^[\s:+-]*(\w+)", plan, re.M)) - {"Project", "Relation"} or not re.search(r"^[\s:+-]*Relation .* parquet$", plan, re.M):
        return None
    paths = df.select(df.metadataColumn("_metadata")["file_path"].alias("path")).distinct().limit(MOST_FILES + 1).select("path", F.xxhash64("path").alias("file")).collect()
    if len(paths) > MOST_FILES or len({r["file"] for r in paths}) < len(paths):
        return None
    return df.sparkSession.createDataFrame([(r["file"], i) for i, r in enumerate(sorted(paths))], "__file long, __number long")


def with_rid(df: DataFrame, name: str = "rid") -> DataFrame:
    """A unique row id (long) that is the same in every job, however the scan is split.

    Over Parquet files it is made of the file's number and the row's place in the file, which the scan itself
    gives; only the files' numbers are broadcast, and the driver has listed the files before (of over
    `MOST_FILES`, as of anything that isn't a plain scan, the rows are written with their ids and read from there).
    """
    files = _numbered_files(df)
    if files is None:
        return stash(df.withColumn(name, F.monotonically_increasing_id()))
    place = df.metadataColumn("_metadata")
    rows = df.select("*", F.xxhash64(place["file_path"]).alias("__file"), place["row_index"].alias("__row_index"))
    rows = rows.join(F.broadcast(files), "__file")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.shiftleft("__number", ROW_BITS).bitwiseOR(F.col("__row_index")).alias(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; on one machine (local mode, as in tests) a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders of stashed tables that are not deleted yet.
_stashed: set[str] = set()


def stash(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stashed.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(SparkContext._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(where, True)


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that no result reads any more."""
    for df in stashed:
        for name in {f.rsplit("/", 2)[1] for f in df.inputFiles()}:
            for path in [p for p in _stashed if p.endswith(f"/{name}")]:
                _delete(path)
                _stashed.discard(path)


@atexit.register
def _clear() -> None:
    """What is left when the driver ends; results have been written by then. What a killed driver leaves goes with the shared folder."""
    with contextlib.suppress(Exception):
        for path in _stashed:
            _delete(path)
