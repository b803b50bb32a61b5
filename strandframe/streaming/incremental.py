"""Runs that go on where they stopped, and logs whose last record counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import keep_last


def check_settings(spark: SparkSession, folder: str, settings: dict) -> None:
    """Record the settings of a run; a later run with others is refused, naming the keys."""
    path = f"{folder}/settings"
    try:
        old = json.loads(spark.read.text(path).first()[0])
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.text(path)
        return
    if changed := sorted(k for k in {*old, *settings} if old.get(k) != settings.get(k)):
        raise ValueError(f"settings differ from those of the run so far: {', '.join(changed)}")


def run_new_files(spark: SparkSession, source: str, schema, measure: Callable[[DataFrame], DataFrame], folder: str, settings: dict | None = None, file_format: str = "parquet") -> None:
    """Measure the files that no earlier run has seen, and append the rows to folder/out."""
    check_settings(spark, folder, settings or {})
    rows = spark.readStream.schema(schema).format(file_format).load(source)
    query = measure(rows).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_latest(spark: SparkSession, stream: DataFrame, folder: str, key: list[str], order: list[str]):
    """Keep the latest record of each key. A batch writes only its own latest records, under its number, so a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        keep_last(batch, key, order).write.mode("overwrite").parquet(f"{folder}/table/upsert_version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str, name: str, complete: bool = False) -> list[int]:
    """The numbers of the folders name=number in a folder; only those whose writing has ended, if asked for."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return []
    found = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith(f"{name}=")]
    done = [p for p in found if not complete or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _since(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """The batch up to which the newest compacted table goes (-1 without one), and the batches after it."""
    upto = max(_numbers(spark, f"{folder}/compact", "upto"), default=-1)
    return upto, [n for n in _numbers(spark, f"{folder}/table", "upsert_version") if n > upto]


def _every(spark: SparkSession, folder: str, upto: int, batches: list[int]) -> DataFrame | None:
    """Records of the compacted table and of the batches, with the batch each counts as."""
    parts = [spark.read.parquet(f"{folder}/compact/upto={upto}").withColumn("upsert_version", F.lit(upto))] if upto >= 0 else []
    if batches:
        paths = [f"{folder}/table/upsert_version={n}" for n in batches]
        parts.append(spark.read.option("basePath", f"{folder}/table").parquet(*paths))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_latest(spark: SparkSession, folder: str, key: list[str], order: list[str]) -> DataFrame | None:
    """The latest record of each key over all batches (of equal ones the later batch's); None before the first batch.

    Reads the newest compacted table and the batches after it: right after a compaction there is no shuffle, else one on the key, of one
    record a key and the newer batches.
    """
    upto, batches = _since(spark, folder)
    every = _every(spark, folder, upto, batches)
    if every is None:
        return None
    return (keep_last(every, key, [*order, "upsert_version"]) if batches else every).drop("upsert_version")


def compact_latest(spark: SparkSession, folder: str, key: list[str], order: list[str], delete: bool = False) -> int | None:
    """Replace the batches written so far by one table of the latest records; returns the last batch in it, None if there is nothing new.

    Runs beside appends: it takes batches whose writing has ended, up to the first that has not, and appears by one rename, so that a reader sees the old
    version or the new one. delete: also remove the batches in it and older compacted tables; readers that began before need them.
    """
    upto, batches = _since(spark, folder)
    done = set(_numbers(spark, f"{folder}/table", "upsert_version", complete=True))
    ready = batches[: next((i for i, n in enumerate(batches) if n not in done), len(batches))]
    if not ready:
        return None
    target, path = f"{folder}/compact/upto={ready[-1]}", f"{folder}/compact/_new-{uuid.uuid4().hex}"
    keep_last(_every(spark, folder, upto, ready), key, [*order, "upsert_version"]).drop("upsert_version").write.parquet(path)
    fs, where = _files(spark, path)
    if not fs.rename(where, _files(spark, target)[1]):
        raise OSError(f"another compaction has written {target}")
    if delete:
        for n in _numbers(spark, f"{folder}/compact", "upto")[:-1]:
            fs.delete(_files(spark, f"{folder}/compact/upto={n}")[1], True)
        for n in (n for n in _numbers(spark, f"{folder}/table", "upsert_version") if n <= ready[-1]):
            fs.delete(_files(spark, f"{folder}/table/upsert_version={n}")[1], True)
    return ready[-1]
