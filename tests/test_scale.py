"""Operators whose work must spread over tasks."""

import pytest
from pyspark.sql import functions as F

from strandframe.operators import windows as wi
from strandframe.plans import queries


def test_fdr_in_many_tasks(spark):
    rows = [(i, None if i % 50 == 0 else (i * 7919 % 1009) ** 2 / 1e6) for i in range(1000)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = wi.step_up_fdr(spark.createDataFrame(rows, "id long, p double"), "p", "id").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(key)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    want, least = {}, 1.0
    for rank in range(len(order), 0, -1):
        i, p = order[rank - 1]
        least = least if p is None else min(least, p * len(order) / rank)
        want[i] = least
    assert {r["id"]: r["fdr"] for r in got} == pytest.approx(want)
    assert len({r["task"] for r in got}) > 1


def test_ensembles_are_counted_without_pairs(spark):
    got = queries.QUERIES["g11_ensemble_signature"](spark, "/root/testdata/sf0.001")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
