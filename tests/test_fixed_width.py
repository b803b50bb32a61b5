"""Fields of fixed width whose texts Java and SQL read differently."""

import math
import shutil

import pytest
from pyspark.sql import functions as F

from strandframe.functions.scalars import decimal_number, trimmed
from strandframe.plans.queries import ORACLES, QUERIES
from tests.compare import assert_same

NUMBERS = {"1234567d": None, "1234567f": None, "12.5D": None, "1.5e3F": None, "0x1p3": None, "12e45678": math.inf, "-1e999": -math.inf, "1_000.2_5": 1000.25, "1__0": None, "1_": None, "1._5": None, "1e1_0": 1e10, "+-5": -5.0, "++5": None, "+.5": 0.5, "5.": 5.0, ".": None, "1e": None, "\t5\r": 5.0, "\x015": None, "5\x1c": None, "inf": math.inf, "-Infinity": -math.inf, "infin": None, "": None}


def test_numbers(spark):
    got = spark.createDataFrame([(x,) for x in NUMBERS], "t string").select("t", decimal_number(trimmed(F.col("t"))).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == NUMBERS
    nan = spark.createDataFrame([("NaN",), ("-nan",), ("nan(a_1)",), ("nand",), (None,)], "t string").select("t", decimal_number(F.col("t")).alias("x")).collect()
    assert [r["x"] is not None and math.isnan(r["x"]) for r in nan] == [True, True, True, False, False]


@pytest.mark.parametrize("space", [" ", "　", " \t", "\r", ""])
def test_same_as_sql_on_odd_fields(spark, tmp_path, space):
    folder = str(tmp_path / "tables")
    shutil.copytree("/root/testdata/sf0.001", folder, ignore=shutil.ignore_patterns("documents*"))
    line = lambda x: "é" * 12 + f"{space}N{space}".ljust(4)[:4] + "y" * 14 + x
    text = "\n".join(line(f"{space}{x}{space}"[:8]) for x in NUMBERS)
    spark.createDataFrame([(1, text), (2, text + "\n"), (3, ""), (4, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    assert_same(QUERIES["f05_fixed_width"](spark, folder), ORACLES["f05_fixed_width"], folder)
