"""Records of many structures: packed into few files, and single files beside them."""

import json
import os

import pytest

from strandframe.plans.queries import ORACLES, QUERIES
from strandframe.sources import tables
from tests.compare import assert_same

FOLDER = "/root/testdata/sf0.01"


def files_in(path):
    return {f"{at}/{f}" for at, _, names in os.walk(path) for f in names}


@pytest.mark.parametrize("name", ["s06_assembly_records", "s05_skipped_minimisations", "s05_minimisation_records", "s05_quarantine"])
def test_files_do_not_grow_with_records(spark, name):
    """100 suppliers have 100 records, but few files."""
    base = spark.conf.get("spark.checkpoint.dir")
    before = files_in(base)
    assert_same(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER)
    assert 0 < len(files_in(base) - before) < 20


def test_packed_records_stay_whole(spark, tmp_path):
    """Lines, null and empty texts, names with signs of their own, and two records of one structure."""
    rows = [("a/b=1", '{\n "status": "built",\n "chains": ["A"]\n}'), ("é", '{"status": "é'), ("none", None), ("empty", ""), ("twice", '{"status": "kept"}'), ("twice", '{"status": "built"}'), (None, "{}")]
    tables.write_records(spark.createDataFrame(rows, "structure string, value string").coalesce(1), f"{tmp_path}/r")
    good, bad = tables.read_records(spark, f"{tmp_path}/r", tables.ASSEMBLY, r"\.assembly\.json")
    assert sorted((r["structure"], r["status"], r["chains"]) for r in good.collect()) == [("a/b=1", "built", ["A"]), ("twice", "built", None), ("twice", "kept", None)]
    got = bad.collect()
    assert {(r["structure"], r["n_bytes"], r["reason"]) for r in got} == {("é", 14, "not readable as a record"), ("none", 0, "not readable as a record"), ("empty", 0, "not readable as a record"), (None, 2, "no status")}
    assert len(got) == 4 and all(r["file"].endswith(".parquet") for r in got)


def test_single_files_beside_packed_ones(spark, tmp_path):
    path = tmp_path / "r"
    for name, text in {"1A.assembly.json": json.dumps({"status": "built"}, indent=1), "deep/2B.assembly.json": '{"status": "kept"}', "structure=3%20C/part-0.txt": '{"status": "none"}\n', "4D.assembly.json": "{broken", "5E.parquet": "no table"}.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    read = lambda: [sorted((r["structure"], r[c]) for r in df.collect()) for df, c in zip(tables.read_records(spark, str(path), tables.ASSEMBLY, r"\.assembly\.json"), ("status", "file"), strict=True)]
    single = [("1A", "built"), ("2B", "kept"), ("3 C", "none")]
    assert read() == [single, [("4D", "4D.assembly.json"), ("5E.parquet", "5E.parquet")]]
    for structure in ("6F", "7G"):
        tables.write_records(spark.createDataFrame([(structure, '{"status": "kept"}')], "structure string, value string"), str(path))
    good, bad = read()
    assert good == [*single, ("6F", "kept"), ("7G", "kept")] and len(bad) == 2
