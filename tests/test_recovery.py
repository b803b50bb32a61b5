"""Logs that name their own columns, record files, conformers and presets."""

import numpy as np
import pytest

from strandframe import schema
from strandframe.operators import curate, joins
from strandframe.plans import standins
from strandframe.plans.queries import QUERIES
from strandframe.sources import logs, tables

BASE = " ".join(logs.BASE_COLUMNS)


def read_by_hand(text):
    """The state machine in plain Python, line after line."""
    columns, rows, unread = list(logs.BASE_COLUMNS), [], []
    for line in text.split("\n"):
        parts = line.split()
        if line[:1] in ("", "-"):
            continue
        if line[0].isalpha() or line[0] == " ":
            if len(parts) > 7 and set(logs.BASE_COLUMNS) <= set(parts):
                columns = list(dict.fromkeys([*logs.BASE_COLUMNS, *parts]))
            continue
        values, i = [], 0
        while i < len(parts):
            j = i
            while parts[i].startswith("[") and not parts[j].endswith("]"):
                j += 1
            values.append(" ".join(parts[i : j + 1]))
            i = j + 1
        values = values[1:]
        if len(values) == len(columns):
            rows.append(dict(zip(columns, values, strict=True)))
        elif values:
            unread.append(line)
    return rows, unread


def log_text():
    out = ["a run begins", "1 P0 1AAA X-ray 1.0 A 5 relaxed"]  # before any header: the base columns
    for run, names in enumerate((["sasa", "aev"], ["depth"], [], ["aev", "sasa", "phi"])):
        out += [f"  {BASE}  {'  '.join(names)}", "---- --- ----", "message of the run that says more than seven words and is no header"]
        for i in range(40):
            values = ["[1.5, -2.0, 3]" if n == "aev" else f"-{i}.{run}" for n in names]
            out.append("   ".join([str(i), f"P{run}", f"{i}ABC", "NMR", "-", "A/B", str(i), "unrelaxed", *values, *(["9"] if i == 17 else [])]))
    return "\n".join(out)


@pytest.mark.parametrize("split", ["128m", "400b"])
def test_header_is_carried_over_splits(spark, tmp_path, split):
    """A header holds for rows in later splits of its file, and for no other file."""
    text = log_text()
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("7 P9 2BBB NMR - C 8 relaxed\n" + text[: len(text) // 2])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = logs.read_lines(spark, str(tmp_path))
        if split != "128m":
            assert lines.select("file", "block").distinct().count() > 20
        good, bad = logs.recover_log(lines)
        got, left = good.collect(), bad.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert good.columns == ["file", *logs.BASE_COLUMNS, "sasa", "aev", "depth", "phi"]
    for name, whole in (("a.txt", text), ("b.txt", "7 P9 2BBB NMR - C 8 relaxed\n" + text[: len(text) // 2])):
        rows, unread = read_by_hand(whole)
        assert sorted(str(sorted((k, v) for k, v in r.asDict().items() if v is not None and k != "file")) for r in got if r["file"].endswith(name)) == sorted(str(sorted(r.items())) for r in rows)
        assert sorted(r["value"] for r in left if r["file"].endswith(name)) == sorted(unread) and unread


def test_columns_behind_the_header(spark):
    df = spark.createDataFrame([("f", 0, 0, f"{BASE} sasa"), ("f", 0, 1, "1 P 1A NMR - A 3 relaxed 2.5 [1, 2]"), ("f", 0, 2, "2 P 1A NMR - A 3 relaxed 2.5")], "file string, block long, line long, value string")
    good, bad = logs.recover_log(df, extra={1: ["aev"]}, mapping={"sasa": "area"})
    assert sorted((r["area"], r["aev"]) for r in good.collect() if r["aev"]) == [("2.5", "[1, 2]")] and good.count() == 2 and bad.count() == 0
    assert logs.recover_log(df.limit(0))[0].columns == ["file", *logs.BASE_COLUMNS]


def test_records_by_folder_and_by_name(spark, tmp_path):
    rows = [("1A", '{"status": "built", "chains": ["A", "B"], "n_atoms": 3}'), ("2 B", '{"status": "none"'), ("3C", '{"chains": []}'), ("4D", "[1]"), ("5E", "")]
    tables.write_records(spark.createDataFrame(rows, "structure string, value string"), f"{tmp_path}/r")
    tables.write_records(spark.createDataFrame([("6F", '{"status": "kept", "extra": {"x": 1}}')], "structure string, value string"), f"{tmp_path}/r")
    good, bad = tables.read_records(spark, f"{tmp_path}/r", tables.ASSEMBLY, r"\.assembly\.json")
    assert sorted((r["structure"], r["status"], r["chains"], r["n_atoms"]) for r in good.collect()) == [("1A", "built", ["A", "B"], 3), ("6F", "kept", None, None)]
    assert {r["structure"]: r["reason"] for r in bad.collect()} == {"2 B": "not readable as a record", "3C": "no status", "4D": "not readable as a record", "5E": "not readable as a record"}
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "7G.assembly.json").write_text('{\n "status": "identity",\n "measured_chains": ["A"]\n}')
    assert [tuple(r) for r in tables.read_assemblies(spark, f"{tmp_path}/n").select("structure", "status", "measured_chains", "chains").collect()] == [("7G", "identity", "A", None)]


def test_letters_of_hetero_atoms(spark):
    rows = [("S", 1, "ATOM", "", 1), ("S", 2, "ATOM", "A", 1), ("S", 3, "ATOM", "B", 1), ("S", 4, "HETATM", "B", 2), ("S", 5, "HETATM", "C", 2), ("T", 6, "ATOM", "", 1), ("T", 7, "HETATM", "A", 2), ("T", 8, "HETATM", "B", 2)]
    a = spark.createDataFrame([(s, 1, n, r, x, "A", i, 0.5) for s, n, r, x, i in rows], "structure string, model int, serial int, record string, altloc string, chain string, resid int, occupancy double")
    got = {}
    for r in curate.pick_rotamers(a, "all").collect():
        got.setdefault((r["structure"], r["conformer"]), set()).add((r["serial"], r["altloc"]))
    assert got == {("S", "A"): {(1, ""), (2, ""), (5, "C")}, ("S", "B"): {(1, ""), (3, ""), (4, ""), (5, "C")}, ("T", ""): {(6, ""), (7, "A"), (8, "B")}}
    first = {(r["serial"], r["altloc"]) for r in curate.pick_rotamers(a, "first").collect()}
    assert first == {(1, ""), (2, ""), (4, ""), (6, ""), (7, "A"), (8, "B")}


def test_presets(spark):
    assert len(schema.PRESETS) == 20 and schema.preset("cys")["modified"][0] == "CSO" and schema.preset("ALA")["modified"] == ()
    with pytest.raises(ValueError):
        schema.preset("XXX")
    rows = [("KCX", "NZ", 1, 1), ("LYE", "N07", 2, 2), ("LYS", "N07", 3, 3), ("LYS", "NZ", 4, 4), ("LYN", "NZ", 5, 5), ("CGU", "CD1", 6, 6), ("CGU", "CD2", 6, 7)]
    a = spark.createDataFrame([("S", "A", i, n, r, x) for r, x, i, n in rows], "structure string, chain string, resid int, serial int, resname string, name string")
    found = lambda *args: sorted((r["serial"], r["Modified"]) for r in curate.preset_anchors(a, *args).collect())
    assert found("LYS") == [(1, True), (2, True), (4, False), (5, False)] and found("LYS", False) == [(4, False), (5, False)] and found("GLU") == [(6, True)]


def test_restart_of_structures(spark):
    wanted = spark.createDataFrame([("1ABC",), ("2DEF",), ("3GHI",), ("AF-P1-F1",)], "PDB_Code string")
    files = spark.createDataFrame([(f,) for f in ("1ABC.pdb", "2DEF-alt-1.pdb", "2DEF-alt-2_relaxed.pdb", "3GHI.pdb", "AF-P1-F1-model.pdb")], "file string")
    log = spark.createDataFrame([("1ABC", 1), ("2DEF-alt-1", 2), ("2DEF-alt-1", 3), ("3GHI", 4), ("9XYZ", 5), ("3GHI", 6)], "code string, at int")
    left, todo = joins.restart_structures(wanted, files, log, ["at"])
    assert {r[0] for r in left.collect()} == {"2DEF", "3GHI", "AF-P1-F1"}
    assert {(r["file"], r["ignored"]) for r in todo.collect()} == {("2DEF-alt-1.pdb", True), ("2DEF-alt-2_relaxed.pdb", False), ("3GHI.pdb", False), ("AF-P1-F1-model.pdb", False)}


def test_structures_of_plain_and_relaxed_files(spark):
    """A file without '-' is its code's, and a code with '-alt' has its own files only."""
    wanted = spark.createDataFrame([(c,) for c in ("1abc", "2DEF-alt-1", "3GHI", "AF-P1-F1", "AF-P2-F1-model_v6", "4JKL.pdb")], "PDB_Code string")
    names = ("1ABC.pdb", "1ABC_relaxed.pdb", "1ABCD.pdb", "2DEF-alt-1.pdb", "2DEF-alt-1_relaxed.pdb", "2DEF-alt-2.pdb", "3GHI-clean.pdb", "3GHI-alt1A.pdb", "AF-P1-F1.pdb", "AF-P1-F2-model.pdb", "AF-P2-F1-model_v6_relaxed.pdb", "AF-P2-F1-model_v4.pdb", "4jkl", "AF-.pdb")
    got = joins.match_structures(wanted, spark.createDataFrame([(f,) for f in names], "file string")).collect()
    assert sorted((r["PDB_Code"], r["file"]) for r in got) == sorted([("1abc", "1ABC.pdb"), ("1abc", "1ABC_relaxed.pdb"), ("2DEF-alt-1", "2DEF-alt-1.pdb"), ("2DEF-alt-1", "2DEF-alt-1_relaxed.pdb"), ("3GHI", "3GHI-alt1A.pdb"), ("AF-P1-F1", "AF-P1-F1.pdb"), ("AF-P2-F1-model_v6", "AF-P2-F1-model_v6_relaxed.pdb"), ("4JKL.pdb", "4jkl")])


def test_components_of_another_table(spark):
    """Fitted on one table and applied to another, with the mean of the first."""
    got = {r["vec_id"]: r["pc"] for r in QUERIES["x05_reused_components"](spark, "/root/testdata/sf0.01").collect()}
    rows = standins.vectors(spark, "/root/testdata/sf0.01").collect()
    fit, new = (np.array([r["aev"] for r in rows if (r["Method"] == "Predicted") == p]) for p in (False, True))
    turn = np.linalg.svd(fit - fit.mean(0), full_matrices=False)[2][:5]
    want = np.abs((new - fit.mean(0)) @ turn.T)
    assert set(got) == {r["vec_id"] for r in rows if r["Method"] == "Predicted"}
    assert np.array([got[r["vec_id"]] for r in rows if r["Method"] == "Predicted"]) == pytest.approx(want, abs=1e-5)
