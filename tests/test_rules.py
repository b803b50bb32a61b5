"""Rules with an answer that is known beforehand."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import curate, filters, joins, learning, spatial, windows
from strandframe.plans import plots, standins
from strandframe.plans.queries import QUERIES
from strandframe.sources import tables

ATOM = "structure string, serial int, record string, name string, altloc string, resname string, chain string, resid int, x double, y double, z double, occupancy double, element string"


def atom(serial, chain, resid, x, name="CB", resname="ALA", record="ATOM", element="C", occupancy=1.0, altloc="", structure="S"):
    return (structure, serial, record, name, altloc, resname, chain, resid, float(x), 0.0, 0.0, occupancy, element)


def test_other_chain_is_of_protein(spark):
    rows = [
        atom(1, "A", 1, 0, "NZ", "LYS", element="N"), atom(2, "B", 1, 7.5), atom(3, "C", 1, 2, "O", "HOH", "HETATM", "O"), atom(4, "D", 1, 3, "ZN", "ZN", "HETATM", "ZN"),
        atom(5, "B", 2, 1, element="H"), atom(6, "E", 1, 60, "SE", "MSE", "HETATM", "SE"), atom(7, "A", 9, 1),
        atom(8, "A", 1, 0, "NZ", "LYS", structure="T", element="N"), atom(9, "W", 1, 2, "O", "HOH", "HETATM", "O", structure="T"), atom(10, "A", 2, 900, "CB", structure="T"),
        atom(11, "A", 1, 0, "NZ", "LYS", structure="U", element="N"), atom(12, "B", 1, 500, "SG", "CSO", structure="U", element="S"),
    ]
    atoms = spark.createDataFrame(rows, ATOM)
    got = spatial.other_chain_distance(atoms.filter("name = 'NZ'"), atoms, ["structure", "serial"])
    assert {r["structure"]: r["distance"] for r in got.collect()} == {"S": 7.5, "T": None, "U": 500.0}


def test_clash_rules(spark):
    rows = [
        atom(1, "A", 1, 0), atom(2, "B", 1, 1.5, occupancy=0.4), atom(3, "C", 1, 2.9, occupancy=0.4),  # 1-2 and 2-3, however faint
        atom(10, "A", 50, 100, "FE", "HEM", "ATOM", "FE"), atom(11, "B", 50, 101), atom(12, "A", 60, 200, "CL", "CL", "HETATM", "CL"), atom(13, "B", 60, 201),  # metals in any record, ions
        atom(20, "A", 70, 300, "O", "WAT", "HETATM", "O", structure="W"), atom(21, "B", 70, 301, structure="W"),
        atom(30, "A", 80, 0, altloc="A", structure="V"), atom(31, "A", 81, 1, altloc="B", structure="V"),
    ]
    atoms = spark.createDataFrame(rows, ATOM)
    ordinals = windows.residue_ordinals(atoms)
    pairs = lambda **k: sorted((r["p_serial"], r["q_serial"]) for r in spatial.clashes(atoms, ordinals, **k).collect())
    assert pairs() == [(1, 2), (2, 3), (20, 21)]
    assert pairs(min_occupancy=0.5) == [(20, 21)]
    got = {r["structure"]: r for r in spatial.geometry_summary(atoms, ordinals).collect()}
    assert got["W"]["involves_water"] and not got["S"]["involves_water"] and got["S"]["n_clashes"] == 2 and got["V"]["n_clashes"] == 0


def test_weights():
    third = [1 / 3, 2 / 3]
    assert windows.best_weights(third, 2) == third and windows.best_weights([0.25, 0.75], 2) == [0.25, 0.75]
    assert windows.best_weights([1, 2], 2) == [0.33, 0.67] and windows.best_weights([3, 1, 9], 2) == [0.75, 0.25]
    assert windows.best_weights([0.5, 0.3], 3) == [0.44, 0.26, 0.29] and windows.best_weights(0.3, 2) == [0.3, 0.7]


def test_histogram_takes_the_features_width(spark):
    df = spark.createDataFrame([(0.0,), *((x / 10 + 0.03,) for x in range(21))], "depth double")
    assert plots.histogram(df, "depth").orderBy("bin").select(F.round("left_edge", 6)).first()[0] == 0
    assert plots.histogram(df, "depth").count() == 20


def test_term_by_name(spark):
    edges = spark.createDataFrame([("1", "P1"), ("2", "P2")], "go_id string, uniprot string")
    terms = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "three")], "go_id string, name string")
    df = spark.createDataFrame([("P1", 1), ("P2", 2), ("P2", 3)], "Uniprot_Entry string, Resid int")
    assert joins.with_term(df, edges, name="two", terms=terms).count() == 2 == joins.with_term(df, edges, "2", "two", terms).count()
    with pytest.raises(ValueError, match="not that of"):
        joins.with_term(df, edges, "1", "two", terms)
    with pytest.raises(KeyError):
        joins.with_term(df, edges, name="four", terms=terms)
    with pytest.raises(ValueError, match="code or a name"):
        joins.with_term(df, edges)
    with pytest.warns(UserWarning, match="empty"):
        assert joins.with_term(df, edges, name="three", terms=terms).count() == 0


def test_learning_table(spark):
    rows = [("P1", 1, "relaxed", "5", 1.0, 2.0, 3.0), ("P1", 1, "unrelaxed", "b", 1.0, 2.0, 3.0), ("P2", 1, "relaxed", None, 1.0, 2.0, 3.0), ("P3", 1, "relaxed", "a", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "Uniprot_Entry string, Resid int, Source string, class string, sasa double, sasa_max double, sasamax double")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        table, names, metadata = learning.learning_table(df, ["sasa"])
    assert names == ["sasa", "sasa_max"] and metadata == ["Uniprot_Entry", "Resid", "Source"] and table.columns == [*metadata, *names, "y"]
    assert [r["y"] for r in table.orderBy("Uniprot_Entry", "Source").collect()] == [5, 7, 8, 6] and dict(table.dtypes)["y"] == "tinyint"
    assert {r["y"] for r in learning.learning_table(df.drop("class"), ["sasa"])[0].collect()} == {-1}
    with pytest.warns(UserWarning, match="not aggregated"):
        learning.learning_table(df.union(df), ["sasa"])
    edges = spark.createDataFrame([("1", "P1"), ("1", "P3"), ("2", "P9")], "go_id string, uniprot string")
    assert [tuple(r) for r in learning.term_proteins(df, edges).collect()] == [("1", ["P1", "P3"])]


def test_structure_numbers(spark):
    residues = spark.createDataFrame([(s, i, "LYS" if i == 2 else "ALA") for s in "ABC" for i in (1, 2, 3)], "structure string, ordinal int, resname string")
    found = spark.createDataFrame([(s, i, "K" if i == 2 and s == "A" else "A", "HC-"[i - 1]) for s in "AB" for i in (1, 2, 3)] + [("C", 1, "A", "H")], "structure string, ordinal int, amino string, letter string")
    got, errors = curate.structure_numbers(residues, found, ("K",), F.col("resname") == "LYS")
    assert [(r["structure"], r["secondarystructure"]) for r in got.collect()] == [("A", 9)]
    assert {(r["path"], "1 residues" in r["error"]) for r in errors.collect()} == {("B", False), ("C", True)}


def test_error_files(spark, tmp_path):
    rows = [("propka 1", "a.pdb", "bad line"), ("sasa", "b.pdb", "two\nlines"), ("depth", None, None)]
    for part in (rows[:2], rows[2:]):
        tables.write_errors(spark.createDataFrame(part, "stage string, path string, error string"), f"{tmp_path}/errors")
    got = {tuple(r) for r in tables.read_errors(spark, f"{tmp_path}/errors").collect()}
    assert got == {("propka 1", "a.pdb", "bad line"), ("sasa", "b.pdb", "two\nlines"), ("depth", "", "")}


def test_row_slices_and_pruning(spark):
    df = spark.createDataFrame([(k, i, 1.0) for k in "ab" for i in range(5)], "Resid string, i int, sasa double")
    assert sorted(map(tuple, filters.first_rows(df, ["Resid"], ["i"], 2, skip=1).select("Resid", "i").collect())) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    table, features, gone = filters.prune_features(df.withColumn("Method", F.lit("NMR")), ["sasa", "Method", "aev"], ["Resid"])
    assert table.columns == ["Resid", "Method", "sasa"] and features == ["sasa"] and gone == ["aev"]


def test_fluctuations_by_hand(spark):
    """The query m12 against superpositions by numpy, one conformer after the other."""
    got = {r["resid"]: r["rmsf"] for r in QUERIES["m12_rmsf"](spark, "/root/testdata/sf0.01").collect()}
    a = standins.atoms(spark, "/root/testdata/sf0.01").withColumn("resid", F.col("resid") % 25).toPandas()
    points = {k: g.set_index(["resid", "name"])[["x", "y", "z"]] for k, g in a[a["name"].isin(["N", "CA", "C", "O"])].groupby("structure")}
    first, at = points[min(points)], {}
    for k, g in a[a["name"] == "NZ"].groupby("structure"):
        both = points[k].join(first, rsuffix="_q", how="inner").to_numpy()
        p, q = both[:, :3], both[:, 3:]
        u, _, vt = np.linalg.svd((p - p.mean(0)).T @ (q - q.mean(0)))
        turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        for resid, xyz in zip(g["resid"], g[["x", "y", "z"]].to_numpy(), strict=True):
            at.setdefault(resid, []).append((xyz - p.mean(0)) @ turn + q.mean(0))
    want = {k: np.sqrt(np.var(np.array(v), axis=0).sum()) for k, v in at.items() if len(v) > 1}
    assert want and {k: v for k, v in got.items() if v is not None} == pytest.approx(want, abs=2e-6) and set(got) == set(at)
