import json
import math

import pytest
from pyspark.sql import functions as F

from strandframe import registry, schema
from strandframe.operators import aggregate, collinear, curate, filters, joins, spatial, stats, windows
from strandframe.plans import plots
from strandframe.sources import tables, text
from strandframe.streaming import incremental


def pdb(record, serial, name, resname, chain, resid, x, y, z, occ=1.0, beta=0.0, element="C", alt=" ", icode=" "):
    return f"{record:<6}{serial:>5} {name:<4}{alt}{resname:>3} {chain}{resid:>4}{icode}   {x:>8.3f}{y:>8.3f}{z:>8.3f}{occ:>6.2f}{beta:>6.2f}          {element:>2}"


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdb")
    (folder / "1ABC-alt-1.pdb").write_text("\n".join([
        "SOURCE    MOL_ID: 1; ORGANISM_SCIENTIFIC: HOMO SAPIENS; ORGANISM_TAXID: 9606;",
        "REMARK 350 BIOMOLECULE: 1", "REMARK 350 SOFTWARE DETERMINED QUATERNARY STRUCTURE: DIMERIC", "REMARK 350 APPLY THE FOLLOWING TO CHAINS: A",
        "REMARK 350   BIOMT1   1  1.000000  0.000000  0.000000        0.00000", "REMARK 350   BIOMT2   1  0.000000  1.000000  0.000000        0.00000", "REMARK 350   BIOMT3   1  0.000000  0.000000  1.000000        0.00000",
        "REMARK 350   BIOMT1   2 -1.000000  0.000000  0.000000       10.00000", "REMARK 350   BIOMT2   2  0.000000 -1.000000  0.000000        0.00000", "REMARK 350   BIOMT3   2  0.000000  0.000000  1.000000        0.00000",
        pdb("ATOM", 1, "N", "LYS", "A", 1, 0, 0, 0, beta=10, element="N"), pdb("ATOM", 2, "CA", "LYS", "A", 1, 1, 0, 0, beta=20), pdb("ATOM", 3, "NZ", "LYS", "A", 1, 2, 0, 0, occ=0, beta=30, element="N"),
        pdb("ATOM", 4, "CB", "MSE", "A", 2, 5, 0, 0, alt="A", occ=0.4), pdb("ATOM", 5, "CB", "MSE", "A", 2, 5, 1, 0, alt="B", occ=0.6), "ATOM      6  SE  MSE A   2       6.000   0.000   0.000  x.xx  0.00          SE",
        pdb("ATOM", 7, "CA", "ALA", "B", 1, 9.5, 0, 0), pdb("HETATM", 8, "O", "HOH", "B", 90, 2.1, 0, 0, element="O"), "ENDMDL", pdb("ATOM", 1, "N", "LYS", "A", 1, 0, 0, 1, element="N"), "ENDMDL",
    ]))
    return text.read_lines(spark, str(folder))


def test_atoms(lines):
    rows = text.atoms(lines).orderBy("model", "serial").collect()
    assert [r["serial"] for r in rows] == [1, 2, 3, 4, 5, 6, 7, 8, 1]
    assert (rows[0]["structure"], rows[0]["chain"], rows[0]["resid"], rows[8]["model"]) == ("1ABC-alt-1", "A", 1, 2)
    assert rows[5]["occupancy"] == 1.0 and rows[3]["altloc"] == "A" and rows[1]["beta"] == 20
    assert text.header_organism(lines).collect()[0][1:] == ("HOMO SAPIENS", "9606")
    got = text.confidence_of(text.atoms(lines), ("LYS",)).filter("PLDDT > 0").collect()
    assert [(r["key"], r["PLDDT"]) for r in got] == [("A_1", 20.0)]


def test_curation(spark, lines):
    a = text.atoms(lines).filter("model = 1")
    assert {r["altloc"] for r in curate.pick_rotamers(a, "first").filter("serial in (4, 5)").collect()} == {""}
    assert [r["serial"] for r in curate.pick_rotamers(a, "first").filter("serial in (4, 5)").collect()] == [4]
    assert [r["serial"] for r in curate.pick_rotamers(a, "highest_occupancy").filter("serial in (4, 5)").collect()] == [5]
    assert sorted((r["serial"], r["conformer"]) for r in curate.pick_rotamers(a, "all").filter("serial in (4, 5, 6)").collect()) == [(4, "A"), (5, "B"), (6, "A"), (6, "B")]
    clean = {r["serial"]: (r["resname"], r["name"], r["element"]) for r in curate.clean(a, None).collect()}
    assert clean[6] == ("MET", "SD", "S") and clean[1][0] == "LYS"
    assert curate.pick_models(text.atoms(lines), 5, most=1).filter("model > 1").isEmpty()
    assert a.filter(curate.keep_hetero()).filter("resname = 'HOH'").isEmpty() and not a.filter(curate.keep_hetero(water=True)).filter("resname = 'HOH'").isEmpty()


def test_assembly(spark, lines):
    a, ops = text.atoms(lines).filter("model = 1 and record = 'ATOM'"), text.biomolecules(lines)
    assert [(r["op"], r["determined"], r["chains"]) for r in ops.orderBy("op").collect()] == [(1, "software", ["A"]), (2, "software", ["A"])]
    built, status = curate.build_assembly(a, ops)
    assert [r["status"] for r in status.collect()] == ["built"]
    at = {(r["chain"], r["serial"]): (r["x"], r["y"]) for r in built.collect()}
    assert {c for c, _ in at} == {"A", "B"} and at[("A", 2)] == (1, 0) and at[("B", 2)] == (9, 0) and ("B", 7) not in at
    assert [r["status"] for r in curate.build_assembly(a, ops, most_atoms=3)[1].collect()] == ["kept"]
    assert [r["status"] for r in curate.build_assembly(a, ops.filter("op = 0"))[1].collect()] == ["none"]


def test_distances(lines):
    a = text.atoms(lines).filter("model = 1")
    anchors = curate.anchor_atoms(a, *schema.anchors("Lysine"))
    key = ["structure", "chain", "resid"]
    assert spatial.other_chain_distance(anchors, a.filter("record = 'ATOM'"), key, start=1.0).collect()[0]["distance"] == pytest.approx(7.5)
    assert spatial.other_chain_distance(anchors, a.filter("chain = 'A'"), key).collect()[0]["distance"] is None
    near = spatial.modelled_distance(anchors, a, key).collect()[0]
    assert (near["distance"], near["in_modelled_region"]) == (0.0, True)
    assert spatial.geometry_summary(a, windows.residue_ordinals(a)).collect()[0]["inter_chain"] is True
    with pytest.raises(ValueError):
        schema.anchors("nothing")


def test_flexibility(spark):
    rows = [("s", "A", 1, 1.0, 10.0), ("s", "A", 2, 1.0, 20.0), ("s", "A", 3, 1.0, 30.0), ("s", "A", 4, 0.0, 99.0), ("t", "A", 1, 1.0, 5.0), ("t", "A", 2, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "structure string, chain string, resid int, occupancy double, beta double")
    for outliers in (False, True):
        got = {(r["structure"], r["resid"]): r["flexibility"] for r in aggregate.flexibility(df, outliers).collect()}
        assert got == {("s", 1): -1.0, ("s", 2): 0.0, ("s", 3): 1.0, ("s", 4): None, ("t", 1): None, ("t", 2): None}


def test_solver_outputs(spark):
    df = spark.createDataFrame([("f", 0, "   LYS  21 A     10.33       10.50"), ("f", 1, "   LYS  21 A     10.33       10.50"), ("f", 2, "   ASP   2 A      2.00"), ("f", 3, "atoms missing in LYS 12 A and LYS 13 B"), ("f", 4, "bad 14-LYS (C)"), ("f", 5, "LYS-33 B x 9.5"), ("f", 6, "P1 1 [1.0, 2.0] 3"), ("f", 7, "-----"), ("f", 8, "GO; GO:0030089; C:phycobilisome; IEA:X."), ("f", 9, "DR   PDB; 1ABC; X-ray; 1.50 A; A/C=1-100.")], "file string, line_no int, value string")
    assert [tuple(r) for r in text.pka_results(df, "LYS").collect()] == [("f", 21, "A", 10.33)]
    assert sorted(tuple(r) for r in text.pka_network(spark.createDataFrame([("f", 0, "LYS-33 B 9.5 1.0"), ("f", 1, "LYS  34 A 8.5"), ("f", 2, "LYS  34 A 8.5"), ("f", 3, "ASP-1 A 3.0"), ("f", 4, "LYS")], "file string, line_no int, value string"), "LYS").collect()) == [("f", 33, "B", 9.5), ("f", 34, "A", 8.5)]
    assert sorted((r["resid"], r["chain"]) for r in text.pka_errors(df.filter("line_no in (3, 4)"), "LYS").collect()) == [(12, "A"), (13, "B"), (14, "C")]
    assert [tuple(r) for r in text.log_measures(df.filter("line_no in (6, 7)"), ["Uniprot_Entry", "Resid", "aev", "x"]).collect()] == [("f", "P1", "1", "[1.0, 2.0]", "3")]
    assert [tuple(r)[:3] for r in text.ontology_lines(df).collect()] == [("f", "GO:0030089", "phycobilisome")]
    assert [tuple(r) for r in text.cross_references(df, "C").collect()] == [("f", "1ABC", "X-ray", "1.50", "C")]
    fasta = spark.createDataFrame([("s", ">1A_1|Chains K[auth M], L|NAME|X\nMK(MSE)U\nA\n")], "structure string, value string")
    assert sorted(tuple(r) for r in text.fasta_chains(fasta).collect()) == [("s", "K", "M", "MKMCA"), ("s", "L", "L", "MKMCA")]


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Unnamed: 0,Uniprot_Entry,Resid,propka,aev\n0,P1,1,NonTitratable,\"[1.0, 2.0]\"\n1,P1,2,10.5,\"[3, 4]\"\n")
    m = tables.read_measures(spark, str(tmp_path / "m.csv"), vectors=("aev",))
    assert [(r["propka"], r["propka_status"], r["aev"]) for r in m.orderBy("Resid").collect()] == [(None, "NonTitratable", [1.0, 2.0]), (10.5, None, [3.0, 4.0])]
    assert schema.features(m) == ["propka", "aev", "propka_status"]
    rec = tmp_path / "json"
    rec.mkdir()
    (rec / "1A.minimisation.json").write_text(json.dumps({"status": "failed", "reason": "big", "settings": {"forcefield": ["a", "b"], "max_iterations": 5}}))
    (rec / "2A.minimisation.json").write_text("{broken")
    flat, skipped = tables.read_minimisation(spark, str(rec))
    assert [(r["structure"], r["setting_forcefield"], r["setting_max_iterations"]) for r in flat.collect()] == [("1A", "a+b", 5)] and [tuple(r) for r in skipped.collect()] == [("1A", "big")]
    with pytest.raises(ValueError):
        tables.ontology_json(spark.createDataFrame([], "go_id string, name string, uniprot string"))
    logs, missing = tables.read_logs(spark, {"geometry": str(tmp_path / "none.csv")})
    assert logs == {} and missing == ["geometry"]
    tables.append_rows(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "log"), ["x", "y", "z"])
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [("a", "", "")]
    organisms = spark.createDataFrame([("e", "P1", [(["P2"], [("cat", 1)]), (["P1"], [("dog", 2), ("dog", 2)])]), ("f", "P9", [(["P2"], [("cat", 1)])])], "entry string, protein string, entities array<struct<uniprot_ids:array<string>,organisms:array<struct<name:string,id:int>>>>")
    assert [tuple(r)[2:] for r in tables.organism_names(organisms).orderBy("entry").collect()] == [("dog", "2"), ("cat", "1")]


def test_labels_and_pooling(spark):
    m = spark.createDataFrame([("P1", 1, "a", "relaxed"), ("P1", 2, None, "unrelaxed")], "Uniprot_Entry string, Resid int, class string, Source string")
    sites = spark.createDataFrame([("P1", 1)], "Uniprot_Entry string, Resid int")
    assert {r["Resid"]: r["class"] for r in joins.add_labels(m, sites, "yes").collect()} == {1: "yes", 2: "-1"}
    assert filters.drop_class(m, "a").count() == 1
    with pytest.raises(ValueError):
        filters.pool_sources(m, "some")
    with pytest.raises(KeyError):
        filters.choose_features(m, ["none"], ["class"])
    assert windows.best_weights(0.5, 3) == [1 / 3] * 3 and windows.best_weights(0.3, 2) == [0.3, 0.7] and windows.best_weights([1, 3], 2) == [0.25, 0.75]


def test_alignment_gaps(spark):
    df = spark.createDataFrame([("x", "MKV-LAYT", "-KVQ--YT")], "id string, target string, template string")
    assert [(r["first"], r["last"]) for r in windows.alignment_gaps(df).collect()] == [(4, 5)]
    assert sorted((r["first"], r["last"]) for r in windows.alignment_gaps(df, trim=False).collect()) == [(1, 1), (4, 5)]


def test_superposition(spark):
    pts = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0)]
    rows = [("k", *p, -p[1] + 1, p[0] + 2, p[2] + 3) for p in pts]  # a quarter turn and a shift
    got = stats.superpositions(spark.createDataFrame(rows, "k string, p_x double, p_y double, p_z double, q_x double, q_y double, q_z double"), ["k"]).collect()[0]
    assert got["rmsd"] == pytest.approx(0, abs=1e-6) and got["matrix"] == pytest.approx([0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3], abs=1e-9)


def test_accessible_area_of_one_atom(spark):
    one = spark.createDataFrame([("s", "A", 1, 1, "C", 0.0, 0.0, 0.0)], "structure string, chain string, resid int, serial int, element string, x double, y double, z double")
    assert stats.accessible_area(one, one).collect()[0]["sasa"] == pytest.approx(4 * math.pi * 3.1**2)


def test_vif_drops_the_copy(spark):
    df = spark.range(200).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("c", F.col("a") * 2 + F.col("b"))
    assert len(collinear.drop_collinear(df, ["a", "b", "c"])) == 2
    assert collinear.drop_collinear(df, ["a", "b"]) == ["a", "b"]


def test_pca(spark):
    df = spark.range(100).select(F.array(F.rand(3) * 10, F.rand(4) * 0.01, F.lit(1.0)).alias("v"))
    assert stats.fit_pca(df, "v", 0.99)[2] == 1
    with pytest.raises(ValueError):
        stats.fit_pca(df, "v", 1.5)


def test_plots(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (3.0,), (None,)], "x double")
    assert [(r["bin"], r["n"]) for r in plots.histogram(df, "x", 1.0).orderBy("bin").collect()] == [(0, 1), (1, 1)]


def test_incremental(spark, tmp_path):
    src, run = str(tmp_path / "src"), str(tmp_path / "run")
    spark.range(3).withColumn("v", F.lit(1)).write.parquet(src)
    schema_ = "id long, v int"
    for _ in range(2):
        incremental.run_new_files(spark, src, schema_, lambda d: d.withColumn("w", F.col("v") + 1), run, {"a": 1})
    assert spark.read.parquet(f"{run}/out").count() == 3
    with pytest.raises(ValueError, match="a"):
        incremental.run_new_files(spark, src, schema_, lambda d: d, run, {"a": 2})
    log = str(tmp_path / "log")
    assert incremental.read_latest(spark, log, ["id"], ["v"]) is None
    for v in (1, 2):
        spark.range(2).withColumn("v", F.lit(v)).write.mode("append").parquet(f"{src}2")
        incremental.upsert_latest(spark, spark.readStream.schema(schema_).parquet(f"{src}2"), log, ["id"], ["v"]).awaitTermination()
    assert sorted(tuple(r) for r in incremental.read_latest(spark, log, ["id"], ["v"]).collect()) == [(0, 2), (1, 2)]


def test_registry(spark):
    registry.register_feature("one", lambda a, k=1: a.select("structure", "chain", "resid").distinct().withColumn("one", F.lit(k)), defaults={"lysine": {"k": 5}})
    registry.register_feature("two", lambda a: a, supported=("cysteine",), reason="no sulphur")
    base = spark.createDataFrame([("s", "A", 1)], "structure string, chain string, resid int")
    got, dropped = registry.measure(base, base, ["one", "two", "three"], "lysine")
    assert [r["one"] for r in got.collect()] == [5] and dropped == {"two": "no sulphur", "three": "not registered"}
