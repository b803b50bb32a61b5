"""Queries of the readers, writers and runs. Their lines and files are made by Spark from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import registry, schema
from ..operators import curate as cu
from ..operators import joins as jn
from ..operators import stats as st
from ..shared import new_folder
from ..sources import logs as lg
from ..sources import tables as tb
from ..sources import text as tx
from ..streaming import incremental as inc
from . import standins as si
from .queries import query
from .standins import A, E, M

def _lines(df: DataFrame, file, *values) -> DataFrame:
    """(file, line_no, value) with one line for each of `values`, which are null where there is none."""
    return df.select(file.alias("file"), F.posexplode(F.array(*values)).alias("line_no", "value")).filter("value is not null")


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    return si.table(s, d, "supplier").join(si.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))


SUPPLIERS = "suppliers AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _supplier_file():
    return F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))


# tables
@query("s01_read_measures", "SELECT Uniprot_Entry, Resid, propka, CASE WHEN propka IS NULL THEN 'NonTitratable' END AS propka_status, sasa, sasa / 2 AS aev_1, depth AS aev_2 FROM measures", M)
def s01(s, d):
    path = f"{new_folder(s)}/measures.csv"
    vector = F.concat(F.lit("["), (F.col("sasa") / 2).cast("string"), F.lit(", "), F.col("depth").cast("string"), F.lit("]"))
    m = si.measures(s, d).select(F.col("Resid").alias("Unnamed: 0"), "Uniprot_Entry", "Resid", F.coalesce(F.col("propka").cast("string"), F.lit("NonTitratable")).alias("propka"), F.coalesce(F.col("sasa").cast("string"), F.lit("NaN")).alias("sasa"), vector.alias("aev"))
    m.write.option("header", True).csv(path)
    got = tb.read_measures(s, path, "`Unnamed: 0` int, Uniprot_Entry string, Resid int, propka string, sasa double, aev string", vectors=("aev",))
    return got.select("Uniprot_Entry", "Resid", "propka", "propka_status", "sasa", F.col("aev")[0].alias("aev_1"), F.col("aev")[1].alias("aev_2"))


@query("s02_resume_list", "SELECT DISTINCT Uniprot_Entry, PDB_Code, Method, 'protein' AS mode FROM measures", M)
def s02(s, d):
    path = f"{new_folder(s)}/structures"
    si.measures(s, d).select("Uniprot_Entry", "PDB_Code", "Method").write.option("header", True).csv(path)
    got, mode = tb.resume_list(s.read.option("header", True).csv(path))
    return got.withColumn("mode", F.lit(mode))


@query("s13_organisms", """SELECT entry, protein, coalesce(string_agg(n_name, '; ' ORDER BY pos), '') AS Organism_Name, coalesce(string_agg(CAST(n_nationkey AS VARCHAR), '; ' ORDER BY pos), '') AS Organism_TaxID FROM
 (SELECT entry, protein, n_name, n_nationkey, min(row(l_linenumber, l_suppkey)) AS pos FROM (SELECT o_orderkey AS entry, 'P' || CAST(o_custkey AS VARCHAR) AS protein, l_linenumber, l_suppkey, n_name, n_nationkey,
 bool_or(l_suppkey = o_custkey) OVER (PARTITION BY o_orderkey) AS known, l_suppkey = o_custkey AS mine FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN suppliers ON l_suppkey = s_suppkey) WHERE mine OR NOT known GROUP BY ALL) GROUP BY entry, protein""", SUPPLIERS)
def s13(s, d):
    x = si.table(s, d, "orders").join(si.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(_suppliers(s, d), F.col("l_suppkey") == F.col("s_suppkey"))
    name = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    one = F.struct("l_linenumber", "l_suppkey", F.array(name("l_suppkey")).alias("uniprot_ids"), F.array(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))).alias("organisms"))
    records = x.groupBy(F.col("o_orderkey").alias("entry"), name("o_custkey").alias("protein")).agg(F.array_sort(F.collect_list(one)).alias("entities"))
    return tb.organism_names(records)


# flat files and sequences
XREF = "SELECT DISTINCT Uniprot_Entry, PDB_Code, Method, CAST(Resid AS VARCHAR) || '.50' AS Resolution"


def _flat_file(s: SparkSession, d: str) -> DataFrame:
    m = si.measures(s, d)
    dr = F.format_string("DR   PDB; %s; %s; %d.50 A; F/%s=1-100.", "PDB_Code", "Method", "Resid", "Chain")
    return _lines(m, F.col("Uniprot_Entry"), F.lit("ID   X; Reviewed;"), F.lit("DR   PDB; none;"), dr)


query("s10_cross_references", f"{XREF}, 'F/' || Chain AS Chains FROM measures", M)(lambda s, d: tx.cross_references(_flat_file(s, d)).distinct())
query("s10_chain_references", f"{XREF}, 'O' AS Chains FROM measures WHERE Chain = 'O'", M)(lambda s, d: tx.cross_references(_flat_file(s, d), "O").distinct())


@query("s11_ontology_lines", """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS uniprot, 'GO:' || lpad(CAST(p_size AS VARCHAR), 7, '0') AS go_id, p_name AS name,
 p_size = arg_min(p_size, 'P' || CAST(p_partkey AS VARCHAR)) OVER (PARTITION BY p_name) AS names_code FROM part""")
def s11(s, d):
    go = F.format_string("DR   GO; GO:%07d; F:%s; IEA:UniProtKB.", "p_size", "p_name")
    return tx.ontology_lines(_lines(si.table(s, d, "part"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.lit("ID   X; Reviewed;"), go))


@query("s15_header_organism", "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS structure, CASE WHEN s_acctbal > 3000 THEN 'SYNTHETIC' ELSE n_name END AS organism, CAST(n_nationkey AS VARCHAR) AS taxid FROM suppliers", SUPPLIERS)
def s15(s, d):
    first = F.format_string("SOURCE    MOL_ID: 1; ORGANISM_SCIENTIFIC: %s; ORGANISM_TAXID: %d;", "n_name", "n_nationkey")
    second = F.when(F.col("s_acctbal") > 3000, F.lit("SOURCE   2 ORGANISM_SCIENTIFIC: SYNTHETIC;"))
    late = F.lit("SOURCE    MOL_ID: 2; ORGANISM_SCIENTIFIC: LATE; ORGANISM_TAXID: 1;")
    return tx.header_organism(_lines(_suppliers(s, d), _supplier_file(), first, second, F.lit("ATOM      1  N   LYS A   1"), late))


@query("s16_fasta_chains", """SELECT 'S' || CAST(p_partkey AS VARCHAR) AS structure, c.chain, c.author AS author_chain, 'KM' || replace(regexp_replace(upper(p_type), '[^A-Z]', '', 'g'), 'U', 'C') AS sequence
 FROM part, (VALUES ('A', 'X'), ('B', 'B')) c(chain, author)""")
def s16(s, d):
    body = F.regexp_replace(F.upper("p_type"), "[^A-Z]", "")
    text = F.concat(F.lit(">1_1|Chains A[auth X], B|NAME|Homo sapiens (9606)\n(KCX)(MSE)"), F.substring(body, 1, 3), F.lit("\n"), F.expr("substring(regexp_replace(upper(p_type), '[^A-Z]', ''), 4)"), F.lit("\n"))
    return tx.fasta_chains(si.table(s, d, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("structure"), text.alias("value")))


@query("s16_unknown_chains", "SELECT 'S' || CAST(p_partkey AS VARCHAR) AS structure, 'B' AS chain FROM part WHERE p_size > 25")
def s16_unknown(s, d):
    """Large parts lack a chain that their sequence file names."""
    names = F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("structure")
    fasta = tx.fasta_chains(si.table(s, d, "part").select(names, F.lit(">1_1|Chains A[auth X], B|NAME|Homo sapiens (9606)\nKM\n").alias("value")))
    rows = si.table(s, d, "part").select(names, F.explode(F.when(F.col("p_size") > 25, F.array(F.lit("X"))).otherwise(F.array(F.lit("X"), F.lit("B")))).alias("chain"))
    return tx.unknown_chains(fasta, rows).select("structure", "chain")


@query("s17_biomolecules", """SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS structure, b.b AS biomolecule, CASE WHEN b.b = 2 THEN 'unspecified' WHEN s_acctbal > 3000 THEN 'author' ELSE 'software' END AS determined, o.op,
 CASE b.b WHEN 1 THEN 'A/B' ELSE 'C' END AS chains, 1.0::DOUBLE AS m_1, CAST(CASE WHEN o.op = 1 THEN 0 ELSE s_nationkey END AS DOUBLE) AS m_4, CAST(o.op - 1 AS DOUBLE) AS m_12 FROM supplier, (VALUES (1), (2)) b(b), (VALUES (1), (2)) o(op)""")
def s17(s, d):
    def matrix(op, shift):
        row = lambda i, v, t: F.format_string(f"REMARK 350   BIOMT{i}   {op}  {v}  %12.5f", t.cast("double"))
        return [row(1, "1.000000  0.000000  0.000000", shift), row(2, "0.000000  1.000000  0.000000", F.lit(0)), row(3, "0.000000  0.000000  1.000000", F.lit(op - 1))]

    both = [*matrix(1, F.lit(0)), *matrix(2, F.col("s_nationkey"))]
    how = F.when(F.col("s_acctbal") > 3000, "REMARK 350 AUTHOR DETERMINED BIOLOGICAL UNIT: DIMERIC")
    lines = [F.lit("REMARK 350 BIOMOLECULE: 1"), how, F.lit("REMARK 350 SOFTWARE DETERMINED QUATERNARY STRUCTURE: DIMERIC"), F.lit("REMARK 350 APPLY THE FOLLOWING TO CHAINS: A, B"), *both]
    lines += [F.lit("REMARK 350 BIOMOLECULE: 2"), F.lit("REMARK 350 APPLY THE FOLLOWING TO CHAINS: C"), *both]
    got = tx.biomolecules(_lines(si.table(s, d, "supplier"), _supplier_file(), *lines))
    return got.select("structure", "biomolecule", "determined", "op", F.array_join("chains", "/").alias("chains"), *[F.col("matrix")[i - 1].alias(f"m_{i}") for i in (1, 4, 12)])


# coordinates
def _coordinate_lines(s: SparkSession, d: str) -> DataFrame:
    """Fixed-width lines of the stand-in atoms, coordinates cut to thousandths; a model ends after the 125th atom. Occupancies of zero are written as no number."""
    a = si.atoms(s, d).withColumn("n", F.row_number().over(Window.partitionBy("structure").orderBy("serial")))
    at = lambda c: F.floor(F.col(c) * 1000) / 1000
    occupancy = F.when(F.col("occupancy") > 0, F.format_string("%6.2f", "occupancy")).otherwise("  x.xx")
    line = F.format_string("%-6s%5d  %-3s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%s%6.2f          %2s", "record", "n", "name", F.when(F.col("altloc") == "", " ").otherwise(F.col("altloc")), "resname", "chain", (F.col("n") / 10).cast("int"), F.when(F.col("icode") == "", " ").otherwise(F.col("icode")), at("x"), at("y"), at("z"), occupancy, F.floor("beta") / 100, "element")
    both = a.select(F.col("structure").alias("file"), "n", F.posexplode(F.array(line, F.when(F.col("n") == 125, "ENDMDL"))).alias("i", "value")).filter("value is not null")
    return both.select("file", (F.col("n") * 2 + F.col("i")).alias("line_no"), "value")


NUMBERED = "numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY structure ORDER BY serial) AS INT) AS n FROM atoms)"
query("s14_coordinates", """SELECT structure, CASE WHEN n <= 125 THEN 1 ELSE 2 END AS model, n AS serial, record, name, altloc, resname, chain, n // 10 AS resid, icode, floor(x * 1000) / 1000 AS x, floor(y * 1000) / 1000 AS y, floor(z * 1000) / 1000 AS z,
 CASE WHEN occupancy = 0 THEN 1 ELSE occupancy END AS occupancy, floor(beta) / 100 AS beta, element FROM numbered""", A, NUMBERED)(lambda s, d: tx.atoms(_coordinate_lines(s, d)))
query("s23_confidence_of_atoms", "SELECT structure AS PDB_Code, chain AS Chain, n // 10 AS Resid, floor(beta) / 100 AS PLDDT, chain || '_' || CAST(n // 10 AS VARCHAR) AS key FROM numbered WHERE name = 'CA' AND resname IN ('LYS', 'CYS')", A, NUMBERED)(lambda s, d: tx.confidence_of(tx.atoms(_coordinate_lines(s, d)), ("LYS", "CYS")))


# solver outputs
def _solver_lines(s: SparkSession, d: str, *values) -> DataFrame:
    return _lines(si.measures(s, d), F.col("PDB_Code"), *values)


query("s18_pka_results", "SELECT DISTINCT PDB_Code AS structure, Resid AS resid, Chain AS chain, propka FROM measures WHERE propka IS NOT NULL", M)(
    lambda s, d: tx.pka_results(_solver_lines(s, d, F.format_string("   LYS %3d %s  %8.2f     10.50", "Resid", "Chain", "propka"), F.format_string("   ASP %3d %s  %8.2f", "Resid", "Chain", "sasa"), F.lit("       pKa  model-pKa")), "LYS")
)
query("s19_pka_errors", "SELECT DISTINCT PDB_Code AS structure, Resid AS resid, Chain AS chain FROM measures UNION SELECT PDB_Code, CAST(Resid + 100 AS INT), Chain FROM measures WHERE propka IS NULL", M)(
    lambda s, d: tx.pka_errors(_solver_lines(s, d, F.format_string("Missing atoms in LYS %d %s, see 900-LYS (Z)", "Resid", "Chain"), F.when(F.col("propka").isNull(), F.format_string("bad %d-LYS (%s)", F.col("Resid") + 100, "Chain")), F.lit("CYS 1 A is whole")), "LYS")
)
query("s20_pka_network", "SELECT DISTINCT PDB_Code AS structure, Resid AS resid, Chain AS chain, propka AS pkaANI FROM measures WHERE propka IS NOT NULL", M)(
    lambda s, d: tx.pka_network(_solver_lines(s, d, F.when(F.col("propka").isNotNull(), F.when(F.col("Chain") == "F", F.format_string("LYS-%d %s %.2f", "Resid", "Chain", "propka")).otherwise(F.format_string("LYS %3d %s %.2f", "Resid", "Chain", "propka"))), F.lit("ASP-1 A 3.0")), "LYS")
)


@query("s21_chemical_shifts", f"SELECT structure, chain, resid, beta AS legolas FROM atoms WHERE name = 'N' AND resname = CASE CAST(chain AS INT) {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(tx.SHIFT_CODES))} END", A)
def s21(s, d):
    n = si.atoms(s, d)
    row = F.row_number().over(Window.partitionBy("structure").orderBy("serial")) - 1
    results = n.filter("name = 'N'").select("structure", row.alias("row"), F.col("chain").cast("int").alias("res_id"), F.col("beta").alias("shift"))
    return tx.chemical_shifts(results, n)


@query("s22_log_measures", "SELECT PDB_Code AS file, Uniprot_Entry, CAST(Resid AS VARCHAR) AS Resid, '[' || CAST(CAST(seqcharge AS INT) AS VARCHAR) || ', 2]' AS aev, Chain FROM measures", M)
def s22(s, d):
    row = F.format_string("%s   %d  [%d, 2]  %s", "Uniprot_Entry", "Resid", F.round("seqcharge").cast("int"), "Chain")
    return tx.log_measures(_solver_lines(s, d, F.lit("protein resid aev chain"), F.lit("------- ----- --- -----"), row, F.lit("measured one residue")), ["protein", "resid", "aev", "chain"], {"protein": "Uniprot_Entry", "resid": "Resid", "chain": "Chain"})


# writers
@query("k01_sorted_measures", "SELECT Uniprot_Entry, Resid, PDB_Code, sasa FROM measures", M)
def k01(s, d):
    path = f"{new_folder(s)}/sorted"
    tb.write_sorted(si.measures(s, d).select("Uniprot_Entry", "Resid", "PDB_Code", "sasa"), path, ["Uniprot_Entry"])
    return s.read.parquet(path)


@query("k02_failures", "SELECT CAST(event_id AS VARCHAR) AS protein, CAST(user_id AS VARCHAR) AS structure, '' AS error FROM events WHERE event_type = 'error' UNION ALL SELECT CAST(event_id AS VARCHAR), '', event_type FROM events WHERE event_type <> 'error'")
def k02(s, d):
    path, e, columns = f"{new_folder(s)}/failures", si.table(s, d, "events"), ["protein", "structure", "error"]
    tb.append_rows(e.filter("event_type = 'error'").select(F.col("event_id").alias("protein"), F.col("user_id").alias("structure")), path, columns)
    tb.append_rows(e.filter("event_type <> 'error'").select(F.col("event_id").alias("protein"), F.col("event_type").alias("error")), path, columns)
    return s.read.parquet(path)


# structures
@query("j24_assembly", """SELECT structure, chain, serial, x, y, z FROM atoms UNION ALL
 SELECT structure, chr(CAST(64 + dense_rank() OVER (PARTITION BY structure ORDER BY chain) AS INT)), serial, x + 100, y, z - 50 FROM atoms""", A)
def j24(s, d):
    a = si.atoms(s, d)
    identity, moved = F.array(*[F.lit(float(v)) for v in cu.IDENTITY]), F.array(*[F.lit(float(v)) for v in (1, 0, 0, 100, 0, 1, 0, 0, 0, 0, 1, -50)])
    both = F.explode(F.array(F.struct(F.lit(1).alias("op"), identity.alias("matrix")), F.struct(F.lit(2).alias("op"), moved.alias("matrix"))))
    records = a.groupBy("structure").agg(F.collect_set("chain").alias("chains")).select("structure", F.lit(1).alias("biomolecule"), F.lit("author").alias("determined"), "chains", both.alias("o"))
    return cu.build_assembly(a, records.select("structure", "biomolecule", "determined", "o.op", "chains", "o.matrix"))[0].select("structure", "chain", "serial", "x", "y", "z")


TURN = (0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3)


@query("m13_superposition", f"SELECT structure, resid, {', '.join(f'CAST(CASE WHEN count(*) < 3 THEN {i} ELSE {t} END AS DOUBLE) AS m_{k + 1}' for k, (i, t) in enumerate(zip((1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0), TURN, strict=True)))}, CASE WHEN count(*) >= 3 THEN 0.0::DOUBLE END AS rmsd FROM atoms WHERE record = 'ATOM' OR name IN ('N', 'CA') GROUP BY ALL", A)
def m13(s, d):
    """A quarter turn and a shift come back from the pairs; residues with two atoms keep the identity."""
    a = si.atoms(s, d).filter("record = 'ATOM' or name in ('N', 'CA')")
    pairs = a.select("structure", "resid", F.col("x").alias("p_x"), F.col("y").alias("p_y"), F.col("z").alias("p_z"), (1 - F.col("y")).alias("q_x"), (F.col("x") + 2).alias("q_y"), (F.col("z") + 3).alias("q_z"))
    got = st.superpositions(pairs, ["structure", "resid"])
    return got.select("structure", "resid", *[(F.round(F.col("matrix")[k], 5) + F.lit(0.0)).alias(f"m_{k + 1}") for k in range(12)], F.round("rmsd", 3).alias("rmsd"))


# runs
@query("t01_resumed_run", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * 2 AS twice FROM lineitem")
def t01(s, d):
    """Files that come in two lots are measured by two runs, and a third run finds nothing new."""
    folder, li = new_folder(s), si.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    kind = li.drop("l_returnflag").schema
    for lot in ("l_returnflag = 'A'", "l_returnflag <> 'A'", None):
        if lot:
            li.filter(lot).drop("l_returnflag").write.mode("append").parquet(f"{folder}/in")
        inc.run_new_files(s, f"{folder}/in", kind, lambda x: x.withColumn("twice", F.col("l_extendedprice") * 2), f"{folder}/run", {"factor": 2})
    return s.read.parquet(f"{folder}/run/out")


@query("t02_latest_records", "SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type FROM events GROUP BY user_id")
def t02(s, d):
    """Batches of errors and of the rest; the latest record of each user stays, whichever batch it is in."""
    folder, e = new_folder(s), si.table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    for lot in ("event_type = 'error'", "event_type <> 'error'"):
        e.filter(lot).write.mode("append").parquet(f"{folder}/in")
        inc.upsert_latest(s, s.readStream.schema(e.schema).parquet(f"{folder}/in"), f"{folder}/run", ["user_id"], ["ts", "event_id"]).awaitTermination()
    return inc.read_latest(s, f"{folder}/run", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("t02_compacted_records", "SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type FROM events GROUP BY user_id")
def t02_compacted(s, d):
    """A batch for each type; the first ones are compacted, and their files removed, before the last comes."""
    folder, e = new_folder(s), si.table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    key, order = ["user_id"], ["ts", "event_id"]
    for lot in ("event_type = 'error'", "event_type = 'purchase'", "event_type NOT IN ('error', 'purchase')"):
        e.filter(lot).write.mode("append").parquet(f"{folder}/in")
        inc.upsert_latest(s, s.readStream.schema(e.schema).parquet(f"{folder}/in"), f"{folder}/run", key, order).awaitTermination()
        if "NOT" not in lot:
            inc.compact_latest(s, f"{folder}/run", key, order, delete=True)
    return inc.read_latest(s, f"{folder}/run", key, order).select("user_id", "event_id", "event_type")


@query("x02_registered_features", "SELECT structure, chain, resid, count(*) AS atoms_of, round(max(beta), 6) AS top_beta FROM atoms GROUP BY ALL", A)
def x02(s, d):
    key = ["structure", "chain", "resid"]
    registry.register_feature("atoms_of", lambda a: a.groupBy(*key).agg(F.count("*").alias("atoms_of")))
    registry.register_feature("top_beta", lambda a, digits=2: a.groupBy(*key).agg(F.round(F.max("beta"), digits).alias("top_beta")), defaults={"lysine": {"digits": 6}})
    registry.register_feature("no_lysines", lambda a: a, supported=("cysteine",), reason="not for lysine")
    a = si.atoms(s, d)
    return registry.measure(a, a.select(*key).distinct(), ["atoms_of", "top_beta", "no_lysines"], "lysine")[0]


@query("j23_ensemble_members", """SELECT protein, structure, count(*) OVER (PARTITION BY protein, chains) AS members FROM
 (SELECT l_suppkey AS protein, l_orderkey AS structure, string_agg(DISTINCT l_linestatus || CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linestatus || CAST(l_linenumber AS VARCHAR)) AS chains FROM lineitem GROUP BY 1, 2)""")
def j23(s, d):
    ca = si.table(s, d, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_orderkey").alias("structure"), F.lit("LYS").alias("resname"), F.col("l_linestatus").alias("chain"), F.col("l_linenumber").alias("resid")).distinct()
    signed = jn.ensemble_members(ca)
    return signed.join(signed.groupBy("protein", "signature").agg(F.count("*").alias("members")), ["protein", "signature"]).select("protein", "structure", "members")


@query("p07_feature_values", "SELECT 'depth' AS feature, count(depth) AS n FROM measures UNION ALL SELECT 'propka', count(propka) FROM measures UNION ALL SELECT 'sasa', count(sasa) FROM measures UNION ALL SELECT 'seqcharge', count(seqcharge) FROM measures", M)
def p07(s, d):
    m = si.measures(s, d)
    names = schema.features(m)
    return m.agg(*[F.count(c).alias(c) for c in names]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in names])).alias("x")).select("x.*")


# records of minimisations and assemblies: one for each supplier, some of them broken
BROKEN = "(s_suppkey % 7 = 3)"


def _records(s: SparkSession, d: str, record):
    made = _suppliers(s, d).withColumn("structure", _supplier_file())
    text = F.when(F.expr(BROKEN), '{"status": "rel').when(F.col("s_suppkey") % 11 == 5, "{}").otherwise(F.to_json(record, {"ignoreNullFields": "false"}))
    path = f"{new_folder(s)}/records"
    tb.write_records(made.select("structure", text.alias("value")), path)
    return path


def _minimised(s, d):
    bad = F.col("s_acctbal") < 0
    settings = F.struct(F.array(F.lit("amber14"), F.col("n_name")).alias("forcefield"), F.lit(10.5).alias("tolerance_kj_mol_nm"), F.col("s_nationkey").cast("int").alias("max_iterations"), (F.col("s_nationkey") > 9).alias("restrain_heavy_atoms"), F.lit(None).cast("double").alias("restraint_k_kcal_mol_a2"), F.lit("CPU").alias("platform"))
    return _records(s, d, F.struct(F.when(bad, "failed").otherwise("relaxed").alias("status"), F.when(bad, F.concat(F.lit("energy "), F.col("s_acctbal").cast("string"))).alias("reason"), F.lit("8.1").alias("openmm_version"), F.lit("2024-05-06T07:08:09").alias("date"), F.col("s_acctbal").alias("energy_final_kj_mol"), settings.alias("settings")))


GOOD = "NOT (s_suppkey % 7 = 3) AND s_suppkey % 11 <> 5"


@query("s05_minimisation_records", f"SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS structure, CASE WHEN s_acctbal < 0 THEN 'failed' ELSE 'relaxed' END AS status, CAST(TIMESTAMP '2024-05-06 07:08:09' AS VARCHAR) AS date, s_acctbal AS energy, 'amber14+' || n_name AS forcefield, CAST(s_nationkey AS INT) AS iterations, s_nationkey > 9 AS restrained FROM suppliers WHERE {GOOD}", SUPPLIERS)
def s05(s, d):
    flat, _ = tb.read_minimisation(s, _minimised(s, d))
    return flat.select("structure", "status", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("energy_final_kj_mol").alias("energy"), F.col("setting_forcefield").alias("forcefield"), F.col("setting_max_iterations").alias("iterations"), F.col("setting_restrain_heavy_atoms").alias("restrained"))


@query("s05_skipped_minimisations", f"SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS structure, substr(CAST(s_acctbal AS VARCHAR), 1, 2) AS energy FROM suppliers WHERE s_acctbal < 0 AND {GOOD}", SUPPLIERS)
def s05_skipped(s, d):
    return tb.read_minimisation(s, _minimised(s, d))[1].select("structure", F.substring(F.substring_index("reason", " ", -1), 1, 2).alias("energy"))


@query("s05_quarantine", "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS structure, CASE WHEN s_suppkey % 7 = 3 THEN 'not readable as a record' ELSE 'no status' END AS reason FROM supplier WHERE s_suppkey % 7 = 3 OR s_suppkey % 11 = 5")
def s05_quarantine(s, d):
    return tb.read_records(s, _minimised(s, d), tb.MINIMISATION, r"\.minimisation\.json")[1].select("structure", "reason")


@query("s06_assembly_records", f"SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS structure, CASE WHEN s_acctbal < 0 THEN 'kept' ELSE 'built' END AS status, 'A/B/' || substr(n_name, 1, 1) AS chains, '' AS measured_chains, CAST(s_nationkey AS INT) AS n_operators, CAST(s_regionkey AS INT) AS n_clashes FROM (SELECT *, n_regionkey AS s_regionkey FROM suppliers) WHERE {GOOD}", SUPPLIERS)
def s06(s, d):
    none = F.array().cast("array<string>")
    record = F.struct(F.lit(1).alias("biomolecule"), F.lit("author").alias("determined"), F.when(F.col("s_acctbal") < 0, "kept").otherwise("built").alias("status"), F.col("s_nationkey").cast("int").alias("n_operators"), F.array(F.lit("A")).alias("original_chains"), F.array(F.lit("A"), F.lit("B"), F.substring("n_name", 1, 1)).alias("chains"), none.alias("measured_chains"), F.col("n_regionkey").cast("int").alias("n_clashes"))
    return tb.read_assemblies(s, _records(s, d, record)).select("structure", "status", "chains", "measured_chains", "n_operators", "n_clashes")


# logs that name their columns: each supplier's has two headers, and rows without a column of theirs
@query("s22_recovered_log", """SELECT Uniprot_Entry, PDB_Code, Method, Chain, CAST(Resid AS VARCHAR) AS Resid, CASE WHEN Chain = 'F' THEN CAST(CAST(floor(sasa) AS INT) AS VARCHAR) END AS sasa,
  CASE WHEN Chain <> 'F' THEN '[' || CAST(CAST(floor(sasa) AS INT) AS VARCHAR) || ', -2.5]' END AS aev, CASE WHEN Chain <> 'F' THEN CAST(Resid AS VARCHAR) END AS seqcharge FROM measures WHERE NOT (Chain = 'F' AND Resid = 4)""", M)
def s22_recovered(s, d):
    return lg.recover_log(_log_lines(s, d))[0].select("Uniprot_Entry", "PDB_Code", "Method", "Chain", "Resid", "sasa", "aev", "seqcharge")


@query("s22_unread_rows", "SELECT Uniprot_Entry, count(*) AS n FROM measures WHERE Chain = 'F' AND Resid = 4 GROUP BY 1", M)
def s22_unread(s, d):
    return lg.recover_log(_log_lines(s, d))[1].groupBy(F.regexp_extract("value", r"(P\d+)", 1).alias("Uniprot_Entry")).agg(F.count("*").alias("n"))


def _log_lines(s, d):
    """A log for each protein: a header and its rows, then another header and rows with other columns; messages, dashes and numbers in front as logs have them."""
    m = si.measures(s, d).withColumn("whole", F.floor("sasa").cast("string"))
    first = F.col("Chain") == "F"
    begin = F.format_string("%d   %s  %s %s  -   %s  %d %s", F.lit(7), "Uniprot_Entry", "PDB_Code", "Method", "Chain", "Resid", "Source")
    row = F.when(first & (F.col("Resid") == 4), begin).when(first, F.concat_ws("  ", begin, F.col("whole"))).otherwise(F.concat_ws("  ", begin, F.concat(F.lit("["), F.col("whole"), F.lit(", -2.5]")), F.col("Resid").cast("string")))
    names = " ".join(lg.BASE_COLUMNS)
    lines = m.select("Uniprot_Entry", F.when(first, 0).otherwise(1).alias("half"), row.alias("row")).groupBy("Uniprot_Entry", "half").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    head = F.when(F.col("half") == 0, f"   {names}  sasa\n----  ---- ---").otherwise(f"{names} aev  seqcharge\nmeasuring goes on with the next structure of the run now\n")
    text = F.concat_ws("\n", head, F.array_join("rows", "\n"))
    path = f"{new_folder(s)}/log"
    lines.select("Uniprot_Entry", "half", text.alias("value")).repartition("Uniprot_Entry").sortWithinPartitions("Uniprot_Entry", "half").select("value").write.text(path)
    return lg.read_lines(s, path)


# runs that go on, and what they reuse
DONE = """log AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 200000 AND o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '-alt-' || CAST(o_orderkey AS VARCHAR) END AS code, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus <> 'O'),
done AS (SELECT DISTINCT code FROM log WHERE code <> (SELECT arg_max(code, row(o_orderdate, o_orderkey)) FROM log)),
still AS (SELECT CAST(c_custkey AS VARCHAR) AS code FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT code FROM done))"""


@query("j22_restart_structures", "SELECT CAST(o_custkey AS VARCHAR) || '-alt-' || CAST(o_orderkey AS VARCHAR) || '.pdb' AS file, CAST(o_custkey AS VARCHAR) || '-alt-' || CAST(o_orderkey AS VARCHAR) IN (SELECT code FROM done) AS ignored FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT code FROM still)", DONE)
def j22_structures(s, d):
    """A file for each order of a customer; finished orders are in the log, some under the customer's code alone."""
    o = si.table(s, d, "orders")
    name = F.concat(F.col("o_custkey").cast("string"), F.lit("-alt-"), F.col("o_orderkey").cast("string"))
    alone = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")
    log = o.filter("o_orderstatus <> 'O'").select(F.when(alone, F.col("o_custkey").cast("string")).otherwise(name).alias("code"), "o_orderdate", "o_orderkey")
    wanted = si.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("PDB_Code"))
    files = o.select(F.concat(name, F.lit(".pdb")).alias("file"))
    return jn.restart_structures(wanted, files, log, ["o_orderdate", "o_orderkey"])[1].select("file", "ignored")


@query("s09_written_ontology", "SELECT DISTINCT e.go_id, name, uniprot FROM edges e JOIN terms USING (go_id)", E)
def s09(s, d):
    path = f"{new_folder(s)}/ontology"
    tb.write_ontology(jn.terms_of(si.edges(s, d), si.terms(s, d)), path)
    return tb.read_ontology(s, path)


@query("x05_reused_components", None)
def x05(s, d):
    """Components fitted on measured structures, applied to predicted ones."""
    v = si.vectors(s, d)
    fitted = st.fit_pca(v.filter("Method <> 'Predicted'"), "aev", 5)
    return st.apply_pca(v.filter("Method = 'Predicted'"), "aev", fitted).select("vec_id", F.transform("pc", lambda x: F.round(F.abs(x), 6)).alias("pc"))
