"""Text files as rows: coordinates, flat files, sequences, solver outputs, logs.

`lines` is (file, line_no, value); read_lines gives it for whole folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row a line with its file's stem and number; files are split by Spark's text reader as wholes so that numbers hold."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[A-Za-z0-9]+$", "").alias("file"), F.split("value", "\r?\n").alias("v"))
    return whole.select("file", F.posexplode("v").alias("line_no", "value"))


def _cut(first: int, last: int) -> Column:
    return F.trim(F.substring("value", first, last - first + 1))


def atoms(lines: DataFrame) -> DataFrame:
    """Fixed-width coordinate records; an occupancy that is no number is 1."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    kept = lines.filter(F.substring("value", 1, 6).isin("ATOM  ", "HETATM", "ENDMDL")).withColumn("model", F.coalesce(F.sum(F.col("value").startswith("ENDMDL").cast("int")).over(w), F.lit(0)) + 1)
    text = {"record": (1, 6), "name": (13, 16), "altloc": (17, 17), "resname": (18, 20), "chain": (22, 22), "icode": (27, 27)}
    number = {"serial": (7, 11, "int"), "resid": (23, 26, "int"), "x": (31, 38, "double"), "y": (39, 46, "double"), "z": (47, 54, "double"), "beta": (61, 66, "double")}
    cols = [_cut(a, b).alias(c) for c, (a, b) in text.items()] + [_cut(a, b).try_cast(t).alias(c) for c, (a, b, t) in number.items()]
    occupancy = F.coalesce(_cut(55, 60).try_cast("double"), F.lit(1.0)).alias("occupancy")
    element = F.when(_cut(77, 78) != "", _cut(77, 78)).alias("element")
    return kept.filter(~F.col("value").startswith("ENDMDL")).select(F.col("file").alias("structure"), F.col("model").cast("int").alias("model"), *cols, occupancy, element)


def header_organism(lines: DataFrame) -> DataFrame:
    """Scientific name and taxonomy id from SOURCE records, the last before the first atom."""
    w = Window.partitionBy("file")
    first = F.coalesce(F.min(F.when(F.col("value").startswith("ATOM"), F.col("line_no"))).over(w), F.lit(2**31 - 1))
    head = lines.withColumn("__first", first).filter((F.col("line_no") < F.col("__first")) & F.col("value").startswith("SOURCE"))
    pick = lambda key: F.max_by(F.trim(F.regexp_extract("value", rf"{key}: *([^;]*)", 1)), F.when(F.col("value").contains(f"{key}:"), F.col("line_no")))
    return head.groupBy(F.col("file").alias("structure")).agg(pick("ORGANISM_SCIENTIFIC").alias("organism"), pick("ORGANISM_TAXID").alias("taxid"))


def cross_references(lines: DataFrame, chain: str | None = None) -> DataFrame:
    """PDB lines of protein flat files -> Uniprot_Entry (the file), PDB_Code, Method, Resolution, Chains; predicted rows are added by resolve_input."""
    f = F.split(F.regexp_extract("value", r"PDB;(.*)$", 1), ";")
    one = lines.filter(F.col("value").rlike(r"PDB;.*=")).select(F.col("file").alias("Uniprot_Entry"), F.trim(f[0]).alias("PDB_Code"), F.trim(f[1]).alias("Method"), F.split(F.trim(f[2]), " ")[0].alias("Resolution"), F.split(F.trim(F.element_at(f, -1)), "=")[0].alias("Chains"))
    return one if chain is None else one.filter(F.array_contains(F.split("Chains", "/"), chain)).withColumn("Chains", F.lit(chain))


def ontology_lines(lines: DataFrame) -> DataFrame:
    """GO lines of protein flat files -> uniprot, go_id, name; of equal names the first code wins."""
    m = lambda i: F.regexp_extract("value", r"GO; (GO:\d+); [CFP]:([^;]*);", i)
    found = lines.withColumn("go_id", m(1)).withColumn("name", m(2)).filter("go_id <> ''")
    first = found.groupBy("name").agg(F.min_by("go_id", F.struct("file", "line_no")).alias("first_id"))
    return found.join(first, "name").select(F.col("file").alias("uniprot"), "go_id", "name", (F.col("go_id") == F.col("first_id")).alias("names_code"))


def fasta_chains(text: DataFrame) -> DataFrame:
    """(structure, value) with a whole FASTA file -> structure, chain, author chain, sequence with standard letters."""
    entry = text.select("structure", F.explode(F.filter(F.split("value", ">"), lambda x: x != "")).alias("e"))
    head = F.regexp_extract("e", r"^([^\n]*)", 1)
    sequence = F.regexp_replace(F.regexp_replace("e", r"^[^\n]*\n?", ""), r"\s", "")
    sequence = F.translate(F.regexp_replace(F.regexp_replace(sequence, r"\(KCX\)", "K"), r"\(MSE\)", "M"), "U", "C")
    names = F.split(F.regexp_extract(head, r"\|Chains? ([^|]*)", 1), r",\s*")
    one = entry.select("structure", F.explode(names).alias("n"), sequence.alias("sequence"))
    plain = F.trim(F.regexp_replace("n", r"\[auth [^\]]*\]", ""))
    author = F.regexp_extract("n", r"\[auth ([^\]]*)\]", 1)
    return one.select("structure", plain.alias("chain"), F.when(author != "", author).otherwise(plain).alias("author_chain"), "sequence")


def unknown_chains(fasta: DataFrame, atom_rows: DataFrame) -> DataFrame:
    return fasta.join(atom_rows.select("structure", F.col("chain").alias("author_chain")).distinct(), ["structure", "author_chain"], "left_anti")


def biomolecules(lines: DataFrame) -> DataFrame:
    """REMARK 350 records -> structure, biomolecule, determined, op, chains, matrix (12 numbers)."""
    r = lines.filter(F.col("value").startswith("REMARK 350")).withColumn("t", F.substring("value", 11, 200))
    w = Window.partitionBy("file").orderBy("line_no")
    carry = lambda x: F.last(x, ignorenulls=True).over(w)
    num = lambda p: F.when(F.col("t").rlike(p), F.regexp_extract("t", p, 1))
    r = r.withColumn("biomolecule", carry(num(r"BIOMOLECULE: *(\d+)").cast("int")))
    within = Window.partitionBy("file", "biomolecule")
    how = F.when(F.max(F.col("t").contains("AUTHOR DETERMINED")).over(within), "author").when(F.max(F.col("t").contains("SOFTWARE DETERMINED")).over(within), "software").otherwise("unspecified")
    r = r.withColumn("determined", how)
    heads = F.col("t").rlike(r"CHAINS: ")
    block = F.sum(F.col("t").contains("APPLY THE FOLLOWING").cast("int")).over(w)
    r = r.withColumn("block", block)
    chains = r.filter(heads).groupBy("file", "biomolecule", "block").agg(F.flatten(F.collect_list(F.filter(F.split(F.regexp_extract("t", r"CHAINS: *(.*)$", 1), r"[,\s]+"), lambda x: x != ""))).alias("chains"))
    b = r.filter(F.col("t").rlike(r"BIOMT[123]")).withColumn("p", F.split(F.trim("t"), r"\s+"))
    rows = b.groupBy("file", "biomolecule", "determined", "block", F.col("p")[1].cast("int").alias("op")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("p")[0].alias("row"), F.transform(F.slice("p", 3, 4), lambda x: x.cast("double")).alias("v")))), lambda s: s["v"])).alias("matrix"))
    return rows.join(chains, ["file", "biomolecule", "block"]).select(F.col("file").alias("structure"), "biomolecule", "determined", "op", "chains", "matrix")


def pka_results(lines: DataFrame, code: str) -> DataFrame:
    """Lines '   LYS  21 A  10.3' -> structure, resid, chain, propka; distinct, by number."""
    m = lambda i: F.regexp_extract("value", rf"^   {code}\s+(-?\d+)\s+(\S+)\s+(-?[0-9.]+)", i)
    return lines.filter(F.col("value").rlike(rf"^   {code}\s")).select(F.col("file").alias("structure"), m(1).try_cast("int").alias("resid"), m(2).alias("chain"), m(3).try_cast("double").alias("propka")).dropna().dropDuplicates().orderBy("structure", "resid")


def pka_errors(lines: DataFrame, code: str) -> DataFrame:
    """Residues that an error log names: 'LYS 12 A', or '12-LYS (A)' where a line has none of the first."""
    one = F.regexp_extract_all("value", F.lit(rf"{code}\s+(-?\d+\s+\w)\b"), 1)
    two = F.regexp_extract_all("value", F.lit(rf"(-?\d+-{code} \(\w\))"), 1)
    hit = lines.select(F.col("file").alias("structure"), F.explode(F.when(F.size(one) > 0, one).otherwise(two)).alias("h"))
    return hit.select("structure", F.regexp_extract("h", r"(-?\d+)", 1).cast("int").alias("resid"), F.regexp_extract("h", r"(\w)\)?$", 1).alias("chain")).distinct()


def pka_network(lines: DataFrame, code: str) -> DataFrame:
    """Lines 'LYS  21 A  10.3' or 'LYS-21 A  10.3', code and one separator first -> structure, resid, chain, pkaANI; distinct."""
    p = F.split(F.trim(F.substring("value", len(code) + 2, 2**31 - 1)), r"\s+")
    found = lines.filter(F.col("value").startswith(code)).select(F.col("file").alias("structure"), p.alias("p"))
    return found.select("structure", F.get("p", F.lit(0)).try_cast("int").alias("resid"), F.get("p", F.lit(1)).alias("chain"), F.get("p", F.lit(2)).try_cast("double").alias("pkaANI")).dropna().distinct()


# Residue ids of the chemical-shift output, in its order.
SHIFT_CODES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
# End of the fixed values.


def chemical_shifts(results: DataFrame, atom_rows: DataFrame, order: tuple = SHIFT_CODES) -> DataFrame:
    """results (structure, row, res_id, shift) laid on the backbone N atoms by position; rows whose residue disagrees go."""
    n = atom_rows.filter("name = 'N'").withColumn("row", F.row_number().over(Window.partitionBy("structure").orderBy("serial")) - 1)
    code = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (i, c)]), F.col("res_id"))
    return results.join(n, ["structure", "row"]).filter(code == F.col("resname")).select("structure", "chain", "resid", F.col("shift").alias("legolas"))


def log_measures(lines: DataFrame, header: list[str], mapping: dict[str, str] | None = None) -> DataFrame:
    """Whitespace rows under a known header; bracketed vectors are one field, separators and other rows are ignored."""
    fields = F.regexp_extract_all("value", F.lit(r"(\[[^\]]*\]|\S+)"), 1)
    rows = lines.filter(~F.col("value").rlike(r"^[\s\-=+|]*$")).withColumn("f", fields).filter((F.size("f") == len(header)) & (F.col("f")[0] != header[0]))
    return rows.select("file", *[F.col("f")[i].alias((mapping or {}).get(h, h)) for i, h in enumerate(header)])


def confidence_of(atom_rows: DataFrame, codes: tuple) -> DataFrame:
    ca = atom_rows.filter((F.col("name") == "CA") & F.col("resname").isin(*codes))
    return ca.select(F.col("structure").alias("PDB_Code"), F.col("chain").alias("Chain"), F.col("resid").alias("Resid"), F.col("beta").alias("PLDDT"), F.concat_ws("_", "chain", F.col("resid").cast("string")).alias("key"))
