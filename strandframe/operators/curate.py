"""Rewrites of atom tables: cleaning, models, rotamers, numbering, assemblies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import affine

# Waters, and rewrites of modified residues.
WATERS = ("HOH", "WAT", "DOD")
SELENO = {"MSE": ("MET", "SD"), "SEC": ("CYS", "SG")}
CARBAMATE = ("CX", "OQ1", "OQ2")
BACKBONE = ("N", "CA", "C", "O")
# End of the fixed values.


def keep_hetero(water: bool = False, ions: tuple = (), ligands: str | tuple = ()) -> Column:
    """Whether a HETATM row stays; atoms of chains do."""
    r = F.col("resname")
    kept = F.when(F.col("element").isin("H", "D"), False).when(r.isin(*WATERS), water).when(r.isin(*ions) if ions else F.lit(False), True)
    return (F.col("record") != "HETATM") | kept.otherwise(F.lit(True) if ligands == "all" else r.isin(*ligands) if ligands else F.lit(False))


def clean(atoms: DataFrame, parents: DataFrame, keep: tuple = ()) -> DataFrame:
    """Standard residues only: selenium to sulphur, carbamates to lysine, the backbone of others under their parent.

    parents: (structure, resname, parent) as declared by the files. Hydrogens go. Codes in `keep` stay as they are.
    """
    r, n = F.col("resname"), F.col("name")
    a = atoms.filter(~F.coalesce(F.col("element"), F.substring(F.regexp_replace("name", "[0-9]", ""), 1, 1)).isin("H", "D"))
    a = a.join(parents, ["structure", "resname"], "left") if parents is not None else a.withColumn("parent", F.lit(None).cast("string"))
    free = ~r.isin(*keep) if keep else F.lit(True)
    a = a.filter(~(free & (r == "KCX") & n.isin(*CARBAMATE)))
    special = r.isin(*SELENO, "KCX")
    a = a.filter(~(free & ~special & F.col("parent").isNotNull() & ~n.isin(*BACKBONE)))
    seleno = free & r.isin(*SELENO) & (F.upper(n) == "SE")
    name = F.when(seleno & (r == "MSE"), SELENO["MSE"][1]).when(seleno, SELENO["SEC"][1]).otherwise(n)
    code = F.when(free & (r == "MSE"), "MET").when(free & (r == "SEC"), "CYS").when(free & (r == "KCX"), "LYS").when(free & F.col("parent").isNotNull(), F.col("parent")).otherwise(r)
    element = F.when(seleno, "S").otherwise(F.coalesce(F.col("element"), F.substring(F.regexp_replace("name", "[0-9]", ""), 1, 1)))
    changed = code != r
    return a.withColumn("element", element).withColumn("name", name).withColumn("record", F.when(changed, "ATOM").otherwise(F.col("record"))).withColumn("resname", code).drop("parent")


def without_insertions(atoms: DataFrame) -> DataFrame:
    bad = atoms.filter(F.coalesce(F.trim("icode"), F.lit("")) != "").select("structure").distinct()
    return atoms.join(bad, "structure", "left_anti")


def pick_models(atoms: DataFrame, how, most: int | None = None, representative: DataFrame | None = None) -> DataFrame:
    """all, a number (the first n), 'representative' (structure, model; else 1) or a list; never more than `most`."""
    cap = lambda n: n if most is None else min(n, most)
    if how == "all":
        return atoms if most is None else atoms.filter(F.col("model") <= most)
    if how == "representative":
        if representative is None:
            return atoms.filter("model = 1")
        chosen = representative.select("structure", F.col("model").alias("__m"))
        return atoms.join(chosen, "structure", "left").filter(F.col("model") == F.coalesce("__m", F.lit(1))).drop("__m")
    if isinstance(how, int):
        return atoms.filter(F.col("model") <= cap(how))
    return atoms.filter(F.col("model").isin(list(how)[: cap(len(how))]))


RESIDUE = ["structure", "model", "chain", "resid"]


def altloc_occupancy(atoms: DataFrame) -> DataFrame:
    return atoms.filter("altloc <> ''").groupBy(*RESIDUE, "altloc").agg(F.avg("occupancy").alias("occupancy"))


def pick_rotamers(atoms: DataFrame, how: str) -> DataFrame:
    """One conformer (first, highest_occupancy), or one for each letter of an ATOM record (all); adds `conformer`, empties the altloc of what is chosen.

    A structure without a letter on an ATOM record stays as it is. With `all`, a letter that stands on hetero atoms only is none of
    the conformers' letters: its atoms are in each of them, and keep it.
    """
    file = ["structure", "model"]
    letters = atoms.filter("record = 'ATOM' AND altloc <> ''").select(*file, F.col("altloc").alias("conformer")).distinct()
    if how == "all":
        own = letters.groupBy(*file).agg(F.collect_set("conformer").alias("__letters"))
        both = atoms.join(own, file, "left").withColumn("conformer", F.explode(F.coalesce("__letters", F.array(F.lit("")))))
        chosen = F.col("altloc") == F.col("conformer")
        kept = both.filter((F.col("altloc") == "") | chosen | F.col("__letters").isNull() | ~F.array_contains("__letters", F.col("altloc")))
        return kept.withColumn("altloc", F.when(chosen, "").otherwise(F.col("altloc"))).drop("__letters")
    rank = [F.col("altloc")] if how == "first" else [F.desc(F.round("occupancy", 9)), F.col("altloc")]
    some = atoms.join(letters.select(*file).distinct(), file, "left_semi")
    best = altloc_occupancy(some).withColumn("__rn", F.row_number().over(Window.partitionBy(*RESIDUE).orderBy(*rank))).filter("__rn = 1").select(*RESIDUE, F.col("altloc").alias("__best"))
    kept = atoms.join(best, RESIDUE, "left").filter((F.col("altloc") == "") | F.col("__best").isNull() | (F.col("altloc") == F.col("__best")))
    return kept.withColumns({"altloc": F.when(F.col("__best").isNull(), F.col("altloc")).otherwise(""), "conformer": F.lit("")}).drop("__best")


def fits_limits(atoms: DataFrame, most_chains: int = 62) -> tuple[DataFrame, DataFrame]:
    """Atoms of structures with at most so many chains, named by one letter; and the rejected structures with the reason."""
    per = atoms.groupBy("structure").agg(F.countDistinct("chain").alias("n_chains"), F.max(F.length("chain")).alias("longest"))
    bad = per.withColumn("reason", F.when(F.col("n_chains") > most_chains, "too many chains").when(F.col("longest") > 1, "chain name of two letters")).filter("reason is not null").select("structure", "reason")
    return atoms.join(bad, "structure", "left_anti"), bad


def small_gaps(atoms: DataFrame, most: int) -> DataFrame:
    from .windows import gap_profile

    gaps = gap_profile(atoms.filter("name = 'CA'"), ["structure", "chain"]).groupBy("structure").agg(F.max("largest_gap").alias("g"))
    return atoms.join(gaps.filter(F.col("g") > most), "structure", "left_anti")


def incomplete_residues(atoms: DataFrame, expected: DataFrame) -> DataFrame:
    """(structure, chain, resid, resname, missing): expected (resname, name) atoms that are not there."""
    seen = atoms.filter("record = 'ATOM'").select("structure", "chain", "resid", "resname").distinct().join(expected, "resname")
    gone = seen.join(atoms.select("structure", "chain", "resid", "name").distinct(), ["structure", "chain", "resid", "name"], "left_anti")
    return gone.groupBy("structure", "chain", "resid", "resname").agg(F.array_sort(F.collect_list("name")).alias("missing"))


def rename_chains(atoms: DataFrame, names: DataFrame) -> DataFrame:
    """names: (structure, chain, new)."""
    return atoms.join(names, ["structure", "chain"], "left").withColumn("chain", F.coalesce("new", "chain")).drop("new")


def renumber(atoms: DataFrame, numbers: DataFrame) -> DataFrame:
    """New residue numbers where a chain's every polymer atom has one; `numbering` says uniprot, mixed or author for the structure.

    numbers: (structure, chain, resid, new).
    """
    a = atoms.join(numbers, ["structure", "chain", "resid"], "left")
    polymer = F.col("record") == "ATOM"
    chain, whole = Window.partitionBy("structure", "chain"), Window.partitionBy("structure")
    a = a.withColumn("__ok", F.coalesce(F.min(F.when(polymer, F.col("new").isNotNull())).over(chain), F.lit(True)))
    a = a.withColumn("numbering", F.when(F.min("__ok").over(whole), "uniprot").when(F.max("__ok").over(whole), "mixed").otherwise("author"))
    return a.withColumn("resid", F.when(F.col("__ok"), F.coalesce("new", "resid")).otherwise(F.col("resid"))).drop("__ok", "new")


def failed_chains(atoms: DataFrame, numbers: DataFrame) -> DataFrame:
    a = atoms.filter("record = 'ATOM'").join(numbers, ["structure", "chain", "resid"], "left_anti")
    return a.groupBy("structure").agg(F.array_join(F.array_sort(F.collect_set("chain")), "/").alias("chains_author_numbering"))


def merge_hetero(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.filter("record <> 'HETATM'").unionByName(source.filter("record = 'HETATM'"))


def choose_biomolecule(records: DataFrame) -> DataFrame:
    """records: (structure, biomolecule, determined, op, chains, matrix); keeps those of the first author-determined, else of the lowest."""
    order = F.struct((F.col("determined") != "author").alias("a"), F.col("biomolecule"))
    best = records.groupBy("structure").agg(F.min(order).alias("__b")).select("structure", F.col("__b.biomolecule").alias("biomolecule"))
    return records.join(best, ["structure", "biomolecule"])


IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]
NAMES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def build_assembly(atoms: DataFrame, records: DataFrame, most_atoms: int = 99_999) -> tuple[DataFrame, DataFrame]:
    """Atoms of the chosen assemblies, and (structure, status): built, identity, none or kept.

    The first copy of a chain keeps its name, further ones get names that are not in use.
    """
    ops = choose_biomolecule(records)
    chains = atoms.groupBy("structure", "chain").agg(F.count("*").alias("n"))
    use = ops.select("structure", "op", F.explode("chains").alias("chain"), "matrix").join(chains, ["structure", "chain"])
    w = Window.partitionBy("structure", "chain").orderBy("op")
    use = use.withColumn("copy", F.row_number().over(w))
    plan = use.groupBy("structure").agg(F.sum("n").alias("atoms"), F.count("*").alias("copies"), F.max("copy").alias("deep"), F.min(F.col("matrix") == F.array(*[F.lit(float(x)) for x in IDENTITY])).alias("still"), F.collect_set("chain").alias("used"))
    have = chains.groupBy("structure").agg(F.count("*").alias("all_chains"), F.collect_set("chain").alias("names"))
    status = have.join(plan, "structure", "left").join(ops.select("structure").distinct().withColumn("__r", F.lit(True)), "structure", "left")
    kind = F.when(F.col("__r").isNull(), "none").when(F.col("copies").isNull() | (F.col("atoms") > most_atoms) | (F.col("copies") > len(NAMES)), "kept")
    kind = kind.when(F.col("still") & (F.col("deep") == 1) & (F.size("used") == F.col("all_chains")), "identity").otherwise("built")
    status = status.select("structure", kind.alias("status"), F.array_except(F.split(F.lit(NAMES), ""), "used").alias("free"))
    use = use.join(status.filter("status = 'built'"), "structure")
    extra = F.row_number().over(Window.partitionBy("structure", F.col("copy") == 1).orderBy("chain", "op"))
    use = use.withColumn("new", F.when(F.col("copy") == 1, F.col("chain")).otherwise(F.get(F.filter("free", lambda x: x != ""), extra - 1)))
    made = atoms.join(use.select("structure", "chain", "matrix", "new"), ["structure", "chain"])
    moved = affine(F.col("matrix"), [F.col("x"), F.col("y"), F.col("z")])
    made = made.withColumns({"__x": moved[0], "__y": moved[1], "__z": moved[2]}).withColumns({"x": F.col("__x"), "y": F.col("__y"), "z": F.col("__z"), "chain": F.col("new")})
    rest = atoms.join(status.filter("status <> 'built'").select("structure"), "structure", "left_semi")
    return made.select(*atoms.columns).unionByName(rest), status.select("structure", "status")


def structure_numbers(residues: DataFrame, found: DataFrame, expected: tuple, of_interest: Column) -> tuple[DataFrame, DataFrame]:
    """residues and found letters (structure, ordinal, amino, letter) -> residues of interest with `secondarystructure` (0-9), and error records.

    A structure for which as many letters were not found as it has residues, or one of whose residues of interest is none of
    the `expected` amino acids by the found sequence, gets no values but an error (stage, path, error).
    """
    from ..functions.scalars import structure_number

    n, m = residues.groupBy("structure").agg(F.count("*").alias("n")), found.groupBy("structure").agg(F.count("*").alias("m"))
    counts = n.join(m, "structure", "left").withColumn("m", F.coalesce("m", F.lit(0))).filter("n <> m")
    rows = residues.join(counts, "structure", "left_anti").filter(of_interest).join(found, ["structure", "ordinal"])
    other = rows.filter(~F.col("amino").isin(*expected)).select("structure").distinct()
    message = F.concat(F.col("m").cast("string"), F.lit(" residues found, but the structure has "), F.col("n").cast("string"))
    record = lambda df, text: df.select(F.lit("secondarystructure").alias("stage"), F.col("structure").alias("path"), text.alias("error"))
    errors = record(counts, message).unionByName(record(other, F.lit("a residue of interest is another one in the sequence found")))
    good = rows.join(other, "structure", "left_anti")
    return good.withColumn("secondarystructure", structure_number(F.col("letter"))).drop("amino", "letter"), errors


def measured_chains(df: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Rows of chains declared for the protein (Chains, '/') and listed by the structure's assembly record, if it has one."""
    from ..functions.scalars import split_list

    right = assemblies.select(F.col("structure").alias("PDB_Code"), split_list(F.col("measured_chains")).alias("__m"))
    out = df.join(right, "PDB_Code", "left")
    declared = F.array_contains(split_list(F.col("Chains")), F.col("Chain"))
    return out.filter(declared & (F.col("__m").isNull() | F.array_contains("__m", F.col("Chain")))).drop("__m")


def anchor_atoms(atoms: DataFrame, codes: tuple, names: tuple, modified: tuple = (), modified_names: tuple | None = None) -> DataFrame:
    """The first anchor atom of each residue of interest; `modified` codes count as well, with anchors of `modified_names` (by default `names`)."""
    plain = F.col("resname").isin(*codes) & F.col("name").isin(*names)
    changed = F.col("resname").isin(*modified) & F.col("name").isin(*(names if modified_names is None else modified_names)) if modified else F.lit(False)
    hit = atoms.filter(plain | changed).withColumn("Modified", F.col("resname").isin(*modified) if modified else F.lit(False))
    return hit.withColumn("__rn", F.row_number().over(Window.partitionBy("structure", "chain", "resid").orderBy("serial"))).filter("__rn = 1").drop("__rn")


def preset_anchors(atoms: DataFrame, residue: str, include_modified: bool = True) -> DataFrame:
    """Anchor atoms by a residue's preset, of its modified forms too unless told otherwise."""
    from ..schema import preset

    p = preset(residue)
    return anchor_atoms(atoms, p["codes"], p["atoms"], p["modified"] if include_modified else (), p["modified_atoms"])
