"""Distance joins on a grid of cells.

A point lies in the cell floor(xyz / c). Within distance c of it there are only points of its own and the 26
cells around, so a fixed-radius join is an equi-join on (structure, cell) after one side is
copied to the 27 cells. Nearest neighbours start with a c by the structure's density and repeat the points
that found none with c four times as large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

XYZ = ("x", "y", "z")


def _cell(c: float, p: str = "") -> list[Column]:
    return [F.floor(F.col(f"{p}{a}") / c) for a in XYZ]


def _renamed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])


def _d2() -> Column:
    return sum(((F.col(f"p_{a}") - F.col(f"q_{a}")) * (F.col(f"p_{a}") - F.col(f"q_{a}")) for a in XYZ), F.lit(0.0))


def pairs_within(left: DataFrame, right: DataFrame, c: float) -> DataFrame:
    """All pairs of one structure at most c apart: columns p_*, q_* and distance."""
    p = _renamed(left, "p_")
    for a, cell in zip(XYZ, _cell(c, "p_"), strict=True):
        p = p.withColumn(f"__{a}", F.explode(F.array(cell - 1, cell, cell + 1)))
    q = _renamed(right, "q_")
    for a, cell in zip(XYZ, _cell(c, "q_"), strict=True):
        q = q.withColumn(f"__q{a}", cell)
    on = (F.col("p_structure") == F.col("q_structure")) & (F.col("__x") == F.col("__qx")) & (F.col("__y") == F.col("__qy")) & (F.col("__z") == F.col("__qz"))
    return p.join(q, on).withColumn("distance", F.sqrt(_d2())).filter(F.col("distance") <= c).drop("__x", "__y", "__z", "__qx", "__qy", "__qz")


def _spacing(left: DataFrame, right: DataFrame, start: float | None) -> DataFrame:
    """(structure, c, extent): for each structure with right points the first radius, by their density, and what covers all points.

    The first radius is the side of a cube that holds eight points of the structure's box on average.
    """
    ends = right.groupBy("structure").agg(F.count("*").alias("n"), *[F.min(a).alias(f"lo_{a}") for a in XYZ], *[F.max(a).alias(f"hi_{a}") for a in XYZ])
    sides = [F.greatest(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(1e-3)) for a in XYZ]
    by_density = F.pow(8 * sides[0] * sides[1] * sides[2] / F.col("n"), F.lit(1 / 3))
    both = left.select("structure", *XYZ).unionByName(right.select("structure", *XYZ)).groupBy("structure")
    extent = both.agg(F.greatest(*[F.max(a) - F.min(a) for a in XYZ]).alias("extent"))
    return ends.join(extent, "structure").select("structure", (F.greatest(by_density, F.col("extent") / 1024) if start is None else F.lit(float(start))).alias("c"), "extent")


def nearest_distance(left: DataFrame, right: DataFrame, allowed: Column, key: list[str], start: float | None = None) -> DataFrame:
    """key -> least distance from a left point to a right point of the structure that `allowed` (on p_*, q_*) admits; null if there is none.

    Each round joins on cells as wide as the structure's radius, and only points that found nothing go on, with a radius four times as large, until it covers the structure. So dense structures
    have small cells and sparse ones large cells, and the many points with near partners never meet the rest. What a round found, and what is left, is written.
    """
    left, right = written(left), written(right)
    grid = _spacing(left, right, start)
    todo, found, i = left.join(grid, "structure"), None, 0
    q = _renamed(written(right.join(grid, "structure")), "q_")
    around = F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in zip((x, y, z), XYZ, strict=True)]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    while True:
        reach = 4.0**i
        p = _renamed(todo, "p_").withColumn("__d", F.explode(around))
        on = F.col("p_structure") == F.col("q_structure")
        for a in XYZ:
            on = on & (F.floor(F.col(f"p_{a}") / (F.col("p_c") * reach)) + F.col(f"__d.{a}") == F.floor(F.col(f"q_{a}") / (F.col("q_c") * reach)))
        near = p.join(q, on).withColumn("__distance", F.sqrt(_d2())).filter((F.col("__distance") <= F.col("p_c") * reach) & allowed)
        got = near.groupBy(*[F.col(f"p_{k}").alias(k) for k in key]).agg(F.min("__distance").alias("__distance"))
        state = written(todo.join(got, key, "left"))
        have = state.filter("__distance IS NOT NULL").select(*key, F.col("__distance").alias("distance")).distinct()
        found = have if found is None else found.unionByName(have)
        # at twice the extent, rounding cannot hide a point
        todo = state.filter(F.col("__distance").isNull() & (F.col("c") * reach < 2 * F.col("extent"))).drop("__distance")
        if todo.isEmpty():
            break
        i += 1
    return left.select(*key).distinct().join(found, key, "left")


# Residue codes of proteins (standard, other protonation states, modified), of water and of ions; metal elements; backbone atoms.
PROTEIN = (
    "ALA", "ARG", "CIR", "2MR", "AGM", "ASN", "MEN", "ASP", "ASH", "CYS", "CYX", "CSO", "CSD", "OCS", "CSX", "CME", "CSS", "SNC", "SMC", "CAS", "CAF",
    "GLN", "MEQ", "GLU", "GLH", "CGU", "GLY", "HIS", "HID", "HIE", "HIP", "HIC", "NEP", "ILE", "LEU", "NLE", "LYS", "LYSN", "LYN", "LYE", "KCX", "MLY", "MLZ", "M3L", "ALY", "LYR",
    "MET", "MSE", "OMT", "MHO", "PHE", "MEA", "PRO", "HYP", "SER", "SEP", "THR", "TPO", "TRP", "TRO", "TRQ", "0AF", "TYR", "PTR", "TYS", "NIY", "DAH", "TYY", "VAL",
)
WATERS = ("HOH", "WAT", "DOD", "H2O")
IONS = ("ZN", "NI", "CU", "FE", "MG", "MN", "NA", "K", "CA", "CO", "CL", "MO", "CD", "HG", "PT", "AU", "AG", "SR", "BA", "CS", "RB", "LI", "BR", "IOD", "F")
METALS = ("FE", "ZN", "CU", "MG", "MN", "NI", "CO", "MO", "CA", "NA", "K", "LI", "CD", "HG", "PT", "AU", "AG", "W", "V", "CR", "SR", "BA", "CS", "RB")
BACKBONE = ("N", "CA", "C", "O")
# End of the fixed values.


def _code(c: str) -> Column:
    return F.upper(F.trim(F.col(c)))


def heavy(atoms: DataFrame) -> DataFrame:
    return atoms.filter(~F.coalesce(F.col("element").isin("H", "D"), F.lit(False)))


def other_chain_distance(anchors: DataFrame, atoms: DataFrame, key: list[str], **options) -> DataFrame:
    """To the nearest heavy atom of a protein residue in another chain: water, ions and ligands are no chains. Null where there is none."""
    partners = heavy(atoms).filter(_code("resname").isin(*PROTEIN))
    # anchors whose structure has no other chain never enter the rounds
    chains = partners.groupBy("structure").agg(F.min("chain").alias("__c1"), F.max("chain").alias("__c2"))
    met = anchors.join(chains, "structure").filter((F.col("chain") != F.col("__c1")) | (F.col("chain") != F.col("__c2"))).drop("__c1", "__c2")
    near = nearest_distance(met, partners, F.col("p_chain") != F.col("q_chain"), key, **options)
    return anchors.select(*key).distinct().join(near, key, "left")


def terminus_distance(anchors: DataFrame, atoms: DataFrame, key: list[str]) -> DataFrame:
    """To any heavy atom of the first or last residue of any chain of the structure."""
    from .windows import chain_termini

    ends = chain_termini(atoms)
    tips = heavy(atoms).join(ends, ["structure", "chain"]).filter((F.col("resid") == F.col("first_resid")) | (F.col("resid") == F.col("last_resid"))).drop("first_resid", "last_resid")
    pairs = _renamed(anchors, "p_").join(_renamed(tips, "q_"), F.col("p_structure") == F.col("q_structure")).withColumn("distance", F.sqrt(_d2()))
    return anchors.select(*key).distinct().join(pairs.groupBy(*[F.col(f"p_{k}").alias(k) for k in key]).agg(F.min("distance").alias("distance")), key, "left")


def modelled_distance(anchors: DataFrame, atoms: DataFrame, key: list[str], **options) -> DataFrame:
    """Distance to the nearest built atom (occupancy 0), and whether the residue holds one."""
    built = heavy(atoms).filter("occupancy = 0")
    near = nearest_distance(anchors.join(built.select("structure").distinct(), "structure", "left_semi"), built, F.lit(True), key, **options)
    near = anchors.select(*key).distinct().join(near, key, "left")
    inside = atoms.groupBy("structure", "chain", "resid").agg(F.max(F.col("occupancy") == 0).alias("in_modelled_region"))
    where = anchors.select(*key, "structure", "chain", "resid").distinct() if "structure" not in key else anchors.select(*dict.fromkeys([*key, "chain", "resid"])).distinct()
    return where.join(inside, ["structure", "chain", "resid"], "left").join(near, key).select(*key, "distance", "in_modelled_region")


def neighbours(anchors: DataFrame, atoms: DataFrame, key: list[str], radius: float) -> DataFrame:
    got = pairs_within(anchors, atoms, radius).groupBy(*[F.col(f"p_{k}").alias(k) for k in key]).agg(F.count("*").alias("n_neighbours"))
    return anchors.select(*key).distinct().join(got, key, "left").fillna(0, ["n_neighbours"])


def clashes(atoms: DataFrame, ordinals: DataFrame, limit: float = 2.0, min_occupancy: float = 0.0) -> DataFrame:
    """Offending pairs p < q, by serial, closer than the limit.

    Not counted: one residue, backbones of residues next to each other, SG-SG, metals in any record and single-atom ions, rival
    alternate locations, and atoms with an occupancy below `min_occupancy` (none by default).
    """
    a = heavy(atoms).join(ordinals.select("structure", "chain", "resid", "ordinal"), ["structure", "chain", "resid"])
    p, q = (lambda c: F.col(f"p_{c}")), (lambda c: F.col(f"q_{c}"))
    same = (p("chain") == q("chain")) & (p("resid") == q("resid"))
    bonded = (p("chain") == q("chain")) & (F.abs(p("ordinal") - q("ordinal")) == 1) & p("name").isin(*BACKBONE) & q("name").isin(*BACKBONE)
    bridge = (p("name") == "SG") & (q("name") == "SG")
    metal = F.coalesce(_code("p_element").isin(*METALS), F.lit(False)) | F.coalesce(_code("q_element").isin(*METALS), F.lit(False)) | _code("p_resname").isin(*IONS) | _code("q_resname").isin(*IONS)
    rival = (p("altloc") != "") & (q("altloc") != "") & (p("altloc") != q("altloc"))
    faint = (p("occupancy") < min_occupancy) | (q("occupancy") < min_occupancy)
    pairs = pairs_within(a, a, limit).filter((p("serial") < q("serial")) & (F.col("distance") < limit))
    return pairs.filter(~(same | bonded | bridge | metal | rival | faint))


def geometry_summary(atoms: DataFrame, ordinals: DataFrame, limit: float = 2.0, reach: float = 4.0) -> DataFrame:
    """One row for each structure: counts, closest contact, worst pair and flags."""
    from ..functions.scalars import clash_text

    wide = clashes(atoms, ordinals, reach)
    hit = F.col("distance") < limit
    pairs = wide.groupBy(F.col("p_structure").alias("structure")).agg(
        F.count(F.when(hit, 1)).alias("n_clashes"), F.min("distance").alias("min_contact"),
        F.min_by(F.when(hit, clash_text("p_", "q_")), F.struct("distance", "p_serial", "q_serial")).alias("worst"),
        F.coalesce(F.max(hit & (F.col("p_chain") != F.col("q_chain"))), F.lit(False)).alias("inter_chain"),
        F.coalesce(F.max(hit & ((F.col("p_record") == "HETATM") | (F.col("q_record") == "HETATM"))), F.lit(False)).alias("involves_hetatm"),
        F.coalesce(F.max(hit & ((F.col("p_occupancy") == 0) | (F.col("q_occupancy") == 0))), F.lit(False)).alias("involves_modelled"),
        F.coalesce(F.max(hit & (_code("p_resname").isin(*WATERS) | _code("q_resname").isin(*WATERS))), F.lit(False)).alias("involves_water"),
    )
    whole = atoms.groupBy("structure").agg(F.count("*").alias("n_atoms"))
    out = whole.join(pairs, "structure", "left")
    return out.fillna(0, ["n_clashes"]).fillna(False, ["inter_chain", "involves_hetatm", "involves_modelled", "involves_water"])
