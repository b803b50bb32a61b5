"""Which columns are keys, metadata and features."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Columns that are no features, their prefixes, and anchors of residues.
METADATA = ("Uniprot_Entry", "PDB_Code", "Method", "Resolution", "Chain", "Chains", "Resid", "Source", "Modified", "Min_Dist_Other_Chain", "Dist_To_Modelled", "Dist_To_Nearest_Terminus", "In_Modelled_Region", "class", "num_structures", "Organism_Name", "Organism_TaxID", "PLDDT")
LOG_PREFIXES = ("geometry_", "minimisation_", "assembly_")
ANCHORS = {"lysine": (("LYS",), ("NZ",)), "cysteine": (("CYS",), ("SG",)), "aspartate": (("ASP",), ("OD1", "OD2")), "glutamate": (("GLU",), ("OE1", "OE2")), "histidine": (("HIS",), ("ND1", "NE2")), "arginine": (("ARG",), ("NH1", "NH2")), "serine": (("SER",), ("OG",)), "threonine": (("THR",), ("OG1",)), "tyrosine": (("TYR",), ("OH",))}
#: Residue, its codes, codes of modified forms, anchor atoms, anchor atoms of modified forms.
PRESETS = (
    ("ALA", "ALA", "", "CB", "CB"),
    ("ARG", "ARG", "CIR 2MR AGM", "CZ", "CZ C7"),
    ("ASN", "ASN", "MEN", "ND2", "ND2"),
    ("ASP", "ASP ASH", "", "CG", "CG"),
    ("CYS", "CYS CYX", "CSO CSD OCS CSX CME CSS SNC SMC CAS CAF", "SG", "SG"),
    ("GLN", "GLN", "MEQ", "NE2", "NE2"),
    ("GLU", "GLU GLH", "CGU", "CD", "CD CD1"),
    ("GLY", "GLY", "", "CA", "CA"),
    ("HIS", "HIS HID HIE HIP", "HIC NEP", "NE2", "NE2"),
    ("ILE", "ILE", "", "CD1", "CD1"),
    ("LEU", "LEU", "NLE", "CG", "CG"),
    ("LYS", "LYS LYSN LYN", "LYE KCX MLY MLZ M3L ALY LYR", "NZ", "NZ N07"),
    ("MET", "MET", "MSE OMT MHO", "SD", "SD SE"),
    ("PHE", "PHE", "MEA", "CZ", "CZ"),
    ("PRO", "PRO", "HYP", "CG", "CG"),
    ("SER", "SER", "SEP", "OG", "OG"),
    ("THR", "THR", "TPO", "OG1", "OG1"),
    ("TRP", "TRP", "TRO TRQ 0AF", "NE1", "NE1"),
    ("TYR", "TYR", "PTR TYS NIY DAH TYY", "OH", "OH"),
    ("VAL", "VAL", "", "CB", "CB"),
)
# End of the fixed values.


def preset(residue: str) -> dict[str, tuple[str, ...]]:
    """Codes, modified codes and anchor atoms of a residue by its three letters, in any case."""
    found = [r[1:] for r in PRESETS if r[0] == residue.upper()]
    if not found:
        raise ValueError(f"unknown residue {residue!r}")
    return dict(zip(("codes", "modified", "atoms", "modified_atoms"), (tuple(x.split()) for x in found[0]), strict=True))


def features(df: DataFrame, row_id: str | None = "row_id") -> list[str]:
    return [c for c in df.columns if c not in METADATA and c != row_id and not c.startswith(LOG_PREFIXES)]


def scalar_features(df: DataFrame) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in features(df) if not kinds[c].startswith(("array", "map", "struct"))]


def residue_key(df: DataFrame, chain: bool = False, source: bool = False) -> list[str]:
    first = "Uniprot_Entry" if "Uniprot_Entry" in df.columns else "PDB_Code"
    return [c for c in [first, *["Chain"] * chain, "Resid", *["Source"] * source] if c in df.columns]


def anchors(choice: str | dict) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Residue codes and atom names of a preset (any case) or of a dict of codes and atoms."""
    if isinstance(choice, str):
        if choice.lower() not in ANCHORS:
            raise ValueError(f"unknown residue {choice!r}")
        return ANCHORS[choice.lower()]
    if not {"codes", "atoms"} <= set(choice):
        raise ValueError("a residue needs codes and atoms")
    return tuple(choice["codes"]), tuple(choice["atoms"])
