"""Column functions on names, codes and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Amino acids (three letters, one letter), charges, secondary-structure letters.
ONE_LETTER = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
STRUCTURE_LETTERS = ("H", "G", "I", "P", "E", "B", "T", "S", "-", "C")
CHARGES = {"K": 1, "H": 1, "R": 1, "D": -1, "E": -1}
# End of the fixed values.


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes NULL, as every aggregate expects."""
    return df.withColumns({f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def stem(name: Column) -> Column:
    """Structure name without the suffix of relaxed copies."""
    return F.regexp_replace(name, "_relaxed", "")


def entry_of(name: Column) -> Column:
    """Structure name without relaxed, conformer and file suffixes."""
    return F.regexp_replace(F.regexp_replace(stem(name), r"-alt.*$", ""), r"\.[A-Za-z0-9]+$", "")


def predicted_code(uniprot: Column, version: int = 6) -> Column:
    return F.concat(F.lit("AF-"), uniprot, F.lit(f"-F1-model_v{version}"))


def split_list(x: Column, separator: str = "/") -> Column:
    return F.filter(F.split(x, separator), lambda y: y != "")


def trimmed(x: Column) -> Column:
    """Text without the Unicode spaces (category Zs) at its ends; tabs and line ends stay."""
    return F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", "")


def decimal_number(x: Column) -> Column:
    """double of a decimal number, inf or nan, white space around it and single `_` between its digits allowed; else null. Java's `12d`, `12f` and `0x1p3` are no numbers."""
    digits = r"\d(?:_?\d)*+"
    number = rf"(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?"
    bare = F.regexp_replace(x, r"^[\t-\r ]*\+?|[\t-\r ]+\z|_", "")
    found = lambda p: x.rlike(rf"^[\t-\r ]*\+?-?(?:{p})[\t-\r ]*\z")
    return F.when(found(rf"{number}|(?i:inf(?:inity)?)"), bare.try_cast("double")).when(found(r"(?i:nan)(?:\(\w*\))?"), F.lit(float("nan")))


def parse_vector(x: Column) -> Column:
    """array<double> from JSON text, or from a list in brackets that is no JSON."""
    plain = F.transform(F.filter(F.split(F.regexp_replace(x, r"[\[\](){}]", " "), r"[,\s]+"), lambda y: y != ""), lambda y: y.try_cast("double"))
    return F.coalesce(F.from_json(x, "array<double>"), plain)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def affine(matrix: Column, xyz: list[Column]) -> list[Column]:
    """R x + t for a row-major array of twelve numbers."""
    return [sum((matrix[4 * i + j] * xyz[j] for j in range(3)), matrix[4 * i + 3]) for i in range(3)]


def one_letter(resname: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(ONE_LETTER), resname), F.lit("X"))


def charge(letter: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(CHARGES), letter), F.lit(0))


def confidence_band(x: Column) -> Column:
    """Bins of five, closed on the right, the first one on both sides; the text nan outside 0-100."""
    k = F.greatest(F.ceil(x / 5), F.lit(1))
    return F.when((x >= 0) & (x <= 100), F.concat_ws("-", ((k - 1) * 5).cast("string"), (k * 5).cast("string"))).otherwise("nan")


def chain_residue(chain: Column, resid: Column) -> Column:
    return F.concat_ws("_", chain, resid.cast("string"))


def ratio_text(n: Column, d: Column) -> Column:
    return F.concat(n.cast("string"), F.lit("/"), d.cast("string"))


def structure_number(letter: Column) -> Column:
    """Secondary-structure letter to 0-9; null for other letters."""
    return literal_map({x: i for i, x in enumerate(STRUCTURE_LETTERS)})[letter]


def clash_text(p: str, q: str) -> Column:
    side = lambda s: F.concat(F.col(f"{s}chain"), F.lit("/"), F.col(f"{s}resname"), F.col(f"{s}resid").cast("string"), F.lit(":"), F.col(f"{s}name"))
    return F.concat(side(p), F.lit(" <-> "), side(q))
