"""Row and column selections on measures and structure lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stem


def residue_rows(df: DataFrame, uniprot: str, resid: int) -> DataFrame:
    return df.filter((F.col("Uniprot_Entry") == uniprot) & (F.col("Resid") == resid))


def predicted_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Method") == "Predicted")


def extreme_values(df: DataFrame, feature: str, lower: float = 1, upper: float = 14) -> DataFrame:
    return df.filter((F.col(feature) < lower) | (F.col(feature) > upper))


def by_technique(df: DataFrame, methods: list[str]) -> DataFrame:
    return df.filter(F.col("Method").isin(methods))


def subset(df: DataFrame, proteins: tuple = (), chains: tuple = (), residues: tuple = ()) -> DataFrame:
    """Empty lists set no condition."""
    wanted = [(c, list(v)) for c, v in (("Uniprot_Entry", proteins), ("Chain", chains), ("Resid", residues)) if v]
    return reduce(lambda d, cv: d.filter(F.col(cv[0]).isin(cv[1])), wanted, df)


def in_box(bounds: dict[str, tuple[float, float]], inclusive: bool = True) -> Column:
    one = (lambda c, a, b: F.col(c).between(a, b)) if inclusive else (lambda c, a, b: (F.col(c) > a) & (F.col(c) < b))
    return reduce(lambda x, y: x & y, [one(c, a, b) for c, (a, b) in bounds.items()])


def choose_features(df: DataFrame, names: list[str] | None, known: list[str]) -> DataFrame:
    """Naming features drops the rows that miss one; none or ['all'] drops nothing."""
    if not names or names == ["all"]:
        return df
    if unknown := set(names) - set(known):
        raise KeyError(f"unknown features: {sorted(unknown)}")
    return df.dropna(subset=names)


def prune_features(df: DataFrame, wanted: list[str], key: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The table with key, PDB_Code, class, Method and the wanted features only; the features, without Method and Resolution; and those wanted that it doesn't have."""
    have = [f for f in wanted if f in df.columns]
    base = [c for c in df.columns if c in (*key, "PDB_Code", "class", "Method")]
    return df.select(*base, *[f for f in have if f not in base]), [f for f in have if f not in ("Method", "Resolution")], [f for f in wanted if f not in df.columns]


def first_rows(df: DataFrame, key: list[str], order: list[str], n: int, skip: int = 0) -> DataFrame:
    """Rows skip+1 .. skip+n of each key, in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter((F.col("__rn") > skip) & (F.col("__rn") <= skip + n)).drop("__rn")


def missing_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """One pass over the table; '' holds the number of rows."""
    return df.agg(F.count("*").alias(""), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first().asDict()


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "missing")


def drop_sparse(df: DataFrame, columns: list[str], most: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Drop features that miss on every row, or on more than the fraction `most`; the features that stay."""
    counts = missing_counts(df, columns)
    rows = counts[""]
    gone = [c for c in columns if rows and (counts[c] == rows or counts[c] / rows > most)]
    return df.drop(*gone), [c for c in columns if c not in gone]


def rows_with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    kept = df.dropna(subset=columns)
    if kept.isEmpty() and not df.isEmpty():
        counts = missing_counts(df, columns)
        worst = sorted(columns, key=lambda c: -counts[c])[:5]
        raise ValueError(f"every row misses a feature; the worst are {worst}")
    return kept


def pool_sources(df: DataFrame, how: str) -> tuple[DataFrame, bool]:
    """together, separate (Source joins the key), relaxed or unrelaxed."""
    if how in ("relaxed", "unrelaxed"):
        df = df.filter(F.col("Source") == how)
        if df.isEmpty():
            raise ValueError(f"no {how} structures")
    elif how not in ("together", "separate"):
        raise ValueError(f"unknown pooling {how!r}")
    return df, how == "separate"


def within_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    bounds = {c: b for c, b in (bounds or {"depth": (0, 20)}).items() if c in df.columns}
    return df.filter(in_box(bounds)) if bounds else df


def drop_class(df: DataFrame, label: str) -> DataFrame:
    return df.filter(~F.col("class").eqNullSafe(label)) if "class" in df.columns else df


def rename_class(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn("class", F.when(F.col("class") == old, new).otherwise(F.col("class"))) if "class" in df.columns else df


def source_of(name: Column) -> Column:
    return F.when(name.endswith("_relaxed"), "relaxed").otherwise("unrelaxed")


def prefer_relaxed(df: DataFrame, require: bool = False, name: str = "PDB_Code") -> DataFrame:
    """Drop originals that have a relaxed copy, or all originals."""
    relaxed = F.col(name).endswith("_relaxed")
    if require:
        return df.filter(relaxed)
    copies = df.filter(relaxed).select(stem(F.col(name)).alias("__stem")).distinct()
    return df.join(copies, ~relaxed & (F.col(name) == F.col("__stem")), "left_anti")


def drop_vectors(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c, kind in df.dtypes if kind.startswith("array")])
