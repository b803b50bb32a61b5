"""Tables for learning: class codes, feature columns and their rows' metadata."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import literal_map
from ..schema import features as feature_columns

#: Codes are bytes.
MOST_CODE = 127


def _number(column: str) -> Column:
    """The class as a number; null if it is a name."""
    x = F.expr(f"try_cast(`{column}` as double)")
    return F.when(~F.isnan(x), x)


def class_codes(df: DataFrame, column: str = "class") -> dict[str, int]:
    """The code of each class that is a name: sorted, and numbered from the largest number among the classes (2 at least) on. A missing class has the name 'nan'."""
    label = F.coalesce(F.col(column), F.lit("nan"))
    number = _number(column)
    top = df.agg(F.max(number)).first()[0]
    start = max(2, int(top) if top is not None else 2) + 1
    names = [r[0] for r in df.filter(number.isNull()).select(label.alias("name")).distinct().limit(MOST_CODE + 1).collect()]  # as many as there are codes
    if start + len(names) - 1 > MOST_CODE:
        raise ValueError(f"{len(names)} named classes from {start} on do not fit into a byte")
    return {n: start + i for i, n in enumerate(sorted(names))}


def class_number(codes: dict[str, int], column: str = "class") -> Column:
    label = F.coalesce(F.col(column), F.lit("nan"))
    named = literal_map(codes)[label] if codes else F.lit(None).cast("int")
    return F.coalesce(_number(column), named.cast("double")).cast("tinyint")


def term_proteins(df: DataFrame, edges: DataFrame) -> DataFrame:
    """(go_id, proteins) of the proteins in the table, for terms that have any."""
    return edges.join(df.select(F.col("Uniprot_Entry").alias("uniprot")).distinct(), "uniprot", "left_semi").groupBy("go_id").agg(F.array_sort(F.collect_set("uniprot")).alias("proteins"))


def learning_table(df: DataFrame, wanted: list[str], key: tuple = ("Uniprot_Entry", "Resid"), row_id: str | None = "row_id") -> tuple[DataFrame, list[str], list[str]]:
    """The rows as metadata, features and `y`; the names of the features, and of the metadata.

    A feature is a wanted name f or any column f_*. y is the class as a byte, -1 for all if there is no class column. A
    warning says if rows of one residue (and, with a Source, of one residue and source) repeat: then a model
    may be tested on what it has learnt.
    """
    every = feature_columns(df, row_id)
    names = [c for c in every if any(c == f or c.startswith(f"{f}_") for f in wanted)]
    metadata = [c for c in df.columns if c not in every and c not in ("class", row_id)]
    repeated = lambda columns: not df.groupBy(*columns).count().filter("count > 1").isEmpty()
    if "Source" in df.columns and repeated([*key, "Source"]):  # and so by the key alone
        warnings.warn("the table is not aggregated; split it by residue, or a model is tested on what it has learnt", UserWarning, stacklevel=2)
    y = class_number(class_codes(df)) if "class" in df.columns else F.lit(-1).cast("tinyint")
    return df.select(*[F.col(f"`{c}`") for c in (*metadata, *names)], y.alias("y")), names, metadata
