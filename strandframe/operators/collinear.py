"""Variance inflation over scalar and vector columns, and the elimination of collinear ones.

All sums of products come from one pass: a task adds up its Arrow batches to one square matrix, whose rows
Spark sums. The elimination takes one inverse and then a downdate for each column that goes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONSTANT = "const"
#: Rows multiplied at once.
BLOCK_ROWS = 4096
#: What is left unexplained of a column, as a share of it, below which it counts as a combination of the others.
EXACT = 1e-10


def matrix_columns(df: DataFrame, features: list[str]) -> tuple[Column, list[str]]:
    """One array of all features, those that are vectors component by component, and the names f or f_0, f_1, ... of its places."""
    vectors = [f for f in features if isinstance(df.schema[f].dataType, T.ArrayType)]
    widths = df.agg(*[F.max(F.size(f)).alias(f) for f in vectors]).first().asDict() if vectors else {}
    names = [n for f in features for n in ([f"{f}_{i}" for i in range(max(widths[f] or 0, 0))] if f in widths else [f])]
    parts = [F.col(f"`{f}`").cast("array<double>") if f in widths else F.array(F.col(f"`{f}`").cast("double")) for f in features]
    return F.concat(*parts), names


def _products(width: int):
    """The rows of X'X over a task's batches, X being [1, values]. Rows that lack a value or hold one that isn't finite have no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            column = batch.column("v")
            column = column.filter(column.is_valid())
            column = column.take(pa.array(np.flatnonzero(np.diff(column.offsets.to_numpy()) == width)))
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)  # a null component is NaN
            for i in range(0, len(flat), BLOCK_ROWS):
                x = np.column_stack([np.ones(len(flat[i : i + BLOCK_ROWS])), flat[i : i + BLOCK_ROWS]])
                x = x[np.isfinite(x).all(1)]
                total += x.T @ x
        lists = pa.ListArray.from_arrays(pa.array(np.arange(width + 2) * (width + 1), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1), pa.int32()), lists], names=["i", "row"])

    return run


def gram(df: DataFrame, features: list[str]) -> tuple[np.ndarray, list[str]]:
    """X'X of [1, features] over the complete rows, and the names of its columns but the first; columns of zeros only are left out."""
    values, names = matrix_columns(df, features)
    width = len(names)
    rows = df.select(values.alias("v")).mapInArrow(_products(width), "i int, row array<double>")
    summed = rows.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("s")).select("i", vector_to_array("s").alias("row")).collect()
    g = np.zeros((width + 1, width + 1))
    for r in summed:
        g[r["i"]] = r["row"]
    some = np.concatenate([[0], 1 + np.flatnonzero(np.diag(g)[1:] > 0)])
    return g[np.ix_(some, some)], [names[i - 1] for i in some[1:]]


def _unit(g: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(np.diag(g))
    return g * np.outer(scale, scale)


def _explained(g: np.ndarray) -> np.ndarray:
    """Which columns are combinations of the others: those with a part in a null direction."""
    values, vectors = np.linalg.eigh(_unit(g))
    null = vectors[:, values < EXACT * len(g)]
    return (null**2).sum(1) > EXACT


def _totals(g: np.ndarray, names: list[str]) -> np.ndarray:
    """Sums of squares of the columns, about the mean while the constant is in."""
    total = np.diag(g).copy()
    if CONSTANT in names:
        c = names.index(CONSTANT)
        total -= np.where(np.arange(len(g)) == c, 0, g[:, c] ** 2 / g[c, c])
    return total


def vif(g: np.ndarray, names: list[str]) -> dict[str, float]:
    """Variance inflation of each column: its total over what the others leave unexplained; infinite for exact combinations."""
    exact = _explained(g)
    out = dict.fromkeys(names, math.inf)
    keep = np.flatnonzero(~exact)
    if len(keep):
        # a column that is no combination is orthogonal to the null directions, so the inverse on the rest is its own
        scale = np.sqrt(np.diag(g))
        unexplained = 1 / np.diag(np.linalg.pinv(_unit(g), rcond=EXACT, hermitian=True))
        for i in keep:
            out[names[i]] = float(_totals(g, names)[i] / (unexplained[i] * scale[i] ** 2))
    return out


def eliminate(g: np.ndarray, names: list[str], threshold: float = 5.0) -> list[tuple[str, float]]:
    """(column, inflation) of the columns that go, in turn: the highest, of equals the last by name, until all are below the threshold or two columns are left.

    Columns that are exact combinations go first, each after a new decomposition; from then on an inverse is
    downdated for every column that goes.
    """
    names, gone = list(names), []
    while len(names) > 2:
        exact = _explained(g)
        if not exact.any():
            break
        worst = max(n for n, e in zip(names, exact, strict=True) if e)
        gone.append((worst, math.inf))
        i = names.index(worst)
        names.pop(i)
        g = np.delete(np.delete(g, i, 0), i, 1)
    scale = np.sqrt(np.diag(g))
    inverse = np.linalg.inv(_unit(g)) if len(names) > 2 else np.zeros((0, 0))
    while len(names) > 2:
        found = _totals(g, names) * np.diag(inverse) / scale**2
        i = max(range(len(names)), key=lambda j: (found[j], names[j]))
        if found[i] < threshold:
            break
        gone.append((names.pop(i), float(found[i])))
        inverse = inverse - np.outer(inverse[:, i], inverse[i]) / inverse[i, i]
        inverse, g = (np.delete(np.delete(m, i, 0), i, 1) for m in (inverse, g))
        scale = np.delete(scale, i)
    return gone


def inflation_table(df: DataFrame, features: list[str], threshold: float = 5.0) -> DataFrame:
    """(parameter, vif, dropped, vif_dropped) for the constant and each column: its inflation among all, when it goes (from 1), and its inflation then."""
    g, found = gram(df, features)
    names = [CONSTANT, *found]
    first, gone = vif(g, names), {n: (i, x) for i, (n, x) in enumerate(eliminate(g, names, threshold), 1)}
    rows = [(n, first[n], *gone.get(n, (None, None))) for n in names]
    return df.sparkSession.createDataFrame(rows, "parameter string, vif double, dropped int, vif_dropped double")


def drop_collinear(df: DataFrame, features: list[str], threshold: float = 5.0) -> list[str]:
    """The columns that stay: features, and components f_i of those that are vectors."""
    g, found = gram(df, features)
    gone = {n for n, _ in eliminate(g, [CONSTANT, *found], threshold)}
    return [n for n in found if n not in gone]
