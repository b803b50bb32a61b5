"""Reduce the conformers of each residue to one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm
from .quantiles import quantiles

STATS = ("min", "max", "med", "avg", "sd", "range")
# Features that `mixmatch` takes at an extreme.
MIX_MAX = ("sasa", "das", "frustration", "seqcharge")
MIX_MIN = ("propka", "pkaANI", "depth", "density", "legolas")
# End of the fixed values.


def statistic(feature: str, name: str) -> Column:
    x = F.col(feature).cast("double")
    made = {"min": F.min(x), "max": F.max(x), "med": F.median(x), "avg": F.avg(x), "sd": F.stddev_pop(x), "range": F.max(x) - F.min(x)}
    return made[name].alias(f"{feature}_{name}")


def _keyed(df: DataFrame, key: list[str]) -> DataFrame:
    return df.dropna(subset=key)


def consensus_class() -> Column:
    """The one class of a group (missing counts as a value), else -1."""
    x = F.coalesce(F.col("class"), F.lit("\0"))
    return F.when((F.min(x) == F.max(x)) & (F.min(x) != "\0"), F.min(x)).otherwise("-1").alias("class")


def residue_statistics(df: DataFrame, key: list[str], features: list[str], stats: tuple = STATS, row_id: str | None = "row_id", seed: int = 7, by_ranks: bool = False) -> DataFrame:
    """Statistics of each feature, the class and the number of structures.

    With a row id also `<feature>_rand`, of one row drawn for all features by a seeded hash. A median holds the distinct values of its group in a task's memory; by_ranks
    takes medians from a range partitioning of all values instead, for residues too large for that.
    """
    ranked = by_ranks and "med" in stats
    aggs = [statistic(f, s) for f in features for s in stats if not (ranked and s == "med")]
    aggs.append(consensus_class() if "class" in df.columns else F.lit("-1").alias("class"))
    if row_id:
        aggs.append(F.min_by(F.struct(*features), F.struct(F.xxhash64(F.lit(seed), F.col(row_id)), F.col(row_id))).alias("__one"))
    rows = _keyed(df, key)
    # apart from the rest: beside a distinct count, Spark would keep each median's values by key and structure first
    counts = rows.select(*key, "PDB_Code").distinct().groupBy(*key).agg(F.count("PDB_Code").alias("num_structures"))
    out = rows.groupBy(*key).agg(*aggs).join(counts, key)
    if ranked:
        medians = quantiles(rows, key, features, [0.5]).groupBy(*key).agg(*[F.max(F.when(F.col("feature") == f, F.col("q")[0])).alias(f"{f}_med") for f in features])
        out = out.join(medians, key, "left")
    return out.select("*", *[F.col(f"__one.{f}").alias(f"{f}_rand") for f in features]).drop("__one") if row_id else out


def select_statistics(df: DataFrame, key: list[str], features: list[str], how: str, picks: dict[str, list[str]] | None = None) -> DataFrame:
    """The columns of one method: a statistic, minmax, minmaxavg, all, mixmatch or choose (with picks)."""
    base = [*key, "class", "num_structures"]
    one = {"random": "rand", "median": "med", "average": "avg"}
    many = {"minmax": ("min", "max"), "minmaxavg": ("min", "max", "avg"), "all": (*STATS, "rand")}
    if how == "mixmatch":
        wanted = [f"{f}_{'max' if f in MIX_MAX else 'min' if f in MIX_MIN else 'avg'}" for f in features]
    elif how == "choose":
        base = [*key, "class"]
        wanted = [f"{f}_{s}" for f, some in (picks or {}).items() for s in (("min", "max", "avg", "sd", "range", "rand") if some == ["all"] else some)]
    else:
        how = one.get(how, how)
        wanted = [f"{f}_{s}" for f in features for s in (many.get(how) or ((how,) if how in (*STATS, "rand") else many["minmax"]))]
    return df.select(*base, *[c for c in wanted if c in df.columns])


def vector_extremes(df: DataFrame, key: list[str], vector: str, row_id: str) -> DataFrame:
    """The vectors of least and largest norm of each group; the first row wins ties."""
    n = F.round(norm(F.col(vector)), 9)
    return _keyed(df, key).groupBy(*key).agg(F.min_by(F.struct(vector, row_id), F.struct(n, F.col(row_id))).alias("a"), F.max_by(F.struct(vector, row_id), F.struct(n, -F.col(row_id))).alias("b")).select(*key, F.col(f"a.{vector}").alias(f"{vector}_nearest"), F.col(f"a.{row_id}").alias("nearest_id"), F.col(f"b.{vector}").alias(f"{vector}_furthest"), F.col(f"b.{row_id}").alias("furthest_id"))


def representative_vector(df: DataFrame, key: list[str], vector: str, row_id: str) -> DataFrame:
    """That of the first predicted structure, else of the first one."""
    order = F.struct((~F.col("Method").eqNullSafe("Predicted")).alias("p"), F.col(row_id))
    return _keyed(df, key).groupBy(*key).agg(F.min_by(F.col(vector), order).alias(vector), F.min_by(F.col(row_id), order).alias("from_id"))


def vector_spread(df: DataFrame, vector: str) -> DataFrame:
    """(pos, sd, top): population deviation and largest magnitude of each vector column."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.stddev_pop("x").alias("sd"), F.max(F.abs("x")).alias("top"))


def widest_columns(df: DataFrame, vector: str, n: int = 100) -> DataFrame:
    return vector_spread(df, vector).orderBy(F.desc(F.round("sd", 12)), "pos").limit(n)


def keep_columns(df: DataFrame, vector: str, positions: list[int]) -> DataFrame:
    return df.withColumn(vector, F.array(*[F.col(vector)[p] for p in sorted(positions)]))


def drop_zero_columns(df: DataFrame, vector: str) -> DataFrame:
    kept = [r["pos"] for r in vector_spread(df, vector).filter("top > 0").collect()]  # one row a column
    return keep_columns(df, vector, kept)


def largest_entry(df: DataFrame, name: str, size: str) -> DataFrame:
    from ..functions.scalars import entry_of

    return df.groupBy(entry_of(F.col(name)).alias("entry")).agg(F.max(size).alias(size))


def is_aggregated(df: DataFrame, key: list[str]) -> bool:
    return df.groupBy(*key).count().filter("count > 1").isEmpty()


def flexibility(atoms: DataFrame, drop_outliers: bool = False) -> DataFrame:
    """Normalised B-factor of each residue: z over measured atoms with the sample deviation, mean over the residue.

    Null where an atom is an outlier or none is measured, and everywhere in predicted or flat structures.
    """
    w = Window.partitionBy("structure")
    live = F.col("occupancy") > 0
    a = atoms.withColumn("b", F.when(live, F.col("beta")))
    if drop_outliers:
        a = a.withColumn("__med", F.median("b").over(w)).withColumn("__mad", F.median(F.abs(F.col("b") - F.col("__med"))).over(w))
        a = a.withColumn("__out", (F.col("__mad") > 0) & (0.6745 * F.abs(F.col("b") - F.col("__med")) / F.col("__mad") > 3.5))
    else:
        a = a.withColumn("__out", F.lit(False))
    inner = F.when(~F.col("__out"), F.col("b"))
    a = a.withColumn("__mean", F.avg(inner).over(w)).withColumn("__sd", F.stddev_samp(inner).over(w))
    z = F.when(F.col("__sd") > 0, (F.col("b") - F.col("__mean")) / F.col("__sd"))
    return a.groupBy("structure", "chain", "resid").agg(F.when(~F.coalesce(F.max("__out"), F.lit(False)), F.avg(z)).alias("flexibility"))
