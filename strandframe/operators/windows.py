"""Windows over residues, chains and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def row_position(df: DataFrame, key: list[str], row_id: str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(row_id)))


def residue_ordinals(atoms: DataFrame) -> DataFrame:
    """(structure, chain, resid, ordinal) in first-seen order."""
    seen = atoms.groupBy("structure", "chain", "resid").agg(F.min("serial").alias("first_serial"))
    return seen.withColumn("ordinal", F.dense_rank().over(Window.partitionBy("structure", "chain").orderBy("first_serial")))


def chain_termini(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("structure", "chain").agg(F.min_by("resid", "serial").alias("first_resid"), F.max_by("resid", "serial").alias("last_resid"))


# Direction in which a feature is better.
LOW_IS_BETTER = ("propka", "pkaANI", "legolas", "depth")
HIGH_IS_BETTER = ("sasa", "das", "seqcharge", "frustration")
# End of the fixed values.


def best_weights(weights, n: int) -> list[float]:
    """Weights of n features: one number gives equal shares or, for two features, w and 1 - w; lists are padded or cut and then rescaled to two places.

    A list of n weights that sum to 1 stays as it is.
    """
    if isinstance(weights, (int, float)):
        return [weights, 1 - weights] if n == 2 and weights != 0.5 else [1 / n] * n
    given = list(weights)
    if len(set(given)) <= 1:
        return [1 / n] * n
    if len(given) == n and sum(given) == 1:
        return given
    given = (given + [1 / n] * (n - len(given)))[:n]
    return [round(w / sum(given), 2) for w in given]


def relative_best(df: DataFrame, key: list[str], weights, features: dict[str, str | None], row_id: str) -> DataFrame:
    """The row of each residue with the best weighted sum of z-scores; the last row wins ties.

    features: name to 'min' or 'max', None for the usual direction. Means, deviations and the best row are aggregations, so that rows of a hot
    residue are never sorted in one task.
    """
    df = df.dropna(subset=list(features))
    stats = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(*[g(f).alias(f"__{n}_{f}") for f in features for n, g in (("mean", F.avg), ("sd", F.stddev_pop))])
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    score: Column = F.lit(0.0)
    for (f, how), weight in zip(features.items(), best_weights(weights, len(features)), strict=True):
        how = how or ("min" if f in LOW_IS_BETTER else "max" if f in HIGH_IS_BETTER else None)
        if how is None:
            raise ValueError(f"no direction for {f}")
        above = F.col(f) - F.col(f"__mean_{f}") if how == "max" else F.col(f"__mean_{f}") - F.col(f)
        score = score + weight * F.when(F.col(f"__sd_{f}") > 1e-12, above / F.col(f"__sd_{f}")).otherwise(0.0)
    scored = df.join(stats, same).select(*df.columns, F.round(score, 9).alias("score"))
    best = F.max_by(F.struct(*scored.columns), F.struct("score", row_id)).alias("__best")
    return scored.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(best).select("__best.*")


def sliding_sum(df: DataFrame, key: list[str], order: list[str], x: str, reach: int = 10, alias: str = "seqcharge") -> DataFrame:
    return df.withColumn(alias, F.sum(x).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(-reach, reach)))


def gap_profile(residues: DataFrame, key: list[str], resid: str = "resid") -> DataFrame:
    """Gaps between observed numbers, missing numbers and the largest gap of each group."""
    d = residues.select(*key, resid).distinct()
    gap = F.col(resid) - F.lag(resid).over(Window.partitionBy(*key).orderBy(resid)) - 1
    return d.withColumn("gap", gap).groupBy(*key).agg(F.count(F.when(F.col("gap") > 0, 1)).alias("n_gaps"), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("missing"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("largest_gap"))


def islands(df: DataFrame, key: list[str], order: str, flag: Column) -> DataFrame:
    """First and last position of each run of rows that meet `flag`; order holds consecutive numbers."""
    run = F.col(order) - F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.filter(flag).withColumn("__run", run).groupBy(*key, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__run")


def alignment_columns(pairs: DataFrame) -> DataFrame:
    """(id, target, template) aligned strings -> one row a column with running positions; null where there is a gap."""
    each = pairs.select("id", F.posexplode(F.arrays_zip(F.split("target", "").alias("t"), F.split("template", "").alias("s"))).alias("col", "x")).select("id", "col", "x.*").filter("t <> '' or s <> ''")
    w = Window.partitionBy("id").orderBy("col")
    count = lambda c: F.when(F.col(c) != "-", F.sum(F.when(F.col(c) != "-", 1).otherwise(0)).over(w))
    return each.withColumn("target_pos", count("t")).withColumn("template_pos", count("s"))


def alignment_gaps(pairs: DataFrame, trim: bool = True) -> DataFrame:
    """Ranges of target positions without template; leading and trailing ones go if trimmed."""
    c = alignment_columns(pairs).filter("target_pos is not null")
    runs = islands(c, ["id"], "target_pos", F.col("template_pos").isNull())
    if not trim:
        return runs
    ends = c.filter("template_pos is not null").groupBy("id").agg(F.min("target_pos").alias("a"), F.max("target_pos").alias("b"))
    return runs.join(ends, "id").filter((F.col("first") > F.col("a")) & (F.col("last") < F.col("b"))).drop("a", "b")


def gaps_over(pairs: DataFrame, cutoff: int, trim: bool = True) -> DataFrame:
    """(id, largest_gap) of the pairs with a gap of more than `cutoff` target positions."""
    return alignment_gaps(pairs, trim).groupBy("id").agg(F.max("n").alias("largest_gap")).filter(F.col("largest_gap") > cutoff)


def local_sequence(df: DataFrame, key: list[str], order: list[str], letter: str, reach: int, pad: str = "X") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.array_join(F.collect_list(letter).over(w.rowsBetween(-reach, -1)), "")
    after = F.array_join(F.collect_list(letter).over(w.rowsBetween(1, reach)), "")
    return df.withColumn("local", F.concat(F.lpad(before, reach, pad), F.col(letter), F.rpad(after, reach, pad)))


def step_up_fdr(df: DataFrame, p: str, tie: str) -> DataFrame:
    """Adjusted p-values: the least of p * m / rank from here on, at most 1. Only counts and minima of range partitions meet in one task."""
    ranked = df.repartitionByRange(p, tie).sortWithinPartitions(p, tie).withColumn("__at", F.monotonically_increasing_id())
    ranked = written(ranked).withColumn("__part", F.shiftright("__at", 33))
    parts = ranked.groupBy("__part").agg(F.min("__at").alias("__lowest"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", "__lowest", before.alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__m"))
    ranked = ranked.join(F.broadcast(parts), "__part").withColumn("__q", F.col(p) * F.col("__m") / (F.col("__before") + F.col("__at") - F.col("__lowest") + 1))
    later = ranked.groupBy("__part").agg(F.min("__q").alias("__q"))
    later = later.select("__part", F.min("__q").over(Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    after = Window.partitionBy("__part").orderBy("__at").rowsBetween(0, Window.unboundedFollowing)
    least = F.least(F.lit(1.0), F.min("__q").over(after), "__later")
    return ranked.join(F.broadcast(later), "__part").withColumn("fdr", least).select(*df.columns, "fdr")


def dihedrals(backbone: DataFrame) -> DataFrame:
    """phi and psi in degrees from (structure, chain, ordinal, n, ca, c), each an array of three coordinates."""
    w = Window.partitionBy("structure", "chain").orderBy("ordinal")
    minus = lambda a, b: [a[i] - b[i] for i in range(3)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    def angle(p, q, r, s):
        one, two, three = minus(q, p), minus(r, q), minus(s, r)
        n1, n2 = cross(one, two), cross(two, three)
        return F.degrees(F.atan2(dot(one, n2) * F.sqrt(dot(two, two)), dot(n1, n2)))

    near = backbone.withColumn("c0", F.lag("c").over(w)).withColumn("n1", F.lead("n").over(w))
    c = F.col
    return near.withColumn("phi", angle(c("c0"), c("n"), c("ca"), c("c"))).withColumn("psi", angle(c("n"), c("ca"), c("c"), c("n1"))).drop("c0", "n1")
