"""Tables behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chain_residue, confidence_band
from ..operators.quantiles import quantiles

# Bin widths of features.
WIDTHS = {"depth": 0.1, "sasa": 2.0, "propka": 0.2, "flexibility": 0.1, "curvature": 0.1, "arc_length": 0.1, "das": 2.0, "legolas": 2.0, "phi": 2.0, "psi": 2.0, "seqcharge": 0.5, "torsion": 0.2, "writhing": 0.02, "frustration": 0.5, "rmsf": 0.2}
# End of the fixed values.


def histogram(df: DataFrame, feature: str, step: float | None = None, split: Column | None = None) -> DataFrame:
    """Counts and densities of whole bins (as wide as `WIDTHS` says where no step is given) from the minimum on; what lies past the last edge is not counted, the last edge is."""
    x, step = F.col(feature), WIDTHS[feature] if step is None else step
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).withColumn("bins", F.ceil((F.col("hi") - F.col("lo")) / step - 1e-12).cast("long") - 1)
    at = df.filter(x.isNotNull()).crossJoin(F.broadcast(ends))  # one row
    bin_ = F.least(F.floor((x - F.col("lo")) / step), F.when(x == F.col("lo") + F.col("bins") * step, F.col("bins") - 1).otherwise(F.floor((x - F.col("lo")) / step)))
    keys = [F.col("bin"), F.col("lo"), *([F.col("colour")] if split is not None else [])]
    named = at.withColumn("bin", bin_) if split is None else at.withColumn("bin", bin_).withColumn("colour", split)
    counts = named.filter((F.col("bin") >= 0) & (F.col("bin") < F.col("bins"))).groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bin", *(["colour"] if split is not None else []), (F.col("lo") + F.col("bin") * step).alias("left_edge"), "n", (F.col("n") / (F.col("total") * step)).alias("density"))


def colours(how: str) -> Column:
    made = {"chain": F.col("Chain"), "residue": F.col("Resid").cast("string"), "both": chain_residue(F.col("Chain"), F.col("Resid")), "class": F.col("class"), "method": F.col("Method"), "source": F.col("Source")}
    return confidence_band(F.col("PLDDT")) if how == "plddt" else made.get(how, F.lit("all"))


def bandwidth_rule(df: DataFrame, feature: str) -> float | None:
    """Scott's rule for one dimension: the sample deviation times the count to the power of -1/5; null for fewer than two values."""
    at = df.agg(F.stddev_samp(feature).alias("sd"), F.count(feature).alias("n")).first()
    return at["sd"] * at["n"] ** -0.2 if at["n"] > 1 and at["sd"] else None


def density(df: DataFrame, feature: str, bandwidth: float | None = None, points: int = 200, cells: int = 64, reach: float = 8.5) -> DataFrame:
    """Gaussian kernel density on an even grid over the data's range, with `bandwidth` or that of the rule.

    Values are binned linearly: each gives its two neighbours among `cells` fine cells a bandwidth their shares of its weight, so that all rows are one aggregation
    of bounded size. A cell then meets only the grid points within `reach` bandwidths, by a join on stretches of that length; the kernel beyond is below 1e-15.
    The error of the binning is of the order of 1 / (8 cells^2) of the density's curvature. Equal values have no density: without a bandwidth the result is empty.
    """
    h = bandwidth if bandwidth is not None else bandwidth_rule(df, feature)
    ends = df.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"), F.count(feature).alias("n")).first()
    spark = df.sparkSession
    if h is None or not ends["n"]:
        return spark.createDataFrame([], "at double, density double")
    lo, hi, n = ends["lo"], ends["hi"], ends["n"]
    fine = h / cells
    place = (F.col(feature) - lo) / fine
    cell = F.floor(place)
    shares = F.array(F.struct(cell.alias("c"), (1 - (place - cell)).alias("w")), F.struct((cell + 1).alias("c"), (place - cell).alias("w")))
    binned = df.filter(F.col(feature).isNotNull()).select(F.inline(shares)).filter("w > 0").groupBy("c").agg(F.sum("w").alias("w"))
    stretch = h * reach
    binned = binned.select((F.lit(lo) + F.col("c") * fine).alias("x"), "w").withColumn("s", F.floor((F.col("x") - lo) / stretch))
    grid = spark.range(points).select(F.col("id").alias("i"), (F.lit(lo) + (F.lit(hi) - lo) * F.col("id") / max(points - 1, 1)).alias("at"))
    near = grid.withColumn("s", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor((F.col("at") - lo) / stretch) + k)))
    z = (F.col("at") - F.col("x")) / h
    sums = binned.join(F.broadcast(near), "s").filter(F.abs(z) <= reach).groupBy("i").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("s"))  # three times `points` rows
    return grid.join(sums, "i", "left").select("at", (F.coalesce("s", F.lit(0.0)) / (n * h * 2.5066282746310002)).alias("density"))


def violins(df: DataFrame, columns: list[str]) -> DataFrame:
    """Extremes and quartiles of each column; the columns are as long as the table, so their quartiles come from ranks."""
    ends = df.select(*columns).unpivot([], columns, "feature", "value").groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    q = quantiles(df, [], columns, [0.25, 0.5, 0.75]).select("feature", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])
    return ends.join(q, "feature", "left").select("feature", "low", "q1", "q2", "q3", "high")


def axis_limits(df: DataFrame, feature: str) -> DataFrame:
    return df.agg(F.round(F.min(feature), 1).alias("low"), F.round(F.max(feature), 1).alias("high"))


def pick_list(df: DataFrame, column: str) -> DataFrame:
    """'All' first, then the distinct values of the current subset."""
    values = df.select(F.col(column).cast("string").alias("value"), F.lit(1).alias("i")).distinct()
    head = df.sparkSession.range(1).select(F.lit("All").alias("value"), F.lit(0).alias("i"))
    return head.unionByName(values).orderBy("i", "value").select("value")


def scatter(df: DataFrame, key: list[str], axes: list[str], bounds: dict | None = None, spread: bool = False) -> DataFrame:
    from ..operators.filters import in_box

    rows = df.filter(in_box(bounds)) if bounds else df
    more = [f"{a.rsplit('_', 1)[0]}_sd" for a in axes if spread and f"{a.rsplit('_', 1)[0]}_sd" in df.columns]
    return rows.dropna(subset=axes).select(*key, *axes, *more)
