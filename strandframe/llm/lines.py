"""Line dedup by spread over sites: lines that stand on many sites are boilerplate.

One HyperLogLog sketch of the sites for each line hash, merged by aggregation. Lines
whose estimate is near the threshold get exact distinct counts; those far above are
boilerplate, those far below are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, with_rid

#: log2 of a sketch's registers; small sets are kept as lists, so rare lines cost a few bytes.
LG_REGISTERS = 10
#: Estimates within this factor of the threshold are counted exactly: over 4 standard errors.
NEAR = 1.25


def boilerplate(lines: DataFrame, sites: int) -> DataFrame:
    """(line, site) -> the `line`s that stand on at least `sites` distinct sites. Null sites count as no site."""
    lines = lines.filter(F.col("site").isNotNull())
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_REGISTERS).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("spread"))
    spread = stash(spread.filter(F.col("spread") >= sites / NEAR))
    near = spread.filter(F.col("spread") < sites * NEAR).select("line")
    exact = lines.join(near, "line").groupBy("line").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= sites)
    return spread.filter(F.col("spread") >= sites * NEAR).select("line").unionByName(exact.select("line"))


def drop_boilerplate(docs: DataFrame, site: str, text: str = "text", sites: int = 8) -> DataFrame:
    """Remove the lines of `text` that stand on at least `sites` values of `site`.

    A line is what stands between newlines, blanks at its ends aside; lines are equal
    if these are, and empty ones stay. Returns all columns with the cleaned text, and
    n_lines and n_removed. A null text stays null, with no lines; rows with a null site lose
    boilerplate but make none. Repeated rows are rows of their own; an empty table
    gives an empty result. Long texts and long lines are taken whole. Columns n_lines and n_removed are replaced; others pass through.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = with_rid(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(f"`{site}`").alias("site"), F.split(F.col(f"`{text}`"), "\n", -1).alias("lines")), "rid")
    each = rows.select("rid", "site", F.posexplode(F.transform("lines", lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))).alias("i", "line"))
    common = boilerplate(each.filter(F.col("line").isNotNull()).select("line", "site"), sites)
    told = each.filter(F.col("line").isNotNull()).join(common.withColumn("hit", F.lit(True)), "line", "left").select("rid", "i", "hit")
    flagged = told.unionByName(each.filter(F.col("line").isNull()).select("rid", "i", F.lit(None).cast("boolean").alias("hit")))  # blank lines have no key to meet on
    flags = flagged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("flags"), F.max("hit").alias("any")).filter(F.col("any"))
    out = rows.join(flags, "rid", "left")
    left = F.filter(F.zip_with("lines", F.col("flags.hit"), lambda x, hit: F.when(~hit, x)), lambda x: x.isNotNull())
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    clean = F.when(F.col("any"), F.array_join(left, "\n")).otherwise(F.array_join("lines", "\n"))
    return out.select(*[(clean if c == text else F.col(f"__row.`{c}`")).alias(c) for c in kept], n.cast("long").alias("n_lines"), F.when(F.col("any"), n - F.size(left)).otherwise(0).cast("long").alias("n_removed"))
