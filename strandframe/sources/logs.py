"""Measures recovered from text logs, whose lines say themselves what their columns are.

A log's rows stand under header lines; a run that goes on with other features writes another header. Which header holds for a row
depends on all lines before it: each block of a file hands the last header in it to the blocks after it (one small row a block), and within a
block a window carries it from line to line. So a log of any size is read in splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns that every log begins with.
BASE_COLUMNS = ("Uniprot_Entry", "PDB_Code", "Method", "Resolution", "Chain", "Resid", "Source")
# End of the fixed values.
#: A value: a bracketed vector, or what has no space in it.
FIELD = r"(\[.+?\]|[\w.,/\-]+)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): lines of text files, in order by block (the split's first byte) and line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def _header(value: Column, base: tuple) -> Column:
    """The columns that a line names: those of `base` and all others in it, in order; null if it names no columns beyond them."""
    parts = F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != "")
    named = value.rlike("^[A-Za-z ]") & (F.size(parts) > len(base)) & (F.size(F.array_intersect(parts, F.array(*map(F.lit, base)))) == len(base))
    return F.when(named, F.array_distinct(F.concat(F.array(*map(F.lit, base)), parts)))


def with_header(lines: DataFrame, base: tuple = BASE_COLUMNS) -> DataFrame:
    """Add `header`, the columns in force at each line (`base` alone before the first header of a file), and `is_header`."""
    found = lines.withColumn("__own", _header(F.col("value"), base))
    blocks = found.groupBy("file", "block").agg(F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col("line"))).alias("__last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    within = Window.partitionBy("file", "block").orderBy("line")
    carried = found.join(blocks, ["file", "block"]).withColumn("header", F.coalesce(F.last("__own", ignorenulls=True).over(within), "__before", F.array(*map(F.lit, base))))
    return carried.withColumn("is_header", F.col("__own").isNotNull()).drop("__own", "__before")


def recover_log(lines: DataFrame, base: tuple = BASE_COLUMNS, extra: dict[int, list[str]] | None = None, mapping: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, block, line, value) -> (file and one column for each name in any header, as text; the rows that fit no header).

    A row begins with its number, which is dropped; dashes and other lines are no rows. Columns that a row's header lacks are null.
    extra: names of the columns that follow the header in rows that have so many more values than it names; without them, rows of another number of values go to
    the second table (file, value, n_fields, n_columns). mapping: new names of columns.
    """
    rows = with_header(lines, base).filter(~F.col("is_header") & F.col("value").rlike(r"^\s*\d") & ~F.col("value").rlike(r"^[\s\-]*$"))
    fields = F.regexp_extract_all("value", F.lit(FIELD), 1)
    rows = rows.withColumn("f", F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0)))).filter(F.size("f") > 0)
    for n, names in (extra or {}).items():
        rows = rows.withColumn("header", F.when(F.size("f") - F.size("header") == n, F.concat("header", F.array(*map(F.lit, names)))).otherwise(F.col("header")))
    fits = F.size("f") == F.size("header")
    schemas = rows.filter(fits).groupBy("header").agg(F.min(F.struct("file", "block", "line")).alias("first")).orderBy("first").collect()  # one row for each set of columns
    names = list(dict.fromkeys([*base, *(c for r in schemas for c in r["header"])]))
    read = rows.filter(fits).withColumn("m", F.map_from_arrays("header", "f"))
    unread = rows.filter(~fits).select("file", "value", F.size("f").alias("n_fields"), F.size("header").alias("n_columns"))
    return read.select("file", *[F.col("m")[c].alias((mapping or {}).get(c, c)) for c in names]), unread
