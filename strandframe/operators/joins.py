"""Joins of features, logs, labels and annotations onto measures."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stem


def combine_features(frames: list[DataFrame], on: list[str], how: str = "inner") -> DataFrame:
    """One row for each residue that every frame has; `left` keeps those of the first."""
    return reduce(lambda a, b: a.join(b, on, how), frames)


def join_late_features(df: DataFrame, late: DataFrame, on: list[str]) -> DataFrame:
    return df.join(late.drop(*[c for c in late.columns if c in df.columns and c not in on]), on, "left")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    last = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").drop("__rn")


def join_confidence(df: DataFrame, plddt: DataFrame, order: list[str]) -> DataFrame:
    """PLDDT of the last record for (structure, chain, residue), relaxed copies taking that of their original."""
    right = keep_last(plddt, ["PDB_Code", "Chain", "Resid"], order).select(F.col("PDB_Code").alias("__stem"), F.col("Chain"), F.col("Resid"), "PLDDT")
    return df.withColumn("__stem", stem(F.col("PDB_Code"))).join(right, ["__stem", "Chain", "Resid"], "left").drop("__stem")


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    if not df.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError(f"rows repeat on {key}")
    return df


def collate_logs(logs: dict[str, DataFrame]) -> DataFrame:
    """One row for each structure of the geometry log (or of all logs), the other logs joined on the stem; unique names lose the prefix.

    Each log has `structure` and one row for it.
    """
    others = {n: d for n, d in logs.items() if n != "geometry"}
    if "geometry" in logs:
        base = logs["geometry"].select("structure", *[F.col(c).alias(f"geometry_{c}") for c in logs["geometry"].columns if c != "structure"])
    else:
        base = reduce(lambda a, b: a.union(b), [d.select("structure") for d in others.values()]).distinct()
    out = base.withColumn("__stem", stem(F.col("structure")))
    for name, log in others.items():
        right = assert_unique(log, ["structure"]).select(F.col("structure").alias("__stem"), *[F.col(c).alias(f"{name}_{c}") for c in log.columns if c != "structure"])
        out = out.join(right, "__stem", "left")
    out = out.drop("__stem")
    bare = [c.split("_", 1)[-1] if c != "structure" else c for c in out.columns]
    return out.toDF(*[b if bare.count(b) == 1 else c for b, c in zip(bare, out.columns, strict=True)])


def add_logs(df: DataFrame, logs: dict[str, DataFrame]) -> DataFrame:
    """Log columns with prefixes; geometry by exact name, others by stem. The number of rows stays."""
    out = df.withColumn("__stem", stem(F.col("PDB_Code")))
    for name, log in logs.items():
        on = "PDB_Code" if name == "geometry" else "__stem"
        out = out.join(assert_unique(log, ["structure"]).select(F.col("structure").alias(on), *[F.col(c).alias(f"{name}_{c}") for c in log.columns if c != "structure"]), on, "left")
    return out.drop("__stem")


def add_measures(df: DataFrame, extra: DataFrame, on_conflict: str = "old") -> DataFrame:
    on = ["PDB_Code", "Chain", "Resid"]
    both = [c for c in extra.columns if c in df.columns and c not in on]
    extra = extra.drop(*both) if on_conflict == "old" else extra
    return (df if on_conflict == "old" else df.drop(*both)).join(extra, on, "left")


def required_residues(df: DataFrame, sites: DataFrame) -> DataFrame:
    return df.dropDuplicates().join(sites.select("Uniprot_Entry", "Resid").distinct(), ["Uniprot_Entry", "Resid"], "left_semi")


def add_labels(df: DataFrame, sites: DataFrame, label: str, unlisted: str = "-1") -> DataFrame:
    old = F.col("class") if "class" in df.columns else F.lit(None).cast("string")
    flagged = df.join(sites.select("Uniprot_Entry", "Resid").distinct().withColumn("__in", F.lit(True)), ["Uniprot_Entry", "Resid"], "left")
    return flagged.withColumn("class", F.when(F.col("__in"), label).otherwise(F.coalesce(old, F.lit(unlisted)))).drop("__in")


def with_term(df: DataFrame, edges: DataFrame, go_id: str | None = None, name: str | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Rows of the proteins that a term annotates, by its code, its name (terms: go_id, name) or both.

    A code that isn't the name's, an unknown name and neither of the two are errors. A code without
    proteins gives an empty table and a warning.
    """
    if go_id is None and name is None:
        raise ValueError("a term needs a code or a name")
    if name is not None:
        codes = {r["go_id"] for r in terms.filter(F.col("name") == name).select("go_id").distinct().collect()}  # one term, or few that share a name
        if not codes:
            raise KeyError(f"unknown term {name!r}")
        if go_id is not None and go_id not in codes:
            raise ValueError(f"the code {go_id} is not that of {name!r}")
        go_id = go_id if go_id is not None else min(codes)
    if edges.filter(F.col("go_id") == go_id).isEmpty():
        warnings.warn(f"no protein has the term {go_id}; the table is empty", UserWarning, stacklevel=2)
    return df.join(edges.filter(F.col("go_id") == go_id).select(F.col("uniprot").alias("Uniprot_Entry")).distinct(), "Uniprot_Entry", "left_semi")


def terms_of(edges: DataFrame, terms: DataFrame) -> DataFrame:
    return edges.join(terms, "go_id").select("uniprot", "go_id", "name").distinct()


def match_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (PDB_Code) and files (file): code up to the first '-', any case; predicted ones by the second token."""
    code = lambda c: F.lower(F.when(c.startswith("AF-"), F.split(c, "-")[1]).otherwise(F.split(c, "-")[0]))
    return entries.withColumn("__k", code(F.col("PDB_Code"))).join(files.withColumn("__k", code(F.col("file"))), "__k").drop("__k")


def match_structures(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (PDB_Code) and files (file, with or without an extension), any case, `_relaxed` left out: codes equal to a file's stem, or to the stem up to `-alt`;
    of predicted ones to the stem up to any '-' ("AF-P1-F1" has "AF-P1-F1-model.pdb")."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\.[^.]*$", ""), "_relaxed$", "")
    parts = F.split("__stem", "-")
    codes = F.when(F.col("__stem").startswith("af-"), F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-")))
    codes = codes.otherwise(F.array_distinct(F.array("__stem", F.split("__stem", "-alt")[0])))
    files = files.withColumn("__stem", stem(F.col("file"))).withColumn("__k", F.explode(codes)).drop("__stem")
    return entries.withColumn("__k", stem(F.col("PDB_Code"))).join(files, "__k").drop("__k")


def not_done(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def not_done_but_last(wanted: DataFrame, done: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last one done may be partial and is done again."""
    last = done.select(F.max_by(F.col(key), F.struct(*order)).alias("__last"))
    return not_done(wanted, done.select(key).distinct().join(F.broadcast(last), F.col(key) == F.col("__last"), "left_anti"), key)


def restart_structures(wanted: DataFrame, files: DataFrame, log: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """wanted (PDB_Code), files (file, with .pdb), log (code, order columns) -> the wanted codes that are left, and the files to measure for them, with `ignored`.

    Of the codes in the log the last one may be partial and counts as not done. A wanted code that is done as it stands goes; where curation has made files of
    other names, the wanted code stays, and those of its files that are done are ignored.
    """
    last = log.select(F.max_by("code", F.struct(*order)).alias("__last"))
    done = log.select("code").distinct().join(F.broadcast(last), F.col("code") == F.col("__last"), "left_anti")
    left = wanted.join(done, F.col("PDB_Code") == F.col("code"), "left_anti")
    stems = done.select(F.concat("code", F.lit(".pdb")).alias("file"), F.lit(True).alias("ignored"))
    return left, match_structures(left, files).join(stems, "file", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def restore_columns(df: DataFrame, template: DataFrame, on: list[str], columns: list[str], marker: dict | None = None) -> DataFrame:
    right = assert_unique(template, on).select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.drop(*columns).join(right, on, "left")
    return out.select(*[c for c in out.columns if not c.startswith("__")], *[F.coalesce(F.col(f"__{c}"), F.lit((marker or {}).get(c))).alias(c) for c in columns])


def fill_from(df: DataFrame, other: DataFrame, on: list[str], column: str) -> DataFrame:
    """Full join; the first value that is not null."""
    right = other.select(*on, F.col(column).alias("__other"))
    return df.select(*on, column).join(right, on, "full").select(*on, F.coalesce(column, "__other").alias(column))


def ensemble_members(ca: DataFrame) -> DataFrame:
    """(protein, structure, resname, chain, resid) of CA atoms -> (protein, structure, signature); structures of a protein with equal CA tables share a signature."""
    return ca.groupBy("protein", "structure").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "chain", F.lpad(F.col("resid").cast("string"), 6, "0"), "resname")))), 256).alias("signature"))
