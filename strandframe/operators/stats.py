"""Statistics over tables: enrichment, outliers, components, collinearity, undersampling, superposition."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .quantiles import quantiles
from .windows import step_up_fdr


def contingency(edges: DataFrame, flags: DataFrame) -> DataFrame:
    """edges (go_id, uniprot), flags (uniprot, selected) over the reference proteins -> a, b, c, d for each term."""
    totals = flags.agg(F.count("*").alias("n"), F.sum(F.col("selected").cast("long")).alias("n_sel"))
    per = edges.distinct().join(flags, "uniprot").groupBy("go_id").agg(F.sum(F.col("selected").cast("long")).alias("a"), F.count("*").alias("n_term"))
    t = per.crossJoin(F.broadcast(totals))  # one row
    return t.select("go_id", "a", (F.col("n_term") - F.col("a")).alias("b"), (F.col("n_sel") - F.col("a")).alias("c"), (F.col("n") - F.col("n_sel") - F.col("n_term") + F.col("a")).alias("d"))


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number: a table of the first twenty, then Stirling's series for the gamma function, to about 1e-15 of the result."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(20)])
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(n < 20, F.get(small, n.cast("int"))).otherwise(series)


def fisher_greater(tables: DataFrame) -> DataFrame:
    """Add p: probability of at least a in the first cell given the margins of a, b, c, d.

    The first term comes from factorials, each further one from the ratio to the one before, all in logarithms and within the row.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    lf = log_factorial
    first = lf(F.col("a") + F.col("b")) + lf(F.col("c") + F.col("d")) + lf(F.col("a") + F.col("c")) + lf(F.col("b") + F.col("d"))
    first = first - lf(F.col("a") + F.col("b") + F.col("c") + F.col("d")) - lf(F.col("a")) - lf(F.col("b")) - lf(F.col("c")) - lf(F.col("d"))
    more = F.least(F.col("b"), F.col("c"))
    steps = F.when(more > 0, F.sequence(F.lit(0).cast("long"), more - 1)).otherwise(F.array().cast("array<long>"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log((b - k) * (c - k) / ((a + k + 1) * (d + k + 1)))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    return tables.withColumn("p", F.least(F.lit(1.0), F.aggregate(steps, start, step, lambda acc: acc["sum"])))


def enrichment(measures: DataFrame, edges: DataFrame, terms: DataFrame, box, cutoff: int = 1) -> DataFrame:
    """Terms of proteins with a row in the box against all proteins of the table, with corrected p-values."""
    flags = measures.groupBy(F.col("Uniprot_Entry").alias("uniprot")).agg(F.coalesce(F.max(box), F.lit(False)).alias("selected"))
    tables = contingency(edges, flags).filter(F.col("a") + F.col("b") >= cutoff)
    tested = step_up_fdr(fisher_greater(tables), "p", "go_id").join(terms, "go_id", "left")
    ratio = lambda x, y: F.concat(F.col(x).cast("string"), F.lit("/"), (F.col(x) + F.col(y)).cast("string"))
    return tested.select("go_id", "name", F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"), ratio("a", "c").alias("in_region"), ratio("b", "d").alias("in_background")).orderBy("p", "go_id")


def outliers(df: DataFrame, key: list[str], feature: str, whisker: float = 1.5, by_ranks: bool = False) -> DataFrame:
    """Rows beyond the whiskers of their group, by linear quartiles.

    by_ranks: for groups too large for one task's buffer; their quartiles come from a range partitioning of all values.
    """
    if by_ranks:
        q = quantiles(df, key, [feature], [0.25, 0.75]).select(*key, F.col("q")[0].alias("__q1"), F.col("q")[1].alias("__q3"))
    else:
        q = df.groupBy(*key).agg(F.percentile(feature, F.lit(0.25)).alias("__q1"), F.percentile(feature, F.lit(0.75)).alias("__q3"))
    reach = whisker * (F.col("__q3") - F.col("__q1"))
    return df.join(q, key).filter((F.col(feature) < F.col("__q1") - reach) | (F.col(feature) > F.col("__q3") + reach)).drop("__q1", "__q3")


def clean(df: DataFrame, features: list[str]) -> DataFrame:
    return df.dropna(subset=features).dropDuplicates(features)


def normalise(df: DataFrame, features: list[str]) -> DataFrame:
    """z-scores with the population deviation; constant columns become 0."""
    at = df.agg(*[F.struct(F.avg(f), F.stddev_pop(f)).alias(f) for f in features]).first()
    return df.withColumns({f: (F.col(f) - at[f][0]) / at[f][1] if at[f][1] else F.lit(0.0) for f in features})


def fit_pca(df: DataFrame, vector: str, keep: float | int = 0.99):
    """(model, mean, k): components for a share of the variance (below 1) or a number of them."""
    if isinstance(keep, bool) or keep <= 0 or (keep >= 1 and keep != int(keep)):
        raise ValueError("keep a share between 0 and 1, or a whole number")
    v = df.select(array_to_vector(vector).alias("v"))
    mean = v.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
    width = len(mean)
    if keep >= 1 and keep > width:
        raise ValueError(f"there are {width} columns")
    model = PCA(k=width if keep < 1 else int(keep), inputCol="v", outputCol="pc").fit(v)
    k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), keep - 1e-12) + 1) if keep < 1 else int(keep)
    return model, mean, min(k, width)


def apply_pca(df: DataFrame, vector: str, fitted, alias: str = "pc") -> DataFrame:
    model, mean, k = fitted
    shift = F.array(*[F.lit(float(x)) for x in mean])
    centred = df.withColumn("v", array_to_vector(F.zip_with(F.col(vector), shift, lambda x, m: x - m)))
    return model.transform(centred).withColumn(alias, F.slice(vector_to_array("pc"), 1, k)).drop("v", *["pc"] * (alias != "pc"))


def spread_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): least id of the component. Labels go to neighbours and jump to their label's label until nothing changes."""
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        near = links.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        fresh = step.join(jump, "label").select("id", F.col("next").alias("label"))
        fresh = written(fresh)
        if fresh.join(labels.withColumnRenamed("label", "old"), "id").filter("label <> old").isEmpty():
            return fresh
        labels = fresh


def superpositions(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key -> row-major matrix (12 numbers) that lays p on q with least squares, and rmsd; fewer than three pairs: the identity.

    The sums over pairs are one aggregation; only 3x3 problems go to Python.
    """
    p, q = [F.col(f"p_{a}") for a in "xyz"], [F.col(f"q_{a}") for a in "xyz"]
    sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"p{i}") for i, x in enumerate(p)], *[F.sum(x).alias(f"q{i}") for i, x in enumerate(q)]]
    sums += [F.sum(p[i] * q[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)] + [F.sum(sum((x * x for x in [*p, *q]), F.lit(0.0))).alias("square")]
    one = pairs.groupBy(*key).agg(*sums)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["n"].to_numpy()[:, None]
            mp, mq = frame[["p0", "p1", "p2"]].to_numpy() / n, frame[["q0", "q1", "q2"]].to_numpy() / n
            cov = frame[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3) - n[:, :, None] * mp[:, :, None] * mq[:, None, :]
            u, s, vt = np.linalg.svd(cov)
            sign = np.sign(np.linalg.det(u) * np.linalg.det(vt))
            u[:, :, 2] *= sign[:, None]
            s[:, 2] *= sign
            turn = np.transpose(u @ vt, (0, 2, 1))
            shift = mq - np.einsum("nij,nj->ni", turn, mp)
            spread = frame["square"].to_numpy() - (n[:, 0] * ((mp**2).sum(1) + (mq**2).sum(1)))
            rmsd = np.sqrt(np.maximum(0, spread - 2 * s.sum(1)) / n[:, 0])
            matrix = np.concatenate([turn, shift[:, :, None]], 2).reshape(-1, 12)
            few = n[:, 0] < 3
            matrix[few] = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]
            out = frame[key].copy()
            out["matrix"] = list(matrix)
            out["rmsd"] = np.where(few, np.nan, rmsd)
            yield out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.select(*key).schema)
    return one.mapInPandas(fit, f"{kinds}, matrix array<double>, rmsd double").withColumn("rmsd", F.when(~F.isnan("rmsd"), F.col("rmsd")))


def rmsf(backbone: DataFrame, anchors: DataFrame, align: str = "backbone") -> DataFrame:
    """Fluctuation of each anchor over an ensemble after laying every conformer on the first.

    backbone: (ensemble, structure, chain, resid, name, x, y, z); anchors alike. align: `backbone` lays whole structures, once for each; `local` lays, for
    every residue number, the backbone of the residues that have it, in all chains. One conformer gives null, and so does an anchor whose
    residue has fewer than three backbone atoms to lay.
    """
    from ..functions.scalars import affine

    if align not in ("backbone", "local"):
        raise ValueError("align by the backbone or local")
    first = backbone.groupBy("ensemble").agg(F.min("structure").alias("first"))
    on = ["ensemble", "chain", "resid", "name"]
    unit = ["ensemble", "structure", *(["resid"] if align == "local" else [])]
    base = backbone.join(first, "ensemble").filter("structure = first").select(*on, *[F.col(a).alias(f"q_{a}") for a in "xyz"])
    fits = superpositions(backbone.select(*on, "structure", *[F.col(a).alias(f"p_{a}") for a in "xyz"]).join(base, on), unit)
    laid = anchors.join(fits, unit, "left")
    x, y, z = affine(F.col("matrix"), [F.col("x"), F.col("y"), F.col("z")])
    laid = laid.select("ensemble", "chain", "resid", F.col("rmsd").isNotNull().alias("fits"), x.alias("x"), y.alias("y"), z.alias("z"))
    spread = lambda a: F.avg(F.col(a) * F.col(a)) - F.avg(a) * F.avg(a)
    return laid.groupBy("ensemble", "chain", "resid").agg(F.when((F.count("*") > 1) & F.min("fits"), F.sqrt(F.greatest(F.lit(0.0), spread("x") + spread("y") + spread("z")))).alias("rmsf"))


def ensemble_rmsf(atoms: DataFrame, anchor: str, align: str = "backbone", names: tuple = ("N", "CA", "C", "O")) -> DataFrame:
    """(protein, structure, chain, resid, resname, name, x, y, z) -> (protein, signature, members, chain, resid, rmsf) of the atoms named `anchor`.

    The ensembles are the structures of a protein whose CA atoms have equal residue names, chains and numbers.
    """
    from .joins import ensemble_members

    members = ensemble_members(atoms.filter("name = 'CA'"))
    sizes = members.groupBy("protein", "signature").agg(F.count("*").alias("members"))
    mine = atoms.join(members, ["protein", "structure"]).withColumn("ensemble", F.struct("protein", "signature"))
    found = rmsf(mine.filter(F.col("name").isin(*names)), mine.filter(F.col("name") == anchor), align)
    return found.select("ensemble.*", "chain", "resid", "rmsf").join(sizes, ["protein", "signature"]).select("protein", "signature", "members", "chain", "resid", "rmsf")


def sphere_points(n: int) -> list[tuple[float, float, float]]:
    turn = math.pi * (3 - math.sqrt(5))
    rings = [1 - 2 * (i + 0.5) / n for i in range(n)]
    return [(math.cos(turn * i) * math.sqrt(1 - h * h), math.sin(turn * i) * math.sqrt(1 - h * h), h) for i, h in enumerate(rings)]


# Van der Waals radii; atoms of carbamylated residues that occlude nothing.
RADII = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "P": 1.8}
NOT_OCCLUDING = ("CX", "OQ1", "OQ2")
# End of the fixed values.


def _exposed(points: int):
    """How many points of each atom's sphere (of radius r) lie in none of the spheres around (x, y, z from its centre, r)."""
    unit = np.array(sphere_points(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            around, radius = batch.column("around"), batch.column("r").to_numpy()
            offsets = around.offsets.to_numpy() - around.offsets.to_numpy()[0] if len(around) else np.zeros(1, np.int64)
            near = np.stack([around.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("x", "y", "z", "r")], 1)
            free = np.empty(len(radius), np.int64)
            for i, r in enumerate(radius):
                at, out = r * unit, np.ones(points, bool)
                for o in near[offsets[i] : offsets[i + 1]]:
                    left = np.flatnonzero(out)
                    gap = at[left] - o[:3]
                    out[left] = (gap * gap).sum(1) >= o[3] * o[3]
                free[i] = out.sum()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(free)], names=["key", "free"])

    return run


def accessible_area(side_chains: DataFrame, atoms: DataFrame, probe: float = 1.4, points: int = 960, threshold: float = 0.0, ignore: tuple = NOT_OCCLUDING) -> DataFrame:
    """(structure, chain, resid, sasa): exposed share of the spheres of side-chain atoms; needs serial, name, element and xyz.

    An atom counts if at least the share `threshold` of its points is exposed. Atoms named in `ignore` neither count nor occlude. The spheres that can reach an atom
    come from a join on cells; a task then tests its atoms' points against their lists.
    """
    from .spatial import XYZ, pairs_within

    if probe <= 0 or points < 1 or not 0 <= threshold <= 1:
        raise ValueError("the probe has to be positive, with one point at least and a threshold between 0 and 1")
    if ignore and "name" in atoms.columns:
        side_chains, atoms = (df.filter(~F.coalesce(F.col("name").isin(*ignore), F.lit(False))) for df in (side_chains, atoms))
    radius = lambda e: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RADII.items() for x in kv]), F.col(e)), F.lit(1.7)) + probe
    near = pairs_within(side_chains, atoms, 2 * (max(RADII.values()) + probe)).filter(F.col("p_serial") != F.col("q_serial")).filter(F.col("distance") < radius("p_element") + radius("q_element"))
    around = near.groupBy("p_structure", "p_serial").agg(F.collect_list(F.struct(*[(F.col(f"q_{a}") - F.col(f"p_{a}")).alias(a) for a in XYZ], radius("q_element").alias("r"))).alias("around"))
    own = side_chains.select(F.col("structure").alias("p_structure"), F.col("serial").alias("p_serial"), "chain", "resid", radius("element").alias("r")).join(around, ["p_structure", "p_serial"], "left")
    own = own.select(F.struct(F.col("p_structure").alias("structure"), "chain", "resid", "r").alias("key"), "r", F.coalesce("around", F.array().cast("array<struct<x:double,y:double,z:double,r:double>>")).alias("around"))
    kind = own.schema["key"].dataType.simpleString()
    tested = own.mapInArrow(_exposed(points), f"key {kind}, free long").select("key.*", (F.col("free") / points).alias("share"))
    area = F.when(F.col("share") >= threshold, 4 * math.pi * F.col("r") * F.col("r") * F.col("share")).otherwise(0.0)
    return tested.groupBy("structure", "chain", "resid").agg(F.sum(area).alias("sasa"))
