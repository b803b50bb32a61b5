"""Entropy balancing: mix sources to target token counts with the least change of the documents' rates.

A document's rate lies between 0 and a cap. Among all rates that bring each source to its target of tokens and keep the number of documents that
equal rates within the sources would give, the ones of least relative entropy to 1 (that of the rate, plus that of what it lacks of the cap) are

    rate = cap * sigmoid(base + lam[source] * size + mu),

so that documents are tilted by their size: lam turns a source's tokens, and mu, common to all, its documents.
The multipliers minimise a convex dual. A Newton step takes its gradient and Hessian from one aggregation; the Hessian is an arrow
(a diagonal for the sources, a border for mu), so its solution is one more sum, and no table of the sources
passes through the driver. Rates are then rounded to whole copies so that the copies' tokens follow the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash, with_rid

#: Largest error of a source's tokens, and of all documents, as a share of what they should be.
TOLERANCE = 1e-9
#: Newton steps after which the error is raised, not used; near the solution it squares with each one.
MOST_STEPS = 60
#: Step lengths that the line search looks at, in one aggregation.
LENGTHS = tuple(0.5**i for i in range(12))
#: Documents that are rounded together.
LOT = 500


def words_of(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(stats: DataFrame, share: float, weights: list[float], most: float) -> DataFrame:
    """Add `target` to one row a source (source, source_size).

    Sources take the weights in turn, by code point and null last, and share `share`
    times all tokens; what a source can't use beyond `most` times its size goes to the
    others by weight. A source is full exactly if its limit per weight is at most the
    level that the sources after it (by limit per weight) would reach without it.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = stats.withColumn("__i", F.row_number().over(everything) - 1).withColumn("__w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__i") % len(weights) + 1).cast("int")))
    w = w.withColumn("__limit", most * F.col("source_size").cast("double"))
    by_limit = Window.orderBy(F.col("__limit") / F.col("__w"), "__i")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("__all", share * F.sum("source_size").over(whole))
        .withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
        .withColumn("__full", F.col("__limit") / F.col("__w") <= F.col("__level"))
        .withColumn("__top", F.max(F.when(~F.col("__full"), F.col("__level"))).over(whole))
    )
    return w.select("source", "source_size", F.when(F.col("__full"), F.col("__limit")).otherwise(F.col("__w") * F.col("__top")).alias("target"))


def _base(most: float) -> float:
    """What the sigmoid starts from, so that multipliers of 0 are a rate of 1."""
    return -math.log(most - 1) if most > 1 else 0.0


def rate_of(size: Column, lam: Column, mu: Column, most: float) -> Column:
    """The rate of a document under multipliers for tokens and documents."""
    return most / (1 + F.exp(-(_base(most) + lam * size + mu)))


def multipliers(units: DataFrame, wanted: DataFrame, most: float) -> tuple[DataFrame, float]:
    """The dual solution: (source, lam) for each source of `wanted` (source, target) whose target can be met in between, and mu.

    units: (source, size, n), n documents of that size. Sources with a target of 0 or of `most` times their size are no
    part of it: their rates are 0 and `most`. Each step solves the full Newton system and takes the longest of LENGTHS that lowers the dual enough.
    """
    some = units.filter("size > 0")
    sizes = some.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"), F.sum("n").alias("docs"))
    free = wanted.alias("w").join(sizes.alias("s"), F.col("w.source").eqNullSafe(F.col("s.source"))).filter((F.col("target") > 0) & (F.col("target") < most * F.col("tokens") * (1 - 1e-12)))
    state = stash(free.select(F.col("w.source").alias("source"), "target", "tokens", "docs", F.lit(0.0).alias("lam")))
    scale, goal = state.agg(F.sum("tokens") / F.sum("docs"), F.sum(F.col("docs") * F.col("target") / F.col("tokens"))).first()
    if scale is None:
        return state.select("source", "lam"), 0.0
    mu = 0.0
    some = stash(some.alias("u").join(state.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.source", (F.col("size") / scale).alias("x"), "n"))
    state = state.select("source", (F.col("target") / scale).alias("target"), "lam")
    soft = lambda eta: F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))

    def joined(state: DataFrame) -> DataFrame:
        return some.alias("u").join(state.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))

    for _ in range(MOST_STEPS):
        rate = rate_of(F.col("x"), F.col("lam"), F.lit(mu), most)
        bend = F.col("n") * rate * (1 - rate / most)
        sums = joined(state).groupBy(F.col("s.source").alias("source")).agg(
            F.first("target").alias("target"),
            F.first("lam").alias("lam"),
            (F.sum(F.col("n") * rate * F.col("x")) - F.first("target")).alias("g"),
            F.sum(F.col("n") * rate).alias("docs"),
            (F.sum(bend * F.col("x") ** 2) + 1e-300).alias("a"),
            F.sum(bend * F.col("x")).alias("b"),
            F.sum(bend).alias("c"),
        )
        sums = stash(sums)
        at = sums.agg(F.max(F.abs(F.col("g")) / F.col("target")).alias("error"), F.sum("docs").alias("docs"), F.sum("c").alias("c"), F.sum(F.col("b") ** 2 / F.col("a")).alias("bb"), F.sum(F.col("b") * F.col("g") / F.col("a")).alias("bg"), F.sum(F.col("g") ** 2 / F.col("a")).alias("gg")).first()
        over = at["docs"] - goal
        schur = at["c"] - at["bb"]
        loose = schur > 1e-9 * at["c"]  # else every source has documents of one size only, and mu is not needed
        if at["error"] <= TOLERANCE and (abs(over) <= TOLERANCE * goal or not loose):
            return sums.select("source", (F.col("lam") / scale).alias("lam")), mu
        step = -(over - at["bg"]) / schur if loose else 0.0
        moved = sums.select("source", "target", "lam", (-(F.col("g") + F.col("b") * step) / F.col("a")).alias("d"))
        # the dual along the step: its slope, and its change at each length
        slope = -at["gg"] - at["bg"] * step + over * step
        eta = _base(most) + F.col("lam") * F.col("x") + mu
        along = joined(moved).agg(*[F.sum(F.col("n") * most * (soft(eta + t * (F.col("d") * F.col("x") + step)) - soft(eta))).alias(f"t{i}") for i, t in enumerate(LENGTHS)]).first()
        fixed = (moved.agg(F.sum(F.col("d") * F.col("target"))).first()[0] or 0.0) + step * goal
        length = next((t for i, t in enumerate(LENGTHS) if along[f"t{i}"] - t * fixed <= 1e-4 * t * slope), LENGTHS[-1])
        if at["error"] < 1e-4 and abs(over) < 1e-4 * goal:
            length = 1.0  # changes of the dual are below its rounding here
        state, mu = moved.select("source", "target", (F.col("lam") + length * F.col("d")).alias("lam")), mu + length * step
    raise ArithmeticError(f"the Newton steps leave an error of {at['error']}")


def _round(docs: Column, most: int) -> Column:
    """Copies of documents (size, rate), largest first: each takes the number that brings the lot's tokens nearest to what is due so far."""
    start = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<int>").alias("copies"))

    def step(acc: Column, doc: Column) -> Column:
        due = acc["due"] + doc["rate"] * doc["size"]
        copies = F.greatest(F.lit(0), F.least(F.lit(most), F.round(due / doc["size"]).cast("int")))
        return F.struct((due - copies * doc["size"]).alias("due"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    return F.aggregate(docs, start, step, lambda acc: acc["copies"])


def mix(docs: DataFrame, share: float = 1.5, weights: tuple = (5.0, 2.0, 1.0), most: float = 2.0, lot: int = LOT, keep: list[str] | None = None) -> DataFrame:
    """(source, text and other columns) -> the columns `keep` (all by default) with size, source_size, target, `rate` and `copies` (0 to `most`).

    Nulls: a null source is a source of its own, the last one; a null or empty text has
    size 0, rate 0 and no copies. Repeated rows are rows of their own, with one rate; ties in size go by row id. An
    empty table gives an empty result. Long texts and long words are counted whole. Columns of any name pass through, but those of the five names are replaced. Reruns agree.
    A hot source is rounded in lots of about `lot` documents, each by itself.
    """
    new = ("size", "source_size", "target", "rate", "copies")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = with_rid(docs.select(F.struct(F.lit(0).alias("__0"), *[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col("source"), words_of(F.col("text")).alias("size")), "__rid")
    thin = stash(rows.select("__rid", "source", "size"))
    units = stash(thin.groupBy("source", "size").agg(F.count("*").alias("n")))
    stats = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs"))
    stats = stash(stats)
    wanted = stash(targets(stats.select("source", "source_size"), share, list(weights), most))
    found, mu = multipliers(units, wanted, most)
    plan = wanted.alias("w").join(found.alias("m"), F.col("w.source").eqNullSafe(F.col("m.source")), "left")
    plan = plan.join(stats.alias("t"), F.col("w.source").eqNullSafe(F.col("t.source")))
    fixed = F.when(F.col("w.target") > 0, F.lit(float(most))).otherwise(0.0)
    plan = stash(plan.select(F.col("w.source").alias("p_source"), F.col("w.source_size").alias("p_size"), F.col("w.target").alias("p_target"), "m.lam", fixed.alias("fixed"), F.greatest(F.lit(1), F.ceil(F.col("t.n_docs") / lot)).alias("lots")))
    discard(units)
    rate = F.when(F.col("size") > 0, F.coalesce(rate_of(F.col("size"), F.col("lam"), F.lit(mu), most), F.col("fixed"))).otherwise(0.0)

    dealt = thin.filter("size > 0").join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumns({"lot": F.pmod(F.xxhash64("__rid"), F.col("lots")), "rate": rate})
    by_lot = dealt.groupBy("p_source", "lot").agg(F.sort_array(F.collect_list(F.struct("size", "__rid", "rate")), asc=False).alias("docs"))
    copies = by_lot.select(F.explode(F.arrays_zip(F.col("docs.__rid").alias("rid"), _round(F.col("docs"), int(most)).alias("copies"))).alias("x")).select(F.col("x.rid").alias("__rid"), F.col("x.copies").alias("copies"))
    out = rows.join(copies, "__rid", "left").join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left")
    return out.select("__row.*", "size", F.col("p_size").alias("source_size"), F.col("p_target").alias("target"), rate.alias("rate"), F.coalesce("copies", F.lit(0)).alias("copies")).drop("__0")
