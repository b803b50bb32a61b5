"""Language identification by interpolated Kneser-Ney models of characters.

A text becomes symbols: its letters and marks in lower case, each run of anything else as one break. A symbol has 12 bits, so
that five of them pack into one long, of which shifts and masks cut contexts and shorter grams: counting, discounts and probabilities are
Spark aggregations and joins over these longs. What scoring needs of a language is stored in sorted arrays of
hashes (the grams modulo a prime), so a model has a bound that no corpus exceeds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, packed, schema_of, small_batches, stash, unpacked, with_rid

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
#: The symbol of what is neither letter nor mark; 0 stands before a text's first symbol.
BREAK = 1
#: Grams are stored modulo this prime (of 22 bits), so an order of a language has at most so many entries. Two grams with one hash share the larger value.
SLOTS = 4_194_301
#: Entries (of eight bytes) of the models that a task holds at once; more languages are scored in several passes. At least one language is.
BLOCK_ENTRIES = 1 << 24
#: Characters that are taken at once; longer texts go in pieces.
PIECE = 1 << 19
#: Share of the learnable documents that calibrates scores and limits instead of being counted: one of so many.
CALIBRATION = 10
#: Standard deviations above a language's usual cross-entropy at which a text is none of the known languages.
DEVIATIONS = 5.0


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its symbol, and whether it is a letter."""
    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(0x110000)])
    points = np.arange(0x110000, dtype=np.uint64)
    symbol = np.where(points < SYMBOLS, points, 2 + (points * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(SYMBOLS - 2))
    return np.where((kinds == "L") | (kinds == "M"), symbol, BREAK).astype(np.int64), kinds == "L"


def _grams(symbols: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The packed gram that ends at each symbol. first: where documents begin; before: the symbols before the first one."""
    doc = np.searchsorted(first, np.arange(len(symbols)), "right")
    padded = np.zeros(len(symbols) + (ORDER - 1) * len(first), np.int64)
    padded[: ORDER - 1] = before
    at = np.arange(len(symbols)) + (ORDER - 1) * doc
    padded[at] = symbols
    return reduce(lambda g, k: (g << BITS) | padded[at - k], range(ORDER - 1, -1, -1), np.zeros(len(at), np.int64))


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Packed grams of texts in pieces of bounded size: (first document, where the piece's documents begin, grams, whether each document has a letter there)."""
    table, is_letter = _alphabet()
    texts = [(t or "").lower() for t in texts]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= PIECE):
            size += len(texts[j])
            j += 1
        whole = "".join(texts[i:j])
        begins = np.cumsum([0, *map(len, texts[i : j - 1])]).astype(np.int64)
        before, last = np.zeros(ORDER - 1, np.int64), 0
        for a in range(0, max(len(whole), 1), PIECE if j == i + 1 else len(whole) + 1):  # only a single text is cut
            part = whole[a : a + PIECE] if j == i + 1 else whole
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
            symbols = table[points]
            previous = np.concatenate([[last], symbols[:-1]])
            inside = begins[(begins > 0) & (begins < len(points))]
            previous[inside] = 0
            keep = (symbols != BREAK) | (previous != BREAK)
            kept = np.concatenate([[0], np.cumsum(keep)])
            letters = np.concatenate([[0], np.cumsum(is_letter[points])])
            ends = np.append(begins[1:], len(points))
            first = kept[begins]
            found = _grams(symbols[keep], first, before)
            yield i, first, found, letters[ends] > letters[begins]
            if len(found):
                before = (found[-1] >> (BITS * np.arange(ORDER - 2, -1, -1))) & (SYMBOLS - 1)
                last = int(symbols[-1])
        i = j


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs], np.int64)
        for i, first, found, _ in grams(texts):
            lang = np.repeat(number[i : i + len(first)], np.diff(np.append(first, len(found))))
            for k in np.unique(lang):
                key, n = np.unique(found[lang == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(key), pa.string()), pa.array(key), pa.array(n)], names=["lang", "g", "c"])


def train(known: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, n, kind, slot, value): log probabilities (kind 0) of grams of n symbols, log weights (kind 1) of contexts of n - 1.

    Counts cover every text. The highest order counts occurrences, lower ones the distinct symbols before a gram.
    """
    made = [stash(known.mapInArrow(_counts, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")))]
    for n in range(ORDER - 1, 0, -1):
        made.append(stash(made[-1].groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << (BITS * n)) - 1)).alias("g")).agg(F.count("*").alias("c"))))
    lower, entries = None, []
    for n in range(1, ORDER + 1):
        level = made[ORDER - n].withColumn("h", F.shiftright("g", BITS))
        once, twice = (F.sum((F.col("c") == k).cast("double")) for k in (1, 2))
        discount = level.groupBy("lang").agg(F.greatest(F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.0)), F.lit(0.1)).alias("d"))
        contexts = level.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.count("*").alias("types")).join(F.broadcast(discount), "lang").withColumn("gamma", F.col("d") * F.col("types") / F.col("total"))
        p = level.join(contexts, ["lang", "h"])
        if lower is None:
            p = p.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            p = p.join(lower.select("lang", F.col("g").alias("s"), F.col("p").alias("below")), (p["lang"] == lower["lang"]) & (p["g"].bitwiseAND(F.lit((1 << (BITS * (n - 1))) - 1)) == F.col("s"))).drop(lower["lang"])
        lower = stash(p.select("lang", "g", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("below")).alias("p")))
        for kind, df, key, value in ((0, lower, "g", "p"), (1, contexts, "h", "gamma")):
            entries.append(df.select("lang", F.lit(n).alias("n"), F.lit(kind).alias("kind"), (F.col(key) % SLOTS).cast("int").alias("slot"), F.log(value).cast("float").alias("value")))
    stored = stash(reduce(DataFrame.unionByName, entries).groupBy("lang", "n", "kind", "slot").agg(F.max("value").alias("value")))
    discard(*made)
    return stored


class Model:
    """One language: for each order the sorted hashes of grams and contexts with their values."""

    def __init__(self, n: np.ndarray, kind: np.ndarray, slot: np.ndarray, value: np.ndarray):
        self.arrays = {}
        for order in range(1, ORDER + 1):
            for k in (0, 1):
                mine = (n == order) & (kind == k)
                by = np.argsort(slot[mine])
                self.arrays[order, k] = slot[mine][by], value[mine][by]

    def _find(self, order: int, kind: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots, values = self.arrays[order, kind]
        want = (grams % SLOTS).astype(np.int32)
        if not len(slots):
            return np.zeros(len(want), bool), np.zeros(len(want))
        at = np.minimum(np.searchsorted(slots, want), len(slots) - 1)
        return slots[at] == want, values[at].astype(np.float64)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Of each gram's last symbol after the ones before it, from the longest stored gram and the weights of the contexts above."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            mine = grams[left] & ((1 << (BITS * n)) - 1)
            hit, value = self._find(n, 0, mine)
            out[left[hit]] += value[hit]
            left, mine = left[~hit], mine[~hit]
            has, weight = self._find(n, 1, mine >> BITS)
            out[left] += np.where(has, weight, 0.0)
        out[left] -= np.log(SYMBOLS)
        return out


class _Known:
    """Log probabilities of grams under each model, kept for the next texts of a task (up to `most` grams)."""

    def __init__(self, models: list[Model], most: int = 1 << 18):
        self.models, self.most = models, most
        self.grams, self.values = np.zeros(0, np.int64), np.zeros((len(models), 0))

    def __call__(self, distinct: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, distinct)
        found = at < len(self.grams)
        found[found] = self.grams[at[found]] == distinct[found]
        out = np.zeros((len(self.models), len(distinct)))
        out[:, found] = self.values[:, at[found]]
        fresh = distinct[~found]
        for k, model in enumerate(self.models):
            out[k, ~found] = model.log_probability(fresh)
        if len(self.grams) + len(fresh) > self.most:
            self.grams, self.values = distinct, out
        elif len(fresh):
            grams = np.concatenate([self.grams, fresh])
            by = np.argsort(grams, kind="stable")
            self.grams, self.values = grams[by], np.concatenate([self.values, out[:, ~found]], 1)[:, by]
        return out


def _scores(models, keep: list[str]):
    """models: broadcast list of models. Adds n_symbols, has_letter and each model's total of -log p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(models.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            total, size, letter = np.zeros((len(texts), len(models.value))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
            for i, first, found, letters in grams(texts):
                docs = slice(i, i + len(first))
                sizes = np.diff(np.append(first, len(found)))
                size[docs] += sizes
                letter[docs] |= letters
                distinct, place = np.unique(found, return_inverse=True)
                for k, logs in enumerate(known(distinct)):
                    sums = np.concatenate([[0.0], np.cumsum(logs[place])])
                    total[docs, k] -= sums[first + sizes] - sums[first]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(size), pa.array(letter), lists], names=[*keep, "n_symbols", "has_letter", "total"])

    return run


def _blocks(stored: DataFrame, most: int) -> list[list[str]]:
    out, held = [], 0
    for r in sorted(stored.groupBy("lang").count().collect()):
        if not out or held + r["count"] > most:
            out.append([])
            held = 0
        out[-1].append(r["lang"])
        held += r["count"]
    return out


def _load(stored: DataFrame, langs: list[str]) -> list[Model]:
    found = stored.filter(F.col("lang").isin(langs)).toArrow()
    lang = found["lang"].combine_chunks().to_pandas().to_numpy()
    columns = [found[c].to_numpy() for c in ("n", "kind", "slot", "value")]
    return [Model(*(c[lang == name] for c in columns)) for name in langs]


def entropies(rows: DataFrame, stored: DataFrame, most: int = BLOCK_ENTRIES) -> tuple[list[str], DataFrame]:
    """(__row, text) -> the languages, and (__row, n_symbols, has_letter, ce): nats a symbol under each language, in their order.

    Each pass holds the models of a block of languages (of up to `most` entries, or one) in a task, and covers all rows.
    """
    spark, names, parts = rows.sparkSession, [], []
    blocks = _blocks(stored, most)
    if len(blocks) > 1:
        rows = with_rid(rows, "__rid")
    for k, langs in enumerate(blocks or [[]]):
        models = spark.sparkContext.broadcast(_load(stored, langs) if langs else [])
        keep = [c for c in rows.columns if c != "text" and (k == 0 or c == "__rid")]
        part = rows.select(*keep, "text").mapInArrow(_scores(models, keep), schema_of(rows, keep, "n_symbols long, has_letter boolean, total array<double>"))
        parts.append(part if len(blocks) < 2 else stash(part))
        names += langs
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part.select("__rid", F.col("total").alias("more")), "__rid").select("__rid", "__row", "n_symbols", "has_letter", F.concat("total", "more").alias("total"))
    per = F.transform("total", lambda x: x / F.greatest("n_symbols", F.lit(1)))
    return names, out.select("__row", "n_symbols", "has_letter", per.alias("ce"))


def _decided(scored: DataFrame, names: list[str]) -> DataFrame:
    """Adds best (place of the least ce, the first of equals), its ce and x, the lead over the second times the root of the length."""
    ordered = F.array_sort("ce")
    best = F.array_position("ce", ordered[0])
    lead = F.coalesce(F.get(ordered, F.lit(1)) - ordered[0], F.lit(0.0))
    return scored.select("*", F.when(F.size("ce") > 0, best).cast("int").alias("best"), F.get(ordered, F.lit(0)).alias("least"), (lead * F.sqrt("n_symbols")).alias("x"))


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Offset and slope of P(right) over bins (x, right, all), by Newton with smoothed targets."""
    right, every = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not every:
        return 0.0, 1.0
    high, low = (right + 1) / (right + 2), 1 / (every - right + 2)
    x, n = np.array([b[0] for b in bins]), np.array([b[2] for b in bins], float)
    y = np.array([(b[1] * high + (b[2] - b[1]) * low) / b[2] for b in bins])
    design, w = np.stack([np.ones_like(x), x], 1), np.array([0.0, 1.0])
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, design.T @ (n * (y - p)) - ridge @ (w - [0.0, 1.0]))
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _calibrated(decided: DataFrame, truth: Column, names: list[str]) -> tuple[tuple[float, float], list[tuple[float, float, float]]]:
    """The curve from x to P(right), and for each language mean ce, and t, s of the deviation sqrt(t + s / n_symbols)."""
    known = decided.filter("n_symbols > 0 AND best IS NOT NULL").select("*", truth.alias("truth"), (F.element_at(F.array(*map(F.lit, names)), F.col("best")) == truth).alias("right"))
    bins = known.groupBy(F.least(F.round(F.col("x") * 5), F.lit(500.0)).alias("bin")).agg(F.sum(F.col("right").cast("long")), F.count("*")).collect()
    curve = _logistic([(r[0] / 5, r[1], r[2]) for r in bins])
    own = known.filter("right").select("best", "least", "n_symbols")
    mean = {r[0]: r[1] for r in own.groupBy("best").agg(F.sum(F.col("least") * F.col("n_symbols")) / F.sum("n_symbols")).collect()}
    limits = [(float("inf"), 0.0, 0.0)] * len(names)
    if mean:
        usual = F.element_at(F.create_map(*[F.lit(x) for k, v in mean.items() for x in (k, v)]), F.col("best"))
        r2, u = (F.col("least") - usual) ** 2, 1 / F.col("n_symbols")
        for r in own.groupBy("best").agg(F.count("*").alias("n"), F.sum(u).alias("u"), F.sum(u * u).alias("uu"), F.sum(r2).alias("r"), F.sum(r2 * u).alias("ru")).collect():
            spread = r["n"] * r["uu"] - r["u"] ** 2
            s = (r["n"] * r["ru"] - r["u"] * r["r"]) / spread if spread > 1e-12 else 0.0
            s = min(max(s, 0.0), r["r"] / r["u"])
            limits[r["best"] - 1] = mean[r["best"]], max((r["r"] - s * r["u"]) / r["n"], 1e-4), s
    return curve, limits


def identify(docs: DataFrame, learn: Column, keep: list[str] | None = None, part: Column | None = None, most: int = BLOCK_ENTRIES) -> DataFrame:
    """Add lang_pred, score, rejected, cross_entropy and n_symbols to the columns `keep` (all) of (doc_id, text, lang, ...).

    learn: which rows' lang may be learnt from (those of null lang or without text never are). part: of these, which calibrate (by default a tenth, by the
    hash of doc_id); if no other rows are left, all do both. lang_pred is the language of lowest cross-entropy a symbol, the first by name of equals,
    and `und` for texts that are null or have no letter, and where nothing was learnt; these score 0. score is the calibrated
    probability that the language is right. rejected: und, a score under one half, or a cross-entropy far above the language's usual one.

    Repeated rows are rows of their own; an empty table gives an empty result. Long texts are taken whole, in pieces.
    Other columns pass through, but those of the five names are replaced.
    """
    small_batches(docs.sparkSession)
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATION)) == 0 if part is None else part
    usable = docs.filter(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("text", "lang", F.coalesce(part, F.lit(False)).alias("part"))
    stored = train(usable.filter("NOT part").select("lang", "text"))
    if stored.isEmpty():
        discard(stored)
        stored = train(usable.select("lang", "text"))
    names, scored = entropies(usable.filter("part").select(F.struct("lang").alias("__row"), "text"), stored, most)
    curve, limits = (0.0, 1.0), []
    if names:
        measured = stash(_decided(scored, names))
        curve, limits = _calibrated(measured, F.col("__row.lang"), names)
        discard(measured)
    kept = docs.columns if keep is None else keep
    _, scored = entropies(packed(docs, kept, F.col("text")), stored, most)
    decided = _decided(scored, names)
    sure = F.col("has_letter") & F.col("best").isNotNull()
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("best")) if values else F.lit(None)
    score = F.when(sure, 1 / (1 + F.exp(-(F.lit(curve[0]) + F.lit(curve[1]) * F.col("x"))))).otherwise(0.0)
    limit = at([m for m, _, _ in limits]) + DEVIATIONS * F.sqrt(at([t for _, t, _ in limits]) + at([s for _, _, s in limits]) / F.col("n_symbols"))
    labelled = decided.select(
        "__row",
        F.when(sure, at(names)).otherwise("und").cast("string").alias("lang_pred"),
        score.alias("score"),
        (~sure | (score < 0.5) | F.coalesce(F.col("least") > limit, F.lit(False))).alias("rejected"),
        F.when(sure, F.col("least")).cast("double").alias("cross_entropy"),
        "n_symbols",
    )
    return unpacked(labelled, "lang_pred", "score", "rejected", "cross_entropy", "n_symbols")
