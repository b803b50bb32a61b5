"""Quality classifier: a byte-level convolutional network in numpy.

Each filter has a weight for each byte at each of `WIDTH` places. A text is covered
by overlapping chunks of two blocks; within each chunk the filters' outputs are max-pooled, and the
chunks' maxima go, as their largest and their mean over the whole text, into one
logistic unit. Nothing but the bytes of a text enters its score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import packed, schema_of, small_batches, unpacked

WIDTH, FILTERS, BLOCK = 5, 16, 256
#: Bound of the training sample: rows, and bytes of each text that are learnt from.
TRAIN_ROWS, TRAIN_BYTES = 2500, 32_768
EPOCHS, BATCH, RATE = 10, 32, 0.01
#: Bytes that a task convolves at once.
GROUP_BYTES = 1 << 17


class Net:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.filters = (rng.normal(size=(WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.dense = (rng.normal(size=2 * FILTERS) * 0.1).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def convolve(self, data: np.ndarray) -> np.ndarray:
        """Outputs at each of the first len(data) - WIDTH + 1 places."""
        n = len(data) - WIDTH + 1
        out = np.take(self.filters[0], data[:n], axis=0)
        for o in range(1, WIDTH):
            out += np.take(self.filters[o], data[o : o + n], axis=0)
        return out

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest and mean chunk maximum of each filter for each text; zeros for empty ones. A single long text goes piece by piece."""
        lengths = np.diff(offsets)
        docs = len(lengths)
        if docs == 1 and lengths[0] > GROUP_BYTES:
            return self._long(data[int(offsets[0]) : int(offsets[1])])[None]
        out = np.zeros((docs, 2 * FILTERS), np.float32)
        full = np.flatnonzero(lengths)
        if not len(full):
            return out
        lengths = lengths[full]
        begin = np.cumsum(lengths + WIDTH - 1) - (lengths + WIDTH - 1)  # zeros after each text
        padded = np.zeros(int((lengths + WIDTH - 1).sum()), np.uint8)
        padded[np.repeat(begin, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = data[int(offsets[0]) : int(offsets[-1])]
        outputs = self.convolve(padded)
        blocks = -(-lengths // BLOCK)
        first = np.cumsum(blocks) - blocks
        starts = np.repeat(begin, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(first, blocks))
        # a text's last block also ends at its last byte: what follows are places that read the next text
        ends = np.minimum(starts + BLOCK, np.repeat(begin + lengths, blocks))
        cuts = np.stack([starts, ends], 1).ravel()
        if cuts[-1] >= len(outputs):
            cuts = cuts[:-1]
        top = np.maximum.reduceat(outputs, cuts, axis=0)[::2]
        chunk = top.copy()  # of a block and the next one of the text
        inner = np.ones(len(top), bool)
        inner[first + blocks - 1] = False
        chunk[inner] = np.maximum(top[inner], top[np.flatnonzero(inner) + 1])
        chunk = np.maximum(chunk + self.bias, 0)
        out[full, :FILTERS] = np.maximum.reduceat(chunk, first, axis=0)
        out[full, FILTERS:] = np.add.reduceat(chunk, first, axis=0) / blocks[:, None]
        return out

    def _long(self, text: np.ndarray) -> np.ndarray:
        """The features of one text, of which `GROUP_BYTES` are convolved at once."""
        largest, total, before = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), None
        for at in range(0, len(text), GROUP_BYTES):  # whole blocks
            piece = text[at : at + GROUP_BYTES + WIDTH - 1]
            outputs = self.convolve(np.pad(piece, (0, max(0, min(GROUP_BYTES, len(text) - at) + WIDTH - 1 - len(piece)))))
            top = np.maximum.reduceat(outputs, np.arange(0, len(outputs), BLOCK), axis=0)
            if before is not None:
                top = np.concatenate([before, top])
            before = top[-1:]
            chunk = np.maximum(np.maximum(top[:-1], top[1:]) + self.bias, 0)
            total += chunk.sum(0, dtype=np.float64)
            largest = np.maximum(largest, chunk.max(0, initial=0))
        chunk = np.maximum(before[0] + self.bias, 0)  # the last block has none after it
        return np.concatenate([np.maximum(largest, chunk), (total + chunk) / -(-len(text) // BLOCK)]).astype(np.float32)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.features(data, offsets).astype(np.float64) @ self.dense.astype(np.float64) + float(self.offset[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, text: np.ndarray, label: int, weight: float):
        """Of the log loss for one text: (bytes' places and amounts for the filters, bias, dense, offset)."""
        n = len(text)
        blocks = -(-n // BLOCK)
        padded = np.zeros(blocks * BLOCK + WIDTH - 1, np.uint8)
        padded[:n] = text
        outputs = self.convolve(padded)
        outputs[n:] = -np.inf
        view = outputs.reshape(blocks, BLOCK, FILTERS)
        where = view.argmax(1) + BLOCK * np.arange(blocks)[:, None]
        top = np.take_along_axis(outputs, where, 0)
        if blocks > 1:
            later = top[1:] > top[:-1]
            chunk, at = top.copy(), where.copy()
            chunk[:-1] = np.where(later, top[1:], top[:-1])
            at[:-1] = np.where(later, where[1:], where[:-1])
        else:
            chunk, at = top, where
        live = chunk + self.bias
        chunk = np.maximum(live, 0)
        largest = chunk.argmax(0)
        x = np.concatenate([chunk.max(0), chunk.mean(0)])
        z = float(x @ self.dense + self.offset[0])
        delta = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        back = np.tile(delta * self.dense[FILTERS:] / blocks, (blocks, 1))
        back[largest, np.arange(FILTERS)] += delta * self.dense[:FILTERS]
        back *= live > 0
        return padded, at, back, delta * x, delta

    def train(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 9) -> Net:
        rng = np.random.default_rng(seed)
        data = [np.frombuffer(t, np.uint8) for t in texts]
        usable = np.array([i for i, t in enumerate(data) if len(t)], np.int64)
        share = float(np.mean([labels[i] for i in usable])) if len(usable) else 0.5
        weights = {1: 0.5 / max(share, 1e-3), 0: 0.5 / max(1 - share, 1e-3)}
        params = [self.filters, self.bias, self.dense, self.offset]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(epochs):
            rng.shuffle(usable)
            for i in range(0, len(usable), BATCH):
                grads = [np.zeros_like(p) for p in params]
                some = usable[i : i + BATCH]
                for d in some.tolist():
                    padded, at, back, dense, delta = self.gradients(data[d], labels[d], weights[labels[d]] / len(some))
                    column = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for o in range(WIDTH):
                        np.add.at(grads[0][o], (padded[at + o], column), back)
                    grads[1] += back.sum(0)
                    grads[2] += dense
                    grads[3] += delta
                step += 1
                for p, g, (m, v) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(model.value)
        for batch in batches:
            data, offsets = tx.binary_column(batch.column("text"))
            scores = np.zeros(batch.num_rows)
            for i, j in tx.groups_of_docs(offsets, GROUP_BYTES):
                scores[i:j] = net.scores(data, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(scores)], names=["__row", "score"])

    return run


def held_out(doc_id):
    """Rows that no model has learnt from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Net:
    """Fit on a bounded sample: up to `rows` labelled rows that are not held out, those of least hash.

    Only labels with a text of at least one byte count. Of a text of more than `most` bytes, a window of that length is learnt
    from, at a place that the id's hash chooses. Null labels and ids are no labels. Without any row there is an
    error if there are documents to score; of an empty table the initial network is returned.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("l_quality"))
    order = [F.xxhash64(F.col("l_id"), F.lit("sample")), F.col("l_id"), F.col("l_quality")]
    usable = docs.filter(F.octet_length("text") > 0)
    chosen = known.join(usable.select("doc_id"), F.col("doc_id") == F.col("l_id")).select("l_id", "l_quality").orderBy(*order).limit(rows).distinct()
    size = F.octet_length("text")
    begin = F.pmod(F.xxhash64("l_id", F.lit("window")), F.greatest(size - most + 1, F.lit(1))) + 1
    texts = usable.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    texts = texts.select(*order, F.substring("text", begin.cast("int"), F.lit(most))).toDF("h", "id", "quality", "text")
    sample = texts.orderBy("h", "id", "quality", "text").limit(rows).collect()
    if not sample and not docs.isEmpty():
        raise ValueError("documents to score, but no labelled text to learn from")
    return Net().train([bytes(r["text"]) for r in sample], [r["quality"] for r in sample])


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str], net: Net | None = None) -> DataFrame:
    """The columns `keep` and `score`, the probability of quality 1, for every whole text.

    Null and empty texts get the score of no evidence. Repeated rows get equal scores; an empty table
    gives an empty result. Long texts go through piece by piece. A kept column named score is replaced; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    net = net or train_quality(docs, labels)
    model = spark.sparkContext.broadcast(pickle.dumps(net))
    rows = packed(docs, keep, F.col("text").cast("binary").alias("text"))
    return unpacked(rows.mapInArrow(_score(model), schema_of(rows, ["__row"], "score double")), "score")
