"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` positions that overlap by a filter's width
less one, so no position of the whole document is missed. Each of ``FILTERS`` learned filters
looks at ``WIDTH`` embedded bytes; a chunk keeps each filter's maximum, and ``UNITS`` learned units
combine a chunk's maxima. Chunks are short: one in which little but the same word occurs lacks most
maxima that prose has, which a unit can tell. The largest and the mean of every unit over the chunks
go through one logistic layer: one probability a document.

Since inputs are bytes, a filter's response is a sum of table rows; tables of byte pairs make it
three look-ups a position. Short documents are scored together in one array, long ones in slices.

Training: labelled rows of the training folds in the order of a hash of the id, at most
``MOST_DOCS`` and as many as have ``MOST_BYTES`` together, with the whole text of each. This bound is for
learning only; scoring reads every byte. ``STEPS`` steps of Adam on ``BATCH`` documents each
whatever the number of rows, fixed seed, rows in a fixed order.

Nulls and corner cases: a null or empty text is scored as ``WIDTH`` zero bytes; rows without a
label, or whose label is not 0 or 1, teach nothing; without any usable labels, or with one class
only, the score is that class's rate (0.5 without labels); rows that repeat an id teach once (the
smallest text); repeated rows get equal scores; a null doc_id is held out; an empty table gives no
rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stored

WIDTH, FILTERS, EMBED, CHUNK, UNITS = 6, 24, 8, 128, 16
MOST_DOCS, MOST_BYTES, STEPS, BATCH, RATE = 5000, 24 << 20, 500, 48, 0.01
#: Chunks that are looked at in one array.
SLICE = 256


def octets(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(data.ljust(WIDTH, b"\0"), np.uint8)


def chunked(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes in one array, first and last-but-one position of each chunk, first chunk of each document)."""
    at, starts, ends, first = 0, [], [], []
    for data in docs:
        n = len(data) - WIDTH + 1
        own = np.arange(0, n, CHUNK)
        first.append(sum(map(len, starts)))
        starts.append(own + at)
        ends.append(np.minimum(own + CHUNK, n) + at)
        at += len(data)
    return np.concatenate(docs), np.concatenate(starts), np.concatenate(ends), np.array(first)


class Net:
    """Parameters: ``embed`` (256, E), ``filters`` (WIDTH, E, F), ``bias`` (F), ``units`` (F, U), ``offset`` (U), ``out`` (2 U), ``base``."""

    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        self.embed = g.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = g.normal(0, 0.3, (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.units = g.normal(0, 0.25, (FILTERS, UNITS)).astype(np.float32)
        self.offset = np.full(UNITS, 0.1, np.float32)
        self.out = g.normal(0, 0.1, 2 * UNITS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.pairs: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": None}

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.units, self.offset, self.out, self.base]

    def pair_tables(self) -> list[np.ndarray]:
        if self.pairs is None:
            t = np.einsum("be,kef->kbf", self.embed, self.filters)
            self.pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]
        return self.pairs

    def heard(self, data: np.ndarray) -> np.ndarray:
        """Each filter's response at each position."""
        pair, n = (data[:-1].astype(np.uint16) << 8) | data[1:], len(data) - WIDTH + 1
        tables = self.pair_tables()
        out = tables[0].take(pair[:n], axis=0)
        for k in range(1, WIDTH // 2):
            out += tables[k].take(pair[2 * k : n + 2 * k], axis=0)
        return out

    def tops(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each chunk's maximum of each filter, ``SLICE`` chunks at a time."""
        out = []
        for at in range(0, len(starts), SLICE):
            a, b = starts[at : at + SLICE], ends[at : at + SLICE]
            heard = self.heard(data[a[0] : b[-1] + WIDTH - 1])
            # Between the end of a chunk and the start of the next lie positions across two documents.
            bounds = np.stack([a, b], axis=1).ravel()[:-1] - a[0]
            out.append(np.maximum.reduceat(heard, bounds, axis=0)[::2])
        return np.concatenate(out)

    def excited(self, tops: np.ndarray) -> np.ndarray:
        """Each chunk's units."""
        return np.maximum(np.maximum(tops + self.bias, 0) @ self.units + self.offset, 0)

    def seen(self, excited: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The inputs of the last layer for each document: largest and mean value of each unit."""
        n = np.diff(np.append(first, len(excited)))[:, None]
        return np.hstack([np.maximum.reduceat(excited, first, axis=0), np.add.reduceat(excited, first, axis=0) / n])

    def probabilities(self, docs: list[np.ndarray]) -> np.ndarray:
        data, starts, ends, first = chunked(docs)
        z = self.seen(self.excited(self.tops(data, starts, ends)), first).astype(np.float64) @ self.out + self.base[0]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
        data, starts, ends, first = chunked(docs)
        f = np.arange(FILTERS)
        tops, where = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts), FILTERS), np.int64)
        for at in range(0, len(starts), SLICE):
            a, b = starts[at : at + SLICE], ends[at : at + SLICE]
            heard = self.heard(data[a[0] : b[-1] + WIDTH - 1])
            for k, (x, y) in enumerate(zip((a - a[0]).tolist(), (b - a[0]).tolist(), strict=True), at):
                best = heard[x:y].argmax(axis=0) + x
                tops[k], where[k] = heard[best, f], best + a[0]
        excited = self.excited(tops)
        seen = self.seen(excited, first)
        g = ((1 / (1 + np.exp(-np.clip(seen @ self.out + self.base[0], -30, 30))) - labels) / len(docs)).astype(np.float32)
        n = np.diff(np.append(first, len(tops)))
        of = np.repeat(np.arange(len(docs)), n)
        d_units = (g / n)[of][:, None] * self.out[None, UNITS:]
        # The largest value of a unit in a document: its first chunk that reaches it.
        for i, (a, m) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
            d_units[a + excited[a : a + m].argmax(axis=0), np.arange(UNITS)] += g[i] * self.out[:UNITS]
        d_units *= excited > 0
        clipped = np.maximum(tops + self.bias, 0)
        d_tops = (d_units @ self.units.T) * (clipped > 0)
        d_tables = np.empty((WIDTH, 256, FILTERS), np.float32)
        for k in range(WIDTH):
            flat = data[where + k].astype(np.int64) * FILTERS + f
            d_tables[k] = np.bincount(flat.ravel(), d_tops.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return [np.einsum("kbf,kef->be", d_tables, self.filters), np.einsum("be,kbf->kef", self.embed, d_tables), d_tops.sum(axis=0), clipped.T @ d_units, d_units.sum(axis=0), g @ seen, g.sum(keepdims=True)]

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Net:
        g = np.random.default_rng(seed)
        self.base[0] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
        m, v, order = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()], np.empty(0, np.int64)
        for t in range(1, steps + 1):
            while len(order) < BATCH:
                order = np.append(order, g.permutation(len(docs)))
            own, order, rate = order[:BATCH], order[BATCH:], RATE * (1 - (t - 1) / steps)
            for p, d, a, b in zip(self.parameters(), self.gradients([docs[i] for i in own], labels[own]), m, v, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            self.pairs = None
        return self


class Constant:
    """What is left to say without labels of both classes."""

    def __init__(self, rate: float):
        self.rate = rate

    def probabilities(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.full(len(docs), self.rate)


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, *, most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES, held_out_fold: int = 0) -> Net | Constant:
    """A classifier from ``labels`` (doc_id, quality) of documents outside the held-out fold."""
    usable = labels.select("doc_id", F.col("quality").cast("long").alias("quality")).where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != held_out_fold)).dropDuplicates()
    chosen = usable.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id", "quality").limit(most_docs)
    # Rows that repeat an id teach once, so what reaches the driver is bounded.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("place", "doc_id", "quality").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    lessons = stored(texts.withColumn("size", F.octet_length("text").cast("long")), "net-lessons")
    kept, left = [], most_bytes
    for place, doc, size in lessons.select("place", "doc_id", "size").distinct().orderBy("place", "doc_id").collect():
        left -= size
        if left >= 0 or not kept:
            kept.append(place)
    lessons = lessons.where(F.col("place") <= kept[-1]).orderBy("place", "doc_id", "quality").select("quality", "text").collect() if kept else []
    marks = np.array([r.quality for r in lessons], np.float32)
    if len(set(marks.tolist())) < 2:
        return Constant(float(marks[0]) if len(marks) else 0.5)
    return Net().fit([octets(r.text) for r in lessons], marks)


def _score(batches: Iterator[pa.RecordBatch], model: Net | Constant, columns: list[str], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            scores, group, size = [], [], 0
            for text in part.column(text_col).to_pylist():
                group.append(octets(text))
                size += len(group[-1])
                if size >= SLICE * CHUNK:
                    scores.append(model.probabilities(group))
                    group, size = [], 0
            if group:
                scores.append(model.probabilities(group))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(np.concatenate(scores), pa.float64())], names=[*columns, "_score"])


def score(docs: DataFrame, model: Net | Constant, *, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and ``_score``, the probability of label 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = docs.select(*dict.fromkeys([*columns, text_col]))
    schema = StructType([*(kept.schema[c] for c in columns), StructField("_score", DoubleType())])
    return kept.mapInArrow(partial(_score, model=model, columns=columns, text_col=text_col), schema)


def op9_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs, load(spark, sf_dir, "labels"))
    scored = score(docs, model, columns=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
