"""LM scoring: a log-bilinear neural model in numpy, trained by noise-contrastive estimation.

Counts. Token counts are taken from every training document by map-side tables that Spark merges;
nothing is sampled.

Vocabulary. Every word has a leaf of the model: the most frequent ones a leaf each, all others share
``SHARED`` leaves by a hash, in which a word has its smoothed share (all unseen words of a leaf together
have one such share). Leaves lie in classes by frequency: the ``SINGLE`` most frequent tokens are
classes themselves, the others form classes of ``MEMBERS`` leaves. So
p(word | context) = p(class | context) p(leaf | class, context) p(word | leaf), and the probabilities
of all known words and of the unseen ones sum to 1 after any context.

Model. The context vector is h = sum over the ``CONTEXT`` previous tokens of r[token] P[position], with
a matrix for each position; class and leaf are log-bilinear in it: exp(s[class] . h + b) normalised over
all classes, exp(q[leaf] . h + b) over the members of a class, each by batched matrix products. Before
a text's first token stands the end token.

Reading. Texts become leaves (two bytes a token) once, in a table in the shared folder from which the
model learns and is applied.

Training. Every training document is learned from once, in ``ROUNDS`` rounds that share the documents by a hash.
In a round each task starts from the current model and takes steps of noise-contrastive estimation
through its documents, for classes against noise from their counts and for leaves against noise
from their class's counts; what the tasks learned is averaged, each row by how often it was met. A
task sends its changes in pieces of bounded size that are summed in streams; one model (a few MB)
comes to the driver in each round, whatever the corpus.

Counts of words. The most frequent tokens, at most ``KNOWN``, travel to the driver and the executors
with their counts (entries of at most ``LONGEST`` bytes, longer words being named by a digest). Words
beyond these are joined with the counts of all words by a shuffle.

Nulls and corner cases: a null or empty text is its end token; a null doc_id is a training
document; without training documents every token is unknown and all classes and leaves are equally
likely; repeated rows are documents of their own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batcher, load, rows, shuffle_partitions, stored, words_of
from .quality_net import fold

KNOWN, LONGEST = 100_000, 48
#: Classes of one token, other classes and their leaves, and the leaves at the end that words share by a hash.
SINGLE, CLASSES, MEMBERS, SHARED = 32, 64, 128, 2048
DIMENSIONS, CONTEXT, ROUNDS = 15, 3, 2
BATCH, NOISE, LEAF_NOISE, RATE = 4096, 32, 1, 0.08
#: Pieces in which a task's changes of the model travel.
PIECES = 64
#: The end token holds white space, which no word can; it is the first leaf.
END = b"\n"


def named(word: bytes) -> bytes:
    """A word's token: itself, or a digest behind a tab if it is long."""
    if len(word) <= LONGEST:
        return word
    import xxhash

    return b"\t" + xxhash.xxh3_128_hexdigest(word).encode()


def tokens_of(text: str | None) -> list[bytes]:
    out = words_of(text)
    if out and max(map(len, out)) > LONGEST:
        out = [named(w) for w in out]
    out.append(END)
    return out


_COUNT = pa.schema([("token", pa.binary()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([named(w) for w in table], pa.binary()), pa.array(list(table.values()), pa.int64())], schema=_COUNT)
        table.clear()
        return out

    for (text,) in rows(batches, "text"):
        # Long words are named once, when the table goes.
        table.update(words_of(text))
        table[END] += 1
        if len(table) > 300_000:
            yield flush()
    if table:
        yield flush()


class Model:
    """Parameters: ``r`` (leaf, D), ``positions`` (CONTEXT * D, D), ``s`` (class, D + 1) and ``q`` (leaf, D + 1) with biases last.

    ``counts`` are the tokens of each leaf in training; leaves of a class stand together, so ``starts`` bounds them.
    """

    def __init__(self, counts: np.ndarray, seed: int = 3):
        g, n = np.random.default_rng(seed), len(counts)
        self.starts = np.append(np.arange(SINGLE), np.arange(SINGLE, n + 1, MEMBERS)).astype(np.int64)
        self.class_of = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)).astype(np.int64)
        mass = counts + 0.5
        self.leaf_share = mass / np.add.reduceat(mass, self.starts[:-1])[self.class_of]
        self.class_share = np.add.reduceat(mass, self.starts[:-1]) / mass.sum()
        #: Cumulated shares, for drawing leaves of a class: class c has the values from c to c + 1.
        self.upto = np.cumsum(self.leaf_share)
        self.r = g.normal(0, 0.3, (n, DIMENSIONS)).astype(np.float32)
        decay = [np.eye(DIMENSIONS) / (k + 1) for k in range(CONTEXT)]
        self.positions = np.concatenate(decay).astype(np.float32)
        self.s = np.hstack([np.zeros((len(self.class_share), DIMENSIONS)), np.log(self.class_share)[:, None]]).astype(np.float32)
        self.q = np.hstack([np.zeros((n, DIMENSIONS)), np.log(self.leaf_share)[:, None]]).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.positions, self.s, self.q]

    def log_probabilities(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """ln p(leaf | leaves before) of the places ``at``, normalised over all classes and over all leaves of the class."""
        h, leaf = _with_one(_before(self.r[padded]) @ self.positions)[at - CONTEXT], padded[at]
        of = self.class_of[leaf]
        out = np.einsum("nd,nd->n", h, self.s[of]).astype(np.float64)
        for k in range(0, len(h), BATCH):
            out[k : k + BATCH] -= _log_sum(h[k : k + BATCH], self.s)
        order = np.argsort(of, kind="stable")
        order = order[np.searchsorted(of[order], SINGLE) :]
        if len(order):
            out[order] += np.einsum("nd,nd->n", h[order], self.q[leaf[order]])
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            for own in np.split(order, cuts):
                c = of[own[0]]
                out[own] -= _log_sum(h[own], self.q[self.starts[c] : self.starts[c + 1]])
        return out


def _before(values: np.ndarray) -> np.ndarray:
    """The ``CONTEXT`` rows before each row but the first ``CONTEXT``, the nearest first."""
    n = len(values)
    return np.hstack([values[CONTEXT - k : n - k] for k in range(1, CONTEXT + 1)])


def _with_one(h: np.ndarray) -> np.ndarray:
    """Context vectors with a last 1 for the bias."""
    out = np.ones((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1] = h
    return out


def _log_sum(h: np.ndarray, rows_: np.ndarray) -> np.ndarray:
    """ln of the sum of exponentials of all scores, in double precision where single would overflow."""
    scores = h @ rows_.T
    if scores.max(initial=0) > 80:
        top = scores.max(axis=1, keepdims=True).astype(np.float64)
        return (top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True)))[:, 0]
    return np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32)).astype(np.float64)


def _sum_by(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids, sum of their rows, their number)."""
    order = np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[first], np.add.reduceat(values[order], first, axis=0), np.diff(np.append(first, len(own)))


def _certain(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, -30, 30)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class Learner:
    """Noise-contrastive steps from a model, and how often each row of its parameters was met."""

    def __init__(self, model: Model, seed: int):
        self.model, self.g = model, np.random.default_rng(seed)
        self.leaf_weight = np.log(LEAF_NOISE * model.leaf_share).astype(np.float32)
        self.now = [p.copy() for p in model.parameters()]
        self.met = [np.zeros(len(p), np.float32) for p in self.now]
        self.squares = [np.full(len(p), 1e-8, np.float32) for p in self.now]

    def _move(self, k: int, ids: np.ndarray, gradient: np.ndarray, times: np.ndarray) -> None:
        """AdaGrad with one scale for each row, so that frequent and rare rows both move."""
        self.met[k][ids] += times
        self.squares[k][ids] += (gradient * gradient).mean(axis=1)
        self.now[k][ids] -= RATE * gradient / np.sqrt(self.squares[k][ids])[:, None]

    def step(self, padded: np.ndarray, at: np.ndarray) -> None:
        """One step on the places ``at`` of some texts' leaves, each text behind its padding."""
        m, (r, positions, s, q), leaf = self.model, self.now, padded[CONTEXT:]
        x = _before(r[padded])
        h = _with_one(x @ positions)
        # Padding between two texts goes along, without a say.
        said = np.zeros(len(leaf), np.float32)
        said[at - CONTEXT] = 1
        # Classes: noise shared by the batch, drawn from their counts.
        of = m.class_of[leaf]
        noise = self.g.choice(len(m.class_share), NOISE, p=m.class_share)
        weight = np.log(NOISE * m.class_share).astype(np.float32)
        right = (_certain(np.einsum("nd,nd->n", h, s[of]) - weight[of]) - 1) * said
        wrong = _certain(h @ s[noise].T - weight[noise]) * said[:, None]
        d_h = right[:, None] * s[of] + wrong @ s[noise]
        ids, gradient, times = _sum_by(np.concatenate([of, noise]), np.concatenate([right[:, None] * h, wrong.T @ h]))
        # Leaves: noise of their own class, for those that aren't alone in it.
        many = np.flatnonzero(of >= SINGLE)
        if len(many):
            c, own = of[many], h[many]
            drawn = np.searchsorted(m.upto, c[:, None] + self.g.random((len(c), LEAF_NOISE)))
            drawn = np.clip(drawn, m.starts[c][:, None], m.starts[c + 1][:, None] - 1)
            all_leaves = np.hstack([leaf[many][:, None], drawn])
            taken = q[all_leaves]
            d = _certain(np.einsum("nd,nkd->nk", own, taken) - self.leaf_weight[all_leaves])
            d[:, 0] -= 1
            d_h[many] += np.einsum("nk,nkd->nd", d, taken)
            self._move(3, *_sum_by(all_leaves.ravel(), (d[:, :, None] * own[:, None, :]).reshape(-1, own.shape[1])))
        self._move(2, ids, gradient, times)
        d_h = d_h[:, :-1]
        d_x, d_r = d_h @ positions.T, np.zeros((len(padded), DIMENSIONS), np.float32)
        for k in range(1, CONTEXT + 1):
            d_r[CONTEXT - k : len(d_r) - k] += d_x[:, (k - 1) * DIMENSIONS : k * DIMENSIONS]
        self._move(1, np.arange(len(positions)), x.T @ d_h, np.full(len(positions), len(at), np.float32))
        self._move(0, *_sum_by(padded, d_r))

    def changes(self) -> np.ndarray:
        """Weighted changes and weights of all rows, in one array."""
        out = [np.hstack([(now - was) * met[:, None], met[:, None]]).ravel() for now, was, met in zip(self.now, self.model.parameters(), self.met, strict=True)]
        return np.concatenate(out).astype(np.float32)


def apply_changes(model: Model, total: np.ndarray) -> None:
    """Moves a model by the mean change of each row, weighted by how often tasks met it."""
    at = 0
    for p in model.parameters():
        size = len(p) * (p.shape[1] + 1)
        part = total[at : at + size].reshape(len(p), -1)
        p += (part[:, :-1] / np.maximum(part[:, -1:], 1)).astype(np.float32)
        at += size


class Vocabulary:
    """Numbers of the known tokens (the end first, then by frequency), and everyone's leaf."""

    def __init__(self, known: list[bytes]):
        self.ids = {t: i for i, t in enumerate(known)}
        self.own, self.sharing = SINGLE + CLASSES * MEMBERS - SHARED, SHARED
        self.leaf = np.array([i if i < self.own else self.shared(t) for i, t in enumerate(known)], np.int64)

    def shared(self, token: bytes) -> int:
        return self.own + zlib.crc32(token) % self.sharing

    def read(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (those beyond the known ones: their count) and leaves."""
        far = len(self.ids)
        ids = np.fromiter(map(self.ids.get, tokens, repeat(far)), np.int64, len(tokens))
        leaf = self.leaf[np.minimum(ids, far - 1)]
        for i in np.flatnonzero(ids == far).tolist():
            leaf[i] = self.shared(tokens[i])
        return ids, leaf


def padded_texts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All leaves of some texts, each behind ``CONTEXT`` end tokens, and the places of the tokens."""
    pad = np.zeros(CONTEXT, np.int64)
    ends = np.cumsum([CONTEXT + len(x) for x in texts])
    at = np.concatenate([np.arange(e - len(x), e) for e, x in zip(ends.tolist(), texts, strict=True)])
    return np.concatenate([y for x in texts for y in (pad, x)]), at


_CHANGE = pa.schema([("piece", pa.int32()), ("changes", pa.binary())])


def _learn(batches: Iterator[pa.RecordBatch], shared, round_: int) -> Iterator[pa.RecordBatch]:
    learner, held, size = Learner(shared.value, TaskContext.get().partitionId() * ROUNDS + round_), [], 0

    def steps() -> None:
        # Long texts are cut: a batch is as many tokens whatever the texts, in an order by chance.
        cut = [x[a : a + BATCH // 4] for x in held for a in range(0, len(x), BATCH // 4)]
        cut, room, own = [cut[i] for i in learner.g.permutation(len(cut))], BATCH, []
        for k, x in enumerate(cut):
            own.append(x)
            room -= len(x)
            if room <= 0 or k == len(cut) - 1:
                learner.step(*padded_texts(own))
                own, room = [], BATCH

    for (leaves,) in rows(batches, "leaves"):
        held.append(np.frombuffer(leaves, np.uint16).astype(np.int64))
        size += len(held[-1])
        if size >= 16 * BATCH:
            steps()
            held, size = [], 0
    if held:
        steps()
    if learner.met[1].any():
        for k, piece in enumerate(np.array_split(learner.changes(), PIECES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()], pa.binary())], schema=_CHANGE)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for piece, changes in rows(batches, "piece", "changes"):
        own = np.frombuffer(changes, np.float32)
        total[piece] = total[piece] + own if piece in total else own.astype(np.float64)
    for piece, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([own.astype(np.float32).tobytes()], pa.binary())], schema=_CHANGE)


def train(read: DataFrame, counts: np.ndarray) -> Model:
    """A model of the training texts among ``read``; ``counts`` are the tokens of each leaf."""
    spark, model = read.sparkSession, Model(counts)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        own = read.where("teaches").where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == k)
        learned = own.select("leaves").mapInArrow(partial(_learn, shared=shared, round_=k), "piece int, changes binary")
        sums = learned.repartition(shuffle_partitions(spark), "piece").mapInArrow(_add_up, "piece int, changes binary").collect()
        if sums:
            apply_changes(model, np.concatenate([np.frombuffer(r.changes, np.float32) for r in sorted(sums, key=lambda r: r.piece)]))
    return model


_READ = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("teaches", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("shares", pa.float64()), ("leaves", pa.binary()), ("tail", pa.list_(pa.binary()))])
_READ_SQL = "row long, doc_id long, teaches boolean, n_tokens long, n_known long, logs double, shares double, leaves binary, tail array<binary>"


def _read(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Texts as leaves, with sums over a document's known tokens, and its other tokens.

    ``logs`` sums log10(count + 0.5) of known tokens; ``shares`` log10 of tokens' shares in their
    leaves, of tokens that aren't known all but log10(count + 0.5).
    """
    vocabulary, counts, leaf_mass = shared.value
    out, row, far = Batcher(_READ), TaskContext.get().partitionId() << 33, len(counts)
    logs, trained = np.append(np.log10(counts + 0.5), 0.0), np.append(counts > 0, False)
    # A leaf of one token is that token; in a shared one a token has its smoothed share.
    own_logs, below = np.where(np.arange(far + 1) < vocabulary.own, 0.0, logs), np.where(np.arange(len(leaf_mass)) < vocabulary.own, 0.0, np.log10(leaf_mass))
    for doc, teaches, text in rows(batches, "doc_id", "teaches", "text"):
        tokens = tokens_of(text)
        ids, leaf = vocabulary.read(tokens)
        tail = [tokens[i] for i in np.flatnonzero(ids == far).tolist()]
        found = row, doc, teaches, len(ids), int(trained[ids].sum()), float(logs[ids].sum()), float(own_logs[ids].sum() - below[leaf].sum()), leaf.astype(np.uint16).tobytes(), tail
        if out.add(found, 100 + 2 * len(ids) + 16 * len(tail)):
            yield out.take()
        row += 1
    if out.rows:
        yield out.take()


_SCORED = pa.schema([("row", pa.int64()), ("model", pa.float64())])


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """log10 probabilities of the leaves of texts."""
    model, held, size = shared.value, [], 0

    def scored() -> pa.RecordBatch:
        each = model.log_probabilities(*padded_texts([x for _, x in held]))
        first = np.cumsum([0, *(len(x) for _, x in held[:-1])])
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array(np.add.reduceat(each, first) / math.log(10), pa.float64())], schema=_SCORED)

    for row, leaves in rows(batches, "row", "leaves"):
        held.append((row, np.frombuffer(leaves, np.uint16).astype(np.int64)))
        size += len(held[-1][1])
        if size >= 8 * BATCH:
            yield scored()
            held, size = [], 0
    if held:
        yield scored()


def frequent(counted: DataFrame) -> list[tuple[bytes, int]]:
    """At most ``KNOWN`` most frequent tokens but the end, by frequency: all down to a count that keeps within it."""
    words = counted.where(F.col("token") != F.lit(END)).withColumn("level", F.floor(F.log2("c") * 16))
    room, least = KNOWN, None
    for level, n in words.groupBy("level").agg(F.count(F.lit(1))).orderBy(F.desc("level")).collect():
        room -= n
        if room < 0:
            break
        least = level
    if least is None:
        return []
    return sorted(((bytes(t), c) for t, c in words.where(F.col("level") >= least).select("token", "c").collect()), key=lambda x: (-x[1], x[0]))


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` by what those under ``training`` teach."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", training.alias("teaches"), "text")
    counted = docs.where("teaches").select("text").mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))
    counted = stored(counted, "lm-counts")
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_end = (counted.where(F.col("token") == F.lit(END)).first() or (None, 0))[1]
    top = [(END, n_end), *frequent(counted)]
    counts, vocabulary = np.array([c for _, c in top], np.float64), Vocabulary([t for t, _ in top])
    # Tokens and words of each leaf; of the shared ones over all words, not only the known.
    leaves, own = SINGLE + CLASSES * MEMBERS, vocabulary.own
    leaf_counts, leaf_words = np.zeros(leaves), np.zeros(leaves)
    leaf_counts[: min(own, len(counts))] = counts[:own]
    sharing = counted.join(F.broadcast(spark.createDataFrame([(bytearray(t),) for t, _ in top[:own]], "token binary")), "token", "left_anti")
    for leaf, c, words in sharing.groupBy(F.pmod(F.crc32("token"), F.lit(SHARED)).alias("leaf")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        leaf_counts[own + leaf], leaf_words[own + leaf] = c, words
    shared = spark.sparkContext.broadcast((vocabulary, counts, leaf_counts + 0.5 * (leaf_words + 1)))
    read = stored(docs.mapInArrow(partial(_read, shared=shared), _READ_SQL), "lm-leaves")
    model = spark.sparkContext.broadcast(train(read, leaf_counts))
    scored = read.select("row", "leaves").mapInArrow(partial(_score, shared=model), "row long, model double")
    tail = read.select("row", F.explode("tail").alias("token"))
    found = tail.join(counted, "token", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_logs"), F.count("c").alias("tail_known"))
    tail_logs = F.coalesce("tail_logs", F.lit(0.0))
    return read.drop("tail", "leaves").join(scored, "row").join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + tail_logs - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"), (F.col("model") + F.col("shares") + tail_logs).alias("score"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fold(F.col("doc_id")) != 1)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
