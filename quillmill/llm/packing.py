"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are encoded once and stored with a stable row number; they are dealt by its hash to
packs of about ``PACK_TOKENS`` tokens, each a mix of all sources. In a pack every source has a
queue. Every window of ``WINDOW`` tokens credits each source its target share; sources are served
in turn in quanta out of their credit, documents being cut freely. What a source was owed and not
served (its deficit) goes on to the next window, and from pack to pack: a pack serves all that it
holds, so the deficits with which the next one begins are prefix sums of (target share x tokens -
tokens of the source) and need no sequential pass.

The last window of a pack is the only one that needs padding. Packs are dealt to at most
``MOST_PARTS`` shuffle partitions; a task makes its packs one after another. Prefix sums are made
for blocks of ``BLOCK`` packs and within each.

Target proportions are the sources' shares of all tokens unless ``mixture`` gives weights.

Nulls and corner cases: a null text is empty (one id, the end); a null source is a source of its
own; repeated rows are documents of their own; an empty table gives no rows; other columns are
ignored. Row numbers come from how files are split, so another split gives another packing. A pack's ids are what a task holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batcher, load, rows, stored
from .tokens import encoder

WINDOW, QUANTUM, PACK_TOKENS = 4096, 256, 4_000_000
#: Shuffle partitions that packs are dealt to, and packs whose prefix sums one task makes.
MOST_PARTS, BLOCK = 20_000, 4096

_CODED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("row", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, out, row = encoder(path), Batcher(_CODED), TaskContext.get().partitionId() << 33
    for ids, (doc, source) in encode.each(rows(batches, "text", "doc_id", "source")):
        ids = np.append(ids, np.uint32(end_id))
        data = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()
        if out.add((doc, source, row, len(ids), data), len(data)):
            yield out.take()
        row += 1
    if out.rows:
        yield out.take()


class Queue:
    def __init__(self, share: float, owed: float):
        self.share, self.credit, self.docs, self.at, self.left = share, owed, [], 0, 0


def pack_round_robin(queues: list[Queue], window: int = WINDOW, quantum: int = QUANTUM) -> Iterator[tuple]:
    """(document, start, length, window number, offset) of each piece until all queues are empty.

    ``queues[i].docs`` are (document, length) pairs. In each window sources take turns, a quantum
    a turn, while they have credit; what then remains of the window goes to whoever is owed most.
    """
    for q in queues:
        q.left, q.at, q.pos = sum(n for _, n in q.docs), 0, 0
    live, number = [q for q in queues if q.left], 0
    while live:
        room, take = window, {}
        for q in live:
            q.credit += q.share * window
        while room and live:
            owed = [q for q in live if q.left > take.get(id(q), 0) and q.credit - take.get(id(q), 0) >= 1]
            if not owed:
                rest = [q for q in live if q.left > take.get(id(q), 0)]
                if not rest:
                    break
                owed = [max(rest, key=lambda q: q.credit - take.get(id(q), 0))]
                grant = lambda q: quantum
            else:
                owed.sort(key=lambda q: take.get(id(q), 0) - q.credit)
                grant = lambda q: max(1, int(min(q.credit - take.get(id(q), 0), quantum)))
            for q in owed:
                n = min(grant(q), room, q.left - take.get(id(q), 0))
                take[id(q)] = take.get(id(q), 0) + n
                room -= n
        offset = 0
        for q in live:
            n = take.get(id(q), 0)
            q.credit -= n
            q.left -= n
            while n:
                doc, length = q.docs[q.at]
                piece = min(n, length - q.pos)
                yield doc, q.pos, piece, number, offset
                offset, q.pos, n = offset + piece, q.pos + piece, n - piece
                if q.pos == length:
                    q.at, q.pos = q.at + 1, 0
        live = [q for q in live if q.left]
        number += 1


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])
_PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _pack(table: pa.Table, window: int, quantum: int) -> Iterator[pa.RecordBatch]:
    """One pack: control rows (ids null) give each source's share and deficit and the first sequence number."""
    queues, docs, base = {}, [], 0
    for source, row, n, ids, doc, share, owed, first in rows(table.sort_by([("row", "ascending")]).to_batches(), "source", "row", "n", "ids", "doc_id", "share", "owed", "first_sequence"):
        if ids is None:
            queues.setdefault(source, Queue(0, 0)).__dict__.update(share=share, credit=owed)
            base = first
        else:
            queues.setdefault(source, Queue(0, 0)).docs.append((len(docs), n))
            docs.append((doc, n, np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4"), source))
    out = Batcher(_PIECE)
    for k, start, length, number, offset in pack_round_robin([queues[s] for s in sorted(queues, key=lambda s: (s is None, s or ""))], window, quantum):
        doc, n, ids, source = docs[k]
        if out.add((doc, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), n, base + number, offset, source)):
            yield out.take()
    if out.rows:
        yield out.take()


def before(df: DataFrame, value: str, name: str, *group: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the packs before a row's (in its group) as column ``name``.

    No task sees more than ``BLOCK`` packs of a group, or one sum for each block.
    """
    df = df.withColumn("_block", F.floor(F.col("pack") / BLOCK))
    earlier = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = df.groupBy("_block", *group).agg(F.sum(value).alias(value))
    blocks = blocks.select(F.col("_block").alias("_of"), *(F.col(g).alias(f"_{g}") for g in group), earlier(Window.partitionBy(*group).orderBy("_block")).alias("_base"))
    same = F.col("_block") == F.col("_of")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    inner = earlier(Window.partitionBy("_block", *group).orderBy("pack"))
    return df.withColumn(name, inner).join(blocks, same).withColumn(name, F.col(name) + F.col("_base")).drop("_block", "_of", "_base", *(f"_{g}" for g in group))


def pack(docs: DataFrame, tokenizer: str, *, end_id: int, window: int = WINDOW, quantum: int = QUANTUM, pack_tokens: int = PACK_TOKENS, mixture: dict[str, float] | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source) of packed ``docs``."""
    spark = docs.sparkSession
    coded = stored(docs.select("doc_id", "text", "source").mapInArrow(partial(_encode, path=tokenizer, end_id=end_id), "doc_id long, source string, row long, n long, ids binary"), "packing-ids")
    total = coded.agg(F.sum("n")).first()[0] or 0
    packs = max(1, round(total / pack_tokens))
    coded = coded.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(packs)).cast("int"))
    held = stored(coded.groupBy("pack", "source").agg(F.sum("n").cast("double").alias("tokens")), "packing-held")
    # The tables below have a row for each pack and source; none has one for each document.
    by_pack = held.groupBy("pack").agg(F.sum("tokens").alias("pack_tokens")).withColumn("sequences", F.ceil(F.col("pack_tokens") / window))
    by_pack = before(before(by_pack, "sequences", "first_sequence"), "pack_tokens", "tokens_before").select("pack", "first_sequence", "tokens_before")
    by_source = held.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    if mixture is not None:
        weights = spark.createDataFrame(list(mixture.items()), "name string, weight double")
        by_source = by_source.join(weights, F.col("source") == F.col("name"), "left").withColumn("source_tokens", F.coalesce("weight", F.lit(0.0))).select("source", "source_tokens")
    whole = by_source.agg(F.sum("source_tokens")).first()[0] or 1.0
    shares = by_source.select(F.col("source").alias("of"), (F.col("source_tokens") / whole).alias("share"))
    control = (
        before(held, "tokens", "served", "source")
        .join(by_pack, "pack")
        .join(shares, F.col("source").eqNullSafe(F.col("of")))
        .select("pack", "source", F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("long").alias("doc_id"), "share", (F.col("share") * F.col("tokens_before") - F.col("served")).alias("owed"), "first_sequence")
    )
    body = coded.select("pack", "source", "row", "n", "ids", "doc_id", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("owed"), F.lit(None).cast("long").alias("first_sequence"))

    def one_pack(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_pack(table, window, quantum)), _PIECE)

    parts = min(packs, MOST_PARTS)
    dealt = body.unionByName(control).withColumn("part", F.pmod("pack", F.lit(parts)))
    return dealt.repartitionById(parts, "part").groupBy("part", "pack").applyInArrow(one_pack, _PIECE_SQL)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
