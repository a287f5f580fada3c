"""Benchmark decontamination by template canonicalisation.

Tokens are white-space separated pieces without punctuation at their ends, lowered. Numbers,
units and names (capitalised words inside a sentence) become typed placeholders; so a question
whose parameters were exchanged keeps its template. A capitalised word at a sentence's start may
be a name or not: windows with one are looked for both ways. Windows of ``WIDTH`` tokens are hashed
and joined with those of the benchmark items; windows that are mostly placeholders are not used,
since any table of numbers has them. Items with no usable window are looked for literally; items
shorter than a window are one window.

A passage of a document that matches an item is a run of matching windows along a diagonal of
(document, item) positions, or along several where words were put in or left out; a position of
the document never stands for two of the item. Its slots are checked: one value of the item must
stand for one value of the document throughout, and one name or unit of the document for one of the
item (two parameters may well be given the same number). A consistent passage that covers
``SHARE`` of the item's windows is a leak.

Distribution: both sides become rows of (window hash, position); one pass over the documents,
whatever the size of the benchmark. A bitmap of the benchmark's hashes (``MOST_BITS`` at most, sent
to all executors) holds back windows of documents that can't match, so that hardly more than true
hits are shuffled; what it lets through by chance falls in the join on the whole hash. The join is salted, as
a passage may stand in very many documents (and Spark may split it further). Hits meet by document and item; nothing else is gathered.

Nulls and corner cases: null or empty texts match nothing; items without a token are never found;
a null item_id or doc_id is carried as it is; rows with the same id and text are one item, or one
document; rows that only share an id are told apart by their text; empty tables give no rows.
``drop_leaks`` carries all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batcher, load, rows, stored
from .minhash import mix

WIDTH, SHARE, LITERALS = 8, 0.4, 4
#: Logarithms of the least and most bits of the benchmark's bitmap (32 MB at most), and parts into which the rows of one window are dealt.
LEAST_BITS, MOST_BITS, SALTS = 16, 28, 4

# Unit names and number words that the placeholders stand for.
UNITS = frozenset("mm cm m km inch inches ft feet foot yard yards mile miles mg g kg lb lbs oz ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent % mph kmh kph v volt volts w kw watt watts hz khz mhz ghz kb mb gb tb degrees celsius fahrenheit".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

_NUMBER = re.compile(r"[$€£+-]*\d[\d.,:/]*[a-zA-Z%°]{0,3}")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Stands for a line break among the pieces, which ends a sentence and is no token; a private character, on which no white space rule bears.
BREAK = " \ue000 "
_M = np.uint64(0x9E3779B97F4A7C15)
NUM, UNIT, NAME = 1, 2, 3
#: What the placeholders contribute to a window's hash, by kind.
_KIND = mix(np.arange(1, 5, dtype=np.uint64) * _M)


def classify(piece: str) -> tuple[str, int, int, bool]:
    """(literal, kind at a sentence's start, kind inside it, whether a sentence ends here)."""
    if piece.isalpha() and piece.islower():  # most pieces
        low = piece.lower()
        kind = UNIT if low in UNITS else NUM if low in NUMBERS else 0
        return low, kind, kind, False
    core = piece if piece.isalpha() else piece.rstrip(".,;:!?")
    if not core.isalpha():
        core = _EDGE.sub("", piece)
    ends = piece[-1:] in ".!?:;" or piece == BREAK.strip() or piece.rstrip("\"')]")[-1:] in (".", "!", "?")
    low = core.lower()
    if not core:
        return ("%", UNIT, UNIT, ends) if "%" in piece else ("", 0, 0, ends)
    if low in UNITS:
        return low, UNIT, UNIT, ends
    if low in NUMBERS or _NUMBER.fullmatch(core):
        return low, NUM, NUM, ends
    named = NAME if len(core) > 1 and core[0].isupper() and core[1:].islower() else 0
    return low, 0, named, ends


class Pieces:
    """A bounded table of the pieces seen so far, for vectorised lookups."""

    ROOM = 1 << 19

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.literal, self.start, self.inside = (np.zeros(self.ROOM, np.uint64) for _ in range(3))
        self.kind_start, self.kind_inside = np.zeros(self.ROOM, np.int8), np.zeros(self.ROOM, np.int8)
        self.ends = np.zeros(self.ROOM, bool)

    def add(self, pieces: list[str]) -> None:
        from xxhash import xxh3_64_intdigest as digest

        new = [p for p in dict.fromkeys(pieces) if p not in self.ids]
        at, end = len(self.ids), len(self.ids) + len(new)
        self.ids.update(zip(new, range(at, end), strict=True))
        literals, starts, insides, ends = zip(*map(classify, new), strict=True)
        hashes = np.array([digest(x.encode("utf-8", "surrogatepass")) | 8 if x else 0 for x in literals], np.uint64)
        self.literal[at:end], self.ends[at:end] = hashes, ends
        for kinds, own, out in ((starts, self.kind_start, self.start), (insides, self.kind_inside, self.inside)):
            own[at:end] = kinds
            out[at:end] = np.where(own[at:end] == 0, hashes, _KIND[own[at:end]])

    def tokens(self, text: str) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray], list[str], np.ndarray]:
        """(template hashes, literal hashes, slot kinds, pieces, each token's piece).

        Templates and kinds are given twice: capitalised words at a sentence's start as words, and as names.
        """
        pieces = text.replace("\n", BREAK).split()
        if len(self.ids) + len(pieces) > self.ROOM:
            self.reset()
            self.ROOM = max(self.ROOM, 2 * len(pieces))
            self.reset()
        try:
            ids = np.fromiter(map(self.ids.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            self.add(pieces)
            ids = np.fromiter(map(self.ids.__getitem__, pieces), np.int64, len(pieces))
        first = np.concatenate(([True], self.ends[ids[:-1]])) if len(ids) else np.zeros(0, bool)
        real = np.flatnonzero(self.literal[ids])
        first, ids = first[real], ids[real]
        named, named_kinds = self.inside[ids], self.kind_inside[ids]
        template, kinds = np.where(first, self.start[ids], named), np.where(first, self.kind_start[ids], named_kinds)
        return (template, named), self.literal[ids], (kinds, named_kinds), pieces, real


def windows(tokens: np.ndarray, width: int, salt: int) -> np.ndarray:
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Windows of a power of two by doubling, the rest a token at a time.
    acc, size, factor = tokens, 1, _M
    with np.errstate(over="ignore"):
        while 2 * size <= width:
            ahead = acc[size:]
            acc = acc[: len(ahead)] * factor
            acc += ahead
            size, factor = 2 * size, factor * factor
        acc = acc[:n].copy()
        for k in range(size, width):
            acc *= _M
            acc += tokens[k : k + n]
        start = np.uint64(width * 2 + salt)
        for _ in range(width):
            start = start * _M
    acc += start
    return mix(acc)


def _differing(templates: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Places of the windows in which the two templates differ."""
    before = np.concatenate(([0], np.cumsum(templates[0] != templates[1])))
    return np.flatnonzero(before[width:] > before[:-width])


_PIECES = Pieces()


def value_of(piece: str) -> str:
    return _EDGE.sub("", piece).lower()


_SLOT = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string()), ("kind", pa.int8()), ("always", pa.bool_())]))
_ITEM = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("item", pa.int64()), ("p", pa.int32()), ("nth", pa.int32()), ("named", pa.bool_()), ("width", pa.int32()), ("literal", pa.bool_()), ("n_windows", pa.int64()), ("n_tokens", pa.int64()), ("slots", _SLOT)])
_ITEM_SQL = "hash long, item_id long, item long, p int, nth int, named boolean, width int, literal boolean, n_windows long, n_tokens long, slots array<struct<at: int, value: string, kind: tinyint, always: boolean>>"


def item_windows(item_id: int | None, item: int, text: str | None) -> Iterator[tuple]:
    """Rows of ``_ITEM``: the windows by which an item is found, its usable ones numbered, with their slots."""
    templates, literal, kinds, pieces, at = _PIECES.tokens(text or "")
    if not len(literal):
        return
    width = min(WIDTH, len(literal))
    good, named = (np.flatnonzero(np.convolve(k == 0, np.ones(width, int), "valid") >= min(LITERALS, (width + 1) // 2)) for k in kinds)
    salt = 0 if len(good) else 1
    places = good if len(good) else np.arange(len(literal) - width + 1)
    nth = {p: k for k, p in enumerate(places.tolist())}
    found = list(zip(windows(literal if salt else templates[0], width, salt)[places].tolist(), places.tolist(), [False] * len(places), strict=True))
    if not salt:
        other = [p for p in np.intersect1d(named, _differing(templates, width)).tolist() if p in nth]
        found += zip(windows(templates[1], width, 0)[other].tolist(), other, [True] * len(other), strict=True)
    values = {int(i): (value_of(pieces[at[i]]), int(kinds[1][i]), bool(kinds[0][i])) for i in np.flatnonzero(kinds[1])}
    for h, p, is_named in found:
        slots = [dict(zip(("at", "value", "kind", "always"), (j, *values[p + j]), strict=True)) for j in range(width) if p + j in values]
        yield int(np.uint64(h).view(np.int64)), item_id, item, p, nth[p], is_named, width, bool(salt), len(places), len(literal), slots


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Batcher(_ITEM)
    for item_id, item, text in rows(batches, "item_id", "item", "text"):
        for row in item_windows(item_id, item, text):
            if out.add(row, 400):
                yield out.take()
    if out.rows:
        yield out.take()


class Filter:
    """Which leading bits of a hash any item's window has; ``modes`` are the (width, literal) in use."""

    def __init__(self, bits: int, bitmaps: list[tuple[int, bytes]], modes: list[tuple[int, bool]]):
        self.shift, self.modes = np.uint64(64 - bits), sorted(modes)
        packed = np.zeros((1 << bits) >> 3, np.uint8)
        for bucket, bitmap in bitmaps:
            at = (bucket - 1) * 4096
            packed[at : at + 4096] = np.frombuffer(bitmap, np.uint8)[: len(packed) - at]
        #: A byte for each bit is quicker to look up, as long as it is not too long.
        self.plain = bits <= 24
        self.table = np.unpackbits(packed, bitorder="little").view(bool) if self.plain else packed

    def places(self, hashes: np.ndarray) -> np.ndarray:
        top = hashes >> self.shift
        if self.plain:
            return np.flatnonzero(self.table[top])
        return np.flatnonzero((self.table[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8)) & 1)

    def hits(self, text: str | None) -> Iterator[tuple[int, int, list[str]]]:
        """(hash, place, its pieces) of the windows of a text that may be an item's."""
        if not text or not self.modes:
            return
        templates, literal, _, pieces, at = _PIECES.tokens(text)
        for width, salt in self.modes:
            own = windows(literal if salt else templates[0], width, int(salt))
            found = [(own, p, p) for p in self.places(own).tolist()]
            if not salt and len(there := _differing(templates, width)):
                own = windows(templates[1], width, 0)[there]
                found += [(own, k, there[k]) for k in self.places(own).tolist()]
            for hashes, k, p in found:
                yield int(hashes[k].view(np.int64)), int(p), [pieces[k] for k in at[p : p + width].tolist()]


def item_table(benchmark: DataFrame) -> tuple[DataFrame, Filter]:
    """The windows of ``benchmark`` (item_id, text), and the filter that a pass over documents needs."""
    items = benchmark.select("item_id", F.xxhash64("text").alias("item"), "text").where("text is not null").distinct()
    items = stored(items.mapInArrow(_items, _ITEM_SQL), "leak-items")
    n = items.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (128 * n).bit_length()))
    top = (F.shiftrightunsigned("hash", 64 - bits) + 1).alias("top")
    # Bitmaps of 4 KB for 32,768 bits each: at most 2 ** MOST_BITS bits in all come to the driver.
    bitmaps = items.select(top).groupBy(F.bitmap_bucket_number("top").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("top")).alias("bitmap")).collect()
    modes = [(r.width, r.literal) for r in items.select("width", "literal").distinct().collect()]
    return items, Filter(bits, [(r.bucket, bytes(r.bitmap)) for r in bitmaps], modes)


_HIT = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("d", pa.int32()), ("pieces", pa.list_(pa.string()))])


def _hits(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    out = Batcher(_HIT)
    for doc, key, text in rows(batches, "doc_id", "text_key", "text"):
        for h, d, pieces in shared.value.hits(text):
            if out.add((h, doc, key, d, pieces), 200):
                yield out.take()
    if out.rows:
        yield out.take()


def _read(run: list[tuple]) -> tuple[tuple[dict, dict] | None, set[int]]:
    """What the item's values stand for in a run of hits (and names and units of the document for), None if that differs, and the slots seen."""
    named = any(hit[2] for hit in run)
    stands: dict[str, str] = {}
    back: dict[str, str] = {}
    used, same = set(), True
    for _, p, _, _, pieces, slots in run:
        for at, value, kind, always in slots:
            if (always or named) and p + at not in used:
                other = value_of(pieces[at])
                same &= stands.setdefault(value, other) == other
                if kind != NUM:
                    same &= back.setdefault(other, value) == value
                used.add(p + at)
    return (stands, back) if same else None, used


def _changed(stands: dict[str, str]) -> int:
    return sum(a != b for a, b in stands.items())


def _agree(one: dict[str, str], other: dict[str, str]) -> bool:
    return all(one.get(a, b) == b for a, b in other.items())


def passages(hits: list[tuple], length: int) -> Iterator[tuple]:
    """(matched, slots, changed, consistent) of runs of hits (d, p, named, nth, pieces, slots), sorted.

    On one diagonal (d - p) a document position has one item position. Hits of a diagonal are
    tried as one run; pieces of it without a gap are joined with pieces of other diagonals
    (words put in or left out) by the longest run before them that they don't contradict.
    """
    diagonals: dict[int, list[tuple]] = {}
    for hit in hits:
        diagonals.setdefault(hit[0] - hit[1], []).append(hit)
    parts = []
    for run in diagonals.values():
        cuts = [0, *(k for k in range(1, len(run)) if run[k][3] != run[k - 1][3] + 1), len(run)]
        if len(cuts) > 2:
            found, used = _read(run)
            yield len(run), len(used), _changed(found[0]) if found else 0, found is not None
        parts += [run[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    parts.sort(key=lambda run: run[0][:2])
    ends: list[tuple] = []  # (matched, last d, last p, stands, back, used, first d) of the best run to each part
    first = 0
    for run in parts:
        (d, p), (last_d, last_p) = run[0][:2], run[-1][:2]
        found, used = _read(run)
        if found is None:
            yield len(run), len(used), 0, False
            continue
        stands, back = found
        while first < len(ends) and ends[first][6] < d - 2 * length:
            first += 1
        before = [e for e in ends[first:] if e[1] < d <= e[1] + length and e[2] < p]
        matched = len(run)
        for e in sorted(before, key=lambda e: -e[0]):
            if _agree(e[3], stands) and _agree(e[4], back):
                matched, stands, back, used = matched + e[0], e[3] | stands, e[4] | back, e[5] | used
                break
        ends.append((matched, last_d, last_p, stands, back, used, d))
        yield matched, len(used), _changed(stands), True


def best_passage(hits: list[tuple], length: int) -> tuple:
    """The best of the passages that some hits (d, p, named, nth, pieces, slots) of a document and an item make."""
    own: dict[tuple[int, int], tuple] = {}
    for hit in hits:  # where a window matches both ways, the plain one is taken
        if (at := hit[:2]) not in own or not hit[2]:
            own[at] = hit
    hits = [own[at] for at in sorted(own)]
    found = list(passages(hits, length))
    # A word that only looks like a name must not spoil what agrees without it.
    if any(hit[2] for hit in hits) and (plain := [hit for hit in hits if not hit[2]]):
        found += passages(plain, length)
    return max(found, key=lambda p: (p[3], p[0], -p[2]))


def leaked(matched: int, n_windows: int, consistent: bool) -> bool:
    return consistent and matched >= SHARE * n_windows


_LEAK = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("n_matched", pa.int64()), ("n_windows", pa.int64()), ("n_slots", pa.int64()), ("n_changed", pa.int64()), ("consistent", pa.bool_())])
_LEAK_SQL = "doc_id long, text_key long, item_id long, n_matched long, n_windows long, n_slots long, n_changed long, consistent boolean"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Batcher(_LEAK)
    for doc, key, item_id, n_windows, n_tokens, hits in rows(batches, "doc_id", "text_key", "item_id", "n_windows", "n_tokens", "hits"):
        hits = [(h["d"], h["p"], h["named"], h["nth"], h["pieces"], [(s["at"], s["value"], s["kind"], s["always"]) for s in h["slots"]]) for h in hits]
        matched, n_slots, changed, consistent = best_passage(hits, n_tokens)
        if leaked(matched, n_windows, consistent) and out.add((doc, key, item_id, matched, n_windows, n_slots, changed, consistent)):
            yield out.take()
    if out.rows:
        yield out.take()


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``find_leaks`` with ``text_key``, the hash that tells texts of one doc_id apart."""
    items, held = item_table(benchmark)
    shared = docs.sparkSession.sparkContext.broadcast(held)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    hits = texts.mapInArrow(partial(_hits, shared=shared), "hash long, doc_id long, text_key long, d int, pieces array<string>")
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)))
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = hits.join(salted, ["hash", "salt"]).groupBy("doc_id", "text_key", "item_id", "item", "n_windows", "n_tokens")
    return met.agg(F.collect_set(F.struct("d", "p", "named", "nth", "pieces", "slots")).alias("hits")).mapInArrow(_judge, _LEAK_SQL)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and the benchmark item that it leaks."""
    return _leaks(docs, benchmark).drop("text_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that leak an item."""
    found = _leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    found = found.select(F.col("doc_id").alias("_leak_doc"), F.col("text_key").alias("_leak_text")).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("_leak_doc")) & (F.xxhash64(text_col) == F.col("_leak_text")), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
