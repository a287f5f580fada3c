"""Token ids: a word-cached encoder, and a chunked bit/byte-plane file format.

Encoding. A text is cut where a non-space character meets a space or line break; no pre-token of
either tokenizer crosses such a cut, so a text's ids are its pieces' ids in order, and a piece that
was seen before needs no second encoding. Texts with other white space, or several in a row, are
encoded whole where white space matters. Pieces of many texts are looked up together in a table of
ids (``piece_table``); only those not found there become strings. Table and caches are bounded.

File format. Rows of a Parquet dataset are chunks of whole documents (so a chunk is readable by
itself and a lost task is simply run again by Spark's commit protocol): ids are cut into blocks
of ``BLOCK_IDS``, each block's 32-bit ids are transposed into 4 byte planes or 32 bit planes, and
each plane is compressed with zstandard. Beside the chunks lies the chunk index: shard, chunk,
first position of the whole corpus, number of ids, first and last document.

Nulls and corner cases: a null text is empty (its only id is the end id); a null doc_id sorts
first; rows that repeat a doc_id are documents of their own, ordered by text hash (equal rows in any
order, so that no run of them must lie in one range); an empty table
gives an empty dataset. Other columns are ignored. The ids of ``BATCH_CHARS`` characters of texts
or of one document are in memory at a time, plus a chunk.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batcher, load, rows, shared_path
from .piece_table import KEY_BYTES, MARKS, PieceTable, cut, spread

BLOCK_IDS, CHUNK_IDS, CACHED_PIECES, CACHED_WORDS = 16_384, 262_144, 300_000, 250_000
#: Pieces in the table, and characters and texts that are looked up together.
TABLE_PIECES, BATCH_CHARS, BATCH_TEXTS = 1_500_000, 1 << 20, 1024
#: Text bytes of a range of documents, unless that makes more than ``MOST_PARTS`` ranges.
PART_BYTES, MOST_PARTS = 16 << 20, 50_000
#: White space other than the space and \n, and characters on which Python and the tokenizers may not agree.
_RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def _byte_chars() -> dict[int, int]:
    """The characters by which byte-level models name bytes: printable ones themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()
#: The same for all bytes, as UTF-16.
_BYTE_UNITS = np.array([_BYTE_CHARS.get(b, b) for b in range(256)], "<u2")


class Encoder:
    """A tokenizer's ids as little-endian 32-bit bytes.

    The cache maps pieces to ids. A new piece that is a word with punctuation after it is the
    word's ids and the punctuation's, which both pre-tokenizers part; a new word goes straight to
    the tokenizer's model. All other new pieces of a text are encoded in one call, joined by a
    separator that is a pre-token of its own whatever stands beside it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Such a tokenizer drops white space, so any piece between spaces stands for itself.
        self.drops_space = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str()
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.separator = " \x01 " if self.drops_space else "\n"
        (self.cut,) = np.frombuffer(self.whole(self.separator), "<u4")
        self.lead = b"" if self.drops_space else self.whole("\n")
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        #: What stands between delimiters when nothing does.
        self.blank = {"": b""} if self.drops_space else {"": self.whole(" "), "\n": self.lead}
        self.table = PieceTable(TABLE_PIECES)
        self.forget()

    def forget(self) -> None:
        """Starts a new generation: pieces that aren't met in it will be forgotten with the next."""
        self.known_before, self.known = self.known, dict(self.blank)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of letters only, perhaps after one space, which are one pre-token."""
        if word.isascii():
            octets = word.lower() if self.normalizer else word.replace(" ", "Ġ")
        else:
            plain = self.normalizer.normalize_str(word) if self.normalizer else word
            if not plain.lstrip(" ").isalpha():
                return self.whole(word)
            octets = plain.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(octets)]).tobytes()

    def learn(self, pieces: set[str], known: dict[str, bytes]) -> None:
        """Adds new pieces to ``known``; one that begins with \n is that and a piece without a space before it."""
        odd, words, tails = [], self.words, self.tails
        space = "" if self.drops_space else " "
        for p in pieces:
            lead = p[0] == "\n"
            core = p.rstrip(MARKS)
            tail = p[len(core) :]
            core = core[1:] if lead else space + core
            # A letter may become a letter and a sign, which doesn't part from marks.
            if tail and self.normalizer and not core.isascii() and not self.normalizer.normalize_str(core)[-1:].isalpha():
                odd.append(p)
                continue
            if (ids := words.get(core)) is None:
                # Only words get into the cache, so a piece that is found there need not be looked at.
                if not (core if lead else core.removeprefix(space)).isalpha():
                    odd.append(p)
                    continue
                if (ids := self.older.get(core)) is None:
                    ids = self.word(core)
                words[core] = ids
                if len(words) > CACHED_WORDS:  # words not met for a generation are forgotten
                    self.older, self.words = words, (words := {})
            if tail:
                if (more := tails.get(tail)) is None:
                    if len(tails) > CACHED_PIECES:
                        tails.clear()
                    more = tails[tail] = self.whole(tail)
                ids += more
            known[p] = self.lead + ids if lead else ids
        if not odd:
            return
        spaced = [p if self.drops_space else p[1:] if p[0] == "\n" else " " + p for p in odd]
        ids = np.frombuffer(self.whole(self.separator.join(spaced)), "<u4")
        ends = np.append(np.flatnonzero(ids == self.cut), len(ids))
        if len(ends) != len(odd):  # a piece holds the separator
            for p, text in zip(odd, spaced, strict=True):
                known[p] = (self.lead if p[0] == "\n" else b"") + self.whole(text)
            return
        data, at = ids.tobytes(), 0
        for p, end in zip(odd, (4 * ends).tolist(), strict=True):
            known[p] = self.lead + data[at:end] if p[0] == "\n" else data[at:end]
            at = end + 4

    def pieces(self, pieces: list[str]) -> bytes:
        # Most texts have a new piece, so these are found first; a failed attempt to join costs more.
        if new := set(pieces).difference(self.known):
            if len(self.known) > CACHED_PIECES:
                self.forget()
                new = set(pieces).difference(self.known)
            if (before := self.known_before) and (met := [p for p in new if p in before]):
                self.known.update((p, before[p]) for p in met)
                new.difference_update(met)
            self.learn(new, self.known)
        return b"".join(map(self.known.__getitem__, pieces))

    def needs_whole(self, text: str) -> bool:
        return not self.drops_space and bool(_RARE.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n")

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.drops_space:
            return self.pieces(text.replace("\n", " ").split(" "))
        if self.needs_whole(text):
            return self.whole(text)
        # The first piece is read as if a line break stood before it, whose id is then left out.
        return self.pieces(("\n" + text).replace("\n", " \n").split(" ")[1:])[4:]

    def each(self, texts: Iterator[tuple]) -> Iterator[tuple]:
        """(ids, the rest) of each (text, the rest), in order; some texts are encoded together."""
        held, size = [], 0
        for row in texts:
            held.append(row)
            size += len(row[0] or "")
            if size >= BATCH_CHARS or len(held) >= BATCH_TEXTS:
                yield from zip(self.many([r[0] for r in held]), (r[1:] for r in held), strict=True)
                held, size = [], 0
        yield from zip(self.many([r[0] for r in held]), (r[1:] for r in held), strict=True)

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts, owners, size = [], [], 0

        def flush() -> None:
            for k, ids in zip(owners, self._ids(parts), strict=True):
                out[k].append(ids)
            parts.clear()
            owners.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            if "\0" in text or self.needs_whole(text):
                out[k].append(np.frombuffer(self(text), "<u4"))
                continue
            # As in a call, the first piece is read as if a line break stood before it.
            for part in _parts("\n" + text):
                parts.append((part, not out[k] and (not owners or owners[-1] != k)))
                owners.append(k)
                size += len(part)
                if size >= BATCH_CHARS:
                    flush()
                    size = 0
        flush()
        return [ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else np.empty(0, np.uint32) for ids in out]

    def _ids(self, parts: list[tuple[str, bool]]) -> list[np.ndarray]:
        """The ids of parts of texts, each of which begins with a delimiter; True: the line break there isn't the text's."""
        if not parts:
            return []
        octets = [p.encode() for p, _ in parts]
        if self.drops_space:
            octets = [o.replace(b"\n", b" ") for o in octets]
        data, table = b"".join(octets), self.table
        begins = np.cumsum([0, *map(len, octets)])
        at, length, keys = cut(data)
        slot, there = table.find(keys)
        short = length <= KEY_BYTES
        table.met[slot[there & short]] = True
        if len(miss := np.flatnonzero(short & ~there)):
            first: dict[bytes, int] = {}
            for i, a, n in zip(miss.tolist(), at[miss].tolist(), length[miss].tolist(), strict=True):
                first.setdefault(data[a : a + n], i)
            found, ids, n = self._first_met(list(first))
            anew = table.add(keys[[first[p] for p in found]], ids, n, slot[there & short])
            again = slice(None) if anew else miss
            slot[again] = table.find(keys[again])[0]
        start, n = table.runs[slot].astype(np.int64).T
        if len(long := np.flatnonzero(~short)):
            runs = [self.pieces([self._name(data[a : a + m])]) for a, m in zip(at[long].tolist(), length[long].tolist(), strict=True)]
            n[long] = [len(r) // 4 for r in runs]
            start[long] = table.place(np.frombuffer(b"".join(runs), "<u4")) + np.cumsum(n[long]) - n[long]
        heads = np.searchsorted(at, begins[:-1])
        if not self.drops_space:
            own = heads[[is_first for _, is_first in parts]]
            start[own] += 1
            n[own] -= 1
        ids = table.ids[spread(start, n)]
        return np.split(ids, np.concatenate([[0], np.cumsum(n)])[heads[1:]])

    @staticmethod
    def _name(piece: bytes) -> str:
        """A piece with its delimiter, as the caches name it."""
        return piece.decode() if piece[0] == 10 else piece[1:].decode()

    def _first_met(self, new: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """New pieces of the table in another order, their ids one run after another, and how many each has."""
        named = [(p, p[1:].decode()) for p in new if p[0] == 32]
        words = [x for x in named if x[1].isalpha()]
        plain = [w for _, w in words]
        if self.normalizer:
            plain = self.normalizer.normalize_str(" ".join(plain)).split(" ")
            if len(plain) != len(words):
                plain, words = [], []
            words, plain = [x for x, w in zip(words, plain, strict=True) if w.isalpha()], [w for w in plain if w.isalpha()]
        units = _BYTE_UNITS[np.frombuffer("\n".join(plain if self.drops_space else [" " + w for w in plain]).encode(), np.uint8)]
        tokenize = self.model.tokenize
        runs = [tokenize(w) for w in units.tobytes().decode("utf-16-le").split(chr(_BYTE_CHARS[10]))] if words else []
        n = [*map(len, runs)]
        ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(runs)), np.uint32, sum(n))
        done = [p for p, _ in words]
        if len(done) < len(new):
            rest = [*set(new).difference(done)]
            got = dict(self.blank)
            self.learn({self._name(p) for p in rest if p[0] in b" \n"}.difference(got), got)
            more = [got[self._name(p)] if p[0] in b" \n" else self.whole(p.decode()) for p in rest]
            done += rest
            n += [len(r) // 4 for r in more]
            ids = np.concatenate([ids, np.frombuffer(b"".join(more), "<u4")])
        return done, ids, np.array(n, np.int64)


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``BATCH_CHARS`` characters, each of which begins at a space or line break."""
    at = 0
    while len(text) - at > BATCH_CHARS:
        found = [x for x in (text.find(" ", at + BATCH_CHARS), text.find("\n", at + BATCH_CHARS)) if x >= 0]
        if not found:
            break
        yield text[at : min(found)]
        at = min(found)
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The compressed planes of one block."""
    squeeze = _zstd()[0].compress
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [squeeze(p.tobytes()) for p in octets]
    return [squeeze(np.packbits((p >> b) & 1).tobytes()) for p in octets for b in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    open_ = _zstd()[1].decompress
    if kind == "byte":
        octets = np.stack([np.frombuffer(open_(p), np.uint8) for p in planes])
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(open_(p), np.uint8), count=n) for p in planes]).reshape(4, 8, n)
        octets = (bits << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)


_CHUNK = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("planes", pa.list_(pa.list_(pa.binary()))), ("kind", pa.string())])
_CHUNK_SQL = "shard int, chunk long, n_ids long, doc_ids array<long>, lengths array<long>, planes array<array<binary>>, kind string"


def _chunks(path: str, end_id: int, kind: str):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path), TaskContext.get().partitionId()
        chunk, held, docs, lengths = 0, bytearray(), [], []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(bytes(held), "<u4")
            blocks = [to_planes(ids[a : a + BLOCK_IDS], kind) for a in range(0, len(ids), BLOCK_IDS)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, chunk, len(ids), docs, lengths, blocks, kind), _CHUNK, strict=True)], schema=_CHUNK)

        for ids, (doc,) in encode.each(rows(batches, "text", "doc_id")):
            held += ids.tobytes()
            held += end
            docs.append(doc)
            lengths.append(len(ids) + 1)
            if len(held) >= 4 * CHUNK_IDS:
                yield close()
                chunk, held, docs, lengths = chunk + 1, bytearray(), [], []
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, kind: str = "byte") -> None:
    """Encode ``docs`` (doc_id, text) into chunks under ``path`` in ascending doc_id order, and index them."""
    spark = docs.sparkSession
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(1, -(-octets // PART_BYTES)), MOST_PARTS)
    # Many rows may share an id, a text or both: the hash and the random number cut such runs too.
    order = [F.asc_nulls_first("doc_id"), F.col("_text"), F.col("_any")]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.rand(5).alias("_any"))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_chunks(tokenizer, end_id, kind), _CHUNK_SQL).write.option("compression", "none").parquet(f"{path}/chunks")
    heads = spark.read.schema("shard int, chunk long, n_ids long").parquet(f"{path}/chunks")
    # One row a shard comes to the driver: as many as there are partitions, however many ids they hold.
    at, starts = 0, []
    for shard, n in heads.groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect():
        starts.append((shard, at))
        at += n
    from pyspark.sql.window import Window

    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    full = spark.read.schema("shard int, chunk long, n_ids long, doc_ids array<long>").parquet(f"{path}/chunks").select("shard", "chunk", "n_ids", F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"))
    shard_at = spark.createDataFrame(starts, "shard int, shard_start long")
    indexed = full.join(shard_at, "shard").withColumn("start", F.col("shard_start") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("shard_start")
    indexed.write.parquet(f"{path}/index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Batcher(_DOC)
    for start, docs, lengths, planes, kind, n_ids in rows(batches, "start", "doc_ids", "lengths", "planes", "kind", "n_ids"):
        left, ids = n_ids, []
        for block in planes:
            n = min(BLOCK_IDS, left)
            ids.append(from_planes(block, n, kind))
            left -= n
        whole, at = np.concatenate(ids), 0
        for doc, n in zip(docs, lengths, strict=True):
            data = whole[at : at + n].tobytes()
            if out.add((doc, start + at, n, data), len(data)):
                yield out.take()
            at += n
    if out.rows:
        yield out.take()


_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _read_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    chunks = spark.read.schema(_CHUNK_SQL).parquet(f"{path}/chunks")
    index = spark.read.schema("shard int, chunk long, start long").parquet(f"{path}/index")
    return chunks.join(index, ["shard", "chunk"]).select("start", "doc_ids", "lengths", "planes", "kind", "n_ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document under ``path``; ids are little-endian 32-bit."""
    return _placed(spark, path).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    return _placed(spark, path).mapInArrow(_read_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-planes")
    write_tokens(load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_digests(spark, path)
