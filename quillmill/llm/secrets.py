"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Base spans are the matches of three patterns (assignments, access keys, hex runs). The method
then looks at each longer token in a sensitive context (a credential word shortly before it on
its line): a compressor primed with the surrounding text, without the token, and with a
dictionary of common identifiers shows how many more bytes the token costs. Names, paths and
prose repeat what the dictionaries hold and cost little; a token that costs at least ``NOVELTY``
times what random characters of its alphabet would (frame overhead included) is reported as ``novel``.
That holds while the compressor stores characters as they are. Where it codes them, as in long
tokens and small alphabets, even random ones cost less; so a token is ``novel`` as well if it
costs at least ``LIKE_RANDOM`` of what random tokens of its length and its own characters cost
in its place under the same compressor.

Every candidate is measured, whatever its characters. But the compressor stores a short run of new
letters as it is, be it a word or not. A token that could be a word (letters only, none but the
first a capital) is therefore measured once more, behind the letters of its surroundings and of
the dictionary in random order: there it pays for letters by their frequency, and must cost
at least ``UNLIKE_WORD`` of what random letters cost.

Nulls and corner cases: a null text is empty; texts are scanned whole, one at a time; rows that
repeat a doc_id are scanned each; a null doc_id is carried; an empty table gives no rows. Other
columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Batcher, load, rows

# Fixed patterns of the base scan and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|cred|bearer|private|session|signature|salt|login|api", re.ASCII | re.IGNORECASE)
NEAR, AROUND, NOVELTY = 48, 1024, 1.15
LIKE_RANDOM, UNLIKE_WORD, SAMPLES = 0.96, 0.87, 5
WORD = re.compile("[A-Za-z][a-z]+")
# Fixed words of code and configuration, which no secret consists of.
IDENTIFIERS = """access account address api application array assert async attribute auth authorization await base64 boolean bucket buffer
cache callback certificate class client cluster column config configuration connection const constructor container context controller
cookie credential credentials database datetime default delete deploy description dictionary directory document domain download element
email encoding endpoint environment error event example exception execute export extends false field filename filter float folder format
function generate github global handler hash header hostname https identifier implements import index initialize input insert instance
integer interface internal iterator json kubernetes label lambda language length library license list localhost location logger login
manager message metadata method middleware migration module namespace network null number object operation option output package
parameter password path pattern payload permission pipeline placeholder platform plugin port position postgres prefix primary private
process production project property protected protocol provider public query queue random reader reference register registry repository
request resource response result return role route schema scope secret select sequence serializer server service session settings
signature source staging static status storage stream string struct subscription suffix table template test text thread timeout
timestamp token transaction true undefined update upload url user username utf8 validate value variable version volume webhook window
worker workspace writer xml yaml abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 changeme your_key_here xxxxxxxx"""


@lru_cache(maxsize=1)
def _identifiers() -> bytes:
    return " ".join(IDENTIFIERS.split()).encode()


def _packed(body: bytes, primer: bytes) -> int:
    """Size of ``body`` compressed with what ``primer`` holds at hand."""
    import zstandard

    words = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=9, dict_data=words, write_content_size=False, write_dict_id=False).compress(body))


def marginal_bytes(token: str, around: str) -> int:
    """What ``token`` adds to a frame primed with identifiers and its surroundings, which end with the text before it."""
    primer = _identifiers() + b"\n" + around.encode("utf-8", "surrogatepass")
    tail = around[-32:].encode("utf-8", "surrogatepass")
    return _packed(tail + token.encode(), primer) - _packed(tail, primer)


def novelty(token: str, around: str) -> float:
    """Marginal bytes as a share of what as many random characters of the token's alphabet would take."""
    alphabet = sum(n for chars, n in (("0123456789", 10), ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26), ("+/_=~-", 6)) if set(chars) & set(token))
    return marginal_bytes(token, around) / (len(token) * math.log2(max(2, alphabet)) / 8)


@lru_cache(maxsize=256)
def _random_tokens(length: int, alphabet: str) -> list[str]:
    """Fixed by length and alphabet, so that results don't depend on what was scanned before."""
    seed = int.from_bytes(hashlib.sha256(f"{length}:{alphabet}".encode()).digest()[:8])
    chars = np.frombuffer(alphabet.encode(), np.uint8)
    return [chars[x].tobytes().decode() for x in np.random.default_rng(seed).integers(0, len(chars), (SAMPLES, length))]


def like_a_word(token: str, around: str) -> bool:
    """Whether letters cost clearly less than random ones by the letter frequencies around them."""
    import zstandard

    common = np.frombuffer(_identifiers() + around.encode("utf-8", "surrogatepass"), np.uint8)
    common = np.random.default_rng(len(common)).permutation(common).tobytes()
    # Several orders of a token's letters, none of which matches another, tell its cost to less than a byte.
    orders = np.random.default_rng(len(token)).permuted(np.tile(np.arange(len(token)), (8, 1)), axis=1).ravel()
    packed = lambda x: len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(common + x))
    nothing = packed(b"")
    own, *others = (packed(np.frombuffer(x.lower().encode(), np.uint8)[orders].tobytes()) - nothing for x in (token, *_random_tokens(len(token), "abcdefghijklmnopqrstuvwxyz")))
    return SAMPLES * own < UNLIKE_WORD * sum(others)


def is_novel(token: str, around: str) -> bool:
    if WORD.fullmatch(token) and like_a_word(token, around):
        return False
    if novelty(token, around) >= NOVELTY:
        return True
    alphabet, own = "".join(sorted(set(token))), marginal_bytes(token, around)
    # Random tokens hardly cost less than their characters' bits; most others need no comparison.
    if 8 * own < 0.85 * len(token) * math.log2(max(2, len(alphabet))):
        return False
    return SAMPLES * own >= LIKE_RANDOM * sum(marginal_bytes(x, around) for x in _random_tokens(len(token), alphabet))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start, then kind."""
    low = text.lower()
    found = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible tokens in sensitive contexts that overlap no base span; ``base`` is sorted."""
    found, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        token, (a, b) = m.group(), m.span()
        while at < len(base) and base[at][0] < b:
            at, reach = at + 1, max(reach, base[at][2])
        if reach > a:
            continue
        line = text[max(0, a - NEAR) : a].rpartition("\n")[2]
        if SENSITIVE.search(line) and is_novel(token, text[b : b + AROUND] + text[max(0, a - AROUND) : a]):
            found.append((a, 3, b))
    return found


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Batcher(_FOUND)
    for doc, text in rows(batches, "doc_id", "text"):
        text = text or ""
        base = base_spans(text)
        spans = sorted(base + novel_spans(text, base))
        n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        if out.add((doc, *n, hashlib.sha256(_text_of(base).encode()).hexdigest(), _text_of(spans)), 200 + 20 * len(spans)):
            yield out.take()
    if out.rows:
        yield out.take()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
