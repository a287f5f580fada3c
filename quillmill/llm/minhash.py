"""MinHash near-dedup: circulant signatures, banding, exact verification, components.

Signatures (circulant MinHash). Two permutations serve all coordinates: sigma places a shingle
in a universe of ``UNIVERSE`` slots, and pi orders the slots; coordinate k looks pi up k slots
further on, circularly. With pi laid out twice in memory a shingle's values for all coordinates
are one contiguous window, so a signature is the minimum over a few memory rows.

Banding. At similarity 0.85, 45 bands of 7 coordinates (see ``banding``): a pair at the threshold
shares no band with probability 4e-8. Documents with the same shingle set are one class; only its
smallest doc_id goes on. The sets themselves are not kept: those of documents that share a bucket
with another are made again from their texts.

Verification without pairs of a whole group. Each bucket names one hub, a document that shares
many buckets with others (``hub_pairs``); its members are compared with the hub on full shingle
sets, in salted streams that never gather a group. Verified links merge classes into components.

What is left are pairs x, y of different components under one hub p. They need no full sets: with
X = x ^ p and Y = y ^ p, x ^ y is X ^ Y, so sizes and the small sets X and Y decide exactly. x and y
are linked only if |X ^ Y| <= a, the share of |x| + |y| that the threshold leaves, so X and Y share
(|X| + |Y| - a) / 2 elements at least, and by the prefix principle one among the first
(|X| - |Y| + a) / 2 + 1 of X and the first (|Y| - |X| + a) / 2 + 1 of Y in any common order. The order
takes elements that only one component has first (they join nothing and are not even joined on),
then by their number of owners, rarest first; what all copies of a text have lost or gained comes
last and is hardly ever reached. Elements that too many documents have within their prefix are not paired
up: their owners form a new, smaller group around one of them, by differences to it (X ^ Q), and are
treated in the same way (``across_components``). No link between candidates is lost.

Components. Minimum-label propagation with pointer jumping on the verified links; every round is
written to the shared folder.

Nulls and corner cases: a null text is empty; a document without words has an empty set and is
linked with nothing; fewer words than ``SHINGLE`` make one shingle; rows that repeat a doc_id are
one document if their sets agree (a link joins them in any case, as they share the id); a null
doc_id is a class of its own rows, its component null and ``kept`` true; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batcher, load, rows, shuffle_partitions, stored, words_of

UNIVERSE, SHINGLE = 1 << 20, 5
#: Members that share one copy of their hub in a stream, and how many documents may lead an element's pairs before a group of its own is made.
STREAM, MOST_LEADERS = 128, 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares no band with a probability under 1e-7."""
    rows = 7 if percent >= 85 else 6 if percent >= 80 else 4
    miss = 1 - (percent / 100) ** rows
    return math.ceil(math.log(4e-8) / math.log(miss)), rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KNOWN: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, each distinct word hashed once while it stays in a bounded cache."""
    import xxhash

    known, out = _KNOWN, []
    if len(known) > 400_000:
        known.clear()
    try:
        out = [known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        out = [known[w] for w in words]
    return np.array(out, np.uint64)


def shingle_set(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width = min(width, len(h))
    n = len(h) - width + 1
    acc = np.full(n, np.uint64(len(words) if len(words) < SHINGLE else SHINGLE), np.uint64)
    for k in range(width):
        acc = mix((acc + h[k : k + n]) * _M1)
    return np.unique(acc)


@lru_cache(maxsize=2)
def _windows(size: int) -> np.ndarray:
    pi = np.random.default_rng(7).permutation(UNIVERSE).astype(np.uint32)
    laid = np.concatenate([pi, pi[:size]])
    return np.lib.stride_tricks.sliding_window_view(laid, size)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a shingle set."""
    windows, out = _windows(size), np.full(size, np.uint32(0xFFFFFFFF))
    slots = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    for at in range(0, len(slots), 256):
        np.minimum(out, windows[slots[at : at + 256]].min(axis=0), out=out)
    return out


def bands(sig: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit key a band."""
    acc = np.arange(n, dtype=np.uint64)
    for row in sig.reshape(n, -1).T:
        acc = mix((acc + row) * _M1)
    return acc.view(np.int64)


_BANDED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
_BANDED_SQL = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
def _band(batches: Iterator[pa.RecordBatch], n: int, width: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    out = Batcher(_BANDED)
    for doc, text in rows(batches, "doc_id", "text"):
        found = shingle_set(words_of(text))
        digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
        if out.add((doc, len(found), int(digest[0]), int(digest[1]), bands(signature(found, n * width), n).tolist() if len(found) else []), 500):
            yield out.take()
    if out.rows:
        yield out.take()


_STREAM = pa.schema([("ga", pa.int64()), ("gb", pa.int64()), ("salt", pa.int64()), ("node", pa.int64()), ("sid", pa.int64()), ("first", pa.bool_()), ("wanted", pa.bool_()), ("shingles", pa.binary())])
_STREAM_SQL = "ga long, gb long, salt long, node long, sid long, first boolean, wanted boolean, shingles binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of rows as shingle sets; a repeated doc_id has several texts, of which ``sid`` names one."""
    import xxhash

    out, last, data, digest = Batcher(_STREAM), None, b"", 0
    for text, *row in rows(batches, "text", "ga", "gb", "salt", "node", "sid", "first", "wanted"):
        if text != last:
            last, data = text, shingle_set(words_of(text)).tobytes()
            digest = int(np.frombuffer(xxhash.xxh3_128_digest(data), np.int64)[0])
        if digest == row[4] and out.add((*row, data), len(data) + 64):
            yield out.take()
    if out.rows:
        yield out.take()


def _absent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The elements of a sorted set that another hasn't."""
    return a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] != a] if len(b) else a


_HUB = pa.schema([("ga", pa.int64()), ("gb", pa.int64()), ("node", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("linked", pa.bool_()), ("diff", pa.list_(pa.int64()))])
_HUB_SQL = "ga long, gb long, node long, sid long, n long, d long, linked boolean, diff array<long>"


def _against_hubs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members compared with the hub whose row comes before theirs; differences only where they are wanted."""
    out, hub, last = Batcher(_HUB), np.empty(0, np.uint64), None
    for ga, gb, node, sid, first, wanted, data in rows(batches, "ga", "gb", "node", "sid", "first", "wanted", "shingles"):
        if last == (ga, gb, first, node, sid):  # the same document, given twice
            continue
        own, last = np.frombuffer(data, np.uint64), (ga, gb, first, node, sid)
        if first:
            hub = own
            continue
        new, gone = _absent(own, hub), _absent(hub, own)
        both = len(own) - len(new)
        linked = 100 * both >= percent * (len(own) + len(hub) - both)
        diff = np.concatenate([new, gone]).view(np.int64).tolist() if wanted else []
        if (linked or wanted) and out.add((ga, gb, node, sid, len(own), len(new) + len(gone), linked, diff), 64 + 8 * len(diff)):
            yield out.take()
    if out.rows:
        yield out.take()


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (node, label) after merging along ``links`` (a, b): the smallest label reachable.

    Links join labels, not nodes: each round works on the graph of current labels, whose size
    shrinks, and finds for each label its smallest neighbour, then follows pointers twice.
    """
    at = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
    edges = stored(at.select(F.greatest("la", "lb").alias("u"), F.least("la", "lb").alias("v")).distinct(), "near-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "near-up")
        for _ in range(2):
            up = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.u"), "left").select("x.u", F.coalesce("y.p", "x.p").alias("p"))
        up = stored(up, "near-pointers")
        labels = stored(labels.join(up, labels["label"] == up["u"], "left").select("node", F.coalesce("p", "label").alias("label")), "near-labels")
        edges = (
            edges.join(up.select("u", F.col("p").alias("pu")), "u")
            .join(up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            .where("pu <> pv")
            .select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v"))
            .distinct()
        )
        edges = stored(edges, "near-edges")
    return labels


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """(ga, gb, node, sid, members) for ``buckets`` (bucket, node, sid, size): who is compared with which hub (ga, gb).

    A hub should be alike to many, so that differences to it are small: first the member that
    meets most others over all its buckets, then the best of the hubs that the bucket's members
    have elsewhere. So the buckets of one group of copies agree on a hub.
    """
    degree = buckets.groupBy("node", "sid").agg(F.sum("size").alias("degree"))
    best = lambda *c: F.max(F.struct(*c)).alias("h")
    nearest = stored(buckets.join(degree, ["node", "sid"]).groupBy("bucket").agg(best("degree", "node", "sid")), "near-nearest")
    theirs = buckets.join(nearest, "bucket").groupBy("node", "sid").agg(best("h.degree", "h.node", "h.sid"))
    chosen = stored(buckets.join(theirs, ["node", "sid"]).groupBy("bucket").agg(best("h.degree", "h.node", "h.sid")), "near-chosen")
    pairs = buckets.join(chosen, "bucket").select(F.col("h.node").alias("ga"), F.col("h.sid").alias("gb"), "node", "sid").where("ga <> node or gb <> sid").distinct()
    pairs = stored(pairs, "near-pairs")
    return pairs.join(stored(pairs.groupBy("ga", "gb").agg(F.count(F.lit(1)).alias("members")), "near-members"), ["ga", "gb"])


def against_hubs(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``pairs`` of hub_pairs with sizes, verdicts and, in groups of two or more members, differences to the hub."""
    salt = F.pmod(F.xxhash64("node", "sid"), F.ceil(F.col("members") / STREAM)).alias("salt")
    dealt = stored(pairs.select("ga", "gb", salt, "node", "sid", F.lit(False).alias("first"), (F.col("members") > 1).alias("wanted")), "near-dealt")
    heads = dealt.select("ga", "gb", "salt").distinct().select("ga", "gb", "salt", F.col("ga").alias("node"), F.col("gb").alias("sid"), F.lit(True).alias("first"), F.lit(False).alias("wanted"))
    # The same kind of join at every size: what is sent for few documents to all executors grows with the input.
    texts = docs.select("doc_id", "text").join(dealt.unionByName(heads).hint("merge"), F.col("doc_id") == F.col("node"))
    sets = texts.mapInArrow(_sets, _STREAM_SQL).repartition(shuffle_partitions(docs.sparkSession), "ga", "gb", "salt")
    streams = sets.sortWithinPartitions("ga", "gb", "salt", F.desc("first"), "node", "sid")
    return streams.drop("salt").mapInArrow(partial(_against_hubs, percent=percent), _HUB_SQL)


def across_components(live: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``nodes`` (node, label) after merging along all links between members of a group of ``live``.

    ``live``: ga, gb (the group), node, sid, n (set size), d and diff (difference to the group's hub).
    """
    spare = f"(100 - {int(percent)}) / (100 + {int(percent)})"
    group, owner = ["ga", "gb"], ["ga", "gb", "node", "sid"]
    while True:
        # Groups whose members are still in several components; ``main`` is the largest of these.
        labelled = live.join(nodes, "node")
        parts = labelled.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("members"), F.min("d").alias("least"), F.max("n").alias("most"))
        main = parts.groupBy(*group).agg(F.max(F.struct("members", "label"))["label"].alias("main"), F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        other = parts.join(main.select(*group, "main"), group).where("label <> main").groupBy(*group).agg(F.min("least").alias("least_other"))
        torn = main.join(other, group).drop("parts")
        live = stored(labelled.join(stored(torn, "near-torn"), group), "near-live")
        if live.isEmpty():
            return nodes
        # Elements that members of several components have; all others of a member come before them.
        owned = live.select(*owner, "label", F.explode("diff").alias("element"))
        mixed = owned.groupBy(*group, "element").agg(F.count(F.lit(1)).alias("owners"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").drop("low", "high")
        hits = owned.join(stored(mixed, "near-mixed"), [*group, "element"]).drop("label")
        each = Window.partitionBy(*owner)
        ranked = hits.withColumn("nth", F.row_number().over(each.orderBy("owners", "element"))).withColumn("hits", F.count(F.lit(1)).over(each))
        sized = ranked.join(live.drop("diff"), owner).withColumn("rank", F.expr("d - hits + nth - 1"))
        # ``spread`` is the most that x and a linked y may differ by, ``floor`` the least d of its possible partners.
        sized = sized.withColumn("spread", F.expr(f"floor((n + least(n * 100 / {int(percent)}, most)) * {spare} + 1e-9)"))
        sized = sized.withColumn("floor", F.expr("greatest(d - spread, if(label = main, least_other, least))"))
        sized = sized.where("rank <= (d - floor + spread) / 2").withColumn("leads", F.expr("rank <= (d - greatest(d, floor) + spread) / 2"))
        keyed = stored(sized.select(*owner, "element", "label", "n", "d", "rank", "leads"), "near-keys")
        key = [*group, "element"]
        keys = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("owners"), F.sum(F.col("leads").cast("int")).alias("leaders"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("d", "node", "sid")).alias("q"))
        keys = stored(keys.where("low <> high and leaders > 0").drop("low", "high"), "near-key-sizes")
        few = keyed.join(keys.where(F.col("leaders") <= MOST_LEADERS).select(*key, F.ceil(F.col("owners") / STREAM).alias("slots")), key)
        i, j = (few.select(*key, "slots", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "sid", "label", "n", "d", "rank", "leads"))) for k in "ij")
        i = i.where("leads_i").withColumn("slot", F.explode(F.expr("sequence(0L, slots - 1)"))).drop("slots")
        j = j.withColumn("slot", F.expr("pmod(xxhash64(node_j, sid_j), slots)")).drop("slots")
        allowed = f"floor((n_i + n_j) * {spare})"
        near = f"""label_i <> label_j and (d_i < d_j or d_i = d_j and (node_i < node_j or node_i = node_j and sid_i < sid_j)) and d_j - d_i <= {allowed}
            and rank_i <= (d_i - d_j + {allowed}) / 2 and rank_j <= (d_j - d_i + {allowed}) / 2"""
        pairs = i.join(j, [*key, "slot"]).where(near).groupBy("node_i", "sid_i", "node_j", "sid_j").agg(F.min(F.struct(*group)).alias("g")).select("g.*", "node_i", "sid_i", "node_j", "sid_j")
        x, y = (live.select(*group, *(F.col(c).alias(f"{c}_{k}") for c in ("node", "sid", "n", "diff"))) for k in "ij")
        checked = pairs.join(x, [*group, "node_i", "sid_i"]).join(y, [*group, "node_j", "sid_j"])
        apart = "(size(diff_i) + size(diff_j) - 2 * size(array_intersect(diff_i, diff_j)))"
        # Both sets together have (n_i + n_j + apart) / 2 elements, and share apart less.
        alike = f"100 * (n_i + n_j - {apart}) >= {int(percent)} * (n_i + n_j + {apart})"
        links = checked.where(alike).select(F.col("node_i").alias("a"), F.col("node_j").alias("b"))
        many = keys.where(F.col("leaders") > MOST_LEADERS)
        if many.isEmpty():
            return components(links, nodes)
        inner = many.select(*key, F.xxhash64(*key).alias("na"), F.xxhash64(F.lit(1), *key).alias("nb"), F.col("q.node").alias("qn"), F.col("q.sid").alias("qs"))
        hubs = live.select(*group, F.col("node").alias("qn"), F.col("sid").alias("qs"), F.col("n").alias("q_size"), F.col("diff").alias("q_diff"))
        centre = inner.join(hubs, [*group, "qn", "qs"])
        members = keyed.select(*owner, "element").join(live.select(*owner, "n", "diff"), owner).join(centre, key).where("node <> qn or sid <> qs")
        apart = F.array_union(F.array_except("diff", "q_diff"), F.array_except("q_diff", "diff"))
        deeper = stored(members.select(F.col("na").alias("ga"), F.col("nb").alias("gb"), "node", "sid", "n", apart.alias("diff"), "qn", "q_size").withColumn("d", F.size("diff").cast("long")), "near-inner")
        more = deeper.where(f"100 * (n + q_size - d) >= {int(percent)} * (n + q_size + d)").select(F.col("node").alias("a"), F.col("qn").alias("b"))
        nodes = components(links.unionByName(more), nodes)
        live = deeper.select(*owner, "n", "d", "diff")


def near_groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for ``docs`` (doc_id, text)."""
    n, width = banding(percent)
    banded = stored(docs.select("doc_id", "text").mapInArrow(partial(_band, n=n, width=width), _BANDED_SQL), "near-bands")
    classes = banded.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes.where("size > 1").drop("size"), "near-classes")
    classed = banded.join(classes, ["set_a", "set_b"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    known = stored(classed.select("doc_id", "n_shingles", F.col("set_a").alias("sid"), "rep"), "near-known")
    # One row of a class speaks for it; equal sets have equal bands.
    exploded = classed.where("rep = doc_id and n_shingles > 0").select(F.col("doc_id").alias("node"), F.col("set_a").alias("sid"), F.explode("bands").alias("bucket"))
    sizes = stored(exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
    buckets = stored(exploded.join(sizes, "bucket").distinct(), "near-buckets")
    first = stored(against_hubs(hub_pairs(buckets), docs, percent), "near-first")
    # Rows that share a doc_id are one node whatever their texts; its classes start out linked.
    same_id = known.where("rep <> doc_id and n_shingles > 0").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    nodes = known.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("node"), F.col("rep").alias("label")).groupBy("node").agg(F.min("label").alias("label"))
    nodes = components(same_id, stored(nodes, "near-labels"))
    nodes = components(first.where("linked").select(F.col("ga").alias("a"), F.col("node").alias("b")), nodes)
    live = first.where("size(diff) > 0").select("ga", "gb", "node", "sid", "n", "d", "diff")
    nodes = across_components(live, nodes, percent)
    # Labels are the least doc_ids of classes, so a component's label is its least doc_id.
    final = nodes.select("node", F.col("label").alias("component"))
    return known.join(final, known["doc_id"] == final["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near(docs: DataFrame, percent: int) -> DataFrame:
    """``docs`` with one document of each group; rows that share its doc_id stay together."""
    gone = near_groups(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "documents"))
