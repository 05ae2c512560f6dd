"""Near-duplicate documents by min-max hashing, exact verification and connected components.

Each hash function is evaluated once and gives two signature values, the minimum and the maximum. Bands of four
values (two minima, two maxima) deal documents into buckets. Documents with equal shingle sets are one node from the start. In
every bucket each node is first compared with the bucket's smallest node only. Large buckets that still hold several components
are cut into random blocks, and each block proposes a spanning forest of its likeliest links. Both cost as many comparisons
as a bucket has members, and they join up nearly all of a group. Only where a bucket still holds nodes of different
components are those compared with each other, component against component, in blocks of bounded size: no link
between different components is lost, and no pair inside one is ever made. All links are confirmed on full sets.

Before that, pairs are ruled out by parity bitmaps: each shingle flips one of PARITY bits, so the bitmaps of two sets
differ in at most as many bits as the sets have different members. This bound never rules out a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, sides
from .common import discard, small_batches, store
from .components import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS // 2
#: A signature that agrees in less than this share belongs to no pair of similarity 0.8: six standard deviations below.
AGREE = 0.8 - 6 * (0.8 * 0.2 / (BANDS * ROWS)) ** 0.5
#: Ids up to which a set of ids is sent to every executor; beyond that it is joined.
SENT_IDS = 1_000_000
PARITY = 2048
#: Shingles of a text from which it makes a batch of its own.
OUT = 100_000
#: Members from which a bucket's blocks propose forests.
LARGE = 16
#: Letters A-Z in lower case; bytes.split() then splits at the six ASCII white space characters.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
U64 = np.uint64


def stir(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHash(dict):
    """64-bit digests of words; forgets when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def word_hashes(text: str | None, cache: WordHash) -> np.ndarray:
    own = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    return np.fromiter(map(cache.__getitem__, own), U64, len(own))


def shingles(text: str | None, cache: WordHash, width: int) -> np.ndarray:
    """The distinct shingles as sorted digests; fewer words make one shingle, none make none."""
    w = word_hashes(text, cache)
    if not len(w):
        return w
    n = min(width, len(w))
    out = np.full(len(w) - n + 1, U64(n))
    for i in range(n):
        out = stir(out + w[i : len(w) - n + 1 + i])
    return np.unique(out)


_RNG = np.random.default_rng(23)
FACTOR = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFT = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima under each hash function."""
    low, high = np.full(HASHES, 2**32 - 1, np.uint32), np.zeros(HASHES, np.uint32)
    x = (own >> U64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        v = x[i : i + 2048, None] * FACTOR + SHIFT
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
    return low, high


def parity(own: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount((own & U64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8))


def possible(n: np.ndarray, odd: np.ndarray, sig: np.ndarray, k: int, near: np.ndarray, percent: int) -> np.ndarray:
    """Those of the rows near that may be linked with row k: by sizes, parity bitmaps and signatures, in this order."""
    near = near[100 * np.minimum(n[near], n[k]) >= percent * np.maximum(n[near], n[k])]
    apart = np.bitwise_count(odd[near] ^ odd[k]).sum(axis=1, dtype=np.int64)
    both = n[near] + n[k]
    near = near[100 * (both - apart) >= percent * (both + apart)]
    return near[(sig[near] == sig[k]).mean(axis=1) >= AGREE] if len(near) else near


def columns_of(t: pa.Table) -> tuple[np.ndarray, ...]:
    """node, part, n, parity bitmaps and signatures as arrays."""
    n = t.num_rows
    odd = np.frombuffer(b"".join(t.column("odd").to_pylist()), U64).reshape(n, -1)
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(n, -1)
    return (*(t.column(c).to_numpy() for c in ("node", "part", "n")), odd, sig)


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    one = low.astype(U64) << U64(32) | high
    return stir(stir(one[0::2] + U64(1)) + one[1::2] + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id in reach), kept.

    Links join documents with 100 * intersection >= percent * union of their sets of width-word shingles. Null, empty and
    white texts have an empty set and are linked with nothing. A null doc_id counts as larger than all others and
    comes out as a null component_id if nothing smaller is in reach. Rows that share a doc_id are judged by their own texts;
    all those with the component's id are kept. Texts are whole, of any length. No rows: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            out: list[tuple] = []
            for t in batch.column("t").to_pylist():
                own = shingles(t, cache, width)
                if len(own):
                    low, high = signature(own)
                    node = xxhash.xxh64_intdigest(own.tobytes()) - 2**63
                    out.append((len(own), node, band_keys(low, high), np.concatenate([low, high]).astype(np.uint8).tobytes(), parity(own).tobytes()))
                else:
                    out.append((0, None, None, None, None))
            n, node, keys, sig, odd = zip(*out, strict=True) if out else ((),) * 5
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "node", "bands", "sig", "odd"])

    sketches = store(rows.mapInArrow(sketch, "doc_id long, n long, node long, bands array<long>, sig binary, odd binary"), "sketches")
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    smallest = sketches.where("node is not null").groupBy("node").agg(F.min(order).alias("first"))
    # one row for each set: what it is made of is the same in all rows of a node
    nodes = sketches.where("node is not null").join(smallest, "node").where(order == F.col("first")).dropDuplicates(["node"])
    nodes = store(nodes.select("node", "first", "n", "bands", "sig", "odd"), "nodes")
    members = nodes.select(F.explode("bands").alias("band"), "node")
    buckets = members.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("band", "lead")
    shared = store(members.join(buckets, "band"), "buckets")
    stars = store(shared.where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = _confirm(spark, rows, nodes, stars, width, percent)
    # large buckets that hold more than one component
    first = store(components(links), "labels")
    large = _mixed(shared, first, LARGE)
    more = _confirm(spark, rows, nodes, store(_forest(large, nodes, percent).join(stars, ["a", "b"], "left_anti"), "forest"), width, percent)
    first = store(components(links.union(more)), "labels") if not more.isEmpty() else first
    # any bucket that does; one of two members had its only pair compared
    open_ = _mixed(shared, first, 3)
    rest = store(_across(open_.drop("m"), nodes, percent).join(stars, ["a", "b"], "left_anti"), "across")
    later = _confirm(spark, rows, nodes, rest, width, percent)
    end = [first.select(F.col("node").alias(x), F.col("label").alias(f"p{x}")) for x in ("a", "b")]
    bridges = later.join(end[0], "a", "left").join(end[1], "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    second = store(components(bridges), "labels").select(F.col("node").alias("mid"), F.col("label").alias("top"))
    label = nodes.select("node", "first").join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    label = label.join(second, F.col("label") == F.col("mid"), "left").select("node", "first", F.coalesce("top", "label").alias("label"))
    ids = label.groupBy("label").agg(F.min("first").alias("component"))
    ids = label.join(ids, "label").select("node", "component")
    out = sketches.select("doc_id", "n", "node").join(ids, "node", "left")
    component = F.coalesce("component", order)
    named = F.when(component < F.lit(2**63 - 1), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"), (order == component).alias("kept"))


def _confirm(spark, rows: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar, by their full sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = store(nodes.join(wanted, "node").select("node", F.col("first").alias("id")), "wanted")
    small = ids.count() <= SENT_IDS
    keyed = rows.withColumn("id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    unique = ids.select("id").distinct()
    texts = keyed.join(F.broadcast(unique) if small else unique, "id", "left_semi").select("t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            own: list[np.ndarray] = []
            for t in batch.column("t"):
                if len(one := shingles(t.as_py(), cache, width)):
                    own.append(one)
                if sum(map(len, own[-1:])) > OUT or len(own) >= 256:
                    yield _as_sets(own)
                    own = []
            yield _as_sets(own)

    full = store(texts.mapInArrow(sets, "node long, s array<long>").dropDuplicates(["node"]), "sets")
    x, y = (full.select(F.col("node").alias(k), F.col("s").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    # in the JVM, row by row: a batch of pairs of long texts would be as large as its rows are many
    both = pairs.join(y, "b").join(x, "a")
    found = both.where((100 + percent) * F.size(F.array_intersect("x", "y")) >= percent * (F.size("x") + F.size("y"))).select("a", "b")
    out = store(found, "links")
    for t in (ids, full):
        discard(t)
    return out


def _as_sets(own: list[np.ndarray]) -> pa.RecordBatch:
    cuts = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int32)
    values = np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64)
    nodes = pa.array([xxhash.xxh64_intdigest(x.tobytes()) - 2**63 for x in own], pa.int64())
    return pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))], ["node", "s"])


def _across(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of nodes that share a bucket but no component (part), as far as signatures and sizes allow a link."""
    body = ["n", "sig", "odd"]
    left, right = sides(members.join(nodes.select("node", *body), "node"), body)
    left = left.withColumn("side", F.lit(0))
    right = right.where("block <> block2").withColumn("side", F.lit(1))

    def compare(t: pa.Table) -> pa.Table:
        node, part, n, odd, sig = columns_of(t)
        side = t.column("side").to_numpy()
        i = np.flatnonzero(side == 0)
        j = np.flatnonzero(side == 1) if (side == 1).any() else i
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in i:
            near = possible(n, odd, sig, k, j[part[j] != part[k]], percent)
            a.append(np.minimum(node[near], node[k]))
            b.append(np.maximum(node[near], node[k]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return left.unionByName(right).groupBy("band", "block", "block2").applyInArrow(compare, "a long, b long").distinct()


def _mixed(shared: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """(band, node, part, m) of the buckets with at least so many members that are not all of one component."""
    placed = shared.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("part"))
    mixed = placed.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m"))
    return store(placed.join(mixed.where(F.col("m") >= least).where("lo < hi").select("band", "m"), "band"), "open")


def _forest(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b): for random blocks of each bucket a spanning forest of the possible links between parts, likeliest first."""
    block = F.pmod(F.xxhash64("band", "node"), F.ceil(F.col("m") / BLOCK))
    rows = members.select("band", block.alias("block"), "node", "part").join(nodes.select("node", "n", "sig", "odd"), "node")

    def grow(t: pa.Table) -> pa.Table:
        node, part, n, odd, sig = columns_of(t)
        pairs = []
        for k in range(len(node)):
            near = np.arange(k)
            for j in possible(n, odd, sig, k, near[part[near] != part[k]], percent):
                pairs.append((-float((sig[j] == sig[k]).mean()), int(j), k))
        up = {int(p): int(p) for p in part}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for _, j, k in sorted(pairs):
            x, y = top(int(part[j])), top(int(part[k]))
            if x != y:
                up[x] = y
                out.append(sorted((int(node[j]), int(node[k]))))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return rows.groupBy("band", "block").applyInArrow(grow, "a long, b long").distinct()
