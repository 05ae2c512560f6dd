"""Exact duplicate substrings: suffixes are ordered by their first WIDTH bytes only, by most-significant-digit passes.

Two suffixes are equal to depth WIDTH if the same WIDTH-byte string starts at both. The first digit of a suffix is the sampled
K-byte string that marks its window: of each WIDTH consecutive bytes at least one K-byte string is chosen (the smallest
digest), and the same bytes choose the same one. The first pass deals those digits into buckets by their top bits and sorts
the buckets; suffixes whose digit is nowhere else are done. The second pass does the same with the digests of all
WIDTH bytes of the suffixes that are left. What is equal then are exactly the repeated windows, but for collisions of 64-bit digests.

Documents are dealt into parts by ranges of doc_id, so of two parts the lower one holds the smaller ids. A part sends each
distinct digit once, without positions: a passage that a third of all documents share costs one entry for each part. Back
comes one bit for each: whether it is elsewhere (first pass), or in a lower part (second pass). Exact copies of whole
documents are found by digest first and take no part in this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID
from .minhash import stir

WIDTH, K = 50, 24
SPAN = WIDTH - K + 1
#: Bytes of text: in a part, in one pass of NumPy, for each bucket.
PART, PASS, BUCKET = 8 << 20, 1 << 20, 2 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    out[1:] = base & (2**64 - 1)
    return np.multiply.accumulate(out)


POWER, BACK = _powers(BASE, PASS + 2 * WIDTH), _powers(pow(BASE, -1, 2**64), PASS + 2 * WIDTH)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each width neighbours."""
    have = 1
    while have * 2 <= width:
        x, have = pick(x[:-have], x[have:]), have * 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Pass:
    """Bytes of several documents side by side, at most about PASS; longer documents are cut into pieces that overlap."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.doc = np.array([d for d, _, _ in pieces], np.int64)
        self.offset = np.array([o for _, o, _ in pieces], np.int64)
        size = np.array([len(b) for _, _, b in pieces], np.int64)
        self.begin = np.r_[0, np.cumsum(size)]
        raw = np.frombuffer(b"".join(b for _, _, b in pieces), np.uint8)
        self.n = len(raw)
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(raw * POWER[: self.n], out=self.sums[1:])
        edges = np.zeros(self.n + 1, np.int32)
        whole = size >= WIDTH
        np.add.at(edges, self.begin[:-1][whole], 1)
        np.add.at(edges, self.begin[:-1][whole] + size[whole] - WIDTH + 1, -1)
        self.starts = np.cumsum(edges)[: max(0, self.n - WIDTH + 1)] > 0  # where a window of one document starts

    def digest(self, at: np.ndarray, width: int) -> np.ndarray:
        return stir((self.sums[at + width] - self.sums[at]) * BACK[at])

    def grams(self) -> np.ndarray:
        return stir((self.sums[K:] - self.sums[:-K]) * BACK[: self.n - K + 1]) | U64(1)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and digests of the K-byte strings chosen by the windows."""
        if self.n < WIDTH or not self.starts.any():
            return np.empty(0, np.int64), np.empty(0, U64)
        own = self.grams()
        least = np.where(self.starts, sliding(own, SPAN, np.minimum), U64(0))
        pad = np.zeros(SPAN - 1, U64)
        at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum) == own)
        return at, own[at]

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1


def passes(texts: list[bytes], use: np.ndarray) -> Iterator[Pass]:
    pieces, size = [], 0
    for d, raw in enumerate(texts):
        if not use[d] or len(raw) < WIDTH:
            continue
        for o in range(0, max(1, len(raw) - WIDTH + 1), PASS):
            b = raw[o : o + PASS + WIDTH - 1]
            if size + len(b) > PASS + WIDTH and pieces:
                yield Pass(pieces)
                pieces, size = [], 0
            pieces.append((d, o, b))
            size += len(b)
    if pieces:
        yield Pass(pieces)


class Digits:
    """The distinct digits of a part in order, cut into buckets by their top bits; under: how many bits are below these."""

    def __init__(self, keys: np.ndarray, bits: int, under: int):
        self.keys, self.low = keys, -(-under // 8)
        self.cuts = np.searchsorted(keys >> U64(under), np.arange((1 << bits) + 1, dtype=U64))

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        planes = self.keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.low]
        for b in range(len(self.cuts) - 1):
            if self.cuts[b] < self.cuts[b + 1]:
                yield b, planes[self.cuts[b] : self.cuts[b + 1]].T.tobytes()  # by byte: sorted ones compress

    def flags(self, bits: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(self.keys), bool)
        for b, packed in bits.items():
            lo, hi = self.cuts[b], self.cuts[b + 1]
            out[lo:hi] = np.unpackbits(np.frombuffer(packed, np.uint8), count=hi - lo)
        return out


def unpack(blob: bytes, low: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(low, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :low] = planes.T
    return wide.view("<u8")[:, 0]


class Part:
    """The documents of a part in the order of their ids, and what is known about them so far."""

    def __init__(self, docs: pa.Table, info: pa.Table, bits: int):
        ids = docs.column("doc").to_numpy()
        turn = np.argsort(ids, kind="stable")
        self.ids, self.turn, self.bits = ids[turn], turn, bits
        texts = docs.column("t").combine_chunks()
        self.texts = [(texts[int(i)].as_buffer() or b"") for i in turn]
        self.texts = [x.to_pybytes() if x else b"" for x in self.texts]
        self.sent: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
        copies = set()
        for kind, a, b in zip(info.column("kind").to_pylist(), info.column("a").to_pylist(), info.column("b").to_pylist(), strict=True):
            if kind:
                self.sent[kind][a] = b
            else:
                copies.add((a, b))
        maybe = {a for a, _ in copies}
        self.copy = np.array([i in maybe and (int(i), hashlib.md5(t).digest()) in copies for i, t in zip(self.ids, self.texts, strict=True)], bool)

    def first(self) -> tuple[Digits, np.ndarray]:
        """The digits of the anchors, and which of them two documents of this part share."""
        found, docs = [], []
        for p in passes(self.texts, ~self.copy):
            at, own = p.anchors()
            found.append(own >> U64(24 - self.bits))
            docs.append(self.ids[p.doc[p.piece(at)]] if len(at) else np.empty(0, np.int64))
        keys = np.concatenate(found) if found else np.empty(0, U64)
        doc = np.concatenate(docs) if docs else np.empty(0, np.int64)
        turn = np.argsort(keys, kind="stable")
        distinct, begin = np.unique(keys[turn], return_index=True)
        doc = doc[turn]
        several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin) if len(keys) else np.empty(0, bool)
        return Digits(distinct, self.bits, 40), several

    def second(self) -> tuple[list[tuple[Pass, np.ndarray]], np.ndarray]:
        """Each pass with the windows whose own anchor is shared, and the digests of those windows."""
        digits, several = self.first()
        shared = several | digits.flags(self.sent[1])
        out, keys = [], []
        for p in passes(self.texts, ~self.copy):
            start = np.flatnonzero(p.starts)
            least = sliding(p.grams(), SPAN, np.minimum)[start] >> U64(24 - self.bits)
            head = np.r_[True, least[1:] != least[:-1]]  # neighbours mostly have the same
            start = start[shared[np.searchsorted(digits.keys, least[head])][np.cumsum(head) - 1]]
            keys.append(p.digest(start, WIDTH))
            out.append((PassDocs(p), start))
        return out, np.concatenate(keys) if keys else np.empty(0, U64)

    def removed(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each document the maximal runs of bytes to remove (n x 2)."""
        found, keys = self.second()
        distinct, begin, spot = np.unique(keys, return_index=True, return_inverse=True)
        lower = Digits(distinct, self.bits, 64 - self.bits).flags(self.sent[2])
        doc = np.concatenate([p.doc[p.piece(s)] for p, s in found]) if found else np.empty(0, np.int64)
        place = np.concatenate([s - p.begin[p.piece(s)] + p.offset[p.piece(s)] for p, s in found]) if found else np.empty(0, np.int64)
        gone = lower[spot] | (self.ids[doc] > self.ids[doc[begin]][spot]) if len(keys) else np.empty(0, bool)
        doc, place = doc[gone], place[gone]
        cuts = np.searchsorted(doc, np.arange(len(self.texts) + 1))
        for d, raw in enumerate(self.texts):
            if self.copy[d]:
                yield d, np.array([[0, len(raw)]], np.int64)
            elif cuts[d] == cuts[d + 1]:
                yield d, np.empty((0, 2), np.int64)
            else:
                at = place[cuts[d] : cuts[d + 1]]
                new = np.flatnonzero(np.r_[True, np.diff(at) > WIDTH])
                yield d, np.c_[at[new], at[np.r_[new[1:] - 1, len(at) - 1]] + WIDTH]


class PassDocs:
    """What is needed of a Pass once its digests are made."""

    def __init__(self, p: Pass):
        self.doc, self.offset, self.begin, self.piece = p.doc, p.offset, p.begin, lambda at: np.searchsorted(p.begin, at, "right") - 1


def _meet(low: int, lower_only: bool):
    """For each part's digits of a bucket: whether another (or a lower) part has the same."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part").to_numpy()
        own = [unpack(b, low) for b in t.column("blob").to_pylist()]
        size = np.array([len(x) for x in own])
        keys, whose = np.concatenate(own), np.repeat(part, size)
        turn = np.lexsort((whose, keys))
        same = keys[turn][1:] == keys[turn][:-1]
        flag = np.zeros(len(keys), bool)
        flag[turn[1:][same]] = True
        if not lower_only:
            flag[turn[:-1][same]] = True
        bits = [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum(size)[:-1])]
        return pa.table({"part": t.column("part"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return run


def part_of(doc: Column, bounds: list[int]) -> Column:
    """How many bounds are at most doc: those of a coarse list first, then those of one stretch."""
    step = max(1, round(len(bounds) ** 0.5))
    coarse, fine = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]), F.array(*[F.lit(b) for b in bounds])
    if not bounds:
        return F.lit(0)
    tens = F.size(F.filter(coarse, lambda b: b <= doc)) * step
    return (tens + F.size(F.filter(F.slice(fine, tens + 1, F.lit(step)), lambda b: b <= doc))).cast("int")


def layout(rows: DataFrame, part_bytes: int) -> tuple[list[int], int]:
    """Bounds of doc between parts of about part_bytes of text, and bits of a bucket's number."""
    marks = [i / 1000 for i in range(1, 1000)]
    got = rows.agg(F.sum(F.octet_length("t")).alias("bytes"), F.percentile_approx("doc", marks, 100_000).alias("q")).first()
    total, q = got["bytes"] or 0, [b for b in got["q"] or [] if b is not None]
    parts = max(1, -(-total // part_bytes))
    if q:  # between the quantiles the bounds are dealt evenly
        q = sorted({min(int(x), NO_ID) for x in np.interp(np.linspace(0, len(q) - 1, max(2, parts))[1:-1] if parts < 1000 else np.linspace(0, len(q) - 1, parts), np.arange(len(q)), np.array(q, np.float64))}) if parts > 1 else []
    return q, max(4, (total // BUCKET).bit_length())


def duplicate_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", part_bytes: int = PART) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, spans (array of start and end byte), kept (binary).

    Removed is each byte covered by a WIDTH-byte string that also starts in a row with a smaller doc_id. Null text counts as
    empty; texts under WIDTH bytes lose nothing. Rows without an id come after all others and do not take from each
    other, nor do rows that share an id. Texts of any length are compared whole. No rows: no rows. Extra columns are not
    looked at.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("t"))
    bounds, bits = layout(rows, part_bytes)
    parts = rows.select(part_of(F.col("doc"), bounds).alias("part"), "doc", "t")
    prints = rows.where(F.octet_length("t") >= WIDTH).select("doc", F.unhex(F.md5("t")).alias("print"))
    again = prints.groupBy("print").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = prints.join(again, "print").where("doc > least").select(part_of(F.col("doc"), bounds).alias("part"), F.lit(0).alias("kind"), F.col("doc").alias("a"), F.col("print").alias("b"))
    sent = "part int, bucket int, blob binary"

    def send(which: int):
        def run(own: pa.Table, info: pa.Table) -> pa.Table:
            found: list[tuple[int, bytes]] = []
            if own.num_rows:
                p = Part(own, info, bits)
                found = list(p.first()[0].blobs() if which == 1 else Digits(np.unique(p.second()[1]), bits, 64 - bits).blobs())
                number = own.column("part")[0].as_py()
            return pa.table({"part": pa.array([number for _ in found], pa.int32()), "bucket": pa.array([b for b, _ in found], pa.int32()), "blob": pa.array([x for _, x in found], pa.binary())})

        return run

    def told(df: DataFrame, kind: int) -> DataFrame:
        return df.select("part", F.lit(kind).alias("kind"), F.col("bucket").cast("long").alias("a"), F.col("bits").alias("b"))

    both = lambda info: parts.groupBy("part").cogroup(info.groupBy("part"))
    reply = "part int, bucket int, bits binary"
    one = both(copies).applyInArrow(send(1), sent).groupBy("bucket").applyInArrow(_meet(5, False), reply)
    info = copies.union(told(one, 1))
    two = both(info).applyInArrow(send(2), sent).groupBy("bucket").applyInArrow(_meet(-(-(64 - bits) // 8), True), reply)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def finish(own: pa.Table, info: pa.Table) -> pa.Table:
        ids, sizes, spans, kept = [], [], [], []
        if own.num_rows:
            p = Part(own, info, bits)
            for d, runs in p.removed():
                raw, last, left = p.texts[d], 0, []
                for s, e in runs:
                    left.append(raw[last:s])
                    last = e
                ids.append(None if p.ids[d] == NO_ID else int(p.ids[d]))
                sizes.append(len(raw))
                spans.append([{"start": int(s), "end": int(e)} for s, e in runs])
                kept.append(b"".join([*left, raw[last:]]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, pa.list_(span)), "kept": pa.array(kept, pa.binary())})

    out = both(info.union(told(two, 2))).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")
