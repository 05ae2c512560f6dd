"""Benchmark decontamination with an FM-index for each shard of the training documents.

A shard is a batch of documents of bounded size inside one task. Its words are numbered by the benchmark's vocabulary; a
word that no item has cannot be part of an occurrence, so only runs of known words that are long enough are indexed. All
test phrases are searched backwards at once through the wavelet matrix; occurrences are located by sampled suffix
positions, and their spans are merged. The documents are never shuffled.

The benchmark reaches the executors in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, store
from .fmindex import FMIndex

#: A word is a run of digits, letters and non-ASCII characters, A-Z in lower case.
PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(PLAIN).split()


class Phrases:
    """The windows of a block of items, numbered, by length."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in item_words(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners[tuple(own[i : i + window])].update(() if item is None else (item,))
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        for n in sorted({len(p) for p in owners}):
            own = [p for p in owners if len(p) == n]
            self.by_length.append((np.array(own, np.int64), [sorted(owners[p]) for p in own]))
        self.shortest = min((p.shape[1] for p, _ in self.by_length), default=0)


def scan(texts: list[str | None], phrases: Phrases, shard_words: int) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """For each text: its number of words, merged spans of hit words (n x 2), items found."""
    at = 0
    while at < len(texts):
        runs, where, lengths, total = [], [], [], 0
        first = at
        while at < len(texts) and (total < shard_words or at == first):
            own = item_words(texts[at])
            known = np.fromiter((phrases.numbers.get(w, 0) for w in own), np.int64, len(own))
            edges = np.flatnonzero(np.diff(np.r_[0, known != 0, 0]))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if phrases.shortest and b - a >= phrases.shortest:
                    runs += [known[a:b], np.zeros(1, np.int64)]
                    where.append((at - first, a, b - a))
                    total += b - a
            lengths.append(len(own))
            total += len(own) // 64
            at += 1
        yield from _shard(lengths, runs, where, phrases)


def _shard(lengths: list[int], runs: list[np.ndarray], where: list[tuple[int, int, int]], phrases: Phrases) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    items: dict[int, set[str]] = defaultdict(set)
    hit: dict[int, np.ndarray] = {}
    if runs:
        index = FMIndex(np.concatenate(runs), len(phrases.numbers))
        doc, word, size = np.array(where, np.int64).T
        begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        for own, owners in phrases.by_length:
            phrase, place = index.search(own)
            run = np.searchsorted(begin, place, "right") - 1
            in_doc, in_word = doc[run], word[run] + place - begin[run]
            turn = np.argsort(in_doc, kind="stable")
            phrase, in_doc, in_word = phrase[turn], in_doc[turn], in_word[turn]
            cuts = np.flatnonzero(np.diff(in_doc)) + 1
            for rows in np.split(np.arange(len(in_doc)), cuts) if len(in_doc) else ():
                d = int(in_doc[rows[0]])
                marks = hit.setdefault(d, np.zeros(lengths[d] + 1, np.int64))
                np.add.at(marks, in_word[rows], 1)
                np.add.at(marks, in_word[rows] + own.shape[1], -1)
                for p in np.unique(phrase[rows]):
                    items[d].update(owners[p])
    none = np.empty((0, 2), np.int64)
    for d, n in enumerate(lengths):
        spans = np.flatnonzero(np.diff(np.r_[0, np.cumsum(hit[d])[:-1] > 0, 0])).reshape(-1, 2) if d in hit else none
        yield n, spans, sorted(items.get(d, ()))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sets of spans, as maximal spans."""
    out: list[list[int]] = []
    for s, e in sorted([*map(tuple, a), *map(tuple, b)]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return np.array(out, np.int64).reshape(-1, 2)


def cut(text: str, spans: np.ndarray) -> str:
    """The text without the words of the spans; a line break stands for each."""
    raw = text.encode("utf-8", "replace")
    words = [m.span() for m in WORD_BYTES.finditer(raw)]
    out, last = [], 0
    for s, e in spans:
        out += [raw[last : words[s][0]], b"\n"]
        last = words[e - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def blocks_of(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in lists of about most bytes; one list is on the driver at a time."""
    own, size = [], 0
    for r in benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        own.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= most:
            yield own
            own, size = [], 0
    yield own


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", block_bytes: int = 8 << 20, shard_words: int = 2_000_000) -> DataFrame:
    """Adds n_words, n_hit, spans (array of start and end word, merged), items (ids found, as strings, rising), contaminated, clean_text.

    A window is window consecutive words of an item; an item of fewer words, but not none, is one window. All words of all
    occurrences in a document are hit. clean_text has the hit words, and what stands between them, replaced by a line
    break. Null text has no words and stays null. Null or wordless items have no window; windows of items without
    an id hit words but name no item; repeated items count once. No documents or no items: no hits. Texts are whole, of any
    length. Other columns stay; one named like an added one is replaced.
    """
    spark = docs.sparkSession
    added = ("n_words", "n_hit", "spans", "items", "contaminated", "clean_text")
    out = docs.drop(*added)
    (probe,) = fresh(out, "probe_")
    kept = out.schema.fields
    out = out.withColumns({probe: F.col(text), "spans": F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"), "items": F.expr("cast(array() as array<string>)"), "n_words": F.lit(0).cast("long"), "clean_text": F.col(text)})
    schema = out.schema
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def search(shared, df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value, window)
            for batch in batches:
                texts = batch.column(probe).to_pylist()
                spans, items, n, clean = [], [], [], []
                old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                for t, (size, found, ids), (s, i) in zip(texts, scan(texts, phrases, shard_words), old, strict=True):
                    n.append(size)
                    more = merge(found, np.array([(x["start"], x["end"]) for x in s], np.int64).reshape(-1, 2)) if s else found
                    spans.append([{"start": int(a), "end": int(b)} for a, b in more])
                    clean.append(cut(t, more) if len(more) else t)
                    items.append(sorted({*ids, *i}))
                new = {"spans": pa.array(spans, pa.list_(span)), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(n, pa.int64()), "clean_text": pa.array(clean, pa.string())}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

        return df.mapInArrow(run, schema)

    for i, block in enumerate(blocks_of(benchmark, item, "text", block_bytes)):
        out = search(spark.sparkContext.broadcast(block), store(out, "passes") if i else out)  # a block has about block_bytes at most

    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(*[F.col(f"`{f.name}`") for f in kept], "n_words", n_hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"), "clean_text")
