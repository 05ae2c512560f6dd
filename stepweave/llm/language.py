"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit a binary n-gram classifier (log odds of hashed byte n-grams, languages weighing
alike) tells the languages with a 1 from those with a 0. A text is decoded to the codeword of least loss; each classifier's loss
counts by how reliable it is for that language, which follows from the n-gram distributions themselves. If the
two best codewords are close, the answer is marked as ambiguous.

Counts are sums over sampled rows, added up in the executors; the driver gets tables whose size depends only on the
number of languages and of hash bins. Prediction is one pass over the table: no shuffle, whole texts, batch by batch.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BINS = 1 << 16
ORDERS = (2, 3, 4)
#: Odd multipliers of the n-gram hash.
MIX = np.uint32(2654435761)
LETTER = regex.compile(r"\p{L}")
#: Bytes below 128 that are no letters become spaces.
TABLE = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
SPACES = re.compile(rb" {2,}")


def grams(text: str) -> np.ndarray:
    """Bins of the hashed byte n-grams of the whole text, in lower case and without marks and digits."""
    raw = np.frombuffer(SPACES.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(TABLE) + b" "), np.uint8)
    parts = []
    code = raw.astype(np.uint32)
    for n in range(2, max(ORDERS) + 1):
        if len(raw) < n:
            break
        code = (code[:-1] << np.uint32(8)) | raw[n - 1 :]
        if n in ORDERS:
            parts.append(((code ^ np.uint32(n)) * MIX) >> np.uint32(16))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def codebook(n: int, seed: int = 5) -> np.ndarray:
    """Codewords (+1 or -1) of n languages: all splits for up to 6, else random splits far apart."""
    if n <= 6:
        splits = [[1, *s] for s in itertools.product((1, -1), repeat=n - 1) if -1 in s]
        return np.array(splits, np.float32).reshape(len(splits), n).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = [rng.permuted(np.tile(np.resize([1, -1], n)[:, None], bits), axis=0) for _ in range(50)]
    return max(tries, key=lambda m: min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # bins x bits, log odds of bit 1
    trust: np.ndarray  # languages x bits, rows sum to 1
    margin: float = 0.05

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether it is ambiguous; und for texts without a letter."""
        if text is None or not self.languages or not LETTER.search(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        own = grams(text)
        z = np.take(self.odds, own, axis=0).sum(axis=0, dtype=np.float64) / np.sqrt(len(own) + 16.0)
        loss = (np.logaddexp(0.0, -self.code * z) * self.trust).sum(axis=1)
        like = np.exp(-4.0 * (loss - loss.min()))
        like /= like.sum()
        order = np.argsort(-like, kind="stable")
        return self.languages[order[0]], float(like[order[0]]), bool(like[order[0]] - like[order[1]] < self.margin)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = 4_000) -> Model:
    """A model from at most about sample rows of each language (those with the smallest hash of their key).

    Rows with a null language or text teach nothing. The bound on the sample bounds the work; rows are chosen by hash, so
    the same rows are chosen every time. No rows: a model that answers und.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.empty((0, 0)), np.empty((BINS, 0)), np.empty((0, 0)))
    names = sorted(sizes)
    places = {x: i for i, x in enumerate(names)}
    chance = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, sample / sizes[n]))])
    draw = (F.xxhash64(F.lit(11), "k").bitwiseAND(F.lit(2**40 - 1)) / F.lit(float(2**40))).cast("double")
    taken = rows.where(draw < chance[F.col("l")]).drop("k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist(), strict=True):
                own = sums.setdefault(places[name], np.zeros(BINS, np.int64))
                np.add.at(own, grams(t), 1)
        for i, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([own[at].astype("<i8").tobytes()], pa.binary())], ["i", "at", "n"])

    seen = np.zeros((len(names), BINS))
    for r in taken.repartition(6).mapInArrow(count, "i int, at binary, n binary").toLocalIterator():
        seen[r["i"], np.frombuffer(r["at"], "<u4")] += np.frombuffer(r["n"], "<i8")
    return learn(names, seen)


def learn(names: list[str], seen: np.ndarray) -> Model:
    """seen: counts of languages x bins."""
    total = seen.sum(axis=1, keepdims=True)
    share = (seen + 0.5 * total / np.maximum(total, 1) ) / np.maximum(total + 0.5 * BINS, 1)
    share /= share.sum(axis=1, keepdims=True)
    if len(names) == 1:
        return Model(names, np.empty((1, 0)), np.empty((BINS, 0)), np.empty((1, 0)))
    code = codebook(len(names))
    ones, zeros = code > 0, code < 0
    odds = np.log((share.T @ (ones / ones.sum(axis=0))) / (share.T @ (zeros / zeros.sum(axis=0))))
    mean = share @ odds
    spread = np.sqrt(np.maximum(share @ odds**2 - mean**2, 1e-9))
    trust = 1.0 / (1.0 + np.exp(-2.0 * code * mean / spread))
    return Model(names, code, odds.astype(np.float32), trust / trust.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous. Only the text is looked at, all of it.

    Null text, and text without a letter: und, 0, false. Ties between languages go to the first by name. Repeated
    rows get the same answer; other columns stay, and one named like an added one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the bins and languages only
    (probe,) = fresh(docs, "probe_")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.decode(t) for t in batch.column(probe).to_pylist()]
            rest = [c for c in batch.schema.names if c != probe]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, "lang_pred", "score", "ambiguous"])

    kept = docs.drop("lang_pred", "score", "ambiguous")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "lang_pred string, score double, ambiguous boolean"])
    return kept.withColumn(probe, F.col(text)).mapInArrow(answer, schema)


def held_out(key: Column) -> Column:
    """Rows that teach nothing: the key's CRC-32 leaves 2 when divided by 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2
