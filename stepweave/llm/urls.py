"""URL filters by a sorted digest array.

The list (hosts and rules, any number of strings) becomes one file: 64-bit xxhash digests in rising order, the offsets of the
strings, then the strings themselves. The file lies in the shared folder, Spark hands one copy to each executor, and
the workers map it into memory, so all workers of a machine share its pages. A url is probed with every suffix of its host
(at label borders) and every prefix of its path whose length some rule has; all probes of a batch go through one
vectorised binary search, and a hit counts only if the stored string is the same.

A list beyond max_index_bytes is not handed out: the same probes are then joined with the list as a table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_dir

#: A rule: host, path prefix, verdict.
Rule = tuple[str, str, str]

#: Hosts (with all subdomains) that the filter blocks where no rule fits: fixed values.
BLOCKED_HOSTS = (
    "ads-track.example.com",
    "ads-track.example.net",
    "ads-track.example.org",
    "casino-win.example.com",
    "casino-win.example.net",
    "casino-win.example.org",
    "spam-farm.example.com",
    "spam-farm.example.net",
    "spam-farm.example.org",
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_index(entries: Iterable[str]) -> bytes:
    """The file: count, digests in order, offsets, strings."""
    raw = sorted({e.encode() for e in entries}, key=lambda b: (xxhash.xxh64_intdigest(b), b))
    digests = np.array([xxhash.xxh64_intdigest(b) for b in raw], "<u8")
    ends = np.cumsum([0, *map(len, raw)]).astype("<u8")
    return np.array([len(raw)], "<u8").tobytes() + digests.tobytes() + ends.tobytes() + b"".join(raw)


class DigestArray:
    """The mapped file."""

    def __init__(self, path: str):
        self.size = int(np.memmap(path, "<u8", "r", shape=1)[0])
        self.digests = np.memmap(path, "<u8", "r", offset=8, shape=self.size) if self.size else np.empty(0, "<u8")
        self.ends = np.memmap(path, "<u8", "r", offset=8 + 8 * self.size, shape=self.size + 1)
        start = 8 * (2 * self.size + 2)
        rest = os.path.getsize(path) - start
        self.strings = np.memmap(path, "u1", "r", offset=start, shape=rest) if rest else np.empty(0, "u1")

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The place of each probe in the list, or -1. Equal digests lie side by side and are all looked at."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, probes), "<u8", len(probes))
        at = np.searchsorted(self.digests, keys)
        out = np.full(len(probes), -1, "i8")
        live = np.flatnonzero((at < self.size) & (self.digests[np.minimum(at, max(self.size - 1, 0))] == keys)) if self.size else []
        for i in live:
            k = at[i]
            while k < self.size and self.digests[k] == keys[i]:
                if self.strings[self.ends[k] : self.ends[k + 1]].tobytes() == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out


def publish(spark: SparkSession, content: bytes) -> str:
    """Puts the file in the shared folder and lets Spark hand it to every executor; returns its name there."""
    name = f"urls-{uuid.uuid4().hex}.idx"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        for i in range(0, len(content), 1 << 20):
            out.write(bytearray(content[i : i + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def suffixes(host: str, longest: int) -> list[str]:
    """The host and what follows each of its dots, the longest first; none that is longer than longest, the longest host of the list."""
    return [host[i:] for i in range(max(0, len(host) - longest), len(host)) if i == 0 or host[i - 1] == "."]


def probes_of(host: str, path: str, lengths: Sequence[int], longest: int) -> list[str]:
    """Rule keys that could fit, and the host suffixes themselves (marked by a leading space)."""
    own = suffixes(host, longest)
    return [s + path[:n] for s in own for n in lengths if n <= len(path)] + [" " + s for s in own]


def filter_urls(pages: DataFrame, rules: Sequence[Rule], blocked: Sequence[str] = BLOCKED_HOSTS, url: str = "url", max_index_bytes: int = 256 << 20) -> DataFrame:
    """Adds host, path, rule (host and path of the rule that fits, else null), verdict (allow or block).

    A rule fits its host and all subdomains if the path starts with the rule's; of several the longest wins. Without
    one, a url is blocked if its host or a parent of it is in the list of blocked hosts. Null urls and urls without ://
    have an empty host and path, no rule, and are allowed. Repeated rows are judged alike; a url of any length is judged whole.
    Extra columns stay; one named like an added one is replaced. No rows: no rows.
    """
    entries = [h + p for h, p, _ in rules] + [" " + h for h in blocked]
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if sum(map(len, entries)) * 4 + 16 * len(entries) <= max_index_bytes:
        return _by_index(out, rules, entries)
    return _by_join(out, rules, entries)


def _by_index(out: DataFrame, rules: Sequence[Rule], entries: list[str]) -> DataFrame:
    spark = out.sparkSession
    content = build_index(entries)
    name = publish(spark, content)
    longest = max((len(e) for e in entries), default=0)
    lengths = sorted({len(p) for _, p, _ in rules})
    verdicts = {h + p: v for h, p, v in rules}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            probes = [probes_of(h, p, lengths, longest) for h, p in zip(hosts, paths, strict=True)]
            found = index.find([x.encode() for own in probes for x in own]) >= 0
            rule, verdict, i = [], [], 0
            for own in probes:
                hits = [x for x, f in zip(own, found[i : i + len(own)], strict=True) if f]
                i += len(own)
                fits = [x for x in hits if x[0] != " "]
                best = max(fits, key=lambda x: (len(x), x), default=None)
                rule.append(best)
                verdict.append(verdicts[best] if best else "block" if hits else "allow")
            keep = [c for c in batch.schema.names if c not in ("rule", "verdict")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*keep, "rule", "verdict"])

    kept = out.drop("rule", "verdict")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "rule string", "verdict string"])
    return kept.mapInArrow(judge, schema)


def _by_join(out: DataFrame, rules: Sequence[Rule], entries: list[str]) -> DataFrame:
    """The list as a table: for one that is too large to be handed to every executor."""
    spark = out.sparkSession
    row, probe = fresh(out, "row_", "probe_")
    lengths = sorted({len(p) for _, p, _ in rules})
    kept = out.drop("rule", "verdict").withColumn(row, F.struct("host", "path"))
    verdicts = {h + p: v for h, p, v in rules}
    table = spark.createDataFrame([(e, verdicts.get(e)) for e in sorted(set(entries))], "entry string, v string")
    labels = F.split("host", r"\.")
    most = max((e.count(".") + 1 for e in entries), default=1)
    own = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tries = F.flatten(F.transform(own, lambda s: F.concat(F.array(F.concat(F.lit(" "), s)), F.filter(F.array(*[F.when(F.length("path") >= n, F.concat(s, F.substring("path", 1, n))) for n in lengths]), lambda x: x.isNotNull()))))
    distinct = kept.select("host", "path").where("host <> ''").distinct()
    hits = distinct.withColumn(probe, F.explode(tries)).join(table, F.col(probe) == F.col("entry"))
    fits = F.when(F.col("v").isNotNull(), F.struct(F.length("entry").alias("n"), "entry", "v"))
    best = hits.groupBy("host", "path").agg(F.max(fits).alias("b"), F.max(F.col("v").isNull()).alias("listed"))
    joined = kept.drop(row).join(best, ["host", "path"], "left")
    verdict = F.coalesce(F.col("b.v"), F.when(F.col("listed"), "block"), F.lit("allow"))
    return joined.select(*[c for c in kept.columns if c != row], F.col("b.entry").alias("rule"), verdict.alias("verdict"))
