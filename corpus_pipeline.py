"""The corpus pipeline: language, lines, near copies, benchmark, mix. Each stage's table is written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import decontaminate, language, lines, minhash, mixing
from stepweave.llm.common import WORD, store

#: Ids up to which a set of ids is sent to every executor; beyond that it is joined.
SENT_IDS = 1_000_000


#: Ids given to rows without one, beyond all others: equal texts have the same.
NAMELESS = 2**62


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], dict[str, str]]:
    """docs with all columns but doc_id and text under names of our own, what gives them their names back, and those names."""
    names = {c: c if c in ("doc_id", "text") else f"own_{i}_" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda out: out.select(*(F.col(n).alias(c) for c, n in names.items())), names


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found go on; those without a letter (und), or between two languages (ambiguous), go.

    Null and empty texts are und. Rows without an id are judged like others, but are not learned from. Equal texts fare alike. No rows: no rows.
    Columns keep their values, whatever their names.
    """
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    own, back, _ = _apart(docs)
    return back(language.identify(own, model).where("lang_pred <> 'und' and not ambiguous"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of similar lines stays; a document of which no word is left goes.

    Texts from which nothing is removed stay as they are, null and empty ones too. See dedup_lines for ids that are null or shared. n_chars, where
    there is one, is brought up to date. No rows: no rows.
    """
    own, back, names = _apart(docs)
    out = lines.dedup_lines(own)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    if chars := names.get("n_chars"):
        out = out.withColumn(chars, F.when(F.col("n_removed") > 0, F.length("text").cast(own.schema[chars].dataType)).otherwise(F.col(chars)))
    return back(out)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one of the smallest id: five-word shingles, similarity of 0.8 or more.

    Documents without a word have no copies. Rows without an id come after all others; of those with equal texts one stays. Of rows that share
    an id all stay if one is kept. No rows: no rows.
    """
    own, back, _ = _apart(docs)
    own = own.withColumn("key_", F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(NAMELESS - 1))))
    found = minhash.near_duplicates(own, key="key_")
    kept = found.where("kept").select(F.col("doc_id").alias("key_"))
    gone = store(found.where("not kept").select(F.col("doc_id").alias("key_")).join(kept, "key_", "left_anti").distinct(), "near-gone")
    left = own.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, "key_", "left_anti")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    once = left.where(F.col("doc_id").isNull() & worded).dropDuplicates(["text"])
    return back(left.where(F.col("doc_id").isNotNull() | ~worded).unionByName(once))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none. Each row is judged by its own text; no rows: no rows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own, back, _ = _apart(docs)
    return back(decontaminate.decontaminate(own, benchmark).where("not contaminated"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: its words times its whole epochs, and once more if drawn.

    Documents without a word, null texts too, give nothing and have no row. A null source is a source. Repeated rows are drawn each on
    their own; no rows: no rows.
    """
    mixed = mixing.mix(docs).where("taken > 0")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("mix", mix_stage),
]

#: Language identification and the line and document components are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
