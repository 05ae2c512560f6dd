"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame functions only.

A document's key is an exponential variate divided by its quality weight (Efraimidis and Spirakis): taking documents
by rising key is weighted sampling without replacement. A source first gets its whole epochs, then documents by
rising key until the rest of its budget is used up.

No source is ever sorted as a whole. The logarithms of the keys are dealt into bins of one width; sizes are summed by source
and bin, running sums over the bins of a source tell which bin the budget ends in, and only the rows of that bin are
put in order. Whatever the weights, the logarithm of an exponential variate has a density of at most 1/e, so a bin of
width d holds at most d/e of its source's rows: about PER_BIN, and for the largest sources NARROWEST/e of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, store

#: At most about so many documents of a source share a bin of keys, unless the bins would be narrower than NARROWEST.
PER_BIN, NARROWEST = 2_000, 0.002


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on nothing but the key and the seed; also to be had in plain SQL."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def text_weight(text: Column) -> Column:
    """Weight in [0.1, 1] that falls with the share of symbols in the text; 0.1 for none."""
    n = F.length(text)
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    return F.when(n > 0, F.greatest(F.lit(0.1), 1.0 - 5.0 * symbols / n)).otherwise(F.lit(0.1))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """From (source, source_size) to (source, source_size, target).

    Sources by code point, null last, take the weights in turn. share times all sizes is dealt by weight; a target
    stops at cap times its source's size and the excess is dealt again. That fixed point is min(cap * size, level * weight):
    with sources by rising cap * size / weight, the first k are full, and the level follows from running sums.
    The table has one row for each source.
    """
    n = len(weights)
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("turn", F.row_number().over(turn) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("turn") % n + 1).cast("int")))
    out = out.withColumn("most", F.col("source_size") * float(cap))
    rise = Window.orderBy(F.col("most") / F.col("weight"), F.col("turn"))
    before, after = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    out = out.withColumn("budget", F.sum("source_size").over(whole) * float(share))
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    out = out.withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    out = out.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    target = F.when(F.col("full") | F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return out.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, quality: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, weight for each row of docs (doc_id, text, source).

    taken is size times the whole epochs of the source, plus size for documents whose turn by key comes
    before the rest of the budget is used up; the document at the border is taken if that brings the sum nearer.
    Null text: size 0, taken 0. A null source is a source, the last. Repeated rows each count; equal keys are put in order by
    size and text, so a rerun takes the same. No rows: no rows. Extra columns are ignored. With quality (a column of docs)
    that weighs instead of the text's own weight; null or non-positive weighs least.
    """
    text = F.col("text")
    weight = text_weight(text) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-3))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long").alias("size"),
        weight.alias("weight"),
        F.xxhash64("text").alias("tie"),
    )
    rows = store(rows.withColumn("key", -F.ln(uniform(F.col("doc_id"), seed)) / F.col("weight")), "mix-rows")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(by_source.select("source", "source_size"), weights, share, cap)
    plan = plan.join(by_source.select(F.col("source").alias("s_"), "n"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = store(plan.withColumn("width", F.greatest(F.lit(NARROWEST), PER_BIN * math.e / F.col("n"))), "mix-plan")
    bin_of = F.floor(F.ln("key") / F.col("width"))
    by = lambda a, b: a["source"].eqNullSafe(b["source"])
    binned = rows.join(plan, by(rows, plan), "left").drop(plan["source"])
    binned = binned.withColumn("bin", bin_of)
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("end", F.sum("in_bin").over(upto)).withColumn("start", F.col("end") - F.col("in_bin"))
    # at most one bin of a source has the border inside
    border = sums.where((F.col("start") < F.col("rest")) & (F.col("end") > F.col("rest")))
    border = border.select(F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), F.col("start").alias("b_start"))
    full = sums.where(F.col("end") <= F.col("rest")).groupBy("source").agg(F.max("bin").alias("last"))
    full = full.select(F.col("source").alias("f_source"), "last")
    edge = plan.join(border, F.col("source").eqNullSafe(F.col("b_source")), "left").join(full, F.col("source").eqNullSafe(F.col("f_source")), "left")
    edge = store(edge.select("source", "source_size", "target", "epochs", "rest", "width", "b_bin", "b_start", F.coalesce("last", F.lit(-(2**62))).alias("last")), "mix-edge")
    out = rows.join(edge, by(rows, edge), "left").drop(edge["source"])
    out = out.withColumn("bin", bin_of)
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = out.where(F.col("bin") == F.col("b_bin"))
    inside = inside.withColumn("end", F.col("b_start") + F.sum("size").over(within))
    nearer = (F.col("end") - F.col("rest") <= F.col("rest") - (F.col("end") - F.col("size"))) & (F.col("end") - F.col("size") < F.col("rest"))
    inside = inside.withColumn("chosen", (F.col("end") <= F.col("rest")) | nearer).drop("end")
    others = out.where(F.col("b_bin").isNull() | (F.col("bin") != F.col("b_bin")))
    others = others.withColumn("chosen", F.col("bin") <= F.col("last"))
    taken = F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))
    return inside.unionByName(others).select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "weight")
