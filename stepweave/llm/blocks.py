"""Comparing the members of a bucket that belong to different parts, without all pairs of a bucket meeting in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block.
BLOCK = 256


def sides(members: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """From members (band, node, part, columns) two tables with band, block, block2 before these, to be matched on those three.

    Parts with a block's worth of members in a band are cut into blocks of their own, smaller ones share blocks. Two blocks of
    the same part never meet; any other two do, once, and a shared block also meets itself. So a bucket of one large part
    and a few strays costs its members times the blocks of strays, and no group has more than about two blocks of rows.
    """
    sizes = members.groupBy("band", "part").agg(F.count("*").alias("own"))
    mixed = sizes.groupBy("band").agg(F.sum(F.when(F.col("own") < BLOCK, F.col("own")).otherwise(0)).alias("mixed"))
    sized = members.join(sizes, ["band", "part"]).join(mixed, "band")
    big = F.col("own") >= BLOCK
    spot = F.xxhash64("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / BLOCK)))
    sized = sized.withColumn("block", F.when(big, spot).otherwise(F.pmod(F.xxhash64("part"), F.ceil(F.col("mixed") / BLOCK))))
    sized = sized.withColumn("of", F.when(big, F.col("part")))
    blocks = sized.groupBy("band", "block").agg(F.max("of").alias("of"))
    other = blocks.select("band", F.col("block").alias("block2"), F.col("of").alias("of2"))
    meet = (F.col("block") < F.col("block2")) & ~F.coalesce(F.col("of") == F.col("of2"), F.lit(False))
    duos = blocks.join(other, "band").where(meet | ((F.col("block") == F.col("block2")) & F.col("of").isNull()))
    duos = duos.select("band", "block", "block2")
    body = ["band", "block", "block2", "node", "part", *columns]
    left = sized.select("band", "block", "node", "part", *columns).join(duos, ["band", "block"]).select(*body)
    right = sized.select("band", F.col("block").alias("block2"), "node", "part", *columns).join(duos, ["band", "block2"]).select(*body)
    return left, right
