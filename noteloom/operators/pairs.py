"""Joins on conditions that are no equality, where one side is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the side asked for up to which it is counted small and broadcast; beyond, it is dealt into blocks of as many.
SMALL = 10_000


def paired(rows: DataFrame, asked: DataFrame, condition: Column, small: int = SMALL) -> DataFrame:
    """rows with those of asked that a condition pairs them with. asked is broadcast if it is counted small; else its blocks are dealt to salted shares of
    rows, so that no task holds all of it, nor all that meets a block."""
    n = asked.count()
    if n <= small:
        return rows.join(F.broadcast(asked), condition)
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")
    blocks = -(-n // small)
    left = rows.withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(shares)).cast("int")).withColumn("_block", each(blocks))
    right = asked.withColumn("_block", deal(asked, blocks)).withColumn("_share", each(shares))
    met = left.join(right, ["_share", "_block"]).where(condition)
    return met.drop("_share", "_block")
