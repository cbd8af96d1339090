"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WORD, free, prefix_sums, saved

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Sources up to which their table is broadcast to the documents; beyond, the join is shuffled.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Of (source, size) rows, each source's size and target: share of all sizes split by weight, no target
    above cap times its source's size, the excess shared again by weight among the others. That fixed point
    is a water level: a source is full if its cap over its weight is at most the level of those not yet full. Sources are ordered and summed up
    in ranges, so there may be many."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one, last = F.lit(1).cast("long").alias("one"), F.col("source").isNull().alias("last")
    placed = prefix_sums(by.select("source", "source_size", one, last), [], ["last", "source"], {"one": "place"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    weighted = placed.withColumn("weight", weight).withColumn("ratio", F.col("source_size") * F.lit(cap) / F.col("weight"))
    summed = saved(prefix_sums(weighted.select("source", "source_size", "place", "weight", "ratio"), [], ["ratio", "place"], {"source_size": "sizes", "weight": "weights"}))
    size, weight = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    before, rest = F.col("sizes") - F.col("source_size"), F.lit(weight) - F.col("weights") + F.col("weight")
    level = summed.withColumn("level", (F.lit(float(size)) * F.lit(share) - before * F.lit(cap)) / rest).withColumn("open", F.col("ratio") > F.col("level"))
    # the level rises until the first open source and falls after it, so its highest open value is the fixed point
    final = F.lit(level.where("open").agg(F.max("level")).first()[0]).cast("double")
    full = F.col("source_size") * F.lit(cap)
    target = F.when(F.col("open"), F.col("weight") * final).otherwise(full)
    return level.select("source", "source_size", F.least(target, full).alias("target"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size) with rank: the place within the source by size and doc_id, from 1."""
    return prefix_sums(rows.withColumn("one", F.lit(1).cast("long")), ["source"], ["size", "doc_id"], {"one": "rank"})


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of docs.

    Within a source every document has the same expected copies (target over source size); summed up in order of size
    and doc_id and shifted by one random offset, each integer boundary crossed emits the document once. The order by
    size makes the words taken come near the target. size is the number of words, 0 for null or empty texts;
    sources of size 0 take nothing; null is a source of its own, the last; repeated rows are documents of their own; an
    empty table gives no rows; other columns are ignored. Reruns agree: the offset is a hash of seed and source."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = saved(rows)
    targets = saved(source_targets(rows, weights, share, cap))
    key = F.concat(F.lit(seed), F.when(F.col("source").isNull(), F.lit("|")).otherwise(F.concat(F.lit("="), "source")))
    targets = targets.select(
        F.col("source").alias("src"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("each"),
        (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("offset"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    copies = F.floor(F.col("offset") + F.col("rank") * F.col("each")) - F.floor(F.col("offset") + (F.col("rank") - 1) * F.col("each"))
    return (
        ranked(rows).join(targets, F.col("source").eqNullSafe(F.col("src")))
        .withColumn("copies", F.least(copies, F.lit(math.ceil(cap))).cast("long"))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit(docs: DataFrame, **kind) -> DataFrame:
    """The mixed documents: each row of docs as often as mix() takes it, with copy (copy_, if docs has a copy) numbered from 0. A doc_id that
    stands in several rows is told apart by text and source."""
    id_, size_, copies, turn, turn2, own_size, copy = free(docs, "mix_id", "mix_size", "mix_copies", "mix_turn", "mix_turn2", "mix_own", "copy")
    taken = saved(mix(docs, **kind).select(F.col("doc_id").alias(id_), F.col("size").alias(size_), F.col("copies").alias(copies)))
    rows, ids = taken.agg(F.count("*"), F.count_distinct(id_)).first()
    some = taken.where(F.col(copies) > 0)
    if rows == ids:
        some = some.select(id_, copies)
        both = docs.join(F.broadcast(some) if rows <= BROADCAST_IDS else some, F.col("doc_id") == F.col(id_))
    else:
        words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        some = some.withColumn(turn2, F.row_number().over(Window.partitionBy(id_, size_).orderBy(copies)))
        place = F.row_number().over(Window.partitionBy("doc_id", own_size).orderBy(F.col("source"), F.xxhash64("text")))
        both = docs.withColumn(own_size, words).withColumn(turn, place).join(
            some, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_size) == F.col(size_)) & (F.col(turn) == F.col(turn2)))
    repeat = F.explode(F.sequence(F.lit(0), (F.col(copies) - 1).cast("int"))).alias(copy)
    return both.select(*[docs[c] for c in docs.columns], repeat)


ORACLE = r"""
WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s),
w AS (SELECT *, CAST([3.0, 1.0, 2.0][CAST((place - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM p),
l AS (SELECT *, most / weight AS ratio,
        (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(source_size) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * CAST(2 AS DOUBLE))
        / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS final FROM l),
t AS (SELECT source, source_size, least(CASE WHEN ratio > level THEN weight * final ELSE most END, most) AS target,
        CAST(('0x' || substr(md5('mix-1' || CASE WHEN source IS NULL THEN '|' ELSE '=' || source END), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM f),
k AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
        row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.doc_id) AS rank
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(u + rank * e) - floor(u + (rank - 1) * e), 2) AS BIGINT) AS copies,
       CAST(least(floor(u + rank * e) - floor(u + (rank - 1) * e), 2) AS BIGINT) * size AS taken FROM k
"""
