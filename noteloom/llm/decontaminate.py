"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Items are partitioned by size (powers of two of their distinct shingles). Each partition keeps, of an item, its
m smallest shingle hashes: a bottom-m MinHash sketch, with m one more than the shingles that any item of that
partition may miss at the containment threshold. A document that contains enough of the item therefore holds at
least one hash of the sketch, however long the document is, so the search loses nothing. Banded signatures of whole
documents can't do that: a test item of 30 shingles in a document of 3000 has a Jaccard similarity of 0.01.
Candidate pairs are verified by the exact share of the item's shingles, as strings, that the document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SHINGLE = 5
THRESHOLD = 0.8
#: Rows up to which a checked side is broadcast (16 to 40 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 400_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _with_hashes(df: DataFrame, k: int) -> DataFrame:
    """df (with words w) and hashes: one for each shingle; a shorter text is one shingle. The word hashes are a column of
    their own, so that the shingles read them instead of computing them anew for each place."""
    df = df.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    n, h = F.size("h"), F.col("h")
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return df.withColumn("hashes", F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.lit([]).cast("array<bigint>")))


def _with_strings(df: DataFrame, k: int) -> DataFrame:
    """df (with words w) and strings: its distinct shingles."""
    n, w = F.size("w"), F.col("w")
    many = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.concat_ws(" ", F.slice(w, i, k)))
    return df.withColumn("strings", F.array_distinct(
        F.when(n >= k, many).when(n > 0, F.array(F.concat_ws(" ", w))).otherwise(F.lit([]).cast("array<string>"))))


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, n_item_shingles, n_shared, containment): the document holds at least threshold
    of the item's distinct word shingles.

    Items of fewer words than a shingle are one shingle, and match documents of just those words. Items without
    words match nothing; null or empty documents have no pairs; an empty table on either side gives no rows. Repeated
    rows give one pair (of rows with one id and different texts, the best). Null ids take no part. Other columns are
    ignored."""
    spare = F.col("q") - F.ceil(F.col("q") * threshold - 1e-9)
    top = F.pow(F.lit(2), F.floor(F.log2("q")) + 1) - 1
    named = items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).distinct()
    tests = saved(
        _with_hashes(_with_strings(named, shingle), shingle)
        .select("item_id", "strings", F.array_sort(F.array_distinct("hashes")).alias("hashes"))
        .withColumn("q", F.size("strings")).where("q > 0")
        .withColumn("m", F.greatest(spare, top - F.ceil(top * threshold - 1e-9)).cast("int") + 1)
    )
    sketch = saved(tests.select(F.explode(F.slice("hashes", F.lit(1), F.col("m"))).alias("hash"), "item_id"))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    split = texts.select("doc_id", words(F.col("text")).alias("w"))
    # explode_outer: explode would add a filter on hashes, which pushed below its columns computes them for every shingle
    shingles = _with_hashes(split, shingle).select("doc_id", F.explode_outer("hashes").alias("hash"))
    candidates = saved(
        shingles.join(_maybe_broadcast(sketch, sketch.count()), "hash").select("doc_id", "item_id").distinct())
    ids = candidates.select("doc_id").distinct()
    found = texts.join(_maybe_broadcast(ids, ids.count()), "doc_id").select("doc_id", words(F.col("text")).alias("w"))
    held = (
        _with_strings(found, shingle).select("doc_id", F.col("strings").alias("own"))
        .join(candidates, "doc_id")
        .join(_maybe_broadcast(tests.select("item_id", "strings", "q"), 100 * tests.count()), "item_id")
        .select("doc_id", "item_id", F.col("q").cast("long").alias("n_item_shingles"),
                F.size(F.array_intersect("strings", "own")).cast("long").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
        .where(F.col("n_shared") >= F.ceil(F.col("n_item_shingles") * threshold - 1e-9))
    )
    best = F.max(F.struct("containment", "n_shared", "n_item_shingles")).alias("best")
    return held.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.n_item_shingles", "best.n_shared", "best.containment")


def clean(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows without a doc_id stay."""
    ids = saved(contaminated(docs, items, shingle, threshold).select("doc_id").distinct())
    return docs.join(_maybe_broadcast(ids, ids.count()), "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5
          THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5
          THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
q AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, any_value(q.n) AS n_item_shingles, count(*) AS n_shared,
       count(*) / any_value(q.n) AS containment
FROM ds JOIN bs ON ds.s = bs.s JOIN q ON q.id = bs.id
GROUP BY ds.id, bs.id HAVING count(*) >= ceil(any_value(q.n) * 0.8 - 1e-9)
"""
