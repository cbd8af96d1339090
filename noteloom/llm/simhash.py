"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some 64-bit word lies within r bits of both. So every
fingerprint emits its ball of radius r = 2 (itself, 64 one-bit and 2016 two-bit variants), the variants are
shuffled, and fingerprints that meet on a variant are linked. A variant can be met by 2081 fingerprints at
most, whatever the number of documents, since equal fingerprints are one row.

Most fingerprints have no neighbour, so a first round of the same kind runs on parts of the word: of three
blocks of bits, some two together differ in at most 2 bits if all three differ in at most 4; each
fingerprint therefore emits the radius-1 variants of its three block pairs (132 keys). One that meets no other
fingerprint there has no partner, and emits nothing in the full round. The round loses no pair.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, components, free, ids_of, main_rows, only_ids, saved

SEED = 42
RADIUS = 4
_BLOCKS = (range(0, 22), range(22, 43), range(43, 64))


def fingerprint(text: bytes, shingle: int = 4, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: n - shingle + 1].tolist()
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i:i + 65536], ">u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp the fingerprint as a signed long. One row for each input row; null text is empty."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(t, shingle) for t in as_bytes(batch.column(1))]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(bits: list[int], radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(radius + 1) for c in combinations(bits, k)]


def _variants(masks: list[int]):
    return F.explode(F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseXOR(m)))


def neighbours(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp: every pair within RADIUS bits is connected by links,
    and every link joins fingerprints within RADIUS bits (b is the least of those that meet on a variant)."""
    keys = None
    for pair in combinations(range(3), 2):
        (rest,) = {0, 1, 2} - set(pair)
        bits = [b for p in pair for b in _BLOCKS[p]]
        mask = sum(1 << b for b in bits)
        tag = (rest + 1) << _BLOCKS[rest][0]
        part = fps.select("fp", _variants(_ball(bits, 1)).alias("key")).select(
            "fp", F.col("key").bitwiseAND(F.lit(_signed(mask))).bitwiseOR(F.lit(_signed(tag))).alias("key"))
        keys = part if keys is None else keys.union(part)
    met = Window.partitionBy("key")
    close = (
        keys.withColumn("lo", F.min("fp").over(met)).withColumn("hi", F.max("fp").over(met))
        .where("lo <> hi").select("fp").distinct()
    )
    balls = saved(close).select("fp", _variants(_ball(list(range(64)), RADIUS // 2)).alias("z"))
    return (
        balls.withColumn("b", F.min("fp").over(Window.partitionBy("z")))
        .where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Every row's fingerprint and component: (doc_id, fingerprint, component_id).

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over links of at most
    RADIUS differing bits, itself included. Null or empty texts have fingerprint zero and are linked like any
    other; repeated rows give repeated result rows; a null doc_id is linked but never the component's name
    unless all are null; an empty table gives no rows; other columns are ignored."""
    rows = saved(fingerprints(docs, id_col, text_col, shingle))
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(neighbours(distinct.select("fp")))
    named = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    linked = named.join(labels.select(F.col("label").alias("l2")).distinct(), named.label == F.col("l2"), "left_semi")
    groups = linked.groupBy("label").agg(F.min("least").alias("group_least"))
    by_fp = named.join(groups, "label", "left").select(
        F.col("fp").alias("key"), F.coalesce("group_least", "least").alias("component_id"))
    return rows.join(by_fp, rows.fp == by_fp.key).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedupe(docs: DataFrame) -> DataFrame:
    """docs with one document of each component left, the one of smallest doc_id (once, if its row is repeated). Rows without a
    doc_id stay; of rows that share a doc_id with different texts the one of least text hash is the document, and the others stay."""
    ids = ids_of(docs)
    (main,) = free(docs, "is_main")
    rows = main_rows(docs, ids.odd, main)
    own = rows.where(F.col(main)).drop(main)
    found = near_duplicates(own).where("doc_id is not null and doc_id = component_id")
    kept = only_ids(own.where("doc_id is not null"), saved(found.select("doc_id").distinct()))
    kept = (kept.dropDuplicates(["doc_id"]) if ids.again else kept).unionByName(docs.where("doc_id is null"))
    return kept if ids.odd is None else kept.unionByName(rows.where(~F.col(main) & F.col("doc_id").isNotNull()).drop(main))
