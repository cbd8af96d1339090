"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of all word rules here: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage. A cluster names it in spark.checkpoint.dir; only where that
    is unset (local tests) a local one is made."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="noteloom-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def saved(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about limit bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit words (shift-xor-multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """The first n powers of an odd 64-bit base, modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
    return _POWERS[base][:n]


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random word for each byte at each of the first places of a word (tabulation hashing); longer words are hashed by XXH64.
_PLACES = 64
_TABLE = np.random.default_rng(64).integers(0, 1 << 64, _PLACES * 256, np.uint64)


def tokens(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: (text number, first byte, length) into the concatenation with a space after
    each text, and a 64-bit hash of each word's bytes (A-Z lower-cased if asked)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = LOWER[data]
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    lengths = ends - starts
    taken = np.minimum(lengths, _PLACES)
    first = np.r_[0, np.cumsum(taken)[:-1]]
    within = np.arange(int(taken.sum())) - np.repeat(first, taken)
    part = _TABLE[within << 8 | data[np.repeat(starts, taken) + within]]
    hashes = mix64(np.add.reduceat(part, first) ^ (lengths.astype(np.uint64) << np.uint64(56)))
    for i in np.flatnonzero(lengths > _PLACES):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(bounds, starts, side="right"), starts, lengths, hashes


def later(h: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows have the keys (h, c) of another row that stands earlier by doc and at."""
    order = np.lexsort((at, doc))
    order = order[np.argsort((h ^ (c << np.uint64(1)))[order], kind="stable")]
    a, b = order[1:], order[:-1]
    same = (h[a] == h[b]) & (c[a] == c[b])
    run = np.cumsum(np.r_[True, ~same]) - 1
    first = order[np.flatnonzero(np.r_[True, ~same])][run]
    out = np.zeros(len(h), bool)
    out[order] = (doc[order] != doc[first]) | (at[order] != at[first])
    return out


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b): rows (node, label), label the least node.

    Rounds of contraction: every node hooks onto its least smaller neighbour, trees are flattened by pointer jumping,
    and links are rewritten to the roots, until none is left. Each step is checkpointed; only counts reach the driver, and
    no join makes more rows than there are links. Loops and repeated links are harmless."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = saved(links.where("a is not null and b is not null and a <> b").select(a, b).distinct())
    labels = saved(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while edges.count():
        roots = edges.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("root"))
        while True:
            above = roots.select(F.col("at").alias("up"), F.col("root").alias("top"))
            stepped = saved(roots.join(above, roots.root == above.up, "left").select(
                "at", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
            roots = stepped.select("at", "root")
            if not stepped.where("moved").count():
                break
        labels = saved(labels.join(roots, labels.label == roots["at"], "left").select(
            "node", F.coalesce("root", "label").alias("label")))
        up = roots.select(F.col("at").alias("at2"), F.col("root").alias("root2"))
        moved = edges.join(roots, edges.a == roots["at"]).select(F.col("root").alias("a"), "b")
        moved = moved.join(up, moved.b == up.at2, "left").select("a", F.coalesce("root2", "b").alias("b"))
        edges = saved(moved.where("a <> b").select(a, b).distinct())
    return labels


#: Rows up to which a counted frame of ids is broadcast (about 16 bytes each); beyond, the join is shuffled.
BROADCAST_IDS = 400_000


def only_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of df whose key is in ids (distinct, already saved): by broadcast if ids is counted small."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add that df doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Ids(NamedTuple):
    """odd: (id, text_hash) of the doc_ids that stand with different texts, and the least hash of these; None if there are none. again: whether
    any doc_id stands in several rows."""

    odd: DataFrame | None
    again: bool


def ids_of(docs: DataFrame) -> Ids:
    h = F.xxhash64("text")
    by = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.min(h).alias("text_hash"), F.max(h).alias("most"), F.count("*").alias("n"))
    many = saved(by.where("n > 1"))
    again, odd = many.limit(1).count() > 0, many.where("text_hash <> most").select("id", "text_hash")
    return Ids(odd if again and odd.limit(1).count() else None, again)


def main_rows(rows: DataFrame, odd: DataFrame | None, name: str = "main") -> DataFrame:
    """rows (doc_id, text, ...) with a column that says whether a row is the document of its doc_id. Of rows with one id and different texts
    it is the one whose text has the least hash."""
    if odd is None:
        return rows.withColumn(name, F.lit(True))
    id_, least = free(rows.withColumn(name, F.lit(True)), "odd_id", "odd_hash")
    odd = odd.select(F.col("id").alias(id_), F.col("text_hash").alias(least))
    odd = F.broadcast(odd) if odd.count() <= BROADCAST_IDS else odd
    own = F.coalesce(F.xxhash64("text") == F.col(least), F.col(least).isNull())
    return rows.join(odd, F.col("doc_id").cast("long") == F.col(id_), "left").withColumn(name, own).drop(id_, least)


_STORED: list[tuple[SparkSession, str]] = []


@atexit.register
def remove_stored() -> None:
    """Deletes the tables that stored() has written; results that still read them can't be read again. Runs at exit as well."""
    while _STORED:
        spark, path = _STORED.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended
            return


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the shared checkpoint folder, and read from there."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df itself if it is read straight from files, so that two readings see the same rows in the same batches; else written once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df if "FileScan" in plan and "Exchange" not in plan else stored(df)


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with running sums (the row included) of columns within the rows of equal keys in the given order, nulls first.

    Rows are sorted into ranges, each range's sums by key are added up over the ranges, and each range is summed by itself:
    no task holds a key. Rows that are equal in keys and order should be interchangeable."""
    n = shuffle_parts(rows.sparkSession)
    dealt = saved(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    by = dealt.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = by.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                       *[F.coalesce(F.sum(f"_all_{c}").over(ahead), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = dealt.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in sums})
    return own.join(before, same).select(*rows.columns, *[(F.col(f"_b_{c}") + F.col(f"_i_{c}")).alias(out) for c, out in sums.items()])
