"""Search: chunking, keyword search, vector and hybrid search with one result for each document.

chunks: hash, path, chunk_index, text, embedding, ord. queries: qid, query, embedding. Results: qid, rank, path, content_excerpt, score,
match_type. Every limit is at most CAP.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType

from ..functions import text as T
from .pairs import paired

# Chunk size in words, least length of a chunk, the largest limit, and the weight of shared words.
CHUNK_WORDS, LEAST_CHARS, CAP, BOOST = 512, 20, 100, 0.3
#: Places of the default embedding.
EMBEDDING = 384
RESULT = ["qid", "rank", "path", "content_excerpt", "score", "match_type"]
#: Queries in a block and chunks in a part: one matrix product.
BLOCK, PART = 256, 20_000
#: Queries and chunks of a task of the vector search, and rows that it gives at a time.
ASKED, HELD, OUT = 20_000, 20_000, 10_000
#: What a matrix product's scores may be off: a vector's last bits depend on its place there, so the best are scored again, each by itself.
SLACK = 1e-9


def chunk(notes: DataFrame, path: str = "rel_path", text: str = "content", size: int = CHUNK_WORDS) -> DataFrame:
    """(hash, path, chunk_index, text): runs of size words without overlap, short ones left out; chunk_index counts words."""
    w = notes.select(F.col(path).alias("path"), T.words(text).alias("w")).where(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size)),
                      lambda i: F.struct(i.alias("i"), F.array_join(F.slice("w", i + 1, size), " ").alias("t")))
    rows = w.select("path", F.explode_outer(cut).alias("c")).select(
        T.chunk_id("path", "c.i").alias("hash"), "path", F.col("c.i").alias("chunk_index"), F.col("c.t").alias("text"))
    return rows.where(F.length(F.trim("text")) >= LEAST_CHARS)


def update_chunks(chunks: DataFrame, notes: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """chunks with those of notes (and of removed paths) replaced by new ones."""
    gone = notes.select(F.col("rel_path").alias("path"))
    if removed is not None:
        gone = gone.union(removed.select("path"))
    keep = chunks.select("hash", "path", "chunk_index", "text").join(gone.distinct(), "path", "left_anti")
    return keep.select("hash", "path", "chunk_index", "text").union(chunk(notes))


def hash_embed(df: DataFrame, text: str = "text", size: int = EMBEDDING) -> DataFrame:
    """df with embedding: signed counts of the text's lower-cased words over size hashed places, at length one (zero without words). It needs
    no model, and likens texts by the words they share; a model's vectors can take its place."""

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                v = np.zeros(size)
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    v[(h >> 1) % size] += 1 if h & 1 else -1
                rows.append((v / max(np.linalg.norm(v), 1e-9)).astype(np.float32))
            made = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * size, np.concatenate(rows) if rows else np.zeros(0, np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], out.names)

    own = [c for c in df.columns if c != "embedding"]
    out = df.select(*own).schema.add("embedding", ArrayType(FloatType()))
    return df.select(*own, F.col(text).alias("_embed")).mapInArrow(run, out)


def first_by(hits: DataFrame, order: list, limit: int) -> DataFrame:
    """The first hits of each query, ranked: a window limit, which cuts before the shuffle too."""
    w = Window.partitionBy("qid").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(limit, CAP)).select(*RESULT)


def keyword_chunks(chunks: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Chunks whose text holds the query, in chunk order (ord); a document can come more than once."""
    hits = paired(chunks, queries.select("qid", "query"), F.contains(F.lower("text"), F.lower("query"))).select(
        "qid", "path", F.substring("text", 1, 200).alias("content_excerpt"), F.lit(1.0).alias("score"), F.lit("keyword").alias("match_type"), "ord")
    return first_by(hits, ["ord"], limit)


def keyword_lines(notes: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """The first line of each note's raw text that holds the query."""
    lines = notes.select(F.col("rel_path").alias("path"), F.posexplode(F.split("raw", "\n")).alias("at", "line"))
    hits = paired(lines, queries.select("qid", "query"), F.contains(F.lower("line"), F.lower("query")))
    first = hits.groupBy("qid", "path").agg(F.min_by("line", "at").alias("line"))
    return first_by(first.select("qid", "path", F.substring("line", 1, 200).alias("content_excerpt"), F.lit(1.0).alias("score"), F.lit("keyword").alias("match_type")), ["path"], limit)


def best_by_path(scored: DataFrame, limit: int) -> DataFrame:
    """Of (qid, path, ord, score, ...) the best chunk of each path, then the best paths; ties in chunk order. The best of a path is an
    aggregate, so each task sends one row for each query and path."""
    best = F.min_by(F.struct("content_excerpt", "score", "match_type", "ord"), F.struct(-F.col("score"), F.col("ord"))).alias("r")
    one = scored.groupBy("qid", "path").agg(best).select("qid", "path", "r.*")
    return first_by(one, [F.col("score").desc(), "ord"], limit)


def _unit(column) -> np.ndarray:
    """Vectors at length one; a zero vector stays zero."""
    size = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(size) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(size)}")
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), *size or [0])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places from each first one on, as many as sizes say, one run after another."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Wanted:
    """The different words of queries, numbered; of the queries one after another, the words of each."""

    def __init__(self, asked: list[str | None]):
        sets = [set((q or "").lower().split()) for q in asked]
        self.number = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
        self.words = np.array([self.number[w] for q in sets for w in q], np.int64)
        self.ends = np.r_[0, np.cumsum([len(q) for q in sets], dtype=np.int64)]

    def held(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts that hold each word, a word's after another's, and where each word's begin; each text is split once."""
        found = [[self.number[w] for w in self.number.keys() & set(t.lower().split())] for t in texts]
        word = np.array([w for f in found for w in f], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        order = np.argsort(word, kind="stable")
        return text[order], np.searchsorted(word[order], np.arange(len(self.number) + 1))

    def shared(self, a: int, b: int, held: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """BOOST times the share of the different words of each query from a to b that each of n texts holds."""
        text, begins = held
        words, own = self.words[self.ends[a]:self.ends[b]], np.diff(self.ends[a:b + 1])
        sizes = begins[words + 1] - begins[words]
        cell = np.repeat(np.repeat(np.arange(b - a), own) * n, sizes) + text[_ragged(begins[words], sizes)]
        return np.bincount(cell, minlength=(b - a) * n).reshape(b - a, n) / np.maximum(own, 1)[:, None] * BOOST


def shared_words(asked: list[str | None], texts: list[str]) -> np.ndarray:
    """BOOST times the share of each query's different words that each text holds."""
    wanted = Wanted(asked)
    return wanted.shared(0, len(asked), wanted.held(texts), len(texts))


def _key(value):
    return tuple(value.values()) if isinstance(value, dict) else value


def _rank(values: list) -> np.ndarray:
    """Places of values (numbers, or structs as dicts) in their order."""
    out = np.zeros(len(values), np.int64)
    out[sorted(range(len(values)), key=lambda i: _key(values[i]))] = np.arange(len(values))
    return out


def _first_paths(score: np.ndarray, place: np.ndarray, path: np.ndarray, limit: int) -> np.ndarray:
    """The best chunk of each of the best paths (numbers), ties by place: of the highest scores first, of more if these have too few paths."""
    n, take = len(score), 4 * limit
    while True:
        some = np.arange(n) if take >= n else np.flatnonzero(score >= np.partition(score, n - take)[n - take])
        some = some[np.lexsort((place[some], -score[some]))]
        first = np.unique(path[some], return_index=True)[1]
        if len(first) >= limit or len(some) == n:
            return some[np.sort(first)[:limit]]
        take *= 8


class Best:
    """The best paths of each query of a task, over the chunks seen so far."""

    def __init__(self, queries: list[pa.RecordBatch], limit: int, hybrid: bool, block: int):
        table = pa.Table.from_batches(queries).combine_chunks()
        self.limit, self.block = limit, block
        self.qid, vectors = table.column("qid").to_pylist(), table.column("vector").combine_chunks()
        self.unit = _unit(vectors)
        self.wanted = Wanted(table.column("text").to_pylist()) if hybrid else None
        self.found: list[dict] = [{} for _ in self.qid]
        self.floor = np.full(len(self.qid), -np.inf)  # of the last of limit paths

    def see(self, chunks: pa.RecordBatch) -> None:
        unit, texts = _unit(chunks.column("vector")), [t or "" for t in chunks.column("text").to_pylist()]
        paths, ords = chunks.column("path").to_pylist(), chunks.column("ord").to_pylist()
        numbers: dict = {}
        place, path = _rank(ords), np.array([numbers.setdefault(p, len(numbers)) for p in paths])
        held = self.wanted.held(texts) if self.wanted else None
        for a in range(0, len(self.qid), self.block):
            b = min(a + self.block, len(self.qid))
            s = self.unit[a:b] @ unit.T
            extra = self.wanted.shared(a, b, held, len(texts)) if self.wanted else np.zeros_like(s)
            s = s + extra
            order = np.where(np.isnan(s), -np.inf, s)
            for i in np.flatnonzero((order >= self.floor[a:b, None] - SLACK).any(axis=1)):
                some = np.flatnonzero(order[i] >= self.floor[a + i] - SLACK)
                first = _first_paths(order[i, some], place[some], path[some], self.limit)
                if len(first) == self.limit:
                    some = some[order[i, some] >= order[i, some[first]].min() - SLACK]
                score = (unit[some] * self.unit[a + i]).sum(axis=1) + extra[i, some]
                key = np.where(np.isnan(score), -np.inf, score)
                for k in _first_paths(key, place[some], path[some], self.limit):
                    j = some[k]
                    t = texts[j]
                    row = (-key[k], _key(ords[j])), ords[j], t[:300] + "..." if len(t) > 300 else t, float(score[k]), "hybrid" if extra[i, j] > 0 else "semantic"
                    was = self.found[a + i].get(paths[j])
                    if was is None or row[0] < was[0]:
                        self.found[a + i][paths[j]] = row
                self._settle(a + i)

    def _settle(self, i: int) -> None:
        if len(self.found[i]) >= self.limit:
            best = sorted(self.found[i].items(), key=lambda x: x[1][0])[:self.limit]
            self.found[i], self.floor[i] = dict(best), -best[-1][1][0][0]

    def rows(self):
        for qid, found in zip(self.qid, self.found):
            for path, (_, ord_, text, score, kind) in found.items():
                yield qid, path, ord_, text, score, kind


def _best_of_task(limit: int, hybrid: bool, block: int, part: int, qid: pa.DataType, ord_: pa.DataType):
    kinds = [("qid", qid), ("path", pa.string()), ("ord", ord_), ("content_excerpt", pa.string()), ("score", pa.float64()), ("match_type", pa.string())]

    def run(batches):
        queries, best = [], None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            n = int(asks.sum())  # queries stand first
            if n:
                queries.append(batch.slice(0, n))
            if n < len(asks) and queries:
                best = best or Best(queries, limit, hybrid, block)
                for a in range(n, len(asks), part):
                    best.see(batch.slice(a, part))
        rows = list(best.rows()) if best else []
        for a in range(0, len(rows), OUT):
            cols = zip(*rows[a:a + OUT])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], [n for n, _ in kinds])

    return run


def vector(chunks: DataFrame, queries: DataFrame, limit: int = 5, hybrid: bool = False, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Every chunk scored by cosine against every query (exact search), with a boost for shared words if hybrid.

    Chunks and queries are dealt to tasks, HELD chunks and ASKED queries to one, or fewer chunks until every core has some. A task reads its
    queries, then its chunks one part after another, and scores a part against a block of queries in one matrix product; block and part bound its
    memory, not what is sent. A query's best paths are kept over all parts, so a task gives limit rows for each query. What is sent is a copy of the
    chunks for each ASKED queries, and of the queries for each HELD chunks."""
    rows = chunks.select("path", "ord", "text", F.col("embedding").alias("vector")).where("embedding is not null")
    asked = queries.select("qid", "query", F.col("embedding").alias("vector")).where("embedding is not null")
    kind, place = asked.schema["qid"].dataType, rows.schema["ord"].dataType
    n, groups = rows.count(), max(1, -(-asked.count() // ASKED))
    shares = max(1, -(-n // HELD), min(-(-n // part), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // groups)))
    deal = lambda k, *c: F.pmod(F.xxhash64(*c), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    nothing = lambda k: F.lit(None).cast(k)
    names = ["asks", "qid", "path", "ord", "text", "vector"]
    held = rows.select(F.lit(False).alias("asks"), nothing(kind).alias("qid"), "path", "ord", "text", "vector", deal(shares, "path", "ord").alias("share"), each(groups).alias("group"))
    wanted = asked.select(F.lit(True).alias("asks"), "qid", nothing("string").alias("path"), nothing(place).alias("ord"), F.col("query").alias("text"), "vector",
                          deal(groups, "qid").alias("group"), each(shares).alias("share"))
    met = held.unionByName(wanted).withColumn("task", F.col("share") * groups + F.col("group")).repartitionById(shares * groups, "task")
    scored = met.sortWithinPartitions(F.col("asks").desc()).select(*names).mapInArrow(
        _best_of_task(min(limit, CAP), hybrid, block, part, to_arrow_type(kind), to_arrow_type(place)),
        f"qid {kind.simpleString()}, path string, ord {place.simpleString()}, content_excerpt string, score double, match_type string")
    return best_by_path(scored, limit)


def in_wing(results: DataFrame, wings: DataFrame, limit: int = 5) -> DataFrame:
    """Filter after the limit: results whose path holds the query's wing and room (wings: qid, wing, room); where none does, all stay."""
    inside = lambda c: F.col(c).isNull() | F.contains("path", F.col(c))
    flagged = results.join(wings, "qid").withColumn("_in", inside("wing") & inside("room"))
    any_in = F.max("_in").over(Window.partitionBy("qid"))
    return flagged.withColumn("_any", any_in).where("_in or not _any").where(F.col("rank") <= limit).select(*RESULT)


def across(shared: DataFrame, personal: DataFrame, limit: int = 5) -> DataFrame:
    """Results of two vaults as one list by score, shared before personal on ties; personal match types are marked."""
    both = shared.withColumn("_v", F.lit(0)).union(
        personal.withColumn("match_type", F.concat(F.lit("personal:"), "match_type")).withColumn("_v", F.lit(1))).withColumnRenamed("rank", "_r")
    return first_by(both, [F.col("score").desc(), "_v", "_r"], limit)
