"""Exact substring deduplication over suffix arrays and their common-prefix interval trees.

Anchors. Of the K-byte strings in every window of LENGTH bytes the one of least hash (the leftmost of equals) is the
window's anchor. Equal windows have their anchor at the same place, so a repeated window has a repeated anchor, and
only suffixes at repeated anchors, with the bytes before them that a window can reach, have to be compared.

Contexts. What a window can reach around an anchor is its context. Equal suffixes need one place in the array only: occurrences whose
whole context equals an earlier one's (by a 64-bit hash among the occurrences of one anchor; within a batch of rows already before the shuffle)
are one class, and the first of each class stands for it, if its anchor has several.

Suffix array. These suffixes are sorted by Spark within partitions by anchor: each partition is a (sparse) suffix array.
It is scanned with a stack over the common prefixes of neighbours, which gives the nodes of the interval tree:
all occurrences that share the next r bytes. Within a node, the left contexts are told apart in the same way
(from the anchor backwards): a class that shares l bytes is a maximal repeat of l + r bytes with all its occurrences, left- and
right-diverse. If it has LENGTH bytes or more, all but its first occurrence are removed. groups() returns these repeats.

The contexts of an anchor with more than GROUP different ones - a line or passage that stands in many surroundings - are dealt by what stands beside it: a window
with up to half of what it can reach before the anchor holds the bytes after it that any such window holds, and the others the bytes before it. So each
context goes to two tasks, with what windows of that half can hold, and meets those only that share these bytes. Of what is still over MOST different contexts,
windows are reduced to their first places by an aggregation over 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, BROADCAST_IDS, Ids, as_bytes, chunks, free, ids_of, later, main_rows, mix64, only_ids, powers, saved, shuffle_parts, stored

LENGTH = 100
K = 32
#: Different contexts of an anchor that are dealt by the anchor alone, and those that are compared in memory (about 200 bytes each).
GROUP, MOST = 1_000, 20_000
_PIECE = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
_BASE = np.uint64(BASE)
_BYTE = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on."""
    part, size, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, done, skip = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                shifted = part[done:] * skip if done else part
                out = shifted if out is None else out[: len(shifted)] + shifted[: len(out)]
                done += size
                skip = skip * power
            if 2 * size > k:
                return mix64(out[: len(data) - k + 1])
            part = part[:-size] + part[size:] * power
            power, size = power * power, 2 * size


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each run of window values."""
    size = 1
    while 2 * size <= window:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: len(values) - (window - size)], values[window - size:])


def anchors(texts: list[bytes], length: int = LENGTH, k: int = K) -> list[np.ndarray]:
    """Of the anchors of all windows of the texts: hash, hash of the context, text number, place, and the context's bytes
    before and from the anchor on. An anchor whose windows lie in two pieces of a long text counts in each."""
    out = [[np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4]]
    for number, text in enumerate(texts):
        if len(text) > _PIECE:
            step = _PIECE - length + 1  # each window lies in one piece
            for at in range(0, len(text) - length + 1, step):
                h, c, _, place, before, after = anchors([text[at:at + _PIECE]], length, k)
                out.append([h, c, np.full(len(h), number), place + at, before, after])
    some = [i for i, t in enumerate(texts) if length <= len(t) <= _PIECE]
    for a, b in chunks([texts[i] for i in some], _PIECE):
        own = some[a:b]
        sizes = np.array([len(texts[i]) for i in own])
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
        grams = _grams(data, k)
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (_least(key, length - k + 1) & _PLACE).astype(np.int64)
        valid = np.ones(len(place), bool)
        for end in (first + sizes)[:-1]:
            valid[end - length + 1:end] = False
        window = np.flatnonzero(valid)
        place = place[window]
        run = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        low, high, place = window[run], window[np.r_[run[1:] - 1, len(window) - 1]] + length, place[run]
        sums = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * powers(len(data)))]
        context = (sums[high] - sums[low]) * powers(len(data), pow(BASE, -1, 1 << 64))[low]
        context = mix64(context ^ ((place - low) << 8 | (high - low)).astype(np.uint64))
        which = np.searchsorted(first, place, side="right") - 1
        out.append([grams[place], context, np.array(own)[which], place - first[which], place - low, high - place])
    return [np.concatenate(x) for x in zip(*out)]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def intervals(strings: list[bytes]) -> list[tuple[int, int, int]]:
    """Nodes (common prefix, first, last) of the interval tree over sorted strings, inner nodes only."""
    nodes, stack = [], [(0, 0)]
    for i in range(1, len(strings) + 1):
        lcp = _common(strings[i - 1], strings[i]) if i < len(strings) else -1
        left = i - 1
        while stack and stack[-1][0] > lcp:
            depth, left = stack.pop()
            nodes.append((depth, left, i - 1))
        if lcp >= 0 and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, left))
    return nodes


def maximal(group: list[tuple], length: int) -> list[tuple[int, int, list[tuple]]]:
    """Of the suffixes at one anchor (right bytes, reversed left bytes, occurrence), sorted by right bytes, the maximal repeats of length bytes or
    more: (bytes before the anchor, bytes from it on, all occurrences)."""
    out = []
    for r, first, last in intervals([g[0] for g in group]):
        inside = sorted((g[1], g[2]) for g in group[first:last + 1] if len(g[1]) >= length - r)
        if len(inside) > 1:
            out += [(left, r, [o for _, o in inside[a:b + 1]]) for left, a, b in intervals([x[0] for x in inside]) if left + r >= length]
    return out


def repeats(group: list[tuple[bytes, bytes, tuple]], length: int) -> list[tuple[tuple, int, int]]:
    """Of the suffixes at one anchor those that occur in maximal repeats, but not first: (occurrence, bytes before, bytes from the anchor
    on); one row for each, since all its repeats hold the anchor."""
    widest: dict[tuple, tuple[int, int]] = {}
    for left, r, occurrences in maximal(group, length):
        start = min(occurrences)
        for o in occurrences:
            if o > start:
                x, y = widest.get(o, (0, 0))
                widest[o] = max(x, left), max(y, r)
    return [(o, a, b) for o, (a, b) in widest.items()]


def _halves(h: int, right: bytes, left: bytes, length: int) -> list[tuple[int, bytes, bytes]]:
    """What a context of a hot anchor is dealt by, and what of it windows can hold there: those that begin up to half of their reach before
    the anchor, and those that begin at half of it or earlier. A window of length bytes is in one of them."""
    half = (length - K) // 2
    out = []
    for side, shared, parts in ((b"R", right[:length - half], (right, left[:half])), (b"L", left[:half], (right[:length - half], left))):
        if len(shared) == (half if side == b"L" else length - half):
            out.append((xxhash.xxh64_intdigest(side + h.to_bytes(8, "little", signed=True) + shared) - (1 << 63), *parts))
    return out


def _scan(length: int, most: int):
    """Streams a partition sorted by anchor, right, left, doc and place; gives spans, and the contexts of groups with more than most as they are."""

    def run(batches):
        anchor, group, last, over = None, [], None, False
        spans, rest = [], []

        def close():
            if len(group) > 1:
                spans.extend((d, p - a, p + b) for (d, p), a, b in repeats(group, length))
            group.clear()

        def flush():
            rows = [(d, a, b, None) for d, a, b in spans] + rest
            spans.clear()
            rest.clear()
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["doc_id", "a", "b", "bytes"])

        for batch in batches:
            for h, d, p, right, left in zip(*(c.to_pylist() for c in batch.columns)):
                if h != anchor:
                    close()
                    anchor, last, over = h, None, False
                if last is not None and last[0] == right and last[1] == left:
                    if (d, p) != last[2] and len(left) + len(right) >= length:
                        spans.append((d, p - len(left), p + len(right)))
                    continue
                last = (right, left, (d, p))
                group.append(last)
                if over or len(group) > most:
                    over = True
                    rest += [(*o, len(y), y[::-1] + x) for x, y, o in group]
                    group.clear()
            if len(spans) + len(rest) > 20_000:
                yield flush()
        close()
        yield flush()

    return run


def _windows(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for d, p, left, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(xxhash.xxh3_128_digest(data[i:i + length]), d, p - left + i) for i in range(len(data) - length + 1)]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["w", "doc_id", "a"])

    return run


def _rows(docs: DataFrame, odd: DataFrame | None) -> DataFrame:
    """The documents: (doc_id, text) without nulls, one text to an id."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return main_rows(rows, odd).where("main").select("doc_id", "text")


def _occurrences(rows: DataFrame, length: int, settle: bool = True) -> DataFrame:
    """(h, c, doc_id, at, again): the anchors of all windows with their contexts, at as in removals(). If settle, what has an equal earlier in
    its batch is marked by again and dealt by its document, not by its anchor."""

    def find(batches):
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for i, j in chunks(texts):
                h, c, number, place, before, after = anchors(texts[i:j], length)
                parts.append((h, c, ids[i:j][number], place << 16 | before << 8 | after))
            if not parts:
                continue
            h, c, doc, at = (np.concatenate(x) for x in zip(*parts))
            if not len(h):
                continue
            again = later(h, c, doc, at) if settle else np.zeros(len(h), bool)
            h = np.where(again, mix64(doc.astype(np.uint64)), h)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(at), pa.array(again)], ["h", "c", "doc_id", "at", "again"])

    return rows.mapInArrow(find, "h bigint, c bigint, doc_id bigint, at bigint, again boolean")


def removals(docs: DataFrame, length: int = LENGTH, group: int = GROUP, ids: Ids | None = None, most: int = MOST) -> DataFrame:
    """(doc_id, text, cut, spans) of the documents that lose bytes: cut has whole contexts to remove, packed as place << 16 | bytes
    before << 8 | bytes from the place on; spans has further ones (a, b). They overlap as they come. ids: ids_of(docs)."""
    if not K <= length < 256:
        raise ValueError(f"length must be {K} to 255")
    ids = ids or ids_of(docs)
    rows = _rows(docs, ids.odd)
    same, anchor = Window.partitionBy("h", "c"), Window.partitionBy("h")
    found = _occurrences(rows, length).repartition(shuffle_parts(docs.sparkSession), "h")
    place = lambda c: F.when(~F.col("again"), F.col(c))
    first = ~F.col("again") & (F.struct("doc_id", "at") == F.min(F.when(~F.col("again"), F.struct("doc_id", "at"))).over(same))
    repeated = (
        found.withColumn("first", first).withColumn("lo", F.min(place("c")).over(anchor)).withColumn("hi", F.max(place("c")).over(anchor))
        .where("not first or lo <> hi")
        .withColumn("many", F.count_if("first").over(anchor) > group)
        .groupBy("doc_id").agg(F.collect_set(F.when(F.col("first"), F.struct("at", "h", "many"))).alias("ask"),
                               F.collect_set(F.when(~F.col("first"), F.col("at"))).alias("cut"))
    )
    repeated = stored(repeated)
    texts = only_ids(rows, saved(repeated.select("doc_id")))
    texts = stored(texts.dropDuplicates(["doc_id"]) if ids.again else texts)

    def around(batches):
        for batch in batches:
            for d, text, ask in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                out = []
                for x in ask:
                    p, before, after = x["at"] >> 16, x["at"] >> 8 & 255, x["at"] & 255
                    right, left = text[p:p + after], text[p - before:p][::-1]
                    out += [(h, p, r, l) for h, r, l in _halves(x["h"], right, left, length)] if x["many"] else [(x["h"], p, right, left)]
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([
                    pa.array(cols[0], pa.int64()), pa.array([d] * len(out), pa.int64()), pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["h", "doc_id", "p", "right", "left"])

    suffixes = (
        texts.join(repeated.where("size(ask) > 0"), "doc_id").select("doc_id", "text", "ask")
        .mapInArrow(around, "h bigint, doc_id bigint, p bigint, right binary, left binary")
        .repartition(shuffle_parts(docs.sparkSession), "h").sortWithinPartitions("h", "right", "left", "doc_id", "p")
    )
    decided = stored(suffixes.mapInArrow(_scan(length, most), "doc_id bigint, a bigint, b bigint, bytes binary"))
    direct = decided.where("bytes is null").select("doc_id", "a", "b")
    if decided.where("bytes is not null").limit(1).count():
        over = decided.where("bytes is not null").mapInArrow(_windows(length), "w binary, doc_id bigint, a bigint")
        first = over.groupBy("w").agg(F.min(F.struct("doc_id", "a")).alias("first")).withColumnRenamed("w", "w1")
        late = over.join(first, F.col("w") == F.col("w1")).where(F.struct("doc_id", "a") > F.col("first"))
        direct = direct.union(late.select("doc_id", "a", (F.col("a") + length).alias("b")))
    by_doc = direct.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return texts.join(repeated.select("doc_id", "cut"), "doc_id").join(by_doc, "doc_id", "left").where("size(cut) > 0 or spans is not null")


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cuts(docs: DataFrame, length: int = LENGTH, group: int = GROUP, with_text: bool = False, ids: Ids | None = None, most: int = MOST) -> DataFrame:
    """For the documents that lose bytes: (doc_id, n_removed, n_spans, kept_sha256, kept), kept (the remaining bytes) null unless
    asked for."""
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for d, text, cut, spans in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), *(c.to_pylist() for c in batch.columns[2:])):
                whole = [((x >> 16) - (x >> 8 & 255), (x >> 16) + (x & 255)) for x in cut]
                runs = merged(whole + [(x["a"], x["b"]) for x in spans or ()])
                edges = [0, *(e for r in runs for e in r), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edges[0::2], edges[1::2]))
                for col, v in zip(out, (d, len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    return removals(docs, length, group, ids, most).select("doc_id", "text", "cut", "spans").mapInArrow(
        run, "doc_id bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def dedupe_report(docs: DataFrame, length: int = LENGTH, group: int = GROUP, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte goes if a string of length bytes that covers it also starts earlier: in a document of smaller doc_id, or in the same one
    further ahead. Null and empty texts have no bytes; a null doc_id loses nothing and is no earlier copy; rows that share a doc_id and the text
    are repeats of one document and get equal rows; of rows that share a doc_id with different texts the one of least text hash is the
    document, and the others lose nothing and are no earlier copies; an empty table gives no rows; other columns are ignored."""
    ids = ids_of(docs)
    cut = cuts(docs, length, group, ids=ids, most=most).select(F.col("doc_id").alias("id"), "n_removed", "n_spans", F.col("kept_sha256").alias("sha"))
    text = F.coalesce("text", F.lit(""))
    whole = main_rows(docs.select("doc_id", "text"), ids.odd).select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"), "main")
    return whole.join(cut, (F.col("doc_id").cast("long") == cut.id) & F.col("main"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


def dedupe(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """docs with repeated bytes cut from text (bytes left of a cut character are dropped with it) and n_chars set anew;
    documents of which nothing is left go. Documents that lose nothing are unchanged. Rows that share a doc_id as in dedupe_report()."""
    ids = ids_of(docs)
    id_, new_text, main = free(docs, "cut_id", "cut_text", "is_main")
    cut = stored(cuts(docs, length, group, with_text=True, ids=ids)).select(F.col("doc_id").alias(id_), "kept")

    def decode(batches):
        for batch in batches:
            texts = [None if x is None else x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_, new_text])

    new = cut.mapInArrow(decode, f"`{id_}` bigint, `{new_text}` string").where(F.col(new_text) != "")
    lost = saved(cut.select(id_))
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost
    rows = main_rows(docs, ids.odd, main)
    here = (F.col("doc_id").cast("long") == F.col(id_)) & F.col(main)
    same = rows.join(lost, here, "left_anti").drop(main)
    changed = rows.drop("text").join(lost, here, "left_semi").join(new, here)
    return same.unionByName(changed.select(*[
        F.col(new_text).alias("text") if c == "text"
        else F.length(new_text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(c) for c in docs.columns]))


def groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The maximal repeats themselves: (anchor, number, n_bytes, doc_id, start), a row for every occurrence of every repeat of length
    bytes or more, as far as the windows around its anchor reach. The suffixes at one anchor are compared in one task here."""
    rows = _rows(docs, ids_of(docs).odd).dropDuplicates(["doc_id"])
    found = saved(_occurrences(rows, length, settle=False))
    often = found.groupBy("h").count().where("count > 1").select("h")
    asked = found.join(often, "h", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("at", "h")).alias("ask"))

    def around(batches):
        for batch in batches:
            for d, text, ask in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                spots = [(x["h"], x["at"] >> 16, x["at"] >> 8 & 255, x["at"] & 255) for x in ask]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in spots], pa.int64()), pa.array([d] * len(spots), pa.int64()), pa.array([x[1] for x in spots], pa.int64()),
                    pa.array([text[p:p + n] for _, p, _, n in spots], pa.binary()), pa.array([text[p - n:p][::-1] for _, p, n, _ in spots], pa.binary())],
                    ["h", "doc_id", "p", "right", "left"])

    def scan(batches):
        anchor, group = None, []

        def close():
            rows = [(anchor, k, left + r, d, p - left) for k, (left, r, occurrences) in enumerate(maximal(group, length)) for d, p in occurrences]
            group.clear()
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "number", "n_bytes", "doc_id", "start"])

        for batch in batches:
            for h, d, p, right, left in zip(*(c.to_pylist() for c in batch.columns)):
                if h != anchor and len(group) > 1:
                    yield close()
                if h != anchor:
                    group.clear()
                    anchor = h
                group.append((right, left, (d, p)))
        if len(group) > 1:
            yield close()

    suffixes = rows.join(asked, "doc_id").mapInArrow(
        around, "h bigint, doc_id bigint, p bigint, right binary, left binary").repartition("h").sortWithinPartitions("h", "right", "left", "doc_id", "p")
    return suffixes.mapInArrow(scan, "anchor bigint, number bigint, n_bytes bigint, doc_id bigint, start bigint")


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(hex(b[i + 1:i + 100])) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS i FROM d) x),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM w) y WHERE rn > 1),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r) z),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, e AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM s
  UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(hex(b[k.a + 1:coalesce(k.e, n)]), '' ORDER BY k.a) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
c AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN t.doc_id IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
