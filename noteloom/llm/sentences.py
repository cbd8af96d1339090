"""Substring deduplication over sliding spans of sentences.

Texts are cut into sentences: after words that end in a full stop, exclamation or question mark, and at line ends. Sentences of over LONG words -
texts without stops, or a passage that begins and ends inside a sentence - are cut further after about every CUT-th word, chosen by the
word's hash, and after a word said twice, so that equal passages are cut alike wherever they
stand. Every run of consecutive sentences - at least SPAN, with WORDS words or more - is hashed (128 bits over its
lower-cased words), and the hashes are grouped over the corpus. A sentence goes if a run that covers it also stands earlier: in a
document of smaller doc_id, or further ahead in the same one.

Only the shortest run from each sentence on and the shortest run up to each sentence are sent; they decide as all runs would: of a longer
repeated run, a sentence whose shortest run from it on doesn't fit is in the shortest run up to the last sentence, or else in the one from the run's start.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, BROADCAST_IDS, as_bytes, chunks, ids_of, later, main_rows, mix64, powers, saved, stored, tokens

SPAN, WORDS, LONG, CUT = 3, 8, 16, 8
_SECOND = 0xD1342543DE82EF95  # the other base of the run hashes
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


@dataclass
class Sentences:
    """Sentences of several texts: text number, first and end byte in it (they make up the text), first word and word after the
    last, and the hashes of all words."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    words: np.ndarray


def split(texts: list[bytes]) -> Sentences:
    """The sentences of the texts; a text without words has none."""
    which, starts, lengths, hashes = tokens(texts)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return Sentences(none, none, none, none, none, hashes)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lines = np.cumsum(data == 10)
    after = starts + lengths
    following = np.r_[starts[1:], len(data) - 1]
    real = _STOP[data[after - 1]] | (lines[following] > lines[after - 1]) | np.r_[which[1:] != which[:-1], True]
    last = np.flatnonzero(real) + 1
    size = np.diff(np.r_[0, last])
    inner = ((hashes >> np.uint64(20)) % np.uint64(CUT) == 0) | np.r_[False, hashes[1:] == hashes[:-1]]
    last = np.flatnonzero(real | (inner & np.repeat(size > LONG, size))) + 1
    first = np.r_[0, last[:-1]]
    text = which[first]
    offset = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    begins = np.r_[True, text[1:] != text[:-1]]
    start = np.where(begins, 0, starts[first] - offset[text])
    size = np.array([len(t) for t in texts])
    end = np.where(np.r_[begins[1:], True], size[text], np.r_[start[1:], 0])
    return Sentences(text, start, end, first, last, hashes)


def runs(s: Sentences, span: int = SPAN, least: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentence after the last, hash, second hash) of the shortest runs from and up to each sentence; each once."""
    n = len(s.first)
    each = np.arange(n)
    after = np.maximum(each + span, np.searchsorted(s.last, s.first + least) + 1)
    starts = np.minimum(each + 1 - span, np.searchsorted(s.first, s.last - least, side="right") - 1)
    i, after = np.r_[each, starts], np.r_[after, each + 1]
    fits = (i >= 0) & (after <= n)
    i, after = i[fits], after[fits]
    whole = s.text[i] == s.text[after - 1]
    i, after = np.divmod(np.unique(i[whole] * (n + 1) + after[whole]), n + 1)
    return i, after, *_hashes(s, i, after)


def _hashes(s: Sentences, i: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    a, b = s.first[i], s.last[after - 1] if len(i) else i
    out = []
    for base in (BASE, _SECOND):
        sums = np.r_[np.uint64(0), np.cumsum(s.words * powers(len(s.words), base))]
        out.append(mix64((sums[b] - sums[a]) * powers(len(s.words) + 1, pow(base, -1, 1 << 64))[a] + (b - a).astype(np.uint64)))
    return out


def covered(docs: DataFrame, span: int = SPAN, least: int = WORDS) -> DataFrame:
    """(doc_id, runs): the runs of a document that stand earlier as well, as (first sentence) * (most + 1) + (number of sentences), where
    most is the larger of span and least. docs: doc_id long and text.

    What has an equal earlier in its batch of rows is settled before the shuffle, and dealt by a key of its own; so a run
    has a row for each batch at most in the group that settles it."""
    code = max(span, least) + 1

    def run(batches):
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for a, b in chunks(texts):
                s = split(texts[a:b])
                i, after, h, g = runs(s, span, least)
                begin = np.searchsorted(s.text, np.arange(b - a))
                parts.append((h, g, ids[a:b][s.text[i]], (i - begin[s.text[i]]) * code + after - i))
            if not parts:
                continue
            h, g, doc, at = (np.concatenate(x) for x in zip(*parts))
            if len(h):
                again = later(h, g, doc, at)
                own = mix64(h ^ mix64(doc.astype(np.int64).view(np.uint64) * np.uint64(BASE) + at.astype(np.uint64)))
                h = np.where(again, own, h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(doc), pa.array(at), pa.array(again)], ["h", "g", "doc_id", "run", "again"])

    found = docs.mapInArrow(run, "h bigint, g bigint, doc_id bigint, run bigint, again boolean")
    # rows of one doc_id are repeats of one document
    late = found.withColumn("lo", F.min("doc_id").over(Window.partitionBy("h", "g"))).where("again or doc_id > lo")
    return late.groupBy("doc_id").agg(F.collect_set("run").alias("runs"))


def dropped(text: bytes, found, span: int = SPAN, least: int = WORDS) -> tuple[int, bytes]:
    """(sentences removed, bytes that remain) of a text without the given runs."""
    s = split([text])
    gone = np.zeros(len(s.first), bool)
    for one in found:
        at, n = divmod(one, max(span, least) + 1)
        gone[at:at + n] = True
    kept = b"".join(text[a:b] for a, b, x in zip(s.start.tolist(), s.end.tolist(), gone.tolist()) if not x)
    return int(gone.sum()), kept


def dedupe(docs: DataFrame, span: int = SPAN, least: int = WORDS) -> DataFrame:
    """(doc_id, n_removed, removed_bytes, kept_sha256, text) for every row of docs: sentences and bytes removed, and what remains.

    Null, empty and blank texts have no sentences and stay; a null doc_id loses nothing and is no earlier copy; rows that share a doc_id and the text
    are repeats of one document, and none of them is the other's earlier copy; of rows that share a doc_id with different texts the one of least
    text hash is the document, and the others lose nothing and are no earlier copies; an empty table gives no rows; other columns are ignored."""
    odd = ids_of(docs).odd
    every = main_rows(docs.select("doc_id", "text"), odd)
    rows = every.where("main and doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = stored(covered(rows, span, least)).withColumnRenamed("doc_id", "cut_id")
    ids = saved(cut.select("cut_id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    here = (F.col("doc_id").cast("long") == F.col("cut_id")) & F.col("main")
    both = every.join(ids, here, "left_semi").join(cut, here).select("doc_id", "text", "runs")
    rest = every.join(ids, here, "left_anti")
    none = F.lit(0).cast("long")
    whole = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rest = rest.select("doc_id", none.alias("n_removed"), none.alias("removed_bytes"), whole.alias("kept_sha256"), "text")

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, found in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                gone, kept = dropped(text, found, span, least)
                for col, v in zip(out, (gone, len(text) - len(kept), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], ["doc_id", "n_removed", "removed_bytes", "kept_sha256", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_removed bigint, removed_bytes bigint, kept_sha256 string, text string").union(rest)
