"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise part in linear time as half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, chunks, free, saved, tokens

BUCKETS = 1 << 15
RANK = 8
#: Labelled rows the model is fitted on at most (those of least hash of their id), and bytes of their features at most (in that order); the
#: one bound on what it learns from.
SAMPLE, SAMPLE_BYTES = 8192, 256 << 20
THRESHOLD = 0.3
STATS = 14
_EPOCHS, _BATCH, _RATE, _L2 = 25, 64, 0.1, 2e-5
_UPPER = np.zeros(256, bool); _UPPER[65:91] = True
_ALPHA = np.zeros(256, bool); _ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT = np.zeros(256, bool); _DIGIT[48:58] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its word buckets and their weights as (text number, bucket, x) sorted by text, and a row of
    STATS structure statistics, each about 0 to 1."""
    n = len(texts)
    which, starts, lengths, hashes = tokens(texts)
    key, count = np.unique((which.astype(np.int64) << 20) | (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    doc = key >> 20
    x = 1 + np.log(count)
    norm = np.sqrt(np.bincount(doc, x * x, n))
    x = x / np.maximum(norm[doc], 1e-9)

    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    at = np.r_[0, np.cumsum(sizes)[:-1]]
    share = lambda mask: np.add.reduceat(mask, at, dtype=np.int64) / sizes
    words = np.bincount(which, minlength=n)
    some = np.maximum(words, 1)
    per_word = lambda mask: np.bincount(which, mask, n) / some
    last, first = data[starts + lengths - 1], data[starts]
    symbol = ~(_ALPHA | _DIGIT | SPACE)
    stats = np.stack([
        share(_ALPHA[data]), share(_UPPER[data]), share(_DIGIT[data]), share(symbol[data]), share(SPACE[data]), share(data == 10) * 10,
        per_word(_UPPER[last]), per_word(symbol[last]), per_word(symbol[first]), per_word(_UPPER[first]), per_word(lengths) / 16,
        np.bincount(doc, minlength=n) / some, np.log1p(words) / 12, np.log1p(sizes) / 16,
    ], axis=1)
    return doc, key & (BUCKETS - 1), x, stats


@dataclass
class Machine:
    """bias, w and v by feature: the BUCKETS words, then the statistics, centred by mean and scaled by spread."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def _parts(self, n, doc, idx, x, stats):
        z = np.clip((stats - self.mean) / self.spread, -4, 4) / np.sqrt(STATS)
        ws, vs = self.w[BUCKETS:], self.v[BUCKETS:]
        s = z @ vs
        sq = (z * z) @ (vs * vs)
        linear = self.bias + z @ ws + np.bincount(doc, self.w[idx] * x, n)
        vx = self.v[idx] * x[:, None]
        for f in range(self.v.shape[1]):
            s[:, f] += np.bincount(doc, vx[:, f], n)
            sq[:, f] += np.bincount(doc, vx[:, f] ** 2, n)
        return z, s, linear + 0.5 * (s * s - sq).sum(axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, idx, x, stats = features(texts)
        logit = self._parts(len(texts), doc, idx, x, stats)[2]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rank: int = RANK, seed: int = 7) -> Machine:
    """A machine by AdaGrad on the log loss, from rows (buckets, x, statistics, label). Without rows every score is 0.5;
    with one label only, that label's share is the score's start."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATS
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank)), np.zeros(STATS), np.ones(STATS))
    if not rows:
        machine.v[:] = 0
        return machine
    stats = np.array([r[2] for r in rows])
    label = np.array([r[3] for r in rows], float)
    machine.mean, machine.spread = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    rate = np.clip(label.mean(), 0.01, 0.99)
    machine.bias = float(np.log(rate / (1 - rate)))
    gw, gv, gb = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    for _ in range(_EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), _BATCH):
            pick = order[lo:lo + _BATCH]
            n = len(pick)
            doc = np.repeat(np.arange(n), [len(rows[i][0]) for i in pick])
            idx = np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
            x = np.concatenate([rows[i][1] for i in pick]).astype(float)
            z, s, logit = machine._parts(n, doc, idx, x, stats[pick])
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[pick]) / n
            used, where = np.unique(idx, return_inverse=True)
            ex = err[doc] * x
            dw = np.bincount(where, ex, len(used)) + _L2 * machine.w[used]
            dv = np.stack([np.bincount(where, ex * (s[doc, f] - machine.v[idx, f] * x), len(used)) for f in range(rank)], axis=1)
            dv += _L2 * machine.v[used]
            every = np.r_[used, np.arange(BUCKETS, size)]
            vs = machine.v[BUCKETS:]
            dw = np.r_[dw, z.T @ err]
            dv = np.r_[dv, (z * err[:, None]).T @ s - ((z * z).T @ err)[:, None] * vs]
            gw[every] += dw * dw
            gv[every] += dv * dv
            machine.w[every] -= _RATE * dw / np.sqrt(gw[every])
            machine.v[every] -= _RATE * dv / np.sqrt(gv[every])
            gb += err.sum() ** 2
            machine.bias -= _RATE * err.sum() / np.sqrt(gb)
    return machine


def held_out(doc_id):
    """crc32(doc_id as text) mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from at most sample labelled documents that aren't held out. Of repeated labels of one id the highest
    counts, and of repeated documents that of least text hash."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("place", F.xxhash64("doc_id", F.lit("sample")))
        .orderBy("place", "doc_id").limit(sample)
    )

    def run(batches):
        for batch in batches:
            texts, label = as_bytes(batch.column(0)), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                doc, idx, x, stats = features(texts[a:b])
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array([idx[i:j].astype(np.uint16).tobytes() for i, j in zip(cut, cut[1:])]),
                    pa.array([x[i:j].astype(np.float32).tobytes() for i, j in zip(cut, cut[1:])]),
                    pa.array([r.astype(np.float64).tobytes() for r in stats]),
                    pa.array(label[a:b], pa.int32()), *[c[a:b] for c in batch.columns[2:]]], ["idx", "x", "stats", "label", "place", "id"])

    first = F.min_by(F.struct("text", "quality", "place"), F.xxhash64("text")).alias("r")
    made = saved(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(first)
        .select("r.text", F.col("r.quality").cast("int").alias("label"), F.col("r.place").alias("place"), F.col("doc_id").cast("string").alias("id"))
        .mapInArrow(run, "idx binary, x binary, stats binary, label int, place bigint, id string")
    )
    sizes = made.select("place", "id", (F.octet_length("idx") + F.octet_length("x") + F.octet_length("stats")).alias("size")).orderBy("place", "id").collect()
    fits, total = 0, 0
    while fits < len(sizes) and total + sizes[fits].size <= SAMPLE_BYTES:
        total += sizes[fits].size
        fits += 1
    got = made.orderBy("place", "id").limit(fits).collect() if fits else []
    rows = sorted((bytes(r[0]), bytes(r[1]), bytes(r[2]), r[3]) for r in got)
    return fit([(np.frombuffer(i, np.uint16), np.frombuffer(x, np.float32), np.frombuffer(s, np.float64), int(y > 0)) for i, x, s, y in rows])


def score(docs: DataFrame, machine: Machine, columns: list[str] | None = None, name: str = "_quality_score") -> DataFrame:
    """The named columns of docs (all, if none are named) and, as name (one that these don't have), the score of the whole text; null texts
    score as empty."""
    columns = columns or docs.columns
    model = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS * (RANK + 1) numbers, whatever the corpus
    wide = docs.select(*[docs[c] for c in columns], docs["text"].alias(name))
    schema = docs.select(*columns).schema.add(name, "double")

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(batch.num_columns - 1))
            got = [model.value.score(texts[a:b]) for a, b in chunks(texts)]
            values = pa.array(np.concatenate(got) if got else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], batch.schema.names)

    return wide.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Only texts are scored; labels, lang, source and doc_id are no inputs. Null or empty texts get the score of an empty
    text; repeated rows get equal rows; without labels every score is 0.5; an empty table gives no rows; other columns
    are ignored."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_quality_score").alias("score"),
                         (F.col("_quality_score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects."""
    (name,) = free(docs, "quality_score")
    return score(docs, train(docs, labels, sample), name=name).where(F.col(name) >= threshold).select(*docs.columns)
