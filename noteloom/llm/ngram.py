"""Language-model scoring with an Elias-Fano n-gram trie of order three, in shards that follow the corpus.

The model is interpolated: a token's probability is what its context's successors keep of their mass, plus what they leave over times the
probability under the shorter context, down to the base (the unigrams). Level 1 of the trie holds the contexts of one word, with
monotone pointers to their successors; level 2 holds these successors relative to their context (made monotone by the context's number), with pointers to
the successors of the two words together; level 3 holds those. Pointers and successors are Elias-Fano coded; a node has its smoothed
probability and what its own successors leave over as 8-bit codes. A query goes down the levels: two pointers bound the successors of the
node it stands on, and the successor is searched between them, in the compressed sequence.

No process holds the whole model. Texts are taken in batches; a batch sends the paths of its distinct n-grams, with
their training counts, to shards by hash of the first word (every word is one, since something follows it). Each shard adds up the counts of all batches, builds its part of the trie,
writes it to a file, maps that and answers every batch from the map in the order it asked. A batch then sums up its tokens. Frequent first words are spread over SALTS
shards by their successor; so that no context holds over one in HOT of the tokens in one place, pairs of two frequent words are no contexts of the third level.

The whole model leaves no context out. A pair that is itself frequent is a context of its own beside the words, and its successors are spread like a frequent word's; all
other pairs stand at the third level. A batch asks every shard that holds successors of a spread context, and adds up what they count and leave over: the
context has the probabilities that one place would give it.
"""

from __future__ import annotations

import math
import mmap
import struct
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, mix64, saved, settled, shuffle_parts, tokens

END, START = np.uint64(0x454E44), np.uint64(0x5354415254)
SALTS = 16
#: A word is frequent if it is over one in HOT of the training tokens (so at most HOT words are).
HOT = 400
#: Training tokens to a shard, and bytes of text to a batch.
SHARD, BATCH = 1_000_000, 12 << 20
#: Bits of a successor's hash at the second and third level.
TAILS = (40, 32)
#: What is taken off each count at the second and third level (absolute discounting).
DISCOUNTS = (0.75, 0.8)
ABSENT = 255
_PATHS, _STATE = 0, 1

_U = np.uint64
_IN_BYTE = np.zeros((256, 8), np.uint8)  # the place of the k-th bit that is set in a byte
for _b in range(256):
    _places = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, :len(_places)] = _places


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th (from 0) bit that is set in each 64-bit word: counts by byte added up, then a table."""
    x = words - ((words >> _U(1)) & _U(0x5555555555555555))
    x = (x & _U(0x3333333333333333)) + ((x >> _U(2)) & _U(0x3333333333333333))
    x = ((x + (x >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _U(0x0101010101010101)
    byte = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) <= k[:, None]).sum(axis=1)
    shift = (8 * byte).astype(_U)
    before = ((x << _U(8)) >> shift & _U(255)).astype(np.int64)
    return 8 * byte + _IN_BYTE[(words >> shift & _U(255)).astype(np.int64), k - before]


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


class EliasFano:
    """A sorted sequence of unsigned integers: the low bits of each packed one after another, the high bits as unary gaps in words of 64 bits.
    Single values, and the place of a value, are read without decoding the rest."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, _U)
        self.n, top = len(values), int(values[-1]) if len(values) else 0
        self.width = min(max((top // max(self.n, 1)).bit_length() - 1, 0), 56)
        high = (values >> _U(self.width)).astype(np.int64)
        bits = np.zeros(-(-(self.n + (int(high[-1]) if self.n else 0) + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.low = np.frombuffer(self._packed(values & _U((1 << self.width) - 1)), np.uint8)
        self._index()

    def _packed(self, low: np.ndarray) -> bytes:
        """Values of width bits, eight of them in width bytes, and 8 bytes to read over."""
        lanes = np.zeros((-(-self.n // 8), 8), "<u8")
        lanes.ravel()[: self.n] = low
        out = np.zeros((len(lanes), self.width + 8), np.uint8)
        for k in range(8 if self.width else 0):
            at, shift = divmod(k * self.width, 8)
            out[:, at:at + 8] |= np.ascontiguousarray(lanes[:, k] << _U(shift)).view(np.uint8).reshape(-1, 8)
        return _pad(out[:, :self.width].tobytes() + bytes(8))

    def _index(self) -> None:
        """Ones before each word (a directory of one bit to a value), and the low bits as words at every byte."""
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.at = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        return self.at[bit >> 3] >> (bit & 7).astype(_U) & _U((1 << self.width) - 1)

    def _ones(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th ones."""
        w = np.searchsorted(self.before, i, side="right") - 1
        return 64 * w + _select_in_word(self.words[w], i - self.before[w])

    def _zeros(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th zeros."""
        before = 64 * np.arange(len(self.before)) - self.before
        w = np.searchsorted(before, i, side="right") - 1
        return 64 * w + _select_in_word(~self.words[w], i - before[w])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        return ((self._ones(i) - i).astype(_U) << _U(self.width)) | self._low(i) if len(i) else np.zeros(0, _U)

    def find(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place of each value between two places (first, and one after the last), -1 if it isn't there. The high bits give the few values
        that share them; the low bits are searched by halving."""
        out = np.full(len(values), -1, np.int64)
        high = values >> _U(self.width)
        some = np.flatnonzero((first < last) & (high < _U(64 * len(self.words) - self.n)))  # as many zeros as there are
        if not len(some):
            return out
        high, want = high[some].astype(np.int64), values[some] & _U((1 << self.width) - 1)
        lo = np.maximum(np.where(high > 0, self._zeros(np.maximum(high - 1, 0)) - high + 1, 0), first[some])
        end = np.minimum(self._zeros(high) - high, last[some])
        hi, open_ = end.copy(), np.flatnonzero(lo < end)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        there = np.flatnonzero(lo < end)
        hit = there[self._low(lo[there]) == want[there]]
        out[some[hit]] = lo[hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<qqqq", self.n, self.width, len(self.words), len(self.low)) + self.words.tobytes() + self.low.tobytes()

    @classmethod
    def from_buffer(cls, buf, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at a place of a buffer (bytes or a memory map, which is not copied), and its end."""
        new = cls.__new__(cls)
        new.n, new.width, words, low = struct.unpack_from("<qqqq", buf, at)
        new.words = np.frombuffer(buf, "<u8", words, at + 32)
        new.low = np.frombuffer(buf, np.uint8, low, at + 32 + 8 * words)
        new._index()
        return new, at + 32 + 8 * words + low


def weight(count: np.ndarray) -> np.ndarray:
    """The share of a frequent word's mass that its seen successors keep (their number isn't known in one place)."""
    count = np.asarray(count, float)
    return count / (count + 1.2 * count ** 0.93 + 8.0)


def code(share: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities: eighths of powers of two."""
    return np.clip(np.rint(-8 * np.log2(np.maximum(share, 1e-12))), 0, ABSENT - 1).astype(np.uint8)


def decode(codes: np.ndarray, absent: float) -> np.ndarray:
    return np.where(codes == ABSENT, absent, 2.0 ** (codes.astype(float) / -8.0))


@dataclass
class Trie:
    """contexts: sorted hashes of first words. counts: how often each was counted here. pointers, successors: by level, Elias-Fano. shares: by level, codes of what a node has of its
    context's mass. backs: codes of what the successors of first words and of second nodes leave over."""

    contexts: np.ndarray
    counts: np.ndarray
    pointers: tuple[EliasFano, EliasFano]
    successors: tuple[EliasFano, EliasFano]
    shares: tuple[np.ndarray, np.ndarray]
    backs: tuple[np.ndarray, np.ndarray]

    @classmethod
    def build(cls, contexts: np.ndarray, keys: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], frequent: dict[int, int] | None = None,
              pairs: np.ndarray | None = None) -> Trie:
        """keys: by level, sorted (number of the context << bits of a tail | tail), the context being a first word or a second node; counts: their
        occurrences, all over 0; frequent: counts of first words of which other shards hold successors as well; pairs: the contexts among the first words that are two words."""
        pointers, shares, backs, above, first = [], [], [], len(contexts), None
        for level, (key, count) in enumerate(zip(keys, counts)):
            number = (key >> _U(TAILS[level])).astype(np.int64)
            starts = np.searchsorted(number, np.arange(above + 1))
            total = np.bincount(number, count, above)
            first = total if first is None else first
            off = np.full(above, DISCOUNTS[level])
            if not level and pairs is not None:
                off[np.isin(contexts, pairs)] = DISCOUNTS[1]
            left, some = off * np.diff(starts) / np.maximum(total, 1), starts[1:] > starts[:-1]
            keep = np.maximum(count - off[number], 0) / np.maximum(total[number], 1)
            if not level:
                for i in np.flatnonzero(np.isin(contexts, np.array(sorted(frequent or {}), _U))):
                    n, some[i] = frequent[int(contexts[i])], True
                    left[i], keep[starts[i]:starts[i + 1]] = 1 - weight(n), weight(n) * count[starts[i]:starts[i + 1]] / n
            pointers.append(EliasFano(starts))
            shares.append(code(keep))
            backs.append(np.where(some, code(left), ABSENT).astype(np.uint8))
            above = len(key)
        return cls(contexts, first.astype(np.int64), tuple(pointers), tuple(map(EliasFano, keys)), tuple(shares), tuple(backs))

    def numbers(self, contexts: np.ndarray) -> np.ndarray:
        """The numbers of first words, -1 for those not there."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)

    def step(self, level: int, nodes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """From nodes (-1: none) to the ones of their successors, -1 where there is none: the pointers bound the search."""
        out, some = np.full(len(nodes), -1, np.int64), np.flatnonzero(nodes >= 0)
        node = nodes[some]
        first, last = (self.pointers[level].get(node + i).astype(np.int64) for i in (0, 1))
        out[some] = self.successors[level].find(node.astype(_U) << _U(TAILS[level]) | tails[some], first, last)
        return out

    def share(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return _pick(self.shares[level], nodes)

    def back(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return _pick(self.backs[level], nodes)

    def to_bytes(self) -> bytes:
        flat = [self.contexts, self.counts, *self.shares, *self.backs]
        return (struct.pack("<6q", *map(len, flat)) + b"".join(_pad(x.tobytes()) for x in flat)
                + b"".join(x.to_bytes() for x in (*self.pointers, *self.successors)))

    @classmethod
    def from_buffer(cls, buf) -> Trie:
        """A trie over to_bytes(), for instance of a memory-mapped file; its levels stay in the buffer."""
        at, flat, coded = 48, [], []
        for n, kind in zip(struct.unpack_from("<6q", buf, 0), ("<u8", "<i8", "u1", "u1", "u1", "u1")):
            flat.append(np.frombuffer(buf, kind, n, at))
            at += -(-flat[-1].nbytes // 8) * 8
        for _ in range(4):
            one, at = EliasFano.from_buffer(buf, at)
            coded.append(one)
        return cls(flat[0], flat[1], tuple(coded[:2]), tuple(coded[2:]), tuple(flat[2:4]), tuple(flat[4:]))


def _pick(codes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    out = np.full(len(nodes), ABSENT, np.uint8)
    some = nodes >= 0
    out[some] = codes[nodes[some]]
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<i", len(arrays)) + b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), a.nbytes) for a in arrays)
    planes = (a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays))  # alike bytes together
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def _unpack(blob) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(blob))
    (n,) = struct.unpack_from("<i", raw, 0)
    at, out = 4 + 10 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<2sq", raw, 4 + 10 * i)
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(int(kind[1:]), -1)
        out.append(np.ascontiguousarray(planes.T).view("<" + kind.decode()).ravel())
        at += size
    return out


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and each one's place among them; in less memory than numpy's own."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    values = ranked[new]
    del ranked
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return values, place


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else np.uint32)


def _sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts one after another, each text closed by END, and the tokens of each text."""
    parts = [(a, *tokens(texts[a:b])[::3]) for a, b in chunks(texts, 1 << 20)]  # small parts bound the memory of hashing
    which = np.concatenate([a + w for a, w, _ in parts]) if parts else np.zeros(0, np.int64)
    hashes = np.concatenate([h for *_, h in parts]) if parts else np.zeros(0, np.uint64)
    words = np.bincount(which, minlength=len(texts))
    out = np.full(len(hashes) + len(texts), END, np.uint64)
    out[np.arange(len(hashes)) + which] = hashes
    return out, words + 1


@dataclass
class Paths:
    """The distinct n-grams of a batch, each level in the order of the shards that hold them: of bigrams the first word, the second, the
    shard's first place; of trigrams the bigram (its place) and the third word. bigram, trigram: of each token, -1 for none.

    In the whole model first words are numbers of words or, after these, of frequent pairs; after: tokens behind a frequent pair, beside: the
    bigrams of pair and token; idle: (shard, first word) of spread contexts that the batch asks for without a bigram there."""

    lead: np.ndarray
    second: np.ndarray
    cut: np.ndarray
    under: np.ndarray
    third: np.ndarray
    bigram: np.ndarray
    trigram: np.ndarray
    after: np.ndarray | None = None
    beside: np.ndarray | None = None
    idle: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, at: np.ndarray, sizes: np.ndarray, start: int, home: np.ndarray, salt: np.ndarray, hot: np.ndarray, shards: int,
           spread: np.ndarray | None = None, pairs: np.ndarray | None = None) -> Paths:
        """at: word numbers of the tokens; start: the number of what stands before a text; home, salt and hot by word number. For the whole model,
        pairs: sorted, first word * words + second word of the frequent pairs; home and hot go on with these, and spread has the shards of each context."""
        n, first, whole = len(salt), np.r_[0, np.cumsum(sizes)[:-1]], pairs is not None
        before = np.r_[np.int32(start), at[:-1]]
        before[first] = start
        after, which = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if whole:
            inside = np.r_[False, np.ones(len(at) - 1, bool)]
            if len(pairs):
                key = before[:-1].astype(np.int64) * n + before[1:]
                which = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                inside[1:] = pairs[which] != key
                beyond = ~inside
                beyond[0] = beyond[first] = False
                after = np.flatnonzero(beyond)
                which = which[after - 1]
        else:
            inside = np.r_[False, ~(hot[before[:-1]] & hot[before[1:]])]  # what stands before isn't two frequent words
        inside[first] = False
        third = np.flatnonzero(inside).astype(np.int32)
        key = before.astype(np.int64) * n + at
        if len(after):
            key = np.r_[key, (n + which) * n + at[after]]
        del before, inside
        key, bigram = _numbered(key)
        lead, second = (x.astype(np.int32) for x in np.divmod(key, n))
        dealt = salt[second].astype(np.int32) % spread[lead] if whole else salt[second].astype(np.int32)
        where = ((home[lead] + np.where(hot[lead], 1 + dealt, 0)) % shards).astype(np.int32)
        order = np.argsort(where, kind="stable").astype(np.int32)
        place = np.empty_like(order)
        place[order] = np.arange(len(order), dtype=np.int32)
        lead, second, bigram, cut = lead[order], second[order], place[bigram], np.searchsorted(where[order], np.arange(shards + 1))
        idle = _idle(lead, where[order], home, hot, spread, shards) if whole else None
        del order, place, where
        bigram, beside = bigram[:len(at)], bigram[len(at):]
        key = bigram[third - 1].astype(np.int64) * n + at[third]
        key, found = _numbered(key)
        under, last = (x.astype(np.int32) for x in np.divmod(key, n))
        trigram = np.full(len(at), -1, np.int32)
        trigram[third] = found
        return cls(lead, second, cut, under, last, bigram, trigram, after, beside, idle)

    def leads(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words asked of a shard and how often each stands there one after another."""
        own = self.lead[self.cut[shard]:self.cut[shard + 1]]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        idle = self.idle[1][slice(*np.searchsorted(self.idle[0], [shard, shard + 1]))] if self.idle else np.zeros(0, np.int32)
        return np.r_[own[new], idle], np.r_[np.diff(np.r_[new, len(own)]), np.zeros(len(idle), np.int64)]


def _idle(lead: np.ndarray, where: np.ndarray, home: np.ndarray, hot: np.ndarray, spread: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, first word), in order, for the spread contexts of a batch: the shards that hold them and of which it asks no bigram."""
    n, spoken = len(home), hot[lead]
    of = np.unique(lead[spoken])
    each = np.repeat(of, spread[of])
    turn = np.concatenate([np.arange(k) for k in spread[of]]) if len(of) else np.zeros(0, np.int64)
    key = np.setdiff1d((home[each].astype(np.int64) + 1 + turn) % shards * n + each, where[spoken].astype(np.int64) * n + lead[spoken])
    return key // n, (key % n).astype(np.int32)


def _parts(home: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """The shards that hold any, and what each holds."""
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(shards + 1))
    return [(k, order[cut[k]:cut[k + 1]]) for k in range(shards) if cut[k] < cut[k + 1]]


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two words as a context."""
    return mix64(mix64(first + _U(0x9E3779B97F4A7C15)) + second)


def _often(seq: np.ndarray, sizes: np.ndarray, h: np.ndarray, c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of the pairs (START included) that are over one in most of a batch's tokens; both words are, too, so only these are numbered."""
    least = len(seq) / most
    words = np.unique(np.r_[h[c > least], START])
    at = np.minimum(np.searchsorted(words, seq), len(words) - 1)
    at[(words[at] != seq)] = -1
    before = np.r_[-1, at[:-1]]
    before[np.r_[0, np.cumsum(sizes)[:-1]]] = np.searchsorted(words, START)
    some = (at >= 0) & (before >= 0) & (seq != END)
    count = np.bincount(before[some] * len(words) + at[some])
    found = np.flatnonzero(count > least)
    return words[found // len(words)], words[found % len(words)], count[found]


def _train_words(shards: int, most: int = 0):
    """(dest, blob): hashes and counts of each batch's training tokens, by shard; and of the pairs over one in most of a batch's tokens."""

    def run(batches):
        for batch in batches:
            texts = [t for t, use in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()) if use]
            for a, b in chunks(texts, BATCH):
                seq, sizes = _sequence(texts[a:b])
                h, c = np.unique(seq, return_counts=True)
                parts = _parts((mix64(h) % _U(shards)).astype(np.int32), shards)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([_pack(h[p], _small(c[p])) for _, p in parts], pa.binary())], ["dest", "blob"])
                if most:
                    one, two, c = _often(seq, sizes, h, c, most)
                    parts = _parts((_pair(one, two) % _U(shards)).astype(np.int32), shards)
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([_pack(one[p], two[p], _small(c[p])) for _, p in parts], pa.binary())], ["dest", "blob"])

    return run


def _totals(key, table):
    """Of a shard's words: a row without h for their number and sum, and rows of the HOT + 1 largest; of its pairs, rows with h2 of the 2 * HOT + 1 largest."""
    blobs = [_unpack(x.as_py()) for x in table.column("blob")]
    asked, pairs = [x for x in blobs if len(x) == 2], [x for x in blobs if len(x) == 3]
    h, number = np.unique(np.concatenate([np.zeros(0, _U), *(x[0] for x in asked)]), return_inverse=True)
    c = np.bincount(number, np.concatenate([[], *(x[1] for x in asked)]), len(h)).astype(np.int64)
    top = np.argsort(-c, kind="stable")[: HOT + 1]
    two, number = np.unique(np.concatenate([np.zeros((0, 2), _U), *(np.c_[x[0], x[1]] for x in pairs)]), axis=0, return_inverse=True)
    many = np.bincount(number.ravel(), np.concatenate([[], *(x[2] for x in pairs)]), len(two)).astype(np.int64)
    often = np.argsort(-many, kind="stable")[: 2 * HOT + 1]
    one, two = two[often].view(np.int64).T.tolist() if len(two) else ([], [])
    return pa.Table.from_arrays([
        pa.array([None, *h[top].view(np.int64).tolist(), *one], pa.int64()), pa.array([int(c.sum()), *c[top].tolist(), *many[often].tolist()], pa.int64()),
        pa.array([len(h)] + [0] * (len(top) + len(often)), pa.int64()), pa.array([None] * (1 + len(top)) + two, pa.int64())], ["h", "c", "n", "h2"])


def _vocabulary(texts: list[bytes], shards: int, hot_words: np.ndarray):
    """(tokens as word numbers, tokens by text, words, home, salt, hot, number of START); frequent words have small numbers, which pack well."""
    seq, sizes = _sequence(texts)
    vocab, at = _numbered(np.r_[seq, START, END])
    del seq
    common = np.argsort(-np.bincount(at), kind="stable")
    place = np.empty(len(common), np.int32)
    place[common] = np.arange(len(common), dtype=np.int32)
    vocab, at = vocab[common], place[at]
    return at[:-2], sizes, vocab, (mix64(vocab) % _U(shards)).astype(np.int32), (vocab % _U(SALTS)).astype(np.uint8), np.isin(vocab, hot_words), int(at[-2])


@dataclass
class Whole:
    """What the whole model spreads: of frequent words (and START) and of frequent pairs, over how many shards."""

    words: dict[int, int]
    pairs: dict[tuple[int, int], int]

    def hashes(self) -> np.ndarray:
        return _pair(*np.array(list(self.pairs), _U).reshape(-1, 2).T)

    def contexts(self, vocab: np.ndarray, home: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
        """(vocab, home, hot, spread, salt of the words, pairs) of a batch: vocab, home, hot and spread go on with the frequent pairs of its words."""
        n, number = len(vocab), {}
        if self.pairs:
            for i in np.flatnonzero(np.isin(vocab, np.array(list(self.pairs), _U).ravel())):
                number[int(vocab[i])] = int(i)
        found = sorted((number[a] * n + number[b], k, a, b) for (a, b), k in self.pairs.items() if a in number and b in number)
        own = _pair(*np.array([x[2:] for x in found], _U).reshape(-1, 2).T)
        spread = np.ones(n + len(found), np.int32)
        spread[np.flatnonzero(hot)] = [self.words[int(h)] for h in vocab[hot]]
        spread[n:] = [x[1] for x in found]
        return (np.r_[vocab, own], np.r_[home, (mix64(own) % _U(shards)).astype(np.int32)], np.r_[hot, np.ones(len(found), bool)], spread,
                (vocab >> _U(8)).astype(np.uint16), np.array([x[0] for x in found], np.int64))


_NAMES = ["kind", "dest", "batch", "blob", "ids"]


def _rows(kind, dest, batch, blobs, id_lists, ids: pa.DataType):
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(blobs), kind, np.int32)), pa.array(dest, pa.int32()), pa.array(np.full(len(blobs), batch, np.int64)),
        pa.array(blobs, pa.binary()), pa.array(id_lists, pa.list_(ids))], _NAMES)


def _ask(shards: int, hot: dict, ids: pa.DataType, states: bool, whole: Whole | None = None):
    """The rows of each batch: its state for itself, or what it asks of the shards. Both calls see the same batches."""
    hot_words = np.array(sorted(hot), np.uint64)

    def run(batches):
        number = 0
        for batch in batches:
            texts, train = as_bytes(batch.column(1)), np.array(batch.column(2).to_pylist(), bool)
            for a, b in chunks(texts, BATCH):
                number += 1
                name = (batch.column(3)[0].as_py() << 32) + number
                at, sizes, vocab, home, salt, is_hot, start = _vocabulary(texts[a:b], shards, hot_words)
                often, more = np.array([hot[int(h)] for h in vocab[is_hot]], np.int64), ()
                if whole:
                    vocab, home, is_hot, spread, salt, pairs = whole.contexts(vocab, home, is_hot, shards)
                    more = spread, pairs
                if states:
                    yield _rows(_STATE, [0], name, [_pack(at.astype(np.uint32), sizes.astype(np.uint32), home, salt, is_hot.astype(np.uint8), np.array([start], np.int64), train[a:b].astype(np.uint8), often, *more)],
                                [batch.column(0)[a:b].to_pylist()], ids)
                    continue
                used = np.repeat(train[a:b], sizes)
                p = Paths.of(at, sizes, start, home, salt, is_hot, shards, *more)
                two = np.bincount(p.bigram[used], minlength=len(p.lead))
                if whole:
                    two += np.bincount(p.beside[used[p.after]], minlength=len(p.lead))
                three = np.bincount(p.trigram[used & (p.trigram >= 0)], minlength=len(p.under))
                many = np.bincount(p.under, minlength=len(p.lead))
                p.bigram = p.trigram = None
                del at, used
                deep, some, blobs = np.r_[0, np.cumsum(many)], [], []
                for k in range(shards):
                    i, j = p.cut[k], p.cut[k + 1]
                    lead, runs = p.leads(k)
                    if len(lead):
                        tail = vocab[p.second[i:j]] >> _U(64 - TAILS[0])
                        x, y = deep[i], deep[j]
                        some.append(k)
                        blobs.append(_pack(vocab[lead], _small(runs), tail.astype(np.uint32), (tail >> _U(32)).astype(np.uint8), _small(two[i:j]),
                                           _small(many[i:j]), (vocab[p.third[x:y]] >> _U(64 - TAILS[1])).astype(np.uint32), _small(three[x:y])))
                yield _rows(_PATHS, some, name, blobs, [None] * len(some), ids)

    return run


def _merged(asked: list[list[np.ndarray]], hot: dict | None, pairs: np.ndarray | None = None) -> tuple[Trie, tuple[np.ndarray, ...]]:
    """The trie of what all batches ask of a shard, from their training counts; and what they ask: (first words, of the bigrams the first
    word asked, tail, the bigram of each trigram, tail)."""
    leads, runs = np.concatenate([x[0] for x in asked]), np.concatenate([x[1].astype(np.int64) for x in asked])
    of = np.repeat(np.arange(len(leads)), runs)
    tails = np.concatenate([x[2].astype(_U) | x[3].astype(_U) << _U(32) for x in asked])
    under = np.repeat(np.arange(len(of)), np.concatenate([x[5].astype(np.int64) for x in asked]))
    last = np.concatenate([x[6] for x in asked]).astype(_U)
    contexts, number = np.unique(leads, return_inverse=True)
    keys, two = np.unique(number[of].astype(_U) << _U(TAILS[0]) | tails, return_inverse=True)
    count = np.bincount(two, np.concatenate([x[4] for x in asked]).astype(float), len(keys))
    seen = np.flatnonzero(count > 0)
    place = np.full(len(keys), -1)
    place[seen] = np.arange(len(seen))
    node = place[two][under]
    many = np.concatenate([x[7] for x in asked]).astype(float)
    some = np.flatnonzero((node >= 0) & (many > 0))
    deep, three = np.unique(node[some].astype(_U) << _U(TAILS[1]) | last[some], return_inverse=True)
    trie = Trie.build(contexts, (keys[seen], deep), (count[seen], np.bincount(three, many[some], len(deep))), hot, pairs)
    return trie, (leads, of, tails, under, last)


def _mapped(trie: Trie) -> tuple[Trie, mmap.mmap]:
    """The trie out of a memory-mapped file (without a name, gone when it is closed)."""
    with tempfile.TemporaryFile() as f:
        f.write(trie.to_bytes())
        f.flush()
        held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return Trie.from_buffer(held), held


def _answer(hot: dict | None, pairs: np.ndarray | None = None):
    """A shard's answers: counts of the first words, and codes along the paths, in the order each batch asked."""

    def run(key, table):
        asked = [_unpack(x.as_py()) for x in table.column("blob")]
        trie, (leads, of, tails, under, last) = _merged(asked, hot, pairs)
        cuts = [np.r_[0, np.cumsum([len(x[i]) for x in asked])] for i in (0, 2, 6)]
        del asked
        trie, held = _mapped(trie)
        first = trie.numbers(leads)
        second = trie.step(0, first[of], tails)
        third = trie.step(1, second[under], last)
        count = trie.counts[first]
        codes = (count.astype(np.uint32) if not len(count) or count.max() < 1 << 32 else count,
                 trie.back(0, first), trie.share(0, second), trie.back(1, second), trie.share(1, third))
        del trie
        blobs = [_pack(*[c[cut[i]:cut[i + 1]] for c, cut in zip(codes, (cuts[0], cuts[0], cuts[1], cuts[1], cuts[2]))]) for i in range(len(cuts[0]) - 1)]
        return table.set_column(table.schema.get_field_index("blob"), "blob", pa.array(blobs, pa.binary()))

    return run


def _finish(shards: int, total: int, distinct: int, hot: dict, schema: pa.Schema):
    def run(key, table):
        blobs, ids = table.column("blob"), table.column("ids")
        got = {(-1 if k == _STATE else d): i for i, (k, d) in enumerate(zip(table.column("kind").to_pylist(), table.column("dest").to_pylist()))}
        state = got[-1]
        at, sizes, home, salt, is_hot, start, train, often, *more = _unpack(blobs[state].as_py())
        at, sizes, start, is_hot = at.astype(np.int32), sizes.astype(np.int64), int(start[0]), is_hot.astype(bool)
        p = Paths.of(at, sizes, start, home, salt, is_hot, shards, *more)
        leads = [p.leads(k) for k in range(shards)]
        some = [k for k in range(shards) if len(leads[k][0])]
        answers, leads = [_unpack(blobs[got[k]].as_py()) for k in some], [leads[k] for k in some]
        count = np.zeros(len(home), np.int64)
        for a, (words, _) in zip(answers, leads):
            count[words] += a[0].astype(np.int64)
        if more:  # what the shards of a context leave over, by how often each counted it
            left = sum(np.bincount(words, decode(a[1], 1.0) * a[0], len(home)) for a, (words, _) in zip(answers, leads))
            left = np.where(count > 0, left / np.maximum(count, 1), 1.0)
            part = np.concatenate([np.repeat(a[0] / np.maximum(count[words], 1), runs) for a, (words, runs) in zip(answers, leads)])
        else:
            count[np.flatnonzero(is_hot)] = often
        end = int(at[-1])  # what closes a text; as many as begin
        count[end] = hot.get(int(END), count[start])
        count[start] = 0
        base = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
        share, deeper, last = (np.concatenate([a[i] for a in answers]) for i in (2, 3, 4))
        share = decode(share, 0.0) * part if more else decode(share, 0.0)
        back = left[p.lead] if more else decode(np.concatenate([np.repeat(a[1], runs) for a, (_, runs) in zip(answers, leads)]), 1.0)
        two = share + back * 10 ** base[p.second]
        full, some = two[p.bigram], np.flatnonzero(p.trigram >= 0)
        found = p.trigram[some]
        full[some] = decode(last, 0.0)[found] + decode(deeper, 1.0)[p.under[found]] * full[some]
        if more:
            full[p.after] = share[p.beside] + back[p.beside] * full[p.after]
        full = np.log10(full)
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        n = len(sizes)
        return pa.Table.from_arrays([
            ids[state].values.cast(schema.field(0).type), pa.array(train == 0), pa.array(sizes), pa.array(np.add.reduceat((count[at] > 0).astype(np.int64), first)),
            pa.array(np.full(n, total, np.int64)), pa.array(np.add.reduceat(base[at], first)), pa.array(np.add.reduceat(full, first))], schema=schema)

    return run


def _prepared(docs: DataFrame, whole: bool = False):
    """(rows with train, train tokens, different ones, frequent words with counts, shards, what the whole model spreads).

    A pair over one in HOT of all tokens is over one in 4 * HOT of those of some batches, and at most one in 4 * HOT of all tokens are in the others: what
    the batches count of it is over three quarters of one in HOT."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = settled(docs.select("doc_id", "text", (crc % 10 != 0).alias("train")))
    rows = rows.withColumn("part", F.spark_partition_id())  # of the reading, whatever stage it is in
    n = shuffle_parts(docs.sparkSession)
    found = saved(rows.select("text", "train").mapInArrow(_train_words(n, 4 * HOT * whole), "dest bigint, blob binary").groupBy("dest").applyInArrow(_totals, "h bigint, c bigint, n bigint, h2 bigint"))
    distinct, total = found.where("h is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    hot = {r.h % (1 << 64): r.c for r in found.where(F.col("h").isNotNull() & F.col("h2").isNull() & (F.col("c") * HOT > total)).limit(HOT + 1).collect()}
    if int(END) in hot:
        hot[int(START)] = hot[int(END)]  # as many starts as ends
    shards = max(1, math.ceil(total / SHARD))
    if not whole:
        return rows, total, distinct, hot, shards, None
    over = lambda c: min(shards, max(SALTS, math.ceil(c / SHARD)), 1 << 16)
    pairs = {(r.h % (1 << 64), r.h2 % (1 << 64)): over(r.c) for r in found.where(F.col("h2").isNotNull() & (F.col("c") * 4 * HOT > 3 * total)).collect()}
    return rows, total, distinct, hot, shards, Whole({h: over(c) for h, c in hot.items()}, pairs)


def _types(docs: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    return to_arrow_type(kind), kind.simpleString()


def score(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, learning from the
    rows whose crc32(doc_id as text) mod 10 is not 0 (a null id counts as empty text, so it is held out).

    base_score: log10 of the add-0.1 unigram model; score: log10 of the interpolated trigram model; both over words and the end.
    whole: every context has all its successors, also one of two frequent words, and leaves over what their number says.
    Null or empty texts are one token, the end; repeated rows are documents of their own; an empty table gives no rows; with no training
    row all counts are 0; other columns are ignored."""
    rows, total, distinct, hot, shards, spread = _prepared(docs, whole)
    ids, name = _types(docs)
    kinds = f"kind int, dest int, batch bigint, blob binary, ids array<{name}>"
    asked = rows.mapInArrow(_ask(shards, hot, ids, False, spread), kinds).repartitionById(shards, "dest")  # a task for each shard
    states = rows.mapInArrow(_ask(shards, hot, ids, True, spread), kinds)
    answered = asked.groupBy("dest").applyInArrow(_answer(None, spread.hashes()) if spread else _answer(hot), asked.schema)
    schema = pa.schema([("doc_id", ids), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return answered.unionByName(states).groupBy("batch").applyInArrow(
        _finish(shards, total, distinct, hot, schema),
        f"doc_id {name}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def tries(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(shard, trie): the model itself, a row for each shard with what Trie.from_buffer() reads, also out of a memory-mapped file."""
    rows, _, _, hot, shards, spread = _prepared(docs, whole)
    told = (None, spread.hashes()) if spread else (hot,)
    ids, name = _types(docs)

    def run(key, table):
        trie = _merged([_unpack(x.as_py()) for x in table.column("blob")], *told)[0]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([trie.to_bytes()], pa.binary())], ["shard", "trie"])

    asked = rows.where("train").mapInArrow(_ask(shards, hot, ids, False, spread), f"kind int, dest int, batch bigint, blob binary, ids array<{name}>")
    return asked.repartitionById(shards, "dest").groupBy("dest").applyInArrow(run, "shard bigint, trie binary")
