import collections
import html
import math
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.llm import decontaminate as B
from noteloom.llm import mixing as M
from noteloom.llm import neighbours as A
from noteloom.llm import ngram as G
from noteloom.llm import perspectives as P
from noteloom.llm import quality as Q
from noteloom.llm import styletree as S
from noteloom.llm.common import tokens

from .conftest import frame, upper


DATA = "/root/testdata/sf0.01"


def junk(text):
    return " ".join(w + "###" for w in text.split())


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rows = [(i, junk(prose(50)) if i % 4 == 0 else prose(50), "s") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 600)], "doc_id bigint, quality int, toxic int")
    return frame(spark, rows), labels


def test_quality_held_out(spark, labelled, odd, none):
    docs, labels = labelled
    got = Q.classify(docs, labels).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    good = held.doc_id % 4 != 0
    assert held.score[good].min() > held.score[~good].max() and (held.predicted == good.astype(int)).mean() > 0.95
    machine = Q.train(docs, labels)
    rows = Q.score(odd, machine, name="own").collect()
    assert len(rows) == odd.count() and all(0 <= r.own <= 1 for r in rows)
    assert Q.classify(none, labels).count() == 0 and {r.score for r in Q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.accept(odd, labels).columns == odd.columns


def test_machine_is_the_pairwise_sum(prose):
    m = Q.fit([], rank=3)
    m.v = np.random.default_rng(1).normal(0, 0.1, m.v.shape)
    m.w = np.random.default_rng(0).normal(size=m.w.shape)
    texts = [prose(12).encode(), b""]
    doc, idx, x, stats = Q.features(texts)
    z = np.clip((stats - m.mean) / m.spread, -4, 4) / np.sqrt(Q.STATS)
    for d, t in enumerate(texts):
        f = [(int(i), float(v)) for k, i, v in zip(doc, idx, x) if k == d] + [(Q.BUCKETS + i, z[d, i]) for i in range(Q.STATS)]
        y = m.bias + sum(m.w[i] * v for i, v in f) + sum(m.v[i] @ m.v[j] * v * u for a, (i, v) in enumerate(f) for j, u in f[a + 1:])
        assert abs(1 / (1 + math.exp(-y)) - m.score([t])[0]) < 1e-9


def test_tokens(prose):
    texts = [t.encode() for t in (prose(40), "", " \t\n", "Ab ab\x0bAB\x0c é É", "x\x85y z")]
    which, starts, lengths, hashes = tokens(texts)
    data = b" ".join(texts) + b" "
    words = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    assert [(int(i), data[s:s + n]) for i, s, n in zip(which, starts, lengths)] == words
    by = collections.defaultdict(set)
    for (_, w), h in zip(words, hashes):
        by[w.lower()].add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def slow_scores(docs):
    """The model's definition, in dictionaries."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    seqs = [(i, [w for w in (t or "").encode().lower().split()] + [None]) for i, t in docs]
    uni, grams = collections.Counter(), (collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter))
    for i, s in seqs:
        if not held(i):
            uni.update(s)
            for c, w in zip([0, *s[:-1]], s):
                grams[0][c][w] += 1
            for b, c, w in zip([0, *s[:-2]], s[:-1], s[1:]):
                grams[1][b, c][w] += 1
    n, v = sum(uni.values()), len(uni)
    count = lambda w: uni[None] if w == 0 else uni[w]
    hot = lambda w: count(w) * G.HOT > n
    q = lambda x: 2.0 ** (-float(np.clip(np.rint(-8 * np.log2(max(x, 1e-12))), 0, 254)) / 8)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))

    def mixed(level, context, w, lower):
        after, off = grams[level].get(context), G.DISCOUNTS[level]
        if not after:
            return lower
        total = sum(after.values())
        if not level and hot(context):
            lam = float(G.weight(count(context)))
            return (q(lam * after[w] / total) if after[w] else 0) + q(1 - lam) * lower
        return (q((after[w] - off) / total) if after[w] else 0) + q(off * len(after) / total) * lower

    out = []
    for i, s in seqs:
        score = 0.0
        for k, w in enumerate(s):
            c = s[k - 1] if k else 0
            p = mixed(0, c, w, p1(w))
            if k:
                b = s[k - 2] if k > 1 else 0
                p = p if hot(b) and hot(c) else mixed(1, (b, c), w, p)
            score += math.log10(p)
        out.append((i, held(i), len(s), sum(uni[w] > 0 for w in s), n, sum(math.log10(p1(w)) for w in s), score))
    return out


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("hot, shard", [(400, 2_000_000), (12, 300), (1500, 700)])
def test_ngram(spark, prose, odd, none, monkeypatch, hot, shard):
    monkeypatch.setattr(G, "HOT", hot)
    monkeypatch.setattr(G, "SHARD", shard)
    rows = [(i, prose(40) + (" The the THE of" * 5 if i % 3 == 0 else ""), "s") for i in range(120)] + [(500, None, "s"), (501, "", "s"), (500, None, "s"), (None, "x", "s")]
    rows += [(600 + i, rows[i][1], "s") for i in range(20)]
    learnt = next(i for i in range(700, 800) if zlib.crc32(str(i).encode()) % 10)
    kept = next(i for i in range(700, 800) if not zlib.crc32(str(i).encode()) % 10)
    rows += [(learnt, thue_morse(1024), "s"), (kept, thue_morse(1024, "b", "a"), "s")]  # words that a polynomial hash takes for equal
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in G.score(frame(spark, rows)).collect()), key=key)
    want = sorted(slow_scores([r[:2] for r in rows]), key=key)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6
    assert len(got) == len(want) and G.score(none).count() == 0 and G.score(odd).count() == odd.count()
    assert [w for w in want if w[1] and w[2] > 1] and next(w for w in want if w[0] == kept)[3] == 1


@pytest.mark.parametrize("hot, shard", [(400, 2_000_000), (12, 300), (1500, 700)])
def test_whole_ngram(spark, prose, odd, none, monkeypatch, hot, shard):
    """The model without any cut: contexts of frequent words, and of two of them, have the probabilities that one place gives them."""
    rows = [(i, prose(40) + (" The the THE of" * 5 if i % 3 == 0 else ""), "s") for i in range(120)] + [(500, None, "s"), (501, "", "s"), (None, "x the the the", "s")]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    monkeypatch.setattr(G, "HOT", 0)  # no word is frequent for the definition
    want = sorted(slow_scores([r[:2] for r in rows]), key=key)
    monkeypatch.setattr(G, "HOT", hot)
    monkeypatch.setattr(G, "SHARD", shard)
    spread = G._prepared(frame(spark, rows), True)[-1]
    assert spread.words and spread.pairs and (hot != 12 or min(spread.pairs.values()) > 1)
    got = sorted((tuple(r) for r in G.score(frame(spark, rows), whole=True).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        off = 1e-6 if shard > 1_000_000 else 0.02 + 0.01 * w[2]  # each part of a spread context has codes of its own, of 1/8 octave
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < off, (g, w)
    assert G.score(none, whole=True).count() == 0 and G.score(odd, whole=True).count() == odd.count()


def test_ngram_keeps_the_mass(prose):
    """What the successors of a context keep and leave over is one, up to the codes."""
    table = asked_of([[prose(60).encode() for _ in range(6)]])
    trie = G._merged([G._unpack(x.as_py()) for x in table.column("blob")], {})[0]
    for level, above in ((0, len(trie.contexts)), (1, trie.successors[0].n)):
        starts = trie.pointers[level].get(np.arange(above + 1)).astype(int)
        share, left = G.decode(trie.shares[level], 0), G.decode(trie.backs[level], 1)
        some = np.flatnonzero(starts[1:] > starts[:-1])
        mass = np.array([share[starts[i]:starts[i + 1]].sum() + left[i] for i in some])
        assert abs(mass - 1).max() < 0.05


def asked_of(batches, hot=None):
    """The rows that batches of texts ask of a single shard, as a table."""
    import pyarrow as pa

    out = []
    for n, texts in enumerate(batches):
        at, sizes, vocab, home, salt, is_hot, start = G._vocabulary(texts, 1, np.zeros(0, np.uint64))
        p = G.Paths.of(at, sizes, start, home, salt, is_hot, 1)
        lead, runs = p.leads(0)
        tail, many = vocab[p.second] >> np.uint64(24), np.bincount(p.under, minlength=len(p.lead))
        counts = [np.bincount(p.bigram, minlength=len(p.lead)), np.bincount(p.trigram[p.trigram >= 0], minlength=len(p.under))]
        out.append(G._pack(vocab[lead], runs, tail.astype(np.uint32), (tail >> np.uint64(32)).astype(np.uint8), counts[0], many, (vocab[p.third] >> np.uint64(32)).astype(np.uint32), counts[1]))
    return pa.table({"kind": pa.array([G._PATHS] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})


def test_shards_answer_from_a_mapped_file(prose, monkeypatch):
    import mmap

    import pyarrow as pa

    maps, real = [], mmap.mmap
    monkeypatch.setattr(G.mmap, "mmap", lambda *a, **k: maps.append(real(*a, **k)) or maps[-1])
    table = asked_of([[prose(50).encode() for _ in range(4)] for _ in range(3)])
    got = G._answer({})((pa.scalar(G._PATHS), pa.scalar(0)), table)
    assert len(maps) == 1 and len(maps[0]) > 100 and all(len(G._unpack(x.as_py())) == 5 for x in got.column("blob"))
    assert all((G._unpack(x.as_py())[2] < G.ABSENT).all() for x in got.column("blob"))  # every bigram was counted


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1, 1 << 62), (1000, 1 << 40), (5000, 6000), (300, 1 << 62), (4000, 50), (777, 1 << 20)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        for e in (G.EliasFano(v), G.EliasFano.from_buffer(b"x" * 8 + G.EliasFano(v).to_bytes(), 8)[0]):
            assert (e.get(np.arange(n)) == v).all()
            asked = np.unique(np.r_[v, v + np.uint64(1), rng.integers(0, top, 50, dtype=np.uint64), np.uint64(1 << 63)])
            first, last = np.sort(rng.integers(0, n + 1, (2, len(asked))), axis=0)
            for a, b in ((np.zeros(len(asked), int), np.full(len(asked), n)), (first, last)):
                found = e.find(asked, a, b)
                for x, i, j, k in zip(asked, a, b, found):
                    place = i + int(np.searchsorted(v[i:j], x))
                    assert k == (place if place < j and v[place] == x else -1)


def test_trie_over_a_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    contexts = np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    two = np.unique(rng.integers(0, 50, 900, dtype=np.uint64) << np.uint64(40) | rng.integers(0, 1 << 40, 900, dtype=np.uint64))
    three = np.unique(rng.integers(0, len(two), 1500, dtype=np.uint64) << np.uint64(32) | rng.integers(0, 1 << 32, 1500, dtype=np.uint64))
    t = G.Trie.build(contexts, (two, three), (np.full(len(two), 2.0), np.full(len(three), 1.0)))
    (tmp_path / "t").write_bytes(t.to_bytes())
    for trie in (t, G.Trie.from_buffer(np.memmap(tmp_path / "t", mode="r"))):
        assert (trie.numbers(contexts) == np.arange(len(contexts))).all() and (trie.numbers(contexts + np.uint64(1)) == -1).all()
        node, tail = (two >> np.uint64(40)).astype(int), two & np.uint64((1 << 40) - 1)
        assert (trie.step(0, node, tail) == np.arange(len(two))).all() and (trie.step(0, (node + 1) % 50, tail) == -1).all() and (trie.step(0, np.full(len(tail), -1), tail) == -1).all()
        node, tail = (three >> np.uint64(32)).astype(int), three & np.uint64((1 << 32) - 1)
        assert (trie.step(1, node, tail) == np.arange(len(three))).all()
        assert (trie.share(1, np.arange(len(three))) == t.shares[1]).all() and set(trie.back(0, np.array([-1]))) == {G.ABSENT}


def test_tries_hold_the_counts(spark, prose):
    rows = [(i, prose(30), "s") for i in range(40)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    words = [[b"", *t.encode().lower().split(), None] for i, t, _ in rows if i not in held]
    pairs = {p for w in words for p in zip(w, w[1:])}
    found = G.tries(frame(spark, rows)).collect()
    assert sum(G.Trie.from_buffer(bytes(r.trie)).successors[0].n for r in found) == len(pairs)


def test_decontaminate(spark, prose, odd, none):
    items = [(i, prose(30)) for i in range(12)] + [(50, "two words"), (51, None), (52, ""), (0, None)]
    words = items[3][1].split(" ")
    docs = [(1, prose(500) + " " + items[0][1] + " " + prose(900), "s"), (2, prose(200), "s"), (3, upper(items[1][1]), "s"), (4, " ".join(words[: len(words) // 2]), "s"), (5, "Two, words!", "s"), (6, prose(20) + items[0][1] + items[2][1], "s")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = frame(spark, docs)
    split = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = set()
    for d, t, _ in docs:
        for i, u in items:
            a, b = grams(split(t)), grams(split(u or ""))
            if b and len(a & b) >= 0.8 * len(b):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in B.contaminated(df, bench).collect()}
    assert got == want and {(1, 0), (3, 1), (5, 50)} <= got
    assert {r.doc_id for r in B.clean(df, bench).collect()} == {d for d, *_ in docs} - {d for d, _ in want}
    assert B.contaminated(none, bench).count() == 0 and B.contaminated(df, bench.limit(0)).count() == 0
    assert B.clean(odd, bench).columns == odd.columns and B.clean(odd, bench).count() == odd.count()
    plan = B.contaminated(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontaminate_shuffled(spark, prose, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame([(1, prose(30))], "item_id bigint, text string")
    text = bench.first().text
    assert B.contaminated(frame(spark, [(1, "a b c " + text, "s"), (2, prose(30), "s")]), bench).count() == 1


def slow_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        full = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > 2 * sizes[s] + 1e-9}
        if not full:
            target.update({s: left * w[s] / sum(w[x] for x in open_) for s in open_})
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, prose, odd, none):
    rows = [(i, prose(1 + i % 37), [None, "b", "a", "é", "Z", "c"][min(i % 11, 5)]) for i in range(900)]
    got = M.mix(frame(spark, rows)).toPandas()
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    assert all(len(text[i].split()) == n for i, n in zip(got.doc_id, got["size"]))
    sizes = collections.Counter()
    for i, n in zip(got.doc_id, got["size"]):
        sizes[source[i]] += n
    want = slow_targets(sizes)
    for r in got.itertuples():
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
    for s in sizes:
        own = got[[source[i] == s for i in got.doc_id]]
        assert abs(own.taken.sum() - want[s]) <= 2 * own["size"].max()
    assert M.mix(frame(spark, rows)).exceptAll(M.mix(frame(spark, rows))).count() == 0
    out = M.emit(frame(spark, rows)).groupBy("doc_id").count().toPandas()
    assert dict(zip(out.doc_id, out["count"])) == {i: c for i, c in zip(got.doc_id, got.copies) if c}
    assert M.mix(odd).count() == odd.count() and M.mix(none).count() == 0 and M.emit(none).count() == 0
    assert M.emit(odd).count() == M.mix(odd).agg({"copies": "sum"}).first()[0]


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 32))
    v = (centres[rng.integers(0, 8, 3000)] + rng.normal(0, 0.4, (3000, 32))).astype(np.float32)
    v[5::7] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9100, [0.0] * 32), (9200, [float("nan")] * 32), (9300, [1.0, None]), (9400, [1.0, 2.0]), (9401, [1.0, 2.5]), (None, v[0].tolist()), (100, v[100].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = A.search(df, df.where("vec_id % 100 = 0"), part=700, block=12).toPandas()
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id], atol=1e-12)
        hit += len(set(own.vec_id) & set(order))
        total += 10
        if q == 0:
            assert list(own.vec_id) == order  # ties to the smaller id
    assert hit / total >= 0.95
    assert set(got.query_id) == {*range(0, 3000, 100), 9400} and list(got[got.query_id == 9400].vec_id) == [9401]
    assert A.search(df.limit(0), df).count() == 0 and A.search(df, df.limit(0)).count() == 0


def test_neighbours_route(spark):
    """On clusters a query visits few cells, and compares fewer and fewer of the vectors as these grow; extra and clashing columns don't matter."""
    rng, share = np.random.default_rng(6), []
    centres = rng.normal(size=(400, 24))
    for n in (2000, 20_000):
        v = centres[rng.integers(0, 400, n)] + rng.normal(0, 0.1, (n, 24))
        rows = [(i, x.tolist(), "x", 1.0) for i, x in enumerate(v)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cell string, score double").withColumn("q_id", F.lit("y")).withColumn("worst", F.lit(0.0)).cache()
        asked = df.where(f"vec_id % {n // 20} = 0")
        got = A.search(df, asked, part=500, block=3).toPandas()
        hit = 0
        for q in range(0, n, n // 20):
            d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
            hit += len(set(got[got.query_id == q].vec_id) & set([i for i in np.lexsort((np.arange(n), d)) if i != q][:10]))
        assert hit / 200 >= 0.95 and got.groupby("query_id").size().eq(10).all()
        share.append(A.effort(df, asked, part=500, block=3).agg(F.sum("verified")).first()[0] / 20 / n)
        df.unpersist()
    assert share[1] < share[0] / 2 and share[1] < 0.1


def test_neighbours_long_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=5000 if i % 2 else 3).tolist()) for i in range(40)] + [(7, rng.normal(size=5000).tolist())] * 2
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = A.search(df, df.where("vec_id < 4"), k=30).toPandas()
    assert got[got.query_id == 2].vec_id.mod(2).eq(0).all() and got.groupby("query_id").size().to_dict() == {0: 19, 1: 19, 2: 19, 3: 19}


def test_chi_square():
    assert abs(A.chi_square(15.507, 8) - 0.95) < 1e-4 and A.chi_square(0.0) == 0
    assert abs(A.chi_square_inverse(0.95, 8) - 15.507) < 1e-3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body><header>Site <b>head</b></header>
<nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">Cookies</div>{body}<aside>Side</aside><div id="comments"><p>Nice!</p></div><form><input>Send</form><footer>&copy; F</footer></body></html>"""


def test_style_tree_article():
    page = PAGE.format(body="<article><h1>Ti&amp;tle</h1><p>One <b>bo</b>ld&nbsp; text<br>next<p>Two\n three<div class='ad'>Buy</div><ul><li>a<li>b</ul><!-- c --><p hidden>no</p><blockquote>q</blockquote></article>")
    assert S.extract(page) == "Ti&tle One bold text next Two three a b q"
    assert S.extract(PAGE.format(body="<article><p>open")) == "open" and S.extract("") == "" and S.extract("<nav>x</nav>") == ""
    assert S.extract("<p>a<p>b <b>c</b>d &lt;e&gt;") == "a b cd <e>" and S.extract("just text") == "just text"
    assert S.extract("<article><header><h1>H</h1></header>x<footer>f</footer></article>") == "H x"


def test_style_tree_importance(spark):
    page = "<html><body><div class='top'>Same line on all</div><div class='body'><p>Story {0} begins</p><p>and {0} ends</p></div><div class='end'>Read more</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i * 7919)) for i in range(12)] + [(90, None, None), (91, "odd", ""), (92, "http://other.example/", page.format(1)), (0, "http://h.example/0", page.format(0))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in S.main_text(df.selectExpr("*", "'x' as host", "1 as low")).collect()}
    assert got[3].text == "Story 23757 begins and 23757 ends" and got[3].n_chars == len(got[3].text)
    copies = spark.createDataFrame([(i, "http://c.example/", page.format(5)) for i in range(30)], "page_id bigint, url string, html string")
    assert {r.text for r in S.main_text(copies).collect()} == {"Same line on all Story 5 begins and 5 ends Read more"}
    assert got[90].text == got[91].text == "" and got[92].text.startswith("Same line") and S.main_text(df).count() == len(rows) and S.main_text(df.limit(0)).count() == 0


def test_style_tree_judges_articles(spark):
    """Repeated blocks inside an article go, what differs beside it stays, and copies of an article under other frames keep it."""
    page = "<body><div class='wrap'><article class='teaser'><h2>Teaser {0}</h2><div class='box'>Same line on all</div></article><div class='body'><p>Story {0} begins</p><p>and {0} ends</p></div><div class='end'>Read more</div></div></body>"
    framed = "<body><div class='hits'>Seen by {0}</div><div class='wrap'><article><p>One story</p><p>for all</p></article></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i * 7919)) for i in range(12)] + [(50 + i, f"http://f.example/{i}", framed.format(i)) for i in range(12)] + [(90, "http://o.example/", page.format(1))]
    got = {r.page_id: r.text for r in S.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Teaser 23757 Story 23757 begins and 23757 ends"
    assert got[53] == "Seen by 3 One story for all" and got[90] == "Teaser 1 Same line on all"


def test_style_tree_deep_pages(spark):
    """Branches at any depth are judged, and no depth ends a run."""
    page = "<body>" + "<div>" * 60 + "<p class='x'>Same line on all</p><ul><li>Story {0}</ul>" + "</div>" * 60
    rows = [(i, f"http://d.example/{i}", page.format(i)) for i in range(12)]
    rows += [(50 + i, f"http://e.example/{i}", "<div>" * 3000 + str(i)) for i in range(5)] + [(60, None, "<div>" * 3000 + "<article>" * 3000 + "end")]
    got = {r.page_id: r.text for r in S.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Story 3" and got[52] == "2" and got[60] == "end"


def blocks_of(node):
    return [k for k in node.kids if isinstance(k, S.Node) and k.tag in S.BLOCK]


def words_of(node):
    """The texts between the edges of blocks inside a node."""
    out, run = [], []

    def walk(n):
        for k in n.kids:
            if isinstance(k, str):
                run.append(k)
            else:
                edge = k.tag in S.BLOCK
                if edge:
                    cut()
                walk(k)
                if edge:
                    cut()

    def cut():
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    walk(node)
    cut()
    return tuple(out)


def slow_tree(pages):
    """{host: {(path, inside): importance}} by the definition, with whole paths and contents in dictionaries."""
    seen = collections.defaultdict(set)
    for host, page in pages:
        root = S.parse(page)
        mains = [id(m) for m in S._main(root)]

        def walk(node, path, main):
            for k in blocks_of(node):
                at = path + (("!" if id(k) in mains else "") + k.kind,)
                if id(k) not in mains and k.tag not in ("html", "body"):
                    copy = page if main is None else words_of(main)
                    seen[host, at, main is not None, "shape"].add((copy, tuple(x.kind for x in k.kids if isinstance(x, S.Node))))
                    seen[host, at, main is not None, "text"].add((copy, words_of(k)))
                if not k.noise:
                    walk(k, at, k if id(k) in mains else main)

        walk(root, (), None)
    out = collections.defaultdict(dict)
    for (host, at, inside, _), pairs in seen.items():
        n, count = len(pairs), collections.Counter(x for _, x in pairs)
        if n >= S.PAGES:
            h = -sum(c / n * math.log(c / n) for c in count.values()) / math.log(n)
            out[host][at, inside] = max(h, out[host].get((at, inside), 0))
    return out


def slow_text(page, judged, prior):
    root = S.parse(page)
    mains = S._main(root)
    tops, around = [id(m) for m in mains], set()
    for m in mains:
        while m is not None:
            around.add(id(m))
            m = m.parent
    out = S.Node("root", "", None)

    def walk(node, to, path, keep):
        for k in node.kids:
            if isinstance(k, str):
                if keep:
                    to.kids.append(k)
                continue
            if prior and k.noise:
                continue
            copy = S.Node(k.tag, "", to)
            to.kids.append(copy)
            if k.tag not in S.BLOCK or id(k) in tops or k.tag in ("html", "body"):
                at = path + (("!" if id(k) in tops else "") + k.kind,) if k.tag in S.BLOCK else path
                walk(k, copy, at, keep or id(k) in tops)
                continue
            at = path + (k.kind,)
            inside, beside = judged.get((at, True)), judged.get((at, False))
            if id(k) not in around:
                if min(x for x in (inside, beside, 9) if x is not None) < S.IMPORTANCE:
                    continue
                walk(k, copy, at, keep or (beside is not None and max(beside, inside or 0) >= S.ALIKE))
            else:
                walk(k, copy, at, keep)

    walk(root, out, (), not mains)
    return " ".join(words_of(out))


def site(rng, prose, host, n):
    """Pages with menus, notices and boxes in few forms and with stories in many, some in articles, some beside."""
    few = [prose(5) for _ in range(4)]
    out = []
    for i in range(n):
        menu = "".join(f"<li>{x}" for x in rng.sample(few, 3))
        story = "".join(f"<p>{prose(8)}" for _ in range(rng.randint(1, 4)))
        box = f"<div class='box'>{few[0]}</div>"
        body = {0: f"<article><h1>{prose(3)}</h1>{box}{story}</article>", 1: f"<div class='story'>{story}{box}</div>", 2: f"<article class='teaser'>{prose(4)}</article><div class='story'>{story}</div>"}[host % 3]
        out.append((f"h{host}.example", f"<html><body><ul class='top'>{menu}</ul><div class='wrap'>{body}<div class='more'>{rng.choice(few)}</div></div><div class='end'>{few[1]}</div><footer>{few[2]}</footer></body></html>"))
    return out


@pytest.mark.parametrize("prior", [True, False])
def test_style_tree_matches_brute_force(spark, prose, prior):
    rng = random.Random(8)
    pages = [x for h, n in enumerate((12, 14, 30, 3, 9)) for x in site(rng, prose, h, n)]
    pages += rng.sample(pages, 6)
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in S.main_text(df, prior=prior).collect()}
    trees = slow_tree(pages)
    want = {i: slow_text(p, trees[h], prior) for i, (h, p) in enumerate(pages)}
    assert got == want
    changed = sum(S.extract(p, prior=prior) != got[i] for i, (_, p) in enumerate(pages))
    assert changed > 20 and any(0 < v < S.IMPORTANCE for t in trees.values() for v in t.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_style_tree_decides_on_the_tables(spark):
    """Without the prior the tree still finds the articles of most pages, where a page by itself shows menus and adverts as well."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: r.text for r in S.main_text(pages).collect()}
    alone = {r.page_id: r.text for r in S.main_text(pages, prior=False).collect()}
    assert sum(want[i] == alone[i] for i in want) > len(want) / 2


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<a " * 350_000, "<div>" * 50_000 + "</x>" * 50_000, "<p>" + "<div>" * 50_000, "<a href='" * 100_000, "<p><table><tr><td>" + "<div><li>" * 30_000, "<" * 1_000_000, "<article>" * 50_000])
def test_style_tree_time_is_linear(page):
    began = time.process_time()
    S.extract(page)
    list(S.features(page))
    assert time.process_time() - began < 20


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (2, 0, "system", "x"), (3, 0, None, "who"), (3, 1, "ann", "é"), (3, 1, "ann", "é"), (None, 0, "ann", "n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turned = P.rotate(df.selectExpr("*", "1 as place", "2 as size"))
    by = {(r.conv_id, r.perspective): r for r in P.render(turned).collect()}
    assert set(by) == {(1, "ann"), (1, "bob"), (3, "ann"), (None, "ann")}
    r = by[1, "bob"]
    assert r.text == "<|system|>\nBe kind<|end|>\n<|user name=ann|>\nHi<|end|>\n<|assistant|>\n<|end|>\n<|user name=ann|>\nBye<|end|>\n"
    ann = by[1, "ann"]
    assert [ann.text[s.start:s.end] for s in ann.spans] == ["Hi<|end|>", "Bye<|end|>"] and "name=unknown" in by[3, "ann"].text
    assert P.rotate(df.limit(0)).count() == 0


def test_pipeline(spark, odd, none, tmp_path, prose):
    import corpus_pipeline as C

    rows = [(i, prose(60) if i % 5 else junk(prose(60)), f"s{i % 4}") for i in range(300)] + [(400 + i, None, None) for i in range(2)]
    rows += [(500 + i, rows[1][1], "s1") for i in range(5)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[2][1])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id for r in C.run(spark, str(tmp_path)).collect()}
    assert 2 not in out and not out & set(range(500, 505)) and not {i for i in out if i % 5 == 0 and i < 300}
    kept = docs
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert stage(spark, none, str(tmp_path)).count() == 0 and stage(spark, odd, str(tmp_path)).columns == odd.columns
    assert {1, 3, 4, 6} <= {r.doc_id for r in kept.collect()}
    C.STAGES[-1][1](spark, odd, str(tmp_path)).collect()
