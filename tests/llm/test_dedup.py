import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from noteloom.llm import sentences as Z
from noteloom.llm import simhash as H
from noteloom.llm import suffixes as X

from noteloom.llm.common import tokens

from .conftest import frame


def brute(docs, n=100):
    """Per document what the report says, by all n-byte strings in order."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            w = t[p:p + n]
            if w in seen:
                gone[p:p + n] = b"\1" * n
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def copies(prose, seed=1):
    rng, bank, docs = random.Random(seed), [prose(60) for _ in range(6)], []
    for i in range(60):
        parts = [prose(rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(bank)
            a, b = sorted(rng.sample(range(len(p)), 2))
            parts.insert(rng.randint(0, 3), p[a:b] if rng.random() < 0.6 else p)
        docs.append((rng.randint(0, 10**6) * 100 + i, "".join(parts)))
    docs += [(10**9 + i, docs[i][1]) for i in range(4)] + [(10**9 + 50, "ab" * 400), (10**9 + 51, "z" * 99), (10**9 + 52, "z" * 300), (10**9 + 53, "ab" * 90)]
    return docs


@pytest.mark.parametrize("group, most", [(X.GROUP, X.MOST), (3, X.MOST), (1, 2), (X.GROUP, 2)])
def test_suffixes_match_brute_force(spark, prose, group, most):
    docs = copies(prose)
    got = {r.doc_id: tuple(r)[1:5] for r in X.dedupe_report(frame(spark, [(i, t, "s") for i, t in docs]), group=group, most=most).collect()}
    want = brute([(i, t.encode()) for i, t in docs])
    assert got == want and any(v[1] for v in want.values())


def test_suffix_pieces(monkeypatch, prose):
    monkeypatch.setattr(X, "_PIECE", 700)
    text = (prose(300) + prose(20) * 8).encode()
    h, c, number, place, before, after = X.anchors([text, b"short", text])
    for p in range(len(text) - 99):  # every window lies in the context of an anchor it holds
        assert any(s - x <= p and p + 100 <= s + y and p <= s <= p + 100 - X.K for n, s, x, y in zip(number, place, before, after) if n == 0 and abs(s - p) < 100)


def test_suffixes_odd(spark, odd, none):
    rows = X.dedupe_report(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and by[1].n_removed == 0 and by[2].n_removed == by[2].n_bytes > 0
    assert by[3].n_bytes == by[4].n_bytes == 0 and by[None].n_removed == 0 and by[7].n_removed >= by[1].n_bytes
    assert by[10].n_removed == 4999 and by[10].n_spans == 1  # a run: only its first byte starts nothing repeated
    assert X.dedupe_report(none).count() == 0 and X.dedupe(none).count() == 0
    kept = X.dedupe(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 4, 5, 6, 7, 8, None} and 2 not in {r.doc_id for r in kept.collect()}


def test_maximal_repeats():
    nodes = X.intervals([b"aab", b"aac", b"ab", b"b"])
    assert set(nodes) == {(2, 0, 1), (1, 0, 2), (0, 0, 3)}
    group = sorted([(b"R" * 100, b"xyz" + b"l" * 40, (3, 5)), (b"R" * 60 + b"q" * 40, b"l" * 68, (1, 9)), (b"R" * 100, b"l" * 68, (2, 7))])
    assert sorted(X.repeats(group, 100)) == [((2, 7), 68, 60), ((3, 5), 0, 100)]
    assert sorted((left, r, sorted(o)) for left, r, o in X.maximal(group, 100)) == [(0, 100, [(2, 7), (3, 5)]), (68, 60, [(1, 9), (2, 7)])]


def test_repeat_groups(spark, prose):
    """Every occurrence of a group holds the same bytes, and the groups cover just what has to go, and its first places."""
    docs = copies(prose)
    text = {i: t.encode() for i, t in docs}
    groups = {}
    for r in X.groups(frame(spark, [(i, t, "s") for i, t in docs])).collect():
        groups.setdefault((r.anchor, r.number, r.n_bytes), []).append((r.doc_id, r.start))
    covered = {i: bytearray(len(t)) for i, t in text.items()}
    for (_, _, n), places in groups.items():
        assert n >= 100 and len(places) > 1 and len({text[d][p:p + n] for d, p in places}) == 1
        for d, p in sorted(places)[1:]:
            covered[d][p:p + n] = b"\1" * n
    want = brute([(i, t) for i, t in text.items()])
    assert {i: sum(c) for i, c in covered.items()} == {i: v[1] for i, v in want.items()}


def test_suffixes_one_id_with_different_texts(spark, prose):
    base, other = prose(90), prose(90)
    rows = [(1, base, "s"), (5, other, "s"), (5, base, "s"), (5, "short", "s"), (7, other + base, "s")]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in X.dedupe_report(frame(spark, rows)).collect()}
    size = lambda t: len(t.encode())
    assert all(0 <= v <= k[1] for k, v in got.items()) and len(got) == 5 and got[5, 5] == 0 and got[1, size(base)] == 0
    assert sum(v > 0 for k, v in got.items() if k[0] == 5) <= 1 and got[7, size(other + base)] in (size(base), size(base + other))
    kept = X.dedupe(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) in ([1, 5, 5, 7], [1, 5, 5, 5, 7], [1, 5, 5, 5], [1, 5, 5])


def slow_fingerprint(text):
    words = text.lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = ids.copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, prose):
    rng, rows = random.Random(5), []
    for g in range(25):
        words = prose(300).split(" ")
        for i in range(rng.randint(1, 9)):
            w = list(words)
            for _ in range(i // 2):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(100)
            rows.append((rng.randrange(10**6), " ".join(w), "s"))
    got = H.near_duplicates(frame(spark, rows)).toPandas()
    text = {}
    for i, t, _ in rows:
        text.setdefault(i, t)
    fps = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    assert all(slow_fingerprint(text[i].encode()) == int(f) for i, f in zip(got.doc_id, fps))
    assert (reach(got.doc_id.values, fps) == got.component_id.values).all() and got.component_id.nunique() < len(got)


def test_simhash_chain(spark):
    """Fingerprints in a chain of four-bit steps, whose ends are far apart, and one apart by five bits."""
    fps, x, rng = [], 0, random.Random(2)
    for _ in range(12):
        fps.append(x)
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
    fps += [fps[0] ^ 0b11111 << 40]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from noteloom.llm.common import components

    links = H.neighbours(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    label = {r.node: r.label for r in components(links).collect()}
    want = reach(np.arange(len(fps)), np.array(fps, np.uint64))
    for i, a in enumerate(signed):
        for j, b in enumerate(signed):
            assert (label.get(a, a) == label.get(b, b)) == (want[i] == want[j])


def test_simhash_odd(spark, odd, none):
    rows = H.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and H.near_duplicates(none).count() == 0
    assert {by[i].component_id for i in (3, 4, 5, 9)} == {3} and by[3].fingerprint == "0" * 16
    assert by[2].component_id == by[11].component_id == by[None].component_id == 1
    kept = [r.doc_id for r in H.dedupe(odd).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 11 not in kept and 4 not in kept and kept.count(None) == 1 and H.dedupe(odd).columns == odd.columns


def slow_sentences(raw):
    """(words, bytes) of the sentences: first by real ends, then long ones word by word."""
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out, now = [], []
    for k, (a, b) in enumerate(found):
        now.append(k)
        following = found[k + 1][0] if k + 1 < len(found) else len(raw)
        if raw[b - 1:b] in (b".", b"!", b"?") or b"\n" in raw[b:following] or k + 1 == len(found):
            out.append(now)
            now = []
    pieces = []
    for ks in out:
        part = []
        for k in ks:
            part.append(k)
            word = raw[slice(*found[k])].lower()
            again = k > 0 and raw[slice(*found[k - 1])].lower() == word
            if len(ks) > Z.LONG and ((int(tokens([word])[3][0]) >> 20) % Z.CUT == 0 or again) or k == ks[-1]:
                pieces.append(part)
                part = []
    begins = [0] + [found[p[0]][0] for p in pieces[1:]] + [len(raw)]
    return [([raw[slice(*found[k])].lower() for k in p], raw[begins[i]:begins[i + 1]]) for i, p in enumerate(pieces)]


def all_runs(parts):
    """Every run of SPAN sentences or more that holds WORDS words."""
    for i in range(len(parts)):
        flat = ()
        for j in range(i + 1, len(parts) + 1):
            flat += tuple(parts[j - 1][0])
            if j - i >= Z.SPAN and len(flat) >= Z.WORDS:
                yield i, j, hash(flat)


def test_sentences(spark, prose, odd, none):
    tail = "Every long opening sentence of a shared passage goes on for fourteen words or so. Yes. No."
    docs = [(10**7 + k, t[:900]) for k, (_, t) in enumerate(copies(prose, 4))] + [(5 * 10**8, "WORD!! OF!! THE!! " * 20), (5 * 10**8 + 1, "x y\n\n" + prose(60))]
    docs += [(i, f"{prose(15)} {tail} {prose(9)}\nAll rights reserved. Terms apply here. See the file.\n{prose(7)}") for i in range(6)]
    got = {r.doc_id: r for r in Z.dedupe(frame(spark, [(i, t, "s") for i, t in docs])).collect()}
    seen, removed = set(), 0
    for i, t in sorted(docs):
        raw, gone = t.encode(), set()
        parts = slow_sentences(raw)
        assert b"".join(p[1] for p in parts) == raw or not parts
        for a, b, flat in all_runs(parts):
            if flat in seen:
                gone |= set(range(a, b))
            seen.add(flat)
        kept = b"".join(p[1] for j, p in enumerate(parts) if j not in gone) if gone else raw
        assert (got[i].n_removed, got[i].kept_sha256, got[i].text) == (len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()), i
        removed += len(gone)
    assert removed and all("No." not in got[i].text and "rights" not in got[i].text for i in range(1, 6)) and tail in got[0].text
    rows = Z.dedupe(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and by[2].text == "" and by[3].text is None and by[1].n_removed == 0 and by[5].text.isspace() and Z.dedupe(none).count() == 0
    assert by[None].n_removed == 0 and by[8].text == "one"


def test_sentences_one_id_with_different_texts(spark, prose):
    base, other = prose(60), prose(60)
    rows = [(1, base, "s"), (5, other, "s"), (5, "x. y. z " + base, "s"), (5, "short", "s"), (7, other, "s")]
    got = Z.dedupe(frame(spark, rows)).collect()
    assert len(got) == 5 and sum(r.n_removed > 0 for r in got if r.doc_id == 5) <= 1 and [r.n_removed for r in got if r.doc_id == 1] == [0]


def test_short_sentences_are_whole():
    """Sentences of up to LONG words aren't cut."""
    text = " ".join(f"w{i}" for i in range(Z.LONG)).encode() + b". " + " ".join(f"v{i}" for i in range(60)).encode() + b"."
    s = Z.split([text])
    assert (s.first[0], s.last[0]) == (0, Z.LONG) and len(s.first) > 3


def test_shuffled_paths(spark, prose, monkeypatch):
    """The same results where nothing is small enough to be broadcast."""
    from noteloom.llm import common, mixing, styletree

    docs = frame(spark, [(i, t, f"s{i % 3}") for i, t in copies(prose, 6)])
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.example/", f"<div>Same</div><div class='a'><p>{prose(8)}</div>") for i in range(20)], "page_id bigint, url string, html string")
    runs = [lambda: X.dedupe_report(docs), lambda: X.dedupe(docs), lambda: Z.dedupe(docs), lambda: mixing.emit(docs), lambda: styletree.main_text(pages), lambda: H.dedupe(docs)]
    want = [sorted(map(str, f().collect())) for f in runs]
    for module in (common, X, Z, mixing, styletree):
        monkeypatch.setattr(module, "BROADCAST_IDS", -1)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert [sorted(map(str, f().collect())) for f in runs] == want


def test_long_passages_are_caught(prose):
    """A passage of over 50 words is found in any surroundings, most of it."""
    for k in range(30):
        passage, a, b = prose(55), prose(20), prose(33)
        cases = [f"{a} {passage} {b}".encode(), f"{b[:-3]} {passage}".encode()]
        hashes = []
        for t in cases:
            s = Z.split([t])
            hashes.append({(int(h), int(g)) for h, g in zip(*Z.runs(s)[2:])})
        assert hashes[0] & hashes[1], k


def test_split_alone_and_together(prose):
    texts = [t.encode() for t in ("a b same", "same c d e", "", "same same x", prose(30), "x", prose(50))]
    both = Z.split(texts)
    for i, t in enumerate(texts):
        one = Z.split([t])
        mine = both.text == i
        assert list(zip(one.start, one.end)) == list(zip(both.start[mine], both.end[mine]))
        assert [tuple(x)[2:] for x in zip(*Z.runs(one))] == [(h, g) for k, _, h, g in zip(*Z.runs(both)) if mine[k]]
