"""The pipeline against a plain version of each stage, one after another, and on odd rows from end to end."""

import collections
import hashlib
import math

import numpy as np

from noteloom.llm import quality as Q

from .conftest import frame
from .test_dedup import copies, reach, slow_fingerprint
from .test_models import junk, slow_targets


def words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def grams(w):
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def cut(rows):
    """Texts without the bytes of strings of 100 that start earlier as well."""
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(raw) - 99):
            w = raw[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        out[i] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore") if any(gone) else t
    return {i: t for i, t in out.items() if t}


def mixed(rows, source):
    size = {i: len(t.encode().split()) for i, t in rows.items()}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    target = slow_targets(dict(sizes))
    out = []
    for s in sizes:
        each = target[s] / sizes[s] if sizes[s] else 0.0
        offset = int(hashlib.md5(f"mix-1{'|' if s is None else '=' + s}".encode()).hexdigest()[:8], 16) / 4294967296
        for k, i in enumerate(sorted((i for i in rows if source[i] == s), key=lambda i: (size[i], i))):
            n = math.floor(offset + (k + 1) * each) - math.floor(offset + k * each)
            out += [(i, rows[i], c) for c in range(n)]
    return sorted(out)


def test_pipeline_matches_the_plain_stages(spark, prose, tmp_path):
    import corpus_pipeline as C

    rows = [(i, prose(60) if i % 5 else junk(prose(60)), f"s{i % 4}") for i in range(200)]
    rows += [(1000 + k, t, "s1") for k, (_, t) in enumerate(copies(prose, 9)) if len(t) > 200] + [(2000 + i, rows[i][1], "s2") for i in range(1, 9)]
    rows += [(3000 + i, rows[i][1].replace(" ", "  ").upper() + " tail", None) for i in range(11, 14)] + [(4000, prose(20) + " " + rows[2][1], "s3")]
    docs = frame(spark, rows)
    items = [(1, rows[2][1]), (2, " ".join(rows[3][1].split()[:20]))]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id, r.text, r.copy) for r in C.run(spark, str(tmp_path)).collect())

    machine = Q.train(docs, labels)
    kept = {i: t for i, t, _ in rows if machine.score([t.encode()])[0] >= Q.THRESHOLD}
    ids = np.array(sorted(kept))
    fps = np.array([slow_fingerprint(kept[i].encode()) for i in ids.tolist()], np.uint64)
    kept = {int(i): kept[int(i)] for i, c in zip(ids, reach(ids, fps)) if i == c}
    kept = cut(kept)
    asked = [grams(words(t)) for _, t in items]
    kept = {i: t for i, t in kept.items() if all(len(grams(words(t)) & a) < 0.8 * len(a) for a in asked)}
    assert got == mixed(kept, {i: s for i, _, s in rows})
    assert len(kept) < len(rows) - 40 and any(len(t) < len(dict((i, x) for i, x, _ in rows)[i]) for i, t in kept.items())


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as C

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (8, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "x")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sizes = odd, []
    for name, stage in C.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns + (["copy_"] if name == "mixing" else []), name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "mixing":
            assert sizes[-1] <= before.count()
    whole = C.run(spark, str(tmp_path))
    assert whole.count() == sizes[-1] and whole.columns == odd.columns + ["copy_"]
    # nothing is labelled as bad: what isn't a copy stays, the texts of one id each, and rows without an id
    ids = [r.doc_id for r in spark.read.parquet(str(tmp_path / "benchmark")).collect()]
    assert {1, 3, 6, 7, 8, 13, None} <= set(ids) and not {2, 4, 9, 11} & set(ids)
