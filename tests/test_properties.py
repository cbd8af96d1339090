"""Column functions against plain Python on many odd strings at once."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from noteloom.functions import rules as R
from noteloom.functions import text as T
from noteloom.operators import search as S

PIECES = ["[[", "]]", "[", "|", ".md", ".MD", " ", "\n", "\t", "\r\n", " ", "　", "a", "B c", "é", "日本", "---", "date:", "sk-" + "a1" * 12, "AKIA" + "Z9" * 8, "token = x", "Secret:y",
          "@private", "#personal", "?", "go", "decided", "won", "bug", "- [x]", "1:1 with lead", "!", "_", "'", "x" * 30, "## Focus\n", "###", ""]


def strings(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def links(s, strip):
    """Link targets by a scan: two brackets, a target without a closing one, two brackets."""
    out, at = [], s.find("[[")
    while at >= 0:
        end = s.find("]", at + 2)
        if end > at + 2 and s.startswith("]]", end):
            target, _, _ = s[at + 2:end].partition("|")
            target = target.strip()
            out.append(target[:-3] if strip and target[-3:].lower() == ".md" else target)
            at = s.find("[[", end + 2)
        else:
            at = s.find("[[", at + 1)
    return [x for x in out if x]


def redact(s):
    for pattern, instead in R.REDACTIONS:
        s = re.sub(pattern, instead.replace("$1", r"\1"), s)
    return s


def score(s):
    best, low = ("unknown", 0), s.lower()
    for name, patterns, *_ in R.RULES:
        n = sum(bool(re.search(p, low, re.I)) for p in patterns)
        if n > best[1]:
            best = (name, n)
    return best[0], min(best[1] / 3, 1) * (0.7 if best[1] and len(s.split()) < 5 else 1)


def test_functions(spark):
    texts = strings()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").repartition(4)
    rows = df.select(
        "i", T.words("s").alias("w"), T.link_targets("s").alias("l"), T.link_targets("s", False).alias("k"), R.redact("s").alias("r"), T.slug("s").alias("g"),
        T.file_name("s", F.lit("")).alias("f"), T.excerpt("s", 20).alias("e"), T.entity_id("s").alias("h")).collect()
    for r in rows:
        s = texts[r.i]
        name = "-".join(re.sub(r"[^\w\s]", "", s[:40]).split()[:5]) or "note"
        assert (r.w, r.l, r.k) == (s.split(), links(s, True), links(s, False)), repr(s)
        assert (r.r, r.g, r.f) == (redact(s), s.lower().replace(" ", "-"), name + ".md"), repr(s)
        assert (r.e, r.h) == (s[:20] + "..." if len(s) > 20 else s, hashlib.sha256(s.encode()).hexdigest()[:16])


def test_classification(spark):
    texts = strings(600, 2)
    got = R.classify(spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, message string").repartition(4)).collect()
    for r in got:
        want = score(r.message)
        assert r.message_type == want[0] and abs(r.confidence - want[1]) < 1e-9, repr(r.message)


def test_chunks(spark):
    texts = strings(60, 3) + ["w " * n for n in (511, 512, 513, 1500)]
    got = {}
    for r in S.chunk(spark.createDataFrame([(str(i), s) for i, s in enumerate(texts)], "rel_path string, content string")).collect():
        got[r.path, r.chunk_index] = (r.text, r.hash)
    want = {}
    for i, s in enumerate(texts):
        w = s.split()
        for at in range(0, len(w), 512):
            t = " ".join(w[at:at + 512])
            if len(t.strip()) >= 20:
                want[str(i), at] = (t, hashlib.sha256(f"{i}:{at}".encode()).hexdigest()[:16])
    assert got == want
