"""Reading notes: markdown files with YAML front matter, as frames.

Files are listed on the driver through Spark's file system client (so any store it knows works): Spark's own readers
skip hidden, underscored and empty files, which notes may be. Contents are read and parsed on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = "stem string, content string, fm map<string,string>, tags array<string>, date string, description string, wing string"


def _yaml():
    try:
        import yaml
    except ImportError:
        return None
    return yaml


def split_front(raw: str) -> tuple[dict, str]:
    """(front matter, body) of a note; a text without front matter, or with one that can't be read, has none and is its own body."""
    body = raw.strip()
    lines = raw.lstrip("﻿").split("\n")
    if lines[0].rstrip() != "---":
        return {}, body
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---"), None)
    if end is None:
        return {}, body
    head = "\n".join(lines[1:end])
    try:
        yaml = _yaml()
        found = yaml.safe_load(head) if yaml else dict(x.split(":", 1) for x in lines[1:end] if ":" in x)
    except Exception:  # a broken head is text
        return {}, body
    if found is None:
        found = {}
    return (found, "\n".join(lines[end + 1:]).strip()) if isinstance(found, dict) else ({}, body)


def tags_of(value) -> list[str] | None:
    if isinstance(value, str):
        return [t.strip() for t in value.split(",") if t.strip()]
    if isinstance(value, list):
        return [t.strip() for t in value if isinstance(t, str) and t.strip()]
    return None


def parsed(raw: str | None) -> dict:
    """The parsed columns of a note's text."""
    head, body = split_front(raw or "")
    text = lambda k: str(head[k]) if head.get(k) not in (None, "") else None
    only = lambda k: head[k] if isinstance(head.get(k), str) else None
    return {"content": body, "fm": {str(k): "" if v is None else str(v) for k, v in head.items()}, "tags": tags_of(head.get("tags")),
            "date": text("date")[:10] if text("date") else None, "description": only("description"), "wing": only("wing")}


def parse(raw: DataFrame) -> DataFrame:
    """raw (rel_path, raw) with stem, name, content, front matter and ord (by path)."""
    kind = raw.select("rel_path", "raw").schema.simpleString()[7:-1].replace(":", " ") + ", content string, fm map<string,string>, tags array<string>, date string, description string, wing string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = pd.DataFrame([parsed(r) for r in f["raw"]], columns=["content", "fm", "tags", "date", "description", "wing"], index=f.index)
            yield pd.concat([f[["rel_path", "raw"]], rows], axis=1)

    name = F.element_at(T.path_parts("rel_path"), -1)
    notes = raw.select("rel_path", "raw").mapInPandas(run, kind)
    return notes.withColumn("name", name).withColumn("stem", F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).withColumn("ord", F.xxhash64("rel_path"))


def listing(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """(rel_path, path) of all files below root with the suffix, hidden and empty ones too."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, out = unquote(urlparse(fs.makeQualified(at).toUri().toString()).path).rstrip("/"), []
    if fs.exists(at):
        found = fs.listFiles(at, True)
        while found.hasNext():
            path = found.next().getPath()
            full = path.toUri().getPath()
            if full.endswith(suffix):
                out.append((full[len(base) + 1:], path.toString()))
    return spark.createDataFrame(sorted(out), "rel_path string, path string")


def read(spark: SparkSession, root: str) -> DataFrame:
    """Every note below root: rel_path, raw and the parsed columns. The listing is joined to the contents, so that files
    that Spark's reader skips (hidden, underscored and empty ones) are read as well, by the driver. A file that isn't UTF-8 is an empty note."""
    files = listing(spark, root)
    bare = lambda c: F.regexp_replace(c, r"^[a-z]+:/*", "/")
    if not files.limit(1).count():
        return parse(files.select("rel_path", F.lit("").alias("raw")))
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    seen = seen.select(bare("path").alias("_at"), text.alias("raw"), F.lit(True).alias("_read"))
    both = files.withColumn("_at", bare("path")).join(seen, "_at", "left")
    rest = [(r.rel_path, _text(spark, r.path)) for r in both.where("_read is null").select("rel_path", "path").toLocalIterator()]
    return parse(both.where("_read").select("rel_path", "raw").union(spark.createDataFrame(rest, "rel_path string, raw string")))


def _text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    except UnicodeDecodeError:
        return ""
    finally:
        stream.close()


def inside(base: str, path: str) -> bool:
    """Whether a relative path stays below base."""
    p = PurePosixPath(path)
    return not p.is_absolute() and ".." not in p.parts and "\\" not in path and base is not None
