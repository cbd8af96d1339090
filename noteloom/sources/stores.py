"""Tables, documents and files of the stores: fact tables, catalogue document, chunk index, session log, configuration, notes.

Every file is reached through Spark's file system client, so a store may lie wherever Spark can read and write.
"""

from __future__ import annotations

import json
import logging
import posixpath
import shutil
import subprocess
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import catalogue as C

TRIPLES = "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_file string"
ENTITIES = "id string, name string, type string"
CHUNKS = "hash string, path string, chunk_index int, text string, embedding array<float>"
DRAWERS = "wing string, room string, path string"

log = logging.getLogger(__name__)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; bytes that aren't UTF-8 are replaced."""
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written whole: beside its place, then renamed over what is there in one step, so readers see the old or the new one."""
    at, fs = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    new = jvm.org.apache.hadoop.fs.Path(posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}.new"))
    fs.mkdirs(at.getParent())
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(new), fs.makeQualified(at), over)


class Versioned:
    """A table in buckets by hash of a key. A write makes new folders for the buckets that it touches, and then a pointer file names the
    folders of all buckets in one step: readers see whole states, a table can be rewritten from itself, and a small batch rewrites
    what it touches only. Folders that neither this state nor the one before names are removed."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _state(self) -> dict | None:
        at = f"{self.path}/CURRENT"
        if exists(self.spark, at):
            return json.loads(read_text(self.spark, at))
        if self._folders():
            raise OSError(f"{self.path} has versions, but no pointer to one")
        return None

    def _folders(self) -> list[str]:
        at, fs = _fs(self.spark, self.path)
        return [x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().startswith("v-")] if fs.exists(at) else []

    @property
    def written(self) -> bool:
        return self._state() is not None

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, folders) -> DataFrame:
        paths = [f"{self.path}/{x}" for x in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The current state; empty if there is none."""
        return self._read(((self._state() or {}).get("buckets") or {}).values())

    def _put(self, df: DataFrame, keep: dict[str, str]) -> None:
        name = f"v-{uuid.uuid4().hex}"
        df.withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        at, fs = _fs(self.spark, f"{self.path}/{name}")
        made = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
        state = {"buckets": {**keep, **{x.partition("=")[2]: f"{name}/{x}" for x in made}}}
        write_text(self.spark, f"{self.path}/CURRENT", json.dumps(state))
        live = {x.partition("/")[0] for x in state["buckets"].values()} | {name} | self._before
        for old in set(self._folders()) - live:
            at, fs = _fs(self.spark, f"{self.path}/{old}")
            fs.delete(at, True)

    def _names(self) -> dict[str, str]:
        """The buckets' folders; the folders of this state stay until the next but one is written."""
        buckets = (self._state() or {}).get("buckets") or {}
        self._before = {x.partition("/")[0] for x in buckets.values()}
        return buckets

    def write(self, df: DataFrame) -> None:
        """df instead of what is there."""
        self._names()
        self._put(df, {})

    def merge(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """The rows of the buckets of keys (a frame with the key's column) changed: change gets them and returns them anew."""
        names = self._names()
        touched = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}
        if touched:
            self._put(change(self._read([v for k, v in names.items() if k in touched])), {k: v for k, v in names.items() if k not in touched})

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], self.schema))


def read_catalogue(spark: SparkSession, path: str) -> C.Catalogue:
    """The catalogue of a JSON document; empty without the file."""
    if not exists(spark, path):
        doc = spark.createDataFrame([({}, [])], C.DOCUMENT)
    else:
        doc = spark.read.schema(C.DOCUMENT).option("multiLine", "true").json(path)
    return C.from_document(doc)


def write_catalogue(spark: SparkSession, path: str, c: C.Catalogue) -> None:
    """A catalogue names folders, not notes: its one document is put together in one row and written by the driver."""
    doc = C.to_document(c).select(F.to_json(F.struct("wings", "tunnels")).alias("json")).first()
    write_text(spark, path, json.dumps(json.loads(doc["json"]), indent=2, ensure_ascii=False))


_INDEX = "model string, chunks array<struct<hash:string,path:string,chunk_index:int,text:string,embedding:array<float>>>"


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """Chunks of an index: a folder as write_index() makes it, or a JSON document {"model", "chunks"}; None if it is missing or broken."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    if fs.getFileStatus(at).isDirectory():
        return spark.read.schema(f"ord bigint, {CHUNKS}").parquet(path)
    doc = spark.read.schema(_INDEX).option("multiLine", "true").json(path)
    if doc.where("chunks is not null").limit(1).count() == 0:
        return None
    return doc.select(F.posexplode("chunks").alias("ord", "c")).select(F.col("ord").cast("long").alias("ord"), "c.*")


def write_index(chunks: DataFrame, path: str) -> None:
    """An index as a folder of Parquet, in place of what is there. ord is a chunk's place; without one it is made from path and chunk."""
    kept = chunks if "ord" in chunks.columns else chunks.withColumn("ord", F.xxhash64("path", "chunk_index"))
    rows = kept.select(F.col("ord").cast("long").alias("ord"), "hash", "path", F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.col("embedding").cast("array<float>").alias("embedding"))
    rows.write.mode("overwrite").parquet(path)


def archive_sessions(records: DataFrame, root: str) -> int:
    """Session records as one JSON file each below root/thinking/session-logs; how many."""
    n = 0
    for r in records.toLocalIterator():
        row = {k: v.isoformat() if isinstance(v, datetime) else v for k, v in r.asDict().items() if k != "file_name"}
        write_text(records.sparkSession, f"{root.rstrip('/')}/thinking/session-logs/{r.file_name}", json.dumps(row, indent=2, ensure_ascii=False))
        n += 1
    return n


def front_matter(head: dict) -> str:
    """A note's head as YAML lines (JSON values are YAML); dates stay plain."""
    lines = [f"{k}: {v if k == 'date' else json.dumps(v, ensure_ascii=False)}" for k, v in head.items()]
    return "---\n" + "\n".join(lines) + "\n---\n\n" if head else ""


def safe(path: str) -> str:
    if posixpath.isabs(path) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"path leaves the vault: {path}")
    return path


HEAD = ("date", "tags", "description", "wing", "vault", "imported_from")


def write_notes(notes: DataFrame, root: str) -> int:
    """Notes (rel_path, content, date, tags, ...) as markdown files with front matter; how many. Spark's file system client writes them, which
    only the driver has: rows stream to it partition by partition, and none but one partition is held there."""
    keys, n = [c for c in HEAD if c in notes.columns], 0
    extra = ["fm"] if "fm" in notes.columns else []
    for r in notes.select("rel_path", "content", *keys, *extra).toLocalIterator():
        head = {k: v for k, v in ((r["fm"] or {}) if extra else {}).items() if k not in keys}
        head |= {k: list(r[k]) if k == "tags" else r[k] for k in keys if r[k] is not None}
        write_text(notes.sparkSession, f"{root.rstrip('/')}/{safe(r.rel_path)}", front_matter(head) + (r.content or ""))
        n += 1
    return n


def copy_routed(routed: DataFrame, source: str, targets: dict[str, str]) -> dict[str, int]:
    """Files of notes (rel_path, vault) copied byte by byte from source to their vault's root, with the folders they need; how many to each."""
    spark, count = routed.sparkSession, dict.fromkeys(targets, 0)
    conf, util = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    for r in routed.select("rel_path", "vault").toLocalIterator():
        old, fs = _fs(spark, f"{source.rstrip('/')}/{safe(r.rel_path)}")
        new, to = _fs(spark, f"{targets[r.vault].rstrip('/')}/{r.rel_path}")
        to.mkdirs(new.getParent())
        util.copy(fs, old, to, new, False, True, conf)
        count[r.vault] += 1
    return count


@dataclass
class VaultConfig:
    """Two vaults and how contents are told apart."""

    shared_path: str | None = None
    personal_path: str | None = None
    isolation_mode: str = "strict"
    default_vault: str = "personal"
    prompt_on_ambiguous: bool = True
    shared_indicators: list[str] = field(default_factory=lambda: list(R.SHARED_INDICATORS))
    personal_indicators: list[str] = field(default_factory=lambda: list(R.PERSONAL_INDICATORS))

    def __post_init__(self):
        if self.isolation_mode not in ("strict", "permissive", "manual") or self.default_vault not in ("shared", "personal"):
            raise ValueError("isolation_mode is strict, permissive or manual; default_vault is shared or personal")

    @property
    def dual(self) -> bool:
        return self.shared_path is not None and self.personal_path is not None

    @classmethod
    def parse(cls, text: str | None) -> VaultConfig:
        """From YAML text with the sections vaults, isolation and classification; defaults for what is missing, and for all if it can't be
        read (which is logged)."""
        base = cls()
        try:
            import yaml

            data = (yaml.safe_load(text) if text else None) or {}
            part = lambda *names: _at(data, *names) or {}
            return cls(
                part("vaults", "shared").get("path"), part("vaults", "personal").get("path"), part("isolation").get("mode", base.isolation_mode),
                part("isolation").get("default_vault", base.default_vault), part("isolation").get("prompt_on_ambiguous", True),
                part("classification").get("shared_indicators", base.shared_indicators), part("classification").get("personal_indicators", base.personal_indicators))
        except ImportError:
            return base
        except Exception as e:  # a broken file must not stop a session
            log.warning("configuration not read: %s", e)
            return base

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VaultConfig:
        return cls.parse(read_text(spark, path)) if exists(spark, path) else cls()

    def dump(self) -> str:
        """YAML text (JSON, which is YAML, without the library)."""
        d = asdict(self)
        vault = lambda path, **more: {"path": path, "access": "read-write", "auto_classify": True, **more}
        vaults = {k: v for k, v in (("shared", self.shared_path and vault(self.shared_path)), ("personal", self.personal_path and vault(self.personal_path, never_sync_to_shared=True))) if v}
        out = {"vaults": vaults, "isolation": {"mode": d["isolation_mode"], "default_vault": d["default_vault"], "prompt_on_ambiguous": d["prompt_on_ambiguous"]},
               "classification": {k: d[k] for k in ("shared_indicators", "personal_indicators")}}
        try:
            import yaml
        except ImportError:
            return json.dumps(out, indent=2)
        return yaml.safe_dump(out, sort_keys=False)

    def save(self, spark: SparkSession, path: str) -> None:
        write_text(spark, path, self.dump())


def _at(data, *names):
    for name in names:
        data = data.get(name) if isinstance(data, dict) else None
    return data if isinstance(data, dict) else None


#: Seconds that the version log may take.
GIT_SECONDS = 5


def git_log(spark: SparkSession, root: str, now: datetime | None = None, hours: int = 48) -> DataFrame | None:
    """(ts, line): a local vault's commits of the last hours without merges, newest first; None if there is no git or it fails or takes long."""
    git = shutil.which("git")
    since = (now or datetime.now(timezone.utc)).astimezone(timezone.utc) - timedelta(hours=hours)
    if git is None:
        return None
    try:
        got = subprocess.run([git, "log", f"--since={since.isoformat()}", "--no-merges", "--format=%ct%x09%h %s"], cwd=root, capture_output=True, text=True, timeout=GIT_SECONDS)
    except (OSError, subprocess.SubprocessError) as e:
        log.debug("git log: %s", e)
        return None
    lines = [x.partition("\t") for x in got.stdout.splitlines()] if got.returncode == 0 else []
    return spark.createDataFrame([(datetime.fromtimestamp(int(t), timezone.utc), line) for t, _, line in lines], "ts timestamp, line string")
