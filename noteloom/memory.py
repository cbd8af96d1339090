"""The facade: a vault with its facts, catalogue and chunk index, as one object over frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import text as T
from .operators import catalogue as C
from .operators import facts as K
from .operators import notes as N
from .operators import reports as P
from .operators import search as S
from .sources import stores, vault
from .streaming import streams

#: Tools whose calls write a file.
WRITES = ("write", "edit", "create_file")


class Memory:
    """A vault at root (or a frame of notes) and its stores below root/.noteloom. embed maps a frame with text to one with embedding; None
    leaves search to keywords. With config naming two vaults, root is the shared one and personal the other's memory."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[DataFrame], DataFrame] | None = S.hash_embed, notes: DataFrame | None = None,
                 config: stores.VaultConfig | None = None):
        self.spark, self.root, self.embed, self.config = spark, root.rstrip("/"), embed, config or stores.VaultConfig()
        at = f"{self.root}/.noteloom"
        self.facts = stores.Versioned(spark, f"{at}/facts", stores.TRIPLES)
        self.entities = stores.Versioned(spark, f"{at}/entities", stores.ENTITIES)
        self.chunks = stores.Versioned(spark, f"{at}/chunks", stores.CHUNKS, "path")
        self.catalogue_path, self._notes, self.hooks = f"{at}/catalogue.json", notes, {}

    @property
    def personal(self) -> Memory:
        if not self.config.dual:
            raise ValueError("there are no two vaults")
        return Memory(self.spark, self.config.personal_path, self.embed)

    @property
    def today(self) -> str:
        return date.today().isoformat()

    def all_notes(self) -> DataFrame:
        return self._notes if self._notes is not None else vault.read(self.spark, self.root)

    def notes(self, exclude=None) -> DataFrame:
        return N.excluding(self.all_notes(), exclude)

    # facts
    def kg_add(self, batch: DataFrame) -> None:
        streams.add_facts(self.facts, self.entities, batch, self.today)

    def kg_add_one(self, subject: str, predicate: str, obj: str, valid_from: str | None = None, source: str | None = None) -> None:
        self.kg_add(self.spark.createDataFrame([(subject, predicate, obj, valid_from, source, 0)],
                    "subject string, predicate string, object string, valid_from string, source_file string, seq bigint"))

    def kg_invalidate(self, closes: DataFrame) -> None:
        keys = closes.select(T.triple_id("subject", "predicate", "object").alias("id"))
        self.facts.merge(keys, lambda old: K.invalidate(old, closes, self.today))

    def kg_query(self, entity: str, as_of: str | None = None) -> DataFrame:
        return K.ordered(K.of_entity(self.facts.read(), entity, as_of or self.today))

    def kg_relation(self, subject: str, predicate: str) -> DataFrame:
        return self.facts.read().where((F.col("subject") == subject) & (F.col("predicate") == predicate)).select(*K.RESULT)

    def kg_timeline(self, entity: str) -> DataFrame:
        keys = self.spark.createDataFrame([(entity,)], "entity string")
        return K.timeline(self.facts.read(), keys).drop("entity").orderBy(F.col("date").asc_nulls_first(), "predicate", "object", "subject")

    def kg_stats(self) -> DataFrame:
        return K.stats(self.facts.read(), self.entities.read(), self.today)

    def kg_populate(self) -> int:
        notes = self.notes()
        facts, entities = K.populate(self.facts.read(), self.entities.read(), notes, self.today)
        self.facts.write(facts)
        self.entities.write(entities)
        return K.attempts(notes).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # notes
    def stats(self) -> DataFrame:
        return N.stats(self.notes())

    def find_orphans(self) -> DataFrame:
        return N.orphans(self.notes())

    def validate(self) -> DataFrame:
        return N.lint(self.all_notes())

    def brain_note(self, name: str) -> DataFrame:
        return N.brain_note(self.all_notes(), name)

    # catalogue
    def catalogue(self) -> C.Catalogue:
        return stores.read_catalogue(self.spark, self.catalogue_path)

    def palace_build(self) -> int:
        built = C.build(self.notes())
        stores.write_catalogue(self.spark, self.catalogue_path, built)
        return built.drawers.count()

    def traverse(self, wing: str, room: str) -> DataFrame:
        return C.traverse(self.catalogue(), self.spark.createDataFrame([(wing, room)], "wing string, room string"))

    # search
    def rebuild_index(self) -> int:
        found = S.chunk(self.notes())
        found = self.embed(found) if self.embed else found.withColumn("embedding", F.lit(None).cast("array<float>"))
        self.chunks.write(found.select("hash", "path", "chunk_index", "text", "embedding"))
        return self.chunks.read().select("path").distinct().count()

    def search(self, query: str, limit: int = 5, hybrid: bool = True, wing: str | None = None, room: str | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(0, query)], "qid int, query string")
        chunks = self.chunks.read().withColumn("ord", F.struct("path", "chunk_index"))
        if not self.chunks.written:
            found = S.keyword_lines(self.notes(), asked, limit)
        elif self.embed is None:
            found = S.keyword_chunks(chunks, asked, limit)
        else:
            with_vector = self.embed(asked.withColumn("text", F.col("query"))).select("qid", "query", "embedding")
            found = S.vector(chunks, with_vector, limit, hybrid)
        if wing or room:
            found = S.in_wing(found, self.spark.createDataFrame([(0, wing, room)], "qid int, wing string, room string"), limit)
        return found.orderBy("rank").drop("qid")

    def search_across(self, other: Memory, query: str, limit: int = 5) -> DataFrame:
        mine, theirs = (m.search(query, limit).withColumn("qid", F.lit(0)).select(*S.RESULT) for m in (self, other))
        return S.across(mine, theirs, limit).orderBy("rank").drop("qid")

    # messages and sessions
    def classify(self, message: str):
        return R.classify(self.spark.createDataFrame([(message,)], "message string")).first()

    def routing_hint(self, message: str) -> str:
        c = self.classify(message)
        return f"[{c.message_type.upper()}] {c.suggested_action}"

    def vault_target(self, message: str) -> str:
        t = self.classify(message).message_type
        return "shared" if t in R.SHARED_TYPES else "personal" if t in R.PERSONAL_TYPES else "ambiguous"

    def session_start(self, now: datetime | None = None, changes: DataFrame | None = None) -> str:
        if not self.facts.written or self.kg_stats().first().triple_count == 0:
            self.kg_populate()
        if changes is None:
            changes = stores.git_log(self.spark, self.root, now)
        day = (now or datetime.now()).strftime("%Y-%m-%d (%A)")
        return P.as_text(P.session_start(self.all_notes(), self.kg_stats(), day, changes)).first().output

    def handle_message(self, message: str) -> str:
        return P.user_message(self.spark.createDataFrame([(message,)], "message string")).first().output

    def post_tool(self, tool: str, file_path: str):
        """The check after a tool call; a note that was written is kept up in the catalogue, the facts and the index."""
        call = self.spark.createDataFrame([(0, tool, file_path, None)], "call_id int, tool string, file_path string, path string")
        every = self.all_notes()
        if tool in WRITES and file_path.endswith(".md"):
            self.keep_up(every.where(F.col("rel_path") == file_path))
        return N.post_tool(call, every).first()

    def keep_up(self, notes: DataFrame) -> None:
        """Written notes in the facts and, if there is one, the index; each makes its room in the catalogue anew."""
        streams.add_notes(notes, self.today, self.facts, self.entities, chunks=self.chunks if self.chunks.written else None, embed=self.embed)
        made = C.touched(notes)
        if made.limit(1).count():
            stores.write_catalogue(self.spark, self.catalogue_path, C.with_rooms(self.catalogue(), made))

    def pre_compact(self, transcript: str, session: str, now: datetime | None = None, agent: str = "agent") -> str:
        """Archives a session's transcript as a file of its own."""
        turns = self.spark.createDataFrame([(session, transcript)], "conv_id string, line string")
        kept = turns.select("conv_id", F.length("line").cast("long").alias("transcript_length"), F.right("line", F.lit(P.TAIL)).alias("transcript_excerpt"))
        records = P.session_records(kept, agent, (now or datetime.now()).isoformat())
        name = records.first().file_name
        stores.archive_sessions(records, self.root)
        return f"(Archived session log to thinking/session-logs/{name})"

    def stop(self) -> str:
        return P.as_text(P.stop(self.all_notes(), self.kg_stats())).first().output

    wrap_up = stop
    standup = session_start

    def register_hook(self, name: str, hook: Callable[[Memory], str]) -> None:
        self.hooks[name] = hook

    def run_hook(self, name: str) -> str:
        return self.hooks[name](self)

    # writing
    def update_brain(self, name: str, content: str, append: bool = False) -> None:
        """brain/<name>.md written anew (its head goes), or content appended to it; then kept up in all stores."""
        if not vault.inside("brain", f"{name}.md") or "/" in name:
            raise ValueError(f"no name of a brain note: {name}")
        path = f"brain/{name}.md"
        there = self.all_notes().where(F.col("rel_path") == path) if append else None
        old = there.withColumn("content", F.concat("content", F.lit("\n"), F.lit(content))) if append else None
        if old is None or not old.limit(1).count():
            old = self.spark.createDataFrame([(path, content, {})], "rel_path string, content string, fm map<string,string>")
        stores.write_notes(old, self.root)
        self.keep_up(self.all_notes().where(F.col("rel_path") == path))

    def write(self, contents: DataFrame) -> DataFrame:
        """Contents written where they belong; their facts are added."""
        rows = P.written(contents, self.today, self.config.default_vault, self.config.isolation_mode == "manual", self.config.dual)
        for name, at in (("shared", self.config.shared_path or self.root), ("personal", self.config.personal_path)):
            own = rows.where(F.col("vault") == name)
            if at and stores.write_notes(own, at):
                m = Memory(self.spark, at, self.embed)
                m.keep_up(m.all_notes().join(own.select("rel_path"), "rel_path", "left_semi"))
        return rows

    def _given(self, memory: Memory, paths: list[str]) -> DataFrame:
        found = memory.all_notes().where(F.col("rel_path").isin(paths))
        missing = set(paths) - {r.rel_path for r in found.select("rel_path").collect()}
        if missing:
            raise FileNotFoundError(f"no such note: {sorted(missing)[0]}")
        return found

    def export(self, paths: list[str], confirm: bool = True, sanitize: bool = True) -> DataFrame:
        """(rel_path, action, content) for notes of the personal vault: in strict mode a preview until it is confirmed (confirm=False), then
        the redacted notes are written to the shared vault, with their facts."""
        found = self._given(self.personal, paths)
        told = P.exported(found, self.config.isolation_mode == "strict", confirm, sanitize)
        if told.first().action == "exported":
            head = F.map_filter(F.coalesce("fm", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("@private", "vault"))
            new = told.join(found.withColumn("fm", head).drop("content"), "rel_path").withColumn("vault", F.lit("shared"))
            stores.write_notes(new, self.config.shared_path)
            to = Memory(self.spark, self.config.shared_path, self.embed)
            to.keep_up(self._given(to, paths))
        return told

    def import_notes(self, paths: list[str], link_back: bool = True) -> DataFrame:
        """Notes of the shared vault copied to the personal one, marked and with a link back; their facts are added there."""
        to, source = self.personal, Memory(self.spark, self.config.shared_path)
        found = self._given(source, paths)
        head = F.map_filter(F.coalesce("fm", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("vault", "imported_from"))
        new = P.imported(found.withColumn("fm", head), F.concat(F.lit(self.config.shared_path.rstrip("/") + "/"), "rel_path"), link_back)
        stores.write_notes(new, to.root)
        to.keep_up(self._given(to, paths))
        return new

    def migrate(self, shared: str, personal: str, classify: bool = True, config_path: str | None = None) -> dict:
        """Every note's file copied to the one or the other vault; the configuration then names both, and is saved if a path is given."""
        routed = P.routed(self.notes(), self.config.default_vault, classify)
        count = stores.copy_routed(routed, self.root, {"shared": shared, "personal": personal})
        self.config = replace(self.config, shared_path=shared, personal_path=personal)
        if config_path:
            self.config.save(self.spark, config_path)
        return {"shared_notes": count["shared"], "personal_notes": count["personal"], "config_saved": config_path}

    def sync(self) -> dict:
        """All stores made anew; with two vaults the personal facts and catalogue too."""
        out = {"kg_triples": self.kg_populate(), "palace_wings": self.palace_build(), "indexed_files": self.rebuild_index()}
        if self.config.dual:
            other = self.personal
            out |= {"personal_kg_triples": other.kg_populate(), "personal_palace_wings": other.palace_build()}
        return out

    def from_template(self, name: str, target: str, values: dict) -> DataFrame:
        """A note written from templates/<name>.md (of a path its last part) with its places filled; the template's head stays."""
        at = f"templates/{name.replace(chr(92), '/').rpartition('/')[2]}.md"
        made = self._given(self, [at]).withColumns({"rel_path": F.lit(stores.safe(target)), "content": T.fill("content", values)})
        stores.write_notes(made, self.root)
        return made

    def init(self) -> dict:
        """The vault's folders."""
        for folder in N.FOLDERS:
            at, fs = stores._fs(self.spark, f"{self.root}/{folder}")
            fs.mkdirs(at)
        seen = self.stats().first()
        return {"success": True, "initialized": self.root, "notes": seen.total_notes, "brain_notes": seen.brain_notes}
