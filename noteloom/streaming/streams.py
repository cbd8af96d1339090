"""Streams: message classification, incremental stores, sessions and transcript archives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import catalogue as C
from ..operators import facts as K
from ..operators import reports as P
from ..operators import search as S
from ..sources.stores import Versioned


def classified(messages: DataFrame, message: str = "message") -> DataFrame:
    """A stream of messages with their classification; no state."""
    return R.classify(messages, message)


def add_facts(facts: Versioned, entities: Versioned, batch: DataFrame, today: str) -> None:
    """Facts (subject, predicate, object, ..., seq) merged into the buckets of the stores that they touch."""
    facts.merge(K.as_triples(batch, today), lambda old: K.upsert(old, batch, today))
    names = K.entities_of(batch)
    entities.merge(names.select(T.entity_id("name").alias("id")), lambda old: K.upsert_entities(old, names))


def add_notes(notes: DataFrame, today: str, facts: Versioned, entities: Versioned, drawers: Versioned | None = None, chunks: Versioned | None = None,
              embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Written notes kept up in the facts, in the catalogue's drawers (a write makes its room anew) and in the index (a note's
    chunks are replaced), each by the buckets that it touches."""
    found = K.candidates(notes, today).withColumn("seq", F.struct("ord", "at"))
    facts.merge(K.as_triples(found, today), lambda old: K.upsert(old, found, today))
    names = K.note_entities(notes, found)
    entities.merge(names.select(T.entity_id("name").alias("id")), lambda old: K.upsert_entities(old, names))
    if drawers is not None:
        new = C.touched(notes).select("wing", "room", "path")
        drawers.merge(new, lambda old: old.join(new, ["wing", "room"], "left_anti").select("wing", "room", "path").union(new))
    if chunks is not None:
        made = S.chunk(notes)
        made = embed(made) if embed else made.withColumn("embedding", F.lit(None).cast("array<float>"))
        made, paths = made.select("hash", "path", "chunk_index", "text", "embedding"), notes.select(F.col("rel_path").alias("path"))
        chunks.merge(paths, lambda old: old.join(paths.distinct(), "path", "left_anti").select(*made.columns).union(made))


def facts_into(facts: Versioned, entities: Versioned, today: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: facts merged into the stores in order of seq, not of event time,
    since a late fact counts as any other. Ids are made from the texts, so a batch run twice changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        batch.persist()
        add_facts(facts, entities, batch, today)
        batch.unpersist()

    return merge


def notes_into(facts: Versioned, entities: Versioned, drawers: Versioned, today: str, chunks: Versioned | None = None,
               embed: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: written notes kept up in all stores."""

    def merge(batch: DataFrame, _: int) -> None:
        batch.persist()
        add_notes(batch, today, facts, entities, drawers, chunks, embed)
        batch.unpersist()

    return merge


def session_counts(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by gaps between events (ts): their messages, from streams or batches; rows later than `late` are left out."""
    return (
        messages.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id")
        .agg(F.count("*").alias("messages"), F.max("ts").alias("last")))


def last_types(messages: DataFrame) -> DataFrame:
    """The last classification of each session (conv_id) so far: a streaming aggregate."""
    return R.classify(messages).groupBy("conv_id").agg(F.max_by("message_type", "turn").alias("last_type"), F.count("*").alias("messages"))


def archive_into(path: str, agent: str, ts: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: transcripts archived as JSON, one folder for each batch, so that a repeated batch replaces itself."""

    def merge(batch: DataFrame, number: int) -> None:
        P.session_records(P.archive(batch), agent, ts).write.mode("overwrite").json(f"{path}/batch-{number}")

    return merge
