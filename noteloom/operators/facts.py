"""The temporal fact store: triples with validity windows, as DataFrames.

triples: id, subject, predicate, object, valid_from, valid_to, confidence, source_file (dates are ISO texts, compared as text).
entities: id, name, type. Many keys, dates and facts at a time; one key is a frame of one row. Today is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pairs import paired

COLUMNS = ["id", "subject", "predicate", "object", "valid_from", "valid_to", "confidence", "source_file"]
RESULT = COLUMNS[1:]


def as_triples(batch: DataFrame, today: str) -> DataFrame:
    """Facts to add, with ids and defaults: (subject, predicate, object, seq, ...). An empty or missing valid_from is today."""
    have = set(batch.columns)
    value = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    start = F.coalesce(F.nullif(value("valid_from", "string"), F.lit("")), F.lit(today))
    return batch.select(
        T.triple_id("subject", "predicate", "object").alias("id"), "subject", "predicate", "object",
        start.alias("valid_from"), value("valid_to", "string").alias("valid_to"),
        F.coalesce(value("confidence", "double"), F.lit(1.0)).alias("confidence"), value("source_file", "string").alias("source_file"), "seq")


def _latest(rows: DataFrame) -> DataFrame:
    """The row of highest (gen, seq) for each id: an aggregate, so repeats are reduced before the shuffle."""
    best = F.max_by(F.struct(*COLUMNS[1:]), F.struct("gen", "seq")).alias("r")
    return rows.groupBy("id").agg(best).select("id", *[f"r.{c}" for c in COLUMNS[1:]])


def upsert(triples: DataFrame | None, batch: DataFrame, today: str) -> DataFrame:
    """triples with a batch added in order of seq (of any type that has an order). A fact that is there is replaced with its window, confidence and source."""
    new = as_triples(batch, today).withColumn("gen", F.lit(1))
    if triples is not None:
        none = F.lit(None).cast(new.schema["seq"].dataType)
        new = triples.select(*COLUMNS).withColumn("seq", none).withColumn("gen", F.lit(0)).unionByName(new)
    return _latest(new)


def upsert_entities(entities: DataFrame | None, batch: DataFrame) -> DataFrame:
    """entities with a batch (name, type, seq) added: the first type of a name stays."""
    new = batch.select(T.entity_id("name").alias("id"), "name", F.coalesce("type", F.lit("unknown")).alias("type"), "seq", F.lit(1).alias("gen"))
    if entities is not None:
        none = F.lit(None).cast(new.schema["seq"].dataType)
        new = entities.select("id", "name", "type").withColumn("seq", none).withColumn("gen", F.lit(0)).unionByName(new)
    return new.groupBy("id").agg(F.min_by(F.struct("name", "type"), F.struct("gen", "seq")).alias("r")).select("id", "r.name", "r.type")


def entities_of(batch: DataFrame) -> DataFrame:
    """(name, type, seq) of both ends of every fact; literals such as tags and dates count as well."""
    ends = F.explode(F.array(F.struct(F.col("subject").alias("name"), F.lit(0).alias("end")), F.struct(F.col("object").alias("name"), F.lit(1).alias("end"))))
    return batch.select("seq", ends.alias("e")).select("e.name", F.lit("unknown").alias("type"), F.struct("seq", F.col("e.end").alias("end")).alias("seq"))


def invalidate(triples: DataFrame, closes: DataFrame, today: str) -> DataFrame:
    """triples with the open facts named in closes (subject, predicate, object, ended) ended, on today if ended is missing. Of several
    closes of a fact the first in order of seq counts, without seq the earliest day."""
    day = F.coalesce(F.nullif("ended", F.lit("")), F.lit(today))
    first = F.min_by(day, "seq") if "seq" in closes.columns else F.min(day)
    ends = closes.groupBy("subject", "predicate", "object").agg(first.alias("_ended"))
    key = ["subject", "predicate", "object"]
    hit = F.col("valid_to").isNull() & F.col("_ended").isNotNull()
    return triples.join(ends, key, "left").withColumn("valid_to", F.when(hit, F.col("_ended")).otherwise(F.col("valid_to"))).select(*COLUMNS)


def touching(triples: DataFrame, keys: DataFrame, entity: str = "entity") -> DataFrame:
    """keys joined to the facts they are an end of: each fact stands once for each of its different ends, so it is one equi-join over
    one pass of the facts. (A join on 'subject or object' would be a cartesian product.)"""
    ends = triples.withColumn("_end", F.explode(F.array_distinct(F.array("subject", "object"))))
    return keys.join(ends, F.col(entity) == F.col("_end")).drop("_end")


def of_entity(triples: DataFrame, entity: str, day: str) -> DataFrame:
    """One entity's facts on one day: a filter that reaches the scan."""
    return triples.where(((F.col("subject") == entity) | (F.col("object") == entity)) & holds(F.lit(day))).select(*RESULT)


def holds(day) -> F.Column:
    """Validity on a day; both ends belong to the window, a missing end is open."""
    d = T.col(day)
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d))


def as_of(triples: DataFrame, keys: DataFrame, today: str) -> DataFrame:
    """The facts of each entity valid on its as_of day (today, if missing): keys' columns and the facts' columns."""
    day = F.coalesce(F.nullif("as_of", F.lit("")), F.lit(today))
    return touching(triples, keys.withColumn("as_of", day)).where(holds("as_of")).select(*keys.columns, *RESULT)


def ordered(facts: DataFrame) -> DataFrame:
    """Latest start first, open starts last; ties by predicate, object and subject."""
    return facts.orderBy(F.col("valid_from").desc_nulls_last(), "predicate", "object", "subject")


def grid(triples: DataFrame, days: DataFrame) -> DataFrame:
    """How many facts of each subject hold on each of the days (a calendar)."""
    return paired(triples, days, holds("as_of")).groupBy("subject", "as_of").agg(F.count("*").alias("facts"))


def relation(triples: DataFrame, keys: DataFrame) -> DataFrame:
    """Facts of given (subject, predicate) pairs at any time."""
    return triples.join(keys, ["subject", "predicate"]).select(*RESULT)


def timeline(triples: DataFrame, keys: DataFrame) -> DataFrame:
    """The events of each entity: (entity, date, end_date, direction, subject, predicate, object, label, source)."""
    out = F.col("entity") == F.col("subject")
    label = F.concat("subject", F.lit(" --"), "predicate", F.lit("--> "), "object")
    return touching(triples, keys.select("entity")).select(
        "entity", F.col("valid_from").alias("date"), F.col("valid_to").alias("end_date"),
        F.when(out, "outbound").otherwise("inbound").alias("direction"), "subject", "predicate", "object",
        label.alias("label"), F.col("source_file").alias("source"))


def stats(triples: DataFrame, entities: DataFrame, today: str) -> DataFrame:
    """One row of counts. A fact is current if it has not ended, even if it has not begun."""
    current = F.count_if(F.col("valid_to").isNull() | (F.col("valid_to") >= today))
    facts = triples.agg(F.count("*").alias("triple_count"), current.alias("current_facts"),
                        F.min("valid_from").alias("oldest_fact"), F.max("valid_from").alias("newest_fact"))
    names = entities.agg(F.count("*").alias("entity_count"))
    return facts.join(names).select(  # two rows of totals
        "entity_count", "triple_count", "current_facts", (F.col("triple_count") - F.col("current_facts")).alias("expired_facts"),
        "oldest_fact", "newest_fact")


def candidates(notes: DataFrame, today: str) -> DataFrame:
    """The facts that notes state, in order: (subject, predicate, object, valid_from, source_file, ord, at).

    notes: ord, stem, rel_path, content, tags, date. Links keep a final .md here."""
    row = lambda p, o, d=None: F.struct(F.lit(p).alias("predicate"), o.alias("object"), (F.lit(None).cast("string") if d is None else d).alias("valid_from"))
    parts, day = T.path_parts("rel_path"), F.substring("date", 1, 10)
    one = lambda p, o, d=None: F.array(row(p, o, d))
    every = F.concat(
        F.transform(T.link_targets("content", strip_md=False), lambda x: row("links_to", x)),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: row("has_tag", x)),
        one("in_folder", T.folder(parts)), one("in_subfolder", T.subfolder(parts)), one("created_on", F.nullif(day, F.lit("")), day))
    return notes.select("ord", "stem", "rel_path", F.posexplode(every).alias("at", "f")).where("f.object is not null").select(
        F.col("stem").alias("subject"), "f.predicate", "f.object", F.coalesce("f.valid_from", F.lit(today)).alias("valid_from"),
        F.col("rel_path").alias("source_file"), "ord", "at")


def attempts(notes: DataFrame) -> DataFrame:
    """(rel_path, n): the facts each note attempts to add; repeats and a description of over ten characters count."""
    parts, yes = T.path_parts("rel_path"), lambda c: F.coalesce(c, F.lit(False)).cast("int")
    n = (F.size(T.link_targets("content", strip_md=False)) + F.size(F.coalesce("tags", F.array().cast("array<string>")))
         + yes(T.folder(parts).isNotNull()) + yes(T.subfolder(parts).isNotNull())
         + yes(F.nullif("date", F.lit("")).isNotNull()) + yes(F.length("description") > 10))
    return notes.select("rel_path", n.cast("long").alias("n"))


def note_entities(notes: DataFrame, found: DataFrame) -> DataFrame:
    """(name, type, seq) of the entities that notes state: the ends of their facts (found, with seq), and notes that describe themselves."""
    after = F.struct(F.struct("ord", F.lit((1 << 31) - 1).alias("at")).alias("seq"), F.lit(0).alias("end")).alias("seq")
    described = notes.where(F.length("description") > 10).select(F.col("stem").alias("name"), F.lit("note").alias("type"), after)
    return entities_of(found).unionByName(described)


def populate(triples: DataFrame | None, entities: DataFrame | None, notes: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(triples, entities) after the notes' facts are added: facts that were there are opened again."""
    found = candidates(notes, today).withColumn("seq", F.struct("ord", "at"))
    return upsert(triples, found, today), upsert_entities(entities, note_entities(notes, found))
