"""Registered queries over the fixtures: each applies one operator, or a few, to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import catalogue as C
from ..operators import facts as K
from ..operators import notes as N
from ..operators import reports as P
from ..operators import search as S
from . import fixtures as X

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def notes(spark, d, all_=False):
    n = X.frame(spark, d, X.NOTES)
    return n if all_ else N.excluding(n)


def windows(spark, d):
    return X.frame(spark, d, X.TRIPLES).withColumn("id", T.triple_id("subject", "predicate", "object"))


def days(spark):
    return spark.range(1, 31).select(F.format_string("2024-01-%02d", "id").alias("as_of"))


def both_ends(triples):
    """Different entities, in one pass."""
    return triples.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()


@query
def kg_asof_facts(spark, d):
    """Flagship: for every user and every object, the facts that hold on three days."""
    t = windows(spark, d)
    keys = both_ends(t).select("entity", F.explode(F.lit(["2024-01-05", "2024-01-15", ""])).alias("as_of"))
    return K.as_of(t, keys, X.TODAY)


@query
def kg_triples_upsert(spark, d):
    return K.upsert(None, X.frame(spark, d, X.TRIPLES_RAW), X.TODAY)


@query
def kg_triples_reupsert(spark, d):
    """A batch over a store with closed windows: facts that come again are opened again."""
    return K.upsert(windows(spark, d), X.frame(spark, d, X.TRIPLES_RAW), X.TODAY)


@query
def kg_entities(spark, d):
    batch = K.entities_of(X.frame(spark, d, X.TRIPLES_RAW))
    typed = X.frame(spark, d, X.TRIPLES_RAW).select(F.col("object").alias("name"), F.lit("key").alias("type"), F.struct((F.col("seq") - 1).alias("seq"), F.lit(2).alias("end")).alias("seq"))
    return K.upsert_entities(None, batch.unionByName(typed))


@query
def kg_asof_grid(spark, d):
    return K.grid(windows(spark, d), days(spark))


@query
def kg_relation(spark, d):
    """Every (subject, predicate) pair there is, and one that isn't."""
    t = windows(spark, d)
    keys = t.select("subject", "predicate").distinct().union(spark.createDataFrame([("user:none", "click")], "subject string, predicate string"))
    return K.relation(t, keys)


@query
def kg_timeline(spark, d):
    t = windows(spark, d)
    return K.timeline(t, both_ends(t))


@query
def kg_invalidate(spark, d):
    """Every fact is closed twice; the first close counts, and only for facts that are open."""
    t = windows(spark, d)
    first = t.select("subject", "predicate", "object", F.when(F.col("seq") % 2 == 0, F.lit("2024-02-01")).alias("ended"), F.lit(0).alias("seq"))
    again = t.select("subject", "predicate", "object", F.lit("2024-03-01").alias("ended"), F.lit(1).alias("seq"))
    return K.invalidate(t, first.union(again), X.TODAY)


@query
def kg_stats(spark, d):
    raw = X.frame(spark, d, X.TRIPLES_RAW)
    return K.stats(windows(spark, d), K.upsert_entities(None, K.entities_of(raw)), X.TODAY)


@query
def kg_populate(spark, d):
    return K.populate(None, None, notes(spark, d), X.TODAY)[0]


@query
def kg_populate_entities(spark, d):
    return K.populate(None, None, notes(spark, d), X.TODAY)[1].select("id", "name", "type")


@query
def kg_populate_counts(spark, d):
    return K.attempts(notes(spark, d))


@query
def notes_links(spark, d):
    return N.links(notes(spark, d))


@query
def notes_resolve(spark, d):
    return N.resolve(notes(spark, d))


@query
def notes_orphans(spark, d):
    return N.orphans(notes(spark, d)).select("rel_path")


@query
def notes_folder_counts(spark, d):
    return N.folder_counts(notes(spark, d))


@query
def notes_stats(spark, d):
    return N.stats(notes(spark, d))


@query
def notes_lint(spark, d):
    return N.lint(notes(spark, d, True)).withColumn("warnings", F.array_join("warnings", "; "))


@query
def notes_lint_report(spark, d):
    return N.lint_report(notes(spark, d, True))


@query
def notes_posttool_lint(spark, d):
    n = notes(spark, d, True)
    calls = n.select(F.col("ord").alias("call_id"), F.expr("case ord % 5 when 0 then 'read' when 1 then 'write' when 2 then 'edit' else 'create_file' end").alias("tool"),
                     F.expr("case when ord % 9 = 0 then '' when ord % 9 = 4 then 'a.txt' when ord % 9 = 7 then concat('gone/', rel_path) else rel_path end").alias("file_path"),
                     F.expr("case when ord % 18 = 9 then rel_path end").alias("path"))
    return N.post_tool(calls, n)


@query
def notes_search_name(spark, d):
    asked = spark.createDataFrame([(1, "N1"), (2, "50"), (3, "n%"), (4, "n99")], "qid int, query string")
    return N.by_name(notes(spark, d), asked, 8)


@query
def notes_room_paths(spark, d):
    return C.touched(notes(spark, d))


@query
def page_links(spark, d):
    """Links of raw pages: how often each is used and on how many pages."""
    p = spark.read.parquet(f"{d}/pages.parquet").where("html is not null")
    found = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return found.groupBy("href").agg(F.count("*").alias("uses"), F.count_distinct("page_id").alias("pages"))


def messages(spark, d):
    return X.frame(spark, d, X.MESSAGES)


@query
def msg_classify(spark, d):
    c = R.classify(messages(spark, d))
    return c.select("conv_id", "turn", "message_type", F.round("confidence", 6).alias("confidence"), "suggested_folder", "suggested_action", F.size("routing_hints").alias("n_hints"))


@query
def msg_routing(spark, d):
    c = R.classify(messages(spark, d))
    return c.groupBy(R.routing_hint("message_type", "suggested_action").alias("hint"), R.vault_target("message_type").alias("vault")).agg(F.count("*").alias("n"))


@query
def msg_hook(spark, d):
    return P.user_message(messages(spark, d)).select("conv_id", "turn", "output", "tokens_hint")


@query
def msg_rule_scores(spark, d):
    m = messages(spark, d).select(F.explode(R.rule_scores("message")).alias("r")).where("r.score > 0")
    return m.groupBy(F.col("r.type").alias("message_type")).agg(F.count("*").alias("messages"), F.sum("r.score").alias("score"))


@query
def content_route(spark, d):
    s = X.frame(spark, d, X.SECRETS)
    return s.select("doc_id", R.content_target("content", "tags", "rel_path").alias("vault"))


@query
def content_redact(spark, d):
    return X.frame(spark, d, X.SECRETS).select("doc_id", R.redact("content").alias("content"))


@query
def content_export_preview(spark, d):
    return P.exported(X.frame(spark, d, X.SECRETS))


@query
def content_import(spark, d):
    return P.imported(X.frame(spark, d, X.SECRETS)).select("doc_id", "vault", "imported_from", "content")


@query
def migrate_counts(spark, d):
    return P.routed(X.frame(spark, d, X.SECRETS)).groupBy("vault").agg(F.count("*").alias("notes"))


@query
def auto_filename(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.select("doc_id", T.file_name("text", F.lit("thinking/")).alias("rel_path"))


@query
def chunks(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return S.chunk(docs.select(F.concat(F.lit("d"), "doc_id").alias("rel_path"), F.col("text").alias("content")))


def asked(spark, d):
    """The query set of searches: every row whose id is divisible by 20."""
    return X.frame(spark, d, X.CHUNKS).where("ord % 20 = 0").select(
        F.col("ord").alias("qid"), F.array_join(F.slice(T.words("text"), 1, 6), " ").alias("query"), "embedding")


@query
def search_keyword_chunk(spark, d):
    q = spark.createDataFrame([(1, "the and"), (2, "DE LA"), (3, "zzzz"), (4, "%")], "qid int, query string")
    return S.keyword_chunks(X.frame(spark, d, X.CHUNKS), q, 7)


@query
def search_keyword_line(spark, d):
    q = spark.createDataFrame([(1, "the and"), (2, "DATE:"), (3, "zzzz")], "qid int, query string")
    return S.keyword_lines(notes(spark, d), q, 7)


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query
def search_vector(spark, d):
    return _rounded(S.vector(X.frame(spark, d, X.CHUNKS), asked(spark, d), 5))


@query
def search_hybrid(spark, d):
    return _rounded(S.vector(X.frame(spark, d, X.CHUNKS), asked(spark, d), 5, hybrid=True))


@query
def search_vector_blocks(spark, d):
    return _rounded(S.vector(X.frame(spark, d, X.CHUNKS), asked(spark, d), 5, hybrid=True, block=8, part=300))


@query
def search_wing_fallback(spark, d):
    found = S.vector(X.frame(spark, d, X.CHUNKS), asked(spark, d), 6)
    wings = asked(spark, d).select("qid", F.concat(F.lit("wing"), (F.col("qid") % 10).cast("string")).alias("wing"), F.lit(None).cast("string").alias("room"))
    return _rounded(S.in_wing(found, wings, 5))


@query
def search_cross_vault(spark, d):
    c = X.frame(spark, d, X.CHUNKS)
    q = asked(spark, d)
    return _rounded(S.across(S.vector(c.where("ord % 2 = 0"), q, 5), S.vector(c.where("ord % 2 = 1"), q, 5), 5))


def catalogue(spark, d):
    f = lambda sql: X.frame(spark, d, sql)
    halls = spark.createDataFrame([], "wing string, room string, hall_type string, content string")
    return C.Catalogue(f(X.WINGS).withColumn("keywords", F.array().cast("array<string>")), f(X.ROOMS), f(X.DRAWERS), halls, f(X.TUNNELS))


@query
def palace_build(spark, d):
    c = C.build(notes(spark, d))
    return c.drawers.join(c.wings.withColumnRenamed("name", "wing"), "wing").select("wing", "type", "room", "path")


@query
def palace_stats(spark, d):
    return C.stats(catalogue(spark, d))


@query
def palace_rooms(spark, d):
    return C.room_counts(catalogue(spark, d))


@query
def palace_tunnels(spark, d):
    pairs = X.frame(spark, d, X.WINGS).select("name").alias("a").join(X.frame(spark, d, X.WINGS).select("name").alias("b"), F.expr("a.name > b.name"))
    return C.between(catalogue(spark, d).tunnels, pairs.select(F.col("a.name").alias("wing_1"), F.col("b.name").alias("wing_2")))


@query
def palace_traverse(spark, d):
    return C.traverse(catalogue(spark, d), X.frame(spark, d, X.ROOMS))


@query
def palace_document(spark, d):
    """A round trip through the catalogue's document."""
    c = C.from_document(C.to_document(catalogue(spark, d)))
    return c.rooms.join(c.drawers, ["wing", "room"], "left").groupBy("wing", "room").agg(F.count("path").alias("drawers"), F.min_by("path", "ord").alias("first"))


@query
def session_archive(spark, d):
    return P.archive(spark.read.parquet(f"{d}/conversations.parquet"))


def _fact_stats(spark, d):
    return kg_stats(spark, d)


@query
def report_session_start(spark, d):
    changes = spark.read.parquet(f"{d}/events.parquet").select("ts", F.concat_ws(" ", F.hex("event_id"), "event_type").alias("line"))
    return P.session_start(notes(spark, d, True), _fact_stats(spark, d), "2024-01-20 (Saturday)", changes)


@query
def report_stop(spark, d):
    return P.stop(notes(spark, d, True), _fact_stats(spark, d))


@query
def sync_counts(spark, d):
    n = notes(spark, d)
    return P.sync(n, S.chunk(n), C.build(n).wings)


@query
def write_routes(spark, d):
    """Where new contents are written: vault and file."""
    s = X.frame(spark, d, X.SECRETS).select("doc_id", "content", "tags", F.expr("case when doc_id % 2 = 0 then rel_path end").alias("file_path"), F.lit(None).cast("string").alias("vault"))
    return P.written(s, X.TODAY).groupBy("vault", F.get(F.split("rel_path", "/"), F.lit(0)).alias("folder")).agg(F.count("*").alias("n"))


@query
def section_extract(spark, d):
    """Sections of notes, or their start."""
    n = notes(spark, d).select("rel_path", F.expr("case when ord % 4 = 0 then concat('intro\n## Current Focus\n', content, '\n## Next\nx') else content end").alias("content"))
    return n.select("rel_path", T.section_or_start("content", "Current Focus").alias("focus"))


@query
def rpc_guard(spark, d):
    """The guard in front of the tools, over many requests."""
    from .. import rpc

    m = messages(spark, d).select("conv_id", "turn", F.expr("case turn % 4 when 0 then 'ao_search' when 1 then 'ao_classify' when 2 then 'rm' else 'ao_status' end").alias("name"),
                                  F.expr("map('vault_path', case conv_id % 5 when 0 then '/' when 1 then 'a/../b' else 'vault' end, 'limit', cast(conv_id * 40 as string))").alias("arguments"))
    return rpc.guarded(m).groupBy("error", "limit").agg(F.count("*").alias("requests"))


@query
def index_update(spark, d):
    """Chunks after some notes were written anew and others removed."""
    n = notes(spark, d)
    new = n.where("ord % 10 = 0").withColumn("content", F.concat(F.lit("rewritten "), "content"))
    return S.update_chunks(S.chunk(n), new, n.where("ord % 10 = 4").select(F.col("rel_path").alias("path")))


@query
def user_sessions(spark, d):
    """Sessions of users by gaps of half an hour."""
    from ..streaming import streams

    return streams.session_counts(spark.read.parquet(f"{d}/events.parquet")).select("user_id", F.col("session.start").alias("began"), "last", "messages")


@query
def notes_with_links(spark, d):
    return notes(spark, d).where(N.has_links()).select("rel_path")


@query
def palace_point_lookup(spark, d):
    """Drawers of given rooms; rooms that aren't there have none."""
    asked = X.frame(spark, d, X.ROOMS).union(spark.createDataFrame([("NOWHERE", "x")], "wing string, room string"))
    return C.lookup(catalogue(spark, d), asked)


def replayed(spark, d):
    return C.replay(X.frame(spark, d, X.OPS).withColumn("keywords", F.lit(None).cast("array<string>")))


@query
def palace_replay_drawers(spark, d):
    """Drawers after a log of operations: wings and rooms made again lose what they held."""
    return replayed(spark, d).drawers


@query
def palace_replay_halls(spark, d):
    return replayed(spark, d).halls


@query
def palace_replay_tunnels(spark, d):
    """Tunnels after the log, of one room's name."""
    return C.by_room(replayed(spark, d).tunnels, "click")


@query
def template_fill(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", T.fill(F.lit("# {{lang}}\n{{body}} {{other}}"), {"lang": F.col("lang"), "body": F.coalesce("text", F.lit(""))}).alias("content"))


@query
def text_measures(spark, d):
    """Tokens that a text is estimated at, and the tags that its first line would give as an argument."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.select("doc_id", T.token_estimate("text").alias("tokens"), F.array_join(T.tag_list(F.get(F.split("text", "\n"), F.lit(0))), "|").alias("tags"))


@query
def day_headings(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.groupBy(T.day_heading("ts").alias("day")).agg(F.count("*").alias("events"))


@query
def sync_counts_dual(spark, d):
    """Synchronisation with a personal vault beside the shared one."""
    n = notes(spark, d)
    mine = n.where("ord % 4 = 0")
    return P.sync(n, S.chunk(n), C.build(n).wings, mine, C.build(mine).wings)
