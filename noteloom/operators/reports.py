"""Session reports as rows of lines, and their texts; session records; status and synchronisation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import facts, notes as N

# Numbers of lines shown, and characters of a transcript kept.
FILES, ACTIVE, ORPHANS, CHANGES, HINTS, TAIL, TOOL_ORPHANS = 30, 5, 5, 10, 2, 2000, 20
BUDGETS = {"session_start": 2000, "user_message": 100, "post_tool": 200, "pre_compact": 100, "stop": 500}


def _one(spark, section: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, i, x) for i, x in enumerate(lines)], "section int, at int, line string")


def _listed(df: DataFrame, section: int, line, order: list, most: int, start: int = 1) -> DataFrame:
    """At most `most` lines of a section, by order: take-ordered, so each task keeps that many."""
    top = df.select(line.alias("line"), *[c.alias(f"_o{i}") for i, c in enumerate(order)]).orderBy(*[f"_o{i}" for i in range(len(order))]).limit(most)
    rows = top.agg(F.sort_array(F.collect_list(F.struct(*[f"_o{i}" for i in range(len(order))], "line"))).alias("x"))
    return rows.select(F.posexplode("x").alias("at", "x")).select(F.lit(section).alias("section"), (F.col("at") + start).alias("at"), F.col("x.line").alias("line"))


def session_start(notes: DataFrame, fact_stats: DataFrame, day: str, changes: DataFrame | None = None) -> DataFrame:
    """(section, at, line) of the report at a session's start. notes: all; fact_stats: facts.stats(); changes: (ts, line) of the last
    48 hours, None without a change log."""
    spark, seen = notes.sparkSession, N.excluding(notes)
    star = N.brain_note(notes, "North Star").select(F.posexplode(F.array(
        F.lit("### North Star (Current Goals)"), T.section_or_start("content", "Current Focus"), F.lit(""))).alias("at", "line"))
    out = _one(spark, 0, ["## Session Context", f"**Date:** {day}", ""]).union(star.select(F.lit(1), "at", "line"))
    out = out.union(_one(spark, 2, ["### Recent Changes (last 48h)"]))
    if changes is None:
        out = out.union(_one(spark, 2, ["", "(git not available)", ""]).where("at > 0"))
    else:
        shown = _listed(changes, 2, F.concat(F.lit("- "), "line"), [-F.unix_micros(F.col("ts").cast("timestamp")), F.col("line")], CHANGES)
        none = changes.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(2), F.lit(1), F.lit("(no recent git history)"))
        out = out.union(shown).union(none).union(spark.createDataFrame([(2, 1000, "")], out.schema))
    parts = T.path_parts("rel_path")
    active = notes.where((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "work") & (F.get(parts, F.lit(1)) == "active"))
    idle = active.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(3), F.lit(1), F.lit("(no active work notes)"))
    out = out.union(_one(spark, 3, ["### Active Work"])).union(_listed(active, 3, F.concat(F.lit("- "), "stem"), [F.col("rel_path")], ACTIVE)).union(idle)
    out = out.union(spark.createDataFrame([(3, 1000, "")], out.schema))
    lines = lambda df, section, cols: df.select(F.lit(section), F.posexplode(F.array(*cols)))
    show = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("N/A")))
    out = out.union(lines(N.stats(seen), 4, [F.lit("### Vault Stats"), show("- Total notes: ", "total_notes"), show("- Brain notes: ", "brain_notes"), show("- Orphans (no links): ", "orphans"), F.lit("")]))
    span = F.concat(show("- Date range: ", "oldest_fact"), F.lit(" → "), F.coalesce("newest_fact", F.lit("N/A")))
    out = out.union(lines(fact_stats.where("triple_count > 0"), 5, [F.lit("### Knowledge Graph"), show("- Entities: ", "entity_count"), show("- Current facts: ", "current_facts"), span, F.lit("")]))
    more = seen.agg(F.count("*").alias("n")).where(F.col("n") > FILES).select(F.lit(6), F.lit(1000), F.concat(F.lit("... and "), (F.col("n") - FILES).cast("string"), F.lit(" more")))
    return out.union(_one(spark, 6, ["### Vault Files"])).union(_listed(seen, 6, F.concat(F.lit("- "), "rel_path"), [F.col("rel_path")], FILES)).union(more)


def stop(notes: DataFrame, fact_stats: DataFrame) -> DataFrame:
    """(section, at, line) of the report at a session's end."""
    spark, seen = notes.sparkSession, N.excluding(notes)
    lost = N.orphans(seen)
    line = lambda df, section, at, c: df.select(F.lit(section), F.lit(at), c)
    out = _one(spark, 0, ["## Wrap-Up Checklist", ""])
    out = out.union(line(lost.agg(F.count("*").alias("n")), 1, 0, F.concat(F.lit("**Orphan notes:** "), F.col("n").cast("string"))))
    out = out.union(_listed(lost, 1, F.concat(F.lit("  - "), "name"), [F.col("rel_path")], ORPHANS)).union(spark.createDataFrame([(1, 1000, "")], out.schema))
    brain = seen.agg(F.count_if(F.contains("rel_path", F.lit("brain"))).alias("n"))
    out = out.union(line(brain, 2, 0, F.concat(F.lit("**Brain notes:** "), F.col("n").cast("string"))))
    star = N.brain_note(notes, "North Star").agg(F.count("*").alias("n"))
    out = out.union(line(star, 2, 1, F.when(F.col("n") > 0, "**North Star:** North Star.md").otherwise("**WARNING:** No North Star found")))
    out = out.union(spark.createDataFrame([(2, 1000, "")], out.schema))
    out = out.union(line(fact_stats, 3, 0, F.concat(F.lit("**KG:** "), F.col("entity_count").cast("string"), F.lit(" entities, "), F.col("current_facts").cast("string"), F.lit(" current facts"))))
    return out.union(line(fact_stats.where("triple_count = 0"), 3, 1, F.lit("**WARNING:** KG is empty")))


def as_text(lines: DataFrame) -> DataFrame:
    """(output, tokens_hint): a report's lines (a few dozen) as one text."""
    one = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "at", "line"))), lambda x: x.line), "\n").alias("output"))
    return one.withColumn("tokens_hint", T.token_estimate("output"))


def user_message(messages: DataFrame, message: str = "message") -> DataFrame:
    """messages with output and tokens_hint: classification, action and at most two hints."""
    c = R.classify(messages, message)
    hints = F.array_join(F.transform(F.slice("routing_hints", 1, HINTS), lambda h: F.concat(F.lit("  - "), h)), "\n")
    told = F.concat(F.lit("[Classification: "), F.upper("message_type"), F.lit(" | Confidence: "), T.percent("confidence"), F.lit("]\nAction: "), "suggested_action",
                    F.when(F.size("routing_hints") > 0, F.concat(F.lit("\nHints:\n"), hints)).otherwise(""))
    return c.withColumn("output", told).withColumn("tokens_hint", F.lit(BUDGETS["user_message"]))


def archive(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript_length, transcript_excerpt): length and last characters of each conversation's transcript.

    Lengths are sums, added up before they are shuffled. A turn has three characters at least (its colon, blank and line end), so the last
    TAIL characters are in the last TAIL / 3 turns: only these are ranked, by a window limit that cuts before the shuffle too, and of these the ones
    whose following text is shorter than TAIL are joined. So no task holds a whole transcript."""
    from pyspark.sql import Window

    line = turns.select("conv_id", "turn", "role", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("role").desc(), F.col("line").desc())
    total = line.groupBy("conv_id").agg((F.sum(F.length("line")) + F.count("*") - 1).cast("long").alias("transcript_length"))
    near = line.withColumn("place", F.row_number().over(back)).where(F.col("place") <= TAIL // 3 + 1)
    ahead = F.coalesce(F.sum(F.length("line") + 1).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tail = F.when(F.col("after") <= TAIL, F.struct((-F.col("after")).alias("o"), F.col("place").alias("p"), F.right("line", F.lit(TAIL)).alias("t")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(tail)), lambda x: x.t), "\n")
    last = near.withColumn("after", ahead).groupBy(F.col("conv_id").alias("c")).agg(F.right(joined, F.lit(TAIL)).alias("transcript_excerpt"))
    return total.join(last, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def session_records(archived: DataFrame, agent: str, ts: str) -> DataFrame:
    """Rows to append to the session log."""
    when = F.lit(ts).cast("timestamp")
    return archived.select(F.col("conv_id").cast("string").alias("session_id"), when.alias("timestamp"), F.lit(agent).alias("agent"), "transcript_length", "transcript_excerpt",
                           F.concat(F.date_format(when, "yyyy-MM-dd_HHmmss"), F.lit("_"), F.substring(F.col("conv_id").cast("string"), 1, 8), F.lit(".json")).alias("file_name"))


def routed(notes: DataFrame, default: str = "personal", classify: bool = True) -> DataFrame:
    """notes with vault: where a migration to two vaults puts each; all shared without classification."""
    return notes.withColumn("vault", R.content_target("content", "tags", "rel_path", default) if classify else F.lit("shared"))


def exported(notes: DataFrame, strict: bool = True, confirm: bool = True, sanitize: bool = True) -> DataFrame:
    """(rel_path, action, content): a preview of 500 characters (strict mode asks first), or the (redacted) text to share."""
    clean = R.redact("content") if sanitize else F.col("content")
    if strict and confirm:
        return notes.select("rel_path", F.lit("preview").alias("action"), F.substring(clean, 1, 500).alias("content"))
    return notes.select("rel_path", F.lit("exported").alias("action"), clean.alias("content"))


def imported(notes: DataFrame, source=None, link_back: bool = True) -> DataFrame:
    """notes as they are copied to the personal vault: marked with where they come from, with a link back."""
    return notes.withColumns({"vault": F.lit("personal"), "imported_from": F.lit("shared") if source is None else source,
                              "content": T.import_link("content", "rel_path") if link_back else F.col("content")})


def written(contents: DataFrame, day: str, default: str = "personal", manual: bool = False, dual: bool = True) -> DataFrame:
    """Notes to write for contents (content, tags, file_path, vault; the last two may be null): (vault, rel_path, content, tags, date)."""
    rows = R.classify(contents.withColumn("_head", F.substring("content", 1, 200)), "_head")
    auto = T.file_name("content", "suggested_folder")
    where = F.lit(default) if manual else R.content_target("content", "tags", "file_path", default)
    vault = F.coalesce("vault", where) if dual else F.lit("shared")
    return rows.select(vault.alias("vault"), F.coalesce("file_path", auto).alias("rel_path"), "content", "tags", F.lit(day).alias("date"))


def sync(notes: DataFrame, chunks: DataFrame, wings: DataFrame, personal: DataFrame | None = None, personal_wings: DataFrame | None = None) -> DataFrame:
    """(kg_triples, palace_wings, indexed_files), one row: attempted facts, wings built and files indexed; with a personal vault
    personal_kg_triples and personal_palace_wings as well."""
    attempted = lambda df, name: facts.attempts(df).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    built = lambda df, name: df.agg(F.count("*").alias(name))
    out = attempted(notes, "kg_triples").join(built(wings, "palace_wings")).join(chunks.agg(F.count_distinct("path").alias("indexed_files")))
    if personal is None:
        return out
    return out.join(attempted(personal, "personal_kg_triples")).join(built(personal_wings, "personal_palace_wings"))
