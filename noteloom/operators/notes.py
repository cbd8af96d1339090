"""Notes: links and their resolution, orphans, statistics, lint and name search.

notes: ord, rel_path, stem, name, raw, content, links, tags, date, description, wing. Paths are relative to the vault.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pairs import paired

# Parts of paths that scans leave out, entry notes that are no orphans, and the vault's folders.
EXCLUDE = [".git", ".claude", "thinking"]
ENTRY = ["Home.md", "README.md"]
FOLDERS = {
    "brain": ["Memories.md", "Key Decisions.md", "Patterns.md", "Gotchas.md", "Skills.md", "North Star.md"],
    "work/active": [], "work/archive": [], "work/incidents": [], "work/1-1": [], "org/people": [], "org/teams": [],
    "perf/competencies": [], "perf/brag": [], "thinking": [],
    "templates": ["Work Note.md", "Decision Record.md", "1-1 Meeting.md", "Incident.md", "Thinking Note.md"],
}


def excluding(notes: DataFrame, patterns=None) -> DataFrame:
    """notes whose path holds none of the patterns (the default ones if none, or an empty list, are given)."""
    hit = reduce(lambda a, b: a | b, [F.contains("rel_path", F.lit(p)) for p in patterns or EXCLUDE])
    return notes.where(~hit)


def has_links() -> F.Column:
    """Whether a note links to anything."""
    return F.size(T.link_targets("content")) > 0


def links(notes: DataFrame) -> DataFrame:
    """(source, at, target): every link of every note in order."""
    return notes.select(F.col("rel_path").alias("source"), F.posexplode(T.link_targets("content")).alias("at", "target"))


def name_index(notes: DataFrame) -> DataFrame:
    """(kind, key, path): notes by lower-cased stem and file name (of equals the last path counts), and by path."""
    named = notes.select("rel_path", F.explode(F.array(F.lower("stem"), F.lower("name"))).alias("key"))
    return named.groupBy(F.lit("name").alias("kind"), "key").agg(F.max("rel_path").alias("path")).union(
        notes.select(F.lit("path"), "rel_path", "rel_path"))


def resolve(notes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(source, at, target, path): each link's note, null if there is none. A link names a note by stem or file name in any case,
    by that without .md, by its exact path, or by its path without .md, in this order."""
    found = links(notes) if found is None else found
    low = F.lower("target")
    way = lambda i, kind, key: F.struct(F.lit(i).alias("prio"), F.lit(kind).alias("kind"), key.alias("key"))
    ways = F.array(way(1, "name", low), way(2, "name", F.regexp_replace(low, r"\.md$", "")),
                   way(3, "path", F.col("target")), way(4, "path", F.concat("target", F.lit(".md"))))
    tried = found.select("source", "at", "target", F.explode(ways).alias("w")).select("source", "at", "target", "w.*")
    hits = tried.join(name_index(notes), ["kind", "key"], "left")
    # a minimum over prio of those found: partial aggregates before the shuffle
    return hits.groupBy("source", "at", "target").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("prio"))).alias("path"))


def orphans(notes: DataFrame) -> DataFrame:
    """Notes that no link resolves to (a link from a note to itself counts), without the entry notes."""
    # different targets only: a popular one is resolved once, and is reduced before the shuffle
    targets = links(notes).select("target").distinct().select(F.lit("").alias("source"), F.lit(0).alias("at"), "target")
    linked = resolve(notes, targets).where("path is not null").select(F.col("path").alias("rel_path")).distinct()
    return notes.join(linked, "rel_path", "left_anti").where(~F.col("name").isin(ENTRY))


def folder_counts(notes: DataFrame) -> DataFrame:
    """(folder, n) by the name of the immediate folder; 'root' without one."""
    parts = T.path_parts("rel_path")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("root")
    return notes.groupBy(parent.alias("folder")).agg(F.count("*").alias("n"))


def brain_notes(notes: DataFrame) -> DataFrame:
    """(brain_notes): notes in a brain folder or with wing 'brain', at least those right in brain/."""
    parts = T.path_parts("rel_path")
    inside = F.array_contains(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "brain")
    named = F.coalesce(F.lower("wing") == "brain", F.lit(False))
    direct = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "brain")
    return notes.agg(F.greatest(F.count_if(inside | named), F.count_if(direct)).alias("brain_notes"))


def stats(notes: DataFrame) -> DataFrame:
    """(total_notes, orphans, brain_notes), one row."""
    total = notes.agg(F.count("*").alias("total_notes"))
    return total.join(orphans(notes).agg(F.count("*").alias("orphans"))).join(brain_notes(notes))


def lint(notes: DataFrame) -> DataFrame:
    """(rel_path, valid, warnings): the check before a write. Missing fields warn; no front matter, or a long text without a link, is invalid."""
    parts, raw = T.path_parts("rel_path"), F.coalesce("raw", F.lit(""))
    skip = (~F.endswith("rel_path", F.lit(".md")) | F.startswith("name", F.lit(".")) | F.startswith("name", F.lit("README."))
            | F.arrays_overlap(parts, F.lit(["templates", "thinking", ".claude"])))
    fenced = F.startswith(raw, F.lit("---"))
    pieces = F.split(raw, "---", 3)
    head = F.get(pieces, F.lit(1))
    lacks = lambda k: fenced & (F.size(pieces) >= 3) & ~F.contains(head, F.lit(f"{k}:")) & ~F.contains(head, F.lit(f"{k} :"))
    bare = (F.length(raw) > 300) & ~F.contains(raw, F.lit("[["))
    warn = F.array_compact(F.array(
        F.when(~fenced, "Missing YAML frontmatter"), F.when(lacks("date"), "Missing 'date' in frontmatter"),
        F.when(lacks("description"), "Missing 'description' in frontmatter (~150 chars)"), F.when(lacks("tags"), "Missing 'tags' in frontmatter"),
        F.when(bare, "No [[wikilinks]] found — every note must link to at least one other note")))
    return notes.select(
        "rel_path", F.when(skip, True).otherwise(fenced & ~bare).alias("valid"),
        F.when(skip, F.array().cast("array<string>")).otherwise(warn).alias("warnings"))


def lint_report(notes: DataFrame) -> DataFrame:
    """(notes, notes_with_warnings, warnings, invalid), one row."""
    return lint(notes).agg(
        F.count("*").alias("notes"), F.count_if(F.size("warnings") > 0).alias("notes_with_warnings"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("warnings"), F.count_if(~F.col("valid")).alias("invalid"))


def post_tool(writes: DataFrame, notes: DataFrame) -> DataFrame:
    """The check after a tool call: writes (call_id, tool, file_path, path) against notes: (call_id, success, output)."""
    target = F.coalesce(F.nullif("file_path", F.lit("")), "path", F.lit(""))
    seen = notes.select(F.col("rel_path").alias("_path"), "date", "description", F.size(T.link_targets("content")).alias("n_links"))
    rows = writes.withColumn("_target", target).join(seen, F.col("_target") == F.col("_path"), "left")
    there, empty = F.col("_path").isNotNull(), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    warn = F.array_compact(F.array(
        F.when(~there, "File was not created"), F.when(there & empty("date"), "Missing frontmatter 'date' field"),
        F.when(there & empty("description"), "Missing frontmatter 'description' field"),
        F.when(there & (F.col("n_links") == 0), "Note has no wikilinks (orphan)")))
    skip = (
        F.when(~F.col("tool").isin("write", "edit", "create_file"), "(skipped - not a write operation)")
        .when(F.col("_target") == "", "(skipped - no file path)")
        .when(~F.endswith("_target", F.lit(".md")), "(skipped - not a markdown file)")
    )
    told = F.concat(F.lit("(PostTool validation complete)"), F.when(F.size(warn) > 0, F.concat(
        F.lit("\nWarnings:\n"), F.array_join(F.transform(warn, lambda w: F.concat(F.lit("  - "), w)), "\n"))).otherwise(""))
    return rows.select("call_id", F.when(skip.isNotNull(), True).otherwise(F.size(warn) == 0).alias("success"), F.coalesce(skip, told).alias("output"))


def by_name(notes: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Name search: queries (qid, query) against stems: (qid, rank, path, content_excerpt, score, match_type)."""
    from .search import first_by

    low = F.contains(F.lower("stem"), F.lower("query"))
    hits = paired(notes, queries, low).select(
        "qid", F.col("rel_path").alias("path"), F.substring("content", 1, 200).alias("content_excerpt"), F.lit(1.0).alias("score"),
        F.lit("name").alias("match_type"))
    return first_by(hits, ["path"], limit)


def brain_note(notes: DataFrame, name: str) -> DataFrame:
    """The note brain/<name>.md; names that leave the folder give nothing."""
    if any(x in name for x in ("/", "\\", "..")):
        return notes.limit(0)
    return notes.where(F.col("rel_path") == f"brain/{name}.md")
