"""Column functions over note and message text. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"\[\[([^\]]+)\]\]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_hash(c) -> Column:
    """First 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(col(c), 256), 1, 16)


def entity_id(name) -> Column:
    return short_hash(name)


def triple_id(subject, predicate, obj) -> Column:
    """Identity of a fact: its three texts, not its time. A bar inside a text can make two facts one."""
    return short_hash(F.concat(col(subject), F.lit("|"), col(predicate), F.lit("|"), col(obj)))


def chunk_id(path, offset) -> Column:
    return short_hash(F.concat(col(path), F.lit(":"), col(offset).cast("string")))


def words(c) -> Column:
    """White-space separated words, with Unicode white space."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def link_targets(c, strip_md: bool = True) -> Column:
    """Targets of [[target|alias]] links in order, repeats kept: trimmed, and without a final .md unless asked to keep it."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(LINK), 1)
    bare = F.transform(found, lambda x: F.regexp_replace(F.split_part(x, F.lit("|"), F.lit(1)), r"(?U)^\s+|\s+$", ""))
    if strip_md:
        bare = F.transform(bare, lambda x: F.regexp_replace(x, r"(?i)\.md$", ""))
    return F.filter(bare, lambda x: x != "")


def tag_list(value) -> Column:
    """Tags from a comma-separated text."""
    return F.filter(F.transform(F.split(F.coalesce(col(value), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def path_parts(c) -> Column:
    return F.split(col(c), "/")


def folder(parts) -> Column:
    """First folder of a path, null in the root."""
    return F.when(F.size(col(parts)) > 1, F.get(col(parts), F.lit(0)))


def subfolder(parts) -> Column:
    """First two folders of a path with more than one folder."""
    p = col(parts)
    return F.when(F.size(p) > 2, F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def slug(c) -> Column:
    """Room name of a file stem: lower case, spaces as hyphens."""
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit("-"))


def room_of(parts, stem) -> Column:
    """(wing, room) of a note by its folders, null if none applies; the first rule counts."""
    p, s = col(parts), col(stem)
    place = lambda w, r: F.struct(w.alias("wing"), r.alias("room"))
    return (
        F.when(F.array_contains(p, "brain"), place(F.lit("brain"), slug(s)))
        .when(F.array_contains(p, "work"), place(F.lit("work"), slug(s)))
        .when(F.array_contains(p, "org") & F.array_contains(p, "people"), place(s, F.lit("context")))
    )


def excerpt(c, size: int = 300, dots: bool = True) -> Column:
    """The first size characters, with dots if any are left off."""
    cut = F.substring(col(c), 1, size)
    return F.when(F.length(col(c)) > size, F.concat(cut, F.lit("..."))).otherwise(col(c)) if dots else cut


def section(c, name: str) -> Column:
    """Text under a '## name' heading up to the next '## ' (a '###' heading ends it too); empty if there is none."""
    found = F.regexp_extract(col(c), rf"(?is)## {name}(.*?)(?=## |$)", 1)
    return F.regexp_replace(found, r"(?U)^\s+|\s+$", "")


def section_or_start(c, name: str, size: int = 500) -> Column:
    return F.coalesce(F.nullif(section(c, name), F.lit("")), F.substring(col(c), 1, size))


def token_estimate(c) -> Column:
    return F.size(words(c)).cast("long")


def file_name(content, fold) -> Column:
    """A file path from the first 40 characters: up to five words without punctuation, joined by hyphens."""
    bare = F.regexp_replace(F.substring(col(content), 1, 40), r"(?U)[^\w\s]", "")
    stem = F.array_join(F.slice(words(bare), 1, 5), "-")
    return F.concat(col(fold), F.coalesce(F.nullif(stem, F.lit("")), F.lit("note")), F.lit(".md"))


def fill(template, values: dict) -> Column:
    """Replaces {{key}} by each value, in the given order."""
    out = col(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), v if isinstance(v, Column) else F.lit(str(v)))
    return out


def import_link(body, path) -> Column:
    """A body with the link back to where it was imported from."""
    return F.concat(col(body), F.lit("\n\n---\n*Imported from shared: [["), col(path), F.lit("]]*"))


def percent(c) -> Column:
    return F.concat(F.bround(col(c) * 100).cast("int").cast("string"), F.lit("%"))


def day_heading(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd (EEEE)")
