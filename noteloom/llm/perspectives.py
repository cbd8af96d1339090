"""Chat formatting by perspective rotation: for every participant of a dialogue, a rendering with that speaker as the
assistant, the others as named users, and a loss mask over the assistant's words.

Renderings are rows, one for each perspective and turn, with the segment's place in the rendered text: the segments of a
perspective in order are the rendering, and no dialogue has to fit into a task. render() puts them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, saved

SYSTEM = "system"
END = "<|end|>\n"


def rotate(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(conv_id, perspective, place, turn, role, name, header, content, segment, masked, seg_start, mask_start, mask_end).

    turns: conv_id, turn, role, text. A segment is header, content and an end mark; positions count characters of the rendered
    text; masked is 1 on segments whose content and end mark (mask_start to mask_end) are learned. The system's turns stay as they
    are and are nobody's perspective. A null role is rendered as the user "unknown" and has no perspective; null text is empty;
    turns are ordered by turn, role and text (nulls first), so repeated rows are turns of their own; a null conv_id is a dialogue of its own; a
    dialogue without participants, and an empty table, give no rows; other columns are ignored."""
    one = F.lit(1).cast("long").alias("one")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"), one)
    rows = saved(prefix_sums(rows, ["conv_id"], ["turn", "role", "content"], {"one": "place"}))
    people = rows.where(F.col("role").isNotNull() & (F.col("role") != system)).select(
        F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    named = F.when(own, "assistant").when(F.col("role") == system, "system").otherwise("user")
    name = F.when(F.col("as") == "user", F.coalesce("role", F.lit("unknown")))
    header = F.concat(F.lit("<|"), "as", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("|>\n"))
    # sizes only are summed up for each perspective; the texts join them once
    narrow = rows.select("conv_id", "place", "role", (F.length("content") + len(END)).cast("long").alias("after"))
    both = narrow.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    both = both.withColumn("masked", own.cast("int")).withColumn("as", named).withColumn("name", name).withColumn("header", header)
    both = both.select("conv_id", "perspective", "place", "masked", "as", "name", "header", (F.length("header") + F.col("after")).cast("long").alias("size"))
    placed = prefix_sums(both, ["conv_id", "perspective"], ["place"], {"size": "seg_end"}).withColumnsRenamed({"conv_id": "c", "place": "p"})
    start = F.col("seg_end") - F.col("size")
    return rows.join(placed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p"))).select(
        "conv_id", "perspective", "place", "turn", F.col("as").alias("role"), "name", "header", "content", F.concat("header", "content", F.lit(END)).alias("segment"), "masked",
        start.alias("seg_start"), (start + F.length("header")).alias("mask_start"), (F.col("seg_end") - 1).alias("mask_end"))


def render(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, spans): each rendering as one text with its masked spans. A dialogue must fit into a row."""
    turns = F.array_sort(F.collect_list(F.struct("place", "segment", "masked", "mask_start", "mask_end")))
    spans = F.transform(F.filter("t", lambda x: x.masked == 1), lambda x: F.struct(x.mask_start.alias("start"), x.mask_end.alias("end")))
    return rotated.groupBy("conv_id", "perspective").agg(turns.alias("t")).select(
        "conv_id", "perspective", F.array_join(F.transform("t", lambda x: x.segment), "").alias("text"), spans.alias("spans"))


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM r WHERE role IS NOT NULL AND role <> 'system'),
b AS (SELECT r.*, p.perspective, CASE WHEN role = perspective THEN 1 ELSE 0 END AS masked,
        CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS "as"
      FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.c),
n AS (SELECT *, CASE WHEN "as" = 'user' THEN coalesce(role, 'unknown') END AS name FROM b),
h AS (SELECT *, '<|' || "as" || coalesce(' name=' || name, '') || '|>' || chr(10) AS header FROM n),
s AS (SELECT *, header || content || '<|end|>' || chr(10) AS segment FROM h),
w AS (SELECT *, row_number() OVER o AS place, CAST(sum(length(segment)) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_end FROM s
      WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, content))
SELECT conv_id, perspective, place, turn, "as" AS role, name, header, content, segment, masked,
       seg_end - length(segment) AS seg_start, seg_end - length(segment) + length(header) AS mask_start, seg_end - 1 AS mask_end FROM w
"""
