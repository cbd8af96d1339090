"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

import re

from ..functions import rules as R
from . import fixtures as X

_D = X.duck
RAW, WIN, NOTES_ALL = _D(X.TRIPLES_RAW), _D(X.TRIPLES), _D(X.NOTES)
MSG, SEC, CHUNKS = _D(X.MESSAGES), _D(X.SECRETS), _D(X.CHUNKS)
NOTES = f"SELECT * FROM ({NOTES_ALL}) q WHERE NOT (contains(rel_path, '.git') OR contains(rel_path, '.claude') OR contains(rel_path, 'thinking'))"
TODAY = X.TODAY
_ID = "left(sha256(concat(subject, '|', predicate, '|', object)), 16)"
_RES = "subject, predicate, object, valid_from, valid_to, confidence, source_file"
_USERS = f"SELECT DISTINCT subject AS entity FROM ({WIN}) u"
_OBJECTS = f"SELECT DISTINCT object AS entity FROM ({WIN}) o"
_HOLDS = "(valid_from IS NULL OR valid_from <= {0}) AND (valid_to IS NULL OR valid_to >= {0})"
ENT = f"""SELECT name, arg_min(type, seq) AS type FROM (SELECT subject AS name, 'unknown' AS type, seq * 2 AS seq FROM ({RAW}) a
UNION ALL SELECT object, 'unknown', seq * 2 + 1 FROM ({RAW}) b) e GROUP BY name"""

O: dict[str, str] = {}
O["kg_asof_facts"] = f"""WITH k AS (SELECT entity, unnest(['2024-01-05', '2024-01-15', '{TODAY}']) AS day FROM
 (SELECT * FROM ({_USERS}) x UNION ALL SELECT * FROM ({_OBJECTS}) y) z)
SELECT entity, CASE WHEN day = '{TODAY}' THEN '{TODAY}' ELSE day END AS as_of, {_RES} FROM k JOIN ({WIN}) t ON (t.subject = k.entity OR t.object = k.entity)
WHERE {_HOLDS.format('day')}"""
O["kg_triples_upsert"] = f"""SELECT {_ID} AS id, {_RES} FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY seq DESC) AS rn FROM ({RAW}) r) q WHERE rn = 1"""
O["kg_triples_reupsert"] = f"""SELECT {_ID} AS id, {_RES} FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY seq DESC) AS rn FROM
 (SELECT -1 AS seq, {_RES} FROM ({WIN}) w UNION ALL SELECT seq, {_RES} FROM ({RAW}) r) u) q WHERE rn = 1"""
O["kg_entities"] = f"""SELECT left(sha256(name), 16) AS id, name, arg_min(type, seq) AS type FROM (SELECT subject AS name, 'unknown' AS type, seq * 2 AS seq FROM ({RAW}) a
UNION ALL SELECT object, 'unknown', seq * 2 + 1 FROM ({RAW}) b UNION ALL SELECT object, 'key', seq * 2 - 0.5 FROM ({RAW}) c) e GROUP BY name"""
O["kg_asof_grid"] = f"""SELECT subject, as_of, count(*) AS facts FROM ({WIN}) t JOIN (SELECT printf('2024-01-%02d', i) AS as_of FROM range(1, 31) r(i)) d
ON {_HOLDS.format('as_of')} GROUP BY subject, as_of"""
O["kg_relation"] = f"SELECT {_RES} FROM ({WIN}) t"
O["kg_timeline"] = f"""SELECT entity, valid_from AS date, valid_to AS end_date, CASE WHEN subject = entity THEN 'outbound' ELSE 'inbound' END AS direction, subject, predicate, object,
concat(subject, ' --', predicate, '--> ', object) AS label, source_file AS source FROM (SELECT * FROM ({_USERS}) x UNION ALL SELECT * FROM ({_OBJECTS}) y) k
JOIN ({WIN}) t ON t.subject = k.entity OR t.object = k.entity"""
O["kg_invalidate"] = f"""SELECT {_ID} AS id, subject, predicate, object, valid_from, CASE WHEN valid_to IS NULL THEN CASE WHEN seq % 2 = 0 THEN '2024-02-01' ELSE '{TODAY}' END ELSE valid_to END AS valid_to,
confidence, source_file FROM ({WIN}) t"""
O["kg_stats"] = f"""SELECT (SELECT count(*) FROM ({ENT}) e) AS entity_count, count(*) AS triple_count, count(*) FILTER (WHERE valid_to IS NULL OR valid_to >= '{TODAY}') AS current_facts,
count(*) - count(*) FILTER (WHERE valid_to IS NULL OR valid_to >= '{TODAY}') AS expired_facts, min(valid_from) AS oldest_fact, max(valid_from) AS newest_fact FROM ({WIN}) t"""

_LINK = r"regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1)"
_RAWLINKS = f"list_filter(list_transform({_LINK}, lambda x: trim(split_part(x, '|', 1))), lambda x: x <> '')"
_LINKS = f"list_transform({_RAWLINKS}, lambda x: regexp_replace(x, '(?i)\\.md$', ''))"
_CAND = f"""SELECT stem AS subject, 'links_to' AS predicate, unnest({_RAWLINKS}) AS object, '{TODAY}' AS valid_from, rel_path AS source_file, ord, generate_subscripts({_RAWLINKS}, 1) AS at FROM ({NOTES}) n
UNION ALL SELECT stem, 'has_tag', unnest(tags), '{TODAY}', rel_path, ord, 100 + generate_subscripts(tags, 1) FROM ({NOTES}) n
UNION ALL SELECT stem, 'in_folder', split_part(rel_path, '/', 1), '{TODAY}', rel_path, ord, 200 FROM ({NOTES}) n WHERE contains(rel_path, '/')
UNION ALL SELECT stem, 'in_subfolder', concat(split_part(rel_path, '/', 1), '/', split_part(rel_path, '/', 2)), '{TODAY}', rel_path, ord, 201 FROM ({NOTES}) n WHERE len(string_split(rel_path, '/')) > 2
UNION ALL SELECT stem, 'created_on', date, date, rel_path, ord, 202 FROM ({NOTES}) n WHERE date IS NOT NULL"""
O["kg_populate"] = f"""SELECT {_ID} AS id, subject, predicate, object, valid_from, CAST(NULL AS VARCHAR) AS valid_to, CAST(1.0 AS DOUBLE) AS confidence, source_file FROM
(SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY ord DESC, at DESC) AS rn FROM ({_CAND}) c) q WHERE rn = 1"""
O["kg_populate_entities"] = f"""SELECT left(sha256(name), 16) AS id, name, arg_min(type, [ord, at, e]) AS type FROM (
SELECT subject AS name, 'unknown' AS type, ord, at, 0 AS e FROM ({_CAND}) a UNION ALL SELECT object, 'unknown', ord, at, 1 FROM ({_CAND}) b
UNION ALL SELECT stem, 'note', ord, 1000, 0 FROM ({NOTES}) n WHERE length(description) > 10) z GROUP BY name"""
O["kg_populate_counts"] = f"""SELECT rel_path, CAST(len({_RAWLINKS}) + len(tags) + (CASE WHEN contains(rel_path, '/') THEN 1 ELSE 0 END) + (CASE WHEN len(string_split(rel_path, '/')) > 2 THEN 1 ELSE 0 END)
+ (CASE WHEN date IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN length(description) > 10 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ({NOTES}) n"""
_FOUND = f"SELECT rel_path AS source, generate_subscripts({_LINKS}, 1) - 1 AS at, unnest({_LINKS}) AS target FROM ({NOTES}) n"
_IDX = f"SELECT key, max(rel_path) AS path FROM (SELECT lower(stem) AS key, rel_path FROM ({NOTES}) n UNION ALL SELECT lower(name), rel_path FROM ({NOTES}) m) x GROUP BY key"
_RESOLVED = f"""SELECT source, at, target, coalesce(i1.path, i2.path, p1.rel_path, p2.rel_path) AS path FROM ({_FOUND}) f
LEFT JOIN ({_IDX}) i1 ON i1.key = lower(target) LEFT JOIN ({_IDX}) i2 ON i2.key = regexp_replace(lower(target), '\\.md$', '')
LEFT JOIN ({NOTES}) p1 ON p1.rel_path = target LEFT JOIN ({NOTES}) p2 ON p2.rel_path = concat(target, '.md')"""
O["notes_links"] = _FOUND
O["notes_resolve"] = _RESOLVED
_ORPHANS = f"SELECT rel_path, name FROM ({NOTES}) n WHERE rel_path NOT IN (SELECT path FROM ({_RESOLVED}) r WHERE path IS NOT NULL) AND name NOT IN ('Home.md', 'README.md')"
O["notes_orphans"] = f"SELECT rel_path FROM ({_ORPHANS}) o"
O["notes_folder_counts"] = f"SELECT CASE WHEN contains(rel_path, '/') THEN string_split(rel_path, '/')[-2] ELSE 'root' END AS folder, count(*) AS n FROM ({NOTES}) n GROUP BY 1"
_BRAIN = f"SELECT greatest(count(*) FILTER (WHERE starts_with(rel_path, 'brain/') OR lower(wing) = 'brain'), count(*) FILTER (WHERE starts_with(rel_path, 'brain/'))) AS brain_notes FROM ({NOTES}) n"
O["notes_stats"] = f"SELECT (SELECT count(*) FROM ({NOTES}) n) AS total_notes, (SELECT count(*) FROM ({_ORPHANS}) o) AS orphans, (SELECT brain_notes FROM ({_BRAIN}) b) AS brain_notes"
_HEAD = "string_split(raw, '---')[2]"
_LINT = f"""SELECT rel_path, CASE WHEN skip THEN true ELSE fenced AND NOT bare END AS valid, CASE WHEN skip THEN [] ELSE list_filter([
 CASE WHEN NOT fenced THEN 'Missing YAML frontmatter' END, CASE WHEN fenced AND NOT contains(head, 'date:') THEN 'Missing ''date'' in frontmatter' END,
 CASE WHEN fenced AND NOT contains(head, 'description:') THEN 'Missing ''description'' in frontmatter (~150 chars)' END,
 CASE WHEN fenced AND NOT contains(head, 'tags:') THEN 'Missing ''tags'' in frontmatter' END,
 CASE WHEN bare THEN 'No [[wikilinks]] found — every note must link to at least one other note' END], lambda x: x IS NOT NULL) END AS warnings
FROM (SELECT rel_path, contains(concat('/', rel_path), '/thinking/') AS skip, starts_with(raw, '---') AS fenced, {_HEAD} AS head, length(raw) > 300 AND NOT contains(raw, '[[') AS bare FROM ({NOTES_ALL}) n) l"""
O["notes_lint"] = f"SELECT rel_path, valid, array_to_string(warnings, '; ') AS warnings FROM ({_LINT}) l"
O["notes_lint_report"] = f"SELECT count(*) AS notes, count(*) FILTER (WHERE len(warnings) > 0) AS notes_with_warnings, CAST(sum(len(warnings)) AS BIGINT) AS warnings, count(*) FILTER (WHERE NOT valid) AS invalid FROM ({_LINT}) l"
O["notes_posttool_lint"] = f"""WITH c AS (SELECT ord AS call_id, CASE ord % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'edit' ELSE 'create_file' END AS tool,
 coalesce(nullif(CASE WHEN ord % 9 = 0 THEN '' WHEN ord % 9 = 4 THEN 'a.txt' WHEN ord % 9 = 7 THEN concat('gone/', rel_path) ELSE rel_path END, ''), CASE WHEN ord % 18 = 9 THEN rel_path END, '') AS target FROM ({NOTES_ALL}) n),
j AS (SELECT c.*, n.rel_path AS there, n.date, n.description, len({_RAWLINKS}) AS n_links FROM c LEFT JOIN ({NOTES_ALL}) n ON n.rel_path = c.target),
w AS (SELECT *, list_filter([CASE WHEN there IS NULL THEN 'File was not created' END, CASE WHEN there IS NOT NULL AND coalesce(date, '') = '' THEN 'Missing frontmatter ''date'' field' END,
 CASE WHEN there IS NOT NULL AND coalesce(description, '') = '' THEN 'Missing frontmatter ''description'' field' END,
 CASE WHEN there IS NOT NULL AND n_links = 0 THEN 'Note has no wikilinks (orphan)' END], lambda x: x IS NOT NULL) AS warn,
 CASE WHEN tool = 'read' THEN '(skipped - not a write operation)' WHEN target = '' THEN '(skipped - no file path)' WHEN NOT ends_with(target, '.md') THEN '(skipped - not a markdown file)' END AS skip FROM j)
SELECT call_id, skip IS NOT NULL OR len(warn) = 0 AS success, coalesce(skip, concat('(PostTool validation complete)', CASE WHEN len(warn) > 0
 THEN concat(chr(10), 'Warnings:', chr(10), array_to_string(list_transform(warn, lambda x: concat('  - ', x)), chr(10))) ELSE '' END)) AS output FROM w"""
_TOP = "qid, CAST(rank AS INT) AS rank, path, content_excerpt, score, match_type"
O["notes_search_name"] = f"""SELECT {_TOP} FROM (SELECT qid, rel_path AS path, substr(content, 1, 200) AS content_excerpt, CAST(1.0 AS DOUBLE) AS score, 'name' AS match_type,
 row_number() OVER (PARTITION BY qid ORDER BY rel_path) AS rank FROM ({NOTES}) n JOIN (VALUES (1, 'N1'), (2, '50'), (3, 'n%'), (4, 'n99')) q(qid, query) ON contains(lower(stem), lower(query))) r WHERE rank <= 8"""
O["notes_room_paths"] = f"""SELECT wing, room, arg_max(rel_path, ord) AS path FROM (SELECT ord, rel_path, CASE WHEN starts_with(rel_path, 'brain/') THEN 'brain' WHEN starts_with(rel_path, 'work/') THEN 'work'
 WHEN starts_with(rel_path, 'org/people/') THEN stem END AS wing, CASE WHEN starts_with(rel_path, 'org/people/') THEN 'context' ELSE lower(stem) END AS room FROM ({NOTES}) n) q WHERE wing IS NOT NULL GROUP BY wing, room"""
O["page_links"] = """SELECT href, count(*) AS uses, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) p GROUP BY href"""


def _pattern(p: str) -> str:
    """The same pattern without look at letters beyond ASCII: word boundaries spelled out, since RE2's are ASCII only."""
    edge = r"[^\p{L}\p{N}_]"
    if p.startswith(r"\b") and p.endswith(r"\b"):
        inner = p[2:-2].replace(r"\b.*\b", rf"(?:{edge}.*{edge}|{edge})")
        p = rf"(?:^|{edge}){inner}(?:$|{edge})"
    return "(?i)" + p.replace("'", "''")


_SCORES = ", ".join("({}) AS s{}".format(" + ".join(f"CAST(regexp_matches(lower(message), '{_pattern(p)}') AS INT)" for p in r[1]), i) for i, r in enumerate(R.RULES))
_MAX = f"greatest({', '.join(f's{i}' for i in range(len(R.RULES)))})"
_PICK = lambda at, other: "CASE WHEN best = 0 THEN '{}' {} END".format(
    other, " ".join("WHEN s{} = best THEN '{}'".format(i, str(r[at] if not isinstance(r[at], list) else len(r[at])).replace("'", "''")) for i, r in enumerate(R.RULES)))
_CLS = f"""SELECT conv_id, turn, message, {_PICK(0, 'unknown')} AS message_type, CASE WHEN best = 0 THEN 0 ELSE least(best / 3.0, 1.0) * CASE WHEN nw < 5 THEN 0.7 ELSE 1.0 END END AS confidence,
{_PICK(3, R.UNKNOWN[2])} AS suggested_folder, {_PICK(4, R.UNKNOWN[3])} AS suggested_action, CAST({_PICK(2, '1')} AS INT) AS n_hints
FROM (SELECT *, {_MAX} AS best, len(list_filter(regexp_split_to_array(message, '\\s+'), lambda w: w <> '')) AS nw FROM (SELECT *, {_SCORES} FROM ({MSG}) m) s) b"""
O["msg_classify"] = f"SELECT conv_id, turn, message_type, CAST(round(confidence, 6) AS DOUBLE) AS confidence, suggested_folder, suggested_action, n_hints FROM ({_CLS}) c"
_IN = lambda x: ", ".join(f"'{v}'" for v in x)
O["msg_routing"] = f"""SELECT concat('[', upper(message_type), '] ', suggested_action) AS hint, CASE WHEN message_type IN ({_IN(R.SHARED_TYPES)}) THEN 'shared' WHEN message_type IN ({_IN(R.PERSONAL_TYPES)}) THEN 'personal'
ELSE 'ambiguous' END AS vault, count(*) AS n FROM ({_CLS}) c GROUP BY 1, 2"""
_HINTS = "CASE WHEN message_type = 'unknown' THEN '  - {}' {} END".format(R.UNKNOWN[1][0], " ".join(
    "WHEN message_type = '{}' THEN concat({})".format(r[0], ", chr(10), ".join("'  - {}'".format(h.replace("'", "''")) for h in r[2][:2])) for r in R.RULES))
O["msg_hook"] = f"""SELECT conv_id, turn, concat('[Classification: ', upper(message_type), ' | Confidence: ', CAST(CAST(round_even(confidence * 100, 0) AS INT) AS VARCHAR), '%]', chr(10), 'Action: ', suggested_action, chr(10), 'Hints:', chr(10), {_HINTS}) AS output,
100 AS tokens_hint FROM ({_CLS}) c"""
O["msg_rule_scores"] = "SELECT message_type, count(*) AS messages, CAST(sum(score) AS BIGINT) AS score FROM ({}) u WHERE score > 0 GROUP BY message_type".format(
    " UNION ALL ".join(f"SELECT '{r[0]}' AS message_type, s{i} AS score FROM (SELECT {_SCORES} FROM ({MSG}) m) s" for i, r in enumerate(R.RULES)))
_HIT = lambda given: " OR ".join(f"contains(lower(content), '{i.lower()}') OR list_contains(list_transform(tags, lambda t: lower(t)), '{i.lower()}')" for i in given)
_ROUTE = f"""CASE WHEN {_HIT(R.PERSONAL_INDICATORS)} THEN 'personal' WHEN {_HIT(R.SHARED_INDICATORS)} THEN 'shared' WHEN list_has_any(string_split(rel_path, '/'), [{_IN(R.PERSONAL_FOLDERS)}]) THEN 'personal'
WHEN list_has_any(string_split(rel_path, '/'), [{_IN(R.SHARED_FOLDERS)}]) THEN 'shared' ELSE 'personal' END"""
O["content_route"] = f"SELECT doc_id, {_ROUTE} AS vault FROM ({SEC}) s"
O["migrate_counts"] = f"SELECT {_ROUTE} AS vault, count(*) AS notes FROM ({SEC}) s GROUP BY 1"
_RED = "content"
for _p, _r in R.REDACTIONS:
    _RED = f"regexp_replace({_RED}, '{_p}', '{_r.replace('$1', chr(92) + '1')}', 'g')"
O["content_redact"] = f"SELECT doc_id, {_RED} AS content FROM ({SEC}) s"
O["content_export_preview"] = f"SELECT rel_path, 'preview' AS action, substr({_RED}, 1, 500) AS content FROM ({SEC}) s"
O["content_import"] = f"SELECT doc_id, 'personal' AS vault, 'shared' AS imported_from, concat(content, chr(10), chr(10), '---', chr(10), '*Imported from shared: [[', rel_path, ']]*') AS content FROM ({SEC}) s"
_W = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
_NAME = lambda c: f"coalesce(nullif(array_to_string(({_W(f"regexp_replace(substr({c}, 1, 40), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")})[1:5], '-'), ''), 'note')"
O["auto_filename"] = f"SELECT doc_id, concat('thinking/', {_NAME('text')}, '.md') AS rel_path FROM documents"
O["chunks"] = f"""SELECT left(sha256(concat(path, ':', CAST(i AS VARCHAR))), 16) AS hash, path, CAST(i AS INT) AS chunk_index, t AS text FROM (SELECT path, i, array_to_string(w[i + 1:i + 512], ' ') AS t FROM
(SELECT concat('d', CAST(doc_id AS VARCHAR)) AS path, w, unnest(range(0, len(w), 512)) AS i FROM (SELECT doc_id, {_W('text')} AS w FROM documents) a) b) c WHERE length(trim(t)) >= 20"""
_KW = "SELECT {top} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM ({rows}) r) k WHERE rank <= {n}"
O["search_keyword_chunk"] = _KW.format(top=_TOP, order="ord", n=7, rows=f"""SELECT qid, path, substr(text, 1, 200) AS content_excerpt, CAST(1.0 AS DOUBLE) AS score, 'keyword' AS match_type, ord FROM ({CHUNKS}) c
JOIN (VALUES (1, 'the and'), (2, 'DE LA'), (3, 'zzzz'), (4, '%')) q(qid, query) ON contains(lower(text), lower(query))""")
O["search_keyword_line"] = _KW.format(top=_TOP, order="path", n=7, rows=f"""SELECT qid, path, substr(arg_min(line, at), 1, 200) AS content_excerpt, CAST(1.0 AS DOUBLE) AS score, 'keyword' AS match_type FROM
(SELECT rel_path AS path, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS at FROM ({NOTES}) n) l
JOIN (VALUES (1, 'the and'), (2, 'DATE:'), (3, 'zzzz')) q(qid, query) ON contains(lower(line), lower(query)) GROUP BY qid, path""")
_ASK = f"SELECT ord AS qid, array_to_string(({_W('text')})[1:6], ' ') AS query, embedding AS qe FROM ({CHUNKS}) a WHERE ord % 20 = 0"
_QW, _TW = f"list_distinct({_W('lower(query)')})", f"list_distinct({_W('lower(text)')})"


def _vector(hybrid: bool, n: int, where: str = "true") -> str:
    extra = f"len(list_intersect({_QW}, {_TW})) / len({_QW}) * 0.3" if hybrid else "0.0"
    pairs = f"""SELECT qid, path, ord, CASE WHEN length(text) > 300 THEN concat(substr(text, 1, 300), '...') ELSE text END AS content_excerpt,
 list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) + b AS score, CASE WHEN b > 0 THEN 'hybrid' ELSE 'semantic' END AS match_type
 FROM (SELECT *, CAST({extra} AS DOUBLE) AS b FROM ({CHUNKS}) c, ({_ASK}) q WHERE {where}) p"""
    best = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY score DESC, ord) AS rn FROM ({pairs}) x) y WHERE rn = 1"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM ({best}) z) v WHERE rank <= {n}"


_OUT = "qid, CAST(rank AS INT) AS rank, path, content_excerpt, round(score, 6) AS score, match_type"
O["search_vector"] = f"SELECT {_OUT} FROM ({_vector(False, 5)}) r"
O["search_hybrid"] = f"SELECT {_OUT} FROM ({_vector(True, 5)}) r"
O["search_vector_blocks"] = O["search_hybrid"]
O["search_wing_fallback"] = f"""SELECT {_OUT} FROM (SELECT *, max(CAST(inw AS INT)) OVER (PARTITION BY qid) AS anyw FROM
(SELECT *, contains(path, concat('wing', CAST(qid % 10 AS VARCHAR))) AS inw FROM ({_vector(False, 6)}) v) f) g WHERE (inw OR anyw = 0) AND rank <= 5"""
O["search_cross_vault"] = f"""SELECT {_OUT} FROM (SELECT qid, path, content_excerpt, score, match_type, row_number() OVER (PARTITION BY qid ORDER BY score DESC, v, r) AS rank FROM
(SELECT qid, path, content_excerpt, score, match_type, 0 AS v, rank AS r FROM ({_vector(False, 5, 'ord % 2 = 0')}) a UNION ALL
 SELECT qid, path, content_excerpt, score, concat('personal:', match_type), 1, rank FROM ({_vector(False, 5, 'ord % 2 = 1')}) b) u) w WHERE rank <= 5"""
_BUILT = f"""SELECT wing, type, room, max(rel_path) AS path FROM (SELECT rel_path, CASE WHEN starts_with(rel_path, 'brain/') THEN 'brain' WHEN starts_with(rel_path, 'work/active/') THEN 'work' WHEN starts_with(rel_path, 'org/people/') THEN stem END AS wing,
CASE WHEN starts_with(rel_path, 'org/people/') THEN 'person' ELSE 'project' END AS type, CASE WHEN starts_with(rel_path, 'org/people/') THEN 'context' ELSE lower(stem) END AS room FROM ({NOTES}) n) p WHERE wing IS NOT NULL GROUP BY wing, type, room"""
O["palace_build"] = _BUILT
W_, R_, D_, T_ = (_D(x) for x in (X.WINGS, X.ROOMS, X.DRAWERS, X.TUNNELS))
O["palace_stats"] = f"SELECT (SELECT count(*) FROM ({W_}) w) AS wing_count, (SELECT count(*) FROM ({R_}) r) AS room_count, (SELECT count(*) FROM ({D_}) d) AS drawer_count, (SELECT count(*) FROM ({T_}) t) AS tunnel_count"
O["palace_rooms"] = f"SELECT r.wing, r.room, count(d.path) AS drawers FROM ({R_}) r LEFT JOIN ({D_}) d ON d.wing = r.wing AND d.room = r.room GROUP BY r.wing, r.room"
O["palace_tunnels"] = f"""SELECT a.name AS wing_1, b.name AS wing_2, t.* FROM ({W_}) a JOIN ({W_}) b ON a.name > b.name
JOIN ({T_}) t ON (t.wing_a = a.name AND t.wing_b = b.name) OR (t.wing_a = b.name AND t.wing_b = a.name)"""
O["palace_traverse"] = f"""SELECT g.wing, g.room, g.tunnel, g.other, g.hall, (SELECT count(*) FROM ({D_}) d WHERE d.wing = g.other AND d.room = g.room) AS drawers FROM
(SELECT s.wing, s.room, t.id AS tunnel, CASE WHEN t.wing_a = s.wing THEN t.wing_b ELSE t.wing_a END AS other, CASE WHEN t.wing_a = s.wing THEN t.hall_b ELSE t.hall_a END AS hall
 FROM ({R_}) s JOIN ({T_}) t ON t.room = s.room) g JOIN ({R_}) r ON r.wing = g.other AND r.room = g.room"""
O["palace_document"] = f"SELECT r.wing, r.room, count(d.path) AS drawers, arg_min(d.path, d.ord) AS first FROM ({R_}) r LEFT JOIN ({D_}) d ON d.wing = r.wing AND d.room = r.room GROUP BY r.wing, r.room"
O["session_archive"] = """SELECT conv_id, length(t) AS transcript_length, right(t, 2000) AS transcript_excerpt FROM
(SELECT conv_id, string_agg(concat(coalesce(role, ''), ': ', coalesce(text, '')), chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id) c"""
_L = "SELECT {} AS section, {} AS at, {} AS line"
O["report_session_start"] = f"""WITH n AS ({NOTES}), st AS ({O['notes_stats']}), fs AS ({O['kg_stats']})
SELECT 0 AS section, at - 1 AS at, line FROM (SELECT unnest(['## Session Context', '**Date:** 2024-01-20 (Saturday)', '']) AS line, unnest([1, 2, 3]) AS at) a
UNION ALL SELECT 2, 0, '### Recent Changes (last 48h)' UNION ALL
SELECT 2, CAST(row_number() OVER (ORDER BY ts DESC, line) AS INT), concat('- ', line) FROM (SELECT ts, concat(printf('%X', event_id), ' ', event_type) AS line FROM events ORDER BY ts DESC, line LIMIT 10) c
UNION ALL SELECT 2, 1000, '' UNION ALL SELECT 3, 0, '### Active Work' UNION ALL
SELECT 3, CAST(row_number() OVER (ORDER BY rel_path) AS INT), concat('- ', stem) FROM (SELECT * FROM n WHERE starts_with(rel_path, 'work/active/') ORDER BY rel_path LIMIT 5) w
UNION ALL SELECT 3, 1000, '' UNION ALL SELECT 4, 0, '### Vault Stats' UNION ALL SELECT 4, 1, concat('- Total notes: ', CAST(total_notes AS VARCHAR)) FROM st
UNION ALL SELECT 4, 2, concat('- Brain notes: ', CAST(brain_notes AS VARCHAR)) FROM st UNION ALL SELECT 4, 3, concat('- Orphans (no links): ', CAST(orphans AS VARCHAR)) FROM st UNION ALL SELECT 4, 4, ''
UNION ALL SELECT 5, 0, '### Knowledge Graph' UNION ALL SELECT 5, 1, concat('- Entities: ', CAST(entity_count AS VARCHAR)) FROM fs UNION ALL SELECT 5, 2, concat('- Current facts: ', CAST(current_facts AS VARCHAR)) FROM fs
UNION ALL SELECT 5, 3, concat('- Date range: ', oldest_fact, ' → ', newest_fact) FROM fs UNION ALL SELECT 5, 4, '' UNION ALL SELECT 6, 0, '### Vault Files' UNION ALL
SELECT 6, CAST(row_number() OVER (ORDER BY rel_path) AS INT), concat('- ', rel_path) FROM (SELECT * FROM n ORDER BY rel_path LIMIT 30) f
UNION ALL SELECT 6, 1000, concat('... and ', CAST(total_notes - 30 AS VARCHAR), ' more') FROM st WHERE total_notes > 30"""
O["report_stop"] = f"""WITH n AS ({NOTES}), o AS ({_ORPHANS}), fs AS ({O['kg_stats']})
SELECT 0 AS section, 0 AS at, '## Wrap-Up Checklist' AS line UNION ALL SELECT 0, 1, '' UNION ALL SELECT 1, 0, concat('**Orphan notes:** ', CAST(count(*) AS VARCHAR)) FROM o UNION ALL
SELECT 1, CAST(row_number() OVER (ORDER BY rel_path) AS INT), concat('  - ', name) FROM (SELECT * FROM o ORDER BY rel_path LIMIT 5) x UNION ALL SELECT 1, 1000, '' UNION ALL
SELECT 2, 0, concat('**Brain notes:** ', CAST(count(*) FILTER (WHERE contains(rel_path, 'brain')) AS VARCHAR)) FROM n UNION ALL SELECT 2, 1, '**WARNING:** No North Star found' UNION ALL SELECT 2, 1000, '' UNION ALL
SELECT 3, 0, concat('**KG:** ', CAST(entity_count AS VARCHAR), ' entities, ', CAST(current_facts AS VARCHAR), ' current facts') FROM fs"""
_NCHUNK = f"SELECT path, array_to_string(w[i + 1:i + 512], ' ') AS t FROM (SELECT path, w, unnest(range(0, len(w), 512)) AS i FROM (SELECT rel_path AS path, {_W('content')} AS w FROM ({NOTES}) n) a) b"
O["sync_counts"] = f"""SELECT (SELECT CAST(sum(n) AS BIGINT) FROM ({O['kg_populate_counts']}) k) AS kg_triples, (SELECT count(DISTINCT wing) FROM ({_BUILT}) b) AS palace_wings,
(SELECT count(DISTINCT path) FROM ({_NCHUNK}) c WHERE length(trim(t)) >= 20) AS indexed_files"""
_SCLS = f"SELECT *, {_MAX} AS best FROM (SELECT *, {_SCORES} FROM (SELECT *, substr(content, 1, 200) AS message FROM ({SEC}) s) m) b"
_SROUTE = _ROUTE.replace("rel_path", "file_path")
O["write_routes"] = f"""SELECT vault, split_part(coalesce(file_path, concat(folder, {_NAME('content')}, '.md')), '/', 1) AS folder, count(*) AS n FROM
(SELECT *, {_SROUTE} AS vault FROM (SELECT content, tags, CASE WHEN doc_id % 2 = 0 THEN rel_path END AS file_path, {_PICK(3, R.UNKNOWN[2])} AS folder FROM ({_SCLS}) c) d) e GROUP BY 1, 2"""
_C4 = r"CASE WHEN ord % 4 = 0 THEN regexp_replace(regexp_replace(split_part(content, '## ', 1), '^[\s\p{Z}\x0B\x1C-\x1F\x85]+', ''), '[\s\p{Z}\x0B\x1C-\x1F\x85]+$', '') ELSE substr(content, 1, 500) END"
O["section_extract"] = f"SELECT rel_path, CASE WHEN ord % 4 = 0 AND {_C4} = '' THEN substr(concat('intro', chr(10), '## Current Focus', chr(10), content, chr(10), '## Next', chr(10), 'x'), 1, 500) ELSE {_C4} END AS focus FROM ({NOTES}) n"
O["rpc_guard"] = f"""SELECT CASE WHEN turn % 4 = 2 THEN 'Unknown tool: rm' WHEN conv_id % 5 IN (0, 1) THEN 'Invalid vault_path' END AS error, CAST(least(conv_id * 40, 100) AS INT) AS "limit", count(*) AS requests
FROM ({MSG}) m GROUP BY 1, 2"""
_CHUNKED = """SELECT left(sha256(concat(path, ':', CAST(i AS VARCHAR))), 16) AS hash, path, CAST(i AS INT) AS chunk_index, t AS text FROM (SELECT path, i, array_to_string(w[i + 1:i + 512], ' ') AS t FROM
(SELECT path, w, unnest(range(0, len(w), 512)) AS i FROM (SELECT rel_path AS path, {words} AS w FROM ({notes}) a WHERE {where}) b) c) d WHERE length(trim(t)) >= 20"""
O["index_update"] = (_CHUNKED.format(words=_W("content"), notes=NOTES, where="ord % 10 NOT IN (0, 4)") + " UNION ALL "
                     + _CHUNKED.format(words=_W("concat('rewritten ', content)"), notes=NOTES, where="ord % 10 = 0"))
O["user_sessions"] = """SELECT user_id, min(ts) AS began, max(ts) AS last, count(*) AS messages FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, s"""
O["notes_with_links"] = f"SELECT rel_path FROM ({NOTES}) n WHERE len({_RAWLINKS}) > 0"
O["palace_point_lookup"] = f"""SELECT a.wing, a.room, r.wing IS NOT NULL AS there, d.path FROM (SELECT wing, room FROM ({R_}) x UNION ALL SELECT 'NOWHERE', 'x') a
LEFT JOIN ({R_}) r ON r.wing = a.wing AND r.room = a.room LEFT JOIN ({D_}) d ON d.wing = a.wing AND d.room = a.room"""
OPS = _D(X.OPS)
_LOG = f"""o AS ({OPS}), w AS (SELECT wing, max(seq) AS s FROM o WHERE op = 'create_wing' GROUP BY wing),
live AS (SELECT o.* FROM o LEFT JOIN w ON w.wing = o.wing WHERE op IN ('create_room', 'link_drawer') AND seq > coalesce(w.s, -1)),
r AS (SELECT wing, room, max(CASE WHEN op = 'create_room' THEN seq END) AS s, min(seq) AS made FROM live GROUP BY wing, room)"""
O["palace_replay_drawers"] = f"""WITH {_LOG}, f AS (SELECT l.wing, l.room, path, min(seq) AS seq FROM live l JOIN r ON r.wing = l.wing AND r.room = l.room WHERE op = 'link_drawer' AND seq > coalesce(r.s, -1) GROUP BY l.wing, l.room, path)
SELECT wing, room, path, CAST(row_number() OVER (PARTITION BY wing, room ORDER BY seq) - 1 AS INT) AS ord FROM f"""
O["palace_replay_halls"] = f"""WITH {_LOG} SELECT o.wing, o.room, hall_type, arg_max(content, seq) AS content FROM o JOIN r ON r.wing = o.wing AND r.room = o.room
WHERE op = 'add_hall' AND hall_type <> 'nope' AND seq > made AND seq > coalesce(r.s, -1) GROUP BY o.wing, o.room, hall_type"""
O["palace_replay_tunnels"] = f"""SELECT concat(wing, ':', wing_b, ':', room) AS id, wing AS wing_a, wing_b, room, coalesce(first(hall_a ORDER BY seq), 'hall_events') AS hall_a, coalesce(first(hall_b ORDER BY seq), 'hall_facts') AS hall_b
FROM ({OPS}) o WHERE op = 'create_tunnel' AND room = 'click' GROUP BY wing, wing_b, room"""
O["template_fill"] = "SELECT doc_id, concat('# ', lang, chr(10), coalesce(text, ''), ' {{other}}') AS content FROM documents"
O["text_measures"] = f"""SELECT doc_id, CAST(len({_W('text')}) AS BIGINT) AS tokens, array_to_string(list_filter(list_transform(string_split(string_split(text, chr(10))[1], ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags
FROM documents WHERE text IS NOT NULL"""
O["day_headings"] = "SELECT strftime(ts, '%Y-%m-%d (%A)') AS day, count(*) AS events FROM events GROUP BY 1"
_MINE = NOTES.replace("WHERE NOT (", "WHERE ord % 4 = 0 AND NOT (")
O["sync_counts_dual"] = f"""SELECT s.*, (SELECT CAST(sum(n) AS BIGINT) FROM ({O['kg_populate_counts'].replace(NOTES, _MINE)}) k) AS personal_kg_triples,
(SELECT count(DISTINCT wing) FROM ({_BUILT.replace(NOTES, _MINE)}) b) AS personal_palace_wings FROM ({O['sync_counts']}) s"""
# "at" is a keyword of DuckDB; quoted, except in a message text
ORACLE = {k: re.sub(r"\bat\b(?! least)", '"at"', v) for k, v in O.items()}
