"""Registered queries read whole texts and ask with every key."""

from noteloom.plans.registry import QUERIES


def test_whole_texts(spark, tmp_path):
    """What stands behind the cut of a text reaches the operators."""
    late = "w " * 700
    docs = [(i, f"{late}sk-abcdefghij0123456789XYZ [[late{i}]]", "en", "web", 0) for i in (3, 6, 7)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, t, "user", f"{late}the outage had a root cause") for t in range(3)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert all("[[late" in r.content and "sk-abc" not in r.content for r in run("content_redact"))
    assert {r.target for r in run("notes_links")} >= {"late3", "late6", "late7"}
    assert {r.message_type for r in run("msg_classify")} == {"incident"}


def test_whole_searches(spark, tmp_path):
    """Every row whose id is divisible by 20 asks, beyond one block."""
    n = 300 * 20
    docs = spark.range(n).selectExpr("id as doc_id", "concat('word', id, ' shared text') as text", "'en' as lang", "'web' as source", "0L as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    near = "array(cast(cos(id) as float), cast(sin(id) as float), cast(id / 6000 as float))"
    spark.range(n).selectExpr("id as vec_id", "cast(id % 10 as int) as label", f"{near} as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = lambda name: {r.qid for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert asked("search_vector") == set(range(0, n, 20))


def test_whole_keys(spark, tmp_path):
    """All users and pairs are asked for, and the latest of all events is shown."""
    rows = [(i, 100 + i % 7, ["click", "view"][i % 2], f'{{"k": {i}}}', 1.0, f"2024-01-{1 + i // 10:02d} 00:00:00") for i in range(100)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, props string, value double, at string")
    events.selectExpr("event_id", "cast(at as timestamp) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "text", "en", "web", 4)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {f"user:{100 + i}" for i in range(7)} <= {r.entity for r in run("kg_asof_facts")}
    assert {(r.subject, r.predicate) for r in run("kg_relation")} == {(f"user:{100 + i}", p) for i in range(7) for p in ("click", "view")}
    assert any(r.line.startswith("- 63 ") for r in run("report_session_start"))
