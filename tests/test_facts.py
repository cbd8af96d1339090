import pytest

from noteloom.operators import facts as K

TODAY = "2026-04-10"
BATCH = "subject string, predicate string, object string, valid_from string, valid_to string, seq bigint"


def store(spark, *rows):
    batch = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], BATCH)
    return K.upsert(None, batch, TODAY), K.upsert_entities(None, K.entities_of(batch))


def ask(spark, triples, entity, day=None):
    got = K.as_of(triples, spark.createDataFrame([(entity, day)], "entity string, as_of string"), TODAY)
    return [(r.subject, r.predicate, r.object) for r in K.ordered(got).collect()]


@pytest.fixture(scope="module")
def kai(spark):
    return store(spark, ("Kai", "works_on", "Orion", "2025-06-01", "2025-12-01"), ("Kai", "works_on", "Loom", "2026-01-01", None))[0].cache()


def test_window(spark, kai):
    assert ask(spark, kai, "Kai", "2025-09-01") == [("Kai", "works_on", "Orion")]
    assert ask(spark, kai, "Kai", "2026-03-01") == [("Kai", "works_on", "Loom")]
    assert ask(spark, kai, "Kai", "2025-12-01") == [("Kai", "works_on", "Orion")]  # the end belongs to the window
    assert ask(spark, kai, "Kai", "2025-06-01") and not ask(spark, kai, "Kai", "2025-05-31")
    assert ask(spark, kai, "Kai", "") == ask(spark, kai, "Kai", TODAY)
    assert ask(spark, kai, "Loom", "2026-03-01") and not ask(spark, kai, "kai", "2026-03-01")


def test_self_loop_once(spark):
    t, _ = store(spark, ("a", "is", "a", "2020-01-01", None))
    assert ask(spark, t, "a") == [("a", "is", "a")]


def test_add_again_replaces(spark):
    t, e = store(spark, ("a", "p", "b", "2020-01-01", "2021-01-01"), ("a", "p", "b", "2024-01-01", None))
    (r,) = t.collect()
    assert (r.valid_from, r.valid_to) == ("2024-01-01", None) and e.count() == 2
    closed = K.invalidate(t, spark.createDataFrame([("a", "p", "b", None), ("x", "p", "b", None)], "subject string, predicate string, object string, ended string"), TODAY)
    assert closed.first().valid_to == TODAY and closed.count() == 1
    again = K.upsert(closed, spark.createDataFrame([("a", "p", "b", None, None, 9)], BATCH), TODAY)
    assert [(r.valid_from, r.valid_to) for r in again.collect()] == [(TODAY, None)]


def test_id_collision(spark):
    t, _ = store(spark, ("a|b", "c", "d", None, None), ("a", "b|c", "d", None, None))
    assert [r.subject for r in t.collect()] == ["a"]  # one id; the later write stays


def test_future_facts_are_current(spark):
    t, e = store(spark, ("a", "p", "b", "2030-01-01", None), ("a", "p", "c", "2020-01-01", "2021-01-01"))
    s = K.stats(t, e, TODAY).first()
    assert (s.entity_count, s.triple_count, s.current_facts, s.expired_facts, s.oldest_fact, s.newest_fact) == (3, 2, 1, 1, "2020-01-01", "2030-01-01")
    assert ask(spark, t, "a") == []


def test_first_type_stays(spark):
    batch = spark.createDataFrame([("x", "person", 1), ("x", "note", 2), ("y", None, 3)], "name string, type string, seq bigint")
    e = {r.name: r.type for r in K.upsert_entities(None, batch).collect()}
    assert e == {"x": "person", "y": "unknown"}
    e = K.upsert_entities(K.upsert_entities(None, batch), spark.createDataFrame([("x", "z", 0)], "name string, type string, seq bigint"))
    assert {r.name: r.type for r in e.collect()}["x"] == "person"


def test_timeline(spark, kai):
    rows = K.timeline(kai, spark.createDataFrame([("Kai",), ("Orion",)], "entity string")).orderBy("entity", "date").collect()
    assert [(r.entity, r.direction, r.label) for r in rows] == [
        ("Kai", "outbound", "Kai --works_on--> Orion"), ("Kai", "outbound", "Kai --works_on--> Loom"), ("Orion", "inbound", "Kai --works_on--> Orion")]


def test_plan_has_no_cartesian(spark, kai):
    keys = spark.createDataFrame([("Kai", None)], "entity string, as_of string")
    plan = K.as_of(kai, keys, TODAY)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_populate(spark):
    notes = spark.createDataFrame(
        [(1, "Test", "brain/Test.md", "Links to [[North Star]] and [[ Key.md |k]] [[North Star]]", ["auth", "security"], "2026-04-10", "long enough text"),
         (2, "Auth", "work/active/Auth.md", "none", None, None, "short")],
        "ord bigint, stem string, rel_path string, content string, tags array<string>, date string, description string")
    t, e = K.populate(None, None, notes, TODAY)
    got = {(r.subject, r.predicate, r.object) for r in t.collect()}
    assert got == {("Test", "links_to", "North Star"), ("Test", "links_to", "Key.md"), ("Test", "has_tag", "auth"), ("Test", "has_tag", "security"),
                   ("Test", "in_folder", "brain"), ("Test", "created_on", "2026-04-10"), ("Auth", "in_folder", "work"), ("Auth", "in_subfolder", "work/active")}
    n = {r.rel_path: r.n for r in K.attempts(notes).collect()}
    assert n == {"brain/Test.md": 8, "work/active/Auth.md": 2}  # repeats and the description count
    assert {r.name: r.type for r in e.collect()}["Test"] == "unknown"


def test_empty(spark):
    none = spark.createDataFrame([], BATCH)
    t = K.upsert(None, none, TODAY)
    assert t.count() == 0 and K.stats(t, K.upsert_entities(None, K.entities_of(none)), TODAY).first().triple_count == 0
