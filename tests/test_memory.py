import json
import shutil
import subprocess
from datetime import datetime, timezone

import pytest

from noteloom import rpc
from noteloom.memory import Memory
from noteloom.operators import facts as K
from noteloom.sources import stores, vault
from noteloom.streaming import streams


def make(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_md", ".md")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")


def test_vault_round_trip(spark, tmp_path):
    make(tmp_path, brain__A_md="---\ndate: 2026-04-10\ntags: [t]\n---\nSee [[B]]", brain__B_md="Héllo 日本語 [[A]] with more words here", empty_md="", **{"_x__hid_md": "hidden"})
    (tmp_path / "North Star.md").write_text("x")
    got = {r.rel_path: r for r in vault.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"brain/A.md", "brain/B.md", "empty.md", "_x/hid.md", "North Star.md"}
    assert got["brain/B.md"].content == "Héllo 日本語 [[A]] with more words here" and got["empty.md"].raw == "" and got["brain/A.md"].tags == ["t"]

    m = Memory(spark, str(tmp_path))
    assert m.kg_populate() == 7 and m.kg_query("A").count() == 5
    m.kg_add_one("Kai", "works_on", "Orion", "2025-06-01")
    assert m.kg_stats().first().triple_count == 8
    assert m.palace_build() == 2 and m.rebuild_index() >= 1
    assert m.search("héllo").first().path == "brain/B.md" and Memory(spark, str(tmp_path), embed=None).search("héllo").count() == 1 and "## Session Context" in m.session_start()
    assert m.find_orphans().count() == 3

    call = lambda name, **a: rpc.call(lambda _: m, name, a)
    assert call("ao_classify", message="We decided to use X")["type"] == "decision"
    assert call("ao_nope") == {"error": "Unknown tool: ao_nope"} and "Missing" in call("ao_classify")["error"]
    assert call("ao_status", vault_path="/") == {"error": "Invalid vault_path"}
    assert len(call("ao_search", query="a", limit=999999)["results"]) <= 100
    assert call("ao_palace_tunnel", wing_a="brain", wing_b="work", room="a")["status"] == "ok"
    out = list(rpc.serve(lambda _: m, ['{"id": 1, "method": "tools/list"}', "{bad", '{"id": 2, "method": "shutdown"}', '{"id": 3, "method": "tools/list"}']))
    assert len(out) == 2 and len(json.loads(out[0])["result"]["tools"]) == 19 and json.loads(out[1])["error"]["code"] == -32603


def test_two_vaults(spark, tmp_path):
    a, b = tmp_path / "s", tmp_path / "p"
    make(a, brain__plan_md="---\ndate: 2026-01-02\ntags: [t]\n---\nThe plan, see [[Home]].")
    make(b, brain__draft_md="---\ndate: 2026-04-10\ntags: [x, y]\n'@private': true\n---\nDraft idea. Password: hunter2 @private")
    m = Memory(spark, str(a), config=stores.VaultConfig(str(a), str(b)))
    new = spark.createDataFrame([("We agreed on a spec", ["x"], None, None), ("my password: y", [], "private/k.md", None)], "content string, tags array<string>, file_path string, vault string")
    assert {(r.vault, r.rel_path) for r in m.write(new).collect()} == {("shared", "thinking/We-agreed-on-a-spec.md"), ("personal", "private/k.md")}
    assert (b / "private/k.md").exists() and m.personal.kg_query("k").count() == 2
    assert m.export(["brain/draft.md"]).first().action == "preview" and not (a / "brain/draft.md").exists()
    assert m.export(["brain/draft.md"], confirm=False).first().action == "exported"
    text = (a / "brain/draft.md").read_text()
    assert "hunter2" not in text and "@private" not in text and 'vault: "shared"' in text and 'tags: ["x", "y"]' in text and "date: 2026-04-10" in text
    assert {r.object for r in m.kg_query("draft").collect()} >= {"x", "y", "brain"}
    m.import_notes(["brain/plan.md"])
    text = (b / "brain/plan.md").read_text()
    assert "*Imported from shared: [[brain/plan.md]]*" in text and f'imported_from: "{a}/brain/plan.md"' in text and m.personal.kg_query("plan").count() > 2
    with pytest.raises(FileNotFoundError):
        m.import_notes(["brain/none.md"])
    with pytest.raises(ValueError):
        Memory(spark, str(a)).export(["x.md"])
    got = m.sync()
    assert got["personal_kg_triples"] > 0 and got["personal_palace_wings"] == 2 and got["kg_triples"] > 0
    call = lambda name, **k: rpc.call(lambda path: Memory(spark, str(a)), name, {**k, "shared_vault_path": str(a), "personal_vault_path": str(b)})
    assert call("ao_export", note_path="private/k.md")["action"] == "preview" and call("ao_export")["error"] == "Missing required argument: 'note_path'"
    assert call("ao_import", note_path="no.md") == {"error": "FileNotFoundError"}


def test_migrate(spark, tmp_path):
    make(tmp_path / "v", brain__A_md="We decided [[B]]", notes__key_md="my password: x", notes__odd_md="plain")
    (tmp_path / "v/notes/odd.md").write_bytes(b"\xff\xfe plain")
    m = Memory(spark, str(tmp_path / "v"))
    got = m.migrate(str(tmp_path / "s"), str(tmp_path / "p"), config_path=str(tmp_path / "c/config.yaml"))
    assert (got["shared_notes"], got["personal_notes"]) == (1, 2) and (tmp_path / "s/brain/A.md").read_text() == "We decided [[B]]"
    assert (tmp_path / "p/notes/odd.md").read_bytes() == b"\xff\xfe plain" and m.config.dual
    c = stores.VaultConfig.load(spark, str(tmp_path / "c/config.yaml"))
    assert (c.shared_path, c.personal_path) == (str(tmp_path / "s"), str(tmp_path / "p"))


def test_config(spark, tmp_path):
    c = stores.VaultConfig.parse("vaults:\n  shared:\n    path: /a\n  personal:\n    path: /b\nisolation:\n  mode: manual\n")
    assert (c.shared_path, c.personal_path, c.isolation_mode) == ("/a", "/b", "manual") and stores.VaultConfig.parse(c.dump()) == c
    for broken in (None, "", "[1, 2]", "vaults: {shared: 3}", "isolation: {mode: nope}", "a: [b"):
        assert stores.VaultConfig.parse(broken) == stores.VaultConfig(), broken
    assert stores.VaultConfig.load(spark, str(tmp_path / "none.yaml")) == stores.VaultConfig()


def test_brain_and_templates(spark, tmp_path):
    make(tmp_path, templates__Work_Note_md="---\ntags: [work]\n---\n# {{title}} by {{who}} {{left}}")
    (tmp_path / "templates/Work_Note.md").rename(tmp_path / "templates/Work Note.md") if (tmp_path / "templates/Work_Note.md").exists() else None
    m = Memory(spark, str(tmp_path))
    m.rebuild_index()
    m.update_brain("Decisions", "We chose [[Postgres]] for the DB and for all that follows.")
    assert [(r.predicate, r.object) for r in m.kg_query("Decisions").collect() if r.predicate == "links_to"] == [("links_to", "Postgres")]
    m.update_brain("Decisions", "Then [[Kafka]].", append=True)
    assert (tmp_path / "brain/Decisions.md").read_text() == "We chose [[Postgres]] for the DB and for all that follows.\nThen [[Kafka]]."
    assert m.kg_query("Kafka").count() == 1 and [r.path for r in m.catalogue().drawers.collect()] == ["brain/Decisions.md"]
    assert m.search("postgres").first().path == "brain/Decisions.md"
    with pytest.raises(ValueError):
        m.update_brain("../x", "y")
    name = next(x.stem for x in (tmp_path / "templates").iterdir())
    m.from_template(f"../{name}", "work/active/New.md", {"title": "T", "who": "me"})
    assert (tmp_path / "work/active/New.md").read_text().endswith("# T by me {{left}}") and "work" in (tmp_path / "work/active/New.md").read_text().split("---")[1]
    with pytest.raises(FileNotFoundError):
        m.from_template("none", "x.md", {})
    with pytest.raises(ValueError):
        m.from_template(name, "../x.md", {})
    make(tmp_path, work__active__Job_md="see [[Decisions]]")
    assert m.post_tool("write", "work/active/Job.md").success is False and m.kg_query("Job").count() >= 2
    assert {(r.wing, r.room) for r in m.catalogue().rooms.collect()} == {("brain", "decisions"), ("work", "job")}
    said = m.pre_compact("x" * 3000, "session-12345", datetime(2026, 1, 2, 3, 4, 5))
    log = json.loads((tmp_path / "thinking/session-logs/2026-01-02_030405_session-.json").read_text())
    assert "2026-01-02_030405_session-.json" in said and log["transcript_length"] == 3000 and len(log["transcript_excerpt"]) == 2000
    assert m.init()["success"] and (tmp_path / "perf/brag").is_dir()


def test_versions(spark, tmp_path):
    t = stores.Versioned(spark, str(tmp_path / "t"), stores.ENTITIES, buckets=4)
    assert not t.written and t.read().count() == 0
    rows = lambda ids, kind: spark.createDataFrame([(f"i{i}", f"n{i}", kind) for i in ids], stores.ENTITIES)
    t.write(rows(range(40), "a"))
    before = t._state()["buckets"]
    one = rows([3], "b")
    t.merge(one, lambda old: old.join(one.select("id"), "id", "left_anti").select("id", "name", "type").union(one))
    after = t._state()["buckets"]
    assert sum(before[k] != after[k] for k in before) == 1 and t.read().count() == 40 and t.read().where("type = 'b'").count() == 1
    t.write(t.read().where("id <> 'i3'"))
    assert t.read().count() == 39
    for _ in range(3):
        t.clear()
    assert t.read().count() == 0 and len(t._folders()) <= 2
    t.write(rows([1], "c"))
    (tmp_path / "t/CURRENT").unlink()
    with pytest.raises(OSError):  # never an empty table in place of a lost pointer
        t.read()


def test_indexes_and_odd_files(spark, tmp_path):
    chunks = spark.createDataFrame([("h", "a.md", 0, "text", [1.0, 2.0])], stores.CHUNKS)
    for _ in range(2):
        stores.write_index(chunks, str(tmp_path / "index"))
    got = stores.read_index(spark, str(tmp_path / "index")).first()
    assert (got.hash, got.path, got.embedding) == ("h", "a.md", [1.0, 2.0]) and stores.read_index(spark, str(tmp_path / "none")) is None
    (tmp_path / "i.json").write_text(json.dumps({"model": "m", "chunks": [{"hash": "x", "path": "b.md", "chunk_index": 0, "text": "t", "embedding": [0.5]}]}))
    assert stores.read_index(spark, str(tmp_path / "i.json")).first().path == "b.md"
    (tmp_path / "broken.json").write_text("{")
    assert stores.read_index(spark, str(tmp_path / "broken.json")) is None
    (tmp_path / "v").mkdir()
    (tmp_path / "v/bad.md").write_bytes(b"ab\xff\xfe")
    (tmp_path / "v/good.md").write_text("ok")
    (tmp_path / "v/_hidden.md").write_bytes(b"\xff")
    assert {r.rel_path: r.raw for r in vault.read(spark, str(tmp_path / "v")).collect()} == {"bad.md": "", "good.md": "ok", "_hidden.md": ""}


def test_git_log(spark, tmp_path, monkeypatch):
    if not shutil.which("git"):
        pytest.skip("needs git")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@example.com", *a], cwd=tmp_path, check=True, capture_output=True)
    make(tmp_path, A_md="a")
    git("init")
    git("add", ".")
    git("commit", "-m", "first note")
    assert [r.line.split(" ", 1)[1] for r in stores.git_log(spark, str(tmp_path)).collect()] == ["first note"]
    assert "first note" in Memory(spark, str(tmp_path)).session_start()
    assert stores.git_log(spark, str(tmp_path), datetime(2100, 1, 1, tzinfo=timezone.utc)).count() == 0
    monkeypatch.setattr(stores.shutil, "which", lambda _: None)
    assert stores.git_log(spark, str(tmp_path)) is None


def test_rpc_tools(spark):
    listed = rpc.answer(None, '{"id": 1, "method": "tools/list"}')["result"]["tools"]
    by = {t["name"]: t["inputSchema"] for t in listed}
    assert len(by) == 19 and by["ao_kg_add"]["required"] == ["subject", "predicate", "object"] and by["ao_search"]["properties"]["limit"] == {"type": "integer", "default": 5}
    assert rpc.refused("ao_status", "C:\\") == rpc.refused("ao_status", "a/../b") == "Invalid vault_path" and rpc.refused("ao_status", "vault") is None and rpc.refused("ao_statusx", "v") == "Unknown tool: ao_statusx"
    assert rpc.answer(None, '{"id": 1, "method": "other"}') is None and rpc.answer(None, "[1]")["error"]["code"] == rpc.INTERNAL_ERROR


def test_note_streams(spark, tmp_path):
    notes = vault.parse(spark.createDataFrame([("brain/A.md", "See [[B]] and many other words here"), ("brain/B.md", "back to [[A]]")], "rel_path string, raw string"))
    at = lambda n, s, k="id": stores.Versioned(spark, str(tmp_path / n), s, k)
    f, e, d, c = at("f", stores.TRIPLES), at("e", stores.ENTITIES), at("d", stores.DRAWERS, "wing"), at("c", stores.CHUNKS, "path")
    merge = streams.notes_into(f, e, d, "2026-01-01", c)
    for _ in range(2):
        merge(notes, 0)
    assert f.read().count() == 4 and d.read().count() == 2 and c.read().count() == 1 and e.read().count() == 3
    merge(vault.parse(spark.createDataFrame([("brain/A.md", "Now without links but with words enough")], "rel_path string, raw string")), 1)
    assert c.read().first().text.startswith("Now") and d.read().count() == 2
    turns = spark.createDataFrame([("c1", 0, "user", "hello"), ("c1", 1, "bot", "bye")], "conv_id string, turn int, role string, text string")
    for _ in range(2):
        streams.archive_into(str(tmp_path / "logs"), "agent", "2026-01-01T00:00:00")(turns, 0)
    (row,) = spark.read.json(str(tmp_path / "logs/batch-0")).collect()
    assert row.session_id == "c1" and row.transcript_length == len("user: hello\nbot: bye")


def test_streams(spark, tmp_path):
    rows = [(1, 0, "We decided to go"), (1, 1, "wrap up now"), (2, 0, "what is it?")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, message string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("conv_id bigint, turn bigint, message string").parquet(str(tmp_path / "in"))
    streams.classified(source).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert {r.message_type for r in spark.table("seen").collect()} == {"decision", "wrap-up", "question"}
    streams.last_types(source).writeStream.format("memory").queryName("last").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.conv_id, r.last_type) for r in spark.table("last").collect()} == {(1, "wrap-up"), (2, "question")}

    facts, entities = (stores.Versioned(spark, str(tmp_path / n), s) for n, s in (("f", stores.TRIPLES), ("e", stores.ENTITIES)))
    merge = streams.facts_into(facts, entities, "2026-01-01")
    batch = spark.createDataFrame([("a", "p", "b", "2020-01-01", 1), ("a", "p", "b", "2019-01-01", 2)], "subject string, predicate string, object string, valid_from string, seq bigint")
    for _ in range(2):
        merge(batch, 0)
    assert [r.valid_from for r in facts.read().collect()] == ["2019-01-01"] and entities.read().count() == 2
    assert K.stats(facts.read(), entities.read(), "2026-01-01").first().triple_count == 1
