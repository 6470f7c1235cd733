"""Unit tests of the vault operators on small frames."""

import json
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratadoc.functions import text as T
from stratadoc.operators import graph, lint, packet, reconcile, reports, retrieval, state
from stratadoc.plans import ingest
from stratadoc.sources import files, sinks
from stratadoc.streaming import activity


def rows(frame, *cols):
    return sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=str)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def manifest(spark, data):
    return frame(spark, data, state.MANIFEST)


def test_delta_classes_moves_and_copies(spark):
    now = manifest(spark, [("a", "1"), ("b", "2x"), ("c", "3"), ("m2", "5"), ("copy1", "6"), ("copy2", "6")])
    then = manifest(spark, [("a", "1"), ("b", "2"), ("m1", "5"), ("gone", "9"), ("copy0", "6")])
    got = state.delta(now, then)
    assert rows(got, "path", "old_path", "change_type") == sorted(
        [("a", "a", "unchanged"), ("b", "b", "changed"), ("c", None, "new"), ("m2", "m1", "moved"), (None, "gone", "deleted"), ("copy1", "copy0", "moved"), ("copy2", None, "new")], key=str
    )
    assert state.needs_maintenance(got)
    assert rows(state.proceeding(got), "path") == [("b",), ("c",), ("copy2",)]


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("123"), max_size=6), st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("123"), max_size=6))
def test_accepting_a_delta_reaches_a_fixed_point(spark, now, then):
    current, old = manifest(spark, list(now.items())), manifest(spark, list(then.items()))
    accepted = state.accepted(old, state.delta(current, old))
    assert rows(accepted, "path", "sha256") == sorted(now.items())
    assert {r.change_type for r in state.delta(current, accepted).collect()} <= {"unchanged"}


def test_gates(spark):
    s = frame(spark, [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, None), (2, 2, True)], "run_id int, stage_no int, ok boolean")
    assert rows(state.gates(s), "run_id", "stage_no", "may_run") == [(1, 1, True), (1, 2, True), (1, 3, False), (2, 1, True), (2, 2, False)]


def test_renamed_edges(spark):
    edges = frame(spark, [("p", "m1", "ref"), ("m1", "q", "link"), ("p", "gone", "ref")], "src string, dst string, edge_type string")
    found = state.delta(manifest(spark, [("m2", "5")]), manifest(spark, [("m1", "5"), ("gone", "9")]))
    assert rows(graph_edges := state.renamed(edges, found), "src", "dst") == [("m2", "q"), ("p", "m2")] and graph_edges.columns == ["src", "dst", "edge_type"]


PAGE = "---\nconfidence: high\ntags: a: b\n---\n# T\nsee [[x]] and [[y|label]]\n## References\n- [[src/1]]\n- [[src/2]]\n## Notes\nmine\n"


@pytest.fixture
def vault(tmp_path):
    # A folder of the same name above it must not matter.
    data = tmp_path / "Data" / "v" / "Data"
    (data / "Inbox").mkdir(parents=True)
    (data / "Inbox" / "ä+b c.md").write_text("één\n")
    (data / "Inbox" / "%41.txt").write_bytes(b"bytes \xff |")
    (data / "sub").mkdir()
    (data / "sub" / "empty.md").write_text("")
    (data / "top.md").write_text(PAGE)
    return tmp_path


def test_files_are_read_and_parsed(spark, vault):
    root = str(vault / "Data" / "v" / "Data")
    inv = files.inventory(spark, root)
    assert rows(inv, "path", "folder", "length") == [("Inbox/%41.txt", "Inbox", 9), ("Inbox/ä+b c.md", "Inbox", 6), ("sub/empty.md", "sub", 0), ("top.md", None, len(PAGE))]
    assert rows(inv.filter("length = 0"), "sha256") == [("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",)]
    assert rows(files.pages(spark, root), "path") == [("Inbox/ä+b c.md",), ("top.md",)]
    assert rows(files.texts(spark, root).filter("path like '%txt'"), "text") == [("bytes \ufffd |",)]
    page = files.pages(spark, root).filter("path = 'top.md'").first()
    assert page.frontmatter == {"confidence": "high", "tags": "a: b"}
    assert page.links == ["x", "y", "src/1", "src/2"] and page.references == ["src/1", "src/2"] and page.notes == "mine"
    assert [s.heading for s in page.sections] == ["References", "Notes"]
    both = files.collections(spark, {"data": root, "level-knowledge": root})
    assert rows(retrieval.index_status(both), "collection", "n_items") == [("data", 2), ("level-knowledge", 2)]
    empty = files.parse(frame(spark, [("p", None)], "path string, text string")).first()
    assert empty.frontmatter is None and empty.sections == [] and empty.notes is None
    (vault / "none").mkdir()
    assert files.inventory(spark, str(vault / "none")).count() == 0


def test_policy_and_settings_files(spark, tmp_path):
    (tmp_path / "tags.md").write_text("| tag | color |\n|---|---|\n| ops | `#AABBCC` |\n| x y | #000001 |\n")
    assert rows(files.tag_policy(spark, str(tmp_path / "tags.md")), "tag", "color") == [("ops", "#aabbcc"), ("x y", "#000001")]
    (tmp_path / "graph.json").write_text(json.dumps({"scale": 2, "colorGroups": [{"query": "path:a", "color": {"a": 1, "rgb": 255}}]}))
    got = files.graph_settings(spark, str(tmp_path / "graph.json")).first()
    assert (got.query, got.color) == ("path:a", "#0000ff") and json.loads(got.rest)["scale"] == 2
    (tmp_path / "index.md").write_text("# I\n## Clients\n- [[acme]]\n## Tools\n- [[vim|Vim]]\n")
    assert rows(files.catalog(spark, str(tmp_path / "index.md")), "heading", "target") == [("Clients", "acme"), ("Tools", "vim")]
    (tmp_path / "a.png").write_bytes(b"x")
    assert files.images(spark, str(tmp_path)).count() == 1


def places(tmp_path):
    return [str(tmp_path / k) for k in ("manifest", "log", "wiki")]


def test_ingest_accepts_only_after_all_stages(spark, vault, tmp_path):
    root = vault / "Data" / "v" / "Data"
    text = PAGE.replace("src/1", "top").replace("src/2", "Knowledge/ä+b c.md").replace("see [[x]] and [[y|label]]", "see [[w]]")
    page = frame(spark, [("w.md", text)], "path string, text string")
    bad = frame(spark, [("w.md", text.replace("mine", "other"))], "path string, text string")
    where = places(tmp_path)
    args = (spark, str(root), *where)

    def fails(packet):
        raise RuntimeError("no reviewer")

    day = date(2024, 1, 2)
    (root / "Inbox" / "stray").write_text("nowhere")
    blocked = ingest.ingest(*args, fails, day)
    assert blocked.stages == [("inbox", False)] and blocked.note == "blocked: stray"
    assert (root / "Knowledge" / "ä+b c.md").exists() and (root / "Resources" / "%41.txt").exists()
    (root / "Inbox" / "stray").unlink()
    assert ingest.ingest(*args, fails, day).note.startswith("preflight: not_utf8")
    (root / "Resources" / "%41.txt").unlink()
    assert ingest.ingest(*args, fails, day).stages[-1] == ("review", False)
    assert not ingest.ingest(*args, lambda p: page, day, lambda: False).accepted
    assert sinks.current(spark, where[0]) is None
    run = ingest.ingest(*args, lambda p: page, day)
    assert run.accepted and [s for s, _ in run.stages] == ["inbox", "detect", "packet", "preflight", "review", "validate", "accept"]  # the pages were written before the refresh that failed
    assert rows(sinks.read_current(spark, where[2] + "-catalog", sinks.CATALOG), "target") == [("w",)]
    assert rows(sinks.read_current(spark, where[2] + "-state/dependencies", "src string, dst string, edge_type string"), "dst", "edge_type") == [("Knowledge/ä+b c", "reference"), ("top", "reference"), ("w", "link")]
    assert ingest.ingest(*args, fails, day).note == "nothing new"
    (root / "new.md").write_text("see the page w of mine\n")
    seen = {}

    def review(p):
        seen.update(sources=rows(p.sources, "path"), pages=rows(p.pages, "path"), found=rows(p.candidates, "path", "page", "origin"))
        return bad

    broken = ingest.ingest(*args, review, day)
    assert not broken.accepted and broken.stages[-1] == ("validate", False) and broken.note.endswith(": notes")
    assert seen == {"sources": [("new.md",)], "pages": [("w.md",)], "found": [("new.md", "w.md", "search")]}
    worse = frame(spark, [("v.md", PAGE + "\n"), ("u.md", text.replace("see", "ask a@b.cd").replace("confidence", "c"))], "path string, text string")
    assert ingest.ingest(*args, lambda p: worse, day).note.endswith(": metadata, confidence, references, redaction, dependencies")
    assert ingest.ingest(*args, lambda p: page.unionByName(page), day).note.endswith(": repeated")
    again = frame(spark, [("team/w.md", text)], "path string, text string")
    assert ingest.ingest(*args, lambda p: again, day).note.endswith(": dependencies")
    (root / "new.md").rename(root / "newer.md")
    (root / "top.md").rename(root / "moved.md")
    assert ingest.ingest(*args, lambda p: page, day).note.startswith("moved")
    assert spark.read.parquet(where[1]).count() == 1
    ingest.bootstrap(spark, str(root), where[0])
    assert {r.change_type for r in state.delta(files.inventory(spark, str(root)), sinks.read_current(spark, where[0], state.MANIFEST)).collect()} == {"unchanged"}


def test_a_file_that_changes_during_the_review_is_not_accepted(spark, vault, tmp_path):
    root = vault / "Data" / "v" / "Data"
    (root / "Inbox" / "%41.txt").unlink()
    args = (spark, str(root), *places(tmp_path))
    seen = {}

    def review(p):
        seen.update({r.path: r.sha256 for r in p.sources.collect()})
        (root / "top.md").write_text("edited")
        (root / "sub" / "empty.md").write_text("no more")
        return frame(spark, [], "path string, text string")

    assert ingest.ingest(*args, review, date(2024, 1, 2)).accepted
    accepted = dict(rows(sinks.read_current(spark, args[2], state.MANIFEST), "path", "sha256"))
    assert accepted == seen and len(seen) == 3
    again = {}
    assert ingest.ingest(*args, lambda p: again.update(dict(rows(p.sources, "path", "text"))) or frame(spark, [], "path string, text string"), date(2024, 1, 3)).accepted
    assert again == {"top.md": "edited", "sub/empty.md": "no more"}
    (root / "top.md").write_text("")  # a file that loses its content is changed and not gone
    got = state.delta(files.inventory(spark, str(root)), sinks.read_current(spark, args[2], state.MANIFEST))
    assert rows(got.filter("change_type <> 'unchanged'"), "path", "change_type") == [("top.md", "changed")]


def test_only_pages_of_the_packet_may_be_rewritten(spark):
    old = files.parse(frame(spark, [("a.md", PAGE), ("b.md", PAGE)], "path string, text string"))
    found = ingest.findings(old, old, manifest(spark, [("src/1", "1"), ("src/2", "2")]), old.filter("path = 'a.md'"))
    assert rows(found["outside"], "path") == [("b.md",)]
    assert [k for k, v in found.items() if v.head(1)] == ["outside"]


def test_a_version_is_valid_only_with_its_commit(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "n int"
    one = frame(spark, [(1,)], schema)
    sinks.write_version(one, root)
    one.write.parquet(f"{root}/v-unfinished")  # a run that stopped before its commit
    (tmp_path / "t" / "commits" / "000000000002.tmp").write_text("half")
    assert rows(sinks.read_current(spark, root, schema), "n") == [(1,)]
    at = sinks.current(spark, root)
    sinks.write_version(frame(spark, [(2,)], schema), root)
    with pytest.raises(Exception):  # a writer that started from the same version
        sinks.write_text(spark, f"{root}/commits/{at[0] + 1:012d}", "v-late", replace=False)
    assert rows(sinks.read_current(spark, root, schema), "n") == [(2,)]
    assert not [p for p in (tmp_path / "t" / "commits").iterdir() if p.name.startswith("000000000002.") and "tmp" not in p.name and not p.name.endswith(".crc")]


def test_settings_keep_what_is_not_theirs(spark, tmp_path):
    path = tmp_path / "graph.json"
    path.write_text(json.dumps({"scale": 2, "colorGroups": [{"query": "path:a", "color": {"a": 0.5, "rgb": 255}, "x": 1}, {"query": "path:old", "color": {"a": 1, "rgb": 1}}]}))
    groups = frame(spark, [("path:a", "#0000ff"), ("tag:#n", "#000010")], "query string, color string")
    assert sinks.write_settings(spark, str(path), groups) and not sinks.write_settings(spark, str(path), groups)
    got = json.loads(path.read_text())
    assert got == {"scale": 2, "colorGroups": [{"query": "path:a", "color": {"a": 0.5, "rgb": 255}, "x": 1}, {"query": "tag:#n", "color": {"a": 1, "rgb": 16}}]}
    entries = frame(spark, [("team", "team/x")], sinks.CATALOG)
    assert sinks.update_catalog(spark, entries, str(tmp_path / "c")) and not sinks.update_catalog(spark, entries, str(tmp_path / "c"))


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    one = frame(spark, [(1, "a")], "n int, s string")
    sinks.dated_report(one, root, "lint", date(2024, 1, 1))
    assert spark.read.parquet(f"{root}/kind=lint").count() == 1
    sinks.planning(one, f"{root}/daily")
    sinks.planning(one, f"{root}/daily")
    sinks.append_history(one, f"{root}/history")
    sinks.append_history(one, f"{root}/history")
    assert spark.read.parquet(f"{root}/daily").count() == 1 and spark.read.parquet(f"{root}/history").count() == 2
    assert not sinks.write_if_changed(one, one, f"{root}/config") and sinks.write_if_changed(one, one.limit(0), f"{root}/config")
    messages = frame(spark, [(datetime(2024, 1, 31, 23), "u", "sent", "c", "t"), (datetime(2024, 2, 1), "u", "ping", "c", "t")], "ts timestamp, user string, kind string, channel string, text string")
    sinks.append_activity(messages, f"{root}/activity")
    assert rows(spark.read.parquet(f"{root}/activity"), "kind", "month") == [("ping", "2024-02"), ("sent", "2024-01")]
    pages = frame(spark, [("p", "x"), ("q", "y")], "path string, text string")
    sinks.snapshot(pages, pages.filter("path = 'p'"), f"{root}/snap")
    assert rows(spark.read.parquet(f"{root}/snap"), "path") == [("p",)]


def test_bm25_on_edge_cases(spark):
    docs = frame(spark, [(1, "red fox"), (2, "red red dog"), (3, None), (4, "")], "doc_id long, text string")
    queries = frame(spark, [(1, "Red!"), (2, "none such"), (3, None)], "item_id long, text string")
    got = retrieval.bm25(docs, queries).collect()
    assert sorted((r.item_id, r.doc_id, r["rank"]) for r in got) == [(1, 1, 2), (1, 2, 1)]
    assert retrieval.bm25(docs.limit(0), queries).count() == 0


def test_nearest_is_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in r.normal(size=8)]) for i in range(60)] + [(99, None)]
    e = frame(spark, vectors, "vec_id long, embedding array<float>").repartition(4)
    got = rows(retrieval.nearest(e, e.filter("vec_id % 10 = 0"), 3), "query_id", "vec_id", "rank")
    m = np.array([v for _, v in vectors[:60]], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = []
    for q in range(0, 60, 10):
        s = np.round(m @ m[q], 6)
        s[q] = -9
        want += [(q, int(d), k + 1) for k, d in enumerate(np.lexsort((np.arange(60), -s))[:3])]
    assert got == sorted(want, key=str)


def test_packet_checks(spark):
    pages = files.parse(frame(spark, [("p", PAGE), ("q", "no front")], "path string, text string"))
    assert rows(packet.metadata_gaps(pages, ["confidence", "owner"]), "path", "missing") == [("p", "owner"), ("q", "confidence"), ("q", "owner")]
    assert rows(packet.bad_confidence(pages, files.CONFIDENCE), "path") == [("q",)]
    assert rows(lint.missing_sections(pages, ["References"]), "path") == [("q",)]
    assert rows(lint.invalid(pages, {"confidence": ("low",)}), "path", "value") == [("p", "high")]
    after = pages.filter("path = 'p'").withColumn("notes", F.lit("mine"))
    assert rows(packet.touched_notes(pages.filter("path = 'p'"), after), "path") == []
    assert rows(packet.touched_notes(pages, after.limit(0)), "path") == [("p",), ("q",)]
    text = frame(spark, [("mail a@b.cd from 10.0.0.1",)], "text string")
    assert text.select(packet.redacted(F.col("text"))).first()[0] == "mail [email] from [ipv4]"
    refs = frame(spark, [("p", "src/1"), ("p", "src/9")], "page string, path string")
    assert rows(packet.dangling_references(refs, frame(spark, [("src/1",)], "path string")), "path") == [("src/9",)]
    assert rows(packet.bounded(pages, frame(spark, [("p",)], "path string"), "path"), "path") == [("p",)]


def test_components_do_not_depend_on_edge_order(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)]
    want = sorted([(i, 0) for i in range(31)] + [(100, 100), (101, 100)])
    for e in (edges, edges[::-1], [(b, a) for a, b in edges]):
        assert sorted(rows(graph.components(frame(spark, e, "a long, b long").repartition(3)), "node", "label")) == want
    assert graph.components(frame(spark, [], "a long, b long")).count() == 0


def test_impact_stops_at_hops_and_cycles(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("x", "x")], "src string, dst string")
    assert rows(graph.impact(edges, frame(spark, [("a",), ("x",)], "node string")), "node", "hops") == [("a", 0), ("b", 1), ("c", 2), ("x", 0)]


def test_reconcile_is_idempotent_and_keeps_manual_groups(spark):
    schema = "query string, color string, origin string"
    actual = frame(spark, [("path:a", "#1", "domain"), ("path:old", "#2", "domain"), ("file:x", "#3", "manual"), ("path:c", "#9", "domain")], schema)
    wanted = frame(spark, [("path:a", "#1", "domain"), ("path:b", "#4", "domain"), ("path:c", "#5", "domain")], schema)
    changes = reconcile.reconcile(actual, wanted)
    assert rows(changes, "query", "action") == [("file:x", "keep"), ("path:a", "keep"), ("path:b", "add"), ("path:c", "correct"), ("path:old", "remove")]
    again = reconcile.applied(changes).withColumn("origin", F.when(F.col("query") == "file:x", "manual").otherwise("domain"))
    assert {r.action for r in reconcile.reconcile(again, wanted).collect()} == {"keep"}


def test_tag_audit_boundary(spark):
    tagged = frame(spark, [(p, ["two"]) for p in (1, 2)] + [(p, ["three", "colored", "wild", "three"]) for p in (1, 2, 3)], "page long, tags array<string>")
    tag = lambda *t: frame(spark, [(x,) for x in t], "tag string")
    assert rows(reconcile.audit_tags(tagged, tag("two", "three", "colored"), tag("colored")), "tag", "n_pages") == [("three", 3)]
    got = reconcile.next_color(frame(spark, [("n",), ("m",), ("o",)], "domain string"), ["#1", "#2", "#3"], frame(spark, [("#2",)], "color string"))
    assert rows(got, "domain", "color") == [("m", "#1"), ("n", "#3"), ("o", None)]


def test_time_windows():
    on = date(2026, 7, 15)
    assert reports.time_window("last week", on) == (date(2026, 7, 6), date(2026, 7, 13))
    assert reports.time_window("June 2026", on) == (date(2026, 6, 1), date(2026, 7, 1))
    assert reports.time_window("last 30 days", on) == (date(2026, 6, 16), date(2026, 7, 16))
    assert reports.time_window("2024-12", on) == (date(2024, 12, 1), date(2025, 1, 1))
    with pytest.raises(ValueError):
        reports.time_window("soon", on)


def test_briefing_and_todo(spark):
    schema = "task_id long, title string, due timestamp, done boolean, priority string"
    d = lambda n: datetime(2024, 5, n)
    t = frame(spark, [(1, "a", d(1), False, "3"), (2, "b", d(10), False, "1-x"), (3, "c", d(12), False, "3"), (4, "e", d(9), True, "3"), (5, "f", None, False, "3"), (6, "g", d(30), False, "3")], schema)
    assert rows(reports.briefing(t, date(2024, 5, 10)), "task_id", "bucket") == [(1, "overdue"), (2, "due_today"), (3, "upcoming"), (4, "recently_completed")]
    before = frame(spark, [("- [ ] A\n- [x] done\n- [ ] kept\n- [ ] Closed  since\n",)], "text string")
    carried = reports.carried_over(before, frame(spark, [("closed since",)], "title string"))
    assert rows(carried, "title") == [("A",), ("kept",)]
    parts = [t.filter("not done").select("title", "due", "priority", F.lit("task").alias("origin")), carried.select("title", F.lit(None).cast("timestamp").alias("due"), F.lit("5").alias("priority"), F.lit("carry").alias("origin"))]
    got = reports.todo(parts, date(2024, 5, 10), date(2024, 5, 11))
    assert rows(got, "norm", "label", "n_origins") == [("a", "1-overdue", 2), ("b", "2-high", 1), ("f", "4-carried", 1), ("kept", "4-carried", 1)]


def test_connectors(spark):
    m = frame(spark, [(datetime(2024, 1, 1, 9), "u", "c", "t"), (datetime(2024, 1, 2), "u", "c", "t")], "ts timestamp, user string, channel string, text string")
    assert rows(reports.chat_activity(m, m, m.limit(0), date(2024, 1, 1)), "kind") == [("mention",), ("sent",)]
    meetings = frame(spark, [(1, datetime(2024, 1, 1), True, "s"), (2, datetime(2024, 1, 1), False, None)], "meeting_id long, ended_at timestamp, has_summary boolean, summary string")
    assert rows(reports.meetings_to_export(meetings, date(2024, 1, 1)), "meeting_id") == [(1,)]
    cards = frame(spark, [("a", "Red Fox"), ("b", None), ("c", "fox")], "card_id string, title string")
    assert rows(reports.cards(cards, ["b"]), "card_id") == [("b",)]
    assert rows(reports.cards(cards, ["b"], "fox, RED"), "card_id") == [("a",), ("b",)]
    assert reports.cards(cards, keyword="?").count() == 0
    turns = frame(spark, [(1, 1, "assistant", None), (1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert reports.transcripts(turns).first().transcript == "user: hi\nassistant: "


def test_lint_cycle(spark):
    schema = "rule string, severity int, page string, detail string"
    found = frame(spark, [("stale", 1, "b", "x"), ("stale", 1, "a", "x"), ("broken_link", 3, "z", "y")], schema)
    numbered = lint.plan(found)
    assert rows(numbered, "issue_no", "page") == [(1, "z"), (2, "a"), (3, "b")]
    chosen = lint.selected(numbered, [2, 77])
    assert rows(chosen, "page") == [("a",)]
    again = found.filter("page <> 'a'")
    assert lint.remaining(chosen, again).count() == 0
    assert rows(lint.lifecycle(found, again.unionByName(frame(spark, [("orphan", 1, "n", "")], schema))), "page", "state") == [("a", "resolved"), ("b", "open"), ("n", "new"), ("z", "open")]
    pages = manifest(spark, [("a", "1"), ("b", "2")])
    assert lint.untouched(pages, manifest(spark, [("a", "9"), ("b", "2")]), chosen.select(F.col("page").alias("path"))).count() == 0
    assert lint.untouched(pages, manifest(spark, [("a", "9"), ("b", "3")]), chosen.select(F.col("page").alias("path"))).count() == 2


def test_streaming(spark, tmp_path):
    events = [(datetime(2024, 1, d, h), 1, "click") for d in (1, 2, 5) for h in (1, 2)]
    frame(spark, events, "ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
    q = activity.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert {(str(r.day), r.n) for r in spark.table("daily").collect()} >= {("2024-01-01", 2), ("2024-01-02", 2)}
    q = activity.append_monthly(stream, str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert activity.sessions(batch).count() == 6


def test_text_functions(spark):
    got = frame(spark, [("É-a b_1!",)], "t string").select(T.tokens(F.col("t"))).first()[0]
    assert got == ["é", "a", "b", "1"]


def test_similar_pairs_are_all_pairs(spark):
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.sample(base, r.randint(20, 60))) for _ in range(120)] + ["the", "the!", "", "the a", None, "the"]
    for _ in range(30):  # a group of near copies larger than any limit on common terms
        w = list(base)
        w[r.randrange(60)] = f"x{r.randrange(9)}"
        texts.append(" ".join(w))
    sets = {}
    for i, t in enumerate(texts):
        if t is not None and t not in {texts[j] for j in sets}:
            sets[i] = set(t.replace("!", "").split())
    want = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and (j := round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) >= 0.7:
                want.append((a, b, j))
    got = graph.similar(frame(spark, list(enumerate(texts)), "doc_id long, text string"))
    assert rows(got, "a", "b", "score") == sorted(want, key=str) and len(want) > 400
    assert graph.similar(frame(spark, [], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("terms", [graph.COMMON, 700])
def test_similar_pairs_are_compared_where_they_meet(spark, monkeypatch, terms):
    import random

    r = random.Random(5)
    monkeypatch.setattr(graph, "BLOCK_TERMS", terms, raising=False)
    monkeypatch.setattr(graph, "CELLS", min(terms, 1 << 20), raising=False)
    monkeypatch.setattr(graph, "COMMON", terms)
    sets = {f"d{i}": {f"w{r.randrange(40)}" for _ in range(r.randint(1, 60))} for i in range(90)}
    for i in range(90, 110):  # one size, more terms than a block
        sets[f"d{i}"] = {f"w{k}" for k in r.sample(range(46), 40)}
    ids = sorted(sets)
    scores = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in ids for b in ids if a < b and sets[a] != sets[b]}
    got = graph.similar(frame(spark, [(i, " ".join(sorted(s, key=lambda w: (len(i), w)))) for i, s in sets.items()], "doc_id string, text string"))
    want = {(a, b, x) for (a, b), x in scores.items() if x >= 0.7}
    same = {(a, b) for a in ids for b in ids if a < b and sets[a] == sets[b]}
    assert {x for x in rows(got, "a", "b", "score") if (x[0], x[1]) not in same} == want and len(want) > 100
    # Only similar pairs leave a task: no terms of pairs that merely meet are dealt out.
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_matched_pages_are_the_same_in_one_block_or_many(spark, monkeypatch):
    docs = [(i, " ".join(f"t{(i * k) % 17}" for k in range(1, 9))) for i in range(40)] + [(40, None), (41, "")]
    pages = [(f"p{i}", " ".join(f"t{(i + k) % 23}" for k in range(6))) for i in range(30)] + [("none", None)]
    sources, wiki = frame(spark, docs, "doc_id long, text string"), frame(spark, pages, "page string, text string")
    cols = ("doc_id", "page", "score", "cosine", "fused", "rank")
    one = rows(retrieval.matched(sources, wiki, 4, 5, page="page"), *cols)
    monkeypatch.setattr(retrieval, "POSTINGS", 40)
    assert one == rows(retrieval.matched(sources, wiki, 4, 5, page="page"), *cols) and len(one) >= 150
    assert retrieval.matched(sources, wiki.limit(0), 4, page="page").count() == 0


def test_hybrid_finds_what_has_no_common_term(spark, monkeypatch):
    docs = frame(spark, [(1, "red fox"), (2, "fox fox dog"), (3, None)], "doc_id long, text string")
    queries = frame(spark, [(i, t) for i, t in enumerate(["red", "fox", "", "dog cat"])], "item_id long, text string")
    got = rows(retrieval.hybrid(docs, queries), "item_id", "doc_id", "score", "rank")
    assert {(q, d) for q, d, *_ in got} >= {(0, 1), (1, 1), (1, 2), (3, 2)}
    near = rows(retrieval.closest(docs, queries, 1), "item_id", "doc_id", "cosine")
    monkeypatch.setattr(retrieval, "QUERY_VECTORS", 1)
    assert rows(retrieval.closest(docs, queries, 1), "item_id", "doc_id", "cosine") == near and (1, 2) in {(q, d) for q, d, _ in near}


def test_fallback_and_references(spark):
    found = frame(spark, [(1, 10, 1, "low", False), (2, 11, 1, "high", None), (2, 12, 2, "low", False), (3, 11, 1, None, True), (4, 12, 1, "high", False)], "doc_id long, item_id long, rank int, confidence string, needs_precision boolean")
    claims = frame(spark, [(11, "a", "x"), (12, "a", "y"), (12, "a", None), (10, "a", None)], "item_id long, attribute string, value string")
    got = rows(retrieval.fallback(found, claims), "doc_id", "low", "imprecise", "contradicting", "raw")
    assert got == [(1, True, False, False, True), (2, False, False, True, True), (3, False, True, False, True), (4, False, False, False, False)]
    pages = frame(spark, [("p", "low"), ("q", "high"), ("r", None)], "page string, confidence string")
    refs = frame(spark, [("p", "s1"), ("p", "s1"), ("p", "none"), ("q", "s1"), ("r", "s1")], "page string, path string")
    assert rows(retrieval.referenced(pages, refs, manifest(spark, [("s1", "h")])), "page", "path", "sha256") == [("p", "s1", "h")]


def test_embedding_hook(spark):
    docs = frame(spark, [(1, "ab"), (2, None)], "doc_id long, text string")
    got = retrieval.embedded(docs, "doc_id", lambda t: F.array(F.length(t), F.lit(1)))
    assert rows(got, "doc_id", "dim", "w") == [(1, 0, 2.0), (1, 1, 1.0), (2, 1, 1.0)]
    assert rows(retrieval.embedded(docs, "doc_id").groupBy("doc_id").agg(F.sum("w").alias("w")), "doc_id", "w") == [(1, 1.0)]


def test_packet_queue_and_neighbours(spark):
    found = frame(spark, [(1, 10, 5.0, 1), (1, 11, 4.0, 2), (2, 12, 1.0, 1)], "doc_id long, item_id long, score double, rank int")
    sources = frame(spark, [(1,), (2,), (3,)], "doc_id long")
    assert rows(packet.unmatched(sources, found, 1.0), "doc_id", "score") == [(2, 1.0), (3, 0.0)]
    edges = frame(spark, [(10, 20), (20, 11), (11, 10), (12, 12), (30, 12)], "src long, dst long")
    assert rows(packet.neighbours(found, edges), "doc_id", "item_id", "via") == [(1, 20, 10), (2, 30, 12)]


def test_catalog_changes(spark):
    entries = graph.catalog_entries(frame(spark, [("clients/acme.md",), ("top.md",)], "path string"))
    assert rows(entries, "heading", "target") == [("", "top"), ("clients", "clients/acme")]
    catalog = frame(spark, [("clients", "clients/acme"), ("tools", "tools/old")], "heading string, target string")
    assert rows(graph.catalog_changes(entries, catalog), "target", "action") == [("tools/old", "remove"), ("top", "add")]
    assert graph.catalog_changes(entries, entries).count() == 0


def test_opportunities(spark):
    metrics = frame(spark, [("m", "a", 1.0), ("m", "b", 0.0), ("m", "c", 0.0), ("m", "d", None)], "metric string, subject string, value double")
    assert rows(reports.opportunities(metrics, 2), "subject", "rank", "lacks") == [("b", 1, 0.333333), ("c", 2, 0.333333)]
