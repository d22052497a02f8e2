import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sparkweft.functions import expr
from sparkweft.plans import tools
from sparkweft.sources import compdb, facts, git, indexer
from sparkweft.sources.store import Store, StoreConflict
from sparkweft.streaming import arrivals

# A stream made up for these tests: one unit of a kitchen program.
BODY = [
    {"t": "meta", "k": "tu", "v": "oven/bake.cc"}, {"t": "meta", "k": "config_source", "v": "compile_commands.json"}, {"t": "meta", "k": "stats", "v": {"symbols": 2, "edges": 1}},
    {"t": "f", "i": 10, "p": "oven/bake.cc"}, {"t": "f", "i": 11, "p": "oven/.././oven//tray.hh"}, {"t": "f", "i": 12, "p": "/sdk/heat.h", "sys": 1},
    {"t": "sym", "u": "u:bake", "k": "function", "n": "bake", "f": 10, "l": 4, "el": 12, "df": 10, "dl": 4, "F": {"inline": 1}},
    {"t": "sym", "u": "u:warm", "k": "method", "n": "warm", "q": "oven::Coil::warm", "stub": 1, "f": 12, "l": 31},
    {"t": "edge", "k": "calls", "a": "u:bake", "b": "u:warm", "f": 10, "l": 7, "F": {"virt": 1}}, {"t": "inc", "f": 10, "b": 11, "l": 1, "sp": "tray.hh"}, {"t": "inc", "f": 10, "b": 99, "l": 2},
    {"t": "diag", "sev": "warning", "f": 11, "l": 5, "c": 2, "m": "tray is unused"}, {"t": "note", "x": 1},
]
DONE = {"t": "done"}


def text(*records):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records)


def decoded(spark, *texts, stamps=None):
    streams = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "stream string, text string")
    return facts.decode(facts.from_texts(streams), "/kitchen", stamps)


def test_a_whole_stream_is_read(spark):
    found, judged = decoded(spark, text(*BODY, "", DONE, ""))
    assert judged.first()["accepted"]
    warm, bake = found.symbols.orderBy(F.desc("usr")).collect()
    assert (bake["qualified"], bake["file"], bake["end_line"], bake["flags"], bake["stub"]) == ("bake", "/kitchen/oven/bake.cc", 12, '{"inline":1}', 0)
    assert (warm["qualified"], warm["file"], warm["stub"], warm["signature"]) == ("oven::Coil::warm", "/sdk/heat.h", 1, "")
    e, i, d, u = found.edges.first(), found.includes.collect(), found.diagnostics.first(), found.units.first()
    assert (e["dst"], e["weight"], e["line"], e["flags"]) == ("u:warm", 1, 7, '{"virt":1}') and len(i) == 1 and i[0]["to_file"] == "/kitchen/oven/tray.hh"
    assert (d["severity"], d["message"]) == ("warning", "tray is unused") and (u["tu"], u["degraded"], u["errors"], u["pch_dropped"]) == ("/kitchen/oven/bake.cc", False, 0, "")
    files = {("/kitchen/oven/bake.cc", False, True), ("/kitchen/oven/tray.hh", False, True), ("/sdk/heat.h", True, False)}
    assert {(r["path"], r["is_system"], r["in_project"]) for r in found.files.collect()} == files


def test_streams_are_read_in_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    records = [json.dumps({"t": "sym", "u": f"u{n}", "n": "x" * 50}) for n in range(3000)]
    (tmp_path / "in" / "a.jsonl").write_bytes("\r\n".join([json.dumps(BODY[0]), *records, json.dumps(DONE)]).encode() + b'\n{"t":"note","m":"\xff"}\n')
    (tmp_path / "in" / "b.jsonl").write_text(text({"t": "diag", "sev": "error", "m": "late"}, {"t": "diag", "sev": "fatal", "m": "no tray"}, {"t": "diag", "sev": "fatal", "m": "nor oven"}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = facts.read_lines(spark, f"{tmp_path}/in")
        assert lines.rdd.getNumPartitions() > 5
        found, judged = facts.decode(lines, "/kitchen")
        said = {os.path.basename(r["stream"]): (r["accepted"], r["reason"]) for r in judged.collect()}
        assert found.symbols.select("usr").distinct().count() == 3000 and said["a.jsonl"] == (True, None) and said["b.jsonl"][1].endswith(": no tray")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_units_carry_errors_fallbacks_and_stamps(spark):
    more = [{"t": "meta", "k": "degraded", "v": "1"}, {"t": "meta", "k": "errors", "v": {"errors": 4}}, {"t": "meta", "k": "pch_dropped", "v": "all.pch"}]
    stamps = spark.createDataFrame([("s0", "abc")], "stream string, stamp string")
    u = decoded(spark, text(*BODY, *more, DONE), stamps=stamps)[0].units.first()
    assert (u["degraded"], u["errors"], u["pch_dropped"], u["stamp"]) == (True, 4, "all.pch", "abc")


@pytest.mark.parametrize(
    "stream, said",
    [
        (text(*BODY), "no end record in s0"),
        (text(*BODY, {"t": "diag", "sev": "fatal", "m": "tray.hh: no such file"}), "tray.hh: no such file"),
        (text({"t": "diag", "sev": "error", "m": "one"}, {"t": "diag", "sev": "error", "m": "two"}), ": one"),
        (text(*BODY, '{"t":"edge","a', DONE), "malformed"),
        (text("7", DONE), "malformed"),
    ],
)
def test_cut_and_malformed_streams_are_rejected_whole(spark, stream, said):
    found, judged = decoded(spark, stream)
    (r,) = judged.collect()
    assert not r["accepted"] and said in r["reason"] and "s0" in r["reason"] and found.symbols.count() == 0


def test_an_empty_stream_holds_nothing(spark):
    assert decoded(spark, "")[0].units.count() == 0


def other(name, *records):
    return text(*[r | {"v": name} if r.get("k") == "tu" else r for r in BODY], *records, DONE)


def test_store_replaces_units_whole(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/index", buckets=3)
    stamps = spark.createDataFrame([("s0", "one"), ("s1", "two")], "stream string, stamp string")
    store.ingest(decoded(spark, text(*BODY, DONE), other("oven/roast.cc"), stamps=stamps)[0])
    assert store.table("symbol").count() == 4 and store.table("file").count() == 3
    asked = spark.createDataFrame([("/kitchen/oven/bake.cc", "one"), ("/kitchen/oven/roast.cc", "new"), ("/kitchen/x.cc", "")], "tu string, stamp string")
    assert sorted(r["tu"] for r in store.stale(asked).collect()) == ["/kitchen/oven/roast.cc", "/kitchen/x.cc"]
    store.rebuild_symbols()
    merged = store.current()[1]["merged"]
    assert store.symbols().count() == 2 and merged[0] == store.current()[1]["data"]
    store.ingest(decoded(spark, text(*[r for r in BODY if r.get("u") != "u:warm" and r["t"] != "diag"], DONE))[0])
    assert {(r["tu"][14:], r["usr"]) for r in store.table("symbol").collect()} == {("bake.cc", "u:bake"), ("roast.cc", "u:bake"), ("roast.cc", "u:warm")}
    assert [r["tu"] for r in store.table("diag").collect()] == ["/kitchen/oven/roast.cc"] and store.current()[1]["merged"][0] < store.current()[1]["data"]
    assert {r["usr"]: r["tu_count"] for r in store.symbols().collect()} == {"u:bake": 2, "u:warm": 1}
    store.drop(spark.createDataFrame([("/kitchen/oven/roast.cc",)], "tu string"))
    assert store.table("unit").count() == 1 and store.table("edge").count() == 1 and {r["usr"] for r in store.symbols().collect()} == {"u:bake"}


def test_store_writes_only_what_changes(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/index", buckets=16)
    store.ingest(decoded(spark, *(other(f"oven/u{i}.cc") for i in range(12)))[0])
    before = store.current()[1]["tables"]
    store.set_meta(root="/kitchen", indexed_at="now")
    store.set_meta(indexed_at="later")
    assert store.get_meta("indexed_at") == "later" and store.get_meta("root") == "/kitchen" and store.get_meta("none") is None
    store.ingest(decoded(spark, other("oven/u5.cc", {"t": "sym", "u": "u:more", "n": "more"}))[0])
    after = store.current()[1]["tables"]
    changed = [b for b in before["symbol"] if before["symbol"][b] != after["symbol"][b]]
    assert len(changed) == 1 and store.table("symbol").count() == 25 and store.table("unit").count() == 12
    gone = store.compact(keep=1)
    import shutil

    store.compact(keep=1, delete=lambda p: shutil.rmtree(p))
    assert any("/symbol/" in g for g in gone) and store.table("symbol").count() == 25 and store.table("file").count() == 3


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    a, b = Store(spark, f"{tmp_path}/index", buckets=2), Store(spark, f"{tmp_path}/index", buckets=2)
    a.set_meta(who="a")
    seen = b._numbers()
    a.set_meta(who="a again")
    monkeypatch.setattr(b, "_numbers", lambda: seen)
    with pytest.raises(StoreConflict):
        b.set_meta(who="b")
    assert a.get_meta("who") == "a again"
    (tmp_path / "index" / "versions" / "9.json").write_text('{"tables": {"un')  # a writer that died at its commit
    assert a.get_meta("who") == "a again" and a.version() == 2


def test_arrivals_are_ingested(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(text(*BODY, DONE))
    (tmp_path / "in" / "b.jsonl").write_text(text(*BODY[:5]))
    store = Store(spark, f"{tmp_path}/index", buckets=2)
    for _ in range(2):
        arrivals.follow(spark, f"{tmp_path}/in", store, f"{tmp_path}/mark", "/kitchen").awaitTermination(120)
    assert store.table("unit").count() == 1 and store.table("symbol").count() == 2


def test_compilation_databases(spark, tmp_path):
    (tmp_path / "build").mkdir()
    entries = [
        {"file": "src/one.cc", "directory": "/w/out/..", "command": "cc -DNAME='a b' -Xclang -include-pch -Xclang '/w/my all.pch' src/one.cc"},
        {"source": "/w/./two.CPP", "directory": "/w", "arguments": ["cc", "-include-pch", "/w/z.pch"]}, {"file": "", "source": "three.c", "command": "cc 'unbalanced three.c"},
        {"file": "/w/pre.cc", "arguments": ["cc", "-Xclang", "-emit-pch"]}, {"file": "/w/pre.cc", "arguments": ["cc"]}, {"file": "/w/pre.hxx", "arguments": ["cc", "-emit-pch"]},
        {"file": "/w/src/../src/one.cc", "command": "cc later"}, {"file": "/w/readme.txt", "command": "cat"},
    ]
    path = tmp_path / "build" / "compile_commands.json"
    path.write_text(json.dumps(entries))
    assert compdb.find(str(tmp_path)) == str(path) and compdb.find(str(tmp_path), str(tmp_path / "build")) == str(path)
    files = compdb.read(spark, str(path))
    assert [tuple(r) for r in files.collect()] == sorted([("/w/src/one.cc", "/w/my all.pch"), ("/w/two.CPP", "/w/z.pch"), (f"{tmp_path}/build/three.c", None)])
    assert [r["path"] for r in compdb.plan(files, ["*/two.*"]).collect()] == ["/w/two.CPP"] and compdb.plan(files, limit=1).count() == 1
    held = compdb.load(spark, str(tmp_path))
    assert (held.source, held.header_builders) == ("discovered", 1) and held.detail.startswith("3 translation units") and "1 that build" in held.detail
    assert compdb.load(spark, str(tmp_path), str(path)).source == "explicit" and compdb.load(spark, str(tmp_path), "/nowhere").path is None
    for bad in ('{"file": "a.cc"}', "not json", ""):
        path.write_text(bad)
        held = compdb.load(spark, str(tmp_path))
        assert held.path is None and held.source == "none" and "no JSON array" in held.detail


def test_walking_and_producing(spark, tmp_path):
    for name in ("pan.cc", "lids/pot.c", ".git/x.c", "node_modules/y.c", "menu.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = compdb.walk(spark, str(tmp_path))
    assert sorted(os.path.basename(r["path"]) for r in found.collect()) == ["pan.cc", "pot.c"]
    missing = spark.createDataFrame([("/nowhere/a.cc",)], "path string")
    assert compdb.present(found.unionByName(missing)).count() == 2
    planned = found.withColumn("header", F.when(F.col("path").endswith("pan.cc"), "x.pch"))
    command = lambda path, again: ["sh", "-c", f"echo {'plain' if again else 'with'}; exit 0" if again or path.endswith("pot.c") else "echo lost >&2; exit 3"]
    rows = {os.path.basename(r["stream"]): (r["text"].strip(), r["error"]) for r in compdb.produce(planned, command).collect()}
    assert rows == {"pan.cc": ("plain", ""), "pot.c": ("with", "")}
    failing = compdb.produce(planned.withColumn("header", F.lit(None).cast("string")), lambda p, _: ["sh", "-c", "echo lost >&2; exit 3"]).first()
    assert failing["error"] == "lost"


EXTRACTOR = """
import json, os, sys
path, again = sys.argv[1], sys.argv[2] == "again"
name = os.path.basename(path)
body = open(path).read()
if "broken" in body or ("header" in body and not again):
    print(json.dumps({"t": "diag", "sev": "fatal", "m": "cannot read " + name}))
    sys.exit(1)
for r in (
    {"t": "meta", "k": "tu", "v": path}, {"t": "meta", "k": "config_source", "v": "compile_commands.json"}, {"t": "meta", "k": "stats", "v": {"symbols": 1, "edges": 0, "includes": 0}},
    *([{"t": "meta", "k": "pch_dropped", "v": "all.pch"}] if again else []),
    {"t": "f", "i": 0, "p": path}, {"t": "sym", "u": "u:" + body.split()[0], "k": "function", "n": body.split()[0], "f": 0, "l": 1}, {"t": "done"},
):
    print(json.dumps(r))
"""


def test_index_command(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (tmp_path / "extract.py").write_text(EXTRACTOR)
    for name, body in (("a.cc", "alpha"), ("b.cc", "beta header"), ("c.cc", "gamma"), ("d.cc", "delta broken")):
        (root / name).write_text(body)
    entries = [{"file": n, "directory": str(root), "command": "cc" + (" -include-pch all.pch" if n == "b.cc" else "")} for n in ("a.cc", "b.cc", "c.cc", "d.cc", "missing.cc")]
    (root / "compile_commands.json").write_text(json.dumps(entries))
    script = str(tmp_path / "extract.py")
    run = lambda **k: indexer.index(spark, str(root), store, lambda p, again: [sys.executable, script, p, "again" if again else "once"], **k)
    store = Store(spark, f"{tmp_path}/index", buckets=4)
    first = run()
    assert (first.total, first.indexed, first.failed, first.unchanged, first.pch_dropped) == (4, 3, 1, 0, 1) and "5 translation units" in first.notes[0]
    told = {os.path.basename(r["path"]): r for r in first.results.collect()}
    assert "cannot read d.cc" in told["d.cc"]["detail"] and told["a.cc"]["symbols"] == 1 and told["b.cc"]["pch_dropped"] == "all.pch"
    assert {r["usr"] for r in store.symbols().collect()} == {"u:alpha", "u:beta", "u:gamma"} and store.get_meta("root") == str(root)
    merged = store.current()[1]["merged"]
    again = run()
    assert (again.indexed, again.unchanged, again.failed) == (0, 3, 1) and store.current()[1]["merged"] == merged  # nothing new, nothing merged
    (root / "a.cc").write_text("alpha2")
    (root / "c.cc").write_text("gamma broken")
    third = run()
    assert (third.indexed, third.unchanged, third.failed) == (1, 1, 2) and {r["usr"] for r in store.symbols().collect()} == {"u:alpha2", "u:beta", "u:gamma"}  # a failure keeps what was there
    full = run(incremental=False, only=["*/a.cc", "b.cc"])
    assert (full.total, full.indexed) == (2, 2)
    status = tools.call(tools.Index.open(store, str(root)), "get_index_status")
    assert status["accuracy"] == "approximate" and status["pch_dropped_tus"] == 1 and status["built_at"]
    os.remove(root / "compile_commands.json")
    bare = indexer.plan(spark, str(root), limit=2)
    assert bare.degraded and bare.files.count() == 2 and "guessed" in bare.notes[1]


PATCH = """diff --git a/m.c b/m.c
--- a/m.c
+++ b/m.c
@@ -7 +7,2 @@ g
--- old;
+++ counter;
+plain
@@ -40,3 +42,0 @@
-a
--- b/x
-c
diff --git a/was.c b/is.c
--- /dev/null
+++ b/is.c
@@ -0,0 +1,2 @@
+++ b/other.c
+z
\\ No newline at end of file
diff --git a/p.c b/p.c
--- a/p.c
+++ b/p.c
@@ -3 +3 @@
-q
+r
diff --git a/del.c b/del.c
--- a/del.c
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b"""


def test_patches_become_ranges(spark):
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(PATCH.split("\n"))], "diff int, seq int, line string")
    assert {tuple(r) for r in git.ranges(lines).collect()} == {("m.c", 7, 8), ("m.c", 42, 42), ("is.c", 1, 2), ("p.c", 3, 3)}
    said = spark.createDataFrame([("M\tm.c",), ("R090\twas.c\tis.c",), ("D\tdel.c",), ("T\tlink",), ("",)], "line string")
    assert {tuple(r) for r in git.statuses(said).collect()} == {("m.c", "", "modified"), ("is.c", "was.c", "renamed"), ("del.c", "", "deleted"), ("link", "", "type changed")}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kitchen")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "oven").mkdir()
    (root / "oven" / "bake.cc").write_text("".join(f"step {i}\n" for i in range(1, 21)))
    run("add", ".")
    run("commit", "-qm", "x")
    changed = (root / "oven" / "bake.cc").read_text().replace("step 9\n", "++ crumbs;\n")
    (root / "oven" / "bake.cc").write_text(changed)
    (root / "knead.cc").write_text("x\n")
    store = Store(spark, f"{root}/.index", buckets=2)
    more = [{"t": "sym", "u": "u:bake2", "k": "function", "n": "bake", "f": 10, "l": 15, "el": 18}, {"t": "edge", "k": "calls", "a": "u:bake2", "b": "u:bake", "f": 10, "l": 16}]
    more += [{"t": "sym", "u": "u:gone", "k": "function", "n": "gone", "f": 11, "l": 1}]
    streams = spark.createDataFrame([("s", text(*BODY, *more, DONE))], "stream string, text string")
    store.ingest(facts.decode(facts.from_texts(streams), str(root))[0])
    return tools.Index.open(store, str(root))


def test_all_questions_are_there():
    assert len(tools.TOOLS) == 19


def test_questions_about_symbols(index):
    ask = lambda name, **a: tools.call(index, name, a)
    assert ask("get_index_status")["accuracy"] == "exact"
    assert ask("find_symbol", reference="BAK")["match_count"] == 2
    got = ask("get_symbol", symbol="u:bake")
    assert (got["callers"], got["callees"], got["location"]) == (1, 0, "oven/bake.cc:4") and got["properties"] == {"inline": True}
    assert ask("get_function", symbol="u:bake")["callers"] == 1
    assert ask("search_symbols", query="AKE")["matches"][0]["symbol"] == "bake" and ask("search_symbols", query="zzz")["note"]
    callers = ask("get_callers", symbol="u:bake")
    assert callers["callers_count"] == 1 and callers["callers"][0]["call_site"] == "oven/bake.cc:16"
    assert ask("get_callees", symbol="u:bake2", limit="3")["callees"][0]["symbol"] == "bake" and ask("get_references", symbol="u:bake")["references"] == []
    assert ask("get_symbol_dependencies", symbol="u:bake")["dependency_count"] == 1 and ask("get_impact_analysis", symbol="u:bake")["direct"][0]["symbol"] == "bake"
    assert ask("get_inheritance", symbol="u:bake")["bases"] == []
    source = ask("get_source_context", symbol="u:bake2", context_lines=1)
    assert (source["start"], source["end"]) == (14, 19) and source["source"].startswith("14: step 14\n15: step 15")
    assert ask("get_source_context", symbol="u:gone")["error"].startswith("cannot read")


def test_questions_about_files_and_changes(index):
    ask = lambda name, **a: tools.call(index, name, a)
    assert ask("get_file", path="bake.cc")["languages"] == ["c++"] and ask("get_file_symbols", path="oven/bake.cc")["symbol_count"] == 2
    assert ask("get_includes", path="bake.cc")["includes"][0]["path"] == "oven/tray.hh" and ask("get_file_dependencies", path="tray.hh")["included_by_count"] == 1
    assert ask("get_diagnostics")["diagnostics"][0]["location"] == "oven/tray.hh:5"
    changed = ask("get_changed_symbols", include_impact="yes")
    assert [(r["symbol"], r["lines"]) for r in changed["changed_symbols"]] == [("bake", "9")]
    assert {f["path"] for f in changed["files"]} >= {"oven/bake.cc", "knead.cc"}


def test_wrong_questions_say_why(index):
    assert "candidates" in json.loads(tools.answer(index, "get_symbol", {"symbol": "bake"}))
    assert json.loads(tools.answer(index, "get_symbol", {"symbol": "nothing"}))["error"].startswith("no symbol") and "required" in json.loads(tools.answer(index, "get_symbol"))["error"]
    assert json.loads(tools.answer(index, "get_class", {"symbol": "u:bake"}))["kind"] == "function" and "known" in json.loads(tools.answer(index, "what"))


def test_expressions(spark):
    df = spark.createDataFrame([("É_a", "é_a"), ("AbC", "aBc"), ("a\\b", "a\\b"), ("axb", "a_b")], "x string, p string")
    assert [r[0] for r in df.select(expr.like(F.col("x"), F.col("p"))).collect()] == [False, True, True, True]
    row = spark.createDataFrame([("src/a.c:12-14", "f(int)")], "l string, s string").select(*expr.split_location(F.col("l")), *expr.split_signature(F.col("s")), expr.language(F.lit("/x/Y.CPP"))).first()
    assert tuple(row) == ("src/a.c", 12, "f", "(int)", "c++")
