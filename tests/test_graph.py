from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkweft import model
from sparkweft.operators import closure, edges, family, impact, merge, ranges, resolve, status
from sparkweft.plans import catalogue

# A small drawing library, made up for these tests: shapes in a namespace, three of them in a line of descent.
FILES = [("lib/shape.h", False, True), ("lib/disc.cpp", False, True), ("lib/ring.cpp", False, True), ("bin/draw.cpp", False, True), ("/sdk/math.h", True, False)]
SYM = "usr string, kind string, name string, qualified string, signature string, type_text string, file_id string, line int, col int, end_line int, def_file_id string, def_line int, parent_usr string, flags string, stub int, tu_count long, in_project boolean"
EDGE = "tu_id string, kind string, src string, dst string, file_id string, line int, weight long, flags string"


def sym(usr, kind, qualified, signature, file, line, end=None, parent=None, flags=None, def_file=None, def_line=None):
    return (usr, kind, qualified.rsplit("::", 1)[-1], qualified, signature, None, file, line, 1, end, def_file, def_line, parent, flags, 0, 1, not file.startswith("/sdk"))


SYMBOLS = [
    sym("geo", "namespace", "geo", "", "lib/shape.h", 1, 60),
    sym("shape", "class", "geo::Shape", "", "lib/shape.h", 5, 20, parent="geo"),
    sym("shape.area", "method", "geo::Shape::area", "() const", "lib/shape.h", 8, 8, parent="shape", flags='{"virtual":1}'),
    sym("disc", "class", "geo::Disc", "", "lib/shape.h", 24, 34, parent="geo"),
    sym("disc.area", "method", "geo::Disc::area", "() const", "lib/shape.h", 27, 9, parent="disc", def_file="lib/disc.cpp", def_line=4),
    sym("ring", "class", "geo::Ring", "", "lib/shape.h", 38, 50, parent="geo"),
    sym("ring.area", "method", "geo::Ring::area", "() const", "lib/shape.h", 41, 14, parent="ring", def_file="lib/ring.cpp", def_line=6),
    sym("square", "function", "geo::square", "(double)", "lib/disc.cpp", 12, 15, parent="geo"),
    sym("draw", "function", "draw", "(const geo::Shape &)", "bin/draw.cpp", 3, 11),
    sym("start", "function", "main", "()", "bin/draw.cpp", 13, 20),
    sym("scale#i", "function", "scale", "(int)", "bin/draw.cpp", 22),
    sym("scale#d", "function", "scale", "(double)", "bin/draw.cpp", 23),
    sym("hypot", "function", "hypot", "(double, double)", "/sdk/math.h", 90),
]
EDGES = [
    ("disc", "inherits", "disc", "shape", "lib/shape.h", 24, 1, '{"acc":"pub"}'),
    ("ring", "inherits", "ring", "disc", "lib/shape.h", 38, 1, '{"acc":"priv"}'),
    ("disc", "overrides", "disc.area", "shape.area", "lib/shape.h", 27, 1, None),
    ("ring", "overrides", "ring.area", "disc.area", "lib/shape.h", 41, 1, None),
    ("disc", "calls", "disc.area", "square", "lib/disc.cpp", 6, 1, None),
    ("ring", "calls", "ring.area", "disc.area", "lib/ring.cpp", 7, 1, None),
    ("ring", "calls", "ring.area", "square", "lib/ring.cpp", 8, 1, None),
    ("ring", "calls", "ring.area", "hypot", "lib/ring.cpp", 9, 1, None),
    ("draw", "param_type", "draw", "shape", "bin/draw.cpp", 3, 1, None),
    ("draw", "calls", "draw", "shape.area", "bin/draw.cpp", 5, 1, '{"virt":1}'),
    ("draw", "calls", "start", "draw", "bin/draw.cpp", 16, 1, None),
    ("draw", "references", "start", "scale#d", "bin/draw.cpp", 17, 1, None),
]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, SYM)


@pytest.fixture(scope="module")
def graph(spark):
    return lambda *more: spark.createDataFrame([*EDGES, *more], EDGE)


def neighbours(graph, symbols, usr, **k):
    return [r for r in edges.neighbours(graph, symbols, **k).where(F.col("usr") == usr).collect()]


def test_callers_carry_their_site_and_dispatch(graph, symbols):
    found = {r["other"]: r for r in neighbours(graph(), symbols, "square")}
    assert {o: r["sites"] for o, r in found.items()} == {"disc.area": ["lib/disc.cpp:6"], "ring.area": ["lib/ring.cpp:8"]}
    assert all(r["occurrences"] is None and r["via"] is None and r["dispatch"] is None for r in found.values())
    assert neighbours(graph(), symbols, "shape.area")[0]["dispatch"] == "virtual"


def test_two_units_reporting_one_call_report_one_call(graph, symbols):
    again = [(tu, "calls", "start", "square", "bin/draw.cpp", 18, 3, None) for tu in ("x", "y", "z")]
    found = {r["other"]: r for r in neighbours(graph(*again), symbols, "square")}
    assert (found["start"]["site_count"], found["start"]["occurrences"]) == (1, 3) and found["ring.area"]["occurrences"] is None


def test_sites_are_counted_exactly_and_shown_in_part(graph, symbols):
    many = [("draw", "calls", "start", "square", "bin/draw.cpp", n, 1, None) for n in range(100, 140)]
    every = {r["other"]: r for r in neighbours(graph(*many), symbols, "square", limit=3)}
    assert every["start"]["site_count"] == 40 and every["start"]["sites"] == [f"bin/draw.cpp:{n}" for n in range(100, 105)]
    assert [r["other"] for r in neighbours(graph(*many), symbols, "square", limit=1)] == ["disc.area"]


def test_references_tell_other_kinds(graph, symbols):
    via = neighbours(graph(("draw", "calls_indirect", "start", "scale#d", "bin/draw.cpp", 19, 1, None)), symbols, "scale#d", kinds=model.REFERENCES)
    assert via[0]["via"] == ["calls_indirect", "references"] and via[0]["site_count"] == 2


def test_degree_counts_symbols_not_rows(graph, symbols):
    more = [(f"t{i}", "calls", "disc.area", "square", "lib/disc.cpp", 7, 1, None) for i in range(3)]
    found = {r["usr"]: r["degree"] for r in edges.degree(graph(*more), symbols).collect()}
    assert found == {"square": 2, "disc.area": 1, "hypot": 1, "shape.area": 1, "draw": 1}


def test_dependencies_list_once_and_total(graph, symbols):
    more = [("other", "calls", "ring.area", "square", "lib/ring.cpp", 8, 1, None)]
    rows = edges.dependencies(graph(*more), symbols, per_kind=2).where("usr = 'ring.area'").collect()
    assert {(r["kind"], r["other"], r["kind_count"], r["total"]) for r in rows} == {("calls", "disc.area", 3, 4), ("calls", "square", 3, 4), ("overrides", "disc.area", 1, 4)}


def test_fold_drops_selves_and_keeps_the_first_line(spark):
    rows = [("u", "uses", "p", "q", 7, 30, 2, 0, "{}"), ("u", "uses", "p", "q", 7, 12, 5, 1, None), ("u", "uses", "q", "q", 7, 3, 1, 2, None), ("u", "uses", "p", "", 7, 4, 1, 3, None), ("w", "uses", "p", "q", 7, 8, 1, 4, None)]
    df = spark.createDataFrame(rows, "tu_id string, kind string, src string, dst string, file_id int, line int, weight long, seq int, flags string")
    assert {tuple(r) for r in edges.fold(df).collect()} == {("u", "uses", "p", "q", 7, 7, 30, "{}"), ("w", "uses", "p", "q", 7, 1, 8, None)}


RAW = "tu_id string, usr string, stub int, name string, file_id string, line int, def_file_id string, def_line int, end_line int"


@pytest.mark.parametrize(
    "rows, line, end",
    [
        ([("m", "k", 1, "n", "lib/shape.h", 3, None, None, None), ("n", "k", 0, "n", "lib/shape.h", 55, None, None, None)], 55, None),  # a full record beats a stub
        ([("m", "k", 0, "n", "/sdk/math.h", 2, None, None, None), ("n", "k", 0, "n", "bin/draw.cpp", 70, None, None, None)], 70, None),  # the project beats the system
        ([("m", "k", 0, "n", "lib/shape.h", 27, None, None, None), ("n", "k", 0, "n", "lib/shape.h", 27, "lib/disc.cpp", 4, 9)], 27, 9),  # a definition beats none
        ([("n", "k", 0, "n", "lib/ring.cpp", 5, None, None, None), ("m", "k", 0, "n", "lib/disc.cpp", 80, None, None, None)], 80, None),  # then the first file
    ],
)
def test_merge_precedence(spark, rows, line, end):
    files = spark.createDataFrame(FILES, "file_id string, is_system boolean, in_project boolean")
    (r,) = merge.merge_symbols(spark.createDataFrame(rows, RAW), files).collect()
    assert (r["line"], r["end_line"], r["tu_count"]) == (line, end, 2)


def test_merge_counts_units_once(spark):
    files = spark.createDataFrame(FILES, "file_id string, is_system boolean, in_project boolean")
    rows = [(tu, "k", s, "n", "bin/draw.cpp", 5, None, None, None) for tu in ("m", "n", "o", "p") for s in (1, 0)]
    merged = merge.merge_symbols(spark.createDataFrame(rows, RAW), files)
    assert merged.first()["tu_count"] == 4 and merge.merge_symbols(spark.createDataFrame(rows[::-1], RAW), files).collect() == merged.collect()


def test_closures_end_on_cycles_and_never_return_the_start(spark):
    pairs = spark.createDataFrame([(9, 1), (1, 2), (2, 4), (4, 1), (2, 3), (3, 3)], "a int, b int")
    starts = spark.createDataFrame([(9,), (3,), (4,)], "start int")
    assert {tuple(r) for r in closure.reach(pairs, starts).collect()} == {(9, 1, 1), (9, 2, 2), (9, 4, 3), (9, 3, 3), (4, 1, 1), (4, 2, 2), (4, 3, 3)}
    assert {tuple(r) for r in closure.reach(pairs, starts, 2).collect()} == {(9, 1, 1), (9, 2, 2), (4, 1, 1), (4, 2, 2)}


def test_small_graphs_are_walked_within_tasks(spark, monkeypatch):
    pairs = [(i, (7 * i + 3) % 90) for i in range(90)] + [(i, (5 * i + 1) % 90) for i in range(90)] + [(200 + i, 201 + i) for i in range(150)] + [(1, 1)]
    named = spark.createDataFrame([(f"f{a}", f"f{b}") for a, b in pairs], "a string, b string")
    starts = spark.createDataFrame([(f"f{i}",) for i in (0, 1, 1, 45, 200, 349, 350, 999)], "start string")
    for most in (None, 3):
        want = closure.reach(named, starts, 3 if most else 6).collect()
        got = closure.reach(named, starts, most, carried=1000)
        assert got.dtypes == [("start", "string"), ("node", "string"), ("level", "bigint")]
        assert sorted(map(tuple, got.where("level <= 6").collect())) == sorted(map(tuple, want))
    # neither a level nor a row is written on the way, however long the walk
    monkeypatch.setattr(closure, "durable", lambda df: pytest.fail("a level was written"))
    monkeypatch.setattr(closure, "BATCH", 7)
    rows = closure.files(named.withColumnsRenamed({"a": "from_file", "b": "to_file"}), starts).where("start = 'f200'").collect()
    assert sorted((r["level"], r["node"]) for r in rows) == [(i, f"f{200 + i}") for i in range(1, 151)]
    assert closure._carried(named.distinct(), starts, None, 5) is None


def test_units_are_walked_from_the_fewer_side(spark, monkeypatch):
    includes = spark.createDataFrame([("a.cc", f"h{i}") for i in range(5)] + [("h0", "h9"), ("h9", "a.cc")], "from_file string, to_file string")
    units, wanted = (spark.createDataFrame([(x,) for x in names], "file_id string") for names in (["a.cc", "a.cc"], ["h1", "h9", "a.cc", "z", "h1"]))
    asked, walk = [], closure.files
    monkeypatch.setattr(closure, "files", lambda i, s, way="out": asked.append(way) or walk(i, s, way))
    for w, u, want in ((wanted, units, [("a.cc", "a.cc"), ("h1", "a.cc"), ("h9", "a.cc")]), (units, wanted, [("a.cc", "a.cc"), ("a.cc", "h9")])):
        assert sorted(map(tuple, closure.units_reaching(includes, u, w).collect())) == want
    assert asked == ["out", "in"]


def test_units_reaching_a_header(spark):
    includes = spark.createDataFrame([("a.cc", "x.h"), ("x.h", "y.h"), ("y.h", "z.h"), ("z.h", "x.h"), ("b.cc", "w.h")], "from_file string, to_file string")
    units = spark.createDataFrame([("a.cc",), ("b.cc",), ("c.cc",)], "file_id string")
    wanted = spark.createDataFrame([("z.h",), ("w.h",), ("c.cc",), ("v.h",)], "file_id string")
    assert {tuple(r) for r in closure.units_reaching(includes, units, wanted).collect()} == {("z.h", "a.cc"), ("w.h", "b.cc"), ("c.cc", "c.cc")}


def test_ancestors_stop_at_missing_records_and_cycles(spark):
    rows = [("m", "n"), ("n", "m"), ("p", "q"), ("q", "r"), ("r", "lost"), ("t", None)]
    found = closure.ancestors(spark.createDataFrame(rows, "usr string, parent_usr string")).collect()
    assert {tuple(r) for r in found} == {("m", 1, "n"), ("n", 1, "m"), ("p", 1, "q"), ("p", 2, "r"), ("q", 1, "r")}


def test_containers_end_with_what_they_hold_in_their_file(symbols):
    found = {r["usr"]: r["last_line"] for r in closure.container_end(symbols).collect()}
    assert found == {"geo": 50, "shape": 8, "disc": 9, "ring": 14}
    assert [r["usr"] for r in closure.container_end(symbols, starts=symbols.where("usr = 'shape'")).collect()] == ["shape"]


def test_family_leaves_out_what_is_told(graph, symbols):
    found = {(r["usr"], r["relation"], r["other"]): r for r in family.report(graph(), symbols).collect()}
    assert found[("shape", "derived", "disc")]["access"] == "public" and found[("disc", "derived", "ring")]["access"] == "private"
    assert ("shape", "descendants", "ring") in found and ("shape", "descendants", "disc") not in found and ("ring", "ancestors", "shape") in found
    assert ("shape.area", "overrides", "disc.area") in found and ("shape.area", "overrides_indirectly", "ring.area") in found and ("ring.area", "overridden", "disc.area") in found


def test_impact_in_three_degrees(graph, symbols):
    found = {r["usr"]: (r["bucket"], r["hops"]) for r in impact.impact(graph(), symbols).where("origin = 'shape.area'").collect()}
    assert found == {"draw": ("direct", None), "start": ("indirect", 2), "disc.area": ("possible", None), "ring.area": ("possible", None)}
    types = {(r["bucket"], r["usr"]) for r in impact.impact(graph(), symbols).where("origin = 'shape'").collect()}
    assert {("direct", "disc"), ("direct", "draw"), ("possible", "ring"), ("indirect", "start")} <= types
    assert not impact.impact(graph(), symbols, depth=1).where("bucket = 'indirect'").collect()


def test_direct_impact_walks_nothing(graph, symbols, monkeypatch):
    for module in (impact, closure):
        monkeypatch.setattr(module, "durable", lambda df: pytest.fail("a table was written"))
    # a template's user derives from it unless a derived type has its name
    more = [("ring", "instantiates", "ring", "shape", "lib/shape.h", 38, 1, None), ("ring", "instantiates", "disc", "shape", "lib/shape.h", 24, 1, None)]
    rows = impact.impact(graph(*more), symbols, buckets=("direct",)).where("origin = 'shape'").collect()
    assert sorted((r["rank"], r["usr"], r["reason"]) for r in rows) == [(1, "disc", impact.DERIVES), (2, "ring", impact.DERIVES), (3, "draw", model.TYPE_REASONS[0][1])]
    assert {r["bucket"] for r in rows} == {"direct"}


def test_impact_says_that_a_list_was_cut(graph, symbols, spark):
    users = [sym(f"paint{i}", "function", f"paint{i}", "()", "bin/draw.cpp", 200 + i) for i in range(6)]
    more = [("draw", "returns", f"paint{i}", "ring", "bin/draw.cpp", 200 + i, 1, None) for i in range(6)]
    rows = impact.impact(graph(*more), spark.createDataFrame([*SYMBOLS, *users], SYM), limit=4).where("origin = 'ring' and bucket = 'direct'").collect()
    assert len(rows) == 4 and all(r["cut"] for r in rows)


def test_impact_of_changes_leaves_the_changed_out(graph, symbols, spark):
    changed = spark.createDataFrame([("square", 1), ("disc.area", 2)], "usr string, seq int")
    rows = impact.of_changes(graph(), symbols, changed).collect()
    assert {(r["bucket"], r["usr"], r["because_of"]) for r in rows} == {("direct", "ring.area", "geo::square")}


def test_spans_belong_to_definitions(spark, symbols):
    one = symbols.where("usr = 'disc.area'")
    asked = [(1, "lib/disc.cpp", 5, 7), (2, "lib/shape.h", 27, 27), (3, "lib/shape.h", 28, 33), (4, "lib/disc.cpp", 10, 11)]
    found = ranges.overlaps(spark.createDataFrame(asked, "range_id int, file_id string, start int, end int"), ranges.spans(one)).collect()
    assert {r["range_id"] for r in found} == {1, 2}


def test_overlaps_meet_once_across_buckets(spark):
    spans = [("all", "p", 1, 5000), ("few", "p", 63, 65), ("far", "p", 4000, 4001), ("other", "q", 1, 5000)]
    asked = [(1, "p", 10, 3000), (2, "r", 1, 2), (3, "p", 64, 64)]
    df, own = spark.createDataFrame(asked, "range_id int, file_id string, start int, end int"), spark.createDataFrame(spans, "usr string, file_id string, start int, end int")
    want = sorted((r, u) for r, f, a, b in asked for u, g, c, d in spans if f == g and a <= d and b >= c)
    for bucket in (1, 32, 64, 100_000):
        assert sorted((r["range_id"], r["usr"]) for r in ranges.overlaps(df, own, bucket=bucket).collect()) == want


def test_pairs_are_those_of_the_overlaps(spark):
    spans = [("all", "p", 1, 5000), ("all", "p", 1, 5000), (None, "p", 63, 65), *((f"few{i}", "p", 63, 65) for i in range(20)), ("far", "p", 4000, 4001), ("other", "q", 1, 5000), ("none", None, 1, 9)]
    asked = [(1, "p", 10, 3000), (2, "r", 1, 2), *((i, "p", 64, 64) for i in range(3, 40)), (3, "p", 64, 64), (None, "p", 64, 64), (41, None, 1, 2), (42, "p", 9, 8)]
    df, own = spark.createDataFrame(asked, "range_id int, file_id string, start int, end int"), spark.createDataFrame(spans, "usr string, file_id string, start int, end int")
    want = Counter((r, u) for r, f, a, b in asked for u, g, c, d in spans if f and f == g and a <= b and a <= d and b >= c)
    for bucket, side, most in ((32, 11_585, 4096), (1000, 3, 4), (100_000, 7, 1), (64, 1, 1000)):
        found = ranges.pairs(df, own, bucket=bucket, side=side, most=most)
        assert found.columns == ["range_id", "usr"] and Counter(tuple(r) for r in found.collect()) == want
    assert not ranges.pairs(df.limit(0), own).collect()


def test_lists_and_cells_of_pairs_are_bounded(spark):
    # one line of one file with everything on it: 2,000 ranges and 500 spans
    df, own = (spark.range(n).selectExpr(f"id as {key}", "'p' as file_id", "7 as start", "7 as end") for key, n in (("range_id", 2000), ("usr", 500)))
    lists = [len(r["ids"]) for r in ranges._listed(df, "range_id", 100).collect()]
    assert sum(lists) == 2000 and max(lists) < 200
    found = ranges.pairs(df, own, side=100, most=10)
    assert found.rdd.getNumPartitions() >= 100 and max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 100_000
    assert found.distinct().count() == 1_000_000


def test_last_generator_of_pairs_is_generated_code_over_short_lists(spark):
    df, own = (spark.range(n).selectExpr(f"id % 2 as {key}", "'p' as file_id", "7 as start", "7 as end") for key, n in (("range_id", 2000), ("usr", 50)))
    # an id that occurs very often makes a long list, since a list is chosen by the id's hash
    held = ranges._listed(df, "range_id", 100).select(F.explode(ranges._pieces("ids", "range_id", 100)).alias("piece")).collect()
    assert max(len(r["piece"]) for r in held) == 100 and Counter(x for r in held for x in r["piece"]) == {0: 1000, 1: 1000}
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has its generated code only after the run
    try:
        found = ranges.pairs(df, own, most=100)
        plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
        assert Counter(tuple(r) for r in found.collect()) == {(r, u): 25_000 for r in (0, 1) for u in (0, 1)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    # from the top: ranges in generated code, symbols and pieces one by one
    assert ["*(" in line for line in plan if "Generate explode" in line][:3] == [True, False, False]


@pytest.mark.parametrize("name", ["symbols_in_range", "containers_in_range"])
def test_pairs_of_copied_tables_leave_in_runs(spark, tmp_path, name):
    for table, keys in (("orders", ("o_orderkey", "o_custkey")), ("events", ("event_id", "user_id"))):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").crossJoin(spark.range(20).withColumnRenamed("id", "k"))
        rows.withColumns({key: F.col(key) + F.col("k") * 1_000_000 for key in keys}).drop("k").write.parquet(str(tmp_path / f"{table}.parquet"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        users = [r["usr"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(users) == catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() * 20**2
    # each symbol stands before at least the 20 copies of a range: runs, which columnar files hold in next to nothing
    assert sum(a != b for a, b in zip(users, users[1:])) < len(users) / 19


def test_ranges_collapse(spark):
    df = spark.createDataFrame([("m", 40, 41), ("m", 3, 3), ("m", 42, 50), ("m", 45, 46), ("n", 7, 7), ("n", 9, 9)], "k string, start int, end int")
    assert {tuple(r) for r in ranges.collapse(df, "k").collect()} == {("m", "3, 40-50"), ("n", "7, 9")}


def test_changed_symbols_prefer_the_innermost_container(symbols, spark):
    asked = [(1, "bin/draw.cpp", 16, 17), (2, "lib/shape.h", 8, 8), (3, "bin/draw.cpp", 14, 14), (4, "bin/draw.cpp", 60, 62), (5, "lib/shape.h", 52, 52)]
    df = spark.createDataFrame(asked, "range_id int, file_id string, start int, end int")
    rows = ranges.changed_symbols(df, symbols).orderBy("seq").collect()
    assert [(r["symbol"], r["lines"]) for r in rows] == [("main", "14, 16-17"), ("geo::Shape::area", "8"), ("geo", "52")]
    assert [tuple(r) for r in ranges.unattributed(df, ranges.spans(symbols)).collect()] == [("bin/draw.cpp", 3)]


def test_source_context_is_padded_and_clamped(spark):
    text = "".join(f"row {i}\n" for i in range(1, 16))
    wanted = spark.createDataFrame([("head", "f", 1, 2), ("tail", "f", 14, 15), ("old", "f", 15, 16), ("gone", "g", 1, 1), ("big", "h", 5, 400)], "usr string, path string, first int, last int")
    sources = spark.createDataFrame([("f", text), ("h", "y\n" * 500)], "path string, text string")
    rows = {r["usr"]: r for r in ranges.source_context(wanted, sources, 4).collect()}
    assert (rows["head"]["start"], rows["head"]["end"]) == (1, 6) and rows["head"]["source"].split("\n")[-1] == "6: row 6"
    assert (rows["tail"]["start"], rows["tail"]["end"]) == (10, 15) and "15 lines" in rows["old"]["error"] and rows["gone"]["error"].startswith("cannot read")
    assert rows["big"]["truncated"] and (rows["big"]["start"], rows["big"]["end"]) == (5, 204)


def resolved(spark, symbols, *references):
    places = symbols.select("usr", F.col("file_id").alias("path"), "line")
    rows = resolve.cascade(spark.createDataFrame([(r,) for r in references], "reference string"), symbols, places).orderBy("rank").collect()
    out = {r: [] for r in references}
    for r in rows:
        out[r["reference"]].append((r["stage"], r["usr"]))
    return out


def test_resolution_stages(spark, symbols):
    found = resolved(spark, symbols, "disc.area", "bin/draw.cpp:23", "draw.cpp:23-30", "scale(double)", "scale", "area", "Disc::area", "DRA", "R_ng", "hypo", "nothing")
    assert found["disc.area"] == [(1, "disc.area")] and found["bin/draw.cpp:23"] == found["draw.cpp:23-30"] == [(2, "scale#d")]
    assert found["scale(double)"] == [(3, "scale#d")] and sorted(found["scale"]) == [(3, "scale#d"), (3, "scale#i")]
    assert sorted(found["area"]) == [(3, "disc.area"), (3, "ring.area"), (3, "shape.area")] and found["Disc::area"] == [(4, "disc.area")]
    assert found["DRA"] == [(5, "draw")] and found["R_ng"] == [(4, "ring")] and found["hypo"] == [(5, "hypot")] and not found["nothing"]


def test_qualified_names_meet_their_tails_by_equality(spark, symbols, monkeypatch):
    names = ["a::b::c", "a:::c", "B::C", "b::c::", "c", "ab::c", "::b::c", "x::a\\::c", "q::a%c"]
    more = spark.createDataFrame([sym(f"t{i}", "function", q, "(int)", "bin/draw.cpp", 300 + i) for i, q in enumerate(names)], SYM).withColumn("name", F.lit("other"))
    asked = ["b::c", "::c", "B::c(int)", "a\\::c", "c::", ":c", "c(double)", "a::b::c", "z", "b::c(int)"]
    like = resolve.expr.like
    matched = F.udf(lambda *a: pytest.fail("a plain spelling was matched as a pattern"), "boolean")
    monkeypatch.setattr(resolve.expr, "like", lambda text, pattern: F.when(F.col("__name").rlike("[%_]"), like(text, pattern)).otherwise(matched(text)) if "qualified" in str(text) else like(text, pattern))
    found = resolve.cascade(spark.createDataFrame([(r,) for r in asked], "reference string"), more).collect()
    want = set()
    for r in asked:
        bare, _, args = r.partition("(")
        fit = not args or args == "int)"
        exact = [i for i, q in enumerate(names) if fit and bare == q]
        ends = [i for i, q in enumerate(names) if fit and q.lower().endswith("::" + bare.lower())]
        want |= {(r, 3 if exact else 4, f"t{i}") for i in exact or ends}
    assert {(r["reference"], r["stage"], r["usr"]) for r in found} == want


def test_files_are_found_by_suffix(spark):
    known = spark.createDataFrame([(f[0],) for f in FILES] + [("old/lib/ring.cpp",), ("/w/notes.h",)], "path string")
    asked = spark.createDataFrame([("ring.cpp",), ("lib/ring.cpp",), ("notes.h",), ("ing.cpp",), ("./bin/draw.cpp",)], "wanted string")
    found = {tuple(r) for r in resolve.files(asked, known, "/w").collect()}
    assert {("ring.cpp", "lib/ring.cpp"), ("lib/ring.cpp", "lib/ring.cpp"), ("notes.h", "/w/notes.h")} <= found and "ing.cpp" not in {w for w, _ in found}


def test_accuracy_takes_the_best_source(spark):
    of = lambda *s: status.accuracy(spark.createDataFrame([(x,) for x in s], "config_source string")).first()["overall"]
    assert of("compile_commands.json", "") == "exact" and of("fallback", "") == "degraded" and of("") == "unknown"


def test_distribution_takes_a_position(spark):
    r = status.distribution(spark.createDataFrame([(float(i),) for i in range(1, 201)], "v double"), "v").first()
    assert (r["p95"], r["most"], r["median"]) == (190.0, 200.0, 100.5)
