"""The registered queries: operators over the projected model, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweft import model
from sparkweft.functions import expr
from sparkweft.operators import closure, edges, family, impact, merge, ranges, resolve, status
from sparkweft.plans.views import load, with_views
from sparkweft.session import shared_folder
from sparkweft.sources import facts, git
from sparkweft.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = with_views(sql)
        return f

    return add


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- merging and edges -----------------------------------------------------------------------


@query("""
SELECT tu_id, kind, src, dst, file_id, CAST(sum(weight) AS BIGINT) AS weight, arg_min(line, line)::BIGINT AS line,
  arg_min(flags, line) FILTER (flags IS NOT NULL) AS flags
FROM v_edge GROUP BY tu_id, kind, src, dst, file_id""")
def edge_fold(spark, sf):
    (found,) = load(spark, sf, "v_edge")
    return longs(edges.fold(found.withColumn("seq", F.col("line"))).select("tu_id", "kind", "src", "dst", "file_id", "weight", "line", "flags"), "line")


@query("""
WITH ranked AS (
  SELECT r.*, row_number() OVER (PARTITION BY usr ORDER BY stub, (def_file_id IS NULL)::INT, coalesce(f.in_project, false)::INT DESC,
    coalesce(f.is_system, false)::INT, r.file_id NULLS LAST, coalesce(line, 0), tu_id, def_file_id NULLS FIRST) AS rn
  FROM v_raw r LEFT JOIN v_file f USING (file_id)),
counts AS (SELECT usr, count(DISTINCT tu_id) AS tu_count FROM v_raw GROUP BY usr)
SELECT usr, stub, def_file_id, file_id, line, tu_count FROM ranked JOIN counts USING (usr) WHERE rn = 1""")
def merge_symbols(spark, sf):
    raw, files = load(spark, sf, "v_raw", "v_file")
    return merge.merge_symbols(raw, files)


_DEGREE = """
SELECT e.{near} AS usr, count(DISTINCT e.{far}) AS degree FROM v_edge e JOIN v_sym s ON s.usr = e.{far} AND s.in_project
WHERE e.kind = 'calls' GROUP BY e.{near}"""


@query(_DEGREE.format(near="dst", far="src"))
def degree_in(spark, sf):
    return edges.degree(*load(spark, sf, "v_edge", "v_sym"))


@query(_DEGREE.format(near="src", far="dst"))
def degree_out(spark, sf):
    return edges.degree(*load(spark, sf, "v_edge", "v_sym"), direction="out")


_EVIDENCE = """
WITH ev AS (
  SELECT e.{near} AS usr, e.{far} AS other, e.file_id, e.line, e.kind, e.flags, max(e.weight) AS weight
  FROM v_edge e JOIN v_sym s ON s.usr = e.{far} AND s.in_project WHERE e.kind IN ({kinds}) GROUP BY ALL),
sites AS (SELECT usr, other, concat(file_id, ':', line) AS site, min(line) AS line FROM ev GROUP BY ALL),
shown AS (SELECT usr, other, string_agg(site, ', ' ORDER BY line, site) AS sites FROM (
  SELECT *, row_number() OVER (PARTITION BY usr, other ORDER BY line, site) AS r FROM sites) WHERE r <= 5 GROUP BY ALL),
folded AS (
  SELECT usr, other, CAST(sum(CASE WHEN coalesce(weight, 0) = 0 THEN 1 ELSE weight END) AS BIGINT) AS weight,
    count(DISTINCT concat(file_id, ':', line)) AS site_count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
    bool_or(coalesce(flags LIKE '%"virt"%', false)) AS virt, bool_or(coalesce(flags LIKE '%pure%', false)) AS pure FROM ev GROUP BY ALL)
SELECT usr, other, weight, site_count, sites, CASE WHEN weight > site_count THEN weight END AS occurrences,
  CASE WHEN kinds <> '{first}' THEN kinds END AS via, CASE WHEN pure THEN 'pure virtual' WHEN virt THEN 'virtual' END AS dispatch
FROM folded JOIN shown USING (usr, other)"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({"sites": F.array_join("sites", ", "), "via": F.array_join("via", ",")})


@query(_EVIDENCE.format(near="dst", far="src", kinds="'calls'", first="calls"))
def callers_evidence(spark, sf):
    return _flat(edges.neighbours(*load(spark, sf, "v_edge", "v_sym")))


@query(_EVIDENCE.format(near="src", far="dst", kinds="'calls'", first="calls"))
def callees_evidence(spark, sf):
    return _flat(edges.neighbours(*load(spark, sf, "v_edge", "v_sym"), direction="out"))


@query(_EVIDENCE.format(near="dst", far="src", kinds="'references', 'calls_indirect'", first="references"))
def references_via(spark, sf):
    return _flat(edges.neighbours(*load(spark, sf, "v_edge", "v_sym"), kinds=model.REFERENCES))


@query("""
WITH p AS (SELECT DISTINCT e.dst AS usr, e.src AS other, s.qualified FROM v_edge e JOIN v_sym s ON s.usr = e.src AND s.in_project WHERE e.kind = 'calls'),
r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY qualified, other) AS rn FROM p)
SELECT r.usr, r.other, count(DISTINCT concat(e.file_id, ':', e.line)) AS site_count
FROM r JOIN v_edge e ON e.dst = r.usr AND e.src = r.other AND e.kind = 'calls' WHERE rn <= 3 GROUP BY ALL""")
def callers_top3(spark, sf):
    return edges.neighbours(*load(spark, sf, "v_edge", "v_sym"), limit=3).select("usr", "other", "site_count")


@query("""
WITH p AS (SELECT DISTINCT e.src AS usr, e.kind, e.dst AS other, s.qualified FROM v_edge e JOIN v_sym s ON s.usr = e.dst),
c AS (SELECT usr, kind, count(*) AS kind_count FROM p GROUP BY ALL), t AS (SELECT usr, CAST(sum(kind_count) AS BIGINT) AS total FROM c GROUP BY usr),
r AS (SELECT *, row_number() OVER (PARTITION BY usr, kind ORDER BY qualified, other) AS rank FROM p)
SELECT usr, kind, other, rank, kind_count, total FROM r JOIN c USING (usr, kind) JOIN t USING (usr) WHERE rank <= 3""")
def dependencies_by_kind_topn(spark, sf):
    return edges.dependencies(*load(spark, sf, "v_edge", "v_sym"), per_kind=3)


@query("SELECT DISTINCT e.src AS usr, e.kind, e.dst AS other FROM v_edge e JOIN v_sym s ON s.usr = e.dst")
def symbol_dependencies(spark, sf):
    return edges.dependencies(*load(spark, sf, "v_edge", "v_sym")).select("usr", "kind", "other")


@query("""
SELECT usr, qualified, count(*) OVER () AS total FROM v_sym ORDER BY qualified, usr LIMIT 26""")
def page_plus_count(spark, sf):
    (symbols,) = load(spark, sf, "v_sym")
    return edges.page(symbols.select("usr", "qualified"), [F.col("qualified"), F.col("usr")], 26)


@query("SELECT kind, count(*) AS edges FROM v_edge GROUP BY kind")
def kind_counts(spark, sf):
    return edges.kind_counts(*load(spark, sf, "v_edge"))


@query("""
SELECT s.usr, count(*) AS callers FROM v_edge e JOIN v_sym s ON s.usr = e.dst WHERE e.kind = 'calls'
GROUP BY s.usr ORDER BY callers DESC, s.usr LIMIT 1""")
def busiest_symbol(spark, sf):
    found, symbols = load(spark, sf, "v_edge", "v_sym")
    return edges.busiest(found, symbols, ("calls",)).withColumnRenamed("edges", "callers")


@query("SELECT usr, qualified FROM v_sym ORDER BY md5('7:' || CAST(usr AS VARCHAR)), usr LIMIT 200")
def symbol_sample(spark, sf):
    (symbols,) = load(spark, sf, "v_sym")
    return status.sample(symbols.select("usr", "qualified"), "usr", 200, seed=7)


@query("SELECT usr FROM v_sym s WHERE EXISTS (SELECT 1 FROM v_edge e WHERE e.dst = s.usr AND e.kind = 'calls')")
def has_calls_semi(spark, sf):
    found, symbols = load(spark, sf, "v_edge", "v_sym")
    return edges.having(symbols, found, ("calls",))


@query("SELECT usr FROM v_sym s WHERE NOT EXISTS (SELECT 1 FROM v_edge e WHERE e.src = s.usr AND e.kind IN ('inherits', 'overrides'))")
def no_calls_anti(spark, sf):
    found, symbols = load(spark, sf, "v_edge", "v_sym")
    return edges.having(symbols, found, ("inherits", "overrides"), "out", negate=True)


# --- walks -------------------------------------------------------------------------------------

_WALK = """
WITH RECURSIVE pairs AS (SELECT DISTINCT {a} AS a, {b} AS b FROM {edges} WHERE {a} <> {b}{where}),
walk(start, node, d) AS (
  SELECT {start}, 0 FROM {starts} UNION SELECT w.start, p.b, w.d + 1 FROM walk w JOIN pairs p ON p.a = w.node WHERE w.d < {depth})
SELECT start, node, CAST(min(d) AS BIGINT) AS level FROM walk WHERE node <> start{known} GROUP BY ALL"""
_CALLS = {"edges": "v_edge", "where": " AND kind = 'calls'", "start": "usr, usr", "starts": "v_sym", "depth": 2, "known": " AND node IN (SELECT usr FROM v_sym)"}


@query(_WALK.format(a="src", b="dst", **_CALLS))
def closure_bounded_out(spark, sf):
    return closure.bounded(*load(spark, sf, "v_edge", "v_sym"), ("calls",), "out", 2)


@query(_WALK.format(a="dst", b="src", **_CALLS))
def closure_bounded_in(spark, sf):
    return closure.bounded(*load(spark, sf, "v_edge", "v_sym"), ("calls",), "in", 2)


_REACHED = """
WITH RECURSIVE walk(start, node) AS (
  SELECT {a}, {b} FROM v_inc UNION SELECT w.start, i.{b} FROM walk w JOIN v_inc i ON i.{a} = w.node)
SELECT start, node FROM walk WHERE start <> node"""


@query(_REACHED.format(a="from_file", b="to_file"))
def closure_unbounded_files(spark, sf):
    includes, files = load(spark, sf, "v_inc", "v_file")
    return closure.files(includes, files.select(F.col("file_id").alias("start"))).select("start", "node")


@query(_REACHED.format(a="to_file", b="from_file"))
def closure_unbounded_includers(spark, sf):
    includes, files = load(spark, sf, "v_inc", "v_file")
    return closure.files(includes, files.select(F.col("file_id").alias("start")), "in").select("start", "node")


@query("""
WITH RECURSIVE walk(file, node) AS (
  SELECT file_id, file_id FROM v_file UNION SELECT w.file, i.from_file FROM walk w JOIN v_inc i ON i.to_file = w.node)
SELECT file, node AS unit FROM walk WHERE node IN (SELECT file_id FROM v_unit)""")
def tus_reaching(spark, sf):
    includes, units, files = load(spark, sf, "v_inc", "v_unit", "v_file")
    return closure.units_reaching(includes, units, files.select("file_id"))


@query("SELECT DISTINCT from_file, to_file, line, angled FROM v_inc")
def direct_includes(spark, sf):
    (includes,) = load(spark, sf, "v_inc")
    return closure.direct(includes)


@query("SELECT DISTINCT to_file AS file, from_file AS includer FROM v_inc")
def direct_includers(spark, sf):
    (includes,) = load(spark, sf, "v_inc")
    return closure.direct(includes, "in")


@query("""
WITH RECURSIVE up(usr, place, level) AS (
  SELECT usr, usr, 0 FROM v_parent UNION ALL
  SELECT u.usr, p.parent_usr, u.level + 1 FROM up u JOIN v_parent p ON p.usr = u.place WHERE p.parent_usr IN (SELECT usr FROM v_parent) AND u.level < 8)
SELECT usr, level::BIGINT AS level, place AS ancestor FROM up WHERE level > 0""")
def ancestors_chain(spark, sf):
    return closure.ancestors(*load(spark, sf, "v_parent"))


@query("SELECT p.usr AS parent, s.usr, s.kind, s.line FROM v_sym s JOIN v_sym p ON p.usr = s.parent_usr")
def members_of(spark, sf):
    return closure.members(*load(spark, sf, "v_sym"))


@query("""
WITH s AS (SELECT usr, kind, parent_usr, file_id % 3 AS f, coalesce(end_line, line) AS e FROM v_sym),
l0 AS (SELECT p.usr, p.f, m.usr AS member, m.kind, m.e FROM s p JOIN s m ON m.parent_usr = p.usr AND m.f = p.f),
l1 AS (SELECT l.usr, l.f, m.usr AS member, m.kind, m.e FROM l0 l JOIN s m ON m.parent_usr = l.member AND m.f = l.f WHERE l.kind = 'namespace'),
l2 AS (SELECT l.usr, l.f, m.usr AS member, m.kind, m.e FROM l1 l JOIN s m ON m.parent_usr = l.member AND m.f = l.f WHERE l.kind = 'namespace'),
l3 AS (SELECT l.usr, l.f, m.usr AS member, m.kind, m.e FROM l2 l JOIN s m ON m.parent_usr = l.member AND m.f = l.f WHERE l.kind = 'namespace'),
l4 AS (SELECT l.usr, l.f, m.usr AS member, m.kind, m.e FROM l3 l JOIN s m ON m.parent_usr = l.member AND m.f = l.f WHERE l.kind = 'namespace')
SELECT usr, max(e)::BIGINT AS last_line FROM (SELECT usr, e FROM l0 UNION ALL SELECT usr, e FROM l1 UNION ALL SELECT usr, e FROM l2
  UNION ALL SELECT usr, e FROM l3 UNION ALL SELECT usr, e FROM l4) GROUP BY usr""")
def container_end(spark, sf):
    (symbols,) = load(spark, sf, "v_sym")
    return closure.container_end(symbols.withColumn("file_id", F.col("file_id") % 3))  # few files, so that members share them


# --- families and impact -----------------------------------------------------------------------

_NAMED = "SELECT usr AS other, coalesce(nullif(qualified, ''), nullif(name, ''), usr::VARCHAR) AS name FROM v_sym"
_FAR = """
{name}_p AS (SELECT DISTINCT {a} AS a, {b} AS b FROM v_edge WHERE kind = '{kind}'),
{name}_w(usr, node, d) AS (SELECT usr, usr, 0 FROM v_sym UNION SELECT w.usr, p.b, w.d + 1 FROM {name}_w w JOIN {name}_p p ON p.a = w.node WHERE w.d < {depth}),
{name} AS (SELECT DISTINCT w.usr, '{name}' AS relation, w.node AS other, n.name FROM {name}_w w JOIN names n ON n.other = w.node WHERE w.usr <> w.node
  AND NOT EXISTS (SELECT 1 FROM direct k WHERE k.usr = w.usr AND k.name = n.name AND k.relation IN ({told})))"""


def _family_sql(depth: int) -> str:
    word = """CASE WHEN flags LIKE '%"pub"%' THEN 'public' WHEN flags LIKE '%"priv"%' THEN 'private' WHEN flags LIKE '%"prot"%' THEN 'protected' END"""
    rel = (
        "SELECT {near} AS usr, '{name}' AS relation, {far} AS other, max({word}) AS access, bool_or(coalesce(flags LIKE '%\"virtual\"%', false)) AS is_virtual"
        " FROM v_edge WHERE kind = '{kind}' AND {near} IN (SELECT usr FROM v_sym) GROUP BY {near}, {far}"
    )
    parts = [("bases", "inherits", "src", "dst"), ("derived", "inherits", "dst", "src"), ("overrides", "overrides", "dst", "src"), ("overridden", "overrides", "src", "dst")]
    plain = " UNION ALL ".join(rel.format(name=n, kind=k, near=a, far=b, word=word) for n, k, a, b in parts)
    far = [("ancestors", "inherits", "src", "dst", "'bases'"), ("descendants", "inherits", "dst", "src", "'bases', 'derived'"), ("overrides_indirectly", "overrides", "dst", "src", "'overrides'")]
    return f"""
WITH RECURSIVE names AS ({_NAMED}),
plain AS (SELECT p.*, n.name FROM ({plain}) p JOIN names n USING (other)),
template AS (SELECT e.dst AS usr, 'derived' AS relation, min(e.src) AS other, n.name FROM v_edge e JOIN names n ON n.other = e.src
  WHERE e.kind = 'instantiates' AND e.dst IN (SELECT usr FROM v_sym)
    AND NOT EXISTS (SELECT 1 FROM plain k WHERE k.usr = e.dst AND k.relation = 'derived' AND k.name = n.name) GROUP BY e.dst, n.name),
direct AS (SELECT usr, relation, other, name, access, is_virtual, false AS via_template FROM plain
  UNION ALL SELECT usr, relation, other, name, CAST(NULL AS VARCHAR), false, true FROM template),
{", ".join(_FAR.format(name=n, kind=k, a=a, b=b, told=t, depth=depth) for n, k, a, b, t in far)},
family AS (SELECT usr, relation, other, access, is_virtual, via_template FROM direct
  {" ".join(f"UNION ALL SELECT usr, relation, other, CAST(NULL AS VARCHAR), false, false FROM {f[0]}" for f in far)})"""


@query(_family_sql(8) + " SELECT * FROM family")
def inheritance_report(spark, sf):
    return family.report(*load(spark, sf, "v_edge", "v_sym"))


def _impact_sql() -> str:
    def used(*kinds: str) -> str:
        listed = ", ".join(f"'{k}'" for k in kinds)
        return f"SELECT DISTINCT e.dst AS origin, e.src AS usr FROM v_edge e JOIN v_sym s ON s.usr = e.src AND s.in_project JOIN v_sym t ON t.usr = e.dst WHERE e.kind IN ({listed})"

    call = "('function', 'method')"
    parts = [
        ("direct", 1, impact.CALLS, used("calls")),
        ("direct", 2, impact.DERIVES, "SELECT usr AS origin, other AS usr FROM family WHERE relation = 'derived'"),
        ("direct", 3, impact.USES, used("references") + f" AND t.kind NOT IN {call}"),
        *(("direct", 4 + k, reason, used(kind)) for k, (kind, reason) in enumerate(model.TYPE_REASONS)),
        ("possible", 20, impact.OVERRIDES, "SELECT usr AS origin, other AS usr FROM family WHERE relation = 'overrides'"),
        ("possible", 21, impact.OVERRIDES_FAR, "SELECT usr AS origin, other AS usr FROM family WHERE relation = 'overrides_indirectly'"),
        ("possible", 22, impact.INHERITS, f"SELECT f.usr AS origin, f.other AS usr FROM family f JOIN v_sym t ON t.usr = f.usr WHERE relation = 'descendants' AND t.kind NOT IN {call}"),
        ("possible", 23, impact.POINTER, used("calls_indirect")),
        ("possible", 24, impact.ADDRESS, used("references") + f" AND t.kind IN {call}"),
        ("possible", 25, impact.INSTANCE, used("specializes", "instantiates")),
    ]
    near = " UNION ALL ".join(f"SELECT origin, usr, '{b}' AS bucket, {k} AS step, '{r}' AS reason FROM ({q})" for b, k, r, q in parts)
    return (
        _family_sql(8)
        + f""",
near AS ({near}),
hop(origin, usr, d) AS (SELECT origin, usr, 1 FROM near WHERE bucket = 'direct' AND usr <> origin UNION
  SELECT h.origin, c.usr, h.d + 1 FROM hop h JOIN ({used("calls")}) c ON c.origin = h.usr WHERE h.d < 3),
far AS (SELECT origin, usr, min(d) AS d FROM hop WHERE usr <> origin GROUP BY ALL HAVING min(d) > 1),
every AS (SELECT origin, usr, bucket, step, reason, CAST(NULL AS BIGINT) AS hops FROM near UNION ALL
  SELECT origin, usr, 'indirect', 30 + d, concat('calls a caller of this symbol (', d, ' hops)'), d FROM far),
named AS (SELECT e.*, n.name AS symbol, CASE bucket WHEN 'direct' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END AS b FROM every e JOIN names n ON n.other = e.usr),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, symbol ORDER BY b, step, usr) AS r FROM named) WHERE r = 1),
shown AS (SELECT *, row_number() OVER (PARTITION BY origin, bucket ORDER BY step, symbol, usr) AS rank FROM firsts)"""
    )


def _impact_of(bucket: str):
    def run(spark, sf):
        found = impact.impact(*load(spark, sf, "v_edge", "v_sym"), depth=3, limit=40, buckets=(bucket,))
        return found.where(F.col("bucket") == bucket).select("origin", "rank", "usr", "symbol", "reason", "hops")

    run.__name__ = f"impact_{bucket}"
    query(_impact_sql() + f" SELECT origin, rank, usr, symbol, reason, hops FROM shown WHERE bucket = '{bucket}' AND rank <= 40")(run)


for _bucket in impact.BUCKETS:
    _impact_of(_bucket)


@query(
    _impact_sql()
    + """,
changed AS (SELECT usr, usr AS seq FROM v_sym WHERE kind = 'class'),
touched AS (SELECT c.usr AS origin, c.seq, n.name AS because_of FROM changed c JOIN names n ON n.other = c.usr),
reached AS (SELECT s.*, t.because_of, t.seq FROM shown s JOIN touched t USING (origin) WHERE rank <= 40 AND symbol NOT IN (SELECT because_of FROM touched))
SELECT bucket, symbol, usr, reason, hops, because_of FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket, symbol ORDER BY seq, origin, rank) AS rr FROM reached) WHERE rr = 1"""
)
def impact_of_changes(spark, sf):
    found, symbols = load(spark, sf, "v_edge", "v_sym")
    changed = symbols.where("kind = 'class'").select("usr", F.col("usr").alias("seq"))
    return impact.of_changes(found, symbols, changed, depth=3, limit=40).drop("cut")


# --- ranges ------------------------------------------------------------------------------------

_INNER = "kind IN ('function', 'class')"


@query(f"""
WITH hits AS (SELECT r.range_id, s.usr, s.kind, r.file_id, row_number() OVER (PARTITION BY r.range_id ORDER BY CASE WHEN {_INNER} THEN 0 ELSE 1 END,
    CASE WHEN {_INNER} THEN end_line - line ELSE line END, CASE WHEN NOT ({_INNER}) THEN end_line END, kind, name, s.usr) AS rn
  FROM v_range r JOIN v_span s ON s.file_id = r.file_id AND r."start" <= s.end_line AND r."end" >= s.line)
SELECT range_id, file_id, usr, kind, {_INNER} AS is_container FROM hits WHERE rn = 1""")
def changed_innermost(spark, sf):
    found, spans = load(spark, sf, "v_range", "v_span")
    return ranges.innermost(found, ranges.spans(spans)).select("range_id", "file_id", "usr", "kind", "is_container")


@query('SELECT r.range_id, s.usr FROM v_range r JOIN v_span s ON s.file_id = r.file_id AND r."start" <= s.end_line AND r."end" >= s.line')
def symbols_in_range(spark, sf):
    found, spans = load(spark, sf, "v_range", "v_span")
    return ranges.pairs(found, ranges.spans(spans))


@query(f'SELECT r.range_id, s.usr FROM v_range r JOIN v_span s ON s.file_id = r.file_id AND r."start" <= s.end_line AND r."end" >= s.line WHERE {_INNER}')
def containers_in_range(spark, sf):
    found, spans = load(spark, sf, "v_range", "v_span")
    inside = ranges.spans(spans).where(F.col("kind").isin(*model.RANGE_CONTAINERS))
    return ranges.pairs(found, inside)


_ISLANDS = """
f AS (SELECT *, max("end") OVER (PARTITION BY {key} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {rows}),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM f),
g AS (SELECT {key}, island, min("start") AS s, max("end") AS e FROM i GROUP BY ALL),
texts AS (SELECT {key}, string_agg(CASE WHEN s = e THEN s::VARCHAR ELSE concat(s, '-', e) END, ', ' ORDER BY s) AS lines FROM g GROUP BY ALL)"""


@query("WITH " + _ISLANDS.format(key="file_id", rows="v_range") + " SELECT * FROM texts")
def collapse_ranges(spark, sf):
    (found,) = load(spark, sf, "v_range")
    return ranges.collapse(found, "file_id")


@query("""
SELECT file_id, CAST(sum("end" - "start" + 1) AS BIGINT) AS lines FROM v_range r WHERE NOT EXISTS (
  SELECT 1 FROM v_span s WHERE s.file_id = r.file_id AND r."start" <= s.end_line AND r."end" >= s.line) GROUP BY file_id""")
def unattributed_lines(spark, sf):
    found, spans = load(spark, sf, "v_range", "v_span")
    return ranges.unattributed(found, ranges.spans(spans))


@query(f"""
WITH hits AS (SELECT r.*, s.usr, s.name AS symbol, s.signature, row_number() OVER (PARTITION BY r.range_id ORDER BY CASE WHEN {_INNER} THEN 0 ELSE 1 END,
    CASE WHEN {_INNER} THEN end_line - line ELSE line END, CASE WHEN NOT ({_INNER}) THEN end_line END, kind, name, s.usr) AS rn
  FROM v_range r JOIN v_span s ON s.file_id = r.file_id AND r."start" <= s.end_line AND r."end" >= s.line),
k AS (SELECT *, concat(symbol, signature) AS key FROM hits WHERE rn = 1),
h AS (SELECT key, min(range_id) AS seq FROM k GROUP BY key),{_ISLANDS.format(key="key", rows="k")}
SELECT k.usr, k.symbol, k.signature, t.lines, h.seq FROM h JOIN k ON k.key = h.key AND k.range_id = h.seq JOIN texts t ON t.key = h.key""")
def changed_symbols(spark, sf):
    return ranges.changed_symbols(*load(spark, sf, "v_range", "v_span"))


@query("""
WITH d AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, lines, len(lines) AS total, len(lines) // 2 + 1 AS first, len(lines) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS last FROM d),
r AS (SELECT *, CASE WHEN last - first + 1 >= 6 THEN first ELSE greatest(1, first - least(2, 6 - (last - first + 1))) END AS s,
  CASE WHEN last - first + 1 >= 6 THEN first + 5 ELSE least(total, last + least(2, 6 - (last - first + 1))) END AS e FROM w)
SELECT doc_id AS usr, last - first + 1 >= 6 AS truncated, CASE WHEN last > total THEN concat(doc_id, ' has ', total, ' lines; the index is older') END AS error,
  CASE WHEN last <= total THEN array_to_string(list_transform(range(s, e + 1), lambda n: concat(n, ': ', lines[n])), chr(10)) END AS source FROM r""")
def source_region(spark, sf):
    """The second half of every text, in regions of six lines at most; every fifth is asked for a line too many."""
    (documents,) = load(spark, sf, "documents")
    sources = documents.select(F.col("doc_id").cast("string").alias("path"), "text")
    total = F.size(F.split(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n$", ""), "\n", -1))
    last = total + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    wanted = documents.select(F.col("doc_id").alias("usr"), F.col("doc_id").cast("string").alias("path"), (F.floor(total / 2) + 1).cast("int").alias("first"), last.alias("last"))
    return ranges.source_context(wanted, sources, context=2, most=6).select("usr", "truncated", "error", "source")


# --- resolution --------------------------------------------------------------------------------

_SPELLINGS = "SELECT DISTINCT name AS reference FROM v_sym UNION SELECT DISTINCT concat(qualified, signature) FROM v_sym UNION SELECT usr::VARCHAR FROM v_sym UNION SELECT DISTINCT upper(substr(name, 1, 6)) FROM v_sym"


@query(f"""
WITH refs AS ({_SPELLINGS}),
asked AS (SELECT reference, CASE WHEN reference LIKE '%)' AND instr(reference, '(') > 1 THEN trim(substr(reference, 1, instr(reference, '(') - 1)) ELSE reference END AS nm,
  CASE WHEN reference LIKE '%)' AND instr(reference, '(') > 1 THEN substr(reference, instr(reference, '(')) END AS sg FROM refs),
fits AS (SELECT a.*, s.* FROM asked a JOIN v_sym s ON a.sg IS NULL OR lower(s.signature) LIKE '%' || lower(a.sg) || '%'),
found AS (
  SELECT reference, usr, 1 AS stage FROM asked JOIN v_sym ON reference = usr::VARCHAR
  UNION SELECT reference, usr, 3 FROM fits WHERE nm = qualified OR nm = name
  UNION SELECT reference, usr, 4 FROM fits WHERE lower(qualified) LIKE '%::' || lower(nm)
  UNION SELECT reference, usr, 5 FROM fits WHERE lower(name) LIKE '%' || lower(nm) || '%'),
firsts AS (SELECT *, min(stage) OVER (PARTITION BY reference) AS f FROM found)
SELECT reference, stage::BIGINT AS stage, usr, row_number() OVER (PARTITION BY reference ORDER BY (NOT in_project)::INT, stub, length(qualified), qualified, usr) AS rank
FROM firsts JOIN v_sym USING (usr) WHERE stage = f""")
def resolve_cascade(spark, sf):
    (symbols,) = load(spark, sf, "v_sym")
    spelled = [
        symbols.select(F.col("name").alias("reference")), symbols.select(F.concat("qualified", "signature").alias("reference")),
        symbols.select(F.col("usr").cast("string").alias("reference")), symbols.select(F.upper(F.substring("name", 1, 6)).alias("reference")),
    ]
    references = spelled[0]
    for part in spelled[1:]:
        references = references.unionByName(part)
    return resolve.cascade(references.distinct(), symbols)


@query("""
SELECT usr, qualified, row_number() OVER (ORDER BY length(qualified), qualified, usr) AS rank FROM v_sym
WHERE in_project AND (lower(name) LIKE '%plate%' OR lower(qualified) LIKE '%plate%') ORDER BY rank LIMIT 20""")
def search_names(spark, sf):
    (symbols,) = load(spark, sf, "v_sym")
    top = resolve.search(symbols, "PLate").select("usr", "qualified", "name").orderBy(*resolve.search_order()).limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*resolve.search_order())).cast("long")).drop("name")


@query("SELECT kind, count(*) AS n FROM v_sym WHERE in_project AND (lower(name) LIKE '%a_%' OR lower(qualified) LIKE '%a_%') GROUP BY kind")
def count_search(spark, sf):
    (symbols,) = load(spark, sf, "v_sym")
    return resolve.search(symbols, "A_").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT DISTINCT regexp_extract(url, '([^/]+)$', 1) AS wanted FROM pages WHERE url NOT LIKE '%/'),
f AS (SELECT wanted, url AS path, row_number() OVER (PARTITION BY wanted ORDER BY CASE WHEN url = wanted THEN 0 ELSE 2 END, length(url), url) AS r
  FROM w JOIN (SELECT DISTINCT url FROM pages) ON url = wanted OR lower(url) LIKE '%/' || lower(wanted))
SELECT wanted, path FROM f WHERE r = 1""")
def file_suffix_lookup(spark, sf):
    (pages,) = load(spark, sf, "pages")
    known = pages.select(F.col("url").alias("path")).distinct()
    wanted = pages.where(~F.col("url").endswith("/")).select(F.regexp_extract("url", "([^/]+)$", 1).alias("wanted"))
    return resolve.files(wanted, known, "/nowhere")


# --- status ------------------------------------------------------------------------------------


@query("""
SELECT d.diag_id, d.severity, f.path, d.line, row_number() OVER (ORDER BY severity DESC, path NULLS FIRST, diag_id) AS rank
FROM v_diag d LEFT JOIN v_file f USING (file_id) WHERE severity IN ('error', 'fatal', 'warning') ORDER BY rank LIMIT 25""")
def diagnostics_list(spark, sf):
    found = status.diagnostics(*load(spark, sf, "v_diag", "v_file"))
    order = [F.desc("severity"), F.col("path").asc_nulls_first(), F.col("diag_id")]
    top = found.select("diag_id", "severity", "path", "line").orderBy(*order).limit(25)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("SELECT severity, count(*) AS n FROM v_diag WHERE severity IN ('error', 'fatal', 'warning') GROUP BY severity")
def diagnostics_count(spark, sf):
    return status.diagnostics(*load(spark, sf, "v_diag", "v_file")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'files' AS name, count(*) AS n FROM v_file UNION ALL SELECT 'project_files', count(*) FROM v_file WHERE in_project
UNION ALL SELECT 'symbols', count(*) FROM v_sym UNION ALL SELECT 'project_symbols', count(*) FROM v_sym JOIN v_file f USING (file_id) WHERE f.in_project
UNION ALL SELECT 'edges', count(*) FROM v_edge UNION ALL SELECT 'includes', count(*) FROM v_inc
UNION ALL SELECT 'units', count(*) FROM v_unit UNION ALL SELECT 'diagnostics', count(*) FROM v_diag""")
def status_counts(spark, sf):
    files, symbols, found, includes, units, diags = load(spark, sf, "v_file", "v_sym", "v_edge", "v_inc", "v_unit", "v_diag")
    inside = symbols.join(files.where("in_project").select("file_id"), "file_id", "left_semi")
    return status.counts(files=files, project_files=files.where("in_project"), symbols=symbols, project_symbols=inside, edges=found, includes=includes, units=units, diagnostics=diags)


@query("""
WITH u AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'auto-detected' WHEN o_orderpriority LIKE '2%' THEN 'fallback' ELSE 'unknown' END AS source FROM orders),
w AS (SELECT source, count(*) AS units, CASE source WHEN 'auto-detected' THEN 'approximate' WHEN 'fallback' THEN 'degraded' ELSE 'unknown' END AS word FROM u GROUP BY source)
SELECT source, units, word, (SELECT arg_min(word, CASE word WHEN 'exact' THEN 1 WHEN 'approximate' THEN 2 WHEN 'degraded' THEN 3 ELSE 4 END) FROM w) AS overall FROM w""")
def accuracy_histogram(spark, sf):
    (orders,) = load(spark, sf, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    return status.accuracy(orders.select(F.when(digit == "1", "auto-detected").when(digit == "2", "fallback").otherwise("").alias("config_source")))


@query("""
SELECT CASE WHEN s.usr IS NULL THEN 'unknown' WHEN s.stub = 1 THEN 'stub' WHEN f.file_id IS NULL THEN 'synthetic' WHEN f.in_project THEN 'project' ELSE 'outside' END AS bucket,
  count(*) AS edges FROM v_edge e LEFT JOIN v_sym s ON s.usr = e.dst LEFT JOIN v_file f ON f.file_id = s.file_id GROUP BY 1""")
def resolution_buckets(spark, sf):
    return status.resolution(*load(spark, sf, "v_edge", "v_sym", "v_file"))


@query("""
SELECT median(value) AS median, max(value) AS most, (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS r FROM events WHERE value IS NOT NULL)
  WHERE r = greatest(1, (SELECT floor(count(*) * 0.95) FROM events WHERE value IS NOT NULL))) AS p95 FROM events""")
def value_distribution(spark, sf):
    return status.distribution(*load(spark, sf, "events"), "value")


# --- scalars and ingest ------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def flags_json(spark, sf):
    (events,) = load(spark, sf, "events")
    return events.select("event_id", F.try_element_at(expr.flags(F.col("props")), F.lit("k")).cast("long").alias("k"))


@query("""
SELECT DISTINCT r.file_id, r.line, CASE WHEN f.path IS NULL THEN '' WHEN r.line = 0 THEN substr(f.path, 6) ELSE concat(substr(f.path, 6), ':', r.line) END AS place
FROM v_raw r LEFT JOIN v_file f USING (file_id)""")
def location_render(spark, sf):
    raw, files = load(spark, sf, "v_raw", "v_file")
    named = raw.select("file_id", "line").distinct().join(files.select("file_id", "path"), "file_id", "left")
    return named.select("file_id", "line", expr.location(expr.relative(F.col("path"), "/src"), F.col("line")).alias("place"))


def _facts(spark: SparkSession, **tables: DataFrame) -> facts.Facts:
    """Facts with these tables; columns that they lack are null, tables that they lack empty."""

    def whole(name: str, schema: str) -> DataFrame:
        empty = spark.createDataFrame([], schema)
        df = tables.get(name)
        return empty if df is None else df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))

    parts = {"units": model.TU, "files": model.FILE, "symbols": model.RAW_SYMBOL, "edges": model.RAW_EDGE, "includes": model.RAW_INCLUDE, "diagnostics": model.RAW_DIAG}
    return facts.Facts(**{name: whole(name, schema) for name, schema in parts.items()})


def _store(spark: SparkSession) -> Store:
    """A new store in the shared folder."""
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=8)


@query("""
SELECT d.doc_id, sha256(concat(text, chr(0), '7')) AS stamp FROM documents d
WHERE doc_id % 10 = 0 OR lang = 'fr'""")
def stamp_incremental(spark, sf):
    """An earlier index lacks every tenth unit and knows other contents of those in one language: these are stale."""
    (documents,) = load(spark, sf, "documents")
    stamped = lambda text: documents.select("doc_id", "lang", F.concat(F.lit("/d/"), "doc_id").alias("tu"), expr.stamp(F.encode(text, "utf-8"), F.lit("7")).alias("stamp"))
    before = stamped(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    store = _store(spark)
    store.ingest(_facts(spark, units=before.where("doc_id % 10 != 0").select("tu", "stamp")))
    return store.stale(stamped(F.col("text"))).select("doc_id", "stamp")


def _reported(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    raw, orders = load(spark, sf, "v_raw", "orders")
    shown = raw.select(F.col("tu_id").cast("string").alias("tu"), F.col("usr").cast("string").alias("usr"), "line")
    return shown, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("tu"))


@query("""
SELECT tu_id, usr, line FROM v_raw WHERE tu_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT tu_id, usr, line + 100 FROM v_raw WHERE tu_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def replace_by_tu(spark, sf):
    """A store takes all units, then some of them again."""
    raw, again = _reported(spark, sf)
    store = _store(spark)
    store.ingest(_facts(spark, units=raw.select("tu").distinct(), symbols=raw))
    new = raw.join(again, "tu", "left_semi").withColumn("line", F.col("line") + 100)
    store.ingest(_facts(spark, units=new.select("tu").distinct(), symbols=new))
    return store.table("symbol").select(F.col("tu").cast("long").alias("tu_id"), F.col("usr").cast("long").alias("usr"), "line")


@query("SELECT tu_id, usr, line FROM v_raw WHERE tu_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def drop_tu(spark, sf):
    raw, gone = _reported(spark, sf)
    store = _store(spark)
    store.ingest(_facts(spark, units=raw.select("tu").distinct(), symbols=raw))
    store.drop(gone)
    return store.table("symbol").select(F.col("tu").cast("long").alias("tu_id"), F.col("usr").cast("long").alias("usr"), "line")


@query("""
WITH m AS (SELECT o_orderpriority AS key, o_custkey AS value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS r FROM orders)
SELECT key, value::VARCHAR AS value FROM m WHERE r = 1""")
def meta_upsert(spark, sf):
    """Each priority's last order, set after its first."""
    (orders,) = load(spark, sf, "orders")
    ends = orders.groupBy("o_orderpriority").agg(F.min_by("o_custkey", "o_orderkey").alias("a"), F.max_by("o_custkey", "o_orderkey").alias("b")).collect()  # a row a priority
    store = _store(spark)
    store.set_meta(**{r["o_orderpriority"]: r["a"] for r in ends})
    store.set_meta(**{r["o_orderpriority"]: r["b"] for r in ends})
    return store.meta()


@query("""
WITH ranked AS (
  SELECT r.*, row_number() OVER (PARTITION BY tu_id, usr ORDER BY stub, file_id NULLS FIRST, line, def_file_id NULLS FIRST) AS rn FROM v_raw r)
SELECT tu_id, usr, stub, def_file_id, file_id, line FROM ranked WHERE rn = 1""")
def stub_upgrade(spark, sf):
    (raw,) = load(spark, sf, "v_raw")
    return merge.once_per_unit(raw)


@query("SELECT file_id AS tu, count(*) AS problems, count(*) FILTER (severity <> 'warning') AS errors FROM v_diag WHERE severity IN ('error', 'fatal', 'warning') GROUP BY file_id")
def problems_by_unit(spark, sf):
    (diags,) = load(spark, sf, "v_diag")
    return status.problems_by_unit(diags.withColumnRenamed("file_id", "tu"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_values(spark, sf):
    return status.duplicates(*load(spark, sf, "documents"), "text")


@query("""
WITH p AS (SELECT DISTINCT s.usr, concat(f.path, ':', s.line) AS reference FROM v_sym s JOIN v_file f USING (file_id)),
r AS (SELECT p.*, row_number() OVER (PARTITION BY reference ORDER BY (NOT in_project)::INT, stub, length(qualified), qualified, usr) AS rank FROM p JOIN v_sym USING (usr))
SELECT reference, 2::BIGINT AS stage, usr, rank FROM r""")
def resolve_places(spark, sf):
    """Every symbol asked for by its place."""
    symbols, files = load(spark, sf, "v_sym", "v_file")
    places = symbols.join(files.select("file_id", "path"), "file_id").select("usr", "path", "line")
    return resolve.cascade(places.select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("reference")), symbols, places)


@query("""
SELECT DISTINCT concat('f', l_suppkey) AS path, l_linenumber AS "start", l_linenumber + CAST(l_quantity AS INT) % 4 AS "end" FROM lineitem""")
def patch_ranges(spark, sf):
    """A patch an order, a file a line item; some added lines look like file headers."""
    (items,) = load(spark, sf, "lineitem")
    name, added = F.concat(F.lit("f"), "l_suppkey"), (F.col("l_quantity").cast("int") % 4 + 1)
    heads = [F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name), F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name)]
    hunk = F.concat(F.lit("@@ -"), F.col("l_linenumber").cast("string"), F.lit(",2 +"), F.col("l_linenumber").cast("string"), F.lit(","), added.cast("string"), F.lit(" @@ f"))
    lines = F.concat(F.array(*heads, hunk, F.lit("--- a/decoy"), F.lit("-x")), F.transform(F.sequence(F.lit(1), added), lambda i: F.when(i == 1, F.lit("+++ b/decoy")).otherwise(F.lit("+y"))))
    shown = items.select(F.col("l_orderkey").alias("diff"), "l_linenumber", F.posexplode(lines).alias("at", "line"))
    found = git.ranges(shown.select("diff", (F.col("l_linenumber") * 100 + F.col("at")).alias("seq"), "line"))
    return found.distinct()


@query("""
SELECT concat('/o/', l_orderkey) AS tu, concat('p', l_partkey) AS usr, concat('/r/s', l_suppkey, '.h') AS file, l_linenumber AS line,
  CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS stub FROM lineitem WHERE l_orderkey % 5 <> 0""")
def fact_records(spark, sf):
    """A stream an order, a symbol a line item, files by ids of the stream; every fifth stream is cut."""
    (items,) = load(spark, sf, "lineitem")
    order, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    file = (F.col("l_linenumber") * 100_000 + F.col("l_suppkey")).cast("string")
    line = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    own = F.array(
        line('{"t":"f","i":', file, ',"p":"x/../s', F.col("l_suppkey").cast("string"), '.h"}'),
        line('{"t":"sym","u":"p', F.col("l_partkey").cast("string"), '","k":"function","n":"f","f":', file, ',"l":', n, ',"stub":', F.when(F.col("l_returnflag") == "N", "1").otherwise("0"), "}"),
    )
    rows = items.select(order.alias("stream"), F.posexplode(own).alias("at", "line"), "l_linenumber").select("stream", (F.col("l_linenumber") * 2 + F.col("at")).alias("seq"), "line")
    heads = items.select("l_orderkey").distinct().select(order.alias("stream"), F.lit(0).alias("seq"), line('{"t":"meta","k":"tu","v":"/o/', order, '"}').alias("line"))
    ends = items.where("l_orderkey % 5 != 0").select("l_orderkey").distinct().select(order.alias("stream"), F.lit(1 << 20).alias("seq"), F.lit('{"t":"done"}').alias("line"))
    found, _ = facts.decode(heads.unionByName(rows).unionByName(ends), "/r")
    return found.symbols.select("tu", "usr", "file", "line", "stub")


@query("""
WITH l AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT concat('s', conv_id) AS stream, bool_or(turn = n - 1 AND n % 2 = 0) AND NOT bool_or(turn = 1 AND conv_id % 7 = 0) AS accepted FROM l GROUP BY conv_id""")
def fact_stream_accept(spark, sf):
    """A stream a conversation; those of an odd number of turns lack their end, some have a line cut in half."""
    (conversations,) = load(spark, sf, "conversations")
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    numbered = conversations.select("conv_id", "turn", n.alias("n"))
    line = (
        F.when((F.col("turn") == 1) & (F.col("conv_id") % 7 == 0), '{"t":"sym","u":"half')
        .when((F.col("turn") == F.col("n") - 1) & (F.col("n") % 2 == 0), '{"t":"done"}')
        .otherwise('{"t":"sym","u":"x","k":"function","n":"f","f":0,"F":{"virtual":1}}')
    )
    lines = numbered.select(F.concat(F.lit("s"), "conv_id").alias("stream"), F.col("turn").alias("seq"), line.alias("line"))
    return facts.verdicts(facts.parse(lines)).select("stream", "accepted")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, f.path FROM lineitem l
LEFT JOIN (SELECT l_orderkey, l_linenumber, concat('/f', min(l_suppkey)) AS path FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL) f USING (l_orderkey, l_linenumber)""")
def remap_file_ids(spark, sf):
    (items,) = load(spark, sf, "lineitem")
    rows = items.select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("local_id"), "l_linenumber", "l_partkey")
    known = items.where("l_linenumber != 3").groupBy(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("local"))
    known = known.agg(F.concat(F.lit("/f"), F.min("l_suppkey")).alias("path"))
    return facts.remap(rows, known, {"local_id": "path"}).select(F.col("stream").alias("l_orderkey"), "l_linenumber", "l_partkey", "path")


def busiest_callers(spark: SparkSession, sf: str) -> DataFrame:
    """Callers of the symbol with the most, with their call sites."""
    found, symbols = load(spark, sf, "v_edge", "v_sym")
    top = edges.degree(found, symbols).orderBy(F.desc("degree"), "usr").limit(1).select("usr")
    near = found.join(F.broadcast(top.withColumnRenamed("usr", "dst")), "dst", "left_semi")  # a single row
    return edges.neighbours(near, symbols)
