"""The nineteen named questions over one index: arguments checked, answers as plain data.

Answers are pages: lists hold at most ``limit`` entries, and exact counts stand beside them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft import model
from sparkweft.functions import expr
from sparkweft.operators import closure, edges, family, impact, ranges, resolve, status
from sparkweft.sources import git
from sparkweft.sources.store import Store

MOST = 500


class ToolError(Exception):
    """A question that cannot be answered as asked; ``payload`` says why."""

    def __init__(self, message: str, **payload: Any):
        super().__init__(message)
        self.payload = {"error": message, **payload}


@dataclass
class Index:
    """The tables that questions read; file ids are paths."""

    spark: SparkSession
    root: str
    files: DataFrame
    units: DataFrame
    symbols: DataFrame
    edges: DataFrame
    includes: DataFrame
    diagnostics: DataFrame
    meta: DataFrame

    @classmethod
    def open(cls, store: Store, root: str) -> Index:
        files = store.table("file").withColumn("file_id", F.col("path"))
        symbols = edges.with_project(store.symbols(), files)
        found = store.table("edge").withColumnsRenamed({"file": "file_id", "tu": "tu_id"})
        diags = store.table("diag").withColumnRenamed("file", "file_id")
        return cls(store.spark, root, files, store.table("unit"), symbols, found, store.table("include"), diags, store.meta())

    def readable(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def place(self, path: str = "file_id", line: str = "line") -> Column:
        return expr.location(expr.relative(F.col(path), self.root), F.col(line))

    def entries(self, rows: DataFrame) -> DataFrame:
        """rows (usr, ...) with what an answer shows of a symbol."""
        shown = self.symbols.select(
            "usr", expr.display().alias("symbol"), F.nullif("signature", F.lit("")).alias("signature"), "kind",
            F.nullif(self.place(), F.lit("")).alias("location"), F.nullif(self.place("def_file_id", "def_line"), F.lit("")).alias("defined_at"),
            F.when(~F.col("in_project"), True).alias("external"), "qualified",
        )
        return rows.join(shown, "usr")

    def places(self) -> DataFrame:
        both = F.array(F.struct(F.col("file_id").alias("path"), F.col("line")), F.struct(F.col("def_file_id").alias("path"), F.col("def_line").alias("line")))
        return self.symbols.select("usr", F.inline(both)).where("path is not null")


def plain(rows: list) -> list[dict]:
    """Rows as dictionaries without absent keys."""
    return [{k: v for k, v in r.asDict(True).items() if v is not None} for r in rows]


def text(args: dict, name: str, required: bool = False) -> str:
    value = args.get(name)
    value = "" if value is None else str(value).strip()
    if required and not value:
        raise ToolError(f"{name} is required")
    return value


def number(args: dict, name: str, default: int, low: int, high: int) -> int:
    try:
        return max(low, min(high, int(args.get(name, default))))
    except (TypeError, ValueError):
        raise ToolError(f"{name} must be a number") from None


def flag(args: dict, name: str, default: bool = False) -> bool:
    value = args.get(name, default)
    return value.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, str) else bool(value)


def cut(rows: DataFrame, order: list, limit: int, key: str, count: str | None = None) -> dict:
    """{key: page, count: exact}: the count is a second job only if the page is full."""
    page = rows.orderBy(*order).limit(limit + 1).collect()
    total = len(page) if len(page) <= limit else rows.count()
    shown = [{k: v for k, v in e.items() if k not in ("usr", "qualified")} for e in plain(page[:limit])]
    return {key: shown, count or f"{key}_count": total} | ({"more": True} if total > limit else {})


_BY_NAME = ["qualified", "usr"]


def candidates(index: Index, reference: str, path: str = "") -> DataFrame:
    asked = index.spark.createDataFrame([(reference,)], "reference string")
    found = resolve.cascade(asked, index.symbols, index.places())
    if path:
        found = resolve.narrowed(found, index.places().withColumn("path", expr.relative(F.col("path"), index.root)), path)
    return found


def one(index: Index, args: dict) -> str:
    reference = text(args, "symbol", required=True)
    rows = candidates(index, reference, text(args, "path")).orderBy("rank").limit(21).collect()
    exact = [r["usr"] for r in rows if r["usr"] == reference]
    if len(exact) == 1 or len(rows) == 1:
        return (exact or [rows[0]["usr"]])[0]
    if not rows:
        raise ToolError(f"no symbol matching {reference!r}")
    listed = index.entries(index.spark.createDataFrame([(r["usr"], r["rank"]) for r in rows[:20]], "usr string, rank long"))
    raise ToolError(f"{reference!r} names more than one symbol", candidates=plain(listed.orderBy("rank").select("symbol", "signature", "kind", "location").collect()))


def only(index: Index, usr: str) -> DataFrame:
    return index.symbols.where(F.col("usr") == usr)


def degree_of(index: Index, usr: str, kinds: tuple[str, ...], direction: str) -> int:
    near, _ = edges.ends(direction)
    row = edges.degree(index.edges.where(F.col(near) == usr), index.symbols, kinds, direction).first()
    return row["degree"] if row else 0


def header(index: Index, usr: str) -> dict:
    return plain(index.entries(only(index, usr).select("usr")).drop("usr", "qualified").collect())[0]


def detail(index: Index, usr: str) -> dict:
    row = only(index, usr).select(expr.notable(F.col("flags")).alias("p"), F.nullif("type_text", F.lit("")).alias("type"), "tu_count", "parent_usr").first()
    out = header(index, usr) | {"usr": usr} | ({"type": row["type"]} if row["type"] else {}) | ({"properties": {k: v == "true" or v for k, v in row["p"].items()}} if row["p"] else {})
    out["translation_units"] = row["tu_count"]
    above = within(index, usr)
    return out | ({"within": above} if above else {})


def within(index: Index, usr: str) -> list[str]:
    chain = closure.ancestors(index.symbols, only(index, usr))
    return [r["symbol"] for r in index.entries(chain.select(F.col("ancestor").alias("usr"), "level")).orderBy("level").collect()]


def neighbour_page(index: Index, usr: str, kinds: tuple[str, ...], direction: str, limit: int, key: str) -> dict:
    near, _ = edges.ends(direction)
    found = index.edges.where(F.col(near) == usr)
    rows = edges.neighbours(found, index.symbols, kinds, direction, limit=limit, place=index.place())
    shown = index.entries(rows.drop("usr").withColumnRenamed("other", "usr"))
    count = F.when(F.col("site_count") > model.MOST_SITES, F.col("site_count")).alias("call_site_count")
    page = shown.orderBy(*_BY_NAME).select(
        "symbol", "signature", "kind", "location", "defined_at", "external", F.when(F.col("site_count") == 1, F.element_at("sites", 1)).alias("call_site"),
        F.when(F.col("site_count") > 1, F.col("sites")).alias("call_sites"), count, "occurrences", "via", "dispatch",
    )
    return {key: plain(page.collect()), f"{key}_count": degree_of(index, usr, kinds, direction)}


# --- the questions -----------------------------------------------------------------------------


def get_index_status(index: Index, args: dict) -> dict:
    inside = index.symbols.where("in_project")
    tables = status.counts(
        files=index.files, project_files=index.files.where("in_project"), translation_units=index.units, symbols=index.symbols, project_symbols=inside, edges=index.edges,
        includes=index.includes, diagnostics=index.diagnostics, degraded_tus=index.units.where("degraded"), failed_tus=index.units.where("errors > 0"),
        pch_dropped_tus=index.units.where("pch_dropped != ''"),
    )
    out: dict[str, Any] = {"root": index.root} | {r["name"]: r["n"] for r in tables.collect()}
    sources = status.accuracy(index.units).collect()
    out["accuracy"] = sources[0]["overall"] if sources else "empty"
    if out["accuracy"] == "exact" and out["pch_dropped_tus"]:
        out["accuracy"] = "approximate"
    out["compiler_arguments"] = {r["source"]: r["units"] for r in sources}
    out["meta"] = meta = {r["key"]: r["value"] for r in index.meta.collect()}
    if out["accuracy"] == "empty":
        out["note"] = "no translation units have been indexed"
    if meta.get("indexed_at"):
        out["built_at"] = meta["indexed_at"]
    if meta.get("git_revision"):
        out["indexed_revision"] = meta["git_revision"]
        if now := git.head(index.root):
            out |= {"current_revision": now, "index_matches_working_tree": now == meta["git_revision"]}
    said = {"degraded_tus": "unit(s) were analysed with guessed arguments", "failed_tus": "unit(s) reported errors", "pch_dropped_tus": "unit(s) were read without their precompiled header"}
    warnings = [f"{out[k]} {words}" for k, words in said.items() if out[k]]
    return out | ({"warnings": warnings} if warnings else {})


def find_symbol(index: Index, args: dict) -> dict:
    reference, limit = text(args, "reference", required=True), number(args, "limit", 10, 1, MOST)
    found = index.entries(candidates(index, reference, text(args, "path")).select("usr", "rank"))
    return {"reference": reference} | cut(found.drop("defined_at", "external"), ["rank"], limit, "matches", "match_count")


def get_symbol(index: Index, args: dict) -> dict:
    usr = one(index, args)
    out = detail(index, usr) | {"callers": degree_of(index, usr, model.CALLS, "in"), "callees": degree_of(index, usr, model.CALLS, "out")}
    return out if out["kind"] in model.CALLABLE else out | {"references": degree_of(index, usr, ("references",), "in")}


def get_function(index: Index, args: dict) -> dict:
    usr = one(index, args)
    out = detail(index, usr)
    if out["kind"] not in model.CALLABLE:
        raise ToolError(f"{out['symbol']} is a {out['kind']}, not a function", symbol=out["symbol"], kind=out["kind"], hint="get_symbol describes any symbol")
    out |= {"callers": degree_of(index, usr, model.CALLS, "in"), "callees": degree_of(index, usr, model.CALLS, "out")}
    if out["kind"] in ("constructor", "destructor"):
        out.pop("type", None)
    return out


def get_class(index: Index, args: dict) -> dict:
    usr, limit = one(index, args), number(args, "limit", 25, 1, MOST)
    out = detail(index, usr)
    if out["kind"] not in (*model.TYPES, "namespace"):
        raise ToolError(f"{out['symbol']} is a {out['kind']}, not a type", symbol=out["symbol"], kind=out["kind"], hint="get_symbol describes any symbol")
    out |= _tree(index, usr, limit, True)
    inside = index.entries(closure.members(index.symbols).where(F.col("parent") == usr).select("usr", "line"))
    for key, kinds, count in (("methods", model.CALLABLE, "method_count"), ("fields", ("field", "enumerator", "variable"), "field_count"), ("nested_types", model.TYPES, "nested_type_count")):
        part = cut(inside.where(F.col("kind").isin(*kinds)), ["kind", "line", "usr"], limit, key, count)
        out |= part if part[key] else {}
    return out


def _tree(index: Index, usr: str, limit: int, transitive: bool) -> dict:
    rows = family.report(index.edges, index.symbols, only(index, usr), 8 if transitive else 0)
    rows = index.entries(rows.drop("usr").withColumnRenamed("other", "usr"))
    rows = rows.withColumns({"is_virtual": F.when(F.col("is_virtual"), True), "via_template": F.when(F.col("via_template"), True)}).withColumnRenamed("is_virtual", "virtual")
    out = {}
    for relation in ("bases", "derived", "ancestors", "descendants", "overrides", "overrides_indirectly", "overridden"):
        part = cut(rows.where(F.col("relation") == relation).drop("relation"), _BY_NAME, limit, relation)
        if part[relation] or relation in ("bases", "derived"):
            out |= part
    return out


def search_symbols(index: Index, args: dict) -> dict:
    wanted, limit = text(args, "query", required=True), number(args, "limit", 20, 1, MOST)
    found = resolve.search(index.symbols, wanted, text(args, "kind") or None, not flag(args, "include_system"))
    shown = index.entries(found.select("usr")).withColumn("__n", F.length(F.coalesce("qualified", "symbol")))
    out = {"query": wanted} | cut(shown, ["__n", *_BY_NAME], limit, "matches", "match_count")
    for entry in out["matches"]:
        entry.pop("__n", None)
    return out if out["matches"] else out | {"note": "no name contains that text"}


def _called(direction: str, key: str, kinds: tuple[str, ...]) -> Callable[[Index, dict], dict]:
    def ask(index: Index, args: dict) -> dict:
        usr = one(index, args)
        out = header(index, usr) | neighbour_page(index, usr, kinds, direction, number(args, "limit", 25, 1, MOST), key)
        if out.get("kind") == "macro" and not out[key]:
            out["note"] = "uses of macros are not recorded as edges"
        return out

    return ask


def get_inheritance(index: Index, args: dict) -> dict:
    usr = one(index, args)
    return header(index, usr) | _tree(index, usr, number(args, "limit", 25, 1, MOST), flag(args, "transitive", True))


def get_symbol_dependencies(index: Index, args: dict) -> dict:
    usr, limit = one(index, args), number(args, "limit", 25, 1, MOST)
    rows = edges.dependencies(index.edges.where(F.col("src") == usr), index.symbols, per_kind=limit)
    shown = index.entries(rows.select(F.col("other").alias("usr"), F.col("kind").alias("edge"), "rank", "kind_count", "total")).orderBy("edge", "rank").collect()
    out = header(index, usr) | {"dependency_count": shown[0]["total"] if shown else 0}
    for row in shown:
        entry = {k: v for k, v in row.asDict().items() if v is not None and k not in ("usr", "edge", "rank", "kind_count", "total", "qualified")}
        out.setdefault(row["edge"], []).append(entry)
        out[f"{row['edge']}_count"] = row["kind_count"]
    return out


def get_impact_analysis(index: Index, args: dict) -> dict:
    usr, depth, limit = one(index, args), number(args, "depth", 3, 1, 8), number(args, "limit", 40, 1, MOST)
    rows = impact.impact(index.edges, index.symbols, only(index, usr), depth=depth, limit=limit).orderBy("bucket", "rank").collect()
    return header(index, usr) | _buckets(rows)


def _buckets(rows: list) -> dict:
    out: dict[str, Any] = {b: [] for b in impact.BUCKETS}
    for r in rows:
        out[r["bucket"]].append({k: v for k, v in r.asDict().items() if v is not None and k in ("symbol", "reason", "hops", "because_of")})
    truncated = sorted({r["bucket"] for r in rows if r["cut"]})
    return out | ({"truncated": truncated} if truncated else {})


def _file(index: Index, args: dict) -> str:
    path = text(args, "path", required=True)
    row = resolve.files(index.spark.createDataFrame([(path,)], "wanted string"), index.files, index.root).first()
    if row is None:
        raise ToolError(f"{path} is not in the index")
    return row["path"]


def _start(index: Index, path: str) -> DataFrame:
    return index.spark.createDataFrame([(path,)], "start string")


def _paths(index: Index, rows: DataFrame, column: str) -> DataFrame:
    return rows.select(expr.relative(F.col(column), index.root).alias("path"), *[c for c in rows.columns if c != column])


def get_file(index: Index, args: dict) -> dict:
    path, limit = _file(index, args), number(args, "limit", 30, 1, MOST)
    row = index.files.where(F.col("path") == path).first()
    held = index.symbols.where((F.col("file_id") == path) | (F.col("def_file_id") == path))
    reaching = closure.units_reaching(index.includes, index.units.select(F.col("tu").alias("file_id")), index.spark.createDataFrame([(path,)], "file_id string"))
    languages = sorted(r[0] for r in reaching.select(expr.language(F.col("unit")).alias("l")).where("l is not null").distinct().collect())
    out = {"path": path, "in_project": row["in_project"], "is_system": row["is_system"], "symbols": held.count(), "languages": languages}
    return out | get_includes(index, args) | cut(_paths(index, reaching.select("unit"), "unit"), ["path"], limit, "translation_units")


def get_file_symbols(index: Index, args: dict) -> dict:
    path, limit = _file(index, args), number(args, "limit", 100, 1, MOST)
    held = index.symbols.where((F.col("file_id") == path) | (F.col("def_file_id") == path))
    if not flag(args, "include_system"):
        held = held.where("in_project")
    start = F.when(F.col("def_file_id") == path, F.col("def_line")).otherwise(F.col("line"))
    rows = index.entries(held.select("usr", start.alias("at"), "col"))
    return {"path": path} | cut(rows, ["at", "col", "usr"], limit, "symbols", "symbol_count")


def _included(index: Index, path: str, limit: int, transitive: bool) -> dict:
    out = {}
    for way, a, b, key in (("out", "from_file", "to_file", "includes"), ("in", "to_file", "from_file", "included_by")):
        if transitive:
            rows = closure.files(index.includes, _start(index, path), way).select("node", "level")
            out |= cut(_paths(index, rows, "node"), ["level", "path"], limit, key)
        else:
            columns = [b, "line", "angled", "spelled"] if way == "out" else [b]
            out |= cut(_paths(index, index.includes.where(F.col(a) == path).select(*columns).distinct(), b), ["path", *columns[1:]], limit, key)
    return out


def get_includes(index: Index, args: dict) -> dict:
    path = _file(index, args)
    return {"path": path} | _included(index, path, number(args, "limit", 50, 1, MOST), flag(args, "transitive"))


def get_file_dependencies(index: Index, args: dict) -> dict:
    path = _file(index, args)
    return {"path": path} | _included(index, path, number(args, "limit", 50, 1, MOST), True)


def get_source_context(index: Index, args: dict) -> dict:
    usr, context = one(index, args), number(args, "context_lines", 20, 0, 200)
    extent = closure.container_end(index.symbols, starts=only(index, usr)).withColumnRenamed("usr", "__u")
    defined = F.col("def_file_id").isNotNull()
    first = F.when(defined, F.col("def_line")).otherwise(F.col("line"))
    inner = F.when(F.col("kind").isin("namespace", "class", "struct"), F.col("last_line"))
    wanted = only(index, usr).join(extent, F.col("usr") == F.col("__u"), "left").select(
        "usr", F.when(defined, F.col("def_file_id")).otherwise(F.col("file_id")).alias("path"), first.alias("first"), F.coalesce("end_line", inner, first).cast("int").alias("last")
    )
    row = wanted.first()
    out = header(index, usr)
    if row["path"] is None or not row["first"]:
        return out
    held = index.spark.read.option("ignoreMissingFiles", True).format("binaryFile").load(row["path"]) if index.readable(row["path"]) else index.spark.createDataFrame([], "content binary")
    source = held.select(F.lit(row["path"]).alias("path"), F.decode("content", "utf-8").alias("text"))
    return out | plain(ranges.source_context(wanted, source, context).drop("usr").collect())[0]


def get_changed_symbols(index: Index, args: dict) -> dict:
    revision, limit, depth = text(args, "revision") or "HEAD", number(args, "limit", 50, 1, MOST), number(args, "depth", 3, 1, 8)
    changes = git.diff(index.spark, index.root, revision, flag(args, "staged"))
    top = git._git(index.root, "rev-parse", "--show-toplevel").strip()
    numbered = git.for_index(changes).select(F.concat(F.lit(top + "/"), "path").alias("file_id"), "start", "end")
    numbered = numbered.withColumn("range_id", F.xxhash64("file_id", "start", "end"))
    changed = ranges.changed_symbols(numbered, index.symbols)
    out = {"revision": revision, "files": plain(changes.select("path", "status").distinct().orderBy("path").collect())}
    out |= cut(changed, ["seq"], limit, "changed_symbols", "symbol_count")
    loose = ranges.unattributed(numbered, ranges.spans(index.symbols)).collect()
    if loose:
        out["lines_outside_any_symbol"] = {r["file_id"].removeprefix(top + "/"): r["lines"] for r in loose}
    if flag(args, "include_impact"):
        rows = impact.of_changes(index.edges, index.symbols, changed.select("usr", "seq"), depth=depth, limit=limit).collect()
        out["affected"] = _buckets(sorted(rows, key=lambda r: (r["bucket"], r["symbol"])))
        out["affected_count"] = len(rows)
    return out


def get_diagnostics(index: Index, args: dict) -> dict:
    rows = status.diagnostics(index.diagnostics, index.files)
    if path := text(args, "path"):
        rows = rows.where(expr.same_file(expr.relative(F.col("path"), index.root), F.lit(path)))
    rows = rows.select("severity", "message", F.nullif(index.place("path"), F.lit("")).alias("location"), "path")
    return cut(rows, [F.desc("severity"), "path", "location", "message"], number(args, "limit", 25, 1, MOST), "diagnostics", "count")


TOOLS: dict[str, Callable[[Index, dict], dict]] = {
    "get_index_status": get_index_status,
    "find_symbol": find_symbol,
    "get_symbol": get_symbol,
    "get_function": get_function,
    "get_class": get_class,
    "search_symbols": search_symbols,
    "get_callers": _called("in", "callers", model.CALLS),
    "get_callees": _called("out", "callees", model.CALLS),
    "get_references": _called("in", "references", model.REFERENCES),
    "get_inheritance": get_inheritance,
    "get_symbol_dependencies": get_symbol_dependencies,
    "get_impact_analysis": get_impact_analysis,
    "get_file": get_file,
    "get_file_symbols": get_file_symbols,
    "get_includes": get_includes,
    "get_file_dependencies": get_file_dependencies,
    "get_source_context": get_source_context,
    "get_changed_symbols": get_changed_symbols,
    "get_diagnostics": get_diagnostics,
}


def call(index: Index, name: str, args: dict | None = None) -> dict:
    if name not in TOOLS:
        raise ToolError(f"no question is named {name!r}", known=sorted(TOOLS))
    return TOOLS[name](index, dict(args or {}))


def answer(index: Index, name: str, args: dict | None = None) -> str:
    """The answer, or the reason that there is none, as JSON."""
    try:
        return json.dumps(call(index, name, args), ensure_ascii=False, default=str)
    except ToolError as e:
        return json.dumps(e.payload, ensure_ascii=False, default=str)
