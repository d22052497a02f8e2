"""Edges: folding, degrees, neighbours with evidence, dependencies, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft import model
from sparkweft.functions import expr


def fold(facts: DataFrame) -> DataFrame:
    """Within a unit, one edge for each (kind, src, dst, file): summed weight, first line, first flags.

    facts: tu_id, kind, src, dst, file_id, line, weight, seq, flags; edges without an end or onto themselves go.
    """
    whole = facts.where((F.col("src") != F.col("dst")) & ~F.col("src").cast("string").eqNullSafe("") & ~F.col("dst").cast("string").eqNullSafe(""))
    has = F.nullif("flags", F.lit("")).isNotNull()
    return whole.groupBy("tu_id", "kind", "src", "dst", "file_id").agg(
        F.sum(F.coalesce("weight", F.lit(1))).alias("weight"),
        F.min_by("line", "seq").alias("line"),
        F.min_by(F.when(has, F.col("flags")), F.when(has, F.col("seq"))).alias("flags"),
    )


def with_project(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Adds in_project of the file that a symbol is declared in."""
    inside = files.where("in_project").select(F.col("file_id").alias("__f"))
    return symbols.join(inside, F.col("file_id") == F.col("__f"), "left").withColumn("in_project", F.col("__f").isNotNull()).drop("__f")


def ends(direction: str) -> tuple[str, str]:
    """(the end asked about, the far end)."""
    return ("dst", "src") if direction == "in" else ("src", "dst")


def linked(edges: DataFrame, symbols: DataFrame, kinds: Sequence[str], direction: str, project_only: bool) -> DataFrame:
    """Edges of these kinds as (usr, other, ...) whose far end is a merged symbol, in the project if asked."""
    near, far = ends(direction)
    known = symbols.where("in_project") if project_only else symbols
    found = edges.where(F.col("kind").isin(*kinds)).withColumnsRenamed({near: "usr", far: "other"})
    return found.join(known.select(F.col("usr").alias("other")), "other", "left_semi")


def degree(edges: DataFrame, symbols: DataFrame, kinds: Sequence[str] = model.CALLS, direction: str = "in", project_only: bool = True) -> DataFrame:
    """usr, degree: exact distinct far ends."""
    pairs = linked(edges, symbols, kinds, direction, project_only).select("usr", "other").distinct()
    return pairs.groupBy("usr").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(
    edges: DataFrame,
    symbols: DataFrame,
    kinds: Sequence[str] = model.CALLS,
    direction: str = "in",
    *,
    project_only: bool = True,
    limit: int | None = None,
    place: Column | None = None,
) -> DataFrame:
    """One row a pair (usr, other): weight, site_count, sites (5), occurrences, via, dispatch.

    Evidence that several units report for one place counts once. place renders a site of an
    edge (default file:line); a limit applies to neighbours by name, not to evidence.
    """
    found = linked(edges, symbols, kinds, direction, project_only)
    if limit is not None:
        names = symbols.select(F.col("usr").alias("other"), F.col("qualified"))
        order = Window.partitionBy("usr").orderBy(F.col("qualified").asc_nulls_first(), "other")
        first = found.select("usr", "other").distinct().join(names, "other").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit)
        found = found.join(first.select("usr", "other"), ["usr", "other"], "left_semi")
    site = place if place is not None else expr.location(F.col("file_id").cast("string"), F.col("line"))
    evidence = found.groupBy("usr", "other", "file_id", "line", "kind", "flags").agg(F.max("weight").alias("weight"))
    weight = F.coalesce(F.nullif("weight", F.lit(0)), F.lit(1))
    has = lambda flag: F.bool_or(F.coalesce(F.try_element_at(expr.flags(F.col("flags")), F.lit(flag)).isNotNull(), F.lit(False)))
    # sites are distinct before they are gathered, and only the first five of a pair are; kinds are bits, so that all of it is hashed;
    # evidence is spread over its places first, then one exchange by pair serves all that follows
    known = sorted(set(kinds))
    bit = F.coalesce(*(F.when(F.col("kind") == k, F.lit(1 << i).cast("long")) for i, k in enumerate(known)))
    per_site = evidence.repartition("usr", "other").withColumn("site", site).groupBy("usr", "other", "site").agg(
        F.min("line").alias("line"), F.sum(weight).alias("weight"), F.bit_or(bit).alias("kinds"), has("virt").alias("virt"), has("pure").alias("pure")
    )
    by_line = Window.partitionBy("usr", "other").orderBy((F.col("site") == "").cast("int"), F.col("line").asc_nulls_first(), "site")
    shown = F.when((F.col("__r") <= model.MOST_SITES) & (F.col("site") != ""), F.struct("__r", "site"))
    folded = per_site.withColumn("__r", F.row_number().over(by_line)).groupBy("usr", "other").agg(
        F.sum("weight").alias("weight"),
        F.count_if(F.col("site") != "").alias("site_count"),
        F.transform(F.sort_array(F.collect_list(shown)), lambda s: s["site"]).alias("sites"),
        F.bit_or("kinds").alias("kinds"),
        F.bool_or("virt").alias("virt"),
        F.bool_or("pure").alias("pure"),
    )
    told = F.filter(F.array(*map(F.lit, known)), lambda k, i: F.getbit("kinds", i) == 1)
    return folded.withColumn("kinds", told).select(
        "usr", "other", "weight", "site_count", "sites",
        F.when(F.col("weight") > F.col("site_count"), F.col("weight")).alias("occurrences"),
        F.when(F.col("kinds") != F.array(F.lit(kinds[0])), F.col("kinds")).alias("via"),
        F.when(F.col("pure"), "pure virtual").when(F.col("virt"), "virtual").alias("dispatch"),
    )


def dependencies(edges: DataFrame, symbols: DataFrame, per_kind: int | None = None, kinds: Sequence[str] = model.DEPENDENCIES) -> DataFrame:
    """usr, kind, other, kind_count, total: what symbols depend on, by edge kind; total sums the exact counts of the kinds."""
    pairs = linked(edges, symbols, kinds, "out", False).select("usr", "kind", "other").distinct()
    counts = pairs.groupBy("usr", "kind").agg(F.count(F.lit(1)).alias("kind_count"))
    totals = counts.groupBy("usr").agg(F.sum("kind_count").alias("total"))
    named = pairs.join(symbols.select(F.col("usr").alias("other"), "qualified"), "other")
    order = Window.partitionBy("usr", "kind").orderBy(F.col("qualified").asc_nulls_first(), "other")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long"))
    if per_kind is not None:
        ranked = ranked.where(F.col("rank") <= per_kind)
    return ranked.drop("qualified").join(counts, ["usr", "kind"]).join(totals, "usr")


def page(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with total, the exact count of all, beside them."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(total), F.lit(True))


def kind_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


def having(symbols: DataFrame, edges: DataFrame, kinds: Sequence[str], direction: str = "in", negate: bool = False) -> DataFrame:
    """usr of the symbols with an edge of these kinds, or without one."""
    near, _ = ends(direction)
    ended = edges.where(F.col("kind").isin(*kinds)).select(F.col(near).alias("usr"))
    return symbols.select("usr").join(ended, "usr", "left_anti" if negate else "left_semi")


def busiest(edges: DataFrame, symbols: DataFrame, kinds: Sequence[str], direction: str = "in", most: int = 1) -> DataFrame:
    """usr, edges of the symbols with the most edges of these kinds, by usr where equal."""
    near, _ = ends(direction)
    known = edges.where(F.col("kind").isin(*kinds)).select(F.col(near).alias("usr")).join(symbols.select("usr"), "usr", "left_semi")
    return known.groupBy("usr").agg(F.count(F.lit(1)).alias("edges")).orderBy(F.desc("edges"), "usr").limit(most)
