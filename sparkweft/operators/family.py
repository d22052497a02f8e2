"""Inheritance and overriding, direct and transitive, for all symbols or some."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.functions import expr
from sparkweft.operators import closure


def _direct(edges: DataFrame, kind: str, relation: str, near: str, far: str) -> DataFrame:
    """Distinct far ends with the access word and the virtual flag of any reporting unit."""
    flags = expr.flags(F.col("flags"))
    access = F.nullif(F.try_element_at(flags, F.lit("acc")), F.lit(""))
    found = edges.where(F.col("kind") == kind).groupBy(F.col(near).alias("usr"), F.col(far).alias("other"))
    return found.agg(
        F.max(expr.access_word(access)).alias("access"), F.bool_or(F.coalesce(F.try_element_at(flags, F.lit("virtual")) == "1", F.lit(False))).alias("is_virtual")
    ).select("usr", F.lit(relation).alias("relation"), "other", "access", "is_virtual", F.lit(False).alias("via_template"))


def report(edges: DataFrame, symbols: DataFrame, targets: DataFrame | None = None, depth: int = 8, relations: tuple[str, ...] | None = None) -> DataFrame:
    """usr, relation, other, access, is_virtual, via_template; of the named relations only, where they are given.

    Transitive relations leave out what the direct ones already name; as names are what a reader
    sees, that is decided by display name.
    """
    wanted = (targets if targets is not None else symbols).select("usr").distinct()
    names = symbols.select(F.col("usr").alias("other"), expr.display().alias("name"))
    parts = [
        _direct(edges, "inherits", "bases", "src", "dst"),
        _direct(edges, "inherits", "derived", "dst", "src"),
        _direct(edges, "overrides", "overrides", "dst", "src"),
        _direct(edges, "overrides", "overridden", "src", "dst"),
    ]
    direct = parts[0]
    for part in parts[1:]:
        direct = direct.unionByName(part)
    direct = direct.join(wanted, "usr", "left_semi").join(names, "other")
    derived = direct.where("relation = 'derived'").select("usr", "name").distinct()
    template = edges.where("kind = 'instantiates'").select(F.col("dst").alias("usr"), F.col("src").alias("other")).distinct()
    template = template.join(wanted, "usr", "left_semi").join(names, "other").join(derived, ["usr", "name"], "left_anti")
    # of template users that share a name the first is told
    template = template.groupBy("usr", "name").agg(F.min("other").alias("other"))
    template = template.select("usr", F.lit("derived").alias("relation"), "other", F.lit(None).cast("string").alias("access"), F.lit(False).alias("is_virtual"), F.lit(True).alias("via_template"), "name")
    direct = direct.unionByName(template)
    told = {"ancestors": ("bases",), "descendants": ("bases", "derived"), "overrides_indirectly": ("overrides",)}
    out = direct
    starts = wanted.select(F.col("usr").alias("start"))
    for relation, kind, way in (("ancestors", "inherits", "out"), ("descendants", "inherits", "in"), ("overrides_indirectly", "overrides", "in")):
        if relations is not None and relation not in relations:
            continue
        far = closure.bounded(edges, symbols, (kind,), way, depth, starts).select(F.col("start").alias("usr"), F.col("node").alias("other"))
        known = direct.where(F.col("relation").isin(*told[relation])).select("usr", "name").distinct()
        far = far.join(names, "other").join(known, ["usr", "name"], "left_anti")
        out = out.unionByName(
            far.select("usr", F.lit(relation).alias("relation"), "other", F.lit(None).cast("string").alias("access"), F.lit(False).alias("is_virtual"), F.lit(False).alias("via_template"), "name")
        )
    if relations is not None:
        out = out.where(F.col("relation").isin(*relations))
    return out.select("usr", "relation", "other", "access", "is_virtual", "via_template")
