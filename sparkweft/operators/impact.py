"""What a change could reach, in three degrees, for many symbols at once.

direct: the index records the dependency; possible: run-time behaviour decides; indirect: callers
of callers, hop by hop. Origins travel with the rows, so one walk serves all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft import model
from sparkweft.functions import expr
from sparkweft.operators import edges as edge_ops
from sparkweft.operators import family
from sparkweft.session import durable

# The sentences of a report.
CALLS = "calls this symbol"
DERIVES = "derives from this type"
USES = "uses this symbol"
OVERRIDES = "overrides this method, so a call through the base may reach it"
OVERRIDES_FAR = "overrides a method that overrides this one, so a call through the base may reach it"
INHERITS = "inherits from this type, so it carries the change through the members it did not redefine"
POINTER = "calls this through a function pointer, so the target is only known at run time"
ADDRESS = "takes the address of this function; the call site is recorded against the pointer, not against this symbol"
INSTANCE = "is an instantiation of this template"
BUCKETS = ("direct", "possible", "indirect")


#: The sentence of each step; steps under 20 are direct, under 30 possible, and 30 + hops indirect.
REASONS = {
    1: CALLS, 2: DERIVES, 3: USES, **{4 + k: reason for k, (_, reason) in enumerate(model.TYPE_REASONS)},
    20: OVERRIDES, 21: OVERRIDES_FAR, 22: INHERITS, 23: POINTER, 24: ADDRESS, 25: INSTANCE,
}


def impact(
    edges: DataFrame, symbols: DataFrame, targets: DataFrame | None = None, *, depth: int = 3, limit: int | None = 60, dedup: str = "name", buckets: tuple[str, ...] = BUCKETS
) -> DataFrame:
    """origin, bucket, rank, usr, symbol, reason, hops, cut; cut: a list behind the bucket was longer than the limit.

    An entry shows once, in the first bucket that has its display name (or usr, with dedup='usr').
    Only what the asked buckets depend on is walked: nothing for direct ones, families for possible ones.
    """
    wanted = (targets if targets is not None else symbols).select(F.col("usr").alias("origin")).distinct()
    kinds = symbols.select(F.col("usr").alias("origin"), expr.callable_kind(F.col("kind")).alias("callable"))
    origins = wanted.join(kinds, "origin")
    names = symbols.select("usr", expr.display().alias("symbol"), F.coalesce("in_project", F.lit(False)).alias("inside"))
    near = _near(edges, origins, names)
    if set(buckets) == {"direct"}:
        return _shown(near.where("step < 20"), limit, dedup, buckets)
    # a walk reads its edges once a level: they are written once, without flags
    tied = durable(edges.where(F.col("kind").isin("inherits", "overrides", "instantiates")).select("kind", "src", "dst").distinct()).withColumn("flags", F.lit(None).cast("string"))
    far = family.report(tied, symbols, wanted.select(F.col("origin").alias("usr")), relations=("overrides_indirectly", "descendants"))
    far = far.select(F.col("usr").alias("origin"), F.col("other").alias("usr"), F.when(F.col("relation") == "descendants", 22).otherwise(21).alias("step"))
    far = far.join(origins, "origin").where("step = 21 or not callable").join(names, "usr")
    near = near.unionByName(far.select("origin", "usr", "symbol", "step"))
    if "indirect" not in buckets:
        return _shown(near, limit, dedup, buckets)
    near = durable(near)
    callers = edge_ops.linked(edges, symbols, model.CALLS, "in", True).select(F.col("usr").alias("at"), F.col("other").alias("usr")).where("at != usr").distinct()
    callers = durable(callers)
    key = "symbol" if dedup == "name" else "usr"
    told = near.select("origin", key).distinct()
    seen = origins.select("origin", F.col("origin").alias("usr"))
    frontier = near.where("step < 20").select("origin", "usr").distinct().join(seen, ["origin", "usr"], "left_anti")
    seen = seen.unionByName(frontier)
    out = near
    for hop in range(2, depth + 1):
        step = frontier.withColumnRenamed("usr", "at").join(callers, "at").select("origin", "usr").distinct()
        frontier = durable(step.join(seen, ["origin", "usr"], "left_anti"))
        if frontier.isEmpty():
            break
        named = frontier.join(names, "usr").select("origin", "usr", "symbol", F.lit(30 + hop).alias("step"))
        out = out.unionByName(named)
        if hop == depth:
            break
        seen = seen.unionByName(frontier)
        if limit is not None:
            # nearer hops rank first: an origin whose page these fill, and whose list is known to be cut, has no use for farther ones
            many = frontier.groupBy("origin").count().where(F.col("count") > limit).select("origin")
            full = named.join(many, "origin", "left_semi").select("origin", key).distinct().join(told, ["origin", key], "left_anti").groupBy("origin").count().where(F.col("count") >= limit)
            full = durable(full.select("origin"))
            frontier = frontier.join(full, "origin", "left_anti")
    return _shown(out, limit, dedup, buckets)


def _near(edges: DataFrame, origins: DataFrame, names: DataFrame) -> DataFrame:
    """origin, usr, symbol, step of all that edges tell by themselves, in one pass over them."""
    kind, inside, callable_ = F.col("kind"), F.col("inside"), F.col("callable")
    steps = [
        F.when((kind == "calls") & inside, 1), F.when(kind == "inherits", 2), F.when(kind == "instantiates", -2), F.when((kind == "references") & inside, F.when(callable_, 24).otherwise(3)),
        *(F.when((kind == k) & inside, 4 + i) for i, (k, _) in enumerate(model.TYPE_REASONS)),
        F.when(kind == "overrides", 20), F.when((kind == "calls_indirect") & inside, 23), F.when(kind.isin("specializes", "instantiates") & inside, 25),
    ]
    used = ["calls", "inherits", "instantiates", "references", *(k for k, _ in model.TYPE_REASONS), "overrides", "calls_indirect", "specializes"]
    found = edges.where(kind.isin(*used)).select("kind", F.col("src").alias("usr"), F.col("dst").alias("origin")).join(origins, "origin").join(names, "usr")
    rows = found.select("origin", "usr", "symbol", F.explode(F.array_compact(F.array(*steps))).alias("step")).distinct()
    # users of a template derive from it (-2) under names that no derived type has; of those that share a name the first is told
    same = Window.partitionBy("origin", "symbol")
    marked = rows.withColumns({"__derived": F.max(F.col("step") == 2).over(same), "__first": F.min(F.when(F.col("step") == -2, F.col("usr"))).over(same)})
    kept = marked.where((F.col("step") != -2) | (~F.col("__derived") & (F.col("usr") == F.col("__first"))))
    return kept.select("origin", "usr", "symbol", F.abs("step").alias("step"))


def _shown(rows: DataFrame, limit: int | None, dedup: str, buckets: tuple[str, ...]) -> DataFrame:
    bucket = F.when(F.col("step") < 20, "direct").when(F.col("step") < 30, "possible").otherwise("indirect")
    rows = rows.withColumn("bucket", bucket)
    key = "symbol" if dedup == "name" else "usr"
    # windows that only cut needs go where cut is not read
    step = F.count(F.lit(1)).over(Window.partitionBy("origin", "bucket", "step"))
    sized = rows.withColumn("__n", step).withColumn("longest", F.max("__n").over(Window.partitionBy("origin", "bucket")))
    first = sized.withColumn("__r", F.row_number().over(Window.partitionBy("origin", key).orderBy("step", "symbol", "usr"))).where("__r = 1")
    first = first.where(F.col("bucket").isin(*buckets))
    rank = F.row_number().over(Window.partitionBy("origin", "bucket").orderBy("step", "symbol", "usr"))
    ranked = first.withColumn("rank", rank)
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    ranked = ranked.withColumn("rank", F.col("rank").cast("long"))
    cut = F.lit(False) if limit is None else F.col("longest") > limit
    hops = F.when(F.col("step") > 30, (F.col("step") - 30).cast("long"))
    reason = F.when(F.col("step") > 30, F.concat(F.lit("calls a caller of this symbol ("), hops.cast("string"), F.lit(" hops)")))
    for k, text in REASONS.items():
        reason = reason.when(F.col("step") == k, text)
    return ranked.select("origin", "bucket", "rank", "usr", "symbol", reason.alias("reason"), hops.alias("hops"), cut.alias("cut"))


def of_changes(edges: DataFrame, symbols: DataFrame, changed: DataFrame, *, depth: int = 3, limit: int | None = 40) -> DataFrame:
    """bucket, symbol, usr, reason, hops, because_of, cut: the union over changed symbols (usr, seq), the first to name an entry keeps it.

    The changed symbols are the subject of the question and are left out, by name.
    """
    names = symbols.select("usr", expr.display().alias("symbol"))
    touched = changed.select("usr", "seq").join(names, "usr")
    reached = impact(edges, symbols, changed.select("usr"), depth=depth, limit=limit)
    reached = reached.join(touched.select("symbol").distinct(), "symbol", "left_anti")
    causes = touched.select(F.col("usr").alias("origin"), F.col("symbol").alias("because_of"), "seq")
    order = Window.partitionBy("bucket", "symbol").orderBy("seq", "origin", "rank")
    first = reached.join(causes, "origin").withColumn("__r", F.row_number().over(order)).where("__r = 1")
    return first.select("bucket", "symbol", "usr", "reason", "hops", "because_of", "cut")


