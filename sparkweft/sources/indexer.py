"""The index command: plan, stamp, produce, ingest, merge."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.session import durable
from sparkweft.sources import compdb, facts, git
from sparkweft.sources.store import Store

RESULT = "path, status, detail, symbols, edges, includes, errors, degraded, pch_dropped"


@dataclass
class Plan:
    """What to index. files: path, header; degraded: there is no database, so arguments are guesses."""

    root: str
    database: compdb.Database
    files: DataFrame
    degraded: bool
    notes: list[str] = field(default_factory=list)


@dataclass
class Report:
    """Counts of a run; ``results`` has a row for each planned unit (path, status, detail, counts)."""

    total: int
    indexed: int
    failed: int
    unchanged: int
    degraded: int
    pch_dropped: int
    seconds: float
    notes: list[str]
    results: DataFrame


def plan(spark: SparkSession, root: str, database: str | None = None, only: list[str] | None = None, limit: int | None = None) -> Plan:
    root = os.path.abspath(root)
    found = compdb.load(spark, root, database)
    files = found.files if found.files is not None else compdb.walk(spark, root).withColumn("header", F.lit(None).cast("string"))
    notes = [found.detail] + ([] if found.files is not None else ["arguments are guessed, since there is no compilation database"])
    return Plan(root, found, compdb.plan(compdb.present(files), only, limit), found.files is None, notes)


def _counted(stats: str) -> list:
    return [F.coalesce(F.get_json_object(stats, f"$.{k}").try_cast("long"), F.lit(0)).alias(k) for k in ("symbols", "edges", "includes")]


def index(
    spark: SparkSession,
    root: str,
    store: Store,
    command: Callable[[str, bool], list[str]],
    *,
    database: str | None = None,
    only: list[str] | None = None,
    limit: int | None = None,
    incremental: bool = True,
    timeout: float = 300.0,
) -> Report:
    """Bring a store up to date with a source tree; command gives the extractor's arguments for (path, without header).

    Units whose stamp is stored already are left alone. Extraction runs on the executors, one unit
    of work a file; what it made is checkpointed before anything is replaced, and all accepted units
    are replaced in one version. A unit that fails keeps the facts that it had. Symbols are
    merged again only if something was indexed.
    """
    began = time.time()
    planned = plan(spark, root, database, only, limit)
    mark = str(os.stat(planned.database.path).st_mtime_ns) if planned.database.path else ""
    stamped = durable(compdb.stamps(planned.files, mark))
    pending = durable(store.stale(stamped)) if incremental else stamped
    made = durable(compdb.produce(pending, command, timeout))
    streams = made.where("text != ''")
    found, judged = facts.decode(facts.from_texts(streams), planned.root, pending.select(F.col("path").alias("stream"), "stamp"))
    judged = durable(judged)
    # a unit is known by the path that was planned, so that its stamp is found again
    accepted = judged.where("accepted").count()
    if accepted:
        store.ingest(found)
        store.rebuild_symbols()
    head = git.head(planned.root)
    store.set_meta(root=planned.root, indexed_at=str(int(time.time())), **({"git_revision": head} if head else {}))
    fresh = store.table("unit").select(F.col("tu").alias("path"), *_counted("stats"), "errors", "degraded", "pch_dropped")
    told = made.select(F.col("stream").alias("path"), "error").join(judged.withColumnRenamed("stream", "path"), "path", "left")
    failed = F.coalesce("accepted", F.lit(False)) == F.lit(False)
    detail = F.coalesce(F.nullif("error", F.lit("")), "reason", F.lit("no output"))
    tried = told.select("path", F.when(failed, "failed").otherwise("indexed").alias("status"), F.when(failed, detail).otherwise("").alias("detail"))
    rows = stamped.select("path").join(tried, "path", "left").join(fresh, "path", "left")
    results = durable(rows.withColumns({"status": F.coalesce("status", F.lit("unchanged")), "detail": F.coalesce("detail", F.lit(""))}).selectExpr(*RESULT.split(", ")))
    n = results.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "failed", "unchanged")),
        F.count_if((F.col("status") == "indexed") & F.col("degraded")).alias("degraded"), F.count_if((F.col("status") == "indexed") & (F.col("pch_dropped") != "")).alias("pch_dropped"),
    ).first()
    return Report(**n.asDict(), seconds=time.time() - began, notes=planned.notes, results=results)
