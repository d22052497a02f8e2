"""One ranked record per symbol out of what every unit reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST = 2**31 - 1


def once_per_unit(raw: DataFrame) -> DataFrame:
    """Of what a unit reports of a symbol (tu_id, usr, stub, file_id, line, ...) the full record, if there is one, else the stub; the first by place of equals."""
    order = F.struct("stub", F.col("file_id"), F.col("line"), F.struct(*(c for c in raw.columns if c not in ("tu_id", "usr"))))
    kept = [c for c in raw.columns if c not in ("tu_id", "usr")]
    return raw.groupBy("tu_id", "usr").agg(F.min_by(F.struct(*kept), order).alias("__best")).select("tu_id", "usr", "__best.*")


def merge_symbols(raw: DataFrame, files: DataFrame) -> DataFrame:
    """raw: tu_id, usr, stub, file_id, line, def_file_id and any further columns; files: file_id, is_system, in_project.

    Full records beat stubs, known definitions unknown ones, project files others, other files
    system ones; then file, line, unit and the remaining columns make the order total. Records are
    spread by symbol and unit, so one that every unit reports fills no task; what follows moves one
    row a symbol and task.
    """
    place = files.select(F.col("file_id").alias("__file"), F.col("is_system").cast("int").alias("__system"), F.col("in_project").cast("int").alias("__inside"))
    ranked = raw.join(place, F.col("file_id") == F.col("__file"), "left")
    rest = [c for c in raw.columns if c not in ("usr", "stub", "file_id", "line", "def_file_id", "tu_id")]
    order = F.struct(
        F.col("stub").cast("int").alias("a"),
        F.col("def_file_id").isNull().cast("int").alias("b"),
        (-F.coalesce("__inside", F.lit(0))).alias("c"),
        F.coalesce("__system", F.lit(0)).alias("d"),
        F.col("file_id").isNull().alias("e"),
        F.col("file_id").alias("f"),
        F.coalesce("line", F.lit(0)).alias("g"),
        F.col("tu_id").alias("h"),
        F.col("def_file_id").alias("i"),
        *(F.col(c).alias(f"r{k}") for k, c in enumerate(rest)),
    )
    kept = [c for c in raw.columns if c not in ("usr", "tu_id")]
    # one exchange serves the distinct units; a unit's records of a symbol are few, so combining them before it only costs a sort
    best = ranked.repartition("usr", "tu_id").groupBy("usr").agg(F.min_by(F.struct(*kept), order).alias("__best"), F.countDistinct("tu_id").alias("tu_count"))
    return best.select("usr", "__best.*", "tu_count")
