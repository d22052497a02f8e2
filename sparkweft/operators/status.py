"""What an index holds and how far to trust it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft import model


def counts(**tables: DataFrame) -> DataFrame:
    """name, n for each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def accuracy(units: DataFrame) -> DataFrame:
    """source, units, word: the configuration sources, with the accuracy of the whole (the best source's) in ``overall``."""
    source = F.coalesce(F.nullif("config_source", F.lit("")), F.lit("unknown"))
    words = F.create_map(*(F.lit(x) for pair in model.ACCURACY_OF.items() for x in pair))
    found = units.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("units"))
    found = found.withColumn("word", F.coalesce(F.try_element_at(words, F.col("source")), F.lit("unknown")))
    rank = F.array_position(F.array(*map(F.lit, model.ACCURACY)), F.col("word"))
    overall = found.agg(F.min_by("word", rank).alias("overall"))
    return found.join(F.broadcast(overall), F.lit(True))


def resolution(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """bucket, edges: where edges lead; the first that fits of no record, stub, no file, project, outside."""
    ends = symbols.select(F.col("usr").alias("dst"), F.col("stub"), F.col("file_id").alias("__f"), F.lit(True).alias("__known"))
    places = files.select(F.col("file_id").alias("__f"), F.col("in_project").alias("__inside"))
    joined = edges.join(ends, "dst", "left").join(places, "__f", "left")
    bucket = (
        F.when(F.col("__known").isNull(), "unknown").when(F.col("stub").cast("int") == 1, "stub").when(F.col("__inside").isNull(), "synthetic")
        .when(F.col("__inside"), "project").otherwise("outside")
    )
    return joined.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("edges"))


def diagnostics(diags: DataFrame, files: DataFrame) -> DataFrame:
    """Errors, fatals and warnings with their paths; the order of an answer is severity descending as text, then path."""
    kept = diags.where(F.col("severity").isin(*model.SEVERITIES))
    return kept.join(files.select("file_id", "path"), "file_id", "left")


def distribution(values: DataFrame, column: str) -> DataFrame:
    """median, p95, most: p95 is the value at position floor(0.95 n) of the sorted values, counted from 1."""
    held = values.where(F.col(column).isNotNull())
    n = held.count()  # the position must be a constant of the aggregate
    at = (max(int(n * 0.95), 1) - 1) / max(n - 1, 1)
    return held.agg(F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(at)).alias("p95"), F.max(column).alias("most"))


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """The column's values that more than one row holds, with their number ``n``."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def problems_by_unit(diags: DataFrame) -> DataFrame:
    """tu, problems, errors: diagnostics of warning and above, and those that are errors, of each unit that has any."""
    kept = diags.where(F.col("severity").isin(*model.SEVERITIES))
    return kept.groupBy("tu").agg(F.count(F.lit(1)).alias("problems"), F.count_if(F.col("severity") != "warning").alias("errors"))


def sample(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """The ``most`` rows that come first by a seeded hash of their key: the same ones however rows are partitioned."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(most)
