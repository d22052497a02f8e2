"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    out = os.path.join(tempfile.mkdtemp(), "sparkweft_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where the session names none, as in local tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        alone = context.master == "local" or context.master.startswith("local[")  # one machine holds driver and executors
        if not (named or alone):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkweft-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: A class that holds more than this part of all rows, one in so many, is common; so common classes are fewer than this number.
COMMON = 1000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, class_key: str, copies: str) -> DataFrame:
    """rows with the columns of the class that has their key; copies, a class's number of rows, is left out.

    Rows of common classes never meet in one task: these classes are broadcast, of which there are fewer than
    ``COMMON`` whatever the data. The other rows are joined by key.
    """
    total = classes.agg(F.sum(copies)).first()[0] or 0
    common, others = (classes.where(c).drop(copies) for c in (F.col(copies) * COMMON > total, F.col(copies) * COMMON <= total))
    same = F.col(key) == F.col(class_key)
    apart = rows.join(F.broadcast(common.select(class_key)), same, "left_anti").join(others, same)
    return rows.join(F.broadcast(common), same).unionByName(apart).drop(class_key)


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m: the split of labelled rows."""
    return F.crc32(F.col(id_col).cast("string")) % m


def rows_with(documents: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """doc_id, text, held_out, and all columns of the document as ``row``."""
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"), row)


def sampled_ids(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> list:
    """(id, class) of at most ``per_class`` ids of each class, first by a hash of the id; an id of several classes counts for the least.

    The sample's bound is ``per_class`` times the number of classes. Rows are thinned by their hash
    inside the scan, against counts of ids by class, so what is exchanged has that bound too.
    """
    from pyspark.sql import Window

    known = rows.select(F.col(id_col).alias("id"), F.col(class_col).alias("class")).where("id is not null and class is not null")
    sizes = known.groupBy("class").agg(F.approx_count_distinct("id").alias("n")).collect()  # a row a language or label
    if not sizes:
        return []
    kept = rows.sparkSession.createDataFrame([(r["class"], (2.0 * per_class + 100) / r["n"]) for r in sizes], f"__class {known.schema['class'].dataType.simpleString()}, __share double")
    share = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    # the classes are those just counted, a row each
    thinned = known.withColumn("__h", share).join(F.broadcast(kept), F.col("class") == F.col("__class")).where("__h <= __share")
    once = thinned.groupBy("id").agg(F.min("class").alias("class"), F.min("__h").alias("__h"))
    w = Window.partitionBy("class").orderBy("__h", "id")
    ranked = once.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_class)
    return sorted((r[0], r[1]) for r in ranked.select("id", "class").collect())


def texts_of(rows: DataFrame, ids: list) -> DataFrame:
    """doc_id, text of a bounded sample of ids; of several texts of an id the greatest, so a repeated id brings one."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    wanted = rows.sparkSession.createDataFrame([(i,) for i in ids], f"__id {kind}")
    found = rows.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("__id"), "left_semi")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"))
