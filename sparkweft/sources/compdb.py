"""Compilation databases, source trees and the plan of what to index."""

from __future__ import annotations

import json
import os
import shlex
import subprocess
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft import model
from sparkweft.sources.facts import canonical

ENTRY = "file string, source string, directory string, command string, arguments array<string>"


def find(root: str, given: str | None = None) -> str | None:
    """The database: a given file or folder, else the first of the conventional folders that has one."""
    name = "compile_commands.json"
    places = [given, os.path.join(given, name)] if given else [os.path.join(root, d, name) for d in model.DATABASE_FOLDERS]
    return next((p for p in places if os.path.isfile(p)), None)


@dataclass
class Database:
    """Where a project's compiler arguments come from. source: explicit, discovered or none; files: path, header."""

    path: str | None
    source: str
    detail: str
    files: DataFrame | None = None
    header_builders: int = 0


def _parted(commands: pd.Series) -> pd.Series:
    def words(command: str | None) -> list[str] | None:
        if command is None:
            return None
        try:
            return shlex.split(command)
        except ValueError:
            return command.split()

    return commands.map(words)


def arguments() -> Column:
    """An entry's arguments: the list, or the command parted as a shell parts it."""
    return F.coalesce("arguments", F.pandas_udf(_parted, "array<string>")("command"))


def includes_header(argv: Column) -> Column:
    """The precompiled header that the arguments include, in either spelling; null without one."""
    plain = F.filter(argv, lambda a: a != "-Xclang")
    at = F.array_position(plain, "-include-pch")
    return F.when(at > 0, F.try_element_at(plain, (at + 1).cast("int")))


def builds_header(argv: Column) -> Column:
    return F.coalesce(F.array_contains(argv, "-emit-pch"), F.lit(False))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """path, header, builds: the first entry of every source file that a database lists, under one normal path."""
    rows = spark.read.schema(ENTRY).option("multiLine", True).json(path).withColumn("n", F.monotonically_increasing_id())
    name = F.coalesce(F.nullif("file", F.lit("")), F.nullif("source", F.lit("")))
    folder = F.coalesce(F.nullif("directory", F.lit("")), F.lit(os.path.dirname(os.path.abspath(path))))
    argv = arguments()
    named = rows.where(name.isNotNull()).select(
        canonical(name, folder).alias("path"), F.coalesce(includes_header(argv), F.lit("")).alias("header"), builds_header(argv).alias("builds"), "n"
    )
    kept = named.where(F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1).isin(*model.LANGUAGES))
    return kept.groupBy("path").agg(F.min_by(F.struct("header", "builds"), "n").alias("e")).select("path", F.nullif("e.header", F.lit("")).alias("header"), "e.builds")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, header, of the distinct source files of a database, in order; units that build a header are left out."""
    return entries(spark, path).where("not builds").select("path", "header").orderBy("path")


def load(spark: SparkSession, root: str, given: str | None = None) -> Database:
    """The database of a project; one that is missing, unreadable or no array is not found, and ``detail`` says why."""
    path = find(root, given)
    if path is None:
        place = f"at {given}" if given else f"in {root} or its build folders"
        return Database(None, "none", f"no compilation database {place}")
    try:
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).select(F.schema_of_variant("v")).first()
        kind = (whole and whole[0]) or "no JSON"
    except Exception as e:  # whatever keeps a file from being read
        kind = str(e).splitlines()[0]
    if not kind.startswith("ARRAY"):
        return Database(None, "none", f"{path} holds no JSON array of compile commands ({kind})")
    found = entries(spark, path)
    counted = found.agg(F.count_if(~F.col("builds")).alias("files"), F.count_if("builds").alias("builders")).first()
    detail = f"{counted['files']} translation units in {path}" + (f"; {counted['builders']} that build a precompiled header skipped" if counted["builders"] else "")
    return Database(path, "explicit" if given else "discovered", detail, found.where("not builds").select("path", "header").orderBy("path"), counted["builders"])


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path of the source files under a root, hidden and well-known foreign folders skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    inner = F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    folders = F.slice(F.split(inner, "/"), F.lit(1), F.size(F.split(inner, "/")) - 1)
    skipped = F.exists(folders, lambda d: d.startswith(".") | d.isin(*model.SKIPPED_FOLDERS))
    suffix = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    return files.where(~skipped & suffix.isin(*model.LANGUAGES)).orderBy("path")


def plan(files: DataFrame, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Files to index: those that a pattern of ``only`` matches as a glob or ends, in order, at most ``limit``."""
    if only:
        keep = F.lit(False)
        for pattern in only:
            glob = "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c not in "/_" else c) for c in pattern) + "$"
            keep = keep | F.col("path").rlike(glob) | F.col("path").endswith(pattern)
        files = files.where(keep)
    files = files.orderBy("path")
    return files.limit(limit) if limit is not None else files


def present(files: DataFrame) -> DataFrame:
    """Of files (path, ...) those that exist; looked up by the executors, in batches."""

    def run(batches):
        for batch in batches:
            yield batch[batch["path"].map(os.path.isfile)]

    return files.mapInPandas(run, files.schema)


def stamps(files: DataFrame, database_time: str = "") -> DataFrame:
    """files (path, ...) with tu and stamp: SHA-256 over the file's bytes, a NUL and the database's time."""
    from sparkweft.functions import expr

    def run(batches):
        for batch in batches:
            contents = []
            for path in batch["path"]:
                try:
                    with open(path, "rb") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(b"<unreadable>")
            yield batch.assign(content=contents)

    held = files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))
    return held.select(*files.columns, F.col("path").alias("tu"), expr.stamp(F.col("content"), F.lit(database_time)).alias("stamp"))


def _whole(text: str) -> bool:
    """Whether every line is an object and one of them ends the stream."""
    done = False
    for line in text.splitlines():
        if line.strip():
            try:
                record = json.loads(line)
            except ValueError:
                return False
            if not isinstance(record, dict):
                return False
            done = done or record.get("t") == "done"
    return done


def _run(command: list[str], timeout: float) -> tuple[str, str]:
    try:
        done = subprocess.run(command, capture_output=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        return "", f"timed out after {timeout:g} s"
    except OSError as e:
        return "", str(e)
    out = done.stdout.decode("utf-8", "replace")
    last = (done.stderr.decode("utf-8", "replace").strip().splitlines() or [""])[-1]
    return out, "" if not done.returncode or out else last or f"exit status {done.returncode}"


def produce(planned: DataFrame, command: Callable[[str, bool], list[str]], timeout: float = 300.0) -> DataFrame:
    """stream, text, error: the facts of each planned unit (path, header) from an extractor.

    command gives the arguments for a path; a unit whose build names a precompiled header is tried
    once more without it if its facts are missing or cut. A failure that left output is still handed on: its end record tells.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path, header in zip(batch["path"], batch["header"]):
                text, error = _run(command(path, False), timeout)
                if header and (error or not _whole(text)):
                    text, error = _run(command(path, True), timeout)
                rows.append((path, text, error))
            yield pd.DataFrame(rows, columns=["stream", "text", "error"])

    header = F.col("header") if "header" in planned.columns else F.lit(None).cast("string").alias("header")
    return planned.select("path", header).repartition(F.col("path")).mapInPandas(run, "stream string, text string, error string")
