"""Fact streams: JSON lines, one stream a file, accepted whole or not at all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweft import model


@dataclass
class Facts:
    """What accepted streams hold; every row carries its unit, files are paths."""

    units: DataFrame
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    includes: DataFrame
    diagnostics: DataFrame


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """stream, seq, line: the lines of every file under a path, in order; bytes that are no UTF-8 become U+FFFD.

    Files are read in splits, so a stream of any size spreads over tasks; seq orders a stream's lines.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    seq = F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    line = F.regexp_replace(F.make_valid_utf8("value"), "\r$", "")
    return rows.select(F.col("_metadata.file_path").alias("stream"), seq.alias("seq"), line.alias("line"))


def from_texts(streams: DataFrame) -> DataFrame:
    """stream, seq, line of streams (stream, text)."""
    return streams.select("stream", F.posexplode(F.split("text", "\r?\n")).alias("seq", "line"))


def parse(lines: DataFrame) -> DataFrame:
    """One row a record with the wire's keys; ``ok`` is false for a line that is not a JSON object. Blank lines go.

    A line is parsed once, to a variant, whose keys tell case.
    """
    kept = lines.where(F.trim("line") != "").select("stream", "seq", "line", F.try_parse_json("line").alias("record"))
    wire = [f for f in model.FACT.fields if f.name != "F"]
    field = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind)
    whole = F.trim("line").startswith("{") & F.col("record").isNotNull()
    return kept.select("stream", "seq", F.coalesce(whole, F.lit(False)).alias("ok"), *(field(f.name, f.dataType.simpleString()).alias(f"j_{f.name}") for f in wire), field("F", "string").alias("j_flags"))


def verdicts(records: DataFrame) -> DataFrame:
    """stream, accepted, reason: a stream without its end record, or with a malformed line, is rejected.

    The reason of a cut stream quotes its first fatal diagnostic that has a message, else its first error.
    """
    said = F.when((F.col("j_t") == "diag") & F.col("j_sev").isin("fatal", "error") & (F.coalesce("j_m", F.lit("")) != ""), F.struct((F.col("j_sev") != "fatal").alias("later"), "seq"))
    found = records.groupBy("stream").agg(
        F.bool_or(F.coalesce(F.col("j_t") == "done", F.lit(False))).alias("__done"), F.count_if(~F.col("ok")).alias("__bad"), F.min_by("j_m", said).alias("__said")
    )
    reason = (
        F.when(F.col("__bad") > 0, F.concat(F.lit("malformed line in "), F.col("stream")))
        .when(~F.col("__done"), F.concat_ws(": ", F.concat(F.lit("no end record in "), F.col("stream")), F.col("__said")))
    )
    return found.select("stream", reason.isNull().alias("accepted"), reason.alias("reason"))


def remap(facts: DataFrame, local_files: DataFrame, columns: dict[str, str], required: bool = False) -> DataFrame:
    """Replace ids that are local to a stream by paths. columns: id column to path column; unknown ids become null, or drop the row if required."""
    out = facts
    for local, path in columns.items():
        names = local_files.select(F.col("stream").alias("__s"), F.col("local").alias("__l"), F.col("path").alias(path))
        out = out.join(names, (F.col("stream") == F.col("__s")) & (F.col(local) == F.col("__l")), "inner" if required else "left").drop("__s", "__l", local)
    return out


def canonical(path: Column, root: str | Column) -> Column:
    """An absolute path with . and .. and doubled slashes resolved, relative ones under the root."""
    root = F.concat(root, F.lit("/")) if isinstance(root, Column) else F.lit(root.rstrip("/") + "/")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(root, path))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def decode(lines: DataFrame, root: str = "/", stamps: DataFrame | None = None) -> tuple[Facts, DataFrame]:
    """(facts of the accepted streams, verdicts of all streams). stamps: stream, stamp of what the streams were made from."""
    records = parse(lines)
    judged = verdicts(records)
    good = records.join(judged.where("accepted").select("stream"), "stream", "left_semi")
    of = lambda kind: good.where(F.col("j_t") == kind)
    local = of("f").groupBy("stream", F.col("j_i").alias("local")).agg(F.min_by(canonical(F.col("j_p"), root), "seq").alias("path"), F.max(F.coalesce("j_sys", F.lit(0))).alias("sys"))
    meta = of("meta").groupBy("stream").agg(
        *(F.max_by("j_v", F.when(F.col("j_k") == k, F.col("seq"))).alias(k) for k in ("tu", "config_source", "config_detail", "degraded", "pch_dropped", "errors", "stats"))
    )
    tu = F.coalesce(canonical(F.col("tu"), root), F.col("stream"))
    units = meta.select(
        "stream", tu.alias("tu"), F.coalesce("config_source", F.lit("")).alias("config_source"), F.coalesce("config_detail", F.lit("")).alias("config_detail"),
        F.col("degraded").isNotNull().alias("degraded"), F.coalesce("pch_dropped", F.lit("")).alias("pch_dropped"),
        F.coalesce(F.get_json_object("errors", "$.errors").try_cast("long"), F.lit(0)).alias("errors"), "stats",
    )
    stamp = F.lit("") if stamps is None else F.coalesce("stamp", F.lit(""))
    if stamps is not None:
        units = units.join(stamps.select("stream", "stamp"), "stream", "left")
    units = units.withColumn("stamp", stamp)
    named = lambda df: df.join(units.select("stream", "tu"), "stream")
    flags = F.when(F.coalesce("j_flags", F.lit("{}")) != "{}", F.col("j_flags"))
    symbols = named(remap(of("sym"), local, {"j_f": "file", "j_df": "def_file"})).select(
        "tu", F.col("j_u").alias("usr"), F.coalesce("j_stub", F.lit(0)).alias("stub"), F.coalesce("j_k", F.lit("unknown")).alias("kind"), F.coalesce("j_n", F.lit("")).alias("name"),
        F.coalesce("j_q", "j_n", F.lit("")).alias("qualified"), F.coalesce("j_s", F.lit("")).alias("signature"), F.coalesce("j_ty", F.lit("")).alias("type_text"), "file",
        F.col("j_l").alias("line"), F.col("j_c").alias("col"), F.col("j_el").alias("end_line"), F.col("j_ec").alias("end_col"), "def_file",
        F.col("j_dl").alias("def_line"), F.col("j_dc").alias("def_col"), F.col("j_p").alias("parent_usr"), flags.alias("flags"),
    )
    edges = named(remap(of("edge"), local, {"j_f": "file"})).select(
        "tu", F.col("j_k").alias("kind"), F.col("j_a").alias("src"), F.col("j_b").alias("dst"), "file", F.col("j_l").alias("line"), F.coalesce("j_w", F.lit(1)).alias("weight"), flags.alias("flags")
    )
    ends = of("inc").withColumn("j_to", F.col("j_b").try_cast("long"))
    includes = named(remap(ends, local, {"j_f": "from_file", "j_to": "to_file"}, required=True)).select(
        "tu", "from_file", "to_file", F.col("j_l").alias("line"), F.coalesce("j_ang", F.lit(0)).alias("angled"), F.coalesce("j_sp", F.lit("")).alias("spelled")
    )
    diags = named(remap(of("diag"), local, {"j_f": "file"})).select(
        "tu", F.coalesce("j_sev", F.lit("note")).alias("severity"), "file", F.col("j_l").alias("line"), F.col("j_c").alias("col"), F.coalesce("j_m", F.lit("")).alias("message")
    )
    inside = F.col("path").startswith(root.rstrip("/") + "/")
    paths = local.groupBy("path").agg(F.max("sys").alias("sys"))
    files = paths.select("path", (F.col("sys") == 1).alias("is_system"), ((F.col("sys") == 0) & inside).alias("in_project"))
    return Facts(units.select([c.split()[0] for c in model.TU.split(", ")]), files, symbols, edges, includes, diags), judged
