"""Line ranges and symbol spans: overlap joins, innermost containers, collapsing, changed symbols."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft import model
from sparkweft.functions import expr
from sparkweft.session import durable

#: Lines of a bucket of the overlap join: a span and a range meet in the buckets that both touch.
BUCKET = 32
#: Ids of one place that travel as one list.
LIST = 4096
#: Ranges, and spans, of a cell of a bucket: a task is given about so many times so many pairs.
SIDE = 11_585


def spans(symbols: DataFrame) -> DataFrame:
    """Rows file_id, start, end for each place of a symbol: its definition, and its declaration if elsewhere.

    end_line is the definition's wherever there is one.
    """
    declared = F.when(F.col("def_file_id").isNull(), F.coalesce("end_line", "line")).otherwise(F.col("line"))
    places = F.array(
        F.struct(F.col("def_file_id").alias("file_id"), F.col("def_line").alias("start"), F.coalesce("end_line", "def_line").alias("end"), F.lit(0).alias("o")),
        F.struct(F.col("file_id"), F.col("line").alias("start"), declared.alias("end"), F.lit(1).alias("o")),
    )
    rest = [c for c in symbols.columns if c not in ("file_id", "line", "def_file_id", "def_line", "end_line")]
    return symbols.select(*rest, F.inline(places)).where("file_id is not null and start is not null and end >= start").drop("o")


def overlaps(ranges: DataFrame, found: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Equal file_id, overlapping lines. ranges: range_id, file_id, start, end; found: file_id, start, end, ....

    Both sides are dealt by (file, bucket of lines), so a file with very many spans spreads over
    tasks; a pair that meets in several buckets is kept in the first.
    """
    buckets = lambda: F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("__b")
    left = ranges.where("start <= end").select(*(F.col(c).alias(c if c in ("range_id", "file_id") else f"r_{c}") for c in ranges.columns), buckets())
    right = found.select("*", buckets())
    met = left.join(right, ["file_id", "__b"]).where((F.col("r_start") <= F.col("end")) & (F.col("r_end") >= F.col("start")))
    first = F.greatest(F.floor(F.col("r_start") / bucket), F.floor(F.col("start") / bucket))
    return met.where(F.col("__b") == first).drop("__b")


def _listed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """file_id, start, end, ids (structs of the key): the rows of a place as lists of about `most`, null keys and repeats included."""
    place = ["file_id", "start", "end"]
    rows = rows.select(key, *place)
    # fewer than one in `most` rows, so broadcast
    many = rows.groupBy(*place).count().where(F.col("count") > most).select(*place, F.ceil(F.col("count") / most).alias("__n"))
    part = F.pmod(F.xxhash64(key), F.coalesce("__n", F.lit(1))).alias("__part")
    return rows.join(F.broadcast(many), place, "left").groupBy(*place, part).agg(F.collect_list(F.struct(key)).alias("ids")).drop("__part")


def _pieces(ids: str, key: str, most: int) -> Column:
    """The keys of a list of structs in arrays of at most `most`; lists are longer where one id occurs very often."""
    last = ((F.size(ids) - 1) / most).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.slice(ids, i * most + 1, most), lambda x: x[key]))


def pairs(ranges: DataFrame, found: DataFrame, bucket: int = BUCKET, side: int = SIDE, most: int = LIST) -> DataFrame:
    """range_id, usr of each row of `overlaps`, for results far larger than their inputs.

    Ranges of equal lines meet the same spans, so places are joined and hold their ids as lists. A bucket of more
    than side * side pairs is dealt as a grid of cells, and there are as many tasks as the pairs need, however few bytes
    go in. Pairs leave a list of ranges at a time: a symbol is a run and the ranges repeat, which columnar files store in a
    fraction of a byte a row.
    """
    spark = ranges.sparkSession
    buckets = lambda: F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("__b")
    asked = ranges.where("file_id is not null and start <= end")
    held = found.where("file_id is not null and start <= end")
    count = lambda df, c: df.select("file_id", buckets()).groupBy("file_id", "__b").agg(F.count("*").alias(c))
    loads = durable(count(asked, "__l").join(count(held, "__h"), ["file_id", "__b"]))
    load = F.col("__l").cast("double") * F.col("__h")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil((loads.agg(F.sum(load)).first()[0] or 0) / side**2))
    # fewer than there are tasks
    grid = loads.where(load > side**2).select("file_id", "__b", F.ceil(F.col("__l") / side).alias("__rows"), F.ceil(F.col("__h") / side).alias("__columns"))

    def dealt(rows: DataFrame, key: str, own: str, other: str, prefix: str) -> DataFrame:
        named = _listed(rows, key, most).select("file_id", F.col("start").alias(f"{prefix}start"), F.col("end").alias(f"{prefix}end"), F.col("ids").alias(f"{prefix}ids"), buckets())
        mine = F.pmod(F.xxhash64(f"{prefix}ids"), F.coalesce(own, F.lit(1)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
        placed = named.join(F.broadcast(grid), ["file_id", "__b"], "left").select(*named.columns, mine.alias(f"{own}_at"), every.alias(f"{other}_at"))
        return placed.repartition(tasks, *cell)

    cell = ["file_id", "__b", "__rows_at", "__columns_at"]
    left, right = dealt(asked, "range_id", "__rows", "__columns", "r_"), dealt(held, "usr", "__columns", "__rows", "s_")
    first = F.greatest(F.floor(F.col("r_start") / bucket), F.floor(F.col("s_start") / bucket))
    met = left.join(right, cell).where((F.col("r_start") <= F.col("s_end")) & (F.col("r_end") >= F.col("s_start")) & (F.col("__b") == first))
    # over a lambda's result a generator hands rows on one by one; over a plain column it is generated code, several times as fast, but
    # gathers all rows of its list first: pieces are short
    each = F.explode(F.transform("s_ids", lambda x: x["usr"])).alias("usr")
    return met.select(F.explode(_pieces("r_ids", "range_id", most)).alias("r_ids"), "s_ids").select("r_ids", each).select(F.explode("r_ids").alias("range_id"), "usr")


def innermost(ranges: DataFrame, found: DataFrame, containers: tuple[str, ...] = model.RANGE_CONTAINERS) -> DataFrame:
    """For each range the smallest container over it, else the first symbol on its lines.

    Adds is_container; ranges that meet nothing are not in the result.
    """
    inside = F.coalesce(F.col("kind").isin(*containers), F.lit(False)).alias("is_container")
    # which of two symbols counts does not depend on the range, so one number tells; checkpointed, so the numbers hold
    first = F.when(F.col("is_container"), F.col("end") - F.col("start")).otherwise(F.col("start"))
    order = [F.desc("is_container"), first, F.when(~F.col("is_container"), F.col("end")), "kind", "name", "usr", "start"]
    numbered = durable(found.select("*", inside).orderBy(*order).withColumn("__n", F.monotonically_increasing_id()))
    hits = overlaps(ranges.select("range_id", "file_id", "start", "end"), numbered.select("__n", "file_id", "start", "end"))
    # the least number is a partial aggregate, hashed: hits are neither sorted nor exchanged
    best = hits.groupBy("range_id").agg(F.min("__n").alias("__n"))
    asked = ranges.select("range_id", *(F.col(c).alias(f"r_{c}") for c in ranges.columns if c not in ("range_id", "file_id")))
    return best.join(numbered, "__n").join(asked, "range_id").drop("__n")


def unattributed(ranges: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, lines: changed lines of ranges that no symbol stands on."""
    hit = overlaps(ranges, found).select("range_id").distinct()
    return ranges.join(hit, "range_id", "left_anti").groupBy("file_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("lines"))


def islands(ranges: DataFrame, key: str) -> DataFrame:
    """key, start, end of ranges joined where they overlap or touch."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.select(key, "start", "end").withColumn("__new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    numbered = flagged.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def collapse(ranges: DataFrame, key: str) -> DataFrame:
    """key, lines: islands as text such as '12-15, 31'."""
    text = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    parts = islands(ranges, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", text.alias("text")))).alias("__parts"))
    return parts.select(key, F.array_join(F.col("__parts.text"), ", ").alias("lines"))


def changed_symbols(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """usr, symbol, signature, lines, seq: what the ranges touch, by name and signature, in the order of first touch."""
    hit = innermost(ranges, spans(symbols)).withColumn("symbol", expr.display())
    key = F.concat(F.col("symbol"), F.coalesce("signature", F.lit("")))
    keyed = hit.withColumn("key", key).select("key", "usr", "symbol", "signature", "range_id", F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    heads = keyed.groupBy("key").agg(F.min_by(F.struct("usr", "symbol", "signature"), "range_id").alias("h"), F.min("range_id").alias("seq"))
    return heads.join(collapse(keyed, "key"), "key").select("h.usr", "h.symbol", "h.signature", "lines", "seq")


def region(first: Column, last: Column, total: Column, context: int = 20, most: int = 200) -> tuple[Column, Column]:
    """(start, end) of the lines to show for a span: padded by the context, within the file, most lines in all."""
    span = last - first + 1
    pad = F.least(F.lit(context), F.lit(most) - span)
    whole = span >= most
    return F.when(whole, first).otherwise(F.greatest(F.lit(1), first - pad)), F.when(whole, first + most - 1).otherwise(F.least(total, last + pad))


def source_context(wanted: DataFrame, sources: DataFrame, context: int = 20, most: int = 200) -> DataFrame:
    """wanted: usr, path, first, last; sources: path, text. usr, path, start, end, truncated, error, source ('n: line')."""
    lines = F.split(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n$", ""), "\n", -1)
    held = wanted.join(sources.select("path", lines.alias("__lines")), "path", "left").withColumn("__total", F.size("__lines"))
    first, last = F.greatest(F.lit(1), F.col("first")), F.greatest(F.lit(1), F.col("last"))
    start, end = region(first, last, F.col("__total"), context, most)
    error = F.when(F.col("__lines").isNull(), F.concat(F.lit("cannot read "), F.col("path"))).when(
        last > F.col("__total"), F.concat_ws(" ", F.col("path"), F.lit("has"), F.col("__total").cast("string"), F.lit("lines; the index is older"))
    )
    shown = F.transform(F.sequence(F.col("start"), F.col("end")), lambda n: F.concat_ws(": ", n.cast("string"), F.element_at("__lines", n)))
    ready = held.withColumns({"start": start.cast("int"), "end": end.cast("int"), "error": error, "truncated": last - first + 1 >= most})
    return ready.select(
        "usr", "path", "start", "end", "truncated", "error", F.when(F.col("error").isNull() & (F.col("start") <= F.col("end")), F.array_join(shown, "\n")).alias("source")
    )
