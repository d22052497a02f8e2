"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source s with n_s of N documents and weight w_s gets the mean repetition rate w_s * N / n_s.
Each document inverts the Poisson distribution of its source's rate at a uniform number hashed
from the seed and the row, is emitted that many times, and every copy gets a hashed key by which
all copies are shuffled globally: ``mix_key`` deals them to partitions and orders them there.

A row is hashed over all of its columns, so rows that share an id, or have none, draw apart. Rows
that are equal in every column are told apart by number: they are folded into one row with a
count before they are exchanged, and draw once for each number.

Defined cases: a null source is a source of its own; null ids, repeated ids and repeated rows draw
each for itself; a null or absent weight is none, and with no weight at all nothing is emitted; a
negative or non-finite weight is an error; an empty table gives no rows; columns named like the
added ones (copy_no, mix_key) are replaced, all other names are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import durable

#: Rates above this are drawn as sums of so many equal Poisson parts, so that exp(-rate) stays exact enough.
PART = 200.0
#: Rows of a small side that are broadcast, counted before: rates (48 bytes and a distribution each) and keys of equal rows.
BROADCAST_SOURCES, BROADCAST_KEYS = 2_000, 100_000
#: Parts of every source in a join that is not broadcast, so that a common source does not meet in one task.
SALTS = 64
#: Equal rows are unfolded in two steps of so many.
RUN = 1_000


def hashed(*parts: Column) -> Column:
    """52 bits of an MD5 over the parts' text, as a long that SQL engines agree on."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def row_key(columns: list[Column]) -> Column:
    """MD5 of the MD5s of all columns as text; a null counts as '-'."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.md5(c.cast("string")), F.lit("-")) for c in columns)))


def rates(sizes: DataFrame, temperature: float, weights: DataFrame | None) -> DataFrame:
    """source, rate from sizes (source, n): from given weights (source, weight), or else in proportion to n ** temperature."""
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
        sound = (weight >= 0) & (weight < float("inf"))
        given = weights.select(F.col("source").alias("s"), F.when(sound, weight).otherwise(F.raise_error(F.lit("weights must be finite and not negative")).cast("double")).alias("w"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = sizes.agg(F.sum("n").alias("every"), F.sum("w").alias("weights"))
    rate = F.when(F.col("weights") > 0, F.col("w") / F.col("weights") * F.col("every") / F.col("n")).otherwise(0.0)
    # one row of totals against one row a source
    return sizes.join(F.broadcast(total), F.lit(True)).select("source", F.round(rate, 9).alias("rate"))


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities, up to where doubles no longer tell them from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), first, step)["c"]


def _numbered(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """keyed (row, source, key) with number: 1, and up to n for the rows of the keys (key, n) that repeat."""
    found = repeated.count()
    if not found:
        return keyed.withColumn("number", F.lit(1).cast("long"))
    marks = repeated.select(F.col("key").alias("k"), "n")
    # a key and a count a row; where they are too many to broadcast, each key is on that side once, so common keys can be split
    marked = keyed.join(F.broadcast(marks) if found <= BROADCAST_KEYS else marks, F.col("key") == F.col("k"), "left").drop("k")
    once = marked.where("n is null").select("row", "source", "key", F.lit(1).cast("long").alias("number"))
    folded = marked.where("n is not null").groupBy("key").agg(*(F.any_value(c).alias(c) for c in ("row", "source", "n")))
    runs = folded.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN).cast("long")))).repartition("key", "from")
    number = F.sequence(F.col("from"), F.least("n", F.col("from") + (RUN - 1)))
    return once.unionByName(runs.select("row", "source", "key", F.explode(number).alias("number")))


def mix(
    documents: DataFrame,
    *,
    source_col: str = "source",
    temperature: float = 0.5,
    weights: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """The documents' columns, then copy_no (from 1 for each row) and mix_key; rows come in shuffled order."""
    names = [c for c in documents.columns if c not in ("copy_no", "mix_key")]
    columns = [F.col(f"`{c}`") for c in names]
    keyed = documents.select(F.struct(*columns).alias("row"), F.col(f"`{source_col}`").alias("source"), row_key(columns).alias("key"))
    # one pass over the texts counts sources and finds equal rows; a common source is spread by the rows' keys
    seen = durable(keyed.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")))
    rate = rates(seen.groupBy("source").agg(F.sum("n").alias("n")), temperature, weights)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    rate = rate.select(F.col("source").alias("s"), parts.alias("parts"), distribution(F.col("rate") / parts).alias("cdf"))
    rows = _numbered(keyed, seen.where("n > 1").select("key", "n"))
    same = F.col("source").eqNullSafe(F.col("s"))
    # the size is checked before the hint: at most this many rows, each of bounded length
    if len(rate.select("parts").limit(BROADCAST_SOURCES + 1).collect()) <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rate), same)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("key", "number"), F.lit(SALTS)))
        rate = rate.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.join(rate, same & (F.col("salt") == F.col("t")))
    uniform = lambda j: hashed(F.lit(seed), F.col("key"), F.col("number"), j) / F.lit(float(1 << 52))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), uniform)
    times = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c <= u)))
    copies = joined.select("row", "key", "number", times.cast("long").alias("times")).where("times > 0")
    copies = copies.select("row", "key", "number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy_no"))
    mix_key = hashed(F.lit(seed), F.lit("order"), F.col("key"), F.col("number"), F.col("copy_no"))
    shuffled = copies.select("row", "copy_no", mix_key.alias("mix_key")).repartition("mix_key").sortWithinPartitions("mix_key")
    return shuffled.select("row.*", "copy_no", "mix_key")
