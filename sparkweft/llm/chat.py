"""Collapse of cumulative conversation logs, then rendering, in DataFrame operations only.

A client that logs a conversation after every turn leaves snapshots that prefix one another. The
hash of a conversation's first k turns is the XOR of hashes of (position, role, text), so it
rolls along a conversation; a conversation whose whole hash is the prefix hash of a longer one is
dropped by an anti-join, and of equal conversations the smallest id stays. What is left is rendered in
parts of a bounded number of turns.

Conversations are handled in blocks of turns, so a conversation with a large share of all rows
spreads over tasks; a block in which turns repeat, or have no number, is split again by turn, role
and the text's hash. Two independent 64-bit hashes are used together.

Defined cases: turns are ordered by turn, role, then the MD5 of the text, nulls first in each, and
repeated turns are kept (equal turns of one conversation share a task); a null role renders as
"unknown" and a null text as an empty one, both unlike the words themselves for matching; rows of a
null conv_id are one conversation, the last in order; an empty table gives no rows; only the four
named columns are read. A part holds 64 turns by position, whatever their numbers. A turn-delimiter
inside a text is broken by a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm.common import durable

#: Numbers of turns that one block covers, rows above which a block is split again, and turns of a rendered part.
BLOCK, CROWDED, PART = 256, 1024, 64
#: Crowded blocks that are broadcast, counted before.
BROADCAST_BLOCKS = 100_000
#: Fixed values of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

_HASHES, _EACH = ("h1", "h2"), ("e1", "e2")
#: A conversation's key without nulls, its blocks, and their pieces in order.
_CONV, _BLOCK = ("id", "none"), ("id", "none", "block")
_KEY = (*_BLOCK, "of_turn", "of_role", "of_tie")
_FIRST = -(1 << 62)


def _keyed(conversations: DataFrame) -> DataFrame:
    id_type = conversations.schema["conv_id"].dataType
    empty = F.lit("" if id_type.simpleString() == "string" else 0).cast(id_type)
    shown = [F.col("role").isNull(), F.col("text").isNull(), F.col("role"), F.col("text")]
    turns = conversations.select(
        F.coalesce("conv_id", empty).alias("id"), F.col("conv_id").isNull().alias("none"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(_FIRST)).alias("block"),
        "conv_id", "turn", "role", "text", F.md5("text").alias("tie"), F.xxhash64(*shown).alias("e1"), F.xxhash64(F.lit("second"), *shown).alias("e2"),
    )
    counted = turns.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
    # hexadecimal digits that leave about a block's rows in a piece
    digits = F.least(F.ceil(F.log(16.0, F.col("n") / BLOCK)), F.lit(32)).cast("int")
    crowded = durable(counted.select(*_BLOCK, digits.alias("digits")))
    found = crowded.count()
    if not found:
        return turns.withColumns({"of_turn": F.lit(_FIRST), "of_role": F.lit(""), "of_tie": F.lit("")})
    marked = turns.join(F.broadcast(crowded) if found <= BROADCAST_BLOCKS else crowded, list(_BLOCK), "left")
    split = F.col("digits").isNotNull()
    return marked.withColumns({
        "of_turn": F.when(split & F.col("turn").isNotNull(), F.col("turn").cast("long")).otherwise(_FIRST),
        "of_role": F.when(split, F.coalesce(F.concat(F.lit("+"), "role"), F.lit(""))).otherwise(""),
        "of_tie": F.when(split, F.coalesce(F.substring("tie", F.lit(1), F.col("digits")), F.lit(""))).otherwise(""),
    }).drop("digits")


def _within() -> Window:
    return Window.partitionBy(*_KEY).orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "tie")))


def _before() -> Window:
    return Window.partitionBy(*_CONV).orderBy(*_KEY[2:]).rowsBetween(Window.unboundedPreceding, -1)


def _blocks(turns: DataFrame) -> DataFrame:
    """A row for each piece of a conversation: the turns before it, and the conversation's turns."""
    counted = turns.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*_KEY, F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*_CONV)).alias("n_turns"))


def _placed(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every turn, without its text, with its position from 1 and the hashes of the conversation up to it."""
    slim = turns.select(*_KEY, "conv_id", "turn", "role", "tie", *_EACH).withColumn("rn", F.row_number().over(_within()))
    placed = slim.join(blocks, list(_KEY)).withColumn("pos", F.col("rn") + F.col("before"))
    placed = placed.withColumns({e: F.xxhash64("pos", e) for e in _EACH})
    rolling = Window.partitionBy(*_KEY).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(*_KEY).agg(*(F.bit_xor(e).alias(e) for e in _EACH))
    carried = totals.select(*_KEY, *(F.coalesce(F.bit_xor(e).over(_before()), F.lit(0)).alias(f"{e}_before") for e in _EACH))
    rolled = placed.withColumns({h: F.bit_xor(e).over(rolling) for h, e in zip(_HASHES, _EACH)}).drop(*_EACH)
    hashes = [F.col(h).bitwiseXOR(F.col(f"{e}_before")).alias(h) for h, e in zip(_HASHES, _EACH)]
    return rolled.join(carried, list(_KEY)).select("conv_id", "pos", "n_turns", *hashes)


def _broken(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one begins with; equal ones are folded first."""
    whole = placed.where("pos = n_turns").groupBy("n_turns", *_HASHES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = placed.where("pos < n_turns").select(F.col("pos").alias("n_turns"), *_HASHES).distinct()
    return whole.join(inner, ["n_turns", *_HASHES], "left_anti").select("conv_id", "n_turns", "n_copies")


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """One row a part of a maximal conversation: conv_id, part, n_turns, n_copies, rendered."""
    turns = _keyed(conversations)
    blocks = _blocks(turns)
    kept = maximal(_placed(turns, blocks))
    id_type = conversations.schema["conv_id"].dataType
    empty = F.lit("" if id_type.simpleString() == "string" else 0).cast(id_type)
    kept = kept.select(F.coalesce("conv_id", empty).alias("id"), F.col("conv_id").isNull().alias("none"), "n_turns", "n_copies")
    shown = blocks.drop("n_turns").join(kept, list(_CONV))
    piece = F.concat(F.lit(OPEN), _broken(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), _broken(F.coalesce("text", F.lit(""))), F.lit(CLOSE + "\n"))
    found = turns.join(shown, list(_KEY)).withColumn("pos", F.row_number().over(_within()) + F.col("before"))
    found = found.select(*_CONV, "conv_id", "n_turns", "n_copies", "pos", piece.alias("piece"), F.floor((F.col("pos") - 1) / PART).alias("part"))
    parts = found.groupBy(*_CONV, "conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("turns"))
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("turns.piece"), "").alias("rendered"))
