"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 32 two-bit segments map to their bit counts. The Manhattan distance of such
points is a lower bound of the Hamming distance, so two fingerprints within 3 bits are within 1 in one
half (16 segments) at least: a grid join probes, in each half, the own cell and the cells at
distance 1, and XOR verifies. Of two cells at distance 1 one has an even sum and one an odd sum,
so only points with an odd sum probe.

Only distinct fingerprints are compared; crowded cells are compared block against block, and
tasks emit spanning links, never all pairs.

Defined cases: a text without words (or null) has fingerprint zero and links like any other;
repeated rows share a fingerprint and component; rows with a null id get a fingerprint and the
component's smallest id, null if no row there has one; an empty table gives no rows; only the id and text columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.cells import candidates, forest, spread
from sparkweft.llm.common import durable, join_classes, ship
from sparkweft.llm.components import components

SEED, SHINGLE, BITS = 42, 3, 3
#: Own points of a cell that one task holds.
BLOCK = 4096
#: Fixed value: the low bit of each of the 16 segments of a half.
LOW = 0x55555555


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and the six white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        shingles = [joined[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(width: int, seed: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], dtype=np.uint64)
            columns = [batch.column(0).cast(kind), pa.array(found.view(np.int64), pa.int64()), *batch.columns[2:]]
            yield pa.record_batch(columns, names=["doc_id", "fp", *batch.schema.names[2:]])

    return run


def _half_bits(fp: Column, high: bool) -> Column:
    return (F.shiftrightunsigned(fp, 32) if high else fp).bitwiseAND(F.lit(0xFFFFFFFF))


def _half(fp: Column, high: bool) -> Column:
    """The bit counts of a half's 16 segments, two bits each."""
    bits = _half_bits(fp, high)
    return bits.bitwiseAND(F.lit(LOW)) + F.shiftright(bits, 1).bitwiseAND(F.lit(LOW))


def grid_rows(distinct: DataFrame) -> DataFrame:
    """fp, cell, role: the own cell in both halves, and the cells that an odd point probes."""
    rows = None
    for high in (False, True):
        own = distinct.withColumn("__own", _half(F.col("fp"), high))
        odd = F.pmod(F.bit_count(_half_bits(F.col("fp"), high)), F.lit(2)) == 1
        unit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i * 2)
        value = lambda i: F.call_function("shiftright", F.col("__own"), i * 2).bitwiseAND(F.lit(3))
        ups = F.transform(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: value(i) < 2), lambda i: F.col("__own") + unit(i))
        downs = F.transform(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: value(i) > 0), lambda i: F.col("__own") - unit(i))
        none = F.array().cast("array<bigint>")
        probes = F.when(odd, F.concat(ups, downs)).otherwise(none)
        cells = own.select("fp", F.posexplode(F.concat(F.array("__own"), probes)).alias("__at", "cell"))
        shift = F.col("cell") + (F.lit(1 << 32) if high else F.lit(0))
        part = cells.select("fp", shift.alias("cell"), (F.col("__at") > 0).cast("int").alias("role"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _linked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left, right in candidates(batches, {"fp": lambda c: c.to_numpy()}):
            fp = rows["fp"]
            near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= bits  # of a signed number it counts the absolute value
            if near.any():
                a, b = forest(left[near], right[near], fp)
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_duplicates(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of every document; links are at most 3 bits.

    With carry, then ``component``, which no two components share whatever their ids, and these columns of the document.
    """
    ship(documents.sparkSession)
    read = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry)
    kind = read.schema["doc_id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    kind = "string" if kind == "string" else "bigint"
    hashed = durable(read.mapInArrow(_fingerprints(width, seed, arrow), ", ".join([f"doc_id {kind}, fp bigint", *(f"{c} {read.schema[c].dataType.simpleString()}" for c in carry)])))
    least = durable(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")))
    dealt = spread(grid_rows(least.select("fp")), F.col("fp"), BLOCK)
    links = dealt.mapInArrow(_linked(BITS), "a bigint, b bigint")
    found = components(links)
    labelled = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least_id", "copies", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = labelled.select("fp", "component", "copies").join(smallest, "component").select(F.col("fp").alias("__fp"), "component_id", "component", "copies")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_classes(hashed, classes, "fp", "__fp", "copies").select("doc_id", text.alias("fingerprint"), "component_id", *(["component", *carry] if carry else []))
