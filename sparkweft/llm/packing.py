"""Bounded-space online packing of tokenised documents into fixed-size sequences.

Every input partition is tokenised and packed in one pass: a fixed number of windows is open, a
document's remainder goes to the open window that it fills best, and when none has room the
fullest window takes as much of it as fits and is emitted. What is still open at the end of a partition is a leftover;
leftovers of 64 partitions at a time are packed once more, by metadata alone.

Defined cases: a null text packs as an empty one (its end token only); a null id stays null;
repeated rows are packed each for itself; an empty table gives no rows; only the id and text
columns are read, so further columns cannot clash. The input must yield the same rows in the same order when a
task is run again (a file scan or a checkpoint does).
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import durable, ship

CONTEXT, OPEN, END_ID = 2048, 32, 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: The least gap worth cutting a document for; smaller gaps are padded.
LEAST_CUT = 16
#: Partitions whose leftovers are packed together.
TOGETHER = 64
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class PieceEncoder:
    """Byte-level BPE ids as little-endian uint32 bytes.

    The rank file holds the vocabulary and merges of the JSON file beside it, whose only added token is
    ``<|endoftext|>``; ids are the same and come several times faster. A text on which the encoder of
    the rank file panics (its regex gives up on about a million white-space characters in a row) is encoded by the JSON file.
    """

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._fast, self._json, self._whole = own.encode_ordinary, ranks_path.removesuffix(".tiktoken") + ".json", None

    def _ids(self, text: str) -> list[int]:
        try:
            return self._fast(text)
        except BaseException as e:  # a panic is not an Exception, and its class cannot be imported
            if type(e).__name__ != "PanicException":
                raise
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._json)
        return self._whole.encode(text, add_special_tokens=False).ids

    def _part(self, text: str) -> bytes:
        ids = array("I", self._ids(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return SPECIAL_ID.to_bytes(4, "little").join(map(self._part, text.split(SPECIAL)))
        return self._part(text)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(ranks_path: str) -> PieceEncoder:
    if ranks_path not in _ENCODERS:
        _ENCODERS[ranks_path] = PieceEncoder(ranks_path)
    return _ENCODERS[ranks_path]


class OpenWindows:
    """A bounded set of open windows; ``add`` places one remainder and returns the windows it closes."""

    def __init__(self, context: int, bound: int):
        self.context, self.bound, self.made = context, bound, 0
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}

    def _put(self, at: int, piece: tuple, length: int) -> list[list[tuple]]:
        room, window = self.free.pop(at)
        self.held[window].append((*piece, length))
        if room == length:
            return [self.held.pop(window)]
        insort(self.free, (room - length, window))
        return []

    def add(self, piece: tuple, length: int, cut: Callable[[tuple, int], tuple[tuple, tuple]]) -> list[list[tuple]]:
        closed = []
        at = bisect_left(self.free, (length, -1))
        if at == len(self.free):
            if len(self.free) >= self.bound:
                room, window = self.free[0]
                if room >= LEAST_CUT:
                    first, piece = cut(piece, room)
                    closed += self._put(0, first, room)
                    return closed + self.add(piece, length - room, cut)
                self.free.pop(0)
                closed.append(self.held.pop(window))
            self.made += 1
            self.held[self.made] = []
            insort(self.free, (self.context, self.made))
            at = bisect_left(self.free, (length, -1))
        return closed + self._put(at, piece, length)


def _rows(window: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total, length in window:
        yield doc, start, length, zlib.crc32(ids), total, sequence, offset
        offset += length


def _pack_partition(ranks_path: str, context: int, bound: int, end: bytes, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = encoder(ranks_path), OpenWindows(context, bound)
        base, made, out = TaskContext.get().partitionId() << 32, 0, []

        def cut(piece: tuple, length: int) -> tuple[tuple, tuple]:
            doc, start, ids, total = piece
            return (doc, start, ids[: 4 * length], total), (doc, start + length, ids[4 * length :], total)

        def close(window: list[tuple], leftover: bool = False) -> None:
            nonlocal made
            out.extend((*r, leftover) for r in _rows(window, base + made))
            made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(schema)
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                piece = (doc, 0, ids, total)
                for _ in range(total // context):
                    full, piece = cut(piece, context)
                    close([(*full, context)])
                if rest := total % context:
                    for window in windows.add(piece, rest, cut):
                        close(window)
                if len(out) > 20_000:
                    yield flush()
        for window in windows.held.values():
            close(window, True)
        yield flush()

    return run


def _merge(context: int, columns: list[str]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        windows, out = OpenWindows(context, len(rows) + 1), []
        closed = []
        for i, length in enumerate(rows["length"].tolist()):
            closed += windows.add((i,), length, None)
        closed += windows.held.values()
        sequence, offset = [0] * len(rows), [0] * len(rows)
        for n, window in enumerate(closed):
            at = 0
            for i, length in window:
                sequence[i], offset[i] = (1 << 62) + (int(key[0]) << 32) + n, at
                at += length
        return rows.assign(sequence_id=sequence, offset=offset)[columns]

    return run


def pack(
    documents: DataFrame,
    ranks_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    context: int = CONTEXT,
    open_windows: int = OPEN,
    end_id: int = END_ID,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The vocabulary's JSON file stands beside the rank file, under the same name.
    """
    spark = documents.sparkSession
    ship(spark)
    kept = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = SCHEMA.format(id=kept.schema["doc_id"].dataType.simpleString())
    arrow = pa.schema([
        ("doc_id", pa.string() if "string" in schema else pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("leftover", pa.bool_()),
    ])
    columns = arrow.names[:-1]
    end = end_id.to_bytes(4, "little")
    pieces = durable(kept.mapInArrow(_pack_partition(ranks_path, context, open_windows, end, arrow), schema + ", leftover boolean"))
    bucket = F.shiftright("sequence_id", 32).cast("long")
    left = pieces.where("leftover").withColumn("bucket", F.floor(bucket / TOGETHER))
    merged = left.groupBy("bucket").applyInPandas(_merge(context, columns), schema)
    return pieces.where("not leftover").select(columns).unionByName(merged)
