"""Greedy word-piece lengths by a longest-match automaton, linear in the text.

A trie holds the vocabulary as bytes; a piece that starts a word begins with the word mark, other
pieces continue one. Every node has a failure link: where matching stands once the pieces that
greedy matching would have popped from the node's text are gone, with their number. Counting adds
those numbers and never builds a piece.

Defined cases: a null or blank text has 0 words and 0 tokens; ids pass through, null or repeated;
a word that the vocabulary cannot spell counts as one unknown token, as greedy matching has it;
an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import ship

CACHED = 200_000


def byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that start a word, without the mark; pieces that continue one) of a byte-level vocabulary file."""
    letters = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    added = {t["content"] for t in found.get("added_tokens", ())}
    pieces = [bytes(letters[c] for c in t) for t in found["model"]["vocab"] if t not in added and all(c in letters for c in t)]
    # a lone mark is the empty start: it stands for itself when the word has no longer one
    return [p[1:] for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


class Automaton:
    """Nodes 0 (a word's start) and 1 (inside a word) are the roots; ``fail`` -1 means no way on."""

    def __init__(self, starts: list[bytes], continues: list[bytes]):
        self.next: dict[int, int] = {}
        self.fail, self.popped = [-1, -1], [0, 0]
        ends, parent = [False, True], [(-1, 0), (-1, 0)]
        for root, pieces in ((0, starts), (1, continues)):
            for piece in pieces:
                at = root
                for b in piece:
                    to = self.next.get(at << 8 | b)
                    if to is None:
                        to = self.next[at << 8 | b] = len(ends)
                        ends.append(False)
                        parent.append((at, b))
                        self.fail.append(-1)
                        self.popped.append(0)
                    at = to
                ends[at] = True
        if ends[0]:  # the mark is a piece by itself
            self.fail[0], self.popped[0] = 1, 1
        depth = [0, 0]
        for v in range(2, len(ends)):
            depth.append(depth[parent[v][0]] + 1)
        # in order of depth, so that a link's own target is ready
        for v in sorted(range(2, len(ends)), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            up, b = parent[v]
            at, n = self.fail[up], self.popped[up]
            while at >= 0 and (to := self.next.get(at << 8 | b)) is None:
                n += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[v], self.popped[v] = to, n

    def count(self, word: bytes) -> int:
        at, n, step, fail, popped = 0, 0, self.next.get, self.fail, self.popped
        for b in word:
            while (to := step(at << 8 | b)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


class Counter:
    """Counts whole texts; the counts of a bounded number of words are kept."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.kept = automaton, {}

    def __call__(self, text: str | None) -> tuple[int, int]:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        counts = list(map(self.kept.get, words))
        if None in counts:
            one, kept = self.automaton.count, self.kept
            for i, c in enumerate(counts):
                if c is None:
                    counts[i] = c = one(words[i])
                    if len(kept) < CACHED:
                        kept[words[i]] = c
        return len(words), sum(counts)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Automaton(*read_vocabulary(path)))
    return _COUNTERS[path]


def _counted(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            found = list(zip(*(count(x.as_py()) for x in batch.column(1)))) or [[]] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in found)], schema=schema)

    return run


def count_tokens(documents: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    ship(documents.sparkSession)
    read = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    arrow = pa.schema([("doc_id", pa.string() if kind == "string" else pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
    return read.mapInArrow(_counted(vocabulary_path, arrow), f"doc_id {kind}, n_words long, n_tokens long")
