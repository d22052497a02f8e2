"""Cross-entropy difference of documents between a target and a background language model.

Both models are word bigrams over one shared vocabulary, all distinct words of target and
background (V of them, counted), and matched in all but their data: the same order and the same
Dirichlet smoothing towards the uniform distribution over the vocabulary,
p(w | v) = (c(v, w) + strength / V) / (c(v) + strength). Every word is in the vocabulary, so no word
stands for unknown ones. The background is all documents, each count in full: nothing is sampled,
pruned, capped or scaled. A document's score is the mean over its words of target loss minus
background loss, in nats; the lower, the closer to the target.

The difference falls into a sum over bigrams and a sum over contexts, so counting and scoring
need one large exchange: tasks send, for every hash bucket of n-grams, the keys of thousands of
documents once each with the documents they occur in; a bucket counts both models from all tasks'
keys and returns partial sums by document. Of an n-gram that many documents of a block hold, the
block sends its count alone and keeps the list of documents beside its ids; the bucket returns
what the n-gram is worth and the block's documents are summed where the block is put together.
So a bucket gets a bounded share of every block, however common an n-gram is, and the number of
buckets follows the bytes of text. N-grams are known by 63 bits of their hash.

Defined cases: a null text or one without words has n_tokens 0 and score 0; null ids and
repeated rows pass through and count each; an empty table gives no rows, an empty target model is uniform; only
the id and text columns are read. The input must yield the same rows in the same order when a
task is run again (a file scan or a checkpoint does).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import ship

STRENGTH = 200.0
#: Documents and bytes that share a block of keys; document numbers in a block take 16 bits.
BLOCK_DOCS, BLOCK_BYTES = 8192, 12 << 20
#: Documents of a block from which on an n-gram's list of them stays with the block.
COMMON = 32
#: Bytes that a block's rows take for each byte of text, about, and bytes that a bucket is sized for.
SENT, BUCKET_BYTES = 1.6, 24 << 20
START = 0x5851F42D4C957F2D
_PARTS = bytes(c + 32 if 65 <= c <= 90 else (32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c) for c in range(256))
_HEAD = "ids array<{id}>, tokens binary, common_per_key binary, common_docs binary, common_counts binary"
_SENT = "bucket int, block long, target boolean, keys binary, per_key binary, docs binary, counts binary, common_keys binary, common_totals binary, common_from long, " + _HEAD
_BACK = "block long, docs binary, sums binary, common_from long, gains binary, " + _HEAD


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PARTS).split()


def ngrams(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every position's context (even) and bigram (odd); hashes hold the words of documents of these sizes."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    with np.errstate(over="ignore"):
        pair = (before * np.uint64(0x9E3779B97F4A7C15)) ^ hashes
        pair = (pair ^ pair >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        pair ^= pair >> np.uint64(29)
    return before & ~np.uint64(1), pair | np.uint64(1)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _block(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of documents as hashes of words: sorted distinct keys, how many (document, count) pairs each has, and those pairs."""
    sizes = np.array([len(t) for t in texts])
    hashes = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint16), sizes)
    context, pair = ngrams(hashes, sizes)
    keys, docs = np.concatenate([context, pair]), np.concatenate([owner, owner])
    del hashes, owner, context, pair
    order = np.argsort(keys, kind="stable")  # owners ascend within a key
    keys, docs = keys[order], docs[order]
    del order
    new_key = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    new_pair = new_key.copy()
    new_pair[1:] |= docs[1:] != docs[:-1]
    at = np.flatnonzero(new_pair)
    counts = np.diff(np.append(at, len(keys))).astype(np.uint32)
    firsts = np.flatnonzero(new_key[at])
    return keys[at][firsts], np.diff(np.append(firsts, len(at))).astype(np.uint32), docs[at], counts


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a task's words, each once a batch at most."""
    for batch in batches:
        words = {w for text in batch.column(0) for w in words_of(text.as_py())}
        yield pa.record_batch([pa.array(hashed(list(words)).view(np.int64), pa.int64())], names=["word"])


def vocabulary_size(texts: DataFrame) -> int:
    """Distinct words of a column of texts, by 64 bits of their hash."""
    return max(1, texts.mapInArrow(_distinct_words, "word bigint").distinct().count())


def _pieces(per_key: np.ndarray) -> np.ndarray:
    """Where each key's pairs begin, and the end."""
    return np.append(0, np.cumsum(per_key, dtype=np.int64))


def _send(buckets: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part = 0, TaskContext.get().partitionId()
        ids: list = []
        texts: list[np.ndarray] = []
        size = 0

        def flush(target: bool) -> pa.RecordBatch:
            nonlocal block, ids, texts, size
            name = (part << 24 | block) << 1 | target
            keys, per_key, docs, counts = _block(texts)
            common = per_key >= COMMON
            of_common = np.repeat(common, per_key)
            c_keys, c_per_key, c_docs, c_counts = keys[common], per_key[common], docs[of_common], counts[of_common]
            c_totals = np.add.reduceat(c_counts, _pieces(c_per_key)[:-1]).astype(np.uint64) if len(c_keys) else np.zeros(0, np.uint64)
            keys, per_key, docs, counts = keys[~common], per_key[~common], docs[~of_common], counts[~of_common]
            cuts = lambda k: np.searchsorted((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
            at, c_at, pairs = cuts(keys), cuts(c_keys), _pieces(per_key)
            rows = []
            for b in np.flatnonzero(np.diff(at) + np.diff(c_at)):
                i, j, k, m = at[b], at[b + 1], c_at[b], c_at[b + 1]
                p, q = pairs[i], pairs[j]
                held = (keys[i:j], per_key[i:j], docs[p:q], counts[p:q], c_keys[k:m], c_totals[k:m])
                rows.append((int(b), name, target, *(x.tobytes() for x in held), int(k), None, None, None, None, None))
            if not target:
                tokens = np.array([len(t) for t in texts], np.int64)
                rows.append((name % buckets, name, False, *[None] * 7, ids, *(x.tobytes() for x in (tokens, c_per_key, c_docs, c_counts))))
            block, ids, texts, size = block + 1, [], [], 0
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

        last = None
        for batch in batches:
            for doc, text, target in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if texts and (target != last or len(texts) >= BLOCK_DOCS or size >= BLOCK_BYTES):
                    yield flush(last)
                last = target
                ids.append(doc)
                texts.append(hashed(words_of(text.as_py())))
                size += len(text.as_py() or "")
        if texts:
            yield flush(last)

    return run


def _arrays(rows: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    """The column's binary values as numbers, without a copy."""
    return [np.frombuffer(x.as_buffer(), kind) for x in rows[column]]


def _score(vocabulary: int, strength: float, schema: pa.Schema):
    """Of a bucket: counts of both models, then each block's partial sums and what its common n-grams are worth."""

    def run(sent: pa.Table) -> pa.Table:
        headed = sent.filter(pc.is_valid(sent["ids"]))
        heads = pa.table([headed[f.name] if f.name in headed.column_names and f.name != "common_from" else pa.nulls(len(headed), f.type) for f in schema], schema=schema)
        rows = sent.filter(pc.is_valid(sent["keys"]))
        if not len(rows):
            return heads
        blocks, targets, starts = (rows[c].to_pylist() for c in ("block", "target", "common_from"))
        keys, per_key, docs, counts = (_arrays(rows, c, k) for c, k in (("keys", np.uint64), ("per_key", np.uint32), ("docs", np.uint16), ("counts", np.uint32)))
        common, totals = _arrays(rows, "common_keys", np.uint64), _arrays(rows, "common_totals", np.uint64)
        distinct, at = np.unique(np.concatenate([*keys, *common]), return_inverse=True)
        places = np.split(at, np.cumsum([len(k) for k in [*keys, *common]])[:-1])
        own, shared = places[: len(keys)], places[len(keys) :]
        total = np.zeros((2, len(distinct)))
        for r, target in enumerate(targets):
            if len(own[r]):
                total[int(target)][own[r]] += np.add.reduceat(counts[r], _pieces(per_key[r])[:-1])
            total[int(target)][shared[r]] += totals[r]
        pair = (distinct & np.uint64(1)).astype(bool)
        base = np.where(pair, strength / vocabulary, strength)
        # of a bigram: log p_background - log p_target; a context's share has the other sign
        gain = np.log((total[0] + base) / (total[1] + base)) * np.where(pair, 1.0, -1.0)
        out = []
        for r in np.flatnonzero(~np.array(targets)):
            sums = np.bincount(docs[r], weights=np.repeat(gain[own[r]], per_key[r]) * counts[r])
            touched = np.unique(docs[r])
            out.append((blocks[r], touched.tobytes(), sums[touched].tobytes(), starts[r], gain[shared[r]].tobytes(), None, None, None, None, None))
        found = pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)
        return pa.concat_tables([heads, found])

    return run


def _gather(schema: pa.Schema):
    def run(back: pa.Table) -> pa.Table:
        head = back.filter(pc.is_valid(back["ids"]))
        rows = back.filter(pc.is_valid(back["docs"]))
        tokens, per_key, docs, counts = (_arrays(head, c, k)[0] for c, k in (("tokens", np.int64), ("common_per_key", np.uint32), ("common_docs", np.uint16), ("common_counts", np.uint32)))
        gains = np.zeros(len(per_key))
        for start, own in zip(rows["common_from"].to_pylist(), _arrays(rows, "gains", np.float64)):
            gains[start : start + len(own)] = own
        sums = np.bincount(docs, weights=np.repeat(gains, per_key) * counts, minlength=len(tokens)).astype(np.float64)
        parts = sorted(zip(_arrays(rows, "docs", np.uint16), _arrays(rows, "sums", np.float64)), key=lambda x: (x[0].tobytes(), x[1].tobytes()))  # an order that runs repeat
        for at, own in parts:
            sums[at] += own
        scores = np.round(sums / np.maximum(tokens, 1), 6)
        ids = head["ids"].combine_chunks().flatten()
        return pa.table([ids, pa.array(tokens), pa.array(scores)], schema=schema)

    return run


def cross_entropy_difference(
    documents: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    vocabulary: int | None = None,
    strength: float = STRENGTH,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """doc_id, n_tokens, score of every whole text; V is counted unless ``vocabulary`` gives it, which saves a pass over the texts."""
    spark = documents.sparkSession
    ship(spark)
    read = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(False).alias("target"))
    kind = "string" if read.schema["doc_id"].dataType.simpleString() == "string" else "bigint"
    aims = target.select(F.lit(None).cast(kind).alias("doc_id"), F.col(target_text_col).alias("text"), F.lit(True).alias("target"))
    both = read.withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(aims)
    size = both.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(math.ceil(size * SENT / bucket_bytes), 1 << 30))
    vocabulary = vocabulary or vocabulary_size(both.select("text"))
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    arrow = lambda text: pa.schema([(n, types[t]) for n, t in (c.split() for c in text.format(id=kind).split(", "))])
    final = pa.schema([("doc_id", pa.string() if kind == "string" else pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
    counted = both.mapInArrow(_send(buckets, arrow(_SENT)), _SENT.format(id=kind)).repartitionById(buckets, F.col("bucket"))
    sums = counted.groupBy("bucket").applyInArrow(_score(vocabulary, strength, arrow(_BACK)), _BACK.format(id=kind))
    return sums.groupBy("block").applyInArrow(_gather(final), f"doc_id {kind}, n_tokens long, score double")
