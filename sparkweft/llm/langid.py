"""Language identification by a byte convolutional network.

Filters of several widths run over embedded bytes of fixed-length windows; max pooling over a
window and a softmax layer give its languages, and a text's score is the mean over all of its
windows, each weighted by its bytes. The network is trained here, in numpy, on windows of a
bounded sample of labelled texts: at most ``per_language`` texts a language and
``windows_per_text`` windows a text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a table without
learnable rows gives ``und`` for all; repeated rows score alike, and a sampled id that repeats is learned from one of its texts; null ids pass through; an empty
table gives no rows; only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import remainder, rows_with, sampled_ids, ship, texts_of

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: The sample's bounds, documented parameters of the fit.
PER_LANGUAGE, WINDOWS_PER_TEXT = 300, 6
UNDETERMINED = "und"
STEP = WINDOW - max(WIDTHS) + 1


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter of some script; digits, fractions and circled numbers are none."""
    return any(map(str.isalpha, text or ""))


def windows(data: bytes) -> np.ndarray:
    """All windows of a text, each overlapping the last by a filter's width; the last is padded with zeros."""
    n = max(1, -(-(len(data) - WINDOW) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


class ByteNetwork:
    """Embedding, one filter bank a width, max pooling, softmax."""

    def __init__(self, n_classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {"embed": normal(256, EMBED, scale=0.5)}
        for k in WIDTHS:
            self.w[f"filter{k}"] = normal(k * EMBED, FILTERS, scale=(k * EMBED) ** -0.5)
            self.w[f"bias{k}"] = np.zeros(FILTERS, np.float32)
        self.w["out"] = normal(len(WIDTHS) * FILTERS, n_classes, scale=0.2)
        self.w["out_bias"] = np.zeros(n_classes, np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        w, kept = self.w, {}
        e = w["embed"][x]
        pooled = []
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            spread = np.concatenate([e[:, i : i + n] for i in range(k)], axis=2)
            h = spread.reshape(-1, k * EMBED) @ w[f"filter{k}"]
            h = h.reshape(len(x), n, FILTERS)
            at = h.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(h, at[:, None], 1)[:, 0] + w[f"bias{k}"], 0))
            kept[k] = spread, at
        features = np.concatenate(pooled, 1)
        scores = features @ w["out"] + w["out_bias"]
        scores -= scores.max(1, keepdims=True)
        p = np.exp(scores)
        return p / p.sum(1, keepdims=True), kept | {"features": features}

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """As forward, without what only training needs."""
        w, pooled = self.w, []
        e = w["embed"][x]
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            h = sum(e[:, i : i + n] @ w[f"filter{k}"][i * EMBED : (i + 1) * EMBED] for i in range(k))
            pooled.append(np.maximum(h.max(1) + w[f"bias{k}"], 0))
        scores = np.concatenate(pooled, 1) @ w["out"] + w["out_bias"]
        scores -= scores.max(1, keepdims=True)
        p = np.exp(scores)
        return p / p.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, kept = self.forward(x)
        d = p
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        f, w = kept["features"], self.w
        g = {"out": f.T @ d, "out_bias": d.sum(0)}
        df = (d @ w["out"].T) * (f > 0)
        de = np.zeros((*x.shape, EMBED), np.float32)
        rows = np.arange(len(x))[:, None]
        for j, k in enumerate(WIDTHS):
            spread, at = kept[k]
            dk = df[:, j * FILTERS : (j + 1) * FILTERS]
            picked = spread[rows, at]  # only the pooled positions pass a gradient
            g[f"filter{k}"] = np.einsum("bfe,bf->ef", picked, dk)
            g[f"bias{k}"] = dk.sum(0)
            back = dk[:, :, None] * w[f"filter{k}"].T[None]
            for i in range(k):
                np.add.at(de, (rows, at + i), back[:, :, i * EMBED : (i + 1) * EMBED])
        g["embed"] = np.zeros_like(w["embed"])
        touched = np.flatnonzero(np.abs(de).sum(2).reshape(-1))
        np.add.at(g["embed"], x.reshape(-1)[touched], de.reshape(-1, EMBED)[touched])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m, v, t = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                t += 1
                at = order[i : i + batch]
                for k, g in self.gradients(x[at], y[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def _sample_windows(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not has_letter(text):
                    continue
                data = text.encode("utf-8", "replace")
                rng = np.random.default_rng(len(data))
                own = windows(data)
                for i in rng.permutation(len(own))[:bound]:
                    ids.append(doc)
                    found.append(own[i].tobytes())
                # short texts are learned too: a window cut short
                n = int(rng.integers(12, WINDOW))
                ids.append(doc)
                found.append(own[0].tobytes()[:n].ljust(WINDOW, b"\0"))
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.binary())], names=["doc_id", "window"])

    return run


def train(documents: DataFrame, per_language: int, windows_per_text: int) -> tuple[list[str], ByteNetwork | None]:
    """documents: doc_id, text, lang of the rows to learn from."""
    chosen = dict(sampled_ids(documents, "doc_id", "lang", per_language))
    if not chosen:
        return [], None
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = texts_of(documents, list(chosen)).mapInArrow(_sample_windows(windows_per_text), f"doc_id {kind}, window binary").collect()
    found.sort(key=lambda r: (str(r[0]), bytes(r[1])))
    names = sorted(set(chosen.values()))
    if not found:
        return [], None
    x = np.frombuffer(b"".join(bytes(r[1]) for r in found), np.uint8).reshape(-1, WINDOW)
    y = np.array([names.index(chosen[r[0]]) for r in found])
    network = ByteNetwork(len(names))
    network.fit(x, y)
    return names, network


def _predictions(names: list[str], network: ByteNetwork | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            totals = np.zeros((len(texts), max(1, len(names))))
            held: list[tuple[int, np.ndarray]] = []
            size = 0

            def score() -> None:
                x = np.concatenate([w for _, w in held])
                owner = np.repeat([i for i, _ in held], [len(w) for _, w in held])
                for i in range(0, len(x), 64):
                    part = x[i : i + 64]
                    np.add.at(totals, owner[i : i + 64], network.probabilities(part) * np.count_nonzero(part, axis=1)[:, None])
                held.clear()

            for i, text in enumerate(texts):
                if network is None or not has_letter(text):
                    continue
                held.append((i, windows(text.encode("utf-8", "replace"))))
                size += len(held[-1][1])
                if size > 2048:
                    score()
                    size = 0
            if held:
                score()
            whole = totals.sum(1)
            known = whole > 0
            best = totals.argmax(1)
            scores = np.where(known, totals.max(1) / np.where(known, whole, 1), 0.0)
            said = [names[b] if k else UNDETERMINED for b, k in zip(best, known)]
            out = [batch.column(0), batch.column(2), pa.array(said, pa.string()), pa.array(np.round(scores, 6))]
            yield pa.record_batch([*out, *batch.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", *batch.schema.names[3:]])

    return run


def identify(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_fold: int = 2,
    per_language: int = PER_LANGUAGE,
    windows_per_text: int = WINDOWS_PER_TEXT,
    carry: bool = False,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; with carry, then ``row``, all of the document's columns."""
    spark = documents.sparkSession
    ship(spark)
    held = F.coalesce(remainder(id_col, folds) == held_fold, F.lit(False))
    read = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"), F.col(lang_col).alias("lang"))
    names, network = train(read.where("not held_out and lang is not null").drop("held_out"), per_language, windows_per_text)
    kind = read.schema["doc_id"].dataType.simpleString()
    rows = read.select("doc_id", "text", "held_out")
    out = f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    if carry:
        rows = rows_with(documents, id_col, text_col, held)
        out += f", row {rows.schema['row'].dataType.simpleString()}"
    return rows.mapInArrow(_predictions(names, network), out)
