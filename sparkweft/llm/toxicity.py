"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input joins a learned vector of the word (one for all words outside the vocabulary) and
the sum of learned vectors of its character four-grams, found by hash. Overlapping windows of words run through one GRU in
each direction, attention pools the states, and a logistic layer scores the window; a text's
score is that of its highest window, over all windows of the whole text.

The network is trained here, in numpy, on windows of a bounded sample: at most ``per_label``
labelled texts of each label and ``windows_per_text`` windows a text, by the same number of steps for
samples of every size; the texts among them that set the offset are scored over all of their windows. A label belongs to a text, not to a window, so training runs in two rounds: the second drops the windows of toxic texts that
the first finds no worse than nearly all clean windows.

Defined cases: a text that is null or has no word scores as one empty window; without learnable
rows every score is 0; repeated rows score alike; of several labels of an id the largest counts, and of several texts of a sampled id one is learned;
null ids pass through (their labels are not looked up); an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import durable, remainder, rows_with, sampled_ids, ship, texts_of

WINDOW, STRIDE = 32, 16
WORD, CHAR, STATE = 12, 8, 8
#: Bits of the hash that finds a four-gram's row, if it has one.
GRAM_BITS = 18
#: The sample's bounds, documented parameters of the fit.
PER_LABEL, WINDOWS_PER_TEXT = 1000, 24
#: Of the sampled texts of each label, one in so many is kept from training and sets the offset.
ASIDE = 4
#: Words and four-grams get a vector if they are in so many sampled texts of one label at least; rarer words share one vector.
LEAST_TEXTS = 3
#: The offset weighs a share of clean texts that it flags so many times a share of toxic texts that it misses; most texts are clean.
WRONG = 10
#: A toxic text's window goes to the second round if it scores above this share of clean windows.
CLEAN = 0.98
#: Steps of a round of training, and windows of a step; the same for samples of every size.
STEPS, BATCH = 260, 256
#: Share of words that training takes for unknown, and the decay of weights.
DROPPED, DECAY = 0.1, 1e-4
_PARTS = bytes(c + 32 if 65 <= c <= 90 else (32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """All lower-cased runs of ASCII letters and digits and of other characters."""
    return (text or "").encode("utf-8", "replace").translate(_PARTS).split()


def window_starts(n: int) -> list[int]:
    """Starts of windows that overlap by half and cover n words."""
    return [*range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the four-grams that start in each word or the space before it, and each word's first."""
    data = np.frombuffer(b" " + b" ".join(words) + b"   ", np.uint8).astype(np.uint32)
    key = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    with np.errstate(over="ignore"):
        return (key * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS), np.cumsum(sizes) - sizes


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Recurrent:
    """The network: ``vocabulary`` maps words to rows of the word table from 1 on, ``grams`` lists the hashes that have rows."""

    def __init__(self, vocabulary: dict[bytes, int], grams: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.vocabulary, self.row, d = vocabulary, np.zeros(1 << GRAM_BITS, np.int32), WORD + CHAR
        self.row[grams] = np.arange(1, len(grams) + 1)
        self.w = {"word": normal(len(vocabulary) + 1, WORD, scale=0.3), "char": normal(len(grams) + 1, CHAR, scale=0.1)}
        self.w["char"][0] = 0
        for side in "fb":
            self.w["in" + side] = normal(d, 3 * STATE, scale=d**-0.5)
            self.w["bias" + side] = np.zeros(3 * STATE, np.float32)
            self.w["gate" + side] = normal(STATE, 2 * STATE, scale=STATE**-0.5)
            self.w["cand" + side] = normal(STATE, STATE, scale=STATE**-0.5)
        self.w |= {"att": normal(2 * STATE, scale=0.3), "out": normal(2 * STATE, scale=0.3), "out_bias": np.zeros(1, np.float32)}
        self.offset = 0.0

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the word table; rows of the four-gram table, and where each word's begin."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        found, starts = grams_of(words)
        return ids, self.row[found], starts

    def inputs(self, ids: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x = np.empty((len(ids), WORD + CHAR), np.float32)
        if len(ids):
            x[:, :WORD] = self.w["word"][ids]
            known = np.flatnonzero(grams)
            total = np.zeros((len(known) + 1, CHAR), np.float32)
            np.cumsum(self.w["char"][grams[known]], axis=0, dtype=np.float32, out=total[1:])
            ends = np.searchsorted(known, np.append(starts, len(grams)))
            x[:, WORD:] = total[ends[1:]] - total[ends[:-1]]
        return x

    def _run(self, pre: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """pre: time x batch x 3 STATE; states in the order of time."""
        w, n = self.w, pre.shape[0]
        gate, cand = w["gate" + side], w["cand" + side]
        h = np.zeros((pre.shape[1], STATE), np.float32)
        states, kept = np.empty((n, pre.shape[1], STATE), np.float32), {}
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            g = sigmoid(pre[t, :, : 2 * STATE] + h @ gate)
            z, r = g[:, :STATE], g[:, STATE:]
            c = np.tanh(pre[t, :, 2 * STATE :] + (r * h) @ cand)
            step = z * mask[t][:, None]
            if keep:
                kept[t] = h, z, r, c
            h = h + step * (c - h)
            states[t] = h
        return states, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: time x batch x (WORD + CHAR), mask: time x batch of 0 and 1; logits by batch."""
        w = self.w
        sides = [self._run(x @ w["in" + s] + w["bias" + s], mask, s, keep) for s in "fb"]
        states = np.concatenate([s[0] for s in sides], 2)
        energy = states @ w["att"] + (mask - 1) * 1e4
        a = np.exp(energy - energy.max(0))
        a *= mask
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * states).sum(0)
        return pooled @ w["out"] + w["out_bias"][0], (states, a, pooled, sides)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        w, g = self.w, {}
        logit, (states, a, pooled, sides) = self.forward(x, mask, True)
        d = (sigmoid(logit) - y) * weight / len(y)
        g["out"], g["out_bias"] = pooled.T @ d, np.array([d.sum()])
        dp = d[:, None] * w["out"]
        da = (states * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tbh,tb->h", states, de)
        ds = a[:, :, None] * dp + de[:, :, None] * w["att"]
        dx = np.zeros_like(x)
        for j, side in enumerate("fb"):
            kept, n = sides[j][1], len(x)
            dstate = ds[:, :, j * STATE : (j + 1) * STATE]
            dh, dpre = np.zeros_like(dstate[0]), np.zeros((*x.shape[:2], 3 * STATE), np.float32)
            ggate, gcand = np.zeros_like(w["gate" + side]), np.zeros_like(w["cand" + side])
            for t in range(n - 1, -1, -1) if side == "f" else range(n):
                h, z, r, c = kept[t]
                dh = dh + dstate[t]
                m = mask[t][:, None]
                dc = dh * z * m * (1 - c * c)
                dz = dh * (c - h) * m * z * (1 - z)
                back = dc @ w["cand" + side].T
                dr = back * h * r * (1 - r)
                dg = np.concatenate([dz, dr], 1)
                ggate += h.T @ dg
                gcand += (r * h).T @ dc
                dpre[t, :, : 2 * STATE], dpre[t, :, 2 * STATE :] = dg, dc
                dh = dh * (1 - z * m) + back * r + dg @ w["gate" + side].T
            g["gate" + side], g["cand" + side] = ggate, gcand
            flat = dpre.reshape(-1, 3 * STATE)
            g["in" + side], g["bias" + side] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
            dx += dpre @ w["in" + side].T
        return g, dx

    def fit(self, parts: list[bytes], y: np.ndarray, steps: int = STEPS, rate: float = 0.006, seed: int = 5) -> None:
        """parts: windows, their words joined by spaces. Every step takes the next windows of an endless row of shuffled passes."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        m, v, order = {}, {}, np.zeros(0, np.int64)
        batch = min(BATCH, len(parts))
        for t in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(parts))])
            at, order = order[:batch], order[batch:]
            ids, grams, starts, place, mask = self._batch([parts[k] for k in at])
            ids = np.where(rng.random(len(ids)) < DROPPED, 0, ids)
            x = self._laid(self.inputs(ids, grams, starts), place, len(at))
            g, dx = self.gradients(x, mask, y[at].astype(np.float32), weight[at])
            dtoken = dx.transpose(1, 0, 2).reshape(-1, WORD + CHAR)[place]
            g["word"], g["char"] = np.zeros_like(self.w["word"]), np.zeros_like(self.w["char"])
            np.add.at(g["word"], ids, dtoken[:, :WORD])
            known = np.flatnonzero(grams)
            np.add.at(g["char"], grams[known], dtoken[np.searchsorted(starts, known, side="right") - 1, WORD:])
            for k, d in g.items():
                d = d + DECAY * self.w[k]
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                self.w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
            self.w["char"][0] = 0

    def _batch(self, parts: list[bytes]):
        own = [p.split() for p in parts]
        sizes = np.array([len(p) for p in own])
        words = [w for p in own for w in p]
        place = np.repeat(np.arange(len(parts)) * WINDOW, sizes) + np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mask = np.arange(WINDOW)[:, None] < sizes[None, :]
        return *self.tokens(words), place, mask.astype(np.float32)

    @staticmethod
    def _laid(inputs: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros((n * WINDOW, WORD + CHAR), np.float32)
        x[place] = inputs
        return np.ascontiguousarray(x.reshape(n, WINDOW, -1).transpose(1, 0, 2))

    def logits(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The logits of all windows of each text of words; inputs are made once a word, not once a window."""
        words = [w for t in texts for w in t]
        tokens = np.zeros((len(words) + 1, WORD + CHAR), np.float32)
        tokens[:-1] = self.inputs(*self.tokens(words))
        rows, owner, base = [], [], 0
        for i, t in enumerate(texts):
            for s in window_starts(len(t)):
                rows.append((base + s, base + min(s + WINDOW, len(t))))
                owner.append(i)
            base += len(t)
        at = np.array(rows)
        index = at[:, :1] + np.arange(WINDOW)
        valid = index < at[:, 1:]
        index[~valid] = len(words)
        found = np.concatenate([self.forward(tokens[index[i : i + 512].T], valid[i : i + 512].T.astype(np.float32))[0] for i in range(0, len(at), 512)])
        return np.split(found, np.flatnonzero(np.diff(owner)) + 1)


def _sample_windows(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                starts = window_starts(len(words))
                for i in np.random.default_rng(len(words)).permutation(len(starts))[:bound]:
                    ids.append(doc)
                    found.append(b" ".join(words[starts[i] : starts[i] + WINDOW]))
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.binary())], names=["doc_id", "words"])

    return run


def _window_logits(network: Recurrent, parts: list[bytes]) -> np.ndarray:
    """The logit of each window alone."""
    return np.concatenate([x for i in range(0, len(parts), 1000) for x in network.logits([p.split() for p in parts[i : i + 1000]])])


def _vocabulary(docs: np.ndarray, parts: list[bytes], y: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
    """Rows of words, and hashes of four-grams, that are in LEAST_TEXTS texts of one label. Windows of a text stand together."""
    number: dict[bytes, int] = {}
    in_words: list[list[int]] = []
    in_grams = np.zeros((2, 1 << GRAM_BITS), np.int32)
    ends = np.flatnonzero(np.append(docs[1:] != docs[:-1], True)) + 1
    for i, j in zip([0, *ends], ends):
        words = {w for p in parts[i:j] for w in p.split()}
        for w in words:
            k = number.setdefault(w, len(number))
            if k == len(in_words):
                in_words.append([0, 0])
            in_words[k][y[i]] += 1
        in_grams[y[i], np.unique(np.concatenate([grams_of(p.split())[0] for p in parts[i:j]]))] += 1
    frequent = sorted(w for w, k in number.items() if max(in_words[k]) >= LEAST_TEXTS)
    return {w: i + 1 for i, w in enumerate(frequent)}, np.flatnonzero(in_grams.max(0) >= LEAST_TEXTS)


def kept_aside(label: dict) -> set:
    """Every fourth text of each label."""
    return set(sorted(label, key=lambda d: (label[d], str(d)))[::ASIDE])


def fit(windows: list[tuple], label: dict, most: int = WINDOWS_PER_TEXT, steps: int = STEPS) -> Recurrent | None:
    """windows: (doc, words joined by spaces), at most ``most`` of a doc; label: 0 or 1 by doc. The offset is left at 0."""
    windows = sorted(windows, key=lambda r: (str(r[0]), r[1]))
    known = {d: i for i, d in enumerate(sorted({d for d, _ in windows}, key=str))}
    docs, parts = np.array([known[d] for d, _ in windows]), [p for _, p in windows]
    y = np.array([label[d] for d, _ in windows])
    if len(set(y.tolist())) < 2:
        return None
    vocabulary, grams = _vocabulary(docs, parts, y)
    first = Recurrent(vocabulary, grams)
    first.fit(parts, y, steps)
    scores = _window_logits(first, parts)
    best = np.full(len(known), -np.inf)
    np.maximum.at(best, docs, scores)
    clean = y == 0
    keep = clean | (scores > np.quantile(scores[clean], CLEAN))
    if not keep[~clean].any():
        keep |= scores == best[docs]
    second = Recurrent(vocabulary, grams, seed=12)
    second.fit([p for p, k in zip(parts, keep) if k], y[keep], steps)
    return second


def offset_of(tops: list[tuple], label: dict) -> float:
    """Where 0.5 is; tops: (doc, the highest logit of all of its windows) of texts that were not trained on.

    The highest of many windows is high by chance too, so it must be of as many as scoring takes.
    """
    best: dict = {}
    for d, s in tops:
        best[d] = max(best.get(d, -1e9), s)
    ranked = sorted((s, label[d]) for d, s in best.items())
    s, t = np.array([r[0] for r in ranked]), np.array([r[1] for r in ranked])
    missed = np.concatenate([[0], np.cumsum(t)]) / max(1, t.sum())
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - t)]) / max(1, np.sum(1 - t))
    costs = missed + WRONG * wrong
    good = np.flatnonzero(costs <= costs.min() + 1e-9)
    low, high = s[max(0, good[0] - 1)], s[min(len(s) - 1, good[-1])]
    return float((low + high) / 2)


def _highest(network: Recurrent, column: pa.Array) -> np.ndarray:
    """Each text's highest logit, over all of its windows."""
    out: list = []
    held: list[list[bytes]] = []
    size = 0
    for i in range(len(column)):
        held.append(words_of(column[i].as_py()))
        size += len(held[-1])
        if size > 20_000 or i == len(column) - 1:
            out.extend(x.max() for x in network.logits(held))
            held, size = [], 0
    return np.array(out, np.float32)


def _text_tops(network: Recurrent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_highest(network, batch.column(1)), pa.float64())], names=["doc_id", "top"])

    return run


def _scores(network: Recurrent | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if network is None:
                out = np.zeros(batch.num_rows)
            else:
                out = sigmoid((_highest(network, batch.column(1)) - network.offset).astype(np.float64))
            found = np.round(out, 6)
            scored = [batch.column(0), batch.column(2), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.record_batch([*scored, *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", *batch.schema.names[3:]])

    return run


def score(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held_fold: int = 0,
    per_label: int = PER_LABEL,
    windows_per_text: int = WINDOWS_PER_TEXT,
    steps: int = STEPS,
    carry: bool = False,
) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; with carry, then ``row``, all of the document's columns."""
    spark = documents.sparkSession
    ship(spark)
    held = F.coalesce(remainder(id_col, folds) == held_fold, F.lit(False))
    read = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(remainder("doc_id", folds) != held_fold)
    known = known.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    labelled = durable(known.join(read.select("doc_id"), "doc_id", "left_semi"))  # ids and labels alone
    chosen = dict(sampled_ids(labelled, "doc_id", "label", per_label))
    network = None
    kind = read.schema["doc_id"].dataType.simpleString()
    if chosen:
        aside = kept_aside(chosen)
        sampled = texts_of(read, sorted(chosen.keys() - aside)).mapInArrow(_sample_windows(windows_per_text), f"doc_id {kind}, words binary").toArrow()
        network = fit(list(zip(sampled["doc_id"].to_pylist(), sampled["words"].to_pylist())), chosen, windows_per_text, steps)
        del sampled
        if network is not None:
            tops = texts_of(read, sorted(aside)).mapInArrow(_text_tops(network), f"doc_id {kind}, top double").collect()
            network.offset = offset_of([(r[0], r[1]) for r in tops], chosen)
    rows = read.select("doc_id", "text", "held_out")
    out = f"doc_id {kind}, held_out boolean, score double, predicted int"
    if carry:
        rows = rows_with(documents, id_col, text_col, held)
        out += f", row {rows.schema['row'].dataType.simpleString()}"
    return rows.mapInArrow(_scores(network), out)
