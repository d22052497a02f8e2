"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors on two random 8-dimensional spaces and decodes both projections
to the nearest point of the E8 lattice; the pair of points is the vector's cell. A vector also probes
the cells with the next nearest point in the first space, in the second, and in both. Vectors
that share a cell are compared by cosine in double precision.

Exact copies are compared once. A pair may meet in several tables; it counts where it meets
first, which both vectors' cells tell, so tasks emit sums of links and spanning links, never pairs.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing and stay (n_links 0, a component of their own); vectors of unlike length never link;
repeated rows are copies of each other; rows with a null id get the links and component of their vector;
an empty table gives no rows; only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.cells import candidates, forest, spread
from sparkweft.llm.common import durable, join_classes, ship
from sparkweft.llm.components import components

LEAST_COSINE = 0.95
#: Measured on random directions: at cosine 0.95 a pair meets with probability 0.97 to 0.98, at 0.97 with 0.996;
#: unrelated vectors meet in one table with probability 0.00006.
TABLES, SPACES, SEED, SCALE = 6, 2, 20_101, 0.53
#: Own vectors of a cell that one task holds.
BLOCK = 2048
PROBES = (1 << SPACES) - 1


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest and the next nearest E8 point of each row, as integers.

    E8 is D8 and its shift by one half. In each, rounding all coordinates gives the nearest point if
    the sum is even; else the coordinate with the largest error rounds the other way. The next
    nearest is the best of what remains: the other coset's point and points with one or two more coordinates rounded the other way.
    """
    found, far = [], []
    for shift in (0.0, 0.5):
        y = x - shift
        near = np.rint(y)
        error = y - near
        step = np.where(error >= 0, 1.0, -1.0)
        order = np.argsort(-np.abs(error), axis=1, kind="stable")
        rows = np.arange(len(x))
        odd = near.sum(1) % 2 != 0

        def turned(*ranks: int) -> np.ndarray:
            z = near.copy()
            for r in ranks:
                z[rows, order[:, r]] += step[rows, order[:, r]]
            return z

        one, two, pair = turned(0), turned(1), turned(0, 1)
        best = np.where(odd[:, None], one, near)
        second = np.where(odd[:, None], two, pair)
        for z in (best, second):
            found.append(2 * z + 2 * shift)
            far.append(((x - z - shift) ** 2).sum(1))
    ranked = np.argsort(np.stack(far, 1), axis=1, kind="stable")
    points = np.stack(found, 1)
    pick = lambda k: np.take_along_axis(points, ranked[:, k][:, None, None], 1)[:, 0].astype(np.int64)
    return pick(0), pick(1)


def _mixed(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit number for each row of integers."""
    h = np.full(len(points), salt, np.uint64)
    with np.errstate(over="ignore"):
        for c in points.T.astype(np.uint64):
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def cells(unit: np.ndarray, tables: int = TABLES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """rows x tables x (1 + probes) numbers of cells; the first is the own one."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    out = np.empty((len(unit), tables, 1 + PROBES), np.uint64)
    for t in range(tables):
        codes = []
        for s in range(SPACES):
            own, other = decode(unit @ rng.standard_normal((unit.shape[1], 8)) * scale)
            salt = 1 + t * SPACES + s
            codes.append((_mixed(own, salt), _mixed(other, salt)))
        for k in range(1 + PROBES):
            h = np.zeros(len(unit), np.uint64)
            with np.errstate(over="ignore"):
                for s in range(SPACES):
                    h = (h ^ codes[s][k >> s & 1]) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(32)
            out[:, t, k] = h
    return out.view(np.int64)


def units(raw: np.ndarray, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) for each length among rows of bytes."""
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(raw[at]), kind).reshape(len(at), -1).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        yield at, x / np.sqrt((x * x).sum(1, keepdims=True))


def _bytes(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _raw(lists: pa.Array, kind: str) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    ends = np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
    out = np.empty(len(lists), object)
    out[:] = [flat[i:j].tobytes() for i, j in zip(ends, ends[1:])]
    return out


def _cell_rows(tables: int, scale: float, seed: int, kind: str):
    width = tables * (1 + PROBES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                piece = batch.slice(begin, 1000)
                node, copies, raw = piece.column(0).to_numpy(), piece.column(1).to_numpy(), _raw(piece.column(2), kind)
                for at, unit in units(raw, kind):
                    found = cells(unit, tables, scale, seed)
                    n = len(at)
                    yield pa.record_batch([
                        pa.array(found.reshape(-1)), pa.array(np.tile(np.repeat(np.arange(tables), 1 + PROBES), n).astype(np.int32)),
                        pa.array((np.tile(np.arange(width), n) % (1 + PROBES) > 0).astype(np.int32)),
                        pa.array(np.repeat(node[at], width)), pa.array(np.repeat(copies[at], width)), pa.array(np.repeat(raw[at], width), pa.binary()),
                    ], names=["cell", "tab", "role", "node", "copies", "raw"])

    return run


def _first(p: np.ndarray, q: np.ndarray, table: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Whether pairs with cells p and q, met in a table in p's own cell, meet there first.

    smaller: p's node is the smaller one; of two probes that meet in the same table its cell counts.
    """
    own_p, own_q = p[:, :, 0], q[:, :, 0]
    p_reaches, q_reaches = (p == own_q[:, :, None]).any(2), (q == own_p[:, :, None]).any(2)
    at = np.arange(len(table))
    before = np.arange(p.shape[1])[None, :] < table[:, None]
    both = p_reaches[at, table] & (own_p[at, table] != own_q[at, table])
    return ~((p_reaches | q_reaches) & before).any(1) & (~both | smaller)


def _linked(least: float, tables: int, scale: float, seed: int, kind: str):
    plain = lambda c: c.to_numpy()
    takes = {"node": plain, "copies": plain, "tab": plain, "raw": _bytes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left, right in candidates(batches, takes):
            node, copies = rows["node"], rows["copies"]
            used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
            slot, a_all, b_all = np.full(len(used), -1), place[: len(left)], place[len(left) :]
            near = []
            for at, x in units(rows["raw"][used], kind):
                slot[:] = -1
                slot[at] = np.arange(len(at))
                pairs = np.flatnonzero((slot[a_all] >= 0) & (slot[b_all] >= 0))
                for i in range(0, len(pairs), 50_000):
                    some = pairs[i : i + 50_000]
                    some = some[np.einsum("ij,ij->i", x[slot[a_all[some]]], x[slot[b_all[some]]]) >= least]
                    near.append(some[node[left[some]] != node[right[some]]])
            near = np.concatenate(near)
            if not len(near):
                continue
            linked, slots = np.unique(np.concatenate([left[near], right[near]]), return_inverse=True)
            known = np.empty((len(linked), tables, 1 + PROBES), np.int64)
            for at, x in units(rows["raw"][linked], kind):
                known[at] = cells(x, tables, scale, seed)
            counts = np.zeros(len(linked), np.int64)
            for i in range(0, len(near), 50_000):
                some = near[i : i + 50_000]
                u, v = slots[: len(near)][i : i + 50_000], slots[len(near) :][i : i + 50_000]
                counted = _first(known[u], known[v], rows["tab"][left[some]], node[left[some]] < node[right[some]])
                np.add.at(counts, u[counted], copies[right[some[counted]]])
                np.add.at(counts, v[counted], copies[left[some[counted]]])
            a, b = forest(left[near], right[near], node)
            some = counts > 0
            is_count = np.arange(some.sum() + len(a)) < some.sum()
            yield pa.record_batch([pa.array(np.concatenate([node[linked[some]], a])), pa.array(np.concatenate([counts[some], b])), pa.array(is_count)], names=["a", "b", "counted"])

    return run


def near_duplicates(
    embeddings: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least_cosine: float = LEAST_COSINE,
    tables: int = TABLES,
    scale: float = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; ids are whole numbers or strings."""
    ship(embeddings.sparkSession)
    own = F.col(id_col) if embeddings.schema[id_col].dataType.simpleString() == "string" else F.col(id_col).cast("long")
    read = embeddings.select(own.alias("vec_id"), F.col(vector_col).alias("v"))
    kind = "<f8" if "double" in read.schema["v"].dataType.simpleString() else "<f4"
    read = read.withColumn("v", F.col("v").cast("array<double>" if kind == "<f8" else "array<float>"))
    bad = lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))
    usable = F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    grouped = read.where(usable).groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = durable(grouped.select(F.xxhash64("v", "least_id").alias("node"), "copies", "v", "least_id"))
    rows = classes.select("node", "copies", "v").mapInArrow(_cell_rows(tables, scale, seed, kind), "cell long, tab int, role int, node long, copies long, raw binary")
    found = durable(spread(rows, F.col("node"), BLOCK).mapInArrow(_linked(least_cosine, tables, scale, seed, kind), "a long, b long, counted boolean"))
    links = found.where("counted").groupBy(F.col("a").alias("__a")).agg(F.sum("b").alias("links"))
    joined = components(found.where("not counted").select("a", "b"))
    labelled = classes.join(links, F.col("node") == F.col("__a"), "left").drop("__a")
    labelled = labelled.join(joined.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy(F.col("component").alias("__c")).agg(F.min("least_id").alias("component_id"))
    verdict = labelled.join(least, F.col("component") == F.col("__c")).select(
        F.col("v").alias("__v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"
    )
    linked = join_classes(read.where(usable), verdict, "v", "__v", "copies").select("vec_id", "n_links", "component_id")
    alone = read.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
