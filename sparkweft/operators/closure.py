"""Walks level by level: closures of edges and files, parent chains, extents of containers.

Loops run on the driver, levels on the cluster; every level is cut by a reliable checkpoint and
only its row count comes back. A small graph is carried to the starts instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft import model
from sparkweft.operators.edges import ends
from sparkweft.session import durable


#: Levels whose tables a walk unites as they are before it writes them as one.
TOGETHER = 8
#: A graph of files of so many distinct pairs at most goes to every task, which then walks whole starts by itself.
CARRIED = 1 << 19
#: Cells (start, node) that a task marks at a time, and rows of a batch that it returns.
CELLS, BATCH = 1 << 21, 1 << 17


def _walker(table: pa.Table, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Breadth-first walks over a table of pairs (a, b), many starts abreast."""
    count = table.num_rows
    coded = pa.concat_arrays([c for name in ("a", "b") for c in table[name].chunks]).dictionary_encode() if count else pa.array([], table.schema.field("a").type).dictionary_encode()
    codes, nodes = coded.indices.to_numpy(), coded.dictionary
    order = np.argsort(codes[:count], kind="stable")
    far = codes[count:][order].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(codes[:count], minlength=len(nodes)))])

    def walk(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n, degree = len(nodes), first[1:] - first[:-1]
        abreast = max(1, CELLS // max(1, n))
        mark = np.zeros(abreast * n, np.int32)

        def rows(values, held):
            # cells stand in the order of their starts: a list for each start and level, since far fewer rows then cross to Spark
            keys, level = np.concatenate([k for k, _ in held]), np.concatenate([np.full(len(k), d) for k, d in held])
            start = keys // n
            heads = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (level[1:] != level[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(keys)).astype(np.int32)), nodes.take(pa.array(keys % n)))
            return pa.RecordBatch.from_arrays([values.take(pa.array(start[heads])), pa.array(level[heads]), lists], ["start", "level", "nodes"])

        for batch in batches:
            known = batch.column(0).filter(pc.is_in(batch.column(0), value_set=nodes))
            for at in range(0, len(known), abreast):
                values = known.slice(at, abreast)
                front = np.arange(len(values)) * n + pc.index_in(values, value_set=nodes).to_numpy()
                mark[:] = 0
                mark[front] = 1
                held, size, level = [], 0, 0
                while len(front) and (most is None or level < most):
                    level += 1
                    node = front % n
                    many = degree[node]
                    ends = np.cumsum(many)
                    if not len(ends) or not ends[-1]:
                        break
                    place = np.arange(ends[-1]) + np.repeat(first[node] - (ends - many), many)
                    near = np.repeat(front - node, many) + far[place]
                    near = near[mark[near] == 0]
                    # of equal cells the last one written stays
                    number = np.arange(1, len(near) + 1, dtype=np.int32)
                    mark[near] = number
                    front = near[mark[near] == number]
                    for cut in range(0, len(front), BATCH):
                        part = front[cut : cut + BATCH]
                        held.append((part, level))
                        size += len(part)
                        if size >= BATCH:
                            yield rows(values, held)
                            held, size = [], 0
                if held:
                    yield rows(values, held)

    return walk


def _carried(steps: DataFrame, starts: DataFrame, most: int | None, carried: int) -> DataFrame | None:
    """The walk with the graph in every task; None where the graph is too large for that or its ids differ in type."""
    kinds = {steps.schema["a"].dataType, steps.schema["b"].dataType, starts.schema["start"].dataType}
    if len(kinds) > 1:
        return None
    table = steps.limit(carried + 1).toArrow()
    if table.num_rows > carried:
        return None
    spark, kind = steps.sparkSession, steps.schema["a"].dataType.simpleString()
    # by number, so that starts are not folded into a task or two for being few bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    spread = starts.select("start").distinct().repartition(tasks, "start")
    found = spread.mapInArrow(_walker(table, most), f"start {kind}, level long, nodes array<{kind}>")
    return found.select("start", F.explode("nodes").alias("node"), "level")


def reach(pairs: DataFrame, starts: DataFrame, most: int | None = None, carried: int = 0) -> DataFrame:
    """start, node, level: nodes that starts (a column ``start``) reach along pairs (a, b), the start itself never.

    level is the shortest distance; cycles end because a pair (start, node) is visited once. A graph of at most
    ``carried`` distinct pairs is walked within tasks: rows are neither exchanged nor written on the way.
    """
    steps = pairs.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    if carried and (found := _carried(steps, starts, most, carried)) is not None:
        return found
    visited = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("level")).distinct()
    frontier, level = visited, 0
    while most is None or level < most:
        level += 1
        found = frontier.select("start", F.col("node").alias("a")).join(steps, "a").select("start", F.col("b").alias("node")).distinct()
        frontier = durable(found.join(visited, ["start", "node"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if level % TOGETHER == 0:
            visited = durable(visited)
    return visited.where("level > 0").withColumn("level", F.col("level").cast("long"))


def bounded(edges: DataFrame, symbols: DataFrame, kinds: Sequence[str], direction: str, most: int = model.CLOSURE_DEPTH, starts: DataFrame | None = None) -> DataFrame:
    """start, node, level over symbols; nodes without a merged record are walked through but not returned."""
    near, far = ends(direction)
    pairs = edges.where(F.col("kind").isin(*kinds)).select(F.col(near).alias("a"), F.col(far).alias("b"))
    starts = starts if starts is not None else symbols.select(F.col("usr").alias("start"))
    return reach(pairs, starts, most).join(symbols.select(F.col("usr").alias("node")), "node", "left_semi")


def direct(includes: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct direct includes (from_file, to_file, line, angled), or distinct includers (file, includer)."""
    if direction == "out":
        return includes.select("from_file", "to_file", "line", "angled").distinct()
    return includes.select(F.col("to_file").alias("file"), F.col("from_file").alias("includer")).distinct()


def files(includes: DataFrame, starts: DataFrame, direction: str = "out") -> DataFrame:
    """start, node, level over files, without a bound; 'out' follows includes, 'in' includers."""
    a, b = ("from_file", "to_file") if direction == "out" else ("to_file", "from_file")
    return reach(includes.select(F.col(a).alias("a"), F.col(b).alias("b")), starts, carried=CARRIED)


def units_reaching(includes: DataFrame, units: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, unit: units (a column ``file_id``) that are a wanted file or include it by any path.

    The fewer of the two are the starts; a walk names a pair once, so the pairs need no distinct.
    """
    asked, held = (x.select(F.col("file_id").alias("start")).distinct() for x in (wanted, units))
    way, few, many = ("out", held, asked) if held.count() < asked.count() else ("in", asked, held)
    walked = files(includes, few, way).select("start", "node")
    found = few.select("start", F.col("start").alias("node")).unionByName(walked).join(many.select(F.col("start").alias("node")), "node", "left_semi")
    file, unit = ("node", "start") if way == "out" else ("start", "node")
    return found.select(F.col(file).alias("file"), F.col(unit).alias("unit"))


def ancestors(symbols: DataFrame, starts: DataFrame | None = None, most: int = model.PARENT_DEPTH) -> DataFrame:
    """usr, level, ancestor along parent_usr, nearest first; a missing record or a repeated one ends a chain."""
    parents = symbols.select(F.col("usr").alias("at"), F.col("parent_usr").alias("up"))
    known = symbols.select(F.col("usr").alias("up"))
    chain = (starts.select("usr") if starts is not None else symbols.select("usr")).withColumns({"at": F.col("usr"), "seen": F.array("usr"), "level": F.lit(0)})
    out = None
    for _ in range(most):
        step = chain.join(parents, "at").where("up is not null").join(known, "up", "left_semi")
        step = step.where(~F.array_contains("seen", F.col("up")))
        chain = durable(step.select("usr", F.col("up").alias("at"), F.concat("seen", F.array("up")).alias("seen"), (F.col("level") + 1).alias("level")))
        if chain.isEmpty():
            break
        part = chain.select("usr", F.col("level").cast("long").alias("level"), F.col("at").alias("ancestor"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else chain.select("usr", F.col("level").cast("long").alias("level"), F.col("at").alias("ancestor")).limit(0)


def members(symbols: DataFrame) -> DataFrame:
    """parent, usr, kind, line of every symbol whose parent is a merged record."""
    inside = symbols.where("parent_usr is not null").select(F.col("parent_usr").alias("parent"), "usr", "kind", "line")
    return inside.join(symbols.select(F.col("usr").alias("parent")), "parent", "left_semi")


def container_end(symbols: DataFrame, nested: Sequence[str] = ("namespace",), most: int = model.NAMESPACE_DEPTH, starts: DataFrame | None = None) -> DataFrame:
    """usr, last_line: the last line of what a container (all, or the given symbols) holds in its own file, nested namespaces included."""
    inside = symbols.where("parent_usr is not null").select(
        F.col("parent_usr").alias("parent"), F.col("file_id").alias("file"), F.col("usr").alias("member"), "kind", F.coalesce("end_line", "line").alias("end")
    )
    best = None
    level = (symbols if starts is None else starts).select("usr", F.col("file_id").alias("file"), F.col("usr").alias("parent"))
    for _ in range(most + 1):
        rows = level.join(inside, ["parent", "file"])
        part = rows.groupBy("usr").agg(F.max("end").alias("end"))
        best = part if best is None else best.unionByName(part)
        level = rows.where(F.col("kind").isin(*nested)).select("usr", "file", F.col("member").alias("parent"))
    return best.groupBy("usr").agg(F.max("end").cast("long").alias("last_line")).where("last_line is not null")
