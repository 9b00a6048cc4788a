"""Connected components of many graphs at once; no large graph, star or component is gathered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import kept

#: Rows that one contraction holds; a graph of more is a giant, which is never gathered.
CONTRACTED = 400_000
_AS_THEY_ARE = ("bigint", "int", "string")


#: Rows of a wide shuffle that a task should have.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """``rows``, of which there are about ``n``, dealt out by ``by`` to as many tasks as so many ask for, so that a task's memory does not follow the table."""
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(tasks, *by) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*by)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Join where one key may hold most rows of ``big``: a hash of ``by`` spreads them, and ``small``, unique by key, is repeated."""
    keyed = big.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keyed.join(each, [*on, "_salt"], how).drop("_salt")


def _numbered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the nodes u and v, in the order of (graph, node), and each number's row; rows from len(rows) on mean its v."""
    code = pd.factorize(rows["graph"])[0]
    node, of = np.concatenate([rows["u"], rows["v"]]), np.concatenate([code, code])
    order = np.lexsort((node, of))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(node[order]) != 0) | (np.diff(of[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number[: len(rows)], number[len(rows) :], order[new]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, each number's least companion, once the edges a - b are there."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _stars(rows: pd.DataFrame) -> pd.DataFrame:
    """Stars that span the components of these (graph, u, v): each node v with the least that it reaches, a centre with itself."""
    a, b, at = _numbered(rows)
    root = _joined(np.arange(len(at)), a, b)
    node, graph = np.concatenate([rows["u"], rows["v"]])[at], rows["graph"].to_numpy()[at % max(len(rows), 1)]
    return pd.DataFrame({"graph": graph, "u": node[root], "v": node})


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) > CONTRACTED:
            yield _stars(pd.concat(held, ignore_index=True)).query("u != v")
            held = []
    if held:
        yield _stars(pd.concat(held, ignore_index=True)).query("u != v")


def _whole(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by graph, in portions of whole graphs."""
    held: list[pd.DataFrame] = []
    count = 0
    for pdf in batches:
        if held and count + len(pdf) > most:
            cut = int((pdf["graph"] == held[-1]["graph"].iloc[-1]).sum())
            if cut < len(pdf):
                yield pd.concat([*held, pdf[:cut]], ignore_index=True)
                held, count, pdf = [], 0, pdf[cut:]
        if len(pdf):
            held.append(pdf)
            count += len(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _grown(rows: pd.DataFrame, levels: int) -> Iterator[pd.DataFrame]:
    """The loops of these rows, once for each level from their own on, with the least node joined by edges up to it."""
    a, b, at = _numbered(rows)
    node, root, level = np.concatenate([rows["u"], rows["v"]])[at], np.arange(len(at)), rows["level"].to_numpy()
    loop, edge = a == b, a != b
    plain = rows.drop(columns=["v", "level"]).rename(columns={"u": "node"})
    for k in range(1, levels + 1):
        now = edge & (level == k)
        root = _joined(root, a[now], b[now])
        here = loop & (level <= k)
        yield plain[here].assign(level=k, component=node[root[a[here]]])


def grow(rows: DataFrame, payload: list[str] = (), levels: int = 1) -> DataFrame:
    """(graph, node, level, component, payload) of graphs that are no giants: their nodes at each level, and what these are joined to.

    ``rows`` (graph, u, v, level) has a loop u = v for each node, with its payload, and the edges among
    such nodes; both are there from their level on, 1 to ``levels``. A task takes whole graphs, no more at
    a time than it may hold.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"graph {kinds['graph']}, node long, level int, component long" + "".join(f", {c} {kinds[c]}" for c in payload)
    names, most = ["graph", "node", "level", "component", *payload], CONTRACTED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole(batches, most):
            for out in _grown(part, levels):
                yield out[names]

    placed = rows.select("graph", "u", "v", F.col("level").cast("int").alias("level"), *payload).repartition("graph").sortWithinPartitions("graph")
    return placed.mapInPandas(run, schema)


def components(edges: DataFrame, graph: str = "graph", u: str = "u", v: str = "v") -> DataFrame:
    """(graph, node, component) of every node with an edge to another; a component's name is its least node.

    ``graph`` may be of any type, nodes are longs; loops and repeats do no harm. Graphs that a task can
    hold are contracted whole, after one shuffle. Of giants, which lie sorted in even ranges, each
    partition first replaces its edges by spanning stars, see ``_giant_components``.
    """
    kind = edges.schema[graph].dataType.simpleString()
    g = F.col(graph) if kind in _AS_THEY_ARE else F.col(graph).cast("string")
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    plain = edges.select(g.alias("graph"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v and graph is not null")
    giants = kept(plain.groupBy("graph").count().where(F.col("count") > CONTRACTED).select("graph"))
    some, most = not giants.isEmpty(), CONTRACTED
    small = plain.join(F.broadcast(giants), "graph", "left_anti") if some else plain
    found = small.repartition("graph").sortWithinPartitions("graph").mapInPandas(lambda batches: map(_stars, _whole(batches, most)), f"graph {plain.schema['graph'].dataType.simpleString()}, u long, v long")
    found = found.select("graph", F.col("v").alias("node"), F.col("u").alias("component"))
    if some:
        found = found.union(_giant_components(plain.join(F.broadcast(giants), "graph", "left_semi")))
    return found.withColumn("graph", F.col("graph").cast(kind))


def _giant_components(plain: DataFrame) -> DataFrame:
    """The same of graphs (graph, u, v) of any size, u below v.

    Each partition replaces its range of edges by spanning stars. Then neighbours above a node hang on the
    least that it meets (large stars), and nodes below it on their common least (small stars), until a
    round changes nothing, told by a count and a checksum.
    """
    schema = f"graph {plain.schema['graph'].dataType.simpleString()}, u long, v long"
    e = kept(plain.repartitionByRange("graph", "u", "v").mapInPandas(_contract, schema).distinct())
    key = ["graph", "u"]

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("graph", "u", "v").cast("decimal(20,0)"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.union(e.select("graph", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(key).agg(F.min("v").alias("m")).select(*key, F.least("u", "m").alias("m"))
        large = spread_join(both, least, key, ["v"]).where("v > u and v > m").select("graph", F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("graph", "v").agg(F.min("u").alias("m"))
        hung = spread_join(large, least, ["graph", "v"], ["u"])
        e = kept(hung.select("graph", F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct())
        if (now := mark(e)) == seen:
            break
        seen = now
    found = e.select("graph", F.col("v").alias("node"), F.col("u").alias("component"))
    return found.union(e.select("graph", F.col("u").alias("node"), F.col("u").alias("component")).distinct())
