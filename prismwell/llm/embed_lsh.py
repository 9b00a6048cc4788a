"""Near-duplicate embeddings by p-stable hashing for the Euclidean distance.

Normalised vectors are projected on random Gaussian directions, shifted and quantised; ``k`` such
numbers make a table's bucket, and ``k`` and the number of tables follow from the number of vectors
and the recall asked for. Vectors that share a bucket are compared by exact cosine, in blocks: a
large bucket is dealt out as pairs of blocks, each pair a group of bounded size. A pair that meets in
several tables counts in the first one only, which the bucket keys tell. Blocks give back counts of
links and spanning edges, never the pairs. Equal vectors are one class and are compared once.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are components of their own; vectors of different lengths never link; repeated rows are
copies; a null id counts as a copy but names no component; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, salted_join

#: Width of a quantisation step, for unit vectors.
WIDTH = 2.5
#: Probability of finding a pair that is just near enough.
RECALL = 0.99
#: Unrelated vectors that a bucket holds on average: comparing them costs less than more tables.
STRANGERS = 32
#: Vectors of one block; a larger bucket is dealt out as pairs of blocks.
BLOCK = 256


def collision(distance: float, width: float) -> float:
    """The probability that two points at a distance share a quantised projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return erf(r / sqrt(2)) - sqrt(2 / pi) / r * (1 - exp(-r * r / 2))


def table_shape(n: int, cosine: float, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a table, tables): so many that unrelated vectors rarely meet, and near ones do."""
    near, far = collision(sqrt(2 - 2 * cosine), width), collision(sqrt(2), width)
    k = max(4, ceil(log(max(n / STRANGERS, 2)) / -log(far)))
    return k, ceil(log(1 - recall) / log(1 - near**k))


def bucket_keys(unit: np.ndarray, k: int, tables: int, width: float = WIDTH, seed: int = 7) -> np.ndarray:
    """A 64-bit bucket key of each vector in each table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    directions, shifts = rng.standard_normal((unit.shape[1], k * tables)), rng.uniform(0, width, k * tables)
    cells = np.floor((unit @ directions + shifts) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, k)
    h = np.zeros((len(unit), tables), np.uint64)
    for j in range(k):
        h = (h ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _unit(vectors: pd.Series) -> list[np.ndarray | None]:
    out = []
    for v in vectors:
        x = None if v is None else np.asarray(v, dtype=np.float64)
        size = float(np.linalg.norm(x)) if x is not None and len(x) and np.isfinite(x).all() else 0.0
        if x is not None and not np.isfinite(size):
            x = x / np.abs(x).max()
            size = float(np.linalg.norm(x))
        out.append(x / size if size > 0 else None)
    return out


def _labels(near: np.ndarray) -> np.ndarray:
    """The least index reachable from each row of a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_block(ids: np.ndarray, side: np.ndarray, sizes: np.ndarray, unit: np.ndarray, keys: np.ndarray, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each vector, edge heads, edge tails) of one bucket's block or pair of blocks.

    ``side`` is 0 in both for one block with itself, and tells two blocks apart otherwise. A pair
    counts if it is near and has met in no earlier table.
    """
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(ids)),) * 2
    near = unit[a] @ unit[b].T >= cosine
    for t in range(table):
        if near.any():
            near &= keys[a, t][:, None] != keys[b, t][None, :]
    if not side.any():
        np.fill_diagonal(near, False)
    links = np.zeros(len(ids), np.int64)
    links[a] += near @ sizes[b]
    if side.any():
        links[b] += near.T @ sizes[a]
        both = np.zeros((len(ids), len(ids)), bool)
        both[np.ix_(a, b)], both[np.ix_(b, a)] = near, near.T
        near = both
    label = _labels(near) if near.any() else np.arange(len(ids))
    away = np.flatnonzero(label != np.arange(len(ids)))
    return links, ids[label[away]], ids[away]


def near_vectors(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", cosine: float = 0.95, width: float = WIDTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row: its id, n_links, component_id, kept and n_same (copies, itself included)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = cut(rows.withColumn("sound", F.coalesce(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))))
    sound = rows.where("sound")
    classes = cut(sound.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n_same"), F.count("id").alias("n_ids")).where("n_ids > 0").withColumn("cls", F.xxhash64("v", "rep")))
    n = classes.count()
    k, tables = table_shape(n, cosine, width, recall)

    @F.pandas_udf("array<long>")
    def hashed(v: pd.Series) -> pd.Series:
        unit = _unit(v)
        out: list = [None] * len(unit)
        for dim in {len(u) for u in unit if u is not None}:
            at = [i for i, u in enumerate(unit) if u is not None and len(u) == dim]
            for i, keys in zip(at, bucket_keys(np.stack([unit[i] for i in at]), k, tables, width), strict=True):
                out[i] = keys
        return pd.Series(out)

    keyed = cut(classes.withColumn("keys", hashed("v")).select("rep", "n_same", "v", "keys"))
    spots = keyed.select("rep", F.size("v").alias("dim"), F.posexplode("keys").alias("t", "key"))
    counts = spots.groupBy("t", "key", "dim").agg(F.count("*").alias("n")).where("n > 1")
    # how many blocks each bucket with company has; a vector is dealt to each pair of blocks that holds its own
    met = salted_join(spots, counts, ["t", "key", "dim"], "inner", salts=2)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = met.withColumn("blocks", blocks).withColumn("own", own).select(
        "rep", "t", "key", "dim", F.col("own"), F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(own, o) as lo, greatest(own, o) as hi))")).alias("p"),
    )
    dealt = dealt.select("rep", "t", F.xxhash64("t", "key", "dim", "p.lo", "p.hi").alias("task"), F.when(F.col("own") == F.col("p.lo"), 0).otherwise(1).alias("side"), (F.col("p.lo") == F.col("p.hi")).alias("alone"))
    full = dealt.join(keyed, "rep").select("task", "t", "side", "alone", "rep", "n_same", "v", "keys")

    def compared(pdf_iter: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in pdf_iter:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf["task"].iloc[-1] if len(pdf) else None
            done, held = pdf[pdf["task"] != last], pdf[pdf["task"] == last]
            yield from solve(done)
        if held is not None:
            yield from solve(held)

    def solve(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(pdf):
            return
        task = pdf["task"].to_numpy()
        ids, side, sizes = pdf["rep"].to_numpy(), pdf["side"].to_numpy(), pdf["n_same"].to_numpy()
        table, alone = pdf["t"].to_numpy(), pdf["alone"].to_numpy()
        unit, keys = _unit(pdf["v"]), pdf["keys"].to_numpy()
        heads, tails, linked, number = [], [], [], []
        ends = [*(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        start = 0
        for end in ends:
            s = slice(start, end)
            start = end
            if end - s.start < 2 or not (alone[s.start] or side[s].any() and not side[s].all()):
                continue
            links, a, b = compare_block(ids[s], np.zeros(end - s.start, int) if alone[s.start] else side[s], sizes[s], np.stack(unit[s]), np.stack(keys[s]), int(table[s.start]), cosine)
            some = np.flatnonzero(links)
            linked.append(ids[s][some])
            number.append(links[some])
            heads.append(a)
            tails.append(b)
        if linked:
            yield pd.DataFrame({"a": np.concatenate(linked), "b": np.concatenate(number), "edge": False}).astype({"a": "int64", "b": "int64"})
            yield pd.DataFrame({"a": np.concatenate(heads), "b": np.concatenate(tails), "edge": True}).astype({"a": "int64", "b": "int64"})

    grouped = full.repartition(F.col("task")).sortWithinPartitions("task")
    found = cut(grouped.mapInPandas(compared, "a long, b long, edge boolean"))
    links = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    parts = connected_components(found.where("edge").select("a", "b"))
    named = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("v", (F.coalesce("others", F.lit(0)) + F.col("n_same") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "n_same")
    out = salted_join(sound, named, ["v"], salts=2).select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce("n_same", F.lit(1)).alias("n_same"))
    lone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("n_same"))
    return out.unionByName(lone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"), "n_same")
