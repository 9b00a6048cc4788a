"""What several operators of this subpackage need: shared storage, skew-proof joins, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one local contraction step holds.
CONTRACT_ROWS = 400_000
#: A-Z to a-z, the only case folding that the contracts ask for.
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="prismwell-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/prismwell-{label}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows in the shared folder; lost executors cost no recomputing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: for loops, as a checkpoint carries on the constraints of its plan."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def whole_rows(docs: DataFrame) -> Column:
    """All columns as one struct ``_row``; whatever they are called, they clash with no name outside it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def text_bytes(col: str | Column) -> Column:
    """The column as UTF-8 bytes, null as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the value written as text, modulo n; null counts as the text ''."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 16, by: Column | None = None) -> DataFrame:
    """Join with ``small``, unique on the key, where one key may hold a third of ``big``.

    The salt spreads a hot key over ``salts`` tasks; ``small`` is repeated that often. As the salt
    is no key of the aggregate that made ``small``, both sides are exchanged, so that adaptive
    execution can split what is still uneven. The salt is a hash of the other columns, or of ``by``
    where rows may agree in all of them; a row number serves if ``big`` is a table that was written.
    """
    rest = [by] if by is not None else [c for c in big.columns if c not in on] or big.columns
    keyed = big.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keyed.join(spread, [*on, "_salt"], how).drop("_salt")


def _forest(pairs: list[pd.DataFrame]) -> pd.DataFrame:
    """Stars that span the components of the given edges: each node with its least reachable node."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for pdf in pairs:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(root(x), x) for x in list(parent)]
    out = [(r, x) for r, x in out if r != x]
    return pd.DataFrame({"a": [r for r, _ in out], "b": [x for _, x in out]}, dtype="int64")


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= CONTRACT_ROWS:
            yield _forest(held)
            held, n = [], 0
    if held:
        yield _forest(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", salts: int = 2) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Edges are longs in any order; loops and repeats do no harm. Each partition first replaces its
    edges by spanning stars (as many edges as nodes at most). If ``CONTRACT_ROWS`` hold what is left, one
    task contracts it; else large-star and small-star rounds alternate until nothing changes. Every round is a join on salted keys, cut by a checkpoint;
    only a count and a checksum reach the driver.
    """
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")
    e = cut(e.mapInPandas(_contract, "a long, b long").distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    seen = mark(e)
    if 0 < seen[0] <= CONTRACT_ROWS:
        e, seen = cut(e.coalesce(1).mapInPandas(_contract, "a long, b long")), (0, None)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"], "inner", salts).where("v > u and v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = salted_join(large, least, ["b"], "inner", salts)
        small = hung.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        e = cut(small)
        if (now := mark(e)) == seen:
            break
        seen = now
    roots = e.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
