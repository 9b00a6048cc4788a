"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. To find all
fingerprints within ``max_distance`` bits, each is cut into segments so few that a pair within
reach agrees on some segment up to one bit. One table holds every segment as it is; probes hold
every segment of the small Hamming ball, of which only the members with one bit cleared are needed:
of two segments that differ in one bit, one has it set. Matches are verified over all 64 bits.

Edge cases: null and blank texts have fingerprint zero and link like any other; repeated rows and
ties share a component, whose id is its least doc_id; rows with a null doc_id get a fingerprint and
the component of its fingerprint; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, connected_components, cut, salted_join, text_bytes
from .spans import mixed

#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Fingerprints with one segment value above which a bucket is split by the rest of the bits.
HEAVY_BUCKET = 256


def fingerprints(data: bytes, words: int = 3, functions: int = 1) -> list[int]:
    """64-bit SimHashes of a text's word shingles, as signed integers.

    The first is of the shingles' XXH64; each further one is of those hashes mixed anew.
    """
    tokens = data.translate(LOWER_AZ).split()
    n = len(tokens)
    if not n:
        return [0] * functions
    buf = b" ".join(tokens)
    if n <= words:
        spans = [(0, len(buf))]
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        spans = list(zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True))
    counts = np.zeros((functions, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), BLOCK):
        first = np.array([digest(buf[s:e], 42) for s, e in spans[at : at + BLOCK]], np.uint64)
        for f in range(functions):
            h = first if f == 0 else mixed(first * np.uint64(2 * f + 1))
            counts[f] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(spans), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def fingerprint(data: bytes, words: int = 3) -> int:
    """The SimHash of the shingles' XXH64."""
    return fingerprints(data, words)[0]


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash", words: int = 3, functions: int = 1) -> DataFrame:
    """``docs`` with an array ``out`` of the fingerprints of each whole text."""

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprints(t, words, functions))

    return docs.withColumn(out, hashed(text_bytes(text)))


def fingerprint_links(fps: DataFrame, max_distance: int = 3, heavy: int = HEAVY_BUCKET) -> DataFrame:
    """(x, y) with x < y: all pairs of distinct fingerprints at most ``max_distance`` bits apart.

    ``fps`` has one column ``fp`` of distinct longs. Segment values that over ``heavy`` fingerprints
    share are split further: the other bits are cut into ``max_distance`` + 1 parts, one of which
    agrees in any pair within reach. No pair is lost by it.
    """
    m = max(1, (max_distance + 2) // 2)  # with so many segments one differs in one bit at most
    width = -(-64 // m)
    widths = [min(width, 64 - i * width) for i in range(m)]
    segment = lambda i: F.expr(f"shiftrightunsigned(fp, {i * width}) & {(1 << widths[i]) - 1 if widths[i] < 64 else -1}L")
    exact = F.array(*[F.struct(F.lit(i).alias("s"), segment(i).alias("v")) for i in range(m)])
    cleared = F.array(*[F.when(F.expr(f"shiftrightunsigned(fp, {i * width + j}) & 1L") == 1, F.struct(F.lit(i).alias("s"), segment(i).bitwiseXOR(F.lit(1 << j).cast("long")).alias("v"))) for i in range(m) for j in range(widths[i])])
    table = fps.select("fp", F.inline(exact))
    probes = fps.select(F.col("fp").alias("fq"), F.inline(exact)).withColumn("same", F.lit(True))
    probes = probes.union(fps.select("fp", F.inline(F.array_compact(cleared))).withColumn("same", F.lit(False)))
    keys = ["s", "v"]
    hot = cut(table.groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("s", "v", F.lit(True).alias("hot")))
    if not hot.isEmpty():
        parts = max_distance + 1
        size = -(-64 // parts)

        def split(df: DataFrame, fp: str) -> DataFrame:
            # a part that lies in the shared segment agrees anyway, so each part is taken from the other bits alone
            other = f"({fp} & ~shiftleft({(1 << width) - 1}L, s * {width}))" if m > 1 else fp
            rest = f"(shiftrightunsigned({other}, s * {width}) | shiftleft({other}, 64 - s * {width}))" if m > 1 else fp
            rest = f"shiftrightunsigned({rest}, {width})" if m > 1 else rest
            size_of = -(-(64 - width) // parts) if m > 1 else size
            part = [F.struct(F.lit(i).alias("p"), F.expr(f"shiftrightunsigned({rest}, {i * size_of}) & {(1 << size_of) - 1}L").alias("w")) for i in range(parts)]
            whole = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("long").alias("w")))
            marked = salted_join(df, hot, ["s", "v"])
            return marked.select(*df.columns, F.inline(F.when(F.col("hot"), F.array(*part)).otherwise(whole)))

        table, probes, keys = split(table, "fp"), split(probes, "fq"), [*keys, "p", "w"]
    met = probes.join(table, keys).where((F.col("fq") < F.col("fp")) | (~F.col("same") & (F.col("fq") != F.col("fp"))))
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fq"))) <= max_distance)
    return near.select(F.least("fp", "fq").alias("x"), F.greatest("fp", "fq").alias("y")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, max_distance: int = 3, functions: int = 1) -> DataFrame:
    """Per row of ``docs``: its id, fingerprint (16 hex digits), component_id and n_same.

    Rows with the same fingerprints form a class of ``n_same``; only classes are compared, so copies
    cost no pairs. With several ``functions`` texts link if any of their fingerprints do, which finds
    more of the copies with several edits.
    """
    rows = cut(with_fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", "fps", words, functions).select("_id", "fps"))
    classes = cut(rows.groupBy("fps").agg(F.min("_id").cast("long").alias("rep"), F.count("*").alias("n_same")))
    edges = None
    for f in range(functions):
        led = classes.groupBy(F.col("fps")[f].alias("fp")).agg(F.min("rep").alias("lead"))
        led = cut(led) if functions > 1 else led
        links = fingerprint_links(led.select("fp"), max_distance)
        found = links.join(led.select(F.col("fp").alias("x"), F.col("lead").alias("a")), "x").join(led.select(F.col("fp").alias("y"), F.col("lead").alias("b")), "y").select("a", "b")
        if functions > 1:
            same = salted_join(classes.select(F.col("fps")[f].alias("fp"), "rep"), led, ["fp"], "inner", salts=2).where("rep != lead")
            found = found.union(same.select("lead", "rep"))
        edges = found if edges is None else edges.union(found)
    parts = connected_components(edges.where("a is not null and b is not null"))
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("fps", "n_same", F.coalesce("component", "rep").alias("component_id"))
    return salted_join(rows, named, ["fps"], salts=2).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def keep_one_per_group(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, max_distance: int = 3, functions: int = 1) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the least id.

    Of repeated rows with that id one stays; rows with a null id stay as they are.
    """
    found = near_duplicates(docs, text, id_col, words, max_distance, functions)
    kept = cut(found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("_n")))
    best = docs.join(kept.select(id_col), id_col, "left_semi")
    if not kept.where("_n > 1").isEmpty():
        best = best.dropDuplicates([id_col])
    return best.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
