"""Near copies by word shingles: SimHash segments propose pairs, their true Jaccard similarity decides.

A bit of two SimHashes of sets with similarity s differs with a chance that only s bounds, so the
number of segments, and with it that of the fingerprint functions, follows from the recall asked for.
Segments are about as long as the table's row count needs for chance buckets to stay small; pairs
that share one are kept if an independent fingerprint is near, and then verified by their shingles.

In a bucket each member is first compared with a leader only; segments take turns at some orders of
the documents, so a group has several leaders. The orders follow one another, and pairs that are linked
already are not verified again. Pairs of sets whose sizes alone rule a similarity out are dropped. Where that leaves several components, all pairs of
different components follow, so no link between components is lost. In large buckets their sets decide
where they meet: each is told by the shingles that it shares with one set of the bucket, a bit each, and
those that it has beside it, so that only links leave the join and texts edited beyond the threshold make no rows.

Edge cases: null and blank texts have the empty set and are copies of one another; a text of fewer
words than a shingle is one shingle; rows with a null id stay; repeated rows keep one, and rows of one
id with different texts count as different; ties go to the least id; texts of any length are hashed in
whole; an empty table gives no rows; extra columns are handed on and clash with none used here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, connected_components, cut, salted_join, stored, text_bytes, whole_rows
from .spans import as_long, batches_of, give_back, mixed, range_hashes, prefix_sums, rolling_hashes, word_hashes, words_of

#: Shingles whose bits are counted at a time.
BLOCK = 4096
#: The greatest chance that a bit differs at similarity 0.8: the limit for large sets is
#: acos(0.8 / 0.9) / pi = 0.1515, sets of 14 against 13 shingles have the most, 0.1612 (4 against 5, with 0.1875, are linked exactly).
FLIP = 0.1612
#: Similarity that FLIP belongs to.
LEAST = 0.8
#: Orders by which leaders of buckets are chosen.
LEADERS = 4
#: Members beyond which a bucket is large, and sets compared in it.
LARGE = 4


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The different hashes of each text's word shingles, in order; a text of fewer words is one shingle."""
    out: list[np.ndarray] = []
    for _, run in batches_of([t.translate(LOWER_AZ) for t in texts]):
        buf, starts, ends, of = words_of(run)
        hashes = word_hashes(buf, starts, ends)
        cuts = np.searchsorted(of, np.arange(len(run) + 1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = hashes[lo:hi]
            if hi - lo >= words:
                own = rolling_hashes(own, words)
            elif hi > lo:
                own = range_hashes(prefix_sums(own), np.array([0]), np.array([hi - lo]))
            out.append(np.unique(own))
    return out


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in each row of ``h``: words are added as bit planes, three to two."""
    total, weight = np.zeros((len(h), 64), np.int64), 1
    while h.shape[1]:
        carries = []
        while (n := h.shape[1]) > 2:
            k = n // 3
            a, b, c = h[:, :k], h[:, k : 2 * k], h[:, 2 * k : 3 * k]
            x = a ^ b
            carries.append((a & b) | (x & c))
            h = np.concatenate([x ^ c, h[:, 3 * k :]], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), n, 8), axis=2, bitorder="little")
        total += weight * bits.sum(1, dtype=np.int64)
        h, weight = (np.concatenate(carries, axis=1) if carries else h[:, :0]), 2 * weight
    return total


def signature(shingles: np.ndarray, functions: int) -> np.ndarray:
    """SimHashes of a set, one for each function, as signed longs."""
    factors = (2 * np.arange(functions, dtype=np.uint64) + np.uint64(1))[:, None]
    counts = np.zeros((functions, 64), np.int64)
    for at in range(0, len(shingles), BLOCK):
        counts += bit_counts(mixed(shingles[at : at + BLOCK] * factors))
    return np.packbits(counts * 2 > len(shingles), axis=1, bitorder="little").view(np.int64).ravel()


def radius_for(bits: int, loss: float, flip: float = FLIP) -> int:
    """How many of so many bits differ at most in a pair at ``flip``, but for this chance; from the binomial distribution."""
    radius, log_choose = 0, 0.0
    within = (1 - flip) ** bits
    while 1 - within > loss and radius < bits:
        radius += 1
        log_choose += math.log((bits - radius + 1) / radius)
        within += math.exp(log_choose + radius * math.log(flip) + (bits - radius) * math.log1p(-flip))
    return radius


def segments_for(rows: int, recall: float) -> tuple[int, int, int]:
    """(bits of a segment, segments, radius of the independent fingerprint) for pairs at FLIP.

    Segments may lose nine tenths of 1 - ``recall``, the radius a twentieth.
    """
    width = min(32, max(12, rows.bit_length() + 1))
    number = math.ceil(math.log(0.9 * (1 - recall)) / math.log1p(-((1 - FLIP) ** width)))
    return width, number, radius_for(64, 0.05 * (1 - recall))


def with_signatures(docs: DataFrame, functions: int, words: int) -> DataFrame:
    """``_id``, ``_h``, the set's size ``n``, its digest ``d1``, ``d2`` (sums over the shingles), ``fps``, and ``less``.

    ``less`` has the digests of a set of five without each of its shingles.
    """

    @F.pandas_udf("n long, d1 long, d2 long, fps array<long>, less array<struct<d1:long,d2:long>>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for s in shingle_sets(list(texts), words):
            terms = np.stack([mixed(s * np.uint64(0x9E3779B97F4A7C15)), mixed(s * np.uint64(0xC2B2AE3D27D4EB4F))])
            d = terms.sum(1, dtype=np.uint64)
            less = [{"d1": int(x), "d2": int(y)} for x, y in as_long(d[:, None] - terms).T] if len(s) == 5 else []
            rows.append((len(s), *as_long(d).tolist(), signature(s, functions), less))
        give_back()
        return pd.DataFrame(rows, columns=["n", "d1", "d2", "fps", "less"])

    return docs.withColumn("_s", signed("_text")).select("_id", "_h", "_s.*")


def with_sets(classes: DataFrame, ids: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(_id, s): the shingle sets, as sorted arrays, of the classes that ``ids`` (_id) names; only their texts move."""

    @F.pandas_udf("array<long>")
    def hashed(t: pd.Series) -> pd.Series:
        return pd.Series([as_long(s) for s in shingle_sets(list(t), words)], dtype=object)

    rows = classes.select("rep", "row.*").join(ids.withColumnRenamed("_id", "rep"), "rep", "left_semi")
    found = texts.join(rows, ["_id", "_h"]).select("rep", "_text").dropDuplicates(["rep"])
    return found.select(F.col("rep").alias("_id"), hashed("_text").alias("s"))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets in ``sets`` (_id, s) have a Jaccard similarity of ``least`` or more."""
    both = pairs.join(sets.select(F.col("_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("_id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return cut(both.where(shared >= least * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b"))


def told_by_base(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, base, told) of ``pairs`` (rep, base): the set of ``rep`` as bits, one for each shingle of ``base`` that it shares, and the rest."""

    @F.pandas_udf("shared array<long>, rest array<long>")
    def parted(own: pd.Series, base: pd.Series) -> pd.DataFrame:
        rows = []
        for s, b in zip(own, base, strict=True):
            bits = np.zeros(-(-len(b) // 64) * 64, bool)
            bits[: len(b)] = np.isin(b, s, assume_unique=True)
            rows.append((np.packbits(bits).view(np.int64), np.setdiff1d(s, b, assume_unique=True)))
        return pd.DataFrame(rows, columns=["shared", "rest"])

    both = pairs.join(sets.select(F.col("_id").alias("rep"), F.col("s").alias("own")), "rep")
    both = salted_join(both, sets.select(F.col("_id").alias("base"), F.col("s").alias("of")), ["base"], "inner", salts=2, by=F.col("rep"))
    return both.select("rep", "base", parted("own", "of").alias("told"))


def links_of_large(rows: DataFrame, sets: DataFrame, apart: Column, least: float) -> DataFrame:
    """(a, b): the pairs of ``rows`` (rep, base, n, fp, key, part, main) that meet ``apart``, on the sides x and y, and whose sets are similar."""
    told = stored(told_by_base(rows.select("rep", "base").distinct(), sets))
    rows = salted_join(rows, told, ["rep", "base"], "inner", salts=2)
    x, y = rows.where("not main").alias("x"), rows.alias("y")
    bits = F.aggregate(F.zip_with("x.told.shared", "y.told.shared", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda total, n: total + n)
    n = F.col("x.n") + F.col("y.n")
    similar = lambda shared: shared >= least * (n - shared) - 1e-9
    most = bits + F.least(F.size("x.told.rest"), F.size("y.told.rest"))
    shared = bits + F.size(F.array_intersect("x.told.rest", "y.told.rest"))
    once = F.col("y.main") | (F.col("x.rep") < F.col("y.rep"))
    return x.join(y, apart & once & similar(most) & similar(shared)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def near_copy_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, least: float = LEAST, recall: float = 0.99) -> DataFrame:
    """(id, component_id) of all rows with an id: components of the pairs at Jaccard ``least`` or more.

    Pairs are found with a chance of ``recall`` at least; ``least`` must not be below 0.8.
    """
    if least < LEAST:
        raise ValueError(f"the chance of a differing bit is derived for a similarity of {LEAST} or more")
    return _grouped(docs, text, id_col, words, least, recall).select(F.col("_id").alias(id_col), "component_id")


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(_id, _h, _text) of the rows with an id: rows of one id are told apart by their texts' hash."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), text_bytes(text).alias("_text"))
    return rows.select("_id", F.xxhash64("_text").alias("_h"), "_text")


def _grouped(docs: DataFrame, text: str, id_col: str, words: int, least: float, recall: float) -> DataFrame:
    """(_id, _h, component_id, kept): of each row its group's least id, and whether it is the row that stays."""
    texts = _keyed(docs, text, id_col)
    width, number, radius = segments_for(docs.count(), recall)
    per = 64 // width
    functions = -(-number // per) + 1
    rows = cut(with_signatures(texts, functions, words))
    digest = ["d1", "d2"]
    classes = rows.groupBy(*digest).agg(F.min(F.struct("_id", "_h")).alias("row"), F.first("n").alias("n"), F.first("fps").alias("fps"), F.first("less").alias("less"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))  # a class's number

    mask = (1 << width) - 1
    key = F.expr(f"transform(sequence(0L, {number - 1}L), i -> shiftleft(i, {width}) | (shiftrightunsigned(fps[int(i div {per})], int((i % {per}) * {width})) & {mask}L))")
    banded = classes.where("n > 0").select("rep", "n", F.element_at("fps", -1).alias("fp"), F.explode(key).alias("key"))
    bucket = Window.partitionBy("key")
    turn = F.expr(f"shiftright(key, {width}) % {LEADERS}")
    order = F.xxhash64("rep", turn).alias("order")
    met = banded.select("*", F.count("*").over(bucket).alias("k"), F.min(F.struct(order, "rep", "fp", "n")).over(bucket).alias("lead")).where("k > 1")
    # as a table, by bucket: keys and leaders are the same row after row, and take next to no room
    met = stored(met.select("rep", F.col("n").cast("int").alias("n"), "fp", "key", F.col("k").cast("int").alias("k"), F.struct("lead.rep", "lead.fp", F.col("lead.n").cast("int").alias("n")).alias("lead")))
    # sets of m and n shingles share min(m, n) at most, of max(m, n) at least
    sizes = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius
    led = met.where(near("fp", "lead.fp") & sizes("n", "lead.n") & (F.col("rep") != F.col("lead.rep"))).select(turn.alias("turn"), F.least("lead.rep", "rep").alias("a"), F.greatest("lead.rep", "rep").alias("b"))
    stars = stored(led.groupBy("a", "b").agg(F.min("turn").alias("turn")))
    small = classes.where("n = 5").select(F.col("rep").alias("a"), F.inline("less")).join(classes.where("n = 4").select(F.col("rep").alias("b"), *digest), digest).select("a", "b")
    # texts move twice in all: for the sets of what leaders meet, and for those of what is left
    of_pairs = lambda pairs: pairs.select(F.col("a").alias("_id")).union(pairs.select("b"))
    sets = stored(with_sets(classes, of_pairs(stars).distinct(), texts, words))
    edges, parts = stored(small), None
    for t in range(LEADERS):  # what an earlier leader has linked is not verified again
        some = stars.where(F.col("turn") == t).select("a", "b")
        if parts is not None:
            of = lambda n: parts.select(F.col("rep").alias(n), F.col("component").alias(f"_{n}"))  # noqa: B023, E731
            some = salted_join(salted_join(some, of("a"), ["a"]), of("b"), ["b"]).where("_a is null or _b is null or _a <> _b").select("a", "b")
        edges = stored(edges.union(verified(stored(some), sets, least)))
        parts = stored(connected_components(edges).withColumnRenamed("node", "rep"))

    more = met.where("k > 2").select("rep", "n", "fp", "key", "k")
    more = salted_join(more, parts, ["rep"]).select("rep", "n", "fp", "key", "k", F.coalesce("component", "rep").alias("part"))
    size = more.select("*", F.count("*").over(Window.partitionBy("key", "part")).alias("size"))
    most = F.max(F.struct("size", "part")).over(bucket)
    base = F.col("most.part")
    split = size.select("*", most.alias("most"), F.min("part").over(bucket).alias("low"), F.max("part").over(bucket).alias("high")).where("low < high")
    split = stored(split.select("rep", "n", "fp", "key", "k", "part", (F.col("part") == base).alias("main"), base.alias("base")))
    large = F.col("k") > LARGE
    met_by = lambda x, y: sizes(f"{x}.n", f"{y}.n") & near(f"{x}.fp", f"{y}.fp")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part")) & met_by("x", "y")
    few, many = split.where(~large), split.where(large)
    across = few.where("not main").alias("x").join(few.alias("y"), apart).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    across = stored(across.join(stars, ["a", "b"], "left_anti"))
    many = stored(many.alias("x").join(many.alias("y"), apart, "left_semi"))  # members that meet another part
    named_in = of_pairs(across).union(many.select("rep")).union(many.select("base")).distinct()
    sets = stored(with_sets(classes, named_in, texts, words))
    parts = connected_components(edges.union(links_of_large(many, sets, apart, least)).union(verified(across, sets, least)))
    named = stored(classes.join(parts, classes["rep"] == parts["node"], "left").select(*digest, "row", F.coalesce("component", "rep").alias("part")))
    stays = named.groupBy("part").agg(F.min("row").alias("first"))
    named = salted_join(named, stays, ["part"]).select(*digest, "first")
    every = salted_join(rows.select("_id", "_h", *digest), named, digest, salts=2)
    return every.select("_id", "_h", F.col("first._id").alias("component_id"), ((F.col("_id") == F.col("first._id")) & (F.col("_h") == F.col("first._h"))).alias("kept"))


def keep_one_per_group(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, least: float = LEAST, recall: float = 0.99) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the least id, of one id's texts that with the least hash.

    Of repeated rows one stays; rows of one id with different texts are rows of their own; rows with a null id stay as they are.
    """
    found = _grouped(docs, text, id_col, words, least, recall)
    kept = cut(found.where("kept").groupBy("_id", "_h").agg(F.count("*").alias("_n")))
    told = docs.where(F.col(id_col).isNotNull()).select(whole_rows(docs), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_bytes(text)).alias("_h"))
    best = told.join(kept.select("_id", "_h"), ["_id", "_h"], "left_semi")
    if not kept.where("_n > 1").isEmpty():
        best = best.dropDuplicates(["_id", "_h"])
    return best.select("_row.*").unionByName(docs.where(F.col(id_col).isNull()))
