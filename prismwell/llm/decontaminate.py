"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: its ones are hashed, its zeros ignored, so a seed
still meets a passage in which words have been replaced. Hashes of the benchmark's seeds are joined
with those of the documents; around each hit the document's words are compared with the item's on
the same diagonal. The best stretch gains 1 for an equal word and loses a half for another; it
counts as an overlap from min(8, 0.45 of the item's words) on, 6 at least.

Documents are read once. A bit map of the benchmark's hashes, of bounded size whatever the
benchmark's, decides which windows can meet a seed; only stretches around those are shuffled, and
the join itself is exact.

Edge cases: null and empty texts overlap with nothing; items of fewer than 6 words cannot be told
from chance and are not searched; repeated rows and items give one result for each pair of ids,
equal items one for each; null ids are kept; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, cut, salted_join, text_bytes, whole_rows
from .filters import HashFilter
from .spans import as_long, batches_of, give_back, mixed, word_hashes, words_of

# fixed values: the seeds, each of weight 5; the first three fit a change of each fifth, fourth and third word
MASKS = ("111101", "111011", "1101101", "11001011", "1010011001")
MIN_WORDS, GAP_COST, FULL_SCORE, SCORE_SHARE, LEAST_SCORE = 6, 0.5, 8.0, 0.45, 6.0


#: Bits of the map for each seed hash: windows that pass by chance are one in a million.
MAP_SHARE = 512


def seed_hashes(words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes) of each mask's windows that lie in one text."""
    for k, mask in enumerate(MASKS):
        span, n = len(mask), len(words) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, k + 1, np.uint64)
        for at, bit in enumerate(mask):
            if bit == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[at : at + n]
        inside = np.flatnonzero(doc[:n] == doc[span - 1 :])
        yield inside, mixed(h[inside])


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, starts, ends, doc = words_of([t.translate(LOWER_AZ) for t in texts])
    return word_hashes(buf, starts, ends), doc


def stretch(equal: np.ndarray) -> tuple[float, int, int]:
    """(score, start, end) of the best stretch of a diagonal."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -GAP_COST))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.argmin(sums[: end + 1]))
    return float(sums[end] - sums[start]), start, end


def least_score(n_words: int) -> float:
    return max(LEAST_SCORE, min(FULL_SCORE, SCORE_SHARE * n_words))


def _benchmark_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["_text"].tolist()
        for first, group in batches_of(texts):
            words, doc = _hashed(group)
            begin = np.searchsorted(doc, np.arange(len(group)))
            long_enough = np.bincount(doc, minlength=len(group)) >= MIN_WORDS
            ids = pdf["item"].to_numpy()[first : first + len(group)]
            for at, h in seed_hashes(words, doc):
                ok = long_enough[doc[at]]
                at, h = at[ok], h[ok]
                yield pd.DataFrame({"item": ids[doc[at]], "ipos": (at - begin[doc[at]]).astype("int32"), "h": as_long(h)})


def _benchmark_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [as_long(_hashed([t])[0]) for t in pdf["_text"]]
        yield pd.DataFrame({"item": pdf["item"], "iwords": words})


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row for each document and item that overlap: ids, item_words, matched, overlap, score, start, text_hash.

    ``matched`` counts the equal words of the best stretch, ``overlap`` is their share of the item,
    ``start`` the stretch's first word in the document.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), text_bytes(item_text).alias("_text")).distinct()
    seeds = cut(items.mapInPandas(_benchmark_seeds, "item string, ipos int, h long").distinct())
    count = seeds.select("h").distinct().count()
    wanted = HashFilter.of(seeds.select("h").distinct(), count, share=MAP_SHARE)
    longest = items.agg(F.max(F.size(F.split(F.col("_text").cast("string"), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    margin = int(longest)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, text_hash = pdf["_id"].to_numpy(), pdf["text_hash"].to_numpy()
            for first, group in batches_of(pdf["_text"].tolist()):
                words, doc = _hashed(group)
                found = [(at[i], h[i]) for at, h in seed_hashes(words, doc) if len(i := np.flatnonzero(wanted.maybe(h)))]
                if not found:
                    continue
                at = np.concatenate([a for a, _ in found])
                h = np.concatenate([x for _, x in found])
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                # stretches: hits of one text no further apart than two margins
                cuts = np.flatnonzero((np.diff(at) > 2 * margin) | (np.diff(doc[at]) != 0)) + 1
                edge = np.searchsorted(doc, np.arange(len(group) + 1))
                rows = []
                for a, x in zip(np.split(at, cuts), np.split(h, cuts), strict=True):
                    d = doc[a[0]]
                    lo, hi = max(edge[d], a[0] - margin), min(edge[d + 1], a[-1] + margin + 1)
                    rows.append((ids[first + d], text_hash[first + d], int(lo - edge[d]), as_long(words[lo:hi].copy()), (a - lo).astype(np.int32), as_long(x)))
                yield pd.DataFrame(rows, columns=["_id", "text_hash", "lo", "words", "pos", "h"])
        give_back()

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text_bytes(text).alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    near = cut(rows.mapInPandas(scan, "_id string, text_hash long, lo int, words array<long>, pos array<int>, h array<long>").withColumn("part", F.xxhash64("_id", "text_hash", "lo")))
    hits = near.select("part", F.explode(F.arrays_zip("pos", "h")).alias("z")).select("part", "z.pos", "z.h")
    # a phrase of many documents and many items: its documents are dealt over tasks
    diagonals = salted_join(hits, seeds, ["h"], "inner", by=F.col("part")).select("part", "item", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                w, i = np.asarray(r.words), np.asarray(r.iwords)  # the words that lie beside the item
                lo = max(0, -r.shift)
                equal = w == i[lo : lo + len(w)]
                score, s, e = stretch(equal)
                if score >= least_score(len(i)):
                    m = int(equal[s:e].sum())
                    out.append((r.doc, r.text_hash, r.item, len(i), m, m / len(i), score, int(r.lo + lo + r.shift + s)))
            yield pd.DataFrame(out, columns=["doc", "text_hash", "item", "item_words", "matched", "overlap", "score", "start"])

    item_words = items.mapInPandas(_benchmark_words, "item string, iwords array<long>")
    texts = near.select(F.col("_id").alias("doc"), "text_hash", "lo", "words", "part").dropDuplicates(["part"])
    met = diagonals.join(texts, "part").join(item_words, "item")
    met = met.select("doc", "text_hash", "lo", F.expr("slice(words, greatest(shift, 0) + 1, least(size(iwords) + least(shift, 0), size(words)))").alias("words"), "shift", "item", "iwords")
    checked = met.mapInPandas(verify, "doc string, text_hash long, item string, item_words int, matched int, overlap double, score double, start int")
    best = checked.groupBy("doc", "text_hash", "item").agg(F.max(F.struct("score", "matched", -F.col("start"), "item_words", "overlap", "start")).alias("b"))
    return best.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("item").cast(benchmark.schema[item_col].dataType).alias(item_col), "b.item_words", "b.matched", "b.overlap", "b.score", "b.start", "text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that overlap with no item, told apart by id and text; columns may have any names."""
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    bad = overlaps(plain, benchmark, "_text", "_id").select(F.col("_id").alias("_bad"), F.col("text_hash").alias("_bad_hash")).distinct()
    keyed = docs.select(whole_rows(docs), F.col(id_col).alias("_id"), F.xxhash64(text_bytes(text)).alias("_hash"))
    clean = keyed.join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_hash") == F.col("_bad_hash")), "left_anti")
    return clean.select("_row.*")
