"""Importance resampling towards a target distribution of hashed n-grams.

Each task keeps an integer dictionary of the words it meets. The n-grams of a block of texts are tuples
of word ids, packed into one integer each; a block's distinct tuples are spelled out and hashed once, and
their buckets are joined back to the occurrences by the tuples' places. What leaves the task is a list of
buckets a document, written once in the shared folder: no n-gram is shuffled. Bucket counts of corpus and
target are summed in Spark, give each bucket's gain, and a second pass over the written lists sums a
document's gains. Eligible documents are then sorted by score in ranges, and a range's first rank is the
number of rows in the ranges before it.

Edge cases: a null or empty text has no features, weight 0 and no rank; a text of any length is cut at
word bounds into pieces of bounded size, which overlap by two words; a null id counts as the text '';
repeated rows are scored and drawn each; ties go to smaller ids, then to earlier rows; an empty target
or corpus gives defined gains, as every bucket is smoothed; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch_path, text_bytes
from .spans import give_back

#: Bits of a word's id in a tuple, and words at which a task begins a new dictionary.
ID_BITS, MAX_WORDS = 21, 1 << 20
#: Bytes of text handled at a time.
PIECE_BYTES = 1 << 20
#: A range's number stands above the row's place in it.
RANGE_BITS = 33
# A-Z to a-z; ASCII letters, digits and all bytes beyond ASCII stay, the rest ends a word
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


class WordIds(dict):
    """word -> id, given in order of arrival; ``words`` leads back."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def pieces_of(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The folded words of a text, in runs of some ``size`` bytes cut between words."""
    at = 0
    while at < len(text):
        end = at + size
        if end >= len(text):
            yield text[at:].translate(_FOLD).split()
            return
        piece = text[at:end].translate(_FOLD)
        kept = piece.rfind(b" ")
        while kept < 0:  # a word longer than a piece
            more = text[end : end + size]
            end += size
            piece += more.translate(_FOLD)
            kept = len(piece) if end >= len(text) else piece.rfind(b" ")
        yield piece[:kept].split()
        at += max(kept, 1)


class Hasher:
    """Buckets of the runs of 1 to ``n`` words, by a dictionary of this task."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self._fresh()

    def _fresh(self) -> None:
        self.ids, self.single = WordIds(), np.zeros(0, np.uint16)

    def _spelled(self, tuples: np.ndarray, n: int) -> np.ndarray:
        """The bucket of each tuple, from its words' bytes."""
        words, low = self.ids.words, (1 << ID_BITS) - 1
        parts = [(tuples >> (ID_BITS * (n - 1 - k)) & low).tolist() for k in range(n)]
        said = (b" ".join([words[i] for i in t]) for t in zip(*parts, strict=True))
        return np.fromiter((zlib.crc32(s) % self.buckets for s in said), np.uint16, len(tuples))

    def of_block(self, runs: list[list[bytes]]) -> list[np.ndarray]:
        """For each run of words, the buckets of its n-grams, one for each occurrence: words, then pairs, then triples."""
        if len(self.ids.words) > MAX_WORDS:
            self._fresh()
        lengths = np.array([len(r) for r in runs])
        ids = np.fromiter((i for r in runs for i in map(self.ids.__getitem__, r)), np.int64, int(lengths.sum()))
        if len(new := self.ids.words[len(self.single) :]):
            self.single = np.concatenate([self.single, np.fromiter((zlib.crc32(w) % self.buckets for w in new), np.uint16, len(new))])
        owner = np.repeat(np.arange(len(runs)), lengths)
        out, key = [(owner, self.single[ids])], ids
        for n in (2, 3):
            if len(ids) < n:
                break
            key = key[:-1] << ID_BITS | ids[n - 1 :]
            inside = np.flatnonzero(owner[: len(key)] == owner[n - 1 :])
            distinct, place = np.unique(key[inside], return_inverse=True)
            out.append((owner[inside], self._spelled(distinct, n)[place]))
        who, found = np.concatenate([w for w, _ in out]), np.concatenate([b for _, b in out])
        order = np.argsort(who, kind="stable")
        return np.split(found[order], np.cumsum(np.bincount(who, minlength=len(runs)))[:-1])


def _features(texts: list[bytes], hasher: Hasher) -> list[tuple[int, np.ndarray]]:
    """(words, buckets) of each text; blocks of several short texts, or a part of a long one."""
    words, found = [0] * len(texts), [[] for _ in texts]
    runs: list[list[bytes]] = []
    whose: list[tuple[int, int]] = []
    held = 0

    def flush() -> None:
        for (i, again), run, buckets in zip(whose, runs, hasher.of_block(runs), strict=True):
            # the words carried over from the part before were counted there, and so were their pair
            skip = np.ones(len(buckets), bool)
            skip[:again] = False
            if again == 2:
                skip[len(run)] = False
            found[i].append(buckets[skip])
        runs.clear(), whose.clear()

    for i, text in enumerate(texts):
        carried: list[bytes] = []
        for piece in pieces_of(text):
            words[i] += len(piece)
            runs.append([*carried, *piece])
            whose.append((i, len(carried)))
            carried = runs[-1][-2:]
            held += len(piece)
            if held >= PIECE_BYTES // 8:
                flush()
                held = 0
    if runs:
        flush()
    none = np.zeros(0, np.uint16)
    return [(n, np.concatenate(f) if f else none) for n, f in zip(words, found, strict=True)]


def hashed_features(texts: DataFrame, path: str, buckets: int = 10_000, text: str = "text", id_col: str | None = None) -> DataFrame:
    """Writes, and reads back, per row: _id, n_words and ``_buckets``, one unsigned 16-bit number for each feature."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered with 16 bits")
    key = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(buckets)
        for pdf in batches:
            found = _features(pdf["_text"].tolist(), hasher)
            yield pd.DataFrame({"_id": pdf["_id"], "n_words": [n for n, _ in found], "_buckets": [b.tobytes() for _, b in found]})
        give_back()

    rows = texts.select(key.alias("_id"), text_bytes(text).alias("_text")).mapInPandas(hashed, "_id string, n_words long, _buckets binary")
    rows.write.parquet(path)
    return texts.sparkSession.read.parquet(path)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features lie in each bucket; a task sends one row for each bucket, the driver gets their sums."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for b in pdf["_buckets"]:
                total += np.bincount(np.frombuffer(b, np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = features.select("_buckets").mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+K) / ((s+1)(T+K)))) of each of the K buckets."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(_id, n_words, n_features, weight): the sum of the gains of each row's features."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.frombuffer(b, np.uint16) for b in pdf["_buckets"]]
            yield pd.DataFrame({"_id": pdf["_id"], "n_words": pdf["n_words"], "n_features": [len(b) for b in found], "weight": [int(gain[b].sum()) for b in found]})

    return features.select("_id", "n_words", "_buckets").mapInPandas(summed, "_id string, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, drawn: int, by: list) -> DataFrame:
    """Adds ``rank`` (1, 2, 3 ... in the order of ``by``, null beyond ``drawn``) without one sorted partition.

    Rows are sorted in ranges and written; a range starts after the rows of those before it, whose
    counts, one a range, are all that reaches the driver.
    """
    spark = scored.sparkSession
    placed = cut(scored.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_pos", RANGE_BITS).alias("range")).count().collect()
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r["range"]):
        before.append((r["range"], total))
        total += r["count"]
    if not before:
        return placed.withColumn("rank", F.lit(None).cast("long")).drop("_pos")
    starts = F.broadcast(spark.createDataFrame(before, "_range long, _before long"))  # one row a range
    at = placed.withColumn("_range", F.shiftright("_pos", RANGE_BITS)).join(starts, "_range")
    rank = F.col("_before") + F.col("_pos").bitwiseAND((1 << RANGE_BITS) - 1) + 1
    return at.withColumn("rank", F.when(rank <= drawn, rank)).drop("_pos", "_range", "_before")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", target_text: str = "text", buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row per document: id, n_features, weight, score and rank; drawn are those with a rank.

    The score adds to the weight a Gumbel variate, of a hash of seed and id, so that the highest scores
    are a draw without replacement in proportion to the exponentials of the weights.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    features = hashed_features(docs, scratch_path(spark, "features"), buckets, text, id_col)
    wanted = hashed_features(target, scratch_path(spark, "target-features"), buckets, target_text)
    rows = weighed(features, gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("_id", F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = rows.select(F.col("_id").cast(id_type).alias(id_col), "n_words", "n_features", "weight", score.cast("long").alias("score"))
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = percent * features.where(F.col("n_words") >= least_words).count() // 100
    # equal rows stay apart by their place in the table, so that no range is bound to hold them all
    order = [F.col("score").desc(), F.col(id_col).asc(), F.col("_n").asc()]
    chosen = ranked(eligible.withColumn("_n", F.monotonically_increasing_id()), drawn, order)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [id_col, "n_features", "weight", "score", "rank"]
    return chosen.select(*columns).union(rest.select(*columns))
