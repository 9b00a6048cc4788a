"""Language-model scores by subword lattices.

A text is its words, lower-cased A-Z, and an end. A word's probability is the sum over all of its
segmentations into pieces of an existing vocabulary, the last of which is a word-final piece; the
pieces' probabilities are learned from the training texts by expectation maximisation over the same
lattices. The forward recursion runs in log space over all words of one length at a time.

Each distinct word is weighed once, wherever it occurs. Word counts and piece counts come from all
training texts. A word's share of a text's score reaches the text in one of two ways with the same
result: the ``head`` most frequent words as a broadcast table of bounded size (long ones by their
digests), all others by a join on the word. What is joined is no more frequent than the least word of
the head, so no key of that join is hot.

Edge cases: null and blank texts are an end alone; repeated rows count and are scored each; a null
id has the remainder of the empty text; without training texts every piece is equally likely; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import digests
from .common import LOWER_AZ, crc_mod, salted_join, scratch_path, text_bytes
from .suffix_dedup import text_digest

#: Words of the broadcast table, and the longest that stand in it as they are, in bytes: 16 MB at most.
HEAD_WORDS, HEAD_BYTES = 1 << 18, 64
#: Rounds of expectation maximisation, and what is added to every piece's expected count.
ROUNDS, SMOOTHING = 2, 0.5
#: Different words that a task counts before it hands them on.
COUNTED_WORDS = 300_000
#: Bytes of words in one lattice computation.
LATTICE_BYTES = 1 << 17
_LN10 = float(np.log(10.0))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS, _PREFIX_BITS = 18, 22


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(bytes of each piece, whether it ends a word), in the order of the vocabulary's ids."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    suffix, letters = model["end_of_word_suffix"], byte_alphabet()
    pieces, final = [], []
    for piece in sorted(model["vocab"], key=model["vocab"].get):
        ends = piece.endswith(suffix)
        body = piece[: -len(suffix)] if ends else piece
        if body and all(c in letters for c in body):
            pieces.append(bytes(letters[c] for c in body))
            final.append(ends)
    return pieces, np.array(final)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Lattice:
    """Forward and backward sums over all segmentations of words into pieces."""

    def __init__(self, path: str):
        self.pieces, self.final = vocabulary(path)
        self.longest = max(map(len, self.pieces))
        # open addressing, a table for inner and one for final pieces
        size = 1 << _TABLE_BITS
        self.keys = np.zeros((2, size), np.uint64)
        self.slots = np.full((2, size), -1, np.int32)
        self.probes = 1
        self.begun = np.zeros(1 << _PREFIX_BITS, bool)  # whether a piece may go on after what hashes to this
        hashes = np.zeros(len(self.pieces), np.uint64)
        for n in {len(p) for p in self.pieces}:
            at = [i for i, p in enumerate(self.pieces) if len(p) == n]
            b = np.frombuffer(b"".join(self.pieces[i] for i in at), np.uint8).reshape(-1, n)
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = h * _MULTIPLIER + b[:, j].astype(np.uint64) + np.uint64(1)
                if j < n - 1:
                    self.begun[(_mixed(h) >> np.uint64(64 - _PREFIX_BITS)).astype(np.int64)] = True
            hashes[at] = _mixed(h)
        for i, h in enumerate(hashes.tolist()):
            side, at, steps = int(self.final[i]), h >> (64 - _TABLE_BITS), 1
            while self.slots[side, at] >= 0:
                at, steps = (at + 1) & (size - 1), steps + 1
            self.keys[side, at], self.slots[side, at] = h, i
            self.probes = max(self.probes, steps)

    def uniform(self) -> np.ndarray:
        """A start: probabilities that fall with the place in the vocabulary, which is by frequency."""
        p = 1.0 / (np.arange(len(self.pieces) + 1) + 100.0)
        return np.log(p / p.sum())

    def _lookup(self, h: np.ndarray, side: np.ndarray) -> np.ndarray:
        """The piece of each mixed hash, or -1; ``side`` tells inner from final pieces."""
        at = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        slot = self.slots[side, at]
        found = np.where(self.keys[side, at] == h, slot, -1)
        more = np.flatnonzero((found < 0) & (slot >= 0))
        for _ in range(self.probes - 1):
            if not len(more):
                break
            at[more] = (at[more] + 1) & ((1 << _TABLE_BITS) - 1)
            slot = self.slots[side[more], at[more]]
            hit = (self.keys[side[more], at[more]] == h[more]) & (slot >= 0)
            found[more[hit]] = slot[hit]
            more = more[~hit & (slot >= 0)]
        return found

    def arcs(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, starts, pieces) for each piece length: all pieces at all places. Words have one length.

        A place is followed no further once what it reads is the beginning of no piece.
        """
        m, n = words.shape
        letters = words.astype(np.uint64) + np.uint64(1)
        row = np.repeat(np.arange(m, dtype=np.int32), n)
        start = np.tile(np.arange(n, dtype=np.int32), m)
        h = np.zeros(m * n, np.uint64)
        out = []
        for size in range(1, min(n, self.longest) + 1):
            h = h * _MULTIPLIER + letters[row, start + (size - 1)]
            x = _mixed(h)
            ids = self._lookup(x, (start + size == n).astype(np.int8))
            some = ids >= 0
            out.append((row[some], start[some], ids[some]))
            on = self.begun[(x >> np.uint64(64 - _PREFIX_BITS)).astype(np.int64)] & (start + size < n)
            row, start, h = row[on], start[on], h[on]
            if not len(row):
                break
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray], m: int) -> np.ndarray:
        if len(terms) < 2:
            return terms[0] if terms else np.full(m, -np.inf)
        t = np.stack(terms)
        top = t.max(axis=0)
        t -= np.where(np.isfinite(top), top, 0.0)
        return top + np.log(np.exp(t, out=t).sum(axis=0))

    def weights(self, arcs: list[tuple], logp: np.ndarray, m: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each piece length: (log probabilities by start and word, how many arcs each start has)."""
        out = []
        for size, (row, start, ids) in enumerate(arcs, 1):
            w = np.full((n - size + 1, m), -np.inf)
            w[start, row] = logp[ids]
            out.append((w, np.bincount(start, minlength=n - size + 1)))
        return out

    def forward(self, weights: list[tuple], m: int, n: int) -> np.ndarray:
        """Log sums over all segmentations up to each place, by place and word."""
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0.0
        with np.errstate(divide="ignore"):
            for j in range(1, n + 1):
                alpha[j] = self._sum([alpha[j - s] + w[j - s] for s, (w, many) in enumerate(weights[:j], 1) if many[j - s]], m)
        return alpha

    def backward(self, weights: list[tuple], m: int, n: int) -> np.ndarray:
        """The same from each place to the end."""
        beta = np.full((n + 1, m), -np.inf)
        beta[n] = 0.0
        with np.errstate(divide="ignore"):
            for i in range(n - 1, -1, -1):
                beta[i] = self._sum([w[i] + beta[i + s] for s, (w, many) in enumerate(weights[: n - i], 1) if many[i]], m)
        return beta

    def groups(self, words: list[bytes]):
        """(indices, byte matrix) of words of one length, in bounded batches."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if not len(at):
                continue
            n = int(lengths[at[0]])
            step = max(1, LATTICE_BYTES // n)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                yield part, np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8).reshape(-1, n)

    def log_probabilities(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """The natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for at, letters in self.groups(words):
            m, n = letters.shape
            out[at] = self.forward(self.weights(self.arcs(letters), logp, m, n), m, n)[n]
        return out

    def expected(self, words: list[bytes], times: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected counts of all pieces in words that occur so many times."""
        counts = np.zeros(len(self.pieces) + 1)
        for at, letters in self.groups(words):
            m, n = letters.shape
            arcs = self.arcs(letters)
            weights = self.weights(arcs, logp, m, n)
            alpha, beta = self.forward(weights, m, n), self.backward(weights, m, n)
            c = times[at]
            for s, (row, start, ids) in enumerate(arcs, 1):
                post = np.exp(alpha[start, row] + logp[ids] + beta[start + s, row] - alpha[n, row]) * c[row]
                counts += np.bincount(ids, weights=post, minlength=len(counts))
        return counts

    def learned(self, counts: np.ndarray, ends: float) -> np.ndarray:
        """Log probabilities of the pieces and, last, of the end."""
        c = counts.copy()
        c[-1] = ends
        c += SMOOTHING
        return np.log(c / c.sum())


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """One lattice for each worker process and vocabulary file."""
    return Lattice(path)


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER_AZ).split()


def count_words(docs: DataFrame, text: str, id_col: str, folds: int, left_out: int) -> DataFrame:
    """(word, c, m): every word of the texts, its occurrences in training texts, and in all texts.

    The empty word stands for the end; a word that only texts left out have has c = 0.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train, rest = Counter(), Counter()

        def frame() -> pd.DataFrame:
            return pd.DataFrame({"word": [*train, *rest], "c": [*train.values(), *[0] * len(rest)], "m": [*train.values(), *rest.values()]}).astype({"c": "int64", "m": "int64"})

        for pdf in batches:
            for t, trains in zip(pdf["_text"], pdf["train"], strict=True):
                (train if trains else rest).update([*_words(t), b""])
                if len(train) + len(rest) > COUNTED_WORDS:
                    yield frame()
                    train.clear()
                    rest.clear()
        yield frame()

    rows = docs.select(text_bytes(text).alias("_text"), (crc_mod(id_col, folds) != left_out).alias("train"))
    return rows.mapInPandas(counted, "word binary, c long, m long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


def learn_pieces(vocab: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces of the vocabulary at ``path`` and of the end, from word counts."""
    lat = lattice(path)
    logp = lat.uniform()
    words = vocab.where((F.col("c") > 0) & (F.octet_length("word") > 0))
    for _ in range(rounds):
        now = logp

        def expected(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            lat, total = lattice(path), np.zeros(len(now))
            for pdf in batches:
                total += lat.expected(pdf["word"].tolist(), pdf["c"].to_numpy(dtype=float), now)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"piece": some, "n": total[some]})

        got = words.mapInPandas(expected, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # as many rows as pieces
        counts = np.zeros(len(logp))
        counts[got["piece"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
        logp = lat.learned(counts, float(ends))
    return logp


def head_count(vocab: DataFrame, most: int = HEAD_WORDS) -> int:
    """The least number of occurrences from which on there are at most ``most`` words; found from a histogram of some hundred rows."""
    # numbers up to 64 have a step each, larger ones 16 steps to each doubling
    step = F.when(F.col("m") <= 64, F.col("m")).otherwise(64 + F.floor((F.log2("m") - 6) * 16)).cast("long")
    rows = vocab.where(F.octet_length("word") > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("m").alias("m")).orderBy(F.desc("step")).collect()
    total, least = 0, (1 << 62)
    for r in rows:
        total += r["n"]
        if total > most:
            break
        least = r["m"]
    return least


def _head_key(word: bytes) -> bytes:
    """A short word itself; a long one's digest after a space, which no word has."""
    return word if len(word) <= HEAD_BYTES else b" " + hashlib.sha256(word).digest()[:16]


def score_texts(docs: DataFrame, vocabulary_path: str, text: str = "text", id_col: str = "doc_id", folds: int = 5, left_out: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """Per row: its id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows whose remainder of crc32 is not ``left_out``. ``base_score`` is the add-half
    unigram log10 probability, ``score`` that of the lattice.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "words")
    count_words(docs, text, id_col, folds, left_out).write.parquet(at)
    vocab = spark.read.parquet(at)
    n, v, ends = (int(x or 0) for x in vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.octet_length("word") == 0, F.col("c")))).first())
    path, logp = vocabulary_path, learn_pieces(vocab, vocabulary_path, ends, rounds)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = pdf["word"].tolist()
            yield pdf.assign(key=[_head_key(w) for w in words], lp=lattice(path).log_probabilities(words, logp) / _LN10)

    # every word is weighed once; the table is read for the head and for the tail
    at = scratch_path(spark, "weights")
    vocab.where(F.octet_length("word") > 0).mapInPandas(weighed, "word binary, c long, m long, key binary, lp double").write.parquet(at)
    scored = spark.read.parquet(at)
    is_head = F.col("m") >= head_count(vocab)
    base = lambda c: float(np.log10((c + 0.5) / (n + 0.5 * (v + 1))))
    head = {bytes(r["key"]): (base(r["c"]), r["lp"], int(r["c"] > 0)) for r in scored.where(is_head).select("key", "c", "lp").collect()}  # HEAD_WORDS of HEAD_BYTES at most
    shared = spark.sparkContext.broadcast(head)
    end = (base(ends), float(logp[-1]) / _LN10, int(ends > 0))

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in ("t1", "t2", "word", "n", "base", "lp", "known")}
            for t in pdf["_text"]:
                t1, t2 = digests([t])[0].tolist()
                base_sum, lp_sum, known, tokens, rest = end[0], end[1], end[2], 1, []
                for w, k in Counter(_words(t)).items():
                    tokens += k
                    if (x := table.get(w if len(w) <= HEAD_BYTES else _head_key(w))) is not None:
                        base_sum += k * x[0]
                        lp_sum += k * x[1]
                        known += k * x[2]
                    else:
                        rest.append((w, k))
                # the text's own row: its key holds a space, so it is no word and meets none
                m = len(rest) + 1
                out["t1"] += [t1] * m
                out["t2"] += [t2] * m
                out["word"] += [b" " + t1.to_bytes(8, "big", signed=True), *(w for w, _ in rest)]
                out["n"] += [tokens, *(k for _, k in rest)]
                out["base"] += [base_sum, *[None] * (m - 1)]
                out["lp"] += [lp_sum, *[None] * (m - 1)]
                out["known"] += [known, *[None] * (m - 1)]
                if len(out["t1"]) > 50_000:
                    yield frame(out)
                    out = {c: [] for c in out}
            yield frame(out)

    def frame(out: dict[str, list]) -> pd.DataFrame:
        pdf = pd.DataFrame(out)
        return pdf.astype({"t1": "int64", "t2": "int64", "n": "int64", "base": "float64", "lp": "float64", "known": "float64"})

    rows = docs.select(F.col(id_col).alias("_id"), text_bytes(text).alias("_text"))
    parts = rows.select("_text").mapInPandas(shares, "t1 long, t2 long, word binary, n long, base double, lp double, known double")
    tail = scored.where(~is_head).select("word", "c", F.col("lp").alias("wlp"))
    met = parts.join(tail, "word", "left")
    own = F.col("lp").isNotNull()
    of_word = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))
    sums = met.groupBy("t1", "t2").agg(
        F.count_if(own).alias("copies"),
        F.sum(F.when(own, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(own, F.col("known").cast("long")).when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(own, F.col("base")).otherwise(F.col("n") * of_word)).alias("base_score"),
        F.sum(F.when(own, F.col("lp")).otherwise(F.col("n") * F.col("wlp"))).alias("score"),
    )
    once = [F.expr(f"{c} div copies").alias(c) for c in ("n_tokens", "n_known")] + [(F.col(c) / F.col("copies")).alias(c) for c in ("base_score", "score")]
    keys = rows.withColumn("_d", text_digest("_text")).select("_id", "_d.t1", "_d.t2")
    done = salted_join(keys, sums.select("t1", "t2", *once), ["t1", "t2"], salts=2)
    return done.select(F.col("_id").alias(id_col), (crc_mod("_id", folds) == left_out).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
