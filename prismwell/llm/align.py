"""Alignment of two tokenizers over the same texts, by byte ranges.

Texts are cut into spans at places where both tokenizers are known to cut: before a space between two
characters that are no white space. A task gathers blocks of texts; a block's distinct spans are encoded
once by either library, and their tokens become two interval tables in DuckDB, in which spans lie one
after the other. ASOF joins find the first and the last token of B that meet a token of A, a range join
lists the links, and a window sum over the common ends numbers the groups. A block is written with its
documents (as lists of spans), its spans' links and, for each pair of ids, how many of its documents hold
it linked. These partial counts are merged in Spark and go back to the blocks that asked for them, where
the documents' sums are taken.

Edge cases: null and empty texts have no tokens and zeros; so have texts that a tokenizer does not spell
out byte by byte; a text with white space beyond ASCII, or with U+2581, is one span, whatever its length;
a text longer than a block is a block of its own, and its spans are aligned in runs; repeated rows are documents of their own; null ids are
kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join, scratch_path, text_bytes
from .spans import give_back

#: Bytes of text in a block, and spans whose ids a task remembers.
BLOCK_BYTES, MAX_SPANS = 4 << 20, 450_000
#: Spans in one pair of interval tables, and spans encoded as one text.
SPANS_ALIGNED, JOINED = 20_000, 4000
#: DuckDB's share of a Python worker's memory.
DUCKDB_MEMORY = "250MB"
# fixed values: characters beyond ASCII that count as white space or stand for it
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")
#: What stands before a token: first of a span, next of its side, first of B, first of a group.
_MARKS = (b"", b",", b"|", b";")
_APART = re.compile(rb"(?<=[^\t-\r ])(?= [^\t-\r ])")
_UNEVEN = re.compile(rb"[\t-\r ] | [\t-\r ]| \Z")
_BLOCK = "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, spans binary, pairs binary, links binary"


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level vocabulary of the tokenizers library; a span comes with the space before it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = True
        alphabet = _byte_alphabet()
        vocab = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
        self.bytes_of = [b""] * self.tok.get_vocab_size()
        for entry, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in entry)

    def ids(self, spans: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([" " + s for s in spans], add_special_tokens=False)]


class PieceModel:
    """Side B: a sentencepiece model that puts a space before a text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, spans: list[str]) -> list[list[int]]:
        return self.model.encode(spans, num_threads=1)


@lru_cache(maxsize=2)
def _sides(path_a: str, path_b: str) -> tuple[ByteLevel, PieceModel, np.ndarray, np.ndarray]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a, b = ByteLevel(path_a), PieceModel(path_b)
    inner = [p for p in b.bytes_of if b" " in p.lstrip(b" ")]
    if inner:
        raise ValueError("a piece reaches over a space; texts cannot be cut there")
    return a, b, np.array([len(x) for x in a.bytes_of]), np.array([len(x) for x in b.bytes_of])


def spans_of(text: bytes) -> list[bytes]:
    """The text's spans, each without the space before it."""
    if not text.isascii() and _WIDE_SPACE.search(text.decode("utf-8", "replace")):
        return [text]
    if text.startswith(b" ") or _UNEVEN.search(b" " + text):
        return [s[1:] for s in _APART.split(b" " + text)]
    return text.split(b" ")


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values, in order; sorts in place."""
    x.sort()
    return x[np.diff(x, prepend=x[0] - 1) > 0] if len(x) else x


def _joinable(span: bytes) -> bool:
    """Whether both tokenizers cut before and after the span where others stand beside it with one space between, unless it has wide white space."""
    return bool(span) and span[0] > 0x20 and span[-1] > 0x20


class Aligner:
    """Blocks of texts to their documents, spans, links and partial pair counts.

    Spans are numbered as a task meets them, -1 where a side does not spell one. ``counts`` has n_a, n_b,
    n_groups and n_links of each, ``said`` its groups as text, ``pairs`` its links from ``first`` on.
    """

    def __init__(self, path_a: str, path_b: str):
        import duckdb

        self.a, self.b, self.len_a, self.len_b = _sides(path_a, path_b)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self.marked = max(len(self.len_a), len(self.len_b))
        self.pieces = [mark + str(i).encode() for mark in _MARKS for i in range(self.marked)]
        self.known: dict[bytes, int] = {}
        self.said: list[bytes] = []
        self.counts, self.first, self.pairs = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _spelled(self, side: ByteLevel | PieceModel, lengths: np.ndarray, spans: list[bytes], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all spans, how many each has, whether their bytes are the span's with a space before it)."""
        joined = " ".join(texts)
        if len(spans) == 1 or not _WIDE_SPACE.search(joined):
            (ids,) = side.ids([joined])
            flat = np.array(ids, np.int32)
            ends, cuts = np.cumsum(lengths[flat]), np.cumsum([len(s) + 1 for s in spans])
            at = np.searchsorted(ends, cuts)
            if len(flat) and at[-1] < len(flat) and (ends[at] == cuts).all() and b"".join(map(side.bytes_of.__getitem__, ids)) == b" " + b" ".join(spans):
                return flat, np.diff(at, prepend=-1), np.ones(len(spans), bool)
        one_by_one = side.ids(texts)
        same = [b"".join(map(side.bytes_of.__getitem__, x)) == b" " + s for x, s in zip(one_by_one, spans, strict=True)]
        return np.array([i for x in one_by_one for i in x], np.int32), np.array([len(x) for x in one_by_one]), np.array(same)

    def _learn(self, spans: list[bytes]) -> None:
        """Number, encode and align new spans."""
        plain = [s for s in spans if _joinable(s)]
        groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)] + [[s] for s in spans if not _joinable(s)]
        waiting: list[list[np.ndarray]] = []
        held = 0
        for n, group in enumerate(groups, 1):
            texts = [s.decode("utf-8", "replace") for s in group]
            (a, n_a, ok_a), (b, n_b, ok_b) = self._spelled(self.a, self.len_a, group, texts), self._spelled(self.b, self.len_b, group, texts)
            if not (same := ok_a & ok_b).all():
                self.known.update((s, -1) for s, ok in zip(group, same.tolist(), strict=True) if not ok)
                group = [s for s, ok in zip(group, same.tolist(), strict=True) if ok]
                a, b, n_a, n_b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)], n_a[same], n_b[same]
            self.known.update(zip(group, range(len(self.said) + held, len(self.said) + held + len(group)), strict=True))
            held += len(group)
            waiting.append([a, n_a, b, n_b])
            if held and (held >= SPANS_ALIGNED or n == len(groups)):
                self._keep(*self.aligned(*map(np.concatenate, zip(*waiting, strict=True))))
                waiting, held = [], 0

    def _keep(self, counts: np.ndarray, pairs: np.ndarray, said: list[bytes]) -> None:
        self.said += said
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts[:, 3])])
        self.counts, self.pairs = np.concatenate([self.counts, counts]), np.concatenate([self.pairs, pairs])

    def _forget(self) -> None:
        """Keep a third of the memory: early spans are the frequent ones."""
        n = MAX_SPANS // 3
        self.known = {s: i for s, i in self.known.items() if 0 <= i < n}
        n = min(n, len(self.said))
        self.said, self.counts, self.first = self.said[:n], self.counts[:n], self.first[: n + 1]
        self.pairs = self.pairs[: self.first[-1]]

    def _intervals(self, ids: np.ndarray, each: np.ndarray, lengths: np.ndarray) -> pa.Table:
        """Token intervals of one side of all spans, which follow one another in one line of bytes."""
        ends = np.cumsum(lengths[ids])
        return pa.table({"i": np.arange(len(ids)), "span": np.repeat(np.arange(len(each)), each), "id": ids, "s": ends - lengths[ids], "e": ends})

    def aligned(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of spans, whose ids follow one another: counts (n_a, n_b, n_groups, n_links), the pair of ids of each link, groups as text."""
        ta, tb = self._intervals(ids_a, n_a, self.len_a), self._intervals(ids_b, n_b, self.len_b)
        con, n = self.con, len(n_a)
        con.register("ta", ta)
        con.register("tb", tb)
        links = con.execute("""
            WITH met AS (SELECT ta.span, ta.id, ta.e, tb.i AS i0 FROM ta ASOF JOIN tb ON ta.s >= tb.s),
                 reach AS (SELECT met.span, met.id, met.i0, tb.i AS i1 FROM met ASOF JOIN tb ON met.e > tb.s)
            SELECT r.span, CAST(r.id AS BIGINT) << 32 | tb.id AS pair FROM reach r JOIN tb ON tb.i >= r.i0 AND tb.i <= r.i1
        """).fetchnumpy()
        numbered = [con.execute(f"""
            WITH met AS (SELECT x.i, y.e IS NOT NULL AS is_cut FROM {x} x LEFT JOIN {y} y ON x.e = y.e)
            SELECT i, coalesce(sum(CAST(is_cut AS INTEGER)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM met ORDER BY i
        """).fetchnumpy()["g"].astype(np.int64) for x, y in (("ta", "tb"), ("tb", "ta"))]  # fmt: skip
        con.unregister("ta")
        con.unregister("tb")
        pair, span = np.asarray(links["pair"], np.int64), np.asarray(links["span"], np.int64)
        order = np.argsort(span, kind="stable")
        # tokens by group, A before B: what stands before each tells it from the one before
        side = np.repeat([0, 1], [len(ta), len(tb)])
        group = np.concatenate(numbered)
        place = np.argsort(2 * group + side, kind="stable")
        side, group = side[place], group[place]
        owner = np.concatenate([ta["span"].to_numpy(), tb["span"].to_numpy()])[place]
        token = np.concatenate([ta["id"].to_numpy(), tb["id"].to_numpy()])[place].astype(np.int64)
        fresh, new_span = np.diff(group, prepend=-1) > 0, np.diff(owner, prepend=-1) > 0
        mark = np.where(new_span, 0, np.where(fresh, 3, np.where(np.diff(side, prepend=0) != 0, 2, 1)))
        pieces = list(map(self.pieces.__getitem__, (mark * self.marked + token).tolist()))
        ends = np.searchsorted(owner, np.arange(n), "right").tolist()
        counts = np.stack([n_a, n_b, np.bincount(owner[fresh], minlength=n), np.bincount(span, minlength=n)], 1).astype(np.int64)
        return counts, pair[order], [b"".join(pieces[i:j]) for i, j in zip([0, *ends], ends)]  # noqa: B905

    def block(self, number: int, ids: list, texts: list[bytes]) -> pd.DataFrame:
        """The block's rows: one for each document, and one with its spans' links and its partial pair counts."""
        cutup = [spans_of(t) if t else [] for t in texts]
        flat = [s for spans in cutup for s in spans]
        fresh = set(flat).difference(self.known)
        if len(self.known) + len(fresh) > MAX_SPANS:
            self._forget()
            fresh = set(flat).difference(self.known)
        self._learn(list(fresh))
        lengths = np.array([len(spans) for spans in cutup])
        number_of = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), lengths)
        unspelled = np.zeros(len(texts), bool)
        unspelled[owner[number_of < 0]] = True
        stay = ~unspelled[owner]
        owner, number_of = owner[stay], number_of[stay]
        out = {"block": number, "doc_id": ids}
        if not len(owner):
            empty = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), 0)
            return pd.DataFrame(out | empty | {"groups_sha256": "", "spans": [b""] * len(texts), "pairs": None, "links": None})
        there = np.bincount(number_of, minlength=len(self.said)) > 0
        distinct, place = np.flatnonzero(there), (np.cumsum(there) - 1)[number_of]
        ends = np.searchsorted(owner, np.arange(len(texts)), "right")
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[number_of], axis=0)])
        out |= dict(zip(("n_a", "n_b", "n_groups", "n_links"), (sums[ends] - sums[starts]).T, strict=True))
        said, order = self.said, number_of.tolist()
        bounds = list(zip(starts.tolist(), ends.tolist(), strict=True))
        out["groups_sha256"] = [hashlib.sha256(b";".join([said[i] for i in order[x:y]])).hexdigest() if y > x else "" for x, y in bounds]
        # the block's links: those of its spans, one span after the other
        many = self.counts[distinct, 3]
        first = np.cumsum(many) - many
        entry = np.repeat(self.first[distinct] - first, many) + np.arange(many.sum())
        pairs, at = np.unique(self.pairs[entry], return_inverse=True)
        # documents that hold a pair: distinct (document, span), spread over the span's pairs, made distinct again
        once = _distinct(owner * len(distinct) + place)
        who, span = once // len(distinct), once % len(distinct)
        spread = np.repeat(first[span] - np.cumsum(many[span]) + many[span], many[span]) + np.arange(many[span].sum())
        held = _distinct(np.repeat(who, many[span]) * len(pairs) + at[spread])
        docs = np.bincount(held % len(pairs), minlength=len(pairs))
        spans = place.astype(np.int32)
        found = pd.DataFrame(out | {"spans": [spans[x:y].tobytes() for x, y in bounds], "pairs": None, "links": None})
        links = np.stack([np.repeat(np.arange(len(distinct)), many), at]).astype(np.int32)
        whole = {"block": number, "pairs": np.stack([pairs, docs]).astype(np.int64).tobytes(), "links": links.tobytes()}
        return pd.concat([found, pd.DataFrame([whole])], ignore_index=True)


def _shape(found: pd.DataFrame) -> pd.DataFrame:
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    found[counts] = found[counts].fillna(-1).astype("int64")  # -1 marks the block's own row
    return found[[x.split()[0] for x in _BLOCK.split(", ")]]


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes, and reads back, the rows of all blocks: documents, and one row a block with n_a -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, number = Aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for pdf in batches:
            for i, t in zip(pdf["_id"].tolist(), pdf["_text"].tolist(), strict=True):
                if texts and size + len(t) > BLOCK_BYTES:
                    yield _shape(aligner.block(number, ids, texts))
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield _shape(aligner.block(number, ids, texts))
        aligner.con.close()
        give_back()

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text_bytes(text).alias("_text"))
    rows.mapInPandas(run, _BLOCK).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks' pairs (block, place, a, b), and per pair of ids its documents corpus-wide and whether its A id has no higher."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, pairs in zip(pdf["block"].tolist(), pdf["pairs"].tolist(), strict=True):
                pair, docs = np.frombuffer(pairs, np.int64).reshape(2, -1)
                yield pd.DataFrame({"block": block, "place": np.arange(len(pair)), "a": pair >> 32, "b": pair & 0xFFFFFFFF, "docs": docs})

    asked = blocks.where("pairs IS NOT NULL").select("block", "pairs").mapInPandas(listed, "block long, place int, a int, b int, docs long")
    merged = cut(asked.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    best = merged.groupBy("a").agg(F.max("count").alias("most"))
    return asked.drop("docs"), salted_join(merged, best, ["a"], "inner").select("a", "b", "count", (F.col("count") == F.col("most")).alias("is_best"))


def _summed(span: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sums of whole numbers by span; spans come in order."""
    first = np.flatnonzero(np.diff(span, prepend=-1))
    out = np.zeros(int(span[-1]) + 1, np.int64)
    out[span[first]] = np.add.reduceat(count, first)
    return out


def align_tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    id_type = docs.schema[id_col].dataType
    blocks = aligned_blocks(docs, path_a, path_b, scratch_path(docs.sparkSession, "aligned"), text, id_col)
    asked, counted = pair_counts(blocks)
    answers = salted_join(asked, counted, ["a", "b"], "inner").select("block", "place", "count", "is_best")

    def summed(found: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """The sums of one block, of bounded size."""
        of_docs = found[found["n_a"] >= 0]
        out = of_docs[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
        out["n_best"], out["count_sum"], out["groups_sha256"] = 0, 0, of_docs["groups_sha256"]
        if len(told):
            span, place = np.frombuffer(found.loc[found["n_a"] < 0, "links"].iloc[0], np.int32).reshape(2, -1)
            count, best = np.zeros(len(told), np.int64), np.zeros(len(told), np.int64)
            count[told["place"]], best[told["place"]] = told["count"], told["is_best"]
            by_span = np.zeros((int(span.max()) + 1, 2), np.int64)
            by_span[:, 0], by_span[:, 1] = np.bincount(span, best[place]), _summed(span, count[place])
            sums = [by_span[np.frombuffer(s, np.int32)].sum(axis=0) for s in of_docs["spans"]]
            out["n_best"], out["count_sum"] = [int(x[0]) for x in sums], [int(x[1]) for x in sums]
        return out

    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    parts = blocks.drop("pairs").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(summed, schema)
    return parts.select(F.col("doc_id").cast(id_type).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
