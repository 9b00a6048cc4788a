"""Removal of repeated word passages with sharded Aho-Corasick automata.

A passage is removed from a document if a document with a smaller id has it too. Texts are cut by
their own content into blocks of 50-word windows (see ``blocks``). Equal blocks are gathered before
any text moves: a block's owner is the smallest id that has it, and all others lose its windows.
Different blocks with the same anchor may still share windows. They are dealt to shards by anchor;
a shard confirms the passages that recur in it, compiles them into an automaton, words as symbols,
and streams all its blocks through it, which stand for every document that holds them. Each
occurrence takes the passage's owner along.

Memory is bounded by the words a shard holds at a time; anchors with over ``max_blocks`` different
blocks are resolved window by window, by digests, instead.

Edge cases: null texts have no words; texts of fewer words than a window lose nothing; of rows with
one id none is smaller; rows with a null id lose nothing and own nothing; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import digests, folded, window_blocks
from .common import cut, salted_join, text_bytes
from .filters import HashFilter
from .spans import as_long, batches_of, give_back, rolling_hashes, word_hashes, words_of
from .suffix_dedup import docs_by_digest, sought_digest

#: Share of a window that its anchor gram has: 19 words of 50.
GRAM = 0.39
MAX_BLOCKS = 4096
#: Words that a shard's automaton is compiled from and run over at a time.
SHARD_WORDS = 200_000
_BLOCK = "t1 long, t2 long, a int, step int, times int, n int, h long, d1 long, d2 long"


def text_blocks(texts: list[bytes], window: int) -> Iterator[pd.DataFrame]:
    """The blocks of these texts: ``i`` (the text), a (the first word), step, times, n (windows), h (anchor), d1, d2.

    ``times`` equal blocks start ``step`` words apart.
    """
    gram = max(1, int(window * GRAM))
    for at, group in batches_of(texts):
        buf, begin, end, owner = words_of(group)
        starts, count, _, h = window_blocks(word_hashes(buf, begin, end), owner, window, gram)
        if not len(starts):
            continue
        # the same words with one space between any two
        plain = b" ".join(buf.split())
        to = np.cumsum(end - begin + 1) - 1
        since = to - (end - begin)
        d = digests([plain[s:e] for s, e in zip(since[starts].tolist(), to[starts + count + window - 2].tolist(), strict=True)])
        doc = owner[starts]
        origin = np.searchsorted(owner, np.arange(len(group)))[doc]
        row, step, times = folded(doc, starts, count, d, window)
        yield pd.DataFrame({"i": at + doc[row], "a": (starts - origin)[row], "step": step, "times": times, "n": count[row], "h": as_long(h)[row], "d1": d[row, 0], "d2": d[row, 1]})


def _emit_blocks(window: int):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_id", *(c.split()[0] for c in _BLOCK.split(", "))]
        for pdf in batches:
            texts, ids = pdf["_text"].tolist(), pdf["_id"].to_numpy()
            keys = digests(texts)
            for found in text_blocks(texts, window):
                i = found["i"].to_numpy()
                yield found.assign(_id=ids[i], t1=keys[i, 0], t2=keys[i, 1])[names]
        give_back()

    return blocks


def _symbols(blocks: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each block as a string with a character for each word; all word numbers, and their blocks."""
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in b.split()] for b in blocks]
    char = lambda i: chr(i + 1 if i < 0xD7FF else i + 0x801)  # noqa: E731  past the surrogates
    table = [char(i) for i in range(len(number))]
    return ["".join(map(table.__getitem__, w)) for w in words], np.array([x for w in words for x in w], np.int64), np.repeat(np.arange(len(words)), [len(w) for w in words])


def _merge(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return sorted(set(spans))


def locate(blocks: list[bytes], owners: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """For each block: (first window, end, owner) of all that blocks with smaller owners hold too."""
    texts, words, block = _symbols(blocks)
    out: list[list[tuple[int, int, int]]] = [[] for _ in blocks]
    h = rolling_hashes(words + 1, window)
    at = np.flatnonzero(block[: len(h)] == block[window - 1 :]) if len(h) else np.zeros(0, np.int64)
    if not len(at):
        return out
    # confirm: windows that also lie in a block with a smaller owner, in runs with one least owner
    own = np.asarray(owners, np.int64)[block[at]]
    kind = np.unique(h[at], return_inverse=True)[1]
    least = np.full(kind.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, own)
    least = least[kind]
    again = least < own
    origin = np.searchsorted(block, np.arange(len(blocks)))
    edge = np.flatnonzero((np.diff(at) != 1) | (np.diff(least) != 0) | (np.diff(again) != 0) | (np.diff(block[at]) != 0)) + 1
    phrases: dict[str, int] = {}
    for run in np.split(np.arange(len(at)), edge):
        if again[run[0]]:
            k = block[at[run[0]]]
            s = int(at[run[0]] - origin[k])
            phrase = texts[k][s : s + len(run) + window - 1]
            phrases[phrase] = min(phrases.get(phrase, own[run[0]]), int(least[run[0]]))
    if not phrases:
        return out
    # compile, and stream every block
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for phrase, owner in phrases.items():
        automaton.add_word(phrase, (len(phrase), owner))
    automaton.make_automaton()
    for k, t in enumerate(texts):
        out[k] = _merge([(end - size + 1, end - window + 2, owner) for end, (size, owner) in automaton.iter(t) if owner < owners[k]])
    return out


def owned_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 50, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(t1, t2, runs): for each text with any, runs [s, e) of windows and the smallest id that has them."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text).alias("_text")).where(F.col("_id").isNotNull())
    blocks = cut(rows.mapInPandas(_emit_blocks(window), f"_id long, {_BLOCK}"))
    again = cut(blocks.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    live = blocks.where(HashFilter.of(again, again.count()).column("h"))
    rep = F.struct("_id", "t1", "t2", "a", "n")
    kinds = cut(live.groupBy("h", "d1", "d2").agg(F.count("*").alias("times"), F.min("_id").alias("owner"), F.min(rep).alias("r")))
    shared = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    needed = cut(salted_join(kinds, shared, ["h"], "inner", salts=2).select("h", "d1", "d2", "kinds", "owner", "r.t1", "r.t2", "r.a", "r.n"))
    texts = cut(needed.select("t1", "t2").distinct())
    wanted = HashFilter.of(texts, texts.count(), "t1")
    keyed = docs_by_digest(rows, "_text", wanted)
    listed = needed.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "d1", "d2", "kinds", "owner", "a", "n")).alias("b"))  # of one text
    fetched = keyed.groupBy("t1", "t2").agg(F.first("_text").alias("_text")).join(listed, ["t1", "t2"]).select("_text", "b")
    piece = "h long, d1 long, d2 long, kinds long, owner long, n int, block binary"

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, wanted_blocks in zip(pdf["_text"], pdf["b"], strict=True):
                buf, begin, end, _ = words_of([t])
                yield pd.DataFrame([(b["h"], b["d1"], b["d2"], b["kinds"], b["owner"], b["n"], buf[begin[b["a"]] : end[b["a"] + b["n"] + window - 2]]) for b in wanted_blocks], columns=[c.split()[0] for c in piece.split(", ")])

    pieces = cut(fetched.mapInPandas(slices, piece))

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            while len(pdf):
                room = np.searchsorted(np.cumsum(pdf["n"].to_numpy() + window), SHARD_WORDS) + 1
                part, pdf = pdf.iloc[:room], pdf.iloc[room:]
                held.append(part)
                size += int(part["n"].sum()) + window * len(part)
                if size < SHARD_WORDS:
                    continue
                both = pd.concat(held, ignore_index=True)
                last = both["h"].iloc[-1]
                if len(done := both[both["h"] != last]):
                    yield solve(done)
                held = [both[both["h"] == last]]
                size = int(held[0]["n"].sum()) + window * len(held[0])
        if held and len(both := pd.concat(held, ignore_index=True)):
            yield solve(both)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = locate(pdf["block"].tolist(), pdf["owner"].tolist(), window)
        out = [(r.h, r.d1, r.d2, s, e, o) for r, spans in zip(pdf.itertuples(index=False), found, strict=True) for s, e, o in spans]
        return pd.DataFrame(out, columns=["h", "d1", "d2", "s", "e", "o"])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                words = r.block.split()
                d = digests([b" ".join(words[k : k + window]) for k in range(r.n)])
                yield pd.DataFrame({"h": r.h, "d1": r.d1, "d2": r.d2, "s": range(r.n), "owner": r.owner, "w1": d[:, 0], "w2": d[:, 1]})

    run = "h long, d1 long, d2 long, s int, e int, o long"
    few = pieces.where(F.col("kinds") <= max_blocks)
    inner = few.repartition(F.col("h")).sortWithinPartitions("h").mapInPandas(shards, run)
    many = pieces.where(F.col("kinds") > max_blocks)
    if not many.isEmpty():
        dealt = cut(many.mapInPandas(windows, "h long, d1 long, d2 long, s int, owner long, w1 long, w2 long"))
        least = dealt.groupBy("w1", "w2").agg(F.min("owner").alias("o"))
        found = salted_join(dealt, least, ["w1", "w2"], "inner", salts=2).where("o < owner")
        inner = inner.union(found.select("h", "d1", "d2", "s", (F.col("s") + 1).cast("int").alias("e"), "o"))
    parts = inner.groupBy("h", "d1", "d2").agg(F.collect_list(F.struct("s", "e", "o")).alias("parts"))  # of one block
    told = kinds.where("times > 1").select("h", "d1", "d2", "owner").join(parts, ["h", "d1", "d2"], "full")
    # a folded row stands for its block at each place; what is told of the block's inside holds at each of them
    spread = live.select("t1", "t2", "a", "step", "times", "n", "h", "d1", "d2").withColumn("_row", F.monotonically_increasing_id())
    met = salted_join(spread, told, ["h", "d1", "d2"], "inner", salts=4, by=F.col("_row"))
    outer = met.where("owner is not null").select("t1", "t2", F.col("a").alias("s"), F.expr("a + step * (times - 1) + n").alias("e"), F.col("owner").alias("o"))
    inner = met.where("parts is not null").select("t1", "t2", "parts", F.explode(F.expr("transform(sequence(0, times - 1), k -> a + step * k)")).alias("a")).select("t1", "t2", "a", F.explode("parts").alias("p")).select("t1", "t2", (F.col("a") + F.col("p.s")).alias("s"), (F.col("a") + F.col("p.e")).alias("e"), "p.o")
    return cut(outer.union(inner).groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "e", "o")).alias("runs")))


def removed_passages(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 50) -> DataFrame:
    """Per row of ``docs``: its id, n_words, n_removed, kept_sha256 and kept_text."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string, kept_text string")
    def kept(data: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, spans in zip(data, runs, strict=True):
            words = t.split()
            n = len(words)
            if spans is not None and len(spans):
                gone = np.zeros(n, bool)
                for r in spans:
                    gone[r["s"] : r["e"] + window - 1] = True
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            rest = b" ".join(words)
            out.append((n, n - len(words), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])

    spans = owned_runs(docs, text, id_col, window)
    wanted = HashFilter.of(spans, spans.count(), "t1")
    rows = docs.select(F.col(id_col).alias("_id"), text_bytes(text).alias("_bytes")).withColumn("_d", sought_digest("_bytes", wanted))
    rows = rows.select("_id", "_bytes", "_d.t1", "_d.t2", F.col("_d.maybe").alias("_maybe"))
    some = rows.where("_maybe").join(spans, ["t1", "t2"], "left").select("_id", "_bytes", F.expr("filter(runs, r -> r.o < _id)").alias("runs"))
    none = rows.where("not _maybe").select("_id", "_bytes", F.lit(None).cast(some.schema["runs"].dataType).alias("runs"))
    done = some.select("_id", kept("_bytes", "runs").alias("k")).union(none.select("_id", kept("_bytes", "runs").alias("k")))
    return done.select(F.col("_id").alias(id_col), "k.*")
