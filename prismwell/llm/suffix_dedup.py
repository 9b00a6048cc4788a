"""Removal of repeated byte strings by suffix arrays of blocks with a difference-cover sample.

A suffix is repeated if its first ``length`` bytes also start elsewhere. Texts are cut by their own
content into blocks of such starts (see ``blocks``); equal blocks are counted before anything is
shuffled with its text, and a block that occurs twice is repeated as a whole. What is left to sort
are the suffixes of different blocks that hold the same anchor: they form a suffix bucket. Buckets
are sorted one after the other, so memory is bounded by the largest, which is bounded itself: the
suffixes of an anchor with over ``max_blocks`` different blocks are dealt out by the digests of
their windows first.

Within a bucket every suffix gets the rank of its first 32 bytes. Longer ties are resolved by the
ranks of a sample: the positions whose remainder modulo 31 lies in a difference cover, ranked 249
bytes deep by doubling over the sample alone. As a bucket's texts are aligned by their anchors, tied
suffixes have the same remainder, and the two sample positions that cover a window lie at the same
distances in all of them.

Edge cases: null texts are empty; texts shorter than ``length`` lose nothing; equal texts of that
length or more lose everything; repeated rows are copies; null ids are kept; an empty table gives no
rows; extra columns are kept where documents come back, and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import digests, folded, window_blocks
from .common import cut, salted_join, text_bytes, whole_rows
from .filters import HashFilter
from .spans import BATCH_BYTES, as_long, batches_of, give_back

#: Share of a window that its anchor gram has: 145 bytes of 400.
GRAM = 145 / 400
#: Different blocks of one anchor that a task sorts together.
MAX_BLOCKS = 4096
#: Bytes of text that are sorted at a time.
SORTED_BYTES = 1 << 20
# fixed values: a difference cover modulo 31
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_HEAD = 32
_BLOCK = "t1 long, t2 long, a int, last int, times int, n int, off int, h long, d1 long, d2 long"


def _chunks(texts: list[bytes], length: int, limit: int = BATCH_BYTES) -> tuple[list[int], list[int], list[bytes]]:
    """(index, offset, bytes): texts as they are, very long ones as pieces that share length - 1 bytes."""
    index, base, out = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 1), limit):
            index.append(i)
            base.append(at)
            out.append(t[at : at + limit + length - 1])
    return index, base, out


def text_blocks(texts: list[bytes], length: int) -> Iterator[pd.DataFrame]:
    """The blocks of these texts: ``i`` (the text), a, last, times, n, off (the anchor's distance), h, d1, d2.

    ``times`` equal blocks start from ``a`` to ``last``.
    """
    index, base, chunks = _chunks(texts, length)
    gram = max(1, int(length * GRAM))
    for at, group in batches_of(chunks):
        buf = b"".join(group)
        sizes = [len(g) for g in group]
        owner = np.repeat(np.arange(len(group), dtype=np.int32), sizes)
        begin = np.cumsum([0, *sizes])
        starts, count, anchors, h = window_blocks(np.frombuffer(buf, np.uint8).astype(np.uint16) + 1, owner, length, gram)
        if not len(starts):
            continue
        d = digests([buf[s:e] for s, e in zip(starts.tolist(), (starts + count + length - 1).tolist(), strict=True)])
        chunk = owner[starts]
        shift = np.asarray(base[at : at + len(group)])[chunk] - begin[chunk]
        row, step, times = folded(chunk, starts, count, d, length)
        first = (starts + shift)[row]
        yield pd.DataFrame({"i": np.asarray(index[at : at + len(group)])[chunk[row]], "a": first, "last": first + step * (times - 1), "times": times, "n": count[row], "off": (anchors - starts)[row], "h": as_long(h)[row], "d1": d[row, 0], "d2": d[row, 1]})


def _emit_blocks(length: int):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        for pdf in batches:
            texts = pdf["_text"].tolist()
            keys = digests(texts)
            for found in text_blocks(texts, length):
                own = keys[found["i"].to_numpy()]
                yield found.assign(t1=own[:, 0], t2=own[:, 1])[names]
        give_back()

    return blocks


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Ranks by several keys, the first the most significant; equal tuples get equal ranks."""
    rank = keys[0]
    for k in keys[1:]:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64) * np.uint64(len(k) + 1) + np.unique(k, return_inverse=True)[1].astype(np.uint64)
    return np.unique(rank, return_inverse=True)[1].astype(np.int64)


def _paired(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of twice the depth: by the rank here, then by the rank ``step`` further on."""
    n = np.uint64(len(rank) + 2)
    later = np.zeros(len(rank), np.uint64)
    later[: len(rank) - step] = rank[step:].astype(np.uint64) + np.uint64(1)
    return np.unique(rank.astype(np.uint64) * n + later, return_inverse=True)[1].astype(np.int64)


def repeated_starts(blocks: list[bytes], starts: list[int], anchors: list[int], length: int) -> list[np.ndarray]:
    """For each block, which of its first ``starts`` suffixes share ``length`` bytes with another.

    ``anchors`` are the anchors' distances from the blocks' first bytes.
    """
    # every block begins where its anchor falls on a multiple of the period
    lead = [(-a) % PERIOD for a in anchors]
    room = [(x + len(b) + 2 * PERIOD) // PERIOD * PERIOD for x, b in zip(lead, blocks, strict=True)]
    origin = np.cumsum([0, *room])
    text = np.zeros(origin[-1] + length, np.uint8)
    begin = origin[:-1] + lead
    for at, b in zip(begin.tolist(), blocks, strict=True):
        text[at : at + len(b)] = np.frombuffer(b, np.uint8)
    # ranks of the first 8, 16 and 32 bytes of every suffix
    words = np.zeros(len(text), np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + len(text)]
    head = _paired(_paired(np.unique(words, return_inverse=True)[1].astype(np.int64), 8), 16)
    # ranks of the sample, doubled over the sample alone: a column for each member of the cover
    rows = len(text) // PERIOD
    grid = np.arange(rows)[:, None] * PERIOD + np.array(COVER)
    deep = head[grid]
    depth, step = _HEAD, 1
    while depth < length - 3 * PERIOD and depth + step * PERIOD <= length - PERIOD:
        later = np.zeros_like(deep)
        later[: rows - step] = deep[step:] + 1
        size = np.uint64(int(later.max(initial=0)) + 2)
        deep = np.unique(deep.astype(np.uint64) * size + later.astype(np.uint64), return_inverse=True)[1].reshape(deep.shape).astype(np.int64)
        depth, step = depth + step * PERIOD, step * 2
    sample = np.zeros(len(text), np.int64)
    sample[grid] = deep
    # suffixes by remainder and head; ties by sample ranks as far as the window reaches, then by its tail
    at = np.concatenate([b + np.arange(n) for b, n in zip(begin.tolist(), starts, strict=True)])
    residue = at % PERIOD
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    after = np.array([min(d for d in range(PERIOD) if cover[(r + d) % PERIOD]) for r in range(PERIOD)])
    before = np.array([min(d for d in range(PERIOD) if cover[(r - d) % PERIOD]) for r in range(PERIOD)])
    rank = _rank(residue.astype(np.uint64) * np.uint64(len(text) + 1) + head[at].astype(np.uint64))
    open_ = np.flatnonzero(np.bincount(rank)[rank] > 1)
    rank, reach = rank[open_], after[residue[open_]]  # reach: from the window's start to a sample position
    while len(open_):
        rank = _rank(rank, sample[at[open_] + reach])
        tied = np.bincount(rank)[rank] > 1
        open_, rank, reach = open_[tied], rank[tied], reach[tied]
        if not len(open_) or (reach + depth >= length - _HEAD).all():
            break
        # on to the farthest sample position that what is compared reaches and whose depth the window holds
        limit = np.minimum(reach + depth, length - depth)
        reach = np.maximum(reach, limit - before[(residue[open_] + limit) % PERIOD])
    if len(open_):
        rank = _rank(rank, head[at[open_] + length - _HEAD])
        open_ = open_[np.bincount(rank)[rank] > 1]
    flags = np.zeros(len(at), bool)
    flags[open_] = True
    return np.split(flags, np.cumsum(starts)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 400, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(t1, t2, runs): for each text that has any, runs [s, e) of starts; their windows cover what is repeated.

    ``length`` is 32 or more. A text is known by its 128-bit digest.
    """
    rows = docs.select(text_bytes(text).alias("_text"))
    blocks = cut(rows.where(F.octet_length("_text") >= length).mapInPandas(_emit_blocks(length), _BLOCK))
    again = cut(blocks.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h"))
    live = blocks.where(HashFilter.of(again, again.count()).column("h"))
    kinds = cut(live.groupBy("h", "d1", "d2").agg(F.sum("times").alias("times"), F.min(F.struct("t1", "t2", "a", "n", "off")).alias("r")))
    at = [F.col("a").alias("s"), (F.col("last") + F.col("n")).alias("e")]
    within = live.where("times > 1").select("t1", "t2", *at)  # repeated by its own text
    alone = live.where("times = 1").drop("times").withColumn("_row", F.monotonically_increasing_id())
    elsewhere = salted_join(alone, kinds.where("times > 1").select("h", "d1", "d2"), ["h", "d1", "d2"], "inner", salts=4, by=F.col("_row"))
    whole = within.union(elsewhere.select("t1", "t2", *at))

    # buckets that need sorting: several kinds of block, one of them seen once
    buckets = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1").select("h", "kinds")
    needed = cut(salted_join(kinds, buckets, ["h"], "inner", salts=2).select("h", "kinds", "times", "r.*"))
    owners = cut(needed.select("t1", "t2").distinct())
    fetch = docs_by_digest(docs, text, HashFilter.of(owners, owners.count(), "t1"))
    listed = needed.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "kinds", "times", "a", "n", "off")).alias("b"))  # of one text
    fetched = fetch.groupBy("t1", "t2").agg(F.first("_text").alias("_text")).join(listed, ["t1", "t2"])
    pieces = fetched.select("t1", "t2", "_text", F.explode("b").alias("b")).select("t1", "t2", "b.*", F.expr(f"substring(_text, b.a + 1, b.n + {length - 1})").alias("block"))
    pieces = cut(pieces)

    def sort_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            while len(pdf):
                room = np.searchsorted(np.cumsum(pdf["block"].map(len)), SORTED_BYTES) + 1
                part, pdf = pdf.iloc[:room], pdf.iloc[room:]
                held.append(part)
                size += int(part["block"].map(len).sum())
                if size < SORTED_BYTES:
                    continue
                both = pd.concat(held, ignore_index=True)
                last = both["h"].iloc[-1]
                done = both[both["h"] != last]
                if len(done):
                    yield sort(done)
                held = [both[both["h"] == last]]
                size = int(held[0]["block"].map(len).sum())
        if held and len(both := pd.concat(held, ignore_index=True)):
            yield sort(both)
        give_back()

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = repeated_starts(pdf["block"].tolist(), pdf["n"].tolist(), pdf["off"].tolist(), length)
        out = [(r.t1, r.t2, r.a + s, r.a + e) for r, f in zip(pdf.itertuples(index=False), flags, strict=True) if r.times == 1 for s, e in _runs(f)]
        return pd.DataFrame(out, columns=["t1", "t2", "s", "e"])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                d = digests([r.block[k : k + length] for k in range(r.n)])
                yield pd.DataFrame({"t1": r.t1, "t2": r.t2, "s": [r.a + k for k in range(r.n)], "times": r.times, "w1": d[:, 0], "w2": d[:, 1]})

    run = "t1 long, t2 long, s int, e int"
    few = pieces.where(F.col("kinds") <= max_blocks).select("h", "t1", "t2", "times", "a", "n", "off", "block")
    sorted_ = few.repartition(F.col("h")).sortWithinPartitions("h").mapInPandas(sort_buckets, run)
    many = pieces.where(F.col("kinds") > max_blocks)
    if not many.isEmpty():
        dealt = cut(many.mapInPandas(windows, "t1 long, t2 long, s int, times long, w1 long, w2 long"))
        twice = dealt.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1")
        found = salted_join(dealt.where("times = 1"), twice, ["w1", "w2"], "inner", salts=2)
        sorted_ = sorted_.union(found.select("t1", "t2", "s", (F.col("s") + 1).alias("e")))
    return cut(whole.union(sorted_).groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("runs")))


def text_digest(col: str) -> Column:
    """The 128-bit digest of a column of bytes, as a struct of two longs."""

    @F.pandas_udf("t1 long, t2 long")
    def digest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(digests(texts.tolist()), columns=["t1", "t2"])

    return digest(F.col(col))


def sought_digest(col: str, wanted: HashFilter) -> Column:
    """The same and ``maybe``: whether the digest's first half may be wanted.

    One Python function does both, and it counts as not deterministic, so that Spark neither chains
    two workers nor runs it a second time for a filter.
    """

    @F.pandas_udf("t1 long, t2 long, maybe boolean")
    def digest(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(digests(texts.tolist()), columns=["t1", "t2"])
        return out.assign(maybe=wanted.maybe(out["t1"].to_numpy().view(np.uint64)))

    return digest.asNondeterministic()(F.col(col))


def docs_by_digest(docs: DataFrame, text: str, wanted: HashFilter) -> DataFrame:
    """(t1, t2, _text) of the rows whose digest may be wanted."""
    keyed = docs.select(text_bytes(text).alias("_text")).withColumn("_d", sought_digest("_text", wanted))
    return keyed.where("_d.maybe").select("_d.t1", "_d.t2", "_text")


def byte_spans(runs, length: int) -> list[tuple[int, int]]:
    """The maximal stretches of bytes that windows starting in these runs cover."""
    out: list[list[int]] = []
    for r in sorted((r["s"], r["e"] - 1 + length) for r in runs):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(s, e) for s, e in out]


def without(data: bytes, spans: list[tuple[int, int]], whole_characters: bool = False) -> bytes:
    """The rest of the bytes; on demand a character that is cut stays as a whole."""
    kept, at = [], 0
    for s, e in spans:
        if whole_characters:
            while s < e and s < len(data) and data[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
                e -= 1
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def _with_runs(docs: DataFrame, text: str, length: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``_row``, ``_bytes``, ``_runs`` of the rows of ``docs`` that may have repeated spans, and the first two of the others.

    Columns ``by`` tell copies of one text apart.
    """
    spans = repeated_spans(docs, text, length)
    wanted = HashFilter.of(spans, spans.count(), "t1")
    keyed = docs.select(whole_rows(docs), text_bytes(text).alias("_bytes")).withColumn("_d", sought_digest("_bytes", wanted))
    some = keyed.where("_d.maybe").select("_row", "_bytes", "_d.t1", "_d.t2")
    salt = F.struct(*[F.col(f"_row.`{c}`") for c in by]) if by else F.lit(0)
    joined = salted_join(some, spans.withColumnRenamed("runs", "_runs"), ["t1", "t2"], salts=4, by=salt)
    return joined.select("_row", "_bytes", "_runs"), keyed.where("not _d.maybe").select("_row", "_bytes")


def removed_bytes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 400) -> DataFrame:
    """Per row of ``docs``: its id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans."""

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>")
    def cut_out(data: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(data, runs, strict=True):
            spans = byte_spans(r, length) if r is not None else []
            out.append((sum(e - s for s, e in spans), len(spans), hashlib.sha256(without(t, spans)).hexdigest(), [{"s": s, "e": e} for s, e in spans]))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "spans"])

    some, none = _with_runs(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", length, ["_id"])
    head = [F.col("_row._id").alias(id_col), F.octet_length("_bytes").cast("long").alias("n_bytes")]
    some = some.select(*head, cut_out("_bytes", "_runs").alias("c")).select(id_col, "n_bytes", "c.*")
    none = none.select(*head, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("_bytes", 256).alias("kept_sha256"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))
    return some.union(none)


def without_repeats(docs: DataFrame, text: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with repeated spans taken out of the texts, in whole characters; all rows and columns stay."""

    @F.pandas_udf("string")
    def rest(data: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([without(t, byte_spans(r, length) if r is not None else [], True).decode("utf-8", "replace") for t, r in zip(data, runs, strict=True)], dtype=object)

    some, none = _with_runs(docs, text, length, [c for c in docs.columns if c != text])
    left = F.when(F.col("_runs").isNull(), F.col(f"_row.`{text}`")).otherwise(rest("_bytes", "_runs"))
    some = some.select(F.col("_row").withField(f"`{text}`", left).alias("_row"))
    return some.union(none.select("_row")).select("_row.*")
