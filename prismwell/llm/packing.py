"""Packing tokenised documents into fixed sequences with a bounded number of open windows.

Each partition packs online: whole sequences of a long document close at once; what is left goes to
the open window where it fits best; if none fits and the windows are used up, the fullest is closed.
A document longer than a sequence is cut so that its first piece fills the fullest window. The
windows still open at a partition's end are merged, best fit from the fullest down, within groups
of a fixed number of partitions; each group's rows are bounded by windows times partitions.

Edge cases: a null or empty text is one piece, the separator alone; repeated rows are packed each;
null ids are kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes
from .tokens import encoder

#: Open windows of a partition, and partitions whose leftovers are merged together.
WINDOWS, MERGED_PARTITIONS = 32, 16
#: Sequence ids: partition or group number above, running number below.
SEQUENCE_BITS = 32
_SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part long"


class Windows:
    """Open windows of ``size`` tokens, at most ``limit`` of them."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.open = size, limit, []  # each: [used, pieces]

    def place(self, piece: tuple, length: int) -> list | None:
        """Put a piece where the least room is left; returns the window closed for it, if any."""
        best = None
        for w in self.open:
            if w[0] + length <= self.size and (best is None or w[0] > best[0]):
                best = w
        closed = None
        if best is None:
            if len(self.open) >= self.limit:
                closed = max(self.open, key=lambda w: w[0])
                self.open.remove(closed)
            self.open.append(best := [0, []])
        best[1].append((piece, best[0]))
        best[0] += length
        return closed

    def full(self) -> list[list]:
        done = [w for w in self.open if w[0] == self.size]
        self.open = [w for w in self.open if w[0] < self.size]
        return done


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", size: int = 4096, separator: int = 2, windows: int = WINDOWS, merged: int = MERGED_PARTITIONS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema, id_type = _SCHEMA, docs.schema[id_col].dataType
    end = int(separator).to_bytes(4, "little")

    def online(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        state, number = Windows(size, windows), part << SEQUENCE_BITS
        names = [x.split()[0] for x in schema.split(", ")]

        def closed(w: list) -> list[tuple]:
            nonlocal number
            number += 1
            return [(*p, number, at, False, part) for p, at in w[1]]

        for pdf in batches:
            rows: list[tuple] = []
            for doc, ids in zip(pdf["_id"].tolist(), enc.ids(pdf["_text"].tolist()), strict=True):
                ids += end
                total, at = len(ids) // 4, 0
                while at < total:
                    length = min(size, total - at)
                    if at == 0 and total > size and state.open:
                        length = size - max(w[0] for w in state.open)  # a cut that is needed anyway fills a window
                    piece = (doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total)
                    if length == size:
                        rows += closed([size, [(piece, 0)]])
                    elif (w := state.place(piece, length)) is not None:
                        rows += closed(w)
                    for w in state.full():
                        rows += closed(w)
                    at += length
            yield pd.DataFrame(rows, columns=names)
        enc.trim()
        left = [(*p, (part << SEQUENCE_BITS) + k, at, True, part) for k, w in enumerate(state.open) for p, at in w[1]]
        yield pd.DataFrame(left, columns=names)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        pdf = pdf.sort_values(["sequence_id", "offset"], kind="stable").reset_index(drop=True)
        used = pdf.groupby("sequence_id")["length"].sum()
        used = used.reset_index().sort_values(["length", "sequence_id"], ascending=[False, True])
        state = Windows(size, len(used))
        for w, n in zip(used["sequence_id"].tolist(), used["length"].tolist(), strict=True):
            state.place((w,), n)
        target = {}
        for k, w in enumerate(state.open):
            for (old,), base in w[1]:
                target[old] = ((((1 << 22) + group) << SEQUENCE_BITS) + k, base)
        pdf["offset"] += pdf["sequence_id"].map(lambda s: target[s][1])
        pdf["sequence_id"] = pdf["sequence_id"].map(lambda s: target[s][0])
        return pdf.drop(columns=["grp"])

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text_bytes(text).alias("_text"))
    pieces = cut(rows.mapInPandas(online, schema))
    groups = max(1, pieces.rdd.getNumPartitions() // merged)
    left = pieces.where("open").withColumn("grp", F.col("part") % groups)
    final = pieces.where("not open").unionByName(left.groupBy("grp").applyInPandas(merge, schema))
    return final.select(F.col("doc_id").cast(id_type).alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
