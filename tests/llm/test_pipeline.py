"""Each stage of the pipeline, and the whole of it, against brute force on a small table."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prismwell.llm import quality
from prismwell.llm.common import LOWER_AZ

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def kept_by(stage, spark, docs):
    out = STAGES[stage](spark, docs, SF)
    assert out.columns == docs.columns
    return {r["doc_id"]: r["text"] or "" for r in out.collect()}


def good(rows: dict, labels: dict) -> set:
    """Quadratic discriminant by numpy's determinants and solves."""
    x = {i: np.asarray(quality.statistics(t.encode())) for i, t in rows.items()}
    train = [i for i in rows if i in labels and zlib.crc32(str(i).encode()) % 5 != 0]
    groups = [np.array([x[i] for i in train if labels[i] == c]) for c in (0, 1)]
    covs = [np.cov(g.T, bias=True) for g in groups]
    both = sum(len(g) * c for g, c in zip(groups, covs, strict=True)) / len(train)
    score = {}
    for i, v in x.items():
        density = []
        for g, c in zip(groups, covs, strict=True):
            c = (1 - quality.POOLED) * c + quality.POOLED * both
            c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + 1e-6 * np.eye(len(v))
            d = v - g.mean(0)
            density.append(-0.5 * (d @ np.linalg.solve(c, d) + np.linalg.slogdet(c)[1]) + np.log(len(g)))
        score[i] = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
    return {i for i, s in score.items() if s >= quality.THRESHOLD}


def test_quality_stage(spark, docs, rows):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(kept_by("quality classifier", spark, docs)) == good(rows, labels)


def shingles(text: str, k: int = 5) -> frozenset:
    w = text.encode().translate(LOWER_AZ).split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_near_copy_stage(spark, docs, rows):
    sets = {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(rows), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert set(kept_by("SimHash near-dedup", spark, docs)) == {i for i in rows if find(i) == i}


def test_repeat_stage(spark, docs, rows):
    n = corpus_pipeline.REPEATED_BYTES
    data = {i: t.encode() for i, t in rows.items()}
    seen = Counter(b[k : k + n] for b in data.values() for k in range(len(b) - n + 1))
    got = kept_by("suffix-array dedup", spark, docs)
    assert got.keys() == rows.keys()
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        # a character that is cut stays as a whole, so only whole ones are compared
        want = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert got[i].encode("ascii", "ignore") == want.encode("ascii", "ignore")


def test_contamination_stage(spark, docs, rows):
    """Documents that hold eight words of an item in a row go, those that share no three with any stay."""
    items = [r["text"].encode().translate(LOWER_AZ).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {k: {tuple(w[i : i + k]) for w in items for i in range(len(w) - k + 1)} for k in (3, 8)}
    words = {i: t.encode().translate(LOWER_AZ).split() for i, t in rows.items()}
    holds = lambda i, k: any(tuple(words[i][j : j + k]) in grams[k] for j in range(len(words[i]) - k + 1))
    kept = set(kept_by("benchmark decontamination", spark, docs))
    assert not any(i in kept for i in rows if holds(i, 8))
    assert all(i in kept for i in rows if not holds(i, 3))


def test_whole_run(spark, rows):
    """What is packed are the tokens of documents that every stage left, each once."""
    pieces = corpus_pipeline.run(spark, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by: dict = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        assert 0 < r["length"] <= 4096 - r["offset"]
    assert set(by) <= set(rows)
    for i, parts in by.items():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total <= len(tok.encode(rows[i], add_special_tokens=False).ids) + 8  # the text, cut where it repeats
