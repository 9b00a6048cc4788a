"""The pipeline's near-copy stage against true Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from prismwell.llm import common, near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str | None) -> frozenset:
    w = "".join(c.lower() if c < "\x80" else c for c in text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"edit{rng.randrange(10**9)}"
    return out


def texts() -> list[str | None]:
    rng = random.Random(11)
    out: list[str | None] = [None, "", " \n", "a b", "A  B", "a b c", "one two three four five six seven eight", "one two three four five six seven eight nine"]
    for n in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([13, 40, 120, 300]))]
        out.append(" ".join(base))
        for _ in range(3):
            out.append(" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 40)))))
        out.append(" ".join(base[: -max(1, len(base) // 8)]))
    return out


def groups(rows: list[tuple]) -> dict:
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def test_near_copy_stage_keeps_one_of_each_jaccard_group(spark, tmp_path):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows] + [(rows[8][0], rows[8][1], "en", "s", 1), (None, rows[9][1], "en", "s", 1)], SCHEMA).repartition(3)
    want = groups(rows)
    assert len(set(want.values())) < len(rows) - 100
    kept = [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, df, str(tmp_path)).collect()]
    assert kept.count(None) == 1
    assert sorted(x for x in kept if x is not None) == sorted(set(want.values()))


def test_pairs_at_the_least_similarity_are_found(spark):
    rng, rows = random.Random(3), []
    for k in range(300):  # 80 shingles against the first 64 of them, 0.8 exactly
        words = [f"v{rng.randrange(10**6)}" for _ in range(84)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:68]))]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in range(300))
    assert found >= 291  # recall 0.99 less three standard deviations
    assert all(c in (i, i - i % 2) for i, c in got.items())


def test_bit_counts_equal_plain_sums():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 5, 64, 1000):
        h = rng.integers(0, 1 << 63, (3, n), dtype=np.uint64)
        want = [[int((row >> np.uint64(j) & np.uint64(1)).sum()) for j in range(64)] for row in h]
        assert near_copies.bit_counts(h).tolist() == want


def test_empty_table(spark):
    assert near_copies.keep_one_per_group(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    """Another text under the least id has no copy and stays; of a family between 0.6 and 0.8 all stay."""
    rng = random.Random(6)
    word = lambda: f"x{rng.randrange(10**6)}"
    a, b, base = ([word() for _ in range(120)] for _ in range(3))
    family = [[word() if k in (5 + 4 * i, 60 + 4 * i) else w for k, w in enumerate(base)] for i in range(12)]
    assert all(0.6 < jaccard(shingles(" ".join(x)), shingles(" ".join(y))) < 0.8 for x, y in combinations(family, 2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a)), (2, " ".join(a)), *[(10 + i, " ".join(f)) for i, f in enumerate(family)]]
    kept = near_copies.keep_one_per_group(spark.createDataFrame([(i, t, "_h", 7) for i, t in rows], "doc_id long, text string, rep string, _h long"))
    assert kept.columns == ["doc_id", "text", "rep", "_h"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted({*rows[:2], *rows[4:]})


def test_texts_edited_beyond_the_threshold_are_not_verified_in_pairs(spark, monkeypatch):
    """In large buckets the sets decide in the join: of a family just below 0.8 few pairs are left to verify, and the groups are those of brute force."""
    rng, asked = random.Random(9), []
    base = [f"y{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(edited(rng, base, 4))) for i in range(150)]
    rows += [(200 + i, t + " and one more") for i, t in rows[:20]]  # links to be found
    verified = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *rest: (asked.append(pairs.count()), verified(pairs, *rest))[1])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)
    assert asked[-1] < 5 * len(rows)


def test_small_graphs_are_contracted_without_rounds(spark, monkeypatch):
    """A path over many partitions: two tables are kept, where each round kept one more; with a small limit the rounds give the same."""
    rows = [(i, i + 1) for i in range(400) if i % 50 != 49]
    edges = spark.createDataFrame(random.Random(4).sample(rows, len(rows)), "a long, b long").repartition(7)
    keep, kept = common.cut, []
    monkeypatch.setattr(common, "cut", lambda df: (kept.append(1), keep(df))[1])
    want = {i: i - i % 50 for i in range(400)}
    assert {r["node"]: r["component"] for r in common.connected_components(edges).collect()} == want
    assert len(kept) == 2
    monkeypatch.setattr(common, "CONTRACT_ROWS", 100)
    assert {r["node"]: r["component"] for r in common.connected_components(edges).collect()} == want
