"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from prismwell.llm import (
    decontaminate,
    embed_lsh,
    lattice_lm,
    packing,
    phrase_dedup,
    quality,
    simhash,
    suffix_dedup,
    token_cache,
    tokens,
    warc,
)
from prismwell.llm.common import LOWER_AZ, connected_components

BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, fp string, t1 long, word string"  # the last three clash with names used inside


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 7))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def documents() -> list[tuple]:
    """Near and exact copies, shared passages, junk, empty and null texts, a long text, a null id, a repeated row."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(40, 200)) for _ in range(12)]
    shared, texts = prose(rng, 90), []
    for k in range(60):
        words = base[k % 12].split()
        if k >= 12:
            words[rng.randrange(len(words))] = "EDIT" + str(k)
        if k % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = shared.split()
        texts.append(" ".join(words))
    texts += [base[0], base[0], base[3] + "\n" + base[3], "", " \t\n ", None, "a", "A b", "x" * 3000, "ab " * 900, prose(rng, 5000), "<|endoftext|> it's 3 don't \x1c é ' '", "� 日本語   wide"]
    rows = [(i, t, "f", 1, "w") for i, t in enumerate(texts)]
    return [*rows, rows[1], rows[1], (None, base[0], "f", 1, "w")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def utf8(t: str | None) -> bytes:
    return (t or "").encode()


def components(nodes: list, links: list[tuple]) -> dict:
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 400)] + [(9, 9), (3, 2), (2, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = components(sorted({x for e in edges for x in e}), edges)
    assert got == {k: v for k, v in want.items() if k != 9}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def bits(text: str | None) -> int:
    import xxhash

    w = utf8(text).translate(LOWER_AZ).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_op1_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    rows = documents()
    fps = {i: bits(t) for i, t, *_ in rows}
    part = components([i for i in fps if i is not None], [(a, b) for a, b in combinations([i for i in fps if i is not None], 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == (part[r["doc_id"]] if r["doc_id"] is not None else part[60])
    assert simhash.near_duplicates(empty).count() == 0


def test_op1_heavy_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 5)
    fps = {int(b) ^ sum(1 << int(j) for j in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(60)}
    want = {tuple(sorted(p)) for p in combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for heavy in (2, 256):
        got = {(r["x"], r["y"]) for r in simhash.fingerprint_links(df, 3, heavy).collect()}
        assert got == want


def test_one_of_each_group_stays(docs):
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, functions=4).collect()}
    kept = [r["doc_id"] for r in simhash.keep_one_per_group(docs, functions=4).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for i, c in groups.items() if i is not None})
    assert kept.count(None) == 1


def test_op2_spaced_seeds(spark, docs, empty):
    rng = random.Random(9)
    words = [prose(rng, 1).strip(".,").replace("é", "e") + str(k) for k in range(4000)]
    items = [(k, " ".join(rng.sample(words, rng.randint(16, 50)))) for k in range(12)] + [(50, None), (51, ""), (52, "too short"), (53, None)]
    texts, want = [], set()
    for d in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if d % 2:
            k = rng.randrange(12)
            passage = items[k][1].split()
            for at in range(rng.randrange(4), len(passage), 5) if d % 4 == 1 else []:
                passage[at] = "changed"
            cut = rng.randint(0, len(body))
            body[cut:cut] = [w.upper() if d % 3 == 0 else w for w in passage]
            want.add((d, k))
        texts.append((d, " ".join(body)))
    texts += [(100, None), (101, ""), (None, items[0][1]), texts[1]]
    want |= {(None, 0)}
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("doc", F.lit(1))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("item", F.lit(0)).repartition(3)
    found = decontaminate.overlaps(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    for r in found:
        assert r["score"] >= decontaminate.least_score(r["item_words"]) and 0 < r["overlap"] <= 1
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in want}
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0


def test_op3_revisits_and_round_trip(spark, tmp_path):
    html = ["<p>" + "long enough " * 12 + "\r\n\r\nWARC/1.1\r\n</p>", "x" * 99, "", None, "é" * 60, "x" * 100]
    rows = [(i, f"http://h/{i}\r\nEvil: 1" if i != 4 else None, html[i % 6], "z") for i in range(30)] + [(None, "u", html[0], "z"), (3, "u", html[0], "z"), (3, "u", html[0], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(4)
    got = warc.deduplicate_pages(pages, folder=str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    first: dict = {}
    for i, _, h, _ in rows:
        if len(utf8(h)) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    responses = Counter()
    for r in got:
        h = next(h for i, _, h, _ in rows if i == r["page_id"] and hashlib.sha256(utf8(h)).hexdigest() == r["payload_digest"])
        assert r["payload_bytes"] == len(utf8(h))
        if r["record_type"] == "response":
            assert r["refers_to"] is None
            responses[h] += 1
            assert len(utf8(h)) < 100 or r["page_id"] == first[h]
        else:
            assert r["refers_to"] == first[h]
    assert all(responses[h] == 1 for h in first)
    back = warc.read_archives(spark, str(tmp_path / "w" / "resolved")).where("warc_type = 'response'").collect()
    assert {bytes(r["payload"]) for r in back} == {utf8(h) for h in html}
    assert warc.deduplicate_pages(pages.limit(0), folder=str(tmp_path / "e")).count() == 0


def test_op3_reads_members_of_their_own():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    assert [b for _, b in warc.parse_archive(gzip.compress(record) + gzip.compress(record))] == [b"ab\r\nc"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_archive(record[:-8]))


def test_op4_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    good = [prose(rng, rng.randint(30, 200)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) if k % 2 else (prose(rng, 1) + " ") * 80 for k in range(150)]
    rows = [(k, t) for k, t in enumerate([x for p in zip(good, bad, strict=True) for x in p])] + [(900, None), (901, ""), (None, good[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.95
    flipped = [(k, 1 - k % 2 if zlib.crc32(str(k).encode()) % 5 else k % 2, 0) for k in range(300)]
    again = quality.score_documents(df, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    np.testing.assert_allclose(sorted(r["score"] for r in again), sorted(r["score"] for r in got), atol=1e-9)  # held-out labels teach nothing
    assert {r["score"] for r in quality.score_documents(df, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(df.limit(0), labels).count() == 0
    kept = {r["doc_id"] for r in quality.keep_good(df, labels).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"]}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_plain_words_go_to_the_model_alone(library, monkeypatch):
    texts = [b"Plain words, each once; a xqzvw zebra!", "Stra\u00dfe I\u0301le caf\u00e9s plain".encode()]
    enc = tokens.TextEncoder(BPE)
    sent: list[str] = []
    encode = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda group: sent.extend(group) or encode(group))
    assert enc.ids(texts) == [np.asarray(library.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert not {"plain", "words", "each", "xqzvw", "zebra"} & set(" ".join(sent).split())


def test_encoder_is_the_library(library):
    texts = [utf8(t) for _, t, *_ in documents()] + [s.encode() for s in ("a.b,c", "it'S", "x...", "É. é, ÉÉ;", "1,2", "<|startoftext|>x", "é.", "|a| b|", "İstanbul.", "ab cd", "don't.'s")]
    got = tokens.TextEncoder(BPE).ids(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]


def test_op5_counts_and_cache(spark, docs, empty, library, tmp_path):
    cache = str(tmp_path / "cache")
    got = token_cache.count_tokens(docs, BPE, cache).collect()
    rows = documents()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == Counter((i, len(utf8(t)), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in rows)
    stored = spark.read.parquet(cache).count()
    assert stored == len({utf8(t) for _, t, *_ in rows})
    more = docs.union(spark.createDataFrame([(999, "new text here", "f", 1, "w")], DOCS))
    assert token_cache.count_tokens(more, BPE, cache).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_cache.count_tokens(empty, BPE, str(tmp_path / "none")).count() == 0


def test_op6_packing(docs, empty, library):
    got = packing.pack(docs, BPE, size=256, windows=4, merged=2).collect()
    rows = documents()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, *_ in rows}
    copies = Counter(i for i, *_ in rows)
    covered: Counter = Counter()
    by_sequence: dict = {}
    for r in got:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        covered.update((r["doc_id"], p) for p in range(r["start"], r["start"] + r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == Counter({(i, p): n for i, n in copies.items() for p in range(len(ids[i]))})
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(n for p in by_sequence.values() for _, n in p) > 0.9 * 256 * len(by_sequence)
    assert packing.pack(empty, BPE).count() == 0


def test_op7_links_counts_and_components(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    x = [c + 0.03 * rng.standard_normal(24) for c in centres for _ in range(rng.integers(1, 40))]
    x += [x[0], x[0], 3 * x[0], *rng.standard_normal((100, 24))]
    rows = [(i, [float(v) for v in a], "k") for i, a in enumerate(x)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0, 2.0]]
    rows += [(1000 + k, v, "k") for k, v in enumerate(odd)] + [rows[1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, keys string").repartition(3)
    a = np.array(x)
    a /= np.linalg.norm(a, axis=1)[:, None]
    near = a @ a.T >= 0.95
    part = components(list(range(len(x))), [(i, j) for i, j in combinations(range(len(x)), 2) if near[i, j]])
    for block in (8, 256):
        got = {r["vec_id"]: r for r in embed_lsh.near_vectors(df, block=block).collect()}
        links = sum(got[i]["n_links"] for i in range(len(x)))
        want = sum(int(near[i].sum()) - 1 + int(near[i, 1]) for i in range(len(x)))  # row 1 is there twice
        assert 0.95 * want <= links <= want
        assert np.mean([got[i]["component_id"] == part[i] for i in range(len(x))]) > 0.95
        assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
        assert all((got[1000 + k]["n_links"], got[1000 + k]["component_id"]) == (0, 1000 + k) for k in range(len(odd)))
    assert embed_lsh.near_vectors(df).count() == len(rows)
    assert embed_lsh.near_vectors(df.limit(0)).count() == 0


def repeated_bytes(texts: list[bytes], length: int) -> list[bytearray]:
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        out.append(mask)
    return out


@pytest.mark.parametrize(("length", "most"), [(400, 4096), (64, 4096), (64, 1)])
def test_op8_suffix_dedup(spark, docs, empty, length, most):
    rows = documents()
    masks = repeated_bytes([utf8(t) for _, t, *_ in rows], length)
    want = Counter()
    for (i, t, *_), m in zip(rows, masks, strict=True):
        kept = bytes(b for b, gone in zip(utf8(t), m, strict=True) if not gone)
        spans = sum(1 for a, b in zip(b"\0" + bytes(m), bytes(m), strict=False) if b and not a)
        want[(i, len(utf8(t)), sum(m), spans, hashlib.sha256(kept).hexdigest())] += 1
    old = suffix_dedup.repeated_spans.__defaults__
    suffix_dedup.repeated_spans.__defaults__ = (*old[:-1], most)
    try:
        got = suffix_dedup.removed_bytes(docs, length=length).collect()
    finally:
        suffix_dedup.repeated_spans.__defaults__ = old
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    if length == 400:
        assert suffix_dedup.removed_bytes(empty).count() == 0
        rest = suffix_dedup.without_repeats(docs)
        assert rest.columns == docs.columns
        cut = [bytes(b for b, gone in zip(utf8(t), m, strict=True) if not gone).decode("utf-8", "ignore") for (_, t, *_), m in zip(rows, masks, strict=True)]
        plain = lambda t: None if t is None else t.encode("ascii", "ignore").decode()  # noqa: E731  characters that a span cuts stay
        assert Counter((r["doc_id"], plain(r["text"])) for r in rest.collect()) == Counter((i, None if t is None else plain(c)) for (i, t, *_), c in zip(rows, cut, strict=True))


def test_op8_very_long_texts_are_cut():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    index, base, chunks = suffix_dedup._chunks([text, b"x" * 10], 400, 1000)
    windows = [(i, b + k) for i, b, c in zip(index, base, chunks, strict=True) for k in range(len(c) - 399)]
    assert sorted(windows) == [(0, k) for k in range(4601)]


def test_op8_runs_of_one_letter():
    texts = [b"a" * 900, b"ab" * 500]
    rows = [r for f in suffix_dedup.text_blocks(texts, 400) for r in f.itertuples()]
    assert len(rows) < 10 and sum(r.times * r.n for r in rows) == 501 + 601
    places = [(r, r.a + k * ((r.last - r.a) // max(1, r.times - 1))) for r in rows for k in range(r.times)]
    flags = suffix_dedup.repeated_starts([texts[r.i][a : a + r.n + 399] for r, a in places], [r.n for r, _ in places], [r.off for r, _ in places], 400)
    assert all(f.all() for f in flags)


def test_op8_passages_go_by_bytes_not_by_words(spark):
    """Shared passages of over 50 words: one of 399 bytes stays, one of 400 goes."""
    rng = random.Random(8)
    rows, want = [], {}
    for n in (399, 400):
        passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 7))) for _ in range(100))[: n - 1] + "."
        assert len(passage.encode()) == n and len(passage.split()) > 50
        for mark in "12":
            rows.append((len(rows), prose(rng, 60) + mark + passage + mark + prose(rng, 60)))
            want[rows[-1][0]] = (len(rows[-1][1].encode()), n if n >= 400 else 0, int(n >= 400))
    got = suffix_dedup.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == want


def test_op9_counts_base_and_lattice(spark, docs, empty):
    rows = documents()
    words = [[*utf8(t).translate(LOWER_AZ).split(), b""] for _, t, *_ in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, *_ in rows]
    c = Counter(w for ws, yes in zip(words, train, strict=True) if yes for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    got = {}
    for most in (0, 50, 1 << 18):
        old = lattice_lm.head_count.__defaults__
        lattice_lm.head_count.__defaults__ = (most,)
        try:
            got[most] = lattice_lm.score_texts(docs, BPE).collect()
        finally:
            lattice_lm.head_count.__defaults__ = old
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got[most]) == Counter(
            (i, not yes, len(ws), sum(c[w] > 0 for w in ws), n, round(base(ws), 6)) for (i, *_), ws, yes in zip(rows, words, train, strict=True)
        )
        assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got[most])
        assert Counter((r["doc_id"], round(r["score"], 5)) for r in got[most]) == Counter((r["doc_id"], round(r["score"], 5)) for r in got[0])
    assert lattice_lm.score_texts(empty, BPE).count() == 0


def test_op9_document_scores_and_rounds_by_enumeration(spark):
    """Two rounds of expectation maximisation and whole texts, over all segmentations written out."""
    texts = ["the then at", "At the a", "then then hat", "ate a", None, "that at the"]
    lat = lattice_lm.lattice(BPE)

    def ways(w: bytes, at: int = 0):
        for k in range(at + 1, len(w) + 1):
            for i in by.get((w[at:k], k == len(w)), []):
                yield from ([i, *rest] for rest in (ways(w, k) if k < len(w) else [[]]))

    by: dict = {}
    for i, (p, f) in enumerate(zip(lat.pieces, lat.final.tolist(), strict=True)):
        by.setdefault((p, f), []).append(i)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    words = Counter(w for t in train for w in utf8(t).lower().split())
    logp = lat.uniform()
    for _ in range(2):
        counts = np.full(len(logp), lattice_lm.SMOOTHING)
        counts[-1] += len(train)
        for w, c in words.items():
            paths = list(ways(w))
            p = np.exp([logp[i].sum() for i in paths])
            for path, x in zip(paths, p / p.sum(), strict=True):
                np.add.at(counts, path, c * x)
        logp = np.log(counts / counts.sum())
    want = {i: (logp[-1] + sum(np.log(sum(np.exp(logp[p].sum()) for p in ways(w))) for w in utf8(t).lower().split())) / np.log(10) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["score"] for r in lattice_lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BPE).collect()}
    assert got == pytest.approx(want)


CLASHING = ("_row", "_bytes", "_d", "_runs", "_maybe", "_t1", "_t2", "_id", "_hash", "_bad", "_x", "_score", "_text", "text_hash", "t1", "t2", "h", "score", "label", "item", "part")


def test_columns_of_any_name_come_back(spark):
    rng = random.Random(2)
    passage, item = prose(rng, 120), prose(rng, 30)
    texts = [prose(rng, 60), passage + " " + prose(rng, 20), prose(rng, 20) + " " + passage, prose(rng, 20) + " " + item, None]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, *(f"{c}{i}" for c in CLASHING)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    named = {(r[0], *r[2:]) for r in rows}
    for out, kept in (
        (decontaminate.drop_contaminated(df, bench), {0, 1, 2, 4}),
        (suffix_dedup.without_repeats(df, length=200), {0, 1, 2, 3, 4}),
        (quality.keep_good(df, labels), None),
    ):
        assert out.columns == df.columns
        got = {(r[0], *r[2:]) for r in out.collect()}
        assert got <= named and (kept is None or {r[0] for r in got} == kept)


def test_op9_forward_is_the_sum_over_all_segmentations():
    lat = lattice_lm.lattice(BPE)
    logp = lat.uniform()
    inner = {p: float(np.exp(x)) for p, f, x in zip(lat.pieces, lat.final, logp, strict=False) if not f}
    final = {p: float(np.exp(x)) for p, f, x in zip(lat.pieces, lat.final, logp, strict=False) if f}

    def total(w: bytes) -> float:
        return final.get(w, 0.0) + sum(inner.get(w[:k], 0.0) * total(w[k:]) for k in range(1, len(w)))

    words = [b"a", b"the", b"thation", "café".encode(), b"x.", b"inthese"]
    np.testing.assert_allclose(lat.log_probabilities(words, logp), [np.log(total(w)) for w in words], rtol=1e-9)
    # every word's expected pieces spell it
    counts = lat.expected(words, np.ones(len(words)), logp)
    assert counts[:-1] @ np.array([len(p) for p in lat.pieces]) == pytest.approx(sum(map(len, words)))
    assert counts[:-1] @ lat.final == pytest.approx(len(words))
    assert np.isfinite(lat.log_probabilities([b"q" * 20_000], logp)).all()


@pytest.mark.parametrize(("window", "most"), [(50, 4096), (12, 4096), (12, 1)])
def test_op10_phrase_dedup(docs, empty, window, most):
    rows = documents()
    first: dict = {}
    for i, t, *_ in rows:
        w = utf8(t).split()
        for k in range(len(w) - window + 1):
            if i is not None:
                q = tuple(w[k : k + window])
                first[q] = min(first.get(q, i), i)
    want = Counter()
    for i, t, *_ in rows:
        w = utf8(t).split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    old = phrase_dedup.owned_runs.__defaults__
    phrase_dedup.owned_runs.__defaults__ = (*old[:-1], most)
    try:
        got = phrase_dedup.removed_passages(docs, window=window).collect()
    finally:
        phrase_dedup.owned_runs.__defaults__ = old
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    if window == 50:
        assert phrase_dedup.removed_passages(empty).count() == 0
