"""Alignment, importance resampling and chat formatting against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from prismwell.llm import align, chat, importance, queries

from tests.oracle import duckdb_rows, spark_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a\n b", "a \n\nb ", "tab\tand  two", "<|endoftext|> plain <s> </s> <0x41>", "it's 3 don't 1234", "é ü ß 日本語 русский 👩‍👩‍👧",
    "no break space  here", "ideographic　space ▁ mark", "nul \x00 byte \x1c sep", "x" * 4000, "ab " * 3000, "ﬁ é é", "  line", "\r\n dos \r\n", "end\n", "� broken",
]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 7))) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(3)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(25)]
    return [*ODD, *base, base[0], base[0], prose(rng, 6000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[30], (None, "null id", "x", 1)], "doc_id long, text string, block string, n_a long").repartition(3).cache()


def aligned_by_hand(said: list[tuple]) -> list[tuple]:
    side_a, side_b = align.ByteLevel(A), align.PieceModel(B)
    found, held = [], Counter()
    for key, text in said:
        ids = [side.ids([text])[0] if text else [] for side in (side_a, side_b)]
        pieces = [[side.bytes_of[i] for i in x] for side, x in zip((side_a, side_b), ids, strict=True)]
        if not text or any(b"".join(p) != b" " + text.encode() for p in pieces):
            found.append((key, None))
            continue
        spans = []
        for p in pieces:
            at, out = 0, []
            for x in p:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j0 = [], 0
        for i, (s, e) in zip(ids[0], spans[0], strict=True):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(ids[1]) and spans[1][j][0] < e:
                links.append((i, ids[1][j]))
                j += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        sides = []
        for x, span in zip(ids, spans, strict=True):
            out, k = [], 0
            for e in ends:
                group = []
                while k < len(x) and span[k][1] <= e:
                    group.append(str(x[k]))
                    k += 1
                out.append(",".join(group))
            sides.append(out)
        said_groups = ";".join(f"{a}|{b}" for a, b in zip(*sides, strict=True))
        found.append((key, (len(ids[0]), len(ids[1]), len(ends), links, hashlib.sha256(said_groups.encode()).hexdigest())))
        held.update(set(links))
    most: dict[int, int] = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = []
    for key, f in found:
        if f is None:
            rows.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = f[3]
            rows.append((key, f[0], f[1], f[2], len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), f[4]))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block_bytes", [align.BLOCK_BYTES, 300])
def test_alignment_equals_brute_force(spark, docs, monkeypatch, block_bytes):
    monkeypatch.setattr(align, "BLOCK_BYTES", block_bytes)
    said = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in align.align_tokens(docs, A, B).collect()), key=repr)
    assert got == aligned_by_hand(said)


@pytest.mark.parametrize("text", [t for t in texts() if t])
def test_spans_give_the_ids_of_whole_texts(text):
    for side in (align.ByteLevel(A), align.PieceModel(B)):
        spans = [s.decode() for s in align.spans_of(text.encode())]
        assert [i for x in side.ids(spans) for i in x] == side.ids([text])[0]


def test_a_small_memory_of_spans_changes_nothing(spark, docs, monkeypatch):
    want = sorted((tuple(r) for r in align.align_tokens(docs, A, B).collect()), key=repr)
    monkeypatch.setattr(align, "MAX_SPANS", 50)
    assert sorted((tuple(r) for r in align.align_tokens(docs, A, B).collect()), key=repr) == want


def test_alignment_of_an_empty_table(docs):
    assert align.align_tokens(docs.limit(0), A, B).count() == 0


_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text: str | None) -> tuple[int, list[int]]:
    words = _WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled_by_hand(said: list[tuple], target: list[str], percent: int) -> list[tuple]:
    found = [(key, *grams(t)) for key, t in said]
    s, t = Counter(b for _, _, g in found for b in g), Counter(b for x in target for b in grams(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s_all + 10_000) / ((s[k] + 1) * (t_all + 10_000)))) for k in range(10_000)]
    rows = []
    for key, n, g in found:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append([key, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for i, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("piece", [importance.PIECE_BYTES, 64])
def test_resampling_equals_brute_force(spark, docs, monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE_BYTES", piece)
    target = [t for t in texts() if t][::3]
    said = [(r.doc_id, r.text) for r in docs.collect()]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate([*target, None, ""])], "item_id long, text string")
    got = sorted((tuple(r) for r in importance.resample(docs, benchmark, percent=40).collect()), key=repr)
    assert got == resampled_by_hand(said, target, 40)


@pytest.mark.parametrize("size", [1, 2, 7, 50, 1 << 20])
def test_pieces_hold_every_word_once(monkeypatch, size):
    text = "Aé b2 " + "w" * 300 + " ,; the END-of it " * 20
    hasher = importance.Hasher(10_000)
    monkeypatch.setattr(importance, "PIECE_BYTES", size)
    assert [w for p in importance.pieces_of(text.encode(), size) for w in p] == [w.encode() for w in _WORDS.findall(text.lower())]
    (n, buckets), (none, _) = importance._features([text.encode(), b""], hasher)
    assert (n, sorted(buckets.tolist()), none) == (grams(text)[0], sorted(grams(text)[1]), 0)


def test_a_full_dictionary_begins_anew(monkeypatch):
    monkeypatch.setattr(importance, "MAX_WORDS", 3)
    hasher = importance.Hasher(10_000)
    for text in ("a b c d e", "f g a b", "a b c"):
        assert sorted(importance._features([text.encode()], hasher)[0][1].tolist()) == sorted(grams(text)[1])


def test_resampling_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).count() == 0
    assert importance.resample(docs, none).count() == docs.count()


def test_the_draw_favours_the_target(spark):
    """Target-like documents are a tenth of the corpus and make up nearly all of what is drawn."""
    rng = random.Random(1)
    like = lambda kind, n: " ".join(rng.choice(("red", "green", "blue") if kind else ("one", "two", "three")) for _ in range(n))
    rows = [(i, like(i % 10 == 0, 60)) for i in range(400)]
    target = spark.createDataFrame([(like(True, 40),) for _ in range(20)], "text string")
    drawn = [r.doc_id for r in importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()]
    assert len(drawn) == 20 and all(i % 10 == 0 for i in drawn)


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "a <|im_end|> b", "<\\\\|x<|<\\|", "<<||", "\\<|\\", "<|im_start|>assistant\n"])
def test_escaping_comes_back_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat._role_in(chat._role_out(text)) == text


def test_chat_equals_its_sql(spark):
    columns, rows = spark_rows(queries.op13_chat(spark, SF))
    want_columns, want = duckdb_rows(queries.ORACLE["op13_chat"], SF)
    assert columns == want_columns and rows == want


TURNS = [
    (1, 0, "system", "s"), (1, 1, "user", "u <|im_end|>"), (1, 2, "assistant", "a\n<\\|"), (2, 0, "assistant", "too early"), (2, 1, "user", "x"), (3, None, "user", None), (3, 5, "assistant", ""),
    (4, 1, "user", "tie b"), (4, 1, "user", "tie a"), (4, 1, "user", "tie a"), (None, 0, "user", "no id"), (5, 0, "tool\nkit\\", "odd role"), (6, 0, None, "no role"), (7, 0, "user", "q"), (7, 1, "assistant", "é" * 5000),
]


def digested(turns: list[tuple]) -> list[tuple]:
    rows = []
    for key in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == key))
        state, order = "start", True
        for _, _, role, _ in own:
            state = chat.CHATML.step(state, role)
        order = state in chat.CHATML.accepting
        said, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in own), "".join(x for _, _, r, x in own if r == "assistant")
        chars = sum(len(f"<|im_start|>{chat._role_out(r)}\n{chat.escape(x)}<|im_end|>\n") for _, _, r, x in own)
        rows.append((key, len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars, order))
    return sorted(rows, key=repr)


def test_chat_edge_cases(spark):
    turns = spark.createDataFrame([(*t, "x", 3) for t in TURNS], "conv_id long, turn long, role string, text string, state string, pos long").repartition(3)
    got = sorted((tuple(r) for r in chat.conversation_digests(chat.format_turns(turns)).collect()), key=repr)
    assert got == digested(TURNS)
    assert chat.format_turns(turns.limit(0)).count() == 0


def test_one_conversation_over_many_ranges(spark):
    """A hot conversation is split, and the machine's state goes from range to range."""
    rng = random.Random(2)
    turns = [(9, i, ("user", "assistant")[i % 2], "w " * rng.randint(0, 300)) for i in range(4000)] + [(k, 0, "user", "hi") for k in range(10, 40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        segments = chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)).cache()
        assert segments.where("conv_id = 9").selectExpr(f"shiftright(pos, {chat.RANGE_BITS})").distinct().count() > 1
        assert segments.where("state = 'error'").count() == 0
        assert sorted((tuple(r) for r in chat.conversation_digests(segments).collect()), key=repr) == digested(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_strict_templates_train_on_nothing_after_an_error(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "early"), (1, 1, "user", "q"), (1, 2, "assistant", "late")], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(turns, chat.Template(strict=True)).where("loss").count() == 0
    assert chat.format_turns(turns).where("loss").count() == 2
