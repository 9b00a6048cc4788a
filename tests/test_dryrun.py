"""Placeholder pictures against decoders written for the test, and the dry run's samples."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest

from prismwell.sources import dryrun


def unpacked(data: bytes, width: int) -> bytes:
    """Decodes LZW codes the reader's way: strings are whole, and the table is a step behind the writer's."""
    clear, end = 1 << width, (1 << width) + 1
    stream, at = int.from_bytes(data, "little"), 0
    table: dict[int, bytes] = {}
    size, before, out = width + 1, None, bytearray()
    while True:
        code = stream >> at & ((1 << size) - 1)
        at += size
        if code == clear:
            table, size, before = {i: bytes([i]) for i in range(clear)} | {clear: b"", end: b""}, width + 1, None
            continue
        if code == end:
            assert at <= 8 * len(data) < at + 8
            return bytes(out)
        said = table[code] if code in table else before + before[:1]
        out += said
        if before is not None and len(table) < 1 << 12:
            table[len(table)] = before + said[:1]
            if len(table) == 1 << size and size < 12:
                size += 1
        before = said


def frames_of(data: bytes) -> tuple[int, int, list[tuple], list[bytes]]:
    assert data[:6] == b"GIF89a" and data[-1:] == b";"
    width, height, flags = struct.unpack("<HHB", data[6:11])
    n = 2 << (flags & 7)
    palette = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(n)]
    at, frames = 13 + 3 * n, []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
        else:
            assert data[at] == 0x2C and struct.unpack("<HHHH", data[at + 1 : at + 9]) == (0, 0, width, height)
            depth = data[at + 10]
            at += 11
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        if data[at - 1] == 0 and parts and not (parts[0] == b"NETSCAPE2.0" or len(parts[0]) == 4 and len(parts) == 1 and parts[0][0] == 0):
            frames.append(unpacked(b"".join(parts), depth))
    return width, height, palette, frames


@pytest.mark.parametrize("width", [2, 3, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 100, 5000, 60_000])
def test_codes_come_back(width, n):
    rng = random.Random(n + width)
    for data in (bytes(rng.randrange(1 << width) for _ in range(n)), bytes(n), bytes(i * i % (1 << width) for i in range(n))):
        assert unpacked(dryrun.packed_codes(data, width), width) == data


def test_every_length_around_a_change_of_width():
    data = bytes(random.Random(1).randrange(4) for _ in range(700))
    for n in range(700):
        assert unpacked(dryrun.packed_codes(data[:n], 2), 2) == data[:n]


def test_an_animation_gives_its_frames_back():
    width, height, palette, frames = frames_of(dryrun.placeholder_gif("seed", frames=5, width=40, height=30))
    assert (width, height, len(frames)) == (40, 30, 5)
    assert all(len(f) == 1200 and set(f) == {0, 1, 2, 3} for f in frames) and len(set(frames)) == 5
    assert dryrun.placeholder_gif("seed") == dryrun.placeholder_gif("seed") != dryrun.placeholder_gif("other")
    assert palette[:1] == [tuple(hashlib.sha256(b"seed").digest()[:3])]


def test_a_still_picture_has_its_lines():
    data = dryrun.placeholder_png("seed", 10, 4)
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at = data.index(b"IDAT")
    (size,) = struct.unpack(">I", data[at - 4 : at])
    assert zlib.decompress(data[at + 4 : at + 4 + size]) == (b"\0" + hashlib.sha256(b"seed").digest()[:3] * 10) * 4


@pytest.mark.parametrize(("route", "magic"), [("t2i", b"\x89PNG"), ("t2v", b"GIF8"), ("edit", b"\x89PNG")])
def test_samples_of_a_dry_run(spark, route, magic):
    rows = spark.createDataFrame([("a", "one"), ("b", None), ("c", "three")], "sample_id string, prompt string")
    got = {r["sample_id"]: r for r in dryrun.generate(rows, dryrun.dry_run(route, frozenset({"c"}))).collect()}
    assert [got[k]["status"] for k in "abc"] == ["generated", "generated", "skipped_existing"]
    for k, prompt in (("a", "one"), ("b", ""), ("c", "three")):
        picture = dryrun.PLACEHOLDERS[route](f"{route}:{k}:{prompt}")
        assert picture[:4] == magic and (got[k]["size"], got[k]["sha256"]) == (len(picture), hashlib.sha256(picture).hexdigest())
