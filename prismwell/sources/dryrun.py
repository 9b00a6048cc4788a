"""The adapter seam for models: rows in, samples out. Only the deterministic dry run is built in."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
SAMPLE = "sample_id string, route string, prompt string, status string, size long, sha256 string"


def placeholder_png(seed: str, width: int = 64, height: int = 64) -> bytes:
    """A small picture that depends on the seed alone."""
    d = hashlib.sha256(seed.encode()).digest()
    line = b"\0" + bytes((d[0], d[1], d[2])) * width

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(line * height)) + chunk(b"IEND", b"")


def packed_codes(indices: bytes, width: int) -> bytes:
    """LZW codes of palette indices below ``2 ** width``, as a GIF frame holds them: of growing width, least bits first.

    The table starts with the indices and two marks, clear and end. It takes a new string with each code,
    codes grow by a bit when the next string's number needs it, and a full table is cleared.
    """
    clear, end = 1 << width, (1 << width) + 1
    bits, held, out = 0, 0, bytearray()
    table: dict[tuple[int, int], int] = {}
    size, following = width + 1, end + 1

    def put(code: int) -> None:
        nonlocal bits, held
        held |= code << bits
        bits += size
        while bits >= 8:
            out.append(held & 0xFF)
            held >>= 8
            bits -= 8

    put(clear)
    so_far = -1
    for index in indices:
        if so_far < 0:
            so_far = index
        elif (known := table.get((so_far, index))) is not None:
            so_far = known
        else:
            put(so_far)
            if following == 1 << 12:
                put(clear)
                table, size, following = {}, width + 1, end + 1
            else:
                if following == 1 << size:
                    size += 1
                table[so_far, index] = following
                following += 1
            so_far = index
    if so_far >= 0:
        put(so_far)
        if following == 1 << size and size < 12:
            size += 1  # a reader has counted one string more
    put(end)
    if bits:
        out.append(held & 0xFF)
    return bytes(out)


def gif(frames: list[bytes], width: int, height: int, palette: list[tuple[int, int, int]], hundredths: int = 20) -> bytes:
    """An animation, shown over and over: each frame has a palette index for each point."""
    depth = max(2, (len(palette) - 1).bit_length())
    colors = b"".join(map(bytes, palette)).ljust(3 << depth, b"\0")
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | (depth - 1), 0, 0), colors, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for frame in frames:
        data = packed_codes(frame, depth)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 0, hundredths, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, height, 0), bytes([depth])]
        out += [bytes([len(part)]) + part for at in range(0, len(data), 255) for part in [data[at : at + 255]]]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def placeholder_gif(seed: str, frames: int = 8, width: int = 64, height: int = 64) -> bytes:
    """A small animation that depends on the seed alone: a bar that moves over a ground."""
    d = hashlib.sha256(seed.encode()).digest()
    palette = [tuple(d[0:3]), tuple(d[3:6]), tuple(d[6:9]), tuple(255 - x for x in d[0:3])]
    bar, pictures = 4 + d[9] % 8, []
    for k in range(frames):
        at = k * width // frames
        line = bytes(1 if at <= x < at + bar else 0 for x in range(width))
        edge = bytes(2 if (x + k) % 16 < 8 else 3 for x in range(width))
        pictures.append(edge * 2 + line * (height - 4) + edge * 2)
    return gif(pictures, width, height, palette)


#: The pictures of a dry run by route: moving ones where the route asks for them.
PLACEHOLDERS = {"t2i": placeholder_png, "edit": placeholder_png, "t2v": placeholder_gif}


def generate(requests: DataFrame, generator: Generator, schema: str = SAMPLE) -> DataFrame:
    """Run an adapter over requests, a batch at a time."""
    return requests.mapInPandas(generator, schema)


def dry_run(route: str, done: frozenset[str] = frozenset()) -> Generator:
    """Samples with placeholder pictures; those that are done already are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sample, prompt in zip(pdf["sample_id"].astype(str), pdf["prompt"].fillna(""), strict=True):
                picture = PLACEHOLDERS.get(route, placeholder_png)(f"{route}:{sample}:{prompt}")
                rows.append((sample, route, prompt, "skipped_existing" if sample in done else "generated", len(picture), hashlib.sha256(picture).hexdigest()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SAMPLE.split(", ")])

    return run
