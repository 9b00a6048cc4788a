"""Exact ids of whole texts by a public tokenizer's own library, remembering what it has encoded.

Where the tokenizer's declared pre-processing drops white space and never looks across it, a text's
ids are those of its white-space-separated chunks one after the other; the library then encodes each
distinct chunk once. Everything else, and any text that holds a special token's string, goes to the
library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np

from .spans import give_back

#: Chunks and letter runs remembered; beyond it only the first ``HELD`` of each stay, as frequent ones are met early, and ``KEPT`` after a task.
MAX_CHUNKS, MAX_WORDS, HELD, KEPT = 500_000, 350_000, 250_000, 120_000
#: Letter runs sent to the library in one text.
JOINED = 2000
_STOPS = b".,;:!?"

# fixed values: pre-processing known to treat white-space-separated chunks apart from each other
_CHUNK_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
_CHUNK_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def version_digest(path: str) -> str:
    """What names a tokenizer in the cache: the SHA-256 of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _ids(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class TextEncoder:
    """ids(texts): the little-endian unsigned 32-bit ids of each UTF-8 text, without added tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.special: list[bytes] = []
        self.by_chunk = False
        self.final: np.ndarray | None = None
        self._model = None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: pieces.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._encode = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            spec = json.loads(Path(path).read_text(encoding="utf-8"))
            self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
            pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
            split = pre[0].get("type") == "Split" and pre[0].get("pattern") == {"Regex": _CHUNK_PATTERN} and pre[0].get("behavior") == "Removed" and pre[0].get("invert")
            rest = all(p.get("type") == "ByteLevel" and not p.get("use_regex") and not p.get("add_prefix_space") for p in pre[1:])
            norm = (spec.get("normalizer") or {}).get("normalizers") or []
            self.by_chunk = bool(split and rest and not spec.get("post_processor") and all(n in _CHUNK_NORMALIZERS for n in norm))
            lowered = all(n in norm for n in _CHUNK_NORMALIZERS[::2])
            if self.by_chunk and lowered and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout"):
                # what comes before the model leaves a run of lower-case ASCII letters as it is
                self._model = tok.model
            suffix = spec["model"].get("end_of_word_suffix")
            if suffix:
                # the last token of a letter run, and no other, is a word-final piece
                self.final = np.zeros(tok.get_vocab_size() + 1, bool)
                self.final[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(suffix)]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.asarray(i, "<u4").tobytes() for i in self._encode([t.decode("utf-8", "replace") for t in texts])]

    def _spell(self, group: list[bytes]) -> list[bytes]:
        """The ids of each letter run."""
        if self._model is not None:
            tokenize = self._model.tokenize
            rest = [w for w in group if not w.isascii()]
            later = iter(self._spell_joined(rest) if rest else ())
            return [_ids([t.id for t in tokenize(w.decode())]) if w.isascii() else next(later) for w in group]
        return self._spell_joined(group)

    def _spell_joined(self, group: list[bytes]) -> list[bytes]:
        if self.final is not None:
            ids = np.asarray(self._encode([b" ".join(group).decode("utf-8", "replace")])[0], "<u4")
            ends = (np.flatnonzero(self.final[ids]) + 1) * 4
            if len(ends) == len(group):
                data, ends = ids.tobytes(), ends.tolist()
                return [data[s:e] for s, e in zip([0, *ends], ends)]  # noqa: B905
        return self.whole(group)

    def _learn(self, chunks: set[bytes]) -> None:
        if len(self.words) > MAX_WORDS:
            self.words = dict(islice(self.words.items(), HELD))
        known = self.words
        parts: list[tuple[bytes, bytes, bytes]] = []
        odd: list[bytes] = []
        new: dict[bytes, None] = {}
        for c in chunks:
            # letters, then one run of plain stops: two tokens of the pre-processing, each with ids of its own
            body = c.rstrip(_STOPS)
            if body.isalpha():  # of ASCII letters alone
                word = body.lower()
            elif body.isascii() or not body.decode("utf-8", "replace").isalpha():
                odd.append(c)
                continue
            else:
                word = body
            parts.append((c, word, c[len(body) :]))
            if word not in known:
                new[word] = None
        fresh = list(new)
        for at in range(0, len(fresh), JOINED):
            group = fresh[at : at + JOINED]
            known.update(zip(group, self._spell(group), strict=True))
        plain = [*odd, *{s for _, _, s in parts if s and s not in self.chunks}]
        learned = self.chunks
        learned.update(zip(plain, self.whole(plain), strict=True))
        for c, w, s in parts:
            learned[c] = known[w] + learned[s] if s else known[w]

    def trim(self) -> None:
        """Give most of the memory back: for the end of a task, as workers live on and Spark keeps several of them."""
        self.chunks, self.words = dict(islice(self.chunks.items(), KEPT)), dict(islice(self.words.items(), KEPT))
        give_back()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        apart = [i for i, t in enumerate(texts) if not self.by_chunk or any(s in t for s in self.special)]
        for i, b in zip(apart, self.whole([texts[i] for i in apart]), strict=True):
            out[i] = b
        for i, t in enumerate(texts):
            if out[i] is None:
                if len(self.chunks) > MAX_CHUNKS:
                    self.chunks = dict(islice(self.chunks.items(), HELD))
                pieces = t.split()
                try:
                    out[i] = b"".join(map(self.chunks.__getitem__, pieces))
                except KeyError:
                    # learn for the texts that follow as well: fewer, larger calls
                    ahead = {c for k in range(i, min(i + 64, len(texts))) if out[k] is None for c in texts[k].split()}
                    self._learn({c for c in ahead if c not in self.chunks})
                    out[i] = b"".join(map(self.chunks.__getitem__, pieces))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and tokenizer file."""
    return TextEncoder(path)
