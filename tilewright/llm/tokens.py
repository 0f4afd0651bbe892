"""Exact ids of public tokenizers, with a bounded cache per piece of text.

Byte-pair merges never cross the pieces that the pre-tokenizer cuts, so a piece's ids are looked
up once. Texts whose characters all lie in a range with long-settled Unicode classes are cut by an
equal pattern here; any other text, and any that may hold the string of an added token, goes
through the library as a whole. Such strings become the added token's id, as is the library's
rule; with ``special_as_text`` they are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

CACHE, KEPT = 600_000, 50_000
#: Characters whose class Python, the library and every Unicode version agree on.
_SAFE = [c for c in map(chr, [*range(0x1C), *range(0x20, 0x250), *range(0x2010, 0x2028)]) if unicodedata.category(c) not in ("Cn", "No")]
_safe = re.compile("[" + "".join(f"\\u{ord(c):04x}" for c in _SAFE) + "]*").fullmatch
#: The public patterns of both vocabularies, written for the safe range, letters first.
_BYTE = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+").findall
_WORD = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|(?:[^\w\s]|_)+").findall
#: The same where a text is ASCII.
_BYTE_ASCII = re.compile(r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
_WORD_ASCII = re.compile(r"[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sA-Za-z0-9]+", re.ASCII).findall


def _visible() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def vocabulary(name: str) -> str:
    """The default place of a public vocabulary file; a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text) as the library gives them, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        spec = json.loads(self.library.to_str())
        added = [t["content"] for t in spec.get("added_tokens") or [] if not (special_as_text and t.get("special"))]
        # no text without the added tokens' common beginning, up to its first letter, holds one
        self.mark = re.match(r"[\W\d_]*", os.path.commonprefix(added))[0] if added else None
        pre, model = json.dumps(spec["pre_tokenizer"]), spec["model"]
        self.cut, self.lower, self.piece = None, False, self._by_model
        if spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]:
            self.cut, self.cut_ascii = _BYTE, _BYTE_ASCII
        elif spec["normalizer"] and '"Split"' in pre and r"[\\p{L}]+|[\\p{N}]|" in pre:
            self.cut, self.cut_ascii, self.lower = _WORD, _WORD_ASCII, True
        self.table = dict(enumerate(_visible()))
        vocab, merges = model.get("vocab", {}), model.get("merges") or []
        joined = (m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in merges)
        if self.cut and not model.get("end_of_word_suffix") and all(vocab[m] == 256 + i for i, m in enumerate(joined)):
            import tiktoken  # merge ranks are the ids: the same merges, faster

            back = {c: b for b, c in self.table.items()}
            ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if all(c in back for c in t)}
            self.core = tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.piece = self._by_ranks
        self.cache: dict[str, bytes] = {}

    def _by_ranks(self, piece: str) -> bytes:
        return np.array(self.core.encode_single_piece(piece.encode()), "<u4").tobytes()

    def _by_model(self, piece: str) -> bytes:
        return np.array([t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.table))], "<u4").tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def packed(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
            elif self.cut is None or (self.mark is not None and self.mark in text) or not _safe(text):
                yield self._whole([text])[0]
            else:
                pieces = (self.cut_ascii if text.isascii() else self.cut)(text.lower() if self.lower else text)
                try:
                    yield b"".join(map(self.cache.__getitem__, pieces))
                except KeyError:
                    if len(self.cache) > CACHE:  # the earliest pieces are the common ones
                        self.cache = dict(islice(self.cache.items(), KEPT))
                    for p in pieces:
                        if p not in self.cache:
                            self.cache[p] = self.piece(p)
                    yield b"".join(map(self.cache.__getitem__, pieces))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]
