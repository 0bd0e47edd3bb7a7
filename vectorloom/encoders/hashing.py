"""A deterministic stand-in encoder: signed feature hashing of words.

It has no semantic quality. It exists so that every step around a model can be run and
checked without model weights.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np

_MEMO_SIZE = 1 << 19


@dataclass(frozen=True)
class HashingFactory:
    """``widths`` pairs each model with its native width."""

    widths: tuple[tuple[str, int], ...]

    def __call__(self, model: str) -> "HashingEncoder":
        return HashingEncoder(dict(self.widths)[model])


class _Slots(dict):
    """Per word 2 * component + (1 if the sign is positive), worked out on first use.

    Emptied when full: that bounds the memory, not the results.
    """

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        slot = ((h >> 1) % self.width) * 2 + (h & 1)
        if len(self) >= _MEMO_SIZE:
            self.clear()
        self[word] = slot
        return slot


class HashingEncoder:
    def __init__(self, width: int):
        self.width = width
        self._slots = _Slots(width)

    def encode(self, texts: list[str]) -> np.ndarray:
        # Bytes split at ASCII white space only, as functions.tokens.tokenize does.
        words = [text.encode().split() for text in texts]
        lengths = [len(w) for w in words]
        slots = np.fromiter(
            map(self._slots.__getitem__, chain.from_iterable(words)), np.int64, sum(lengths)
        )
        vectors = np.zeros((len(texts), self.width), np.float32)
        places = np.repeat(np.arange(len(texts)) * self.width, lengths) + (slots >> 1)
        np.add.at(vectors.reshape(-1), places, ((slots & 1) * 2 - 1).astype(np.float32))
        return vectors
