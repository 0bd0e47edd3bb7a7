"""Encoders to exercise the jobs on real tables: one that fails for some texts, and one with a
tokenizer of its own."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from vectorloom.encoders import Encoder, EncoderFactory, EncoderRejected, EncoderUnavailable, TokenizeFailed
from vectorloom.encoders.tokens import TokenEncoder
from vectorloom.registry import REGISTRY


@dataclass(frozen=True)
class FaultyFactory:
    """Wraps a factory. A call fails if it holds a text whose md5 starts with a small byte:
    below ``rate`` rejected, then unavailable, an unforeseen exception, not tokenised, and
    rejected by the model with 503, each ``rate`` values wide. Models in ``missing`` do not
    load."""

    inner: EncoderFactory
    rate: int = 0
    missing: tuple[str, ...] = ()

    def __call__(self, model: str) -> "FaultyEncoder":
        if model in self.missing:
            raise EncoderUnavailable("weights missing")
        return FaultyEncoder(self.inner(model), self.rate)


class FaultyEncoder:
    def __init__(self, inner: Encoder, rate: int):
        self.inner = inner
        self.rate = rate

    def encode(self, texts: list[str]) -> np.ndarray:
        for text in texts:
            kind = hashlib.md5(text.encode()).digest()[0] // self.rate if self.rate else 5
            if kind == 0:
                raise EncoderRejected(400, "input rejected")
            if kind == 1:
                raise EncoderUnavailable("connection refused")
            if kind == 2:
                raise ValueError("unexpected answer")
            if kind == 3:
                raise TokenizeFailed("bad input")
            if kind == 4:
                raise EncoderRejected(503, "loading model")
        return self.inner.encode(texts)


@dataclass(frozen=True)
class PairFactory:
    """Encoders whose tokens are two characters each, with the models' own limits and numbers of
    special tokens."""

    def __call__(self, model: str) -> "PairEncoder":
        return PairEncoder(model)


class PairEncoder(TokenEncoder):
    """A text's vector is the number of its tokens, special ones included, and the last id."""

    def __init__(self, model: str):
        facts = {m.key: m for m in REGISTRY}[model]
        self.n_ctx = facts.n_ctx
        self.prefix, self.suffix = (-1,) * facts.start_tokens, (-2,) * facts.end_tokens

    def tokenize(self, texts: list[str]) -> list[list[int]]:
        return [[ord(t[k]) * 0x110000 + ord(t[k + 1 : k + 2] or "\0") for k in range(0, len(t), 2)] for t in texts]

    def encode_tokens(self, sequences: list[list[int]]) -> np.ndarray:
        return np.array([[len(ids), ids[-1] if ids else 0] for ids in sequences], float).reshape(-1, 2)
