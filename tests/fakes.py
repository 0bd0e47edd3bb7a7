"""Encoders whose results can be traced back to their inputs."""

import time
from dataclasses import dataclass

import numpy as np

from vectorloom.encoders import EncoderRejected, EncoderUnavailable, TokenEncoder, TokenizeFailed


class Numbers:
    """A numeral becomes the vector (its value, 1); some words make the call fail."""

    def __init__(self):
        self.sizes = []

    def encode(self, texts):
        self.sizes.append(len(texts))
        for text in texts:
            word = text.split()[-1] if text.split() else ""
            if word == "loading":
                raise EncoderRejected(503, "loading")
            if word == "refused":
                raise EncoderRejected(400, "refused")
            if word == "gone":
                raise EncoderUnavailable("no route")
            if word == "untokenizable":
                raise TokenizeFailed("bad bytes")
            if word == "broken":
                raise KeyError("broken")
        return np.array([[float(t.split()[-1]), 1.0] for t in texts], np.float32)


@dataclass(frozen=True)
class NumbersFactory:
    def __call__(self, model):
        return Numbers()


@dataclass(frozen=True)
class FixedFactory:
    """Every text embeds as the same vector."""

    vector: tuple

    def __call__(self, model):
        return self

    def encode(self, texts):
        return np.array([self.vector] * len(texts), np.float32)


@dataclass(frozen=True)
class ShortFactory:
    """Loses a vector."""

    def __call__(self, model):
        return self

    def encode(self, texts):
        return np.ones((len(texts) - 1, 2), np.float32)


@dataclass(frozen=True)
class SlowDocuments:
    """Every call with a document of the first model takes a while."""

    def __call__(self, model):
        return self

    def encode(self, texts):
        if any("title: none" in t for t in texts):
            time.sleep(0.7)
        return np.ones((len(texts), 2), np.float32)


class CharacterEncoder(TokenEncoder):
    """Characters as tokens between a start (1) and an end (2): counts, first and last id."""

    n_ctx, prefix, suffix = 11, (1,), (2,)

    def tokenize(self, texts):
        if any("\x00" in t for t in texts):
            raise ValueError("bad byte")
        return [list(map(ord, t)) for t in texts]

    def encode_tokens(self, sequences):
        return np.array([[len(s), s[0], s[-2], s[-1]] for s in sequences], np.float32)


@dataclass(frozen=True)
class CharacterFactory:
    def __call__(self, model):
        return CharacterEncoder()


numbers = NumbersFactory()
