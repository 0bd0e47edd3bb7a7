"""The interface an embedding model implements to run inside Spark tasks."""

from __future__ import annotations

from typing import Protocol

import numpy as np


class Encoder(Protocol):
    """Texts, already prompted and cut to the context, to full-width vectors."""

    def encode(self, texts: list[str]) -> np.ndarray:
        """One row of ``native_dim`` floats per text, in the order of the texts."""


class EncoderFactory(Protocol):
    """Makes the encoder of a model. Has to be picklable and hashable."""

    def __call__(self, model: str) -> Encoder: ...


class EncoderUnavailable(Exception):
    """The model could not be reached."""


class TokenizeFailed(Exception):
    """The model's tokenizer refused the text."""


class EncoderRejected(Exception):
    """The model answered with an error; ``code`` is its status."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


_LOADED: dict[tuple[EncoderFactory, str], Encoder] = {}


def load_encoder(factory: EncoderFactory, model: str) -> Encoder:
    """The encoder of a model, loaded once per Python worker and reused by its tasks."""
    key = (factory, model)
    if key not in _LOADED:
        _LOADED[key] = factory(model)
    return _LOADED[key]


def describe_failure(error: Exception) -> tuple[str, int | None, str]:
    """An exception as the (kind, code, message) of an outcome."""
    if isinstance(error, EncoderUnavailable):
        return "unavailable", None, str(error)
    if isinstance(error, TokenizeFailed):
        return "tokenize", None, str(error)
    if isinstance(error, EncoderRejected):
        return "rejected", error.code, str(error)
    return "exception", None, str(error)
