"""Encoder plug-ins."""

from vectorloom.encoders.base import (
    Encoder,
    EncoderFactory,
    EncoderRejected,
    EncoderUnavailable,
    TokenizeFailed,
    load_encoder,
)
from vectorloom.encoders.hashing import HashingFactory
from vectorloom.encoders.tokens import TokenEncoder

__all__ = [
    "Encoder",
    "EncoderFactory",
    "EncoderRejected",
    "EncoderUnavailable",
    "HashingFactory",
    "TokenEncoder",
    "TokenizeFailed",
    "load_encoder",
]
