"""A base for encoders with a tokenizer of their own."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from vectorloom.encoders.base import EncoderUnavailable, TokenizeFailed


class TokenEncoder:
    """Implement ``tokenize`` and ``encode_tokens``; texts are then cut by their own tokens.

    ``tokenize`` returns the ids of the text alone. The special tokens named by ``prefix`` and
    ``suffix`` are put around what fits between them. Run it with ``truncate=False``, so that
    texts arrive whole.
    """

    n_ctx: int
    prefix: Sequence[int] = ()
    suffix: Sequence[int] = ()

    def tokenize(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode_tokens(self, sequences: list[list[int]]) -> np.ndarray:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> np.ndarray:
        try:
            sequences = self.tokenize(texts)
        except EncoderUnavailable:
            raise
        except Exception as error:
            raise TokenizeFailed(str(error)) from error
        room = max(0, self.n_ctx - 1 - len(self.prefix) - len(self.suffix))
        return self.encode_tokens([[*self.prefix, *ids[:room], *self.suffix] for ids in sequences])
