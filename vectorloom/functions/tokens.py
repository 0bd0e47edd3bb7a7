"""Token expressions.

``tokenize`` is the stand-in tokenizer (runs of non-space); real subword tokenizers
live in encoder plug-ins, and ``plugin_token_counts`` asks them. ``truncate_tokens`` works on any token array.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from vectorloom.encoders.base import EncoderFactory, load_encoder
from vectorloom.functions.binding import int_div, let


def tokenize(text: Column) -> Column:
    """The whitespace-separated words of a text, without special tokens."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def first_words(text: Column, n: Column) -> Column:
    """At most ``n + 1`` pieces: the first ``n`` words and, if there are more, the rest."""
    return F.filter(F.split(F.regexp_replace(text, r"^\s+", ""), r"\s+", n + 1), lambda w: w != "")


def kept_tokens(n_tokens: Column, limit: Column, n_special: Column) -> Column:
    """How many tokens, special ones included, remain once a text is cut to ``limit``."""
    cut = n_special + F.greatest(F.lit(0), limit - n_special)
    return F.when(n_tokens <= limit, n_tokens).otherwise(cut)


def truncate_tokens(tokens: Column, limit: Column, prefix: Column, suffix: Column) -> Column:
    """Cut ``tokens`` to ``limit`` by dropping the end of the text, not the special tokens.

    What stays is the front of the sequence and, where the sequence ends with ``suffix``,
    that suffix. The front is as long as the limit allows but never shorter than a
    ``prefix`` the sequence starts with, so a limit below the number of special tokens is
    exceeded.
    """
    size, n_prefix, n_suffix = F.size(tokens), F.size(prefix), F.size(suffix)
    starts = F.slice(tokens, F.lit(1), n_prefix) == prefix
    back = F.slice(tokens, F.greatest(F.lit(1), size - n_suffix + 1), n_suffix)
    n_front = F.when(starts, n_prefix).otherwise(0)
    n_back = F.when(back == suffix, n_suffix).otherwise(0)
    front = F.slice(tokens, F.lit(1), F.greatest(n_front, limit - n_back))
    return F.when(size <= limit, tokens).otherwise(
        F.concat(front, F.slice(back, F.lit(1), n_back))
    )


def may_overflow(text: Column, limit: Column, n_special: Column) -> Column:
    """False only for texts that certainly fit into ``limit``, told by their length.

    A word is at least one character and one separator, so a text under twice the room in
    characters fits. That covers most texts and saves tokenising them.
    """
    return F.length(text) + 1 > 2 * F.greatest(F.lit(0), limit - n_special)


def fit_text(text: Column, limit: Column, n_special: Column) -> Column:
    """A text whose words and special tokens fit into ``limit``."""
    room = F.greatest(F.lit(0), limit - n_special)

    def cut(words: Column) -> Column:
        start = F.array_join(F.slice(words, F.lit(1), room), " ")
        return F.when(F.size(words) <= room, text).otherwise(start)

    fits = ~may_overflow(text, limit, n_special)
    return F.when(fits, text).otherwise(let(first_words(text, room), cut))


def plugin_token_counts(factory: EncoderFactory, model: Column, text: Column) -> Column:
    """How many tokens the plug-in of a model makes of a text, special tokens included.

    Texts reach the plug-in's ``tokenize`` (see ``TokenEncoder``) in Arrow batches, those of a
    model together, and only counts come back. Null for a null text or model. The package has
    to be on the workers (``session.attach``).
    """

    def count(models: pa.Array, texts: pa.Array) -> pa.Array:
        names, values = models.to_pylist(), texts.to_pylist()
        counts: list[int | None] = [None] * len(values)
        for name in sorted({n for n in names if n is not None}):
            own = [k for k, (n, v) in enumerate(zip(names, values)) if n == name and v is not None]
            if own:
                encoder = load_encoder(factory, name)
                special = len(encoder.prefix) + len(encoder.suffix)
                for k, ids in zip(own, encoder.tokenize([values[k] for k in own])):
                    counts[k] = len(ids) + special
        return pa.array(counts, pa.int32())

    count.__annotations__ = {"models": pa.Array, "texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, T.IntegerType())(model, text)


def windows(text: Column, parts: int = 4, overlap: int = 0) -> Column:
    """A text in windows of ``ceil(n / parts)`` of its n words: structs of ``window`` (from 0),
    ``start`` (characters before it), ``n_tokens`` and ``text``.

    Neighbouring windows share ``overlap`` words (fewer where a window has no more). Windows are
    pieces of the text as it stands, white space between words included, cut at word ends. Each
    begins by one step behind the one before, until one reaches the end. A text without words has
    none; a null text gives null.
    """
    def of(words: Column) -> Column:
        n = F.size(words)
        size = int_div(n + (parts - 1), parts)
        step = F.greatest(F.lit(1), size - overlap)
        last = int_div(F.greatest(n - size, F.lit(0)) + step - 1, step)

        def window(k: Column) -> Column:
            held = F.slice(words, k * step + 1, size)
            before = F.length(F.array_join(F.slice(words, F.lit(1), k * step), ""))
            return F.struct(
                k.alias("window"),
                (F.length(F.regexp_extract(text, r"^\s*", 0)) + before).alias("start"),
                F.size(held).alias("n_tokens"),
                F.regexp_replace(F.array_join(held, ""), r"\s+$", "").alias("text"),
            )

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(
            F.transform(F.array().cast("array<int>"), window)
        )

    words = F.regexp_extract_all(text, F.lit(r"(\S+\s*)"), F.lit(1))
    return F.when(text.isNotNull(), let(words, of))
