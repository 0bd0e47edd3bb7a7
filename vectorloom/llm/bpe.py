"""Byte-level BPE of whole documents with content-defined chunks that are encoded once."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from vectorloom.llm.common import arrow_schema, arrow_stage, table

WINDOW = 32  # bytes that the rolling hash sees
CUT_BITS = 10  # a chunk has about 2**10 bytes
LEAST, MOST = 256, 16_384  # bytes of a chunk
SHARED = 8192  # shared chunks in the dictionary that goes to every task
CACHE_BYTES = 16 << 20  # text of other chunks that a task remembers
_SLICE = 1 << 20
# The pattern that the byte-level pre-tokenizer of this vocabulary splits by (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Up to this code point the two libraries' character classes agree (a test compares them).
PLAIN_LIMIT = "ɏ"
_OTHER = re.compile(f"[^\\x00-{PLAIN_LIMIT}]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own}
    for k, byte in enumerate(b for b in range(256) if b not in own):
        letters[chr(256 + k)] = byte
    return letters


class Codec:
    """Encodes and decodes as the ``tokenizers`` library does with the same file.

    Plain text goes through ranked byte merges, several times faster; text with characters
    beyond :data:`PLAIN_LIMIT` goes through the library itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"] if t["special"]}
        letters = _byte_letters()
        vocabulary = stored["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.numbers = [str(i) for i in range(size)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in stored["model"]["merges"]]
        in_order = [vocabulary["".join(m)] for m in merges] == list(range(256, 256 + len(merges)))
        plain = stored["normalizer"] is None and stored["post_processor"] is None and stored["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }
        self.merged = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order and plain else None

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, loaded for the first text that needs it."""
        loaded = Tokenizer.from_file(self.path)
        loaded.no_padding()
        loaded.no_truncation()
        return loaded

    def segment(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if self.merged is None or _OTHER.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.merged.encode_ordinary(text)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


# --- content-defined chunks -----------------------------------------------------------

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Where a text is cut: after bytes whose last :data:`WINDOW` bytes hash to a small value,
    never inside a character. Equal passages get equal cuts wherever they stand."""
    found: list[np.ndarray] = []
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), _SLICE):
        begin = max(0, at - WINDOW + 1)
        rolled = _GEAR[raw[begin : at + _SLICE]]
        width = 1
        while width < WINDOW:
            rolled[width:] += rolled[:-width] << np.uint32(width)
            width *= 2
        places = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + begin + 1
        found.append(places[places > at])
    cuts: list[int] = []
    last = 0
    for place in [*(np.concatenate(found).tolist() if found else []), len(raw)]:
        while place - last > MOST:
            step = last + MOST
            while raw[step] & 0xC0 == 0x80:
                step -= 1
            cuts.append(step)
            last = step
        if place - last >= LEAST and place < len(raw) and raw[place] & 0xC0 != 0x80:
            cuts.append(place)
            last = place
    return cuts


def chunks(data: bytes) -> list[bytes]:
    edges = [0, *cut_points(data), len(data)]
    return [data[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def _seen(c: str) -> bool:
    return "!" <= c <= "~" or "À" <= c <= PLAIN_LIMIT


def _anchors(text: str) -> tuple[int, int] | None:
    """The first and last place where a single space stands between two visible characters.

    The pre-tokenizer splits before such a space whatever else the text holds, so ids on the
    two sides do not depend on each other.
    """
    first = text.find(" ", 1)
    while first >= 0 and not (first + 1 < len(text) and _seen(text[first - 1]) and _seen(text[first + 1])):
        first = text.find(" ", first + 1)
    if first < 0:
        return None
    last = text.rfind(" ")
    while not (last + 1 < len(text) and _seen(text[last - 1]) and _seen(text[last + 1])):
        last = text.rfind(" ", 0, last)
    return first, last


Piece = tuple[str, array, str]


class ChunkEncoder:
    """Encodes texts chunk by chunk. ``shared`` chunks come encoded; of the others, those
    seen lately are remembered, up to a number of bytes."""

    def __init__(self, codec_: Codec, shared: dict[bytes, Piece] | None = None, cache_bytes: int = CACHE_BYTES):
        self.codec = codec_
        self.shared = shared or {}
        self.lately: OrderedDict[bytes, Piece] = OrderedDict()
        self.held, self.cache_bytes = 0, cache_bytes

    def piece(self, chunk: bytes) -> Piece:
        """A chunk as the text before its first anchor, the ids up to its last one, and the
        rest; without anchors all is rest."""
        text = chunk.decode()
        places = _anchors(text)
        if places is None:
            return "", array("i"), text
        first, last = places
        return text[:first], array("i", self.codec.segment(text[first:last])), text[last:]

    def _lookup(self, chunk: bytes) -> Piece:
        found = self.shared.get(chunk)
        if found is not None:
            return found
        found = self.lately.get(chunk)
        if found is not None:
            self.lately.move_to_end(chunk)
            return found
        found = self.piece(chunk)
        self.lately[chunk] = found
        self.held += len(chunk)
        while self.held > self.cache_bytes:
            self.held -= len(self.lately.popitem(last=False)[0])
        return found

    def _ordinary(self, data: bytes) -> list[int]:
        ids: list[int] = []
        join = ""  # text around a chunk join, from the last anchor on: grows until both sides agree
        for chunk in chunks(data):
            head, inner, tail = self._lookup(chunk)
            if inner or head:
                ids += self.codec.segment(join + head)
                ids += inner
                join = tail
            else:
                join += tail
        return ids + self.codec.segment(join)

    def encode(self, text: bytes) -> list[int]:
        """The ids of a text; special tokens in it are taken as such."""
        return self._with_special(text, sorted(self.codec.special.items(), key=lambda s: -len(s[0])))

    def _with_special(self, text: bytes, special: list[tuple[str, int]]) -> list[int]:
        if not special:
            return self._ordinary(text)
        (content, number), *rest = special
        ids: list[int] = []
        for k, part in enumerate(text.split(content.encode())):
            if k:
                ids.append(number)
            ids += self._with_special(part, rest)
        return ids


# --- on tables ------------------------------------------------------------------------


def _count_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, list[int]] = {}

    def rows() -> pa.RecordBatch:
        keys = np.fromiter(counts, np.uint64, len(counts)).view(np.int64)
        n, size = zip(*counts.values()) if counts else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["chunk", "n", "size"]
        )

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            for chunk in chunks(text.as_py() or b""):
                counts.setdefault(xxhash.xxh3_64_intdigest(chunk), [0, len(chunk)])[0] += 1
        if len(counts) > 500_000:
            yield rows()
            counts.clear()
    yield rows()


def _texts_of(wanted: frozenset[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, texts = [], []
            for text in batch.column(0).cast(pa.binary()):
                for chunk in chunks(text.as_py() or b""):
                    key = xxhash.xxh3_64_intdigest(chunk)
                    if key in wanted and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        texts.append(chunk)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(texts, pa.binary())], names=["chunk", "text"]
            )

    return run


def _encode_shared(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(codec(path))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            ids = [encoder.piece(t)[1].tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(ids, pa.binary())], names=["text", "ids"])

    return run


def shared_chunks(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = SHARED) -> dict[bytes, Piece]:
    """The ``limit`` chunks whose repeats hold most text, each encoded once.

    All chunks of all texts are counted. Only the dictionary is bounded (``limit`` chunks of
    at most 16 KiB, a few MB in practice), and it decides speed alone: chunks outside of it
    are encoded where they occur.
    """
    path = path or tokenizer_path()
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = arrow_stage(texts, _count_chunks, "chunk long, n long, size long").groupBy("chunk").agg(
        F.sum("n").alias("n"), F.max("size").alias("size")
    )
    best = counts.filter("n > 1").orderBy(F.desc(F.expr("(n - 1) * size")), "chunk").limit(limit).select("chunk").collect()
    if not best:
        return {}
    wanted = frozenset(r.chunk % (1 << 64) for r in best)
    found = arrow_stage(texts, _texts_of(wanted), "chunk long, text binary").groupBy("chunk").agg(F.min("text").alias("text"))
    encoded = arrow_stage(found.select("text"), _encode_shared(path), "text binary, ids binary")
    dictionary: dict[bytes, Piece] = {}
    for row in encoded.toLocalIterator():
        chunk = bytes(row.text)
        text = chunk.decode()
        places = _anchors(text)
        if places:
            dictionary[chunk] = (text[: places[0]], array("i", bytes(row.ids)), text[places[1] :])
    return dictionary


def _encode(path: str, shared, kinds: str, what: frozenset[str]):
    target = arrow_schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        encoder = ChunkEncoder(coder, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: dict[str, list] = {name: [] for name in ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")}
                for text in part.column(part.num_columns - 1).cast(pa.binary()):
                    ids = encoder.encode(text.as_py() or b"")
                    columns["n_tokens"].append(len(ids))
                    if "ids" in what:
                        columns["ids"].append(ids)
                    if "decoded" in what or "digests" in what:
                        decoded = coder.decode(ids)
                        columns["decoded"].append(decoded.decode(errors="replace"))
                    if "digests" in what:
                        columns["ids_sha256"].append(
                            hashlib.sha256(",".join(map(coder.numbers.__getitem__, ids)).encode()).hexdigest()
                        )
                        columns["decoded_sha256"].append(hashlib.sha256(columns["decoded"][-1].encode()).hexdigest())
                made = [
                    pa.array(columns[f.name], f.type) for f in target if f.name in columns
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], schema=target)

    return run


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None,
    what: Iterable[str] = ("ids", "decoded"), limit: int = SHARED,
) -> DataFrame:
    """One row per document: the id, ``n_tokens`` and what is asked for.

    ``what`` may hold ``ids`` (array of int), ``decoded`` (the text that the ids decode to)
    and ``digests`` (SHA-256 of the comma-joined ids, and of the decoded text). A null text
    counts as empty: no ids. Null and repeated ids keep their rows. No text is shuffled.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(shared_chunks(docs, text_col, path, limit))
    wanted = frozenset(what)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long" + "".join(
        text for name, text in (
            ("ids", ", ids array<int>"), ("decoded", ", decoded string"),
            ("digests", ", ids_sha256 string, decoded_sha256 string"),
        ) if name in wanted
    )
    rows = docs.select(F.col(id_col), F.col(text_col))
    return arrow_stage(rows, _encode(path, shared, schema, wanted), schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and digest of what they decode to."""
    return encode_documents(table(spark, sf_dir, "documents"), what=("digests",))
