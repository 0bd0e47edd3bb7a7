"""Alignment of two tokenizers' ids on whole documents, by pointer jumping over their tokens."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectorloom.llm.bpe import _OTHER, Codec, tokenizer_path
from vectorloom.llm.common import arrow_schema, arrow_stage, table
from vectorloom.session import materialize

BATCH_BYTES = 1 << 20  # of texts that are aligned at a time; a longer text is one batch
UNITS = 300_000  # units of text whose ids a task remembers, some 80 MB
HOT = 1 << 18  # most frequent pairs, whose counts every task gets (4.5 MB at any size)
COUNTED = 2_000_000  # distinct pairs that a task counts before it passes them on
SPACE = "▁"
# A single space or line feed between two visible characters: neither tokenizer joins across it.
_CUTS = re.compile("(?<=[!-~À-ɏ])(?=[ \n][!-~À-ɏ])")
_SPACES = re.compile("(?<=[!-~À-ɏ])(?= [!-~À-ɏ])")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Tokens:
    """Ids of a batch of documents in order, with the document (from 0) of each."""

    n_docs: int
    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray


class Ragged:
    """Lists of ids that are taken by number."""

    def __init__(self):
        self.flat, self.ends = array("q"), array("q", [0])

    def add(self, lists: list[list[int]]) -> None:
        self.flat.extend(chain.from_iterable(lists))
        self.ends.extend((np.cumsum([len(x) for x in lists]) + self.ends[-1]).tolist())

    def cut(self, n: int) -> None:
        del self.ends[n + 1 :], self.flat[self.ends[n] :]

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after the other, and the length of each."""
        flat, ends = np.array(self.flat, np.int64), np.array(self.ends, np.int64)
        begins, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
        shift = begins - (np.cumsum(sizes) - sizes)
        return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


class Tokenizers:
    """Both tokenizers, asked for units of text. Units are remembered up to a number; those
    met when that is reached are encoded batch by batch."""

    def __init__(self, byte_path: str, piece_path_: str, remembered: int = UNITS):
        self.codec = Codec(byte_path)
        self.codec.library.encode_special_tokens = True  # their strings are ordinary text
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path_)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_pieces = [
            bytes([int(name[1:-1], 16)]) if self.pieces.is_byte(i) else name.replace(SPACE, " ").encode()
            for i, name in enumerate(names)
        ]
        self.size_a, self.size_b = len(self.codec.pieces), len(names)
        self.a_length = np.array([len(p) for p in self.codec.pieces])
        self.b_length = np.array([len(p) for p in self.b_pieces])
        numbers = [str(i) for i in range(max(self.size_a, self.size_b))]
        # Decimal ids followed by the mark between tokens, between A and B, and between groups.
        self.marked = [n + mark for mark in (",", "|", ";") for n in numbers]
        # Units are whole texts if a piece could join what a cut parts.
        inner = any(SPACE in name.lstrip(SPACE) for name in names)
        self.cuts = None if inner else _SPACES if any("\n" in name for name in names) else _CUTS
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.a, self.b = Ragged(), Ragged()
        self.same, self.apart = bytearray(), bytearray()

    def _learn(self, texts: list[str]) -> None:
        """Encode units. Each begins with the space that B adds, or with a line feed, which B
        has to keep apart from that space; a unit where it does not is marked."""
        with_space = [t[0] == " " for t in texts]
        found = self.pieces.encode([t[1:] if s else t for t, s in zip(texts, with_space)], num_threads=1)
        apart = [s or bool(b) and self.b_pieces[b[0]] == b" " for s, b in zip(with_space, found)]
        found_b = [b if s else b[1:] for s, b in zip(with_space, found)]
        found_a = self._segments(texts)
        data = [t.encode() for t in texts]
        same = b"\1" * len(texts)
        if not self._gives(found_a, found_b, b"".join(data)):
            same = bytes(self._gives([a], [b], d) for a, b, d in zip(found_a, found_b, data))
        self.number.update(zip(texts, range(len(self.same), len(self.same) + len(texts))))
        self.same += same
        self.apart += bytes(apart)
        self.a.add(found_a)
        self.b.add(found_b)

    def _segments(self, texts: list[str]) -> list[list[int]]:
        merged = self.codec.merged
        if merged is None or _OTHER.search("".join(texts)):
            return list(map(self.codec.segment, texts))
        return list(map(merged.encode_ordinary, texts))

    def _gives(self, a: Iterable[Iterable[int]], b: Iterable[Iterable[int]], data: bytes) -> bool:
        """Whether the ids of both give these bytes."""
        return b"".join(map(self.b_pieces.__getitem__, chain.from_iterable(b))) == data == self.codec.decode(chain.from_iterable(a))

    def _numbers(self, units: list[str]) -> np.ndarray:
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if new:
            self._learn(new)
        return np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))

    def encode(self, texts: list[str | None]) -> Tokens:
        """The tokens of each text after a space; none if it is null or empty or the bytes of its
        tokens are not its own."""
        whole = [" " + t if t else None for t in texts]
        split = self.cuts.split if self.cuts else lambda t: [t]
        parts = [split(t) if t else [] for t in whole]
        kept = len(self.same)
        numbers = self._numbers([u for p in parts for u in p])
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        apart, same = np.frombuffer(self.apart, np.uint8).copy(), np.frombuffer(self.same, np.uint8).copy()
        by_doc = [numbers[x:y] for x, y in zip(edges, edges[1:])]
        joined = self._docs_with(numbers, edges, apart)
        for k in joined:
            by_doc[k] = self._numbers([whole[k]])
        for k in {*joined, *self._docs_with(numbers, edges, same)}:
            if not self._gives([self.a.take(by_doc[k])[0]], [self.b.take(by_doc[k])[0]], whole[k].encode()):
                by_doc[k] = by_doc[k][:0]
        numbers = np.concatenate([np.empty(0, np.int64), *by_doc])
        doc = np.repeat(np.arange(len(texts)), [len(n) for n in by_doc])
        (a, in_a), (b, in_b) = self.a.take(numbers), self.b.take(numbers)
        tokens = Tokens(len(texts), a, b, np.repeat(doc, in_a), np.repeat(doc, in_b))
        if len(self.same) > self.remembered:
            if len(self.same) - kept > kept:
                self._forget()  # other texts than before: start anew
            else:
                for unit in [u for u in self.number if self.number[u] >= kept]:
                    del self.number[unit]
                del self.same[kept:], self.apart[kept:]
                self.a.cut(kept)
                self.b.cut(kept)
        return tokens

    @staticmethod
    def _docs_with(numbers: np.ndarray, edges: np.ndarray, flags: np.ndarray) -> list[int]:
        """Documents that hold a unit without the flag."""
        at = np.flatnonzero(flags[numbers] == 0) if len(numbers) else numbers
        return np.unique(np.searchsorted(edges, at, "right") - 1).tolist()


@lru_cache(maxsize=2)
def tokenizers(byte_path: str, piece_path_: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path_)


# --- alignment ------------------------------------------------------------------------


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every place where a token ends: the token of A and of B over its last byte, and whether
    they end there. ``ends_*`` are ascending byte ends over the same bytes."""
    size = int(ends_a[-1]) + 1 if len(ends_a) else 0
    stops_a, stops_b = np.zeros(size, bool), np.zeros(size, bool)
    stops_a[ends_a] = stops_b[ends_b] = True
    places = np.flatnonzero(stops_a | stops_b)
    is_a, is_b = stops_a[places], stops_b[places]
    return np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, is_a, is_b


def terminals(of_a: np.ndarray, of_b: np.ndarray, is_a: np.ndarray, is_b: np.ndarray) -> np.ndarray:
    """For every token of A, then of B, the last token of A in its group (see :func:`overlaps`).

    A token points to the token that reaches farthest right of those that overlap it; where both
    end together, to the one of A. Each round lets all pointers skip over their targets, so a
    chain of n tokens takes log2(n) rounds.
    """
    n = int(is_a.sum())
    own = np.arange(n)
    ahead = np.concatenate([np.where(is_b[is_a], own, n + of_b[is_a]), of_a[is_b]])
    while True:
        farther = ahead[ahead]
        if np.array_equal(farther, ahead):
            return ahead
        ahead = farther


@dataclass(frozen=True)
class Aligned:
    """What a batch of documents holds, tokens and links in order of the text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray  # id of A * size of B + id of B, distinct within a document
    times: np.ndarray  # links of each pair in its document
    pair_ends: np.ndarray  # where the pairs of each document end


def align(tokens: Tokens, both: Tokenizers) -> Aligned:
    n_docs, a, b, doc_a, doc_b = tokens.n_docs, tokens.a, tokens.b, tokens.doc_a, tokens.doc_b
    n_a, n_b = np.bincount(doc_a, minlength=n_docs), np.bincount(doc_b, minlength=n_docs)
    ends_a, ends_b = np.cumsum(both.a_length[a]), np.cumsum(both.b_length[b])

    of_a, of_b, is_a, is_b = overlaps(ends_a, ends_b)
    last = terminals(of_a, of_b, is_a, is_b)
    closes = last[: len(a)] == np.arange(len(a))  # every group ends with a token of A
    group = (np.cumsum(closes) - 1)[last]
    group_a, group_b = group[: len(a)], group[len(a) :]
    n_groups = np.bincount(doc_a[closes], minlength=n_docs)

    # Groups in order, in each the tokens of A and then those of B.
    count = int(closes.sum())
    in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
    before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
    at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b]
    size = len(both.marked) // 3
    codes = np.empty(len(a) + len(b), np.int64)
    more_a, more_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    more_a[:-1], more_b[:-1] = group_a[1:] == group_a[:-1], group_b[1:] == group_b[:-1]
    codes[at_a] = a + np.where(more_a, 0, size)
    codes[at_b] = b + np.where(more_b, 0, 2 * size)
    texts = list(map(both.marked.__getitem__, codes.tolist()))
    edges = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    groups = ["".join(texts[x:y])[:-1] for x, y in zip(edges, edges[1:])]

    # A link begins at every end of a token: its last byte lies in one token of either.
    doc = doc_a[of_a]
    span = both.size_a * both.size_b
    found, times = np.unique(doc * span + a[of_a] * both.size_b + b[of_b], return_counts=True)
    return Aligned(
        n_a, n_b, n_groups, np.bincount(doc, minlength=n_docs), groups, found % span, times,
        np.searchsorted(found, (np.arange(n_docs) + 1) * span),
    )


# --- on tables ------------------------------------------------------------------------

_COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def _align_rows(paths: tuple[str, str], kinds: str):
    target = arrow_schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)

        def made(part: pa.RecordBatch, docs: list[str | None]) -> pa.RecordBatch:
            found = align(both.encode(docs), both)
            edges = [0, *found.pair_ends.tolist()]
            packed = [
                pa.array([np.ascontiguousarray(x[i:j], kind).tobytes() for i, j in zip(edges, edges[1:])], pa.binary())
                for x, kind in ((found.pairs, "<i8"), (found.times, "<i4"))
            ]
            columns = [
                pa.array(found.n_a), pa.array(found.n_b), pa.array(found.n_groups), pa.array(found.n_links),
                pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups]),
                pa.array(found.groups, pa.string()),
            ]
            fields = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"), columns))
            fields |= {"pairs": packed[0], "times": packed[1]}
            rest = [fields[f.name] for f in list(target)[part.num_columns - 1 :]]
            return pa.RecordBatch.from_arrays([*part.columns[:-1], *rest], schema=target)

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            begin = held = 0
            docs: list[str | None] = []
            for k, text in enumerate(texts):
                text = text.as_py()
                docs.append(text)
                held += len(text or "")
                if held >= BATCH_BYTES or k + 1 == len(texts):
                    yield made(batch.slice(begin, k + 1 - begin), docs)
                    begin, held, docs = k + 1, 0, []

    return run


def _count_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            packed = b"".join(batch.column(0).slice(at, 512).to_pylist())
            pairs, n = np.unique(np.frombuffer(packed, "<i8"), return_counts=True)
            held.append((pairs.astype(np.int64), n.astype(np.int64)))
            if len(held) >= 16:
                held = [merged()]
                if len(held[0][0]) >= COUNTED:
                    yield rows(*held.pop())
    if held:
        yield rows(*merged())


def _resolve(hot, columns: int, kinds: str):
    target = arrow_schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = hot.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                packed, packed_times = part.column(columns).to_pylist(), part.column(columns + 1).to_pylist()
                pairs = np.frombuffer(b"".join(packed), "<i8")
                times = np.frombuffer(b"".join(packed_times), "<i4").astype(np.int64)
                sizes = [len(p) // 8 for p in packed]
                doc = np.repeat(np.arange(part.num_rows), sizes)
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                is_hot = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                times_hot, doc_hot, at = times[is_hot], doc[is_hot], at[is_hot]
                total, top = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                np.add.at(total, doc_hot, times_hot * counts[at])
                np.add.at(top, doc_hot, times_hot * best[at])
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~is_hot], minlength=part.num_rows))])
                rest = pa.StructArray.from_arrays([pa.array(pairs[~is_hot]), pa.array(times[~is_hot])], names=["pair", "times"])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:columns], pa.array(top), pa.array(total), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest).cast(target.field("rest").type)],
                    schema=target,
                )

    return run


def align_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, byte_path: str | None = None,
    piece_model: str | None = None, with_groups: bool = False, hot: int = HOT,
) -> DataFrame:
    """One row per document: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256`` (and ``groups``, the groups themselves, if asked for).

    Tokens of A (byte-level BPE of the text after a space) and B (pieces, which add that space)
    are linked if they share bytes; groups are cut where both end. A pair's count is the number
    of documents that hold it linked; ``count_sum`` adds the counts of all links, ``n_best``
    counts the links whose pair is as frequent as any of its id of A. A text that is null,
    empty, or not given back by both tokenizers has no tokens: zeros, and no groups (''). Every
    row counts as a document, with null and repeated ids too, and gives one row; other columns
    are not read.

    Documents are encoded and aligned once and kept as packed distinct pairs. Counting combines
    within tasks. The counts of the ``hot`` most frequent pairs go to every task, so pairs of
    nearly all documents are never shuffled; the others are joined by pair.
    """
    spark = docs.sparkSession
    paths = (byte_path or tokenizer_path(), piece_model or piece_path())
    sizes = tokenizers(*paths).size_b
    kind = docs.schema[id_col].dataType.simpleString()
    shown = f"row long, id {kind}, {_COUNTS}, groups_sha256 string" + (", groups string" if with_groups else "")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"{shown}, pairs binary, times binary"
    aligned = materialize(arrow_stage(numbered, _align_rows(paths, schema), schema), "aligned")

    counts = arrow_stage(aligned.select("pairs"), _count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("a", F.floor(F.col("pair") / sizes)), "counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = materialize(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")), "pairs")
    frequent = counts.orderBy(F.desc("n"), "pair").limit(hot).toArrow().sort_by("pair")
    known = tuple(frequent[c].to_numpy().astype(k) for c, k in (("pair", np.int64), ("n", np.int64), ("best", np.int8)))
    columns = len(arrow_schema(shown))
    resolved_schema = f"{shown}, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"
    resolved = arrow_stage(aligned, _resolve(spark.sparkContext.broadcast(known), columns, resolved_schema), resolved_schema)
    resolved = materialize(resolved, "resolved")
    rare = (
        resolved.select("row", F.inline("rest")).join(counts, "pair")
        .groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    )
    return resolved.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256", *(["groups"] if with_groups else []),
    )


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the ids of the two tokenizers for every document."""
    return align_documents(table(spark, sf_dir, "documents"))
