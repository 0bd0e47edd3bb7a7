"""Benchmark decontamination by a prefix-filtered set join of word shingles."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vectorloom.llm.common import arrow_stage, by_decision, table, text_key
from vectorloom.session import materialize

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
SHINGLE = 3
FILTER_BITS = 26  # the filter that goes to every task has 2**26 bits, whatever the benchmark's size
SHARE = 20  # a document is contaminated from one hit word in so many


def words_of(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words. Only a filter: matches are verified."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    crcs = np.fromiter(map(crc32, words), np.uint64, len(words))
    mixed = np.full(count, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ crcs[k : k + count]) * _A
        mixed ^= mixed >> np.uint64(31)
    mixed *= _B
    return mixed ^ (mixed >> np.uint64(29))


# --- a filter of fixed size -----------------------------------------------------------


def _filter_cells(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes in a table: a fixed number of 64-bit cells, merged by Spark."""
    place = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    cells = hashes.groupBy(F.shiftright(place, 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits")
    )
    found = cells.toArrow()
    held = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    held[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return held


def _passes(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (cells[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


# --- Arrow stages ---------------------------------------------------------------------


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [b" ".join(words_of(t.as_py() or b"")).decode() for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["item", "words"])


def _shape(n: int, window: int) -> tuple[int, int]:
    """Length of an item's windows and of its shingles, for an item of ``n`` words."""
    size = min(window, n)
    return size, min(SHINGLE, size)


def _item_shingles(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column(0):
                own = words.as_py().encode().split()
                hashes = shingle_hashes(own, _shape(len(own), window)[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([words.as_py()] * len(hashes), pa.string()),
                        pa.array(np.arange(len(hashes), dtype=np.int32)),
                        pa.array(hashes.view(np.int64)),
                        pa.array(np.full(len(hashes), _shape(len(own), window)[1], np.int32)),
                    ],
                    names=["words", "at", "h", "width"],
                )

    return run


def _segments(window: int):
    """Each window's rarest shingle is its necessary prefix. Neighbouring windows with the
    same one form a segment, so one row stands for all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("item_words", "h", "words", "at", "windows", "size")}
            for words, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words.split(" ")
                size, width = _shape(len(own), window)
                ranked = [(s["n"], s["h"], s["at"]) for s in sorted(shingles, key=lambda s: s["at"])]
                chosen = [min(ranked[s : s + size - width + 1]) for s in range(len(own) - size + 1)]
                start = 0
                while start < len(chosen):
                    end = start
                    while end + 1 < len(chosen) and chosen[end + 1][2] == chosen[start][2]:
                        end += 1
                    rows["item_words"].append(words)
                    rows["h"].append(chosen[start][1])
                    rows["words"].append(" ".join(own[start : end + size]))
                    rows["at"].append(chosen[start][2] - start)
                    rows["windows"].append(end - start + 1)
                    rows["size"].append(size)
                    start = end + 1
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    return run


def _rarity(cells, widths: tuple[int, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}

        def rows() -> pa.RecordBatch:
            keys = np.fromiter(counts.keys(), np.uint64, len(counts)).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["h", "n"]
            )

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                for width in widths:
                    hashes = shingle_hashes(words, width)
                    for h in hashes[_passes(hashes, cells.value)].tolist():
                        counts[h] = counts.get(h, 0) + 1
            if len(counts) > 500_000:
                yield rows()
                counts.clear()
        yield rows()

    return run


def _candidates(cells, widths: tuple[int, ...], window: int):
    """Per document a row with its number of words, and a row per shingle that passes the
    filter, with the words around it that its windows can reach."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                made: dict[str, list] = {k: [] for k in ("row", "id", "key", "n_words", "h", "at", "near", "offset")}
                for id_, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary())):
                    words = words_of(text.as_py() or b"")
                    found = [(None, None, None, None)]
                    for width in widths:
                        hashes = shingle_hashes(words, width)
                        for at in np.flatnonzero(_passes(hashes, cells.value)).tolist():
                            low = max(0, at - window + 1)
                            near = b" ".join(words[low : at + window]).decode()
                            found.append((int(hashes[at].view(np.int64)), at, near, at - low))
                    for h, at, near, offset in found:
                        for name, value in zip(made, (row, id_, key, len(words), h, at, near, offset)):
                            made[name].append(value)
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made.values(), kinds)], names=list(made))

    return run


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words around a candidate against its segment: which stretch of windows occurs."""
    for batch in batches:
        row, segment, start, end = [], [], [], []
        columns = [batch.column(n).to_pylist() for n in ("row", "at", "near", "offset", "segment", "words", "shingle_at", "windows", "size")]
        for row_, at, near, offset, segment_, words, place, windows, size in zip(*columns):
            own, other = near.split(" "), words.split(" ")
            back = 0
            while back < min(offset, place) and own[offset - back - 1] == other[place - back - 1]:
                back += 1
            ahead = 0
            while ahead < min(len(own) - offset, len(other) - place) and own[offset + ahead] == other[place + ahead]:
                ahead += 1
            first, last = max(0, place - back), min(windows - 1, place + ahead - size)
            if first <= last:
                row.append(row_)
                segment.append(segment_)
                start.append(at - place + first)
                end.append(at - place + last + size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int64()) for v in (row, segment, start, end)], names=["row", "segment", "start", "end"]
        )


# --- the join -------------------------------------------------------------------------


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``(id, key, n_words, n_hit, items, contaminated)`` per row of ``docs``.

    A window is ``window`` consecutive words of an item, or a whole shorter one. Containment
    of a window is all or nothing, so its rarest shingle over all documents is a sufficient
    prefix: only documents with that shingle are candidates, those are dropped that are too
    short or where it stands too near to an end, and the words around it are compared with
    the window. ``n_hit`` counts the words inside occurring windows, ``items`` lists the ids
    (as strings, sorted) of items with one.

    Null and empty texts have no words and no hits. Items without words have no windows; an
    item without an id can hit but is not listed; items of equal words are looked for once,
    and repeated rows count once. Repeated document rows and null ids each keep their row.
    An empty benchmark hits nothing. What goes to every task is a filter of fixed size.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    listed = arrow_stage(listed, _item_words, "item string, words string").filter("words <> ''")
    listed = materialize(listed.distinct(), "items")
    distinct = listed.select("words").distinct()
    shingles = materialize(
        arrow_stage(distinct, _item_shingles(window), "words string, at int, h long, width int"), "shingles"
    )
    widths = tuple(sorted(r.width for r in shingles.select("width").distinct().collect()))  # 1, 2, 3 at most
    broad = spark.sparkContext.broadcast(_filter_cells(shingles))
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")
    )
    rarity = arrow_stage(texts.select("text"), _rarity(broad, widths), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    ranked = shingles.join(rarity, "h", "left").groupBy("words").agg(
        F.collect_list(F.struct("at", "h", F.coalesce("n", F.lit(0)).alias("n"))).alias("shingles")
    )
    schema = "item_words string, h long, words string, at int, windows int, size int"
    segments = arrow_stage(ranked, _segments(window), schema).withColumn(
        "segment", F.xxhash64("words", "h", "at", "windows", "size")
    )
    segments = materialize(segments, "segments")
    narrow = spark.sparkContext.broadcast(_filter_cells(segments.select("h")))
    found = arrow_stage(
        texts, _candidates(narrow, widths, window),
        "row long, id long, key long, n_words long, h long, at long, near string, offset int",
    )
    found = materialize(found, "candidates")
    parts = segments.select("h", "segment", "words", F.col("at").alias("shingle_at"), "windows", "size").distinct()
    near = found.filter("h is not null").join(parts, "h").filter(
        "n_words >= size and at >= shingle_at - windows + 1 and n_words - at >= size - shingle_at"
    )
    near = near.select("row", "at", "near", "offset", "segment", "words", "shingle_at", "windows", "size")
    hits = materialize(arrow_stage(near, _verify, "row long, segment long, start long, end long").distinct(), "hits")

    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = hits.select("row", "start", "end").distinct().withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = covered.groupBy("row").agg(
        F.sum(F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))).alias("n_hit")
    )
    owners = segments.select("segment", F.col("item_words").alias("words")).distinct().join(listed, "words").select("segment", "item")
    named = hits.select("row", "segment").distinct().join(owners, "segment").groupBy("row").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )
    result = found.filter("h is null").join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return result.select(
        "id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they are."""
    rejected = contamination(docs, items, id_col, text_col).filter("contaminated").select("id", "key")
    return by_decision(docs, materialize(rejected, "rejected"), id_col, text_col, "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP2_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), win AS (
  SELECT DISTINCT item_id, l, w[s:s + l - 1] AS win FROM (
    SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s
    FROM item WHERE len(w) > 0)
), places AS (
  SELECT doc_id, l, s, w[s:s + l - 1] AS win FROM (
    SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM doc, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)
), hit AS (
  SELECT DISTINCT p.doc_id, p.s, p.l, v.item_id FROM places p JOIN win v ON p.win = v.win
), word AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(s, s + l)) AS k FROM hit) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(listed.n, 0)::BIGINT AS n_items,
       sha256(coalesce(listed.ids, '')) AS items_sha256,
       coalesce(word.n, 0) > 0 AND 20 * coalesce(word.n, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN listed ON d.doc_id = listed.doc_id
"""
