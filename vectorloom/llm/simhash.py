"""SimHash near-duplicates, joined by a generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectorloom.llm.common import arrow_schema, arrow_stage, by_decision, table, text_key
from vectorloom.llm.components import connected_components
from vectorloom.session import materialize

BITS = 64
SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
BLOCK = 4096  # rows of one bucket that are compared in one piece
_VOTES = 1 << 16  # shingles whose bits are unpacked at once


# --- fingerprints ---------------------------------------------------------------------


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The majority of the bits of all word shingles; zero if there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    flat = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > width:
        starts, ends = starts[: 1 - width or None], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _VOTES):
        part = [digest(flat[a:b], SEED) for a, b in zip(starts[at : at + _VOTES].tolist(), ends[at : at + _VOTES].tolist())]
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(schema: str, width: int):
    target = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            marks = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, batch.num_rows)
            columns = [*batch.columns[:-1], pa.array(marks.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return run


def simhash(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """``(id, key, mark)`` per row: its id, the key of its text and its 64-bit fingerprint."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")
    )
    schema = "id long, key long, mark long"
    return arrow_stage(rows, _fingerprints(schema, width), schema)


# --- the plan: partitions of correlated bits and their thresholds ---------------------


@dataclass(frozen=True)
class Part:
    """Some bit positions, and how many of them may differ; below zero: not probed."""

    bits: tuple[int, ...]
    limit: int


def _bit_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        marks = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
        for at in range(0, len(marks), _VOTES):
            octets = marks[at : at + _VOTES].view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(cells), pa.array(total.ravel()[cells].astype(np.int64))], names=["cell", "n"]
    )


def bit_statistics(marks: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j set, over all of them."""
    cells = arrow_stage(marks.select("mark"), _bit_counts, "cell long, n long")
    joint = np.zeros(BITS * BITS)
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4096 rows at most
        joint[row.cell] = row.n
    return marks.count(), joint.reshape(BITS, BITS)


def _grouped_bits(correlation: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Near-equal partitions, each grown from a seed by the bit most correlated with it."""
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        strength = {b: sum(correlation[b, o] for o in left) for b in left}
        group = [max(sorted(left), key=strength.__getitem__)]
        left -= {group[0]}
        while len(group) < size:
            best = max(sorted(left), key=lambda b: sum(correlation[b, o] for o in group))
            group.append(best)
            left.discard(best)
        groups.append(tuple(sorted(group)))
    return groups


def _within(differ: np.ndarray) -> np.ndarray:
    """Chance of at most t differing bits, for t from 0, from each bit's chance to differ."""
    chance = np.zeros(len(differ) + 1)
    chance[0] = 1.0
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return np.cumsum(chance)


def plan_parts(n: int, joint: np.ndarray, distance: int = MAX_DISTANCE, probe_cost: float = 60.0) -> list[Part]:
    """Choose partitions and thresholds with ``sum(limit + 1) == distance + 1``.

    Two fingerprints within ``distance`` bits then differ in at most ``limit`` bits of some
    partition: otherwise they would differ in ``sum(limit + 1) > distance`` bits. For each
    number of partitions a dynamic program spends the ``distance + 1`` units where the
    estimated candidate pairs (from the bit frequencies of all fingerprints) and the probes
    cost least. Any outcome finds the same links; only the work differs.
    """
    count = max(n, 2)
    mean = np.diag(joint) / count
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    correlation = np.abs((joint / count - np.outer(mean, mean)) / np.outer(spread, spread))
    differ = 2 * mean * (1 - mean)
    best: tuple[float, list[Part]] | None = None
    for parts in range(2, distance + 2):
        groups = _grouped_bits(correlation, parts)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            chance = _within(differ[list(group)])
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, limits) in states.items():
                for units in range(0, distance + 2 - spent):
                    if units > 3:  # more than two flipped bits are too many probes
                        break
                    own = 0.0
                    if units:
                        probes = sum(math.comb(len(group), r) / (1 if r == 0 else 2) for r in range(units))
                        own = count * probes * probe_cost + count * (count - 1) / 2 * chance[units - 1]
                    if spent + units not in step or cost + own < step[spent + units][0]:
                        step[spent + units] = (cost + own, [*limits, units - 1])
            states = step
        if distance + 1 in states and (best is None or states[distance + 1][0] < best[0]):
            cost, limits = states[distance + 1]
            best = (cost, [Part(g, t) for g, t in zip(groups, limits)])
    assert best is not None and sum(p.limit + 1 for p in best[1]) == distance + 1
    return best[1]


# --- probing and verifying ------------------------------------------------------------


def _probe(parts: list[Part]):
    """Fingerprints to bucket rows: one for the own value in each probed partition, and one
    for each value that differs in up to ``limit`` bits. Of two values that differ in such
    bits, just the one with the highest of them set is probed, so each pair meets once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(every), 4096):
                marks = every[at : at + 4096]
                raw = marks.view(np.uint64)
                for number, part in enumerate(parts):
                    if part.limit < 0:
                        continue
                    value = np.zeros(len(raw), np.uint64)
                    for place, bit in enumerate(part.bits):
                        value |= ((raw >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
                    pieces = [(value, marks, True)]
                    for flips in range(1, part.limit + 1):
                        for places in combinations(range(len(part.bits)), flips):
                            set_ = (value >> np.uint64(places[-1])) & np.uint64(1) == 1
                            mask = np.uint64(sum(1 << p for p in places))
                            pieces.append((value[set_] ^ mask, marks[set_], False))
                    for bucket, mark, own in pieces:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(mark), number, np.int32)),
                                pa.array(bucket.view(np.int64)),
                                pa.array(mark),
                                pa.array(np.full(len(mark), own)),
                            ],
                            names=["part", "bucket", "mark", "own"],
                        )

    return run


def _forest(cell: np.ndarray, mark: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal ``cell``: row numbers of its edges.

    All pairs with at least one own value are compared, but no more edges leave than rows
    come in.
    """
    n = len(cell)
    root = np.arange(n)
    left: list[int] = []
    right: list[int] = []
    at = np.arange(n)
    for step in range(1, n):
        at = at[at + step < n]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        other = at + step
        near = np.bitwise_count(mark[at] ^ mark[other]) <= distance
        near &= (own[at] | own[other]) & (root[at] != root[other])
        if not near.any():
            continue
        for a, b in zip(at[near].tolist(), other[near].tolist()):
            ra, rb = a, b
            while root[ra] != ra:
                ra = root[ra]
            while root[rb] != rb:
                rb = root[rb]
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                left.append(a)
                right.append(b)
        while True:
            higher = root[root]
            if np.array_equal(higher, root):
                break
            root = higher
    return np.array(left, np.int64), np.array(right, np.int64)


def _verify(distance: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            key = rows[["part", "bucket", "low", "high"]]
            cell = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            a, b = _forest(cell, rows["mark"].view(np.uint64), rows["own"], distance)
            marks = rows["mark"]
            return pa.RecordBatch.from_arrays([pa.array(marks[a]), pa.array(marks[b])], names=["u", "v"])

        kinds = [("part", "i4"), ("bucket", "i8"), ("low", "i4"), ("high", "i4"), ("mark", "i8"), ("own", "?")]
        for batch in batches:
            rows = np.empty(batch.num_rows, kinds)
            for name, _ in kinds:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            held.append(rows)
            rows = np.concatenate(held) if len(held) > 1 else rows
            key = rows[["part", "bucket", "low", "high"]]
            if not len(rows):
                held = []
                continue
            change = np.flatnonzero(key[1:] != key[:-1])
            cut = change[-1] + 1 if len(change) else 0
            held = [rows[cut:].copy()]
            if cut:
                yield edges(rows[:cut])
        rest = np.concatenate(held) if held else np.empty(0, kinds)
        if len(rest):
            yield edges(rest)

    return run


def links(marks: DataFrame, distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """Distinct ``mark`` values to edges ``(u, v)`` that span every component of values within
    ``distance`` bits of each other. A bucket with more than ``block`` rows is cut into
    blocks, and each pair of blocks is compared in a cell of its own, in different tasks."""
    parts = plan_parts(*bit_statistics(marks), distance)
    rows = materialize(
        arrow_stage(marks.select("mark"), _probe(parts), "part int, bucket long, mark long, own boolean"), "buckets"
    )
    sizes = rows.groupBy("part", "bucket").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("owned"))
    useful = sizes.filter("n > 1 and owned > 0").select(
        "part", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")
    )
    dealt = (
        rows.join(useful, ["part", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "part", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "mark", "own"
        )
    )
    cells = ["part", "bucket", "low", "high"]
    return arrow_stage(
        dealt.repartition(*cells).sortWithinPartitions(*cells), _verify(distance), "u long, v long"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, mark, component)`` per row of ``docs``.

    Two documents are linked if their fingerprints differ in at most four bits; the component
    is the smallest id that can be reached over links. Texts without words (null, empty,
    blank) have fingerprint zero, linked like any other. Rows with a null id get the
    component of their fingerprint, null if no row of it has an id; repeated rows stay.
    Equal fingerprints count as one value, so groups of copies are never compared.
    """
    rows = materialize(simhash(docs, id_col, text_col), "fingerprints")
    values = materialize(rows.groupBy("mark").agg(F.min("id").alias("least")), "values")
    roots = connected_components(links(values))
    placed = values.join(roots, values["mark"] == roots["node"], "left").select(
        "mark", "least", F.coalesce("root", "mark").alias("root")
    )
    placed = materialize(placed, "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(least, "root").select("mark", "component")
    return rows.join(named, "mark").select("id", "key", "mark", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id, and of repeated ids the one
    with the smallest text key. Columns stay as they are; rows that are wholly alike count
    once."""
    found = materialize(near_duplicates(docs, id_col, text_col), "near")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    group = [F.coalesce("component", "mark").alias("g"), F.col("component").isNull().alias("n")]
    groups = found.groupBy(*group).agg(F.min(first).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    rows = found.select("id", "key", *group).join(materialize(groups, "groups"), ["g", "n"])
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    rows = materialize(rows.groupBy("id", "key").agg(F.max(is_first).alias("is_first"), F.count("*").alias("times")), "copies")
    # rows outside of these are alone in their group; only rows of one id and text can be alike
    repeated = rows.filter("is_first and times > 1")
    others = by_decision(docs, rows.filter("not is_first or times > 1"), id_col, text_col, "left_anti")
    return others.unionByName(by_decision(docs, repeated, id_col, text_col, "left_semi").dropDuplicates())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
