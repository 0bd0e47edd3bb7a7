"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectorloom.llm.common import arrow_schema, arrow_stage, fresh_name, table

TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
HASH_BITS = 22
STEM = 4
SAMPLE = 12_000  # labelled rows that the model is fitted on, at most
BLOCK = 512  # rows that are looked at together where all are
FOLDS = 5  # rows whose crc32(id) is a multiple of it are held out


@dataclass(frozen=True)
class Fit:
    """How the machine is fitted: proximal AdaGrad, and the best epoch by rows set aside.

    The linear weights have an L1 penalty and are learned alone for ``linear_epochs``, so that
    the factors start on what single terms leave unexplained. Only terms that tell something
    have factors, since words of nearly every text would drown what pairs tell, the more the
    longer the text: terms whose rows differ from the share of label 1 by ``telling`` standard
    deviations, and of the ``paired`` most frequent terms those whose rows in common differ by
    ``telling_pairs`` and more than either alone from what the linear weights expect.

    Products of plain factors can hardly say that terms of two groups tell together and terms of
    one group do not, as the terms of a group need like factors for it. With ``opposed`` ones,
    whose products are taken off, a few factors can.
    """

    rank: int = 8
    opposed: int = 0  # of these factors, whose products count against label 1
    epochs: int = 24
    linear_epochs: int = 6
    batch: int = 128
    rate: float = 0.3
    l1: float = 4e-4
    rate_factors: float = 0.1
    l1_factors: float = 0.0
    l2_factors: float = 1e-4
    telling: float = 3.5
    telling_pairs: float = 6.0
    paired: int = 2048
    least_rows: int = 8  # terms seen in fewer rows have no weight
    validation: float = 0.2  # share of the rows that choose the epoch
    seed: int = 7


PRODUCTION = Fit(opposed=4, rate_factors=0.25)


@dataclass(frozen=True)
class Machine:
    """``slots`` (sorted hashes) with a linear weight and a factor row each, the bias, and the
    share of label 1, which texts without a known term get."""

    bias: float
    slots: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    base: float = 0.5
    opposed: int = 0

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        """Chance of label 1 for each list of distinct hashed terms."""
        rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        hashes = np.concatenate(terms) if terms else np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.slots, hashes), max(len(self.slots) - 1, 0))
        known = self.slots[at] == hashes if len(self.slots) else np.zeros(len(hashes), bool)
        rows, at = rows[known], at[known]
        chance = _chance(_margins(rows, at, len(terms), self.bias, self.weights, self.factors, self.opposed)[0])
        return np.where(np.bincount(rows, minlength=len(terms)) > 0, chance, self.base)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def _signs(rank: int, opposed: int) -> np.ndarray:
    return np.where(np.arange(rank) < rank - opposed, 1.0, -1.0)


def _margins(rows, at, n, bias, weights, factors, opposed=0):
    """``bias + sum w_i + sum_{i<j} <v_i, v_j>`` per row, and the factor sums per row; the last
    ``opposed`` factors count negative."""
    linear = bias + np.bincount(rows, weights[at], n)
    telling = np.flatnonzero(factors.any(axis=1)[at])
    rows, own = rows[telling], factors[at[telling]]
    sums = np.stack([np.bincount(rows, v, n) for v in own.T], axis=1) if own.shape[1] else np.zeros((n, 0))
    signs = _signs(own.shape[1], opposed)
    squares = np.bincount(rows, np.square(own) @ signs, n)
    return linear + 0.5 * (np.square(sums) @ signs - squares), sums


def hashed_terms(text: bytes) -> np.ndarray:
    """The distinct words of a text and their first bytes (which inflected words share),
    hashed; letters A-Z count in either case."""
    words = set(TERMS.findall(text.lower()))
    distinct = {crc32(w) for w in words} | {crc32(w, STEM) for w in {w[:STEM] for w in words}}
    return np.unique(np.fromiter(distinct, np.int64, len(distinct)) & ((1 << HASH_BITS) - 1))


def fit_machine(terms: list[np.ndarray], labels: np.ndarray, fit: Fit = Fit()) -> Machine:
    """Fit on rows of distinct hashed terms. Without rows of both labels every score is the
    share of label 1 (a half if there is no row).

    A part of the rows is not learned from: the weights after the epoch that explains it best
    are kept, factors still at nothing among them, so pairs never make the machine worse there
    than its linear part.
    """
    n = len(terms)
    base = (float(labels.sum()) + 0.5) / (n + 1) if n else 0.5
    bias = float(np.log(base / (1 - base)))
    slots, seen = np.unique(np.concatenate(terms) if n else np.empty(0, np.int32), return_counts=True)
    slots = slots[seen >= fit.least_rows]
    weights, factors = np.zeros(len(slots)), np.zeros((len(slots), fit.rank))
    if not len(slots) or labels.min() == labels.max():
        return Machine(bias, slots[:0], weights[:0], factors[:0], base)
    places = []
    for t in terms:
        at = np.minimum(np.searchsorted(slots, t), len(slots) - 1)
        places.append(at[slots[at] == t].astype(np.int32))
    random = np.random.default_rng(fit.seed)
    order = random.permutation(n)
    aside, learned = np.split(order, [int(n * fit.validation)])
    if not len(aside):
        aside = learned
    inside = [places[i] for i in learned]
    gained_w, gained_v, gained_b = np.full(len(slots), 1e-4), np.full(factors.shape, 1e-2), 1e-4
    has, signs = np.zeros(len(slots), bool), _signs(fit.rank, fit.opposed)
    best, least = None, np.inf
    held = [places[i] for i in aside]
    for epoch in range(fit.epochs):
        if epoch == fit.linear_epochs:
            if best is not None:  # pairs start from the best linear weights
                bias, weights = best[0], best[1].copy()
            expected = _chance(_margins_of(inside, bias, weights, factors, fit.opposed))
            telling = _telling(inside, labels[learned], expected, len(slots), fit)
            factors[telling], has[telling] = random.normal(0, 0.1, (len(telling), fit.rank)), True
        for chosen in np.array_split(random.permutation(learned), max(1, len(learned) // fit.batch)):
            own = [places[i] for i in chosen]
            rows = np.repeat(np.arange(len(own)), [len(p) for p in own])
            at, near = np.unique(np.concatenate(own), return_inverse=True)
            margin, sums = _margins(rows, near, len(own), bias, weights[at], factors[at], fit.opposed)
            error = (_chance(margin) - labels[chosen]) / len(own)
            slope_w = np.bincount(near, error[rows], len(at))
            gained_w[at] += slope_w**2
            step_w = fit.rate / np.sqrt(gained_w[at])
            weights[at] = _shrunk(weights[at] - step_w * slope_w, step_w * fit.l1)
            paired = has[at[near]]
            if paired.any():
                rows, (there, near) = rows[paired], np.unique(at[near[paired]], return_inverse=True)
                v = factors[there]
                pull = error[rows, None] * signs * (sums[rows] - v[near])
                slope_v = np.stack([np.bincount(near, p, len(there)) for p in pull.T], axis=1)
                gained_v[there] += slope_v**2
                step_v = fit.rate_factors / np.sqrt(gained_v[there])
                factors[there] = _shrunk(v - step_v * slope_v, step_v * fit.l1_factors) / (1 + step_v * fit.l2_factors)
            gained_b += error.sum() ** 2
            bias -= fit.rate / np.sqrt(gained_b) * error.sum()
        margin = _margins_of(held, bias, weights, factors, fit.opposed)
        loss = float(np.logaddexp(0, np.where(labels[aside] > 0, -margin, margin)).mean())
        if loss < least:
            best, least = (bias, weights.copy(), factors.copy()), loss
    bias, weights, factors = best
    used = (weights != 0) | (factors != 0).any(axis=1)
    return Machine(bias, slots[used], weights[used], factors[used], base, fit.opposed)


def _blocks(places: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some rows at a time: the first one's number, and row and place of every term."""
    for start in range(0, len(places), BLOCK):
        own = places[start : start + BLOCK]
        yield start, np.repeat(np.arange(len(own)), [len(p) for p in own]), np.concatenate(own)


def _margins_of(places: list[np.ndarray], *machine) -> np.ndarray:
    found = [_margins(rows, at, min(BLOCK, len(places) - start), *machine)[0] for start, rows, at in _blocks(places)]
    return np.concatenate([np.empty(0), *found])


def _telling(places: list[np.ndarray], labels: np.ndarray, expected: np.ndarray, size: int, fit: Fit) -> np.ndarray:
    """The slots that hold label 1 clearly more or less often than all rows do, alone, or than
    is expected of a row, in pairs."""
    share = labels.mean()
    rows, ones = np.zeros(size), np.zeros(size)
    for start, row, at in _blocks(places):
        rows += np.bincount(at, minlength=size)
        ones += np.bincount(at, labels[start + row], size)
    spread = np.sqrt(np.maximum(rows * share * (1 - share), 1e-9))
    alone = np.flatnonzero((rows >= fit.least_rows) & (np.abs(ones - rows * share) >= fit.telling * spread))

    frequent = np.sort(np.argsort(-rows, kind="stable")[: fit.paired])
    number = np.full(size, -1)
    number[frequent] = np.arange(len(frequent))
    more, spread = np.zeros((len(frequent),) * 2, np.float32), np.zeros((len(frequent),) * 2, np.float32)
    for start, row, at in _blocks(places):
        known = number[at] >= 0
        chance = expected[start : start + BLOCK].astype(np.float32)
        left = labels[start : start + BLOCK].astype(np.float32) - chance
        holds = np.zeros((len(chance), len(frequent)), np.float32)
        holds[row[known], number[at[known]]] = 1
        more += holds.T @ (holds * left[:, None])
        spread += holds.T @ (holds * (chance * (1 - chance))[:, None])
    score = np.abs(more) / np.sqrt(np.maximum(spread, 1.0))
    single = np.diag(score)
    tells = score >= fit.telling_pairs + 1.5 * np.maximum(single[:, None], single[None])
    return np.union1d(alone, frequent[tells.any(axis=1)])


def _shrunk(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(values) * np.maximum(np.abs(values) - by, 0)


# --- on tables ------------------------------------------------------------------------


def held_out(id_: Column) -> Column:
    """Rows that are never learned from; a null id is one of them."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _pack_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [hashed_terms(t.as_py() or b"").astype("<i4").tobytes() for t in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(terms, pa.binary())], names=["id", "label", "terms"]
        )


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, fit: Fit = PRODUCTION,
) -> Machine:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of their id.

    Labels of one id count once (the largest); null labels and null ids, held-out rows, and
    labels without a document are left out. Of repeated ids one document is used. Hashed
    terms of at most ``sample`` rows come to the driver, some MB.
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")
    packed = arrow_stage(rows, _pack_terms, "id long, label int, terms binary")
    once = packed.groupBy("id").agg(F.min(F.struct("terms", "label")).alias("r")).orderBy("id").select("r.*").toArrow()
    terms = [np.frombuffer(t.as_buffer(), "<i4") for t in once["terms"]]
    machine = fit_machine(terms, (once["label"].to_numpy() > 0).astype(float), fit)
    del terms, once
    pa.default_memory_pool().release_unused()
    return machine


def _score(machine: Machine, kinds: str):
    target = arrow_schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.num_columns - 1).cast(pa.binary())
                scores = machine.scores([hashed_terms(t.as_py() or b"") for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], schema=target)

    return run


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: every row, its whole text; a null or empty text, or one of
    unknown words, gets the base rate. All columns are kept; a column named like
    ``score_col`` is replaced. No shuffle."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != score_col.lower()])
    text = fresh_name(kept, "_scored_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{score_col}` double"
    return arrow_stage(kept.withColumn(text, F.col(text_col)), _score(machine, schema), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, machine).select("doc_id", "score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the machine does not call toxic (score below a half)."""
    machine = learn(docs, table(spark, sf_dir, "labels"))
    name = fresh_name(docs, "_toxicity")
    return score(docs, machine, score_col=name).filter(F.col(name) < 0.5).drop(name)
