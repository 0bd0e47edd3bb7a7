"""Language identification by error-correcting output codes over hashed n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectorloom.llm.common import arrow_schema, arrow_stage, fresh_name, table

ORDERS = (2, 3, 4)  # bytes of an n-gram
BUCKET_BITS = 16
FOLDS, HELD_OUT = 4, 2  # rows whose crc32(id) leaves this remainder are held out
CALIBRATION = 1000  # rows of a language, about, that weights of the code's bits are measured on
EXHAUSTIVE = 5  # up to so many languages, the code has every way to divide them in two
STEEPNESS = 4.0  # of the loss; a typical document of a class has a margin of 1
AMBIGUOUS = 0.6  # below this score a prediction is flagged
UNKNOWN = "und"
_SLICE = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)  # A-Z in lower case, other ASCII but letters as a space


def hashed_ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of whole texts, slice by slice, with the number of each one's text.
    Before each text stand so many spaces that no n-gram reaches from one into the next."""
    before = b" " * (max(ORDERS) - 1)
    raw = np.frombuffer(b"".join(before + t.translate(_LETTERS) + b" " for t in texts) + before, np.uint8)
    ends = np.cumsum([len(t) + max(ORDERS) for t in texts])
    for start in range(0, len(raw) - len(before), _SLICE):
        part = raw[start : start + _SLICE + len(before)].astype(np.uint32)
        size = min(_SLICE, len(raw) - len(before) - start)
        code = part
        rows = np.searchsorted(ends, np.arange(start, start + size), "right")
        for order in range(2, max(ORDERS) + 1):
            code = (code[:-1] << np.uint32(8)) | part[order - 1 :]
            if order in ORDERS:
                mixed = (code * np.uint32(2654435761 + 2 * order)) >> np.uint32(32 - BUCKET_BITS)
                yield mixed[:size], rows


# --- the code -------------------------------------------------------------------------


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A codeword of +1 and -1 for each of ``n`` languages (a row each).

    Few languages get the exhaustive code, whose codewords differ in half of the bits; more get
    the one of 200 random codes of 10 log2(n) bits whose closest codewords are farthest apart.
    """
    if n <= 1:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([np.ones(len(bits)), *(np.where(bits >> k & 1, -1.0, 1.0) for k in range(n - 1))])
    random = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1.0
    for _ in range(200):
        code = random.choice([-1.0, 1.0], (n, width))
        split = np.abs(code.sum(axis=0)) < n  # a bit that is the same for all tells nothing
        distance = (split.sum() - code[:, split] @ code[:, split].T) / 2
        least = distance[~np.eye(n, dtype=bool)].min()
        if least > apart:
            best, apart = code[:, split], least
    return best


@dataclass(frozen=True)
class LanguageModel:
    """Binary classifiers (a column of ``weights`` each) and the codewords that they spell."""

    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    middle: np.ndarray
    spread: np.ndarray
    trust: np.ndarray  # languages x bits: weight of a bit's loss, 1 on average for a language

    def outputs(self, texts: list[bytes]) -> np.ndarray:
        """The mean weight of each text's n-grams under every classifier."""
        sums, counts = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for buckets, rows in hashed_ngrams(texts):
            begins = np.flatnonzero(np.diff(rows, prepend=-1))
            sums[rows[begins]] += np.add.reduceat(self.weights[buckets], begins, axis=0, dtype=np.float64)
            counts[rows[begins]] += np.diff(begins, append=len(rows))
        return sums / np.maximum(counts, 1)[:, None]

    def losses(self, outputs: np.ndarray) -> np.ndarray:
        """Per text and language the weighted loss of reading its codeword in the outputs."""
        margins = (outputs - self.middle) / self.spread
        agree = np.logaddexp(0, -STEEPNESS * margins)  # loss of a bit that should be +1
        differ = np.logaddexp(0, STEEPNESS * margins)
        return agree @ (self.trust * (self.code > 0)).T + differ @ (self.trust * (self.code < 0)).T

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the language whose codeword has the least loss (ties: the first), and a
        score: its share of exp(-loss)."""
        losses = self.losses(self.outputs(texts))
        share = np.exp(losses.min(axis=1, keepdims=True) - losses)
        return losses.argmin(axis=1), 1 / share.sum(axis=1)


def fit_classifiers(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log ratios of n-gram frequencies in the languages of either side of each bit.

    Every language counts alike, however many texts it has, and all are smoothed by the same
    frequency, that of half an n-gram in the smallest: with the same count instead, rare n-grams
    would speak for the language of the fewest texts. Buckets never seen have weight 0.
    """
    totals = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    smooth = counts / totals + 0.5 / totals.min()
    plus, minus = code > 0, code < 0
    left = (plus.T @ smooth) / plus.sum(axis=0)[:, None]
    right = (minus.T @ smooth) / minus.sum(axis=0)[:, None]
    weights = np.log(left / right).T
    weights[counts.sum(axis=0) == 0] = 0
    return np.ascontiguousarray(weights, np.float32)


def calibrate(languages: tuple[str, ...], code: np.ndarray, weights: np.ndarray, labels: np.ndarray, outputs: np.ndarray) -> LanguageModel:
    """Scale every classifier so that the means of its two sides are at +1 and -1, and weigh
    its loss for a language by how often it is right about that language."""
    bits = code.shape[1]
    middle, spread = np.zeros(bits), np.ones(bits)
    for bit in range(bits):
        sides = [[outputs[labels == k, bit].mean() for k in np.flatnonzero(code[:, bit] == s) if (labels == k).any()] for s in (1, -1)]
        if sides[0] and sides[1]:
            high, low = np.mean(sides[0]), np.mean(sides[1])
            middle[bit], spread[bit] = (high + low) / 2, max((high - low) / 2, 1e-6)
    right = np.ones(code.shape)
    for k in range(len(languages)):
        own = outputs[labels == k]
        right[k] = ((np.sign(own - middle) == code[k]).sum(axis=0) + 1) / (len(own) + 2)
    trust = right / np.maximum(right.mean(axis=1, keepdims=True), 1e-9) if bits else right
    return LanguageModel(languages, code, weights, middle, spread, trust)


# --- on tables ------------------------------------------------------------------------


def held_out(id_: Column) -> Column:
    """Rows that are never learned from; a null id is one of them."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _count_ngrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and bucket the n-grams of a task, and per language its rows (bucket -1)."""
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}

    def made() -> Iterator[pa.RecordBatch]:
        for language, all_ in counts.items():
            buckets = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([language] * (len(buckets) + 1), pa.string()),
                    pa.array(np.append(buckets, -1), pa.int32()),
                    pa.array(np.append(all_[buckets], rows[language]), pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )
        counts.clear()
        rows.clear()

    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            texts.setdefault(language, []).append(text)
        for language, own in texts.items():
            all_ = counts.setdefault(language, np.zeros(1 << BUCKET_BITS, np.int64))
            rows[language] = rows.get(language, 0) + len(own)
            for buckets, _ in hashed_ngrams(own):
                all_ += np.bincount(buckets, minlength=len(all_))
            if len(counts) > 100:
                yield from made()
    yield from made()


def _outputs(model: LanguageModel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.outputs(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["lang", "outputs"])

    return run


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", calibration: int = CALIBRATION
) -> LanguageModel:
    """Classifiers from the n-grams of all rows that are not held out and have a text and a
    language, and weights of bits from about ``calibration`` of them in each language.

    N-grams are counted within tasks; what comes to the driver is a table of languages times
    buckets. Without any such row there are no languages.
    """
    rows = docs.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`")))
    rows = rows.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    found = arrow_stage(rows, _count_ngrams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    named = found["lang"].to_pylist()
    languages = tuple(sorted(set(named)))
    number = {language: k for k, language in enumerate(languages)}
    of = np.array([number[x] for x in named], np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    counts, n_rows = np.zeros((len(languages), 1 << BUCKET_BITS)), np.zeros(len(languages))
    seen = bucket >= 0
    counts[of[seen], bucket[seen]] = n[seen]
    n_rows[of[~seen]] = n[~seen]
    code = codewords(len(languages))
    weights = fit_classifiers(counts, code) if len(languages) else np.zeros((1 << BUCKET_BITS, 0), np.float32)
    raw = calibrate(languages, code, weights, np.empty(0, int), np.empty((0, code.shape[1])))
    if not code.shape[1]:
        return raw
    share = F.create_map(*[F.lit(x) for k, language in enumerate(languages) for x in (language, float(calibration / n_rows[k]))])
    dice = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = rows.where(dice < F.element_at(share, F.col("lang")))
    sample = arrow_stage(chosen, _outputs(raw), "lang string, outputs array<double>").limit(2 * calibration * len(languages)).toArrow()
    labels = np.array([number[x] for x in sample["lang"].to_pylist()], np.int64)
    outputs = np.array(sample["outputs"].to_pylist()).reshape(len(labels), code.shape[1])
    return calibrate(languages, code, weights, labels, outputs)


def _predict(model, kinds: str):
    target = arrow_schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(part.num_columns - 1)
                told = np.array([bool(known.languages and t and _LETTER.search(t)) for t in texts.to_pylist()])
                names, scores = np.full(len(told), UNKNOWN, object), np.zeros(len(told))
                if told.any():
                    best, share = known.predict(texts.filter(pa.array(told)).cast(pa.binary()).to_pylist())
                    names[told], scores[told] = [known.languages[k] for k in best], share
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(told & (scores < AMBIGUOUS))],
                    schema=target,
                )

    return run


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, from the text alone.

    A null text, one without a letter, or any text if nothing was learned, is ``und`` with
    score 0. Every row and column is kept; columns of those three names are replaced. Whole
    texts are read, in slices, so a very long one needs no more memory than its own size.
    """
    added = ("lang_pred", "score", "ambiguous")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    text = fresh_name(kept, "_read_text")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema) + "lang_pred string, score double, ambiguous boolean"
    given = kept.withColumn(text, F.col(f"`{text_col}`"))
    return arrow_stage(given, _predict(docs.sparkSession.sparkContext.broadcast(model), schema), schema)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
