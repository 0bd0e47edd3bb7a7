"""The encoder stage: requests in, vectors or an outcome per request out.

One Arrow pass without a shuffle. Each Arrow batch is divided into lanes (model, task)
and each lane into calls of whole requests. Only keys, texts and widths enter the stage,
since Catalyst cannot prune columns behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from vectorloom.encoders.base import EncoderFactory, describe_failure, load_encoder
from vectorloom.schemas import OUTCOME

# Texts per call, and per document sub-call.
CALL_TEXTS = 256
DOCUMENT_CHUNK_TEXTS = 8
# What fits into one row; larger requests go through the long form, see split_by_size.
ROW_BYTES = 2**31 - 2**20

_OUTCOME_ARROW = pa.struct(
    [("kind", pa.string()), ("code", pa.int32()), ("message", pa.string())]
)


def encode_requests(
    requests: DataFrame,
    factory: EncoderFactory,
    keys: Sequence[str],
    *,
    double: bool = False,
    normalize: bool = True,
    call_texts: int = CALL_TEXTS,
    chunk_texts: int = DOCUMENT_CHUNK_TEXTS,
) -> DataFrame:
    """Encode ``texts`` of every request.

    ``requests`` holds the key columns and ``model``, ``task``, ``texts`` (prompted and
    cut to the context) and ``dimensions``. The result holds the keys, ``embeddings``
    (one per text in order, null if the request failed) and ``outcome``. A request whose
    ``texts`` are null is passed by without a call and has no outcome. Vectors are cut
    to the request's own width and scaled to length 1 in double; ``double`` keeps that
    precision in the result, ``normalize=False`` returns them unscaled.
    """
    keys = list(keys)
    requests = requests.select(
        *keys,
        F.col("model").alias("_model"),
        F.col("task").alias("_task"),
        F.col("texts").alias("_texts"),
        F.col("dimensions").cast("long").alias("_width"),
    )
    item = T.DoubleType() if double else T.FloatType()
    schema = T.StructType(
        [requests.schema[k] for k in keys]
        + [
            T.StructField("embeddings", T.ArrayType(T.ArrayType(item))),
            T.StructField("outcome", OUTCOME),
        ]
    )
    stage = _stage(factory, keys, np.float64 if double else np.float32, normalize, call_texts, chunk_texts)
    return requests.mapInArrow(stage, schema)


def encode_texts(texts: DataFrame, factory: EncoderFactory, keys: Sequence[str], **options) -> DataFrame:
    """``encode_requests`` for one text per row (column ``text``): ``embedding``, ``outcome``."""
    single = texts.withColumn("texts", F.when(F.col("text").isNotNull(), F.array("text")))
    return encode_requests(single, factory, keys, **options).select(
        *keys, F.get("embeddings", F.lit(0)).alias("embedding"), "outcome"
    )


def _stage(
    factory: EncoderFactory, keys: list[str], dtype: type, normalize: bool, call_texts: int, chunk_texts: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            model, task = table["_model"].to_pylist(), table["_task"].to_pylist()
            sizes = table["_texts"].combine_chunks().value_lengths().to_pylist()
            absent: dict[str, Exception] = {}  # models that did not load for this batch
            for rows in _calls(list(zip(model, task)), sizes, call_texts):
                part = _pick(table, rows)
                widths = part["_width"].to_pylist()
                if sizes[rows[0]] is None:
                    results = [None] * len(rows)
                else:
                    chunk = chunk_texts if task[rows[0]] == "document" else call_texts
                    results = _call(factory, model[rows[0]], part["_texts"], widths, chunk, dtype, absent)
                vectors = _embeddings(results, widths, dtype, normalize)
                outcome = pa.array([_outcome(r) for r in results], _OUTCOME_ARROW)
                columns = [part[k].combine_chunks() for k in keys] + [vectors, outcome]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "embeddings", "outcome"])

    return run


def _pick(table: pa.Table, rows: list[int]) -> pa.Table:
    """The given rows, without a copy if they are neighbours."""
    if rows[-1] - rows[0] + 1 == len(rows):
        return table.slice(rows[0], len(rows))
    return table.take(pa.array(rows))


def _call(
    factory: EncoderFactory, model: str, texts: pa.ChunkedArray, widths: list[int], chunk: int, dtype: type,
    absent: dict[str, Exception],
) -> list[np.ndarray | Exception]:
    """The results of one call. A model that does not load fails its own requests only."""
    if model not in absent:
        try:
            encoder = load_encoder(factory, model)
        except Exception as error:  # noqa: BLE001 - belongs to the requests, not to the job
            absent[model] = error
    if model in absent:
        return [absent[model]] * len(widths)
    counts = texts.combine_chunks().value_lengths().to_pylist()
    if len(widths) == 1 and counts[0] * widths[0] * np.dtype(dtype).itemsize > ROW_BYTES:
        # A row cannot hold that much; vectorloom.operators.requests.split_by_size keeps such
        # requests in long form. Found before anything is encoded.
        return [ValueError("the vectors of this request exceed one row; pass it in long form")]
    return _isolate(encoder, texts.to_pylist(), chunk, max(widths))


def _outcome(result: np.ndarray | Exception | None) -> dict | None:
    if result is None:
        return None
    ok = isinstance(result, np.ndarray)
    cells = ("ok", None, None) if ok else describe_failure(result)
    return dict(zip(("kind", "code", "message"), cells))


def _calls(
    lanes: list[tuple[str, str]], sizes: list[int | None], call_texts: int
) -> Iterator[list[int]]:
    """Row numbers grouped into calls: one lane each, whole requests in order, closed once
    the call holds ``call_texts`` texts. Rows without texts form groups of their own."""
    open_calls: dict[tuple[str, str] | None, list[int]] = {}
    filled: dict[tuple[str, str] | None, int] = {}
    for row, (lane, size) in enumerate(zip(lanes, sizes)):
        if size is None:
            lane, size = None, 1
        open_calls.setdefault(lane, []).append(row)
        filled[lane] = filled.get(lane, 0) + size
        if size >= call_texts and len(open_calls[lane]) > 1:
            # a large request is a call of its own: its width is nobody else's
            yield [open_calls[lane].pop()]
            filled[lane] -= size
        elif filled[lane] >= call_texts:
            yield open_calls.pop(lane)
            del filled[lane]
    yield from open_calls.values()


def _isolate(encoder, requests: list[list[str]], chunk: int, width: int) -> list[np.ndarray | Exception]:
    """Vectors per request; a request that makes its call fail gets the exception instead.

    A failing call is halved until the failing requests stand alone, so a few bad ones
    cost a logarithmic number of extra calls and their neighbours are encoded.
    """
    try:
        vectors = _encode_in_chunks(encoder, [t for texts in requests for t in texts], chunk, width)
        ends = np.cumsum([len(texts) for texts in requests])
        return np.split(vectors, ends[:-1])
    except Exception as error:  # noqa: BLE001 - any failure belongs to a request
        if len(requests) == 1:
            return [error]
        half = len(requests) // 2
        return _isolate(encoder, requests[:half], chunk, width) + _isolate(encoder, requests[half:], chunk, width)


def _encode_in_chunks(encoder, texts: list[str], chunk: int, width: int) -> np.ndarray:
    """Encode in order, cut to ``width`` chunk by chunk, so that full-width vectors of one
    chunk at most are held. The first chunk that fails decides the error."""
    vectors = np.zeros((0, 0), np.float32)
    for at in range(0, len(texts), chunk):
        part = texts[at : at + chunk]
        block = np.asarray(encoder.encode(part))
        if len(block) != len(part):
            raise ValueError(f"encoder returned {len(block)} vectors for {len(part)} texts")
        if at == 0:
            vectors = np.empty((len(texts), min(width, block.shape[1])), block.dtype)
        vectors[at : at + len(part)] = block[:, :width]
    return vectors


def _embeddings(
    results: list[np.ndarray | Exception | None],
    widths: list[int | None],
    dtype: type,
    normalize: bool,
) -> pa.Array:
    """The results as ``list<list<float>>``, null for failed requests.

    Rows are scaled together with all others of their width, not request by request.
    """
    good = [isinstance(r, np.ndarray) for r in results]
    counts = np.array([len(r) if ok else 0 for r, ok in zip(results, good)], np.int64)
    blocks = [r for r in results if isinstance(r, np.ndarray) and len(r)]
    block = np.concatenate(blocks) if blocks else np.zeros((0, 0))
    native = block.shape[1]
    lengths = np.repeat(np.array([min(w or 0, native) for w in widths], np.int64), counts)
    ends = np.cumsum(lengths)
    values = np.empty(int(lengths.sum()), dtype)
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        cut = block[rows, :width]
        places = (ends[rows] - width)[:, None] + np.arange(width)
        values[places] = _unit(cut) if normalize else cut
    inner = pa.ListArray.from_arrays(_offsets(ends), pa.array(values))
    failed = pa.array([not ok for ok in good])
    return pa.ListArray.from_arrays(_offsets(np.cumsum(counts)), inner, mask=failed)


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], ends]).astype(np.int32))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double; rows of length zero or NaN become zeros."""
    wide = vectors.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    usable = norms > 0
    wide[~usable] = 0.0
    with np.errstate(invalid="ignore"):
        wide[usable] /= norms[usable, None]
    return wide
