"""Where results go: responses, vector tables, dead letters."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectorloom.operators.requests import regroup_responses
from vectorloom.session import materialize

VECTOR_LAYOUT = ("model", "build", "task", "dimensions")


def claim_space(spark: SparkSession, path: str, model: str, build: str) -> None:
    """Make the table at ``path`` an index of one (model, build).

    The first writer puts ``<path>.space`` where none is; the file system lets one win. Who comes
    later with the same space passes, so a writer may try again; with another one it is refused.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.space")
    files = place.getFileSystem(conf)
    wanted = {"model": model, "build": build}
    try:
        out = files.create(place, False)
    except Py4JJavaError as taken:
        if "FileAlreadyExists" not in taken.java_exception.getClass().getName():
            raise
        held = spark.read.text(place.toString(), wholetext=True).first()
        if held is None or not held.value:
            raise ValueError(f"{place.toString()} is empty: its writer died, remove it") from None
        if json.loads(held.value) != wanted:
            raise ValueError(f"{path} holds vectors of {held.value}, not of {json.dumps(wanted)}") from None
        return
    try:
        out.write(bytearray(json.dumps(wanted).encode()))
    finally:
        out.close()


def write_vectors(
    vectors: DataFrame, path: str, *, rebalance: bool = False, mode: str = "append",
    space: tuple[str, str] | None = None,
) -> None:
    """A Parquet vector table laid out by model, build, task and width.

    Vectors are comparable only within one model and build, and a text's document and query
    vectors differ, so a reader that asks for one space lists only its folders. ``rebalance`` evens out
    file sizes with one shuffle when a write mixes many spaces; adaptive execution then splits
    the largest ones. With a ``space`` (model, build) the table is an index of that space alone: see
    :func:`claim_space`; a vector of another space among ``vectors`` fails the job.
    """
    missing = [c for c in VECTOR_LAYOUT if c not in vectors.columns]
    if missing:
        raise ValueError(f"vectors need the provenance columns {missing}")
    if space:
        claim_space(vectors.sparkSession, path, *space)
        other = (F.col("model") != space[0]) | (F.col("build") != space[1])
        told = F.raise_error(F.concat(F.lit("vector of another space: "), F.concat_ws(" ", "model", "build")))
        # not a filter: a check of every row that is written
        vectors = vectors.withColumn("model", F.when(F.coalesce(other, F.lit(True)), told).otherwise(F.col("model")))
    if rebalance:
        vectors = vectors.hint("rebalance", *VECTOR_LAYOUT)
    vectors.write.mode(mode).partitionBy(*VECTOR_LAYOUT).parquet(path)


def write_responses(outcomes: DataFrame, path: str, *, format: str = "json", mode: str = "append") -> None:
    """``request_id, embeddings`` of the requests that succeeded."""
    good = outcomes.where(F.col("status") == 200).select("request_id", "embeddings")
    good.write.mode(mode).format(format).save(path)


def write_response_parts(
    vectors: DataFrame, path: str, *, part_texts: int = 1024, format: str = "json", mode: str = "append"
) -> None:
    """``request_id, part, embeddings`` of long-form requests that succeeded, empty ones included.
    The parts of a request, in order, are its answer."""
    regroup_responses(vectors, part_texts).write.mode(mode).format(format).save(path)


def write_errors(outcomes: DataFrame, path: str, *, mode: str = "append") -> None:
    """``request_id, status, detail`` of the requests that failed, and their ``request_line`` where the
    outcomes carry one: what could not be read is found again by it."""
    line = [c for c in ("request_line",) if c in outcomes.columns]
    bad = outcomes.where(F.col("status") != 200).select("request_id", "status", "detail", *line)
    bad.write.mode(mode).parquet(path)


def write_outcomes(
    outcomes: DataFrame, responses: str, errors: str, *, format: str = "json", mode: str = "append"
) -> None:
    """Both of the above from one run: outcomes are stored first, so that no text is encoded
    twice. The two tables are written one after the other; a job that fails between them is
    run again into new folders."""
    stored = materialize(outcomes, "outcomes")
    write_responses(stored, responses, format=format, mode=mode)
    write_errors(stored, errors, mode=mode)
