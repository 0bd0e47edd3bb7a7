"""The embedding jobs on Structured Streaming.

Each micro-batch runs the same transformation as a bulk job. The source limits how much a
micro-batch takes in; the checkpoint and sinks written once per stream and batch make a
restarted job give each request exactly one outcome. A request that is delivered again is known
by its key, which the state store keeps for a while, and is not answered again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from vectorloom.operators.embedding import ROW_BYTES
from vectorloom.operators.quality import readiness, status_totals
from vectorloom.operators.requests import fits_row
from vectorloom.plans.bulk import LARGE, embed_large_requests, embed_requests, encode_request_texts
from vectorloom.registry import REGISTRY
from vectorloom.schemas import REQUEST


def read_request_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = REQUEST,
    *,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
    glob: str | None = None,
    format: str = "parquet",
) -> DataFrame:
    """A folder of request files, or one file, as a stream; how much one batch takes in can be
    limited by files or by bytes, but not by both."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place) and files.getFileStatus(place).isFile():
        path = f"{place.getParent()}/{{{place.getName()}}}"  # Spark streams a file only by a pattern
    reader = spark.readStream.format(format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


# How long a request's key is kept, counted from its first delivery.
ONCE_WITHIN = "1 day"


def first_deliveries(requests: DataFrame, keys: Sequence[str], within: str = ONCE_WITHIN) -> DataFrame:
    """``requests`` without those whose keys were delivered before, in this or an earlier
    micro-batch, up to ``within`` ago.

    The time that counts is that of the micro-batch, so nothing is ever late. Keys live in the
    state store below the checkpoint: they survive restarts, and leave after ``within``. A row
    with a null key cannot be told from others like it; it always passes.
    """
    unknown = F.lit(False)
    for key in keys:
        unknown = unknown | F.col(key).isNull()
    timed = requests.withColumns(
        {"_delivered": F.current_timestamp(), "_unknown": F.when(unknown, F.uuid())}
    ).withWatermark("_delivered", within)
    return timed.dropDuplicatesWithinWatermark([*keys, "_unknown"]).drop("_delivered", "_unknown")


def embed_stream(
    rows: DataFrame,
    out: str,
    checkpoint: str,
    *,
    every: str | None = None,
    once_within: str | None = ONCE_WITHIN,
    **options,
) -> StreamingQuery:
    """Long-form requests to a Parquet table of vectors and errors, one row per payload.

    A payload that is delivered again within ``once_within`` is not encoded again; None
    keeps no state and encodes every row. What the models answered is counted in the same pass;
    a :class:`ReadinessListener` reports it after every micro-batch.
    """
    if once_within:
        rows = first_deliveries(rows, ("request_id", "payload_index"), once_within)
    encoded = encode_request_texts(rows, **options)
    told = encoded.withColumns({"status": F.coalesce("error.status", F.lit(200)), "kind": F.col("error.kind")})
    encoded = told.observe(READINESS, *status_totals(**_models(options))).drop("status", "kind")
    writer = encoded.writeStream.format("parquet").outputMode("append").option("path", out)
    return _start(writer, checkpoint, every)


def embed_stream_with_dead_letters(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = ("request_id",),
    every: str | None = None,
    join_output: bool = False,
    once_within: str | None = ONCE_WITHIN,
    row_bytes: int = ROW_BYTES,
    **options,
) -> StreamingQuery:
    """Array-form requests to tables below ``out``: ``outcomes``, ``dead_letters`` and ``readiness``.

    A micro-batch is encoded and written once. Its failures are then copied from that
    stored result, never from a second run that might turn out differently. Both writes
    replace the folder of their stream (the id in its checkpoint) and batch number, so
    repeating a batch changes nothing and streams never touch each other's batches. An ``out``
    with the batches of another stream is refused unless ``join_output`` is set: after a lost
    checkpoint a source that is read again is answered again.

    A request that is delivered again within ``once_within`` of its first delivery, in the same
    batch, a later one or after a restart, has the one outcome it had; requests without a key
    are answered each time. None keeps no state and answers every row.

    ``readiness`` holds what the models answered in each batch (``model, n_ok, n_failed, status``),
    counted by the pass that writes the outcomes. A request whose vectors exceed ``row_bytes`` is
    answered in long form: its outcome has no vectors, they are in ``response_parts``, which is
    there only for batches with such requests. Nothing is read again in a batch without them.
    """

    spark = requests.sparkSession
    known = _stream_id(spark, checkpoint)
    others = [s for s in _stored_streams(spark, f"{out}/outcomes") if s != known]
    if others and not join_output:
        raise ValueError(f"{out} holds the output of other streams ({', '.join(others)}); pass join_output=True to add to it")

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        place = f"stream_id={_stream_id(session, checkpoint)}/batch_id={number}"
        outcomes = f"{out}/outcomes/{place}"
        counts = status_totals(**_models(options))
        answers = embed_requests(batch, keys=keys, row_bytes=row_bytes, **options)
        large = F.coalesce(F.col("kind") == LARGE, F.lit(False))
        found, seen = Observation(), Observation()
        answers = answers.observe(found, F.count_if(large).alias("n_large")).where(~large)
        answers.observe(seen, *counts).write.mode("overwrite").parquet(outcomes)
        totals = seen.get
        if found.get["n_large"]:
            rest = batch.where(~fits_row(row_bytes, options.get("registry") or REGISTRY))
            late, parts = embed_large_requests(rest, keys=keys, **options)
            added = Observation()
            late.observe(added, *counts).write.mode("append").parquet(outcomes)
            parts.write.mode("overwrite").parquet(f"{out}/response_parts/{place}")
            totals = {name: n + added.get[name] for name, n in totals.items()}
        ready = session.createDataFrame(readiness(totals, **_models(options)), _READINESS_ROW)
        ready.coalesce(1).write.mode("overwrite").parquet(f"{out}/readiness/{place}")
        written = session.read.parquet(outcomes)
        line = [c for c in ("request_line",) if c in written.columns and c not in keys]
        failed = written.where(F.col("status") != 200).select(*keys, "status", "detail", *line)
        failed.write.mode("overwrite").parquet(f"{out}/dead_letters/{place}")

    if once_within:
        requests = first_deliveries(requests, keys, once_within)
    return _start(requests.writeStream.foreachBatch(store), checkpoint, every)


# Fixed value: the name of the counts among a stream's observed metrics.
READINESS = "readiness"
_READINESS_ROW = "model string, n_ok long, n_failed long, status string"


class ReadinessListener(StreamingQueryListener):
    """Calls ``report(query name or id, batch number, rows)`` after every micro-batch of
    :func:`embed_stream`, with the ``readiness`` of its active models.

    The counts come with the progress event: no outcome is read again and no job runs.
    Give it the ``active`` and ``registry`` of the stream.
    """

    def __init__(self, report: Callable[[str, int, list[dict]], None], **models):
        self.report, self.models = report, models

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        totals = (progress.observedMetrics or {}).get(READINESS)
        if totals is not None:
            self.report(progress.name or str(progress.id), progress.batchId, readiness(totals.asDict(), **self.models))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _models(options: dict) -> dict:
    """Those of the options that say which models are active."""
    return {k: options[k] for k in ("active", "registry") if options.get(k) is not None}


def embed_lanes(
    requests: DataFrame, out: str, checkpoint: str, *, pool: str | None = "{lane}", **options
) -> dict[str, StreamingQuery]:
    """One source of array-form requests as two streams side by side, ``query`` and ``document``.

    Each lane is an :func:`embed_stream_with_dead_letters` with its own checkpoint and tables, in
    folders of its name below ``checkpoint`` and ``out``, so that a large batch of documents never
    delays the next batch of queries. Their jobs run in the scheduler pools that ``pool`` names, which
    share the cores task by task; that needs ``spark.scheduler.mode=FAIR`` (weights go into
    ``spark.scheduler.allocation.file``). ``pool=None`` leaves the pool as it is. Requests of
    no known task are answered, with their error, in the document lane. Both lanes read the
    source; each passes over the other's rows. A request is answered once within its lane.
    """
    spark = requests.sparkSession
    context = spark.sparkContext
    if pool is not None and context.getConf().get("spark.scheduler.mode", "FIFO").upper() != "FAIR":
        raise ValueError("lanes share cores only with spark.scheduler.mode=FAIR; pass pool=None to run them without pools")
    is_query = F.coalesce(F.col("task") == "query", F.lit(False))
    before = context.getLocalProperty("spark.scheduler.pool")
    started = {}
    try:
        for lane, rows in (("query", is_query), ("document", ~is_query)):
            if pool is not None:
                # a stream keeps the properties of the thread that starts it
                context.setLocalProperty("spark.scheduler.pool", pool.format(lane=lane))
            started[lane] = embed_stream_with_dead_letters(
                requests.where(rows), f"{out}/{lane}", f"{checkpoint}/{lane}", **options
            )
    finally:
        context.setLocalProperty("spark.scheduler.pool", before)
    return started


def _stream_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id that Spark keeps in a checkpoint, None if it has not been used yet."""
    try:
        return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first().value)["id"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _stored_streams(spark: SparkSession, path: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/stream_id=*")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
    return [f.getPath().getName().partition("=")[2] for f in files or []]


def _start(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    """Without ``every`` the query takes what is there and ends."""
    timing = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**timing).start()
