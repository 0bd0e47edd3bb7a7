"""A request that is delivered more than once is answered once."""

from fakes import NumbersFactory

from vectorloom.schemas import REQUEST, REQUEST_TEXT
from vectorloom.streaming.jobs import embed_stream, embed_stream_with_dead_letters, read_request_stream


def _deliver(spark, path, rows):
    frame = spark.createDataFrame([(i, "gemma", "query", p, 2) for i, p in rows], REQUEST)
    frame.coalesce(1).write.mode("append").parquet(path)


def test_one_outcome_per_request(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(**options):
        stream = read_request_stream(spark, source, REQUEST, files_per_trigger=1)
        embed_stream_with_dead_letters(stream, out, str(tmp_path / "cp"), factory=NumbersFactory(), **options).awaitTermination()
        outcomes = spark.read.parquet(f"{out}/outcomes").collect()
        return sorted((r.request_id is None, r.request_id or 0, r.status) for r in outcomes)

    _deliver(spark, source, [(1, ["1"]), (2, ["refused"]), (1, ["1"]), (None, ["1"])])
    _deliver(spark, source, [(1, ["1"]), (3, ["3"]), (None, ["1"])])
    first = [(False, 1, 200), (False, 2, 500), (False, 3, 200), (True, 0, 200), (True, 0, 200)]
    assert run() == first
    # The failed one too has its answer; a restart knows what was answered before it.
    _deliver(spark, source, [(2, ["2"]), (4, ["4"]), (3, ["3"])])
    assert run() == sorted([*first, (False, 4, 200)])
    letters = spark.read.parquet(f"{out}/dead_letters").collect()
    assert [r.request_id for r in letters] == [2]


def test_without_a_memory_every_delivery_is_answered(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _deliver(spark, source, [(1, ["1"]), (1, ["1"])])
    stream = read_request_stream(spark, source, REQUEST)
    embed_stream_with_dead_letters(stream, out, str(tmp_path / "cp"), factory=NumbersFactory(), once_within=None).awaitTermination()
    assert spark.read.parquet(f"{out}/outcomes").count() == 2


def test_keys_leave_when_their_time_is_over(spark, tmp_path):
    import time

    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = read_request_stream(spark, source, REQUEST)
        query = embed_stream_with_dead_letters(
            stream, out, str(tmp_path / "cp"), factory=NumbersFactory(), once_within="2 seconds"
        )
        query.awaitTermination()
        return spark.read.parquet(f"{out}/outcomes").where("request_id = 1").count(), query.lastProgress

    _deliver(spark, source, [(1, ["1"])])
    assert run()[0] == 1
    time.sleep(4)
    _deliver(spark, source, [(5, ["5"])])  # moves the time on
    run()
    time.sleep(1)
    _deliver(spark, source, [(1, ["1"])])
    count, progress = run()
    assert count == 2 and progress.stateOperators[0].numRowsTotal <= 2


def test_one_vector_per_payload(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        frame = spark.createDataFrame([(7, "gemma", "query", 2, k, str(k)) for k in range(3)], REQUEST_TEXT)
        frame.coalesce(1).write.mode("append").parquet(source)
    embed_stream(read_request_stream(spark, source, REQUEST_TEXT, files_per_trigger=1), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.payload_index for r in spark.read.parquet(out).collect()) == [0, 1, 2]
