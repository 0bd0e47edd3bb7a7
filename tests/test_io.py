import json
import os

import pytest
from fakes import NumbersFactory
from pyspark.sql import functions as F

from vectorloom.plans.bulk import embed_requests, encode_request_texts
from vectorloom.schemas import REQUEST, REQUEST_TEXT
from vectorloom.session import drop_scratch, materialize, scratch_path, shared_dir
from vectorloom.sources.requests import parse_requests
from vectorloom.sources.sinks import write_outcomes, write_vectors
from vectorloom.sources.texts import read_texts
from vectorloom.streaming.jobs import embed_stream, embed_stream_with_dead_letters, read_request_stream


def _outcomes(spark):
    rows = [(i, "gemma", "query", [str(i), "1"] if i % 3 else ["refused"], 2) for i in range(9)]
    return embed_requests(spark.createDataFrame(rows, REQUEST), factory=NumbersFactory(), normalize=False)


def test_responses_and_dead_letters(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    write_outcomes(_outcomes(spark), good, bad)
    lines = [json.loads(line) for name in os.listdir(good) if name.endswith(".json") for line in open(f"{good}/{name}")]
    assert sorted((r["request_id"], r["embeddings"]) for r in lines) == [
        (i, [[float(i), 1.0], [1.0, 1.0]]) for i in range(9) if i % 3
    ]
    letters = spark.read.parquet(bad)
    assert letters.columns == ["request_id", "status", "detail"]
    assert sorted(tuple(r) for r in letters.collect()) == [(i, 500, "gemma: refused") for i in (0, 3, 6)]


@pytest.mark.parametrize("rebalance", [False, True])
def test_vector_table_layout_prunes(spark, tmp_path, rebalance):
    path = str(tmp_path / "vectors")
    rows = [(i, ("gemma", "qwen")[i % 2], "query", (8, 16)[i % 4 // 2], 0, "1") for i in range(40)]
    encoded = encode_request_texts(spark.createDataFrame(rows, REQUEST_TEXT))
    write_vectors(encoded.select("request_id", "embedding", "model", "build", "task", "dimensions"), path, rebalance=rebalance)
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["model=gemma", "model=qwen"]
    one = spark.read.parquet(path).where("model = 'qwen' and dimensions = 16")
    assert one.count() == 10 and one.select(F.max(F.size("embedding"))).first()[0] == 16
    assert "PartitionFilters: [isnotnull(model" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        write_vectors(encoded.select("request_id", "embedding", "model"), path)


def test_read_texts_spreads_and_prunes(spark, small):
    texts = read_texts(spark, f"{small}/documents.parquet", "doc_id", "text")
    assert texts.columns == ["id", "text"] and texts.rdd.getNumPartitions() >= 8
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in texts._jdf.queryExecution().executedPlan().toString()


def test_stream_gives_what_the_bulk_job_gives(spark, tmp_path):
    rows = [(i, ("gemma", "bogus")[i % 5 == 0], "query", 4, j, f"text {i} {j}") for i in range(30) for j in range(3)]
    frame = spark.createDataFrame(rows, REQUEST_TEXT)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame.repartition(6).write.parquet(source)
    stream = read_request_stream(spark, source, REQUEST_TEXT, files_per_trigger=2)
    query = embed_stream(stream, out, str(tmp_path / "cp"))
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 3
    key = lambda df: sorted(map(str, df.select("request_id", "payload_index", "embedding", "error").collect()))
    assert key(spark.read.parquet(out)) == key(encode_request_texts(frame))
    # A restart from the checkpoint takes only what is new.
    more = spark.createDataFrame([(99, "gemma", "query", 4, 0, "new")], REQUEST_TEXT)
    more.write.mode("append").parquet(source)
    embed_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert key(spark.read.parquet(out)) == key(encode_request_texts(frame.union(more)))


def test_stream_limited_by_bytes(spark, tmp_path):
    frame = spark.createDataFrame([(i, "gemma", "query", 4, 0, "x" * 200) for i in range(40)], REQUEST_TEXT)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame.repartition(4).write.parquet(source)
    query = embed_stream(
        read_request_stream(spark, source, REQUEST_TEXT, bytes_per_trigger=2000), out, str(tmp_path / "cp")
    )
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) > 1
    assert spark.read.parquet(out).select("request_id").distinct().count() == 40


def test_stream_of_json_lines_with_dead_letters(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for part in range(3):
        lines = [
            json.dumps({"request_id": 10 * part + i, "model": "gemma", "task": "query", "payloads": [p], "dimensions": 2})
            for i, p in enumerate(["1", "2", "refused", "4", "gone", 5])
        ]
        (source / f"{part}.json").write_text("\n".join(lines))
    text = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))

    def run(checkpoint):
        embed_stream_with_dead_letters(
            parse_requests(text), out, str(tmp_path / checkpoint), factory=NumbersFactory()
        ).awaitTermination()
        outcomes, letters = spark.read.parquet(f"{out}/outcomes"), spark.read.parquet(f"{out}/dead_letters")
        assert {r.request_id for r in outcomes.where("status = 200").collect()} == {10 * p + i for p in range(3) for i in (0, 1, 3)}
        got = sorted((r.request_id, r.status) for r in letters.collect())
        assert got == sorted((10 * p + i, s) for p in range(3) for i, s in ((2, 500), (4, 503), (5, 422)))
        assert outcomes.count() == 18

    run("cp")
    # A line that cannot be read leads back to itself.
    assert '"payloads": [5]' in spark.read.parquet(f"{out}/dead_letters").where("request_id = 5").first().request_line
    # Another stream does not touch these batches, and has to say that it adds to them.
    with pytest.raises(ValueError, match="other streams"):
        run("other")
    before = spark.read.parquet(f"{out}/outcomes").count()
    other = tmp_path / "more"
    other.mkdir()
    (other / "0.json").write_text(json.dumps({"request_id": 77, "model": "gemma", "task": "query", "payloads": ["7"]}))
    embed_stream_with_dead_letters(
        parse_requests(spark.readStream.text(str(other))), out, str(tmp_path / "second"), factory=NumbersFactory(), join_output=True
    ).awaitTermination()
    outcomes = spark.read.parquet(f"{out}/outcomes")
    assert outcomes.count() == before + 1 and outcomes.where("request_id = 77").count() == 1


def test_scratch_is_below_the_shared_folder(spark):
    path = scratch_path(spark, "x")
    assert path.startswith(shared_dir(spark).rstrip("/") + "/vectorloom-") and "/x-" in path


def test_scratch_goes_when_a_job_ends(spark):
    stored = materialize(spark.range(3), "gone")
    folder = stored.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
    drop_scratch(spark)
    assert not os.path.isdir(folder)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_dir(Session())
