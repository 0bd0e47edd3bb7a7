from dataclasses import replace

import pytest
from fakes import FixedFactory, NumbersFactory

from vectorloom.operators import provenance
from vectorloom.operators.provenance import matching, stale_keys
from vectorloom.plans import refresh as refreshing
from vectorloom.plans.refresh import compact, current_vectors, refresh
from vectorloom.registry import GEMMA, REGISTRY
from vectorloom.sources.keyindex import KeyIndex

SPACE = {"model": "gemma", "build": GEMMA.default_build, "task": "query", "dimensions": 2}


def _texts(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def _stored(spark, path):
    return spark.read.parquet(path).where("ok = 1")


def test_refresh_embeds_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "vectors")

    def run(rows, **options):
        failed = refresh(
            _texts(spark, rows), path, "gemma", "query", 2, factory=NumbersFactory(), normalize=False, **options
        )
        return _texts(spark, rows), sorted(tuple(r) for r in failed.collect())

    texts, failed = run([(i, str(i)) for i in range(5)] + [(9, "gone"), (10, None)])
    no_text = (10, 422, "payloads: every item should be a valid string")
    assert failed == [(9, 503, "gemma model server unavailable: no route"), no_text]
    assert _stored(spark, path).count() == 5
    # One text edited, one new, the failed one repaired; the rest is left alone.
    texts, failed = run([(0, "100")] + [(i, str(i)) for i in range(1, 6)] + [(9, "9"), (10, None)])
    assert failed == [no_text] and _stored(spark, path).count() == 8
    now = current_vectors(texts, spark.read.parquet(path), **SPACE)
    assert {r.id: r.embedding[0] for r in now.collect()} == {0: 100.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0, 5: 5.0, 9: 9.0}
    compact(texts, path, str(tmp_path / "small"), **SPACE)
    assert spark.read.parquet(str(tmp_path / "small")).count() == 7
    run([(i, str(i)) for i in range(1, 6)])
    assert _stored(spark, path).count() == 8
    # Another build: everything again, in its own folder.
    run([(i, str(i)) for i in range(1, 6)], build="other.gguf")
    assert _stored(spark, path).where("build = 'other.gguf'").count() == 5


def test_tasks_prompts_and_limits_are_part_of_a_vector(spark, tmp_path):
    path = str(tmp_path / "vectors")
    texts = _texts(spark, [(1, "a b c d e"), (2, "f")])

    def run(task, **options):
        refresh(texts, path, "gemma", task, 2, factory=FixedFactory((1.0, 0.0)), **options)
        return _stored(spark, path).count()

    assert [run("query"), run("document"), run("document"), run("query")] == [2, 4, 4, 4]
    prompted = [replace(m, document_prompt="passage: ") for m in REGISTRY]
    assert [run("document", registry=prompted), run("document", registry=prompted)] == [6, 6]
    # A shorter context changes only the text that no longer fits.
    narrow = [replace(m, n_ctx=10) for m in REGISTRY]
    assert [run("document", registry=narrow), run("document", registry=narrow)] == [7, 7]
    # An encoder that cuts by itself sees the limit, not the cut text.
    assert [run("document", truncate=False), run("document", truncate=False)] == [9, 9]


def test_repeated_rows_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = [(1, "1"), (1, "1"), (2, "2"), (2, "3"), (3, "1")]
    for more in ([], [(4, "4"), (4, "4")]):
        refresh(_texts(spark, rows + more), path, "gemma", "query", 2, factory=NumbersFactory(), normalize=False)
    got = sorted((r.id, r.embedding[0]) for r in _stored(spark, path).collect())
    assert got == [(1, 1.0), (2, 2.0), (2, 3.0), (3, 1.0), (4, 4.0)]


@pytest.mark.parametrize("keep", [True, False])
def test_many_keys_are_matched_without_moving_the_rest(spark, monkeypatch, keep):
    rows = spark.range(5000).selectExpr("id", "cast(id % 7 as string) as text_hash", "repeat('x', 50) as text")
    keys = rows.where("id % 100 = 3").select("id", "text_hash")
    want = {i for i in range(5000) if (i % 100 == 3) == keep}
    for few in (10**6, 10):
        monkeypatch.setattr(provenance, "FEW_KEYS", few)
        found = matching(rows, keys, ["id", "text_hash"], keep)
        assert found.columns == rows.columns and {r.id for r in found.collect()} == want
    # Beyond the broadcast limit it is a plain join of Spark's, without a filter of our own.
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("Join") == 1 and "_bits" not in shown and "broadcast" not in shown


def test_stale_keys(spark):
    keys = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], "id long, text_hash string, n long")
    current = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x")], "id long, text_hash string")
    assert sorted(map(tuple, stale_keys(keys, current).collect())) == [(2, "b", 1), (3, "c", 2)]


def test_stored_keys_are_not_shuffled(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vectors")
    rows = [(i, str(i)) for i in range(50)]
    refresh(_texts(spark, rows), path, "gemma", "query", 2, factory=NumbersFactory())
    plans = []

    def seen(keys, current, *rest):
        plans.append(stale_keys(keys, current, *rest))
        return plans[-1]

    monkeypatch.setattr(refreshing, "stale_keys", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        refresh(_texts(spark, rows + [(99, "7")]), path, "gemma", "query", 2, factory=NumbersFactory())
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left, right = plan[: plan.index("Bucketed: true")], plan[plan.index("Bucketed: true") :]
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in left  # the incoming keys, once
    assert left.index("Exchange") < left.rindex("Sort ") and "Exchange" not in right
    assert _stored(spark, path).count() == 51


def test_an_interrupted_run_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vectors")
    rows = [(i, str(i)) for i in range(5)]

    def run(texts):
        refresh(_texts(spark, texts), path, "gemma", "query", 2, factory=NumbersFactory(), normalize=False)
        return _stored(spark, path).count()

    def dies(self, run, keys):
        raise RuntimeError("lost")

    for more, n in (([], 5), ([(7, "7")], 6)):  # in the first run, and in a later one
        with monkeypatch.context() as patch:
            patch.setattr(KeyIndex, "finish", dies)
            with pytest.raises(RuntimeError):
                run(rows + more)
        assert _stored(spark, path).count() == n
        assert run(rows + more) == n and not KeyIndex(spark, path, SPACE).pending()
    assert run([(7, "8")]) == 7


def test_a_table_without_an_index_gets_one(spark, tmp_path):
    path, other = str(tmp_path / "vectors"), str(tmp_path / "copied")
    rows = [(i, str(i)) for i in range(5)]
    refresh(_texts(spark, rows), path, "gemma", "query", 2, factory=NumbersFactory())
    compact(_texts(spark, rows), path, other, **SPACE)
    refresh(_texts(spark, rows + [(6, "6")]), other, "gemma", "query", 2, factory=NumbersFactory())
    assert _stored(spark, other).count() == 6
    index = KeyIndex(spark, other, SPACE)
    assert index.exists and index.table().count() == 6


@pytest.mark.parametrize("copies", [1, 40])
def test_a_refresh_passes_over_its_texts_twice(spark, tmp_path, copies):
    """``copies`` of 40 rows come twice; a row with a null id equals no other."""
    path, read = str(tmp_path / "vectors"), spark.sparkContext.accumulator(0)

    def given(rows):
        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return _texts(spark, rows).mapInArrow(count, "id long, text string")

    rows = [(i, str(i)) for i in range(40)]
    rows += rows[:copies] + [(None, "5"), (None, "5"), (0, "77")]
    refresh(given(rows), path, "gemma", "query", 2, factory=NumbersFactory(), normalize=False)
    want = sorted([(i, float(i)) for i in range(40)] + [(-1, 5.0), (-1, 5.0), (0, 77.0)])

    def held():
        return sorted((-1 if r.id is None else r.id, r.embedding[0]) for r in _stored(spark, path).collect())

    assert held() == want
    passes, more = read.value, [(i, str(i + 100)) for i in range(40)]
    changed = [r for r in rows if r[0] is not None] + more + more
    refresh(given(changed), path, "gemma", "query", 2, factory=NumbersFactory(), normalize=False)
    assert held() == sorted(want + [(i, float(i + 100)) for i in range(40)])
    assert read.value - passes <= 2 * len(changed)  # for their fingerprints, then the stale ones


def test_a_first_build_counts_ids_without_reading_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i % 30, str(i % 30)) for i in range(60)], "id long, text string").write.parquet(str(tmp_path / "in"))
    plans = []
    stored = refreshing.materialize

    def seen(frame, label):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return stored(frame, label)

    monkeypatch.setattr(refreshing, "materialize", seen)
    path = str(tmp_path / "vectors")
    refresh(spark.read.parquet(str(tmp_path / "in")), path, "gemma", "query", 2, factory=NumbersFactory())
    assert len(plans) == 1 and "struct<id:bigint>" in plans[0] and "md5" not in plans[0]
    assert _stored(spark, path).count() == 30
