import numpy as np
from pyspark.sql import functions as F

from vectorloom.llm.neighbours import grow_forest, leaf_bounds, nearest, op9_neighbours, visited_leaves

SCHEMA = "vec_id long, embedding array<float>, class string, rank int"


def slow(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v):
            good.setdefault(i, []).append(np.float32(v).astype(float))
    result = []
    for q in good:
        if q % 2 == 0:
            near = sorted((-float((v * good[q][0]).sum()), i) for i, vs in good.items() if i != q for v in vs[:1])[:k]
            result += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return sorted(result)


def run(spark, rows, k=3, **options):
    rows = [(i, v and [x if x is None else float(x) for x in v], "x", 1) for i, v in rows]
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, nearest(frame, F.col("vec_id") % 2 == 0, k=k, **options).collect()))


def test_a_wide_search_is_exact(spark):
    random = np.random.default_rng(0)
    rows = [(i, np.float32(random.normal(size=4)).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # copies of one vector
    for options in ({}, {"block": 16, "leaf": 8, "trees": 3, "leaves": 10_000},
                    {"sample": 40, "leaf": 4, "trees": 2, "leaves": 10_000, "split": 30, "ways": 3, "block": 16}):
        got, want = run(spark, rows, **options), slow(rows, 3)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_split_leaves_have_the_priorities_of_the_queue():
    random = np.random.default_rng(1)
    points, queries = random.normal(size=(300, 4)), random.normal(size=(20, 4))
    tree = grow_forest(points, 1, 10)
    bounds = leaf_bounds(tree, queries)
    queue = visited_leaves(tree, queries, np.ones(tree.leaves, int), tree.leaves, 1)
    for row, found in zip(bounds, queue):
        assert len(found) == tree.leaves and np.allclose([row[leaf] for leaf, _ in found], [b for _, b in found])
        assert (np.diff([b for _, b in found]) >= 0).all() and row.min() == 0


def test_leaves_fuller_than_the_sample_are_split(spark):
    random = np.random.default_rng(2)
    centres = random.normal(size=(60, 4)) * 4
    rows = [(i, np.float32(centres[i % 60] + random.normal(size=4) / 4).tolist()) for i in range(1200)]
    rows += [(i, rows[3][1]) for i in range(1200, 1300)]
    got = run(spark, rows, sample=100, leaf=16, trees=6, leaves=12, split=64, ways=4, k=5)
    want = slow(rows, 5)
    assert len(got) == len(want) and len({g[:3] for g in got} & {w[:3] for w in want}) > 0.9 * len(want)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0, 0, 0]), (1, [0.5, 0, 0, 0]), (2, None), (3, [0.0, 0, 0, 0]), (4, [float("nan"), 0, 0, 1]), (5, [1.0, None, 0, 0]),
        (6, [float("inf"), 0, 0, 0]), (7, [1.0, 2.0]), (None, [1.0, 0, 0, 0]), (8, [0.5, 0, 0, 0]), (8, [0.5, 0, 0, 0]), (9, []), (10, [-0.0, 0, 2, 0]),
    ]
    assert run(spark, rows, k=20) == slow(rows, 20)
    assert run(spark, []) == [] and run(spark, [(0, [1.0, 0, 0, 0])]) == [] and run(spark, [(0, None)]) == []


def test_recall(spark):
    folder = "/root/testdata/sf0.1"
    found = op9_neighbours(spark, folder).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    matrix = np.stack([rows[i] for i in ids])
    asked = ids[ids % 20 == 0]
    lists = {}
    for r in found:
        lists.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in asked.tolist():
        scores = matrix @ rows[q]
        best = [i for i in ids[np.lexsort((ids, -scores))].tolist() if i != q][:20]
        assert sorted(lists[q]) == list(range(1, 21))
        assert all(abs(s - float(rows[i] @ rows[q])) < 1e-12 for i, s in lists[q].values())
        hits += len(set(best) & {i for i, _ in lists[q].values()})
    assert hits / (20 * len(asked)) >= 0.95
